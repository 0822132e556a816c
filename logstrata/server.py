"""A server that speaks PostgreSQL's wire protocol, version 3, over one database. For trusted networks: no TLS.

Simple and extended queries; parameters are bound as literals in the parsed statement, never as text. Result columns have the types
of the DataFrame's schema. There are no transactions, cursors, COPY or system catalogs.
"""

from __future__ import annotations

import argparse
import asyncio
import contextlib
import dataclasses
import hashlib
import os
import struct
import sys
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from logstrata.database import Database, Options, Result
from logstrata.errors import EngineError
from logstrata.plans import ir
from logstrata.plans.parser import parse
from logstrata.types import BOOL, INT, REAL, TEXT, TIMESTAMP, display, value_kind

VERSION = "1.0"
PREFIX = "LOGSTRATA_"
#: Fixed values of the protocol: type numbers and sizes.
OIDS = {INT: (20, 8), TIMESTAMP: (20, 8), REAL: (701, 8), BOOL: (16, 1), TEXT: (25, -1)}
_WHOLE_OIDS, _REAL_OIDS = {20, 21, 23}, {700, 701, 1700}
#: Rows sent at a time; results stream from the executors partition by partition.
BATCH = 1000

SETTINGS = {
    "server_version": VERSION, "client_encoding": "UTF8", "server_encoding": "UTF8", "transaction_read_only": "off", "standard_conforming_strings": "on",
    "integer_datetimes": "on", "application_name": "", "is_superuser": "off", "session_authorization": None, "DateStyle": "ISO, MDY",
}


@dataclasses.dataclass(frozen=True)
class Config:
    database: str
    listen: str = "127.0.0.1:5433"
    row_group_size: int = 16384
    sync_on_flush: bool = True
    query_threads: int | None = None
    user: str = "logstrata"
    password: str = "logstrata"

    @property
    def address(self) -> tuple[str, int]:
        host, _, port = self.listen.rpartition(":")
        return host or "127.0.0.1", int(port)


def _flag(text: str) -> bool:
    if text.lower() in ("true", "1", "yes", "on"):
        return True
    if text.lower() in ("false", "0", "no", "off"):
        return False
    raise argparse.ArgumentTypeError(f"invalid boolean: {text}")


def _positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"must be greater than zero: {text}")
    return int(text)


def config(argv: list[str], environment: dict[str, str] | None = None) -> Config:
    """Flags win over the environment's LOGSTRATA_*, which wins over the defaults."""
    env = os.environ if environment is None else environment
    kinds: dict[str, Callable] = {"row_group_size": _positive, "sync_on_flush": _flag, "query_threads": _positive}
    parser = argparse.ArgumentParser(prog="logstrata.server")
    parser.add_argument("database", nargs="?", default=env.get(PREFIX + "PATH"))
    for field in dataclasses.fields(Config)[1:]:
        kind = kinds.get(field.name, str)
        given = env.get(PREFIX + field.name.upper())
        try:
            default = kind(given) if given is not None else field.default
        except argparse.ArgumentTypeError as error:
            raise EngineError(f"{PREFIX}{field.name.upper()}: {error}") from error
        parser.add_argument("--" + field.name.replace("_", "-"), type=kind, default=default)
    args = parser.parse_args(argv)
    if not args.database:
        raise EngineError(f"a database is needed: its path, or {PREFIX}PATH")
    return Config(**vars(args))


# -- parameters


def _bound(node: Any, values: list[Any]) -> Any:
    """The statement with literals in place of its parameters."""
    if isinstance(node, ir.Param):
        if not 1 <= node.number <= len(values):
            raise EngineError(f"no value for parameter {node.text}")
        return ir.Literal(values[node.number - 1], node.text)
    if isinstance(node, tuple):
        return tuple(_bound(x, values) for x in node)
    if dataclasses.is_dataclass(node) and not isinstance(node, type):
        return dataclasses.replace(node, **{f.name: _bound(getattr(node, f.name), values) for f in dataclasses.fields(node)})
    return node


def _expected(db: Database, command: Any) -> dict[int, str]:
    """The kind each parameter should have, from the column it is stored in or compared with."""
    found: dict[int, str] = {}
    table = getattr(command, "table", None)
    if table not in db.catalog.tables:
        return found
    columns = db.catalog.tables[table].columns
    kinds = {c["name"]: c["type"] for c in columns}

    def walk(where: Any) -> None:
        if isinstance(where, (ir.And, ir.Or)):
            for part in where.parts:
                walk(part)
        for value in getattr(where, "values", ()) or ([where.value] if isinstance(where, ir.Compare) else []):
            if isinstance(value, ir.Param):
                found[value.number] = kinds.get(where.column, TEXT)

    if isinstance(command, ir.Insert):
        for row in command.rows:
            for column, value in zip(columns, row, strict=False):
                if isinstance(value, ir.Param):
                    found[value.number] = column["type"]
    elif isinstance(command, ir.Select):
        walk(command.where)
    return found


def _count(node: Any) -> int:
    if isinstance(node, ir.Param):
        return node.number
    if isinstance(node, tuple):
        return max(map(_count, node), default=0)
    if dataclasses.is_dataclass(node) and not isinstance(node, type):
        return max((_count(getattr(node, f.name)) for f in dataclasses.fields(node)), default=0)
    return 0


def _value(data: bytes | None, binary: bool, oid: int, kind: str | None) -> Any:
    if data is None:
        return None
    if binary:
        if oid in _WHOLE_OIDS or (not oid and kind in (INT, TIMESTAMP)):
            return int.from_bytes(data, "big", signed=True)
        if oid in (700, 701) or (not oid and kind == REAL):
            return struct.unpack("!d" if len(data) == 8 else "!f", data)[0]
        if oid == 16 or (not oid and kind == BOOL):
            return data != b"\0"
        return data.decode()
    text = data.decode()
    kind = INT if oid in _WHOLE_OIDS and kind not in (REAL,) else REAL if oid in _REAL_OIDS else BOOL if oid == 16 else kind
    try:
        if kind in (INT, TIMESTAMP):
            return int(text)
        if kind == REAL:
            return float(text)
    except ValueError as error:
        raise EngineError(f"invalid value for {kind}: {text!r}") from error
    if kind == BOOL:
        return text.lower() in ("t", "true", "1", "on", "yes")
    return text


# -- messages


def _message(kind: bytes, body: bytes = b"") -> bytes:
    return kind + struct.pack("!i", len(body) + 4) + body


def _string(text: str) -> bytes:
    return text.encode() + b"\0"


def _error(text: str, code: str = "XX000") -> bytes:
    return _message(b"E", b"S" + _string("ERROR") + b"C" + _string(code) + b"M" + _string(text) + b"\0")


def _description(columns: list[str], kinds: list[str], formats: list[int]) -> bytes:
    body = struct.pack("!h", len(columns))
    for i, (name, kind) in enumerate(zip(columns, kinds, strict=True)):
        oid, size = OIDS[kind]
        body += _string(name) + struct.pack("!ihihih", 0, 0, oid, size, -1, _format(formats, i))
    return _message(b"T", body)


def _format(formats: list[int], i: int) -> int:
    return formats[i] if i < len(formats) and len(formats) > 1 else formats[0] if formats else 0


def _cell(value: Any, kind: str, binary: int) -> bytes:
    if value is None:
        return struct.pack("!i", -1)
    if binary and kind != TEXT:
        data = struct.pack("!q", value) if kind in (INT, TIMESTAMP) else struct.pack("!d", value) if kind == REAL else bytes([value])
    elif isinstance(value, bool):
        data = b"t" if value else b"f"
    elif isinstance(value, float):
        data = {float("inf"): "Infinity", float("-inf"): "-Infinity"}.get(value, "NaN" if value != value else repr(value)).encode()
    else:
        data = display(value).encode()
    return struct.pack("!i", len(data)) + data


def _builtin(sql: str, settings: dict[str, str], database: str, user: str) -> tuple[str, str] | None:
    """Column and value of what clients ask of any server."""
    text = " ".join(sql.strip().rstrip(";").split())
    upper = text.upper()
    if upper.startswith("SHOW "):
        name = next((n for n in settings if n.upper() == upper[5:]), None)
        return (name, settings[name]) if name else None
    fixed = {"SELECT VERSION()": ("version", f"logstrata {VERSION}"), "SELECT CURRENT_DATABASE()": ("current_database", database), "SELECT CURRENT_USER": ("current_user", user), "SELECT CURRENT_USER()": ("current_user", user)}
    return fixed.get(upper)


@dataclasses.dataclass
class _Statement:
    sql: str
    command: Any
    oids: list[int]


@dataclasses.dataclass
class _Portal:
    statement: _Statement
    command: Any
    formats: list[int]
    kinds: list[str] = dataclasses.field(default_factory=list)
    rows: Iterator | None = None  # what is left after an Execute that asked for fewer


class _Client:
    def __init__(self, server: Server, reader: asyncio.StreamReader, writer: asyncio.StreamWriter):
        self.server, self.reader, self.writer = server, reader, writer
        self.statements: dict[str, _Statement] = {}
        self.portals: dict[str, _Portal] = {}
        self.database = "logstrata"
        self.failed = False  # an extended query failed: all is skipped until Sync

    async def start(self) -> bool:
        while True:
            size = struct.unpack("!i", await self.reader.readexactly(4))[0]
            body = await self.reader.readexactly(size - 4)
            version = struct.unpack("!i", body[:4])[0]
            if version in (80877103, 80877104):  # requests for TLS or GSS encryption
                self.writer.write(b"N")
                await self.writer.drain()
                continue
            if version == 80877102:  # to cancel another session's query
                return False
            break
        words = body[4:].split(b"\0")
        options = {k.decode(): v.decode() for k, v in zip(words[::2], words[1::2], strict=False) if k}
        user = options.get("user", "")
        self.database = options.get("database", user)
        salt = os.urandom(4)
        self.writer.write(_message(b"R", struct.pack("!i", 5) + salt))
        await self.writer.drain()
        kind, answer = await self.read()
        config = self.server.config
        inner = hashlib.md5((config.password + config.user).encode()).hexdigest()
        wanted = "md5" + hashlib.md5(inner.encode() + salt).hexdigest()
        if kind != b"p" or user != config.user or answer.rstrip(b"\0").decode() != wanted:
            self.writer.write(_error(f'password authentication failed for user "{user}"', "28P01"))
            await self.writer.drain()
            return False
        self.writer.write(_message(b"R", struct.pack("!i", 0)))
        for name, value in self.settings.items():
            self.writer.write(_message(b"S", _string(name) + _string(value)))
        self.writer.write(_message(b"K", struct.pack("!ii", os.getpid(), 0)) + self.ready())
        await self.writer.drain()
        return True

    @property
    def settings(self) -> dict[str, str]:
        return {k: self.server.config.user if v is None else v for k, v in SETTINGS.items()}

    @staticmethod
    def ready() -> bytes:
        return _message(b"Z", b"I")

    async def read(self) -> tuple[bytes, bytes]:
        kind = await self.reader.readexactly(1)
        size = struct.unpack("!i", await self.reader.readexactly(4))[0]
        return kind, await self.reader.readexactly(size - 4)

    async def serve(self) -> None:
        if not await self.start():
            return
        handlers = {b"P": self.on_parse, b"B": self.on_bind, b"D": self.on_describe, b"E": self.on_execute, b"C": self.on_close}
        while True:
            kind, body = await self.read()
            if kind == b"X":
                return
            if kind == b"Q":
                await self.on_query(body[:-1].decode())
            elif kind == b"S":
                self.failed = False
                self.writer.write(self.ready())
            elif kind in handlers and not self.failed:
                try:
                    await handlers[kind](body)
                except Exception as error:  # noqa: BLE001  the client is told, and may go on
                    self.failed = True
                    self.writer.write(_error(_said(error)))
            await self.writer.drain()

    async def on_query(self, sql: str) -> None:
        try:
            if not sql.strip(" ;\n\t"):
                self.writer.write(_message(b"I"))
            elif self.quiet(sql):
                self.writer.write(_message(b"C", _string("SET")))
            elif found := _builtin(sql, self.settings, self.database, self.server.config.user):
                self.text_row(*found, describe=True)
            else:
                for command in parse(sql):
                    await self.answer(await self.server.call(self.server.db.run, command), [], describe=True)
        except Exception as error:  # noqa: BLE001
            self.writer.write(_error(_said(error)))
        self.writer.write(self.ready())

    @staticmethod
    def quiet(sql: str) -> bool:
        return sql.strip().upper().startswith("SET ")

    def text_row(self, column: str, value: str, describe: bool) -> None:
        if describe:
            self.writer.write(_description([column], [TEXT], []))
        self.writer.write(_message(b"D", struct.pack("!h", 1) + _cell(value, TEXT, 0)) + _message(b"C", _string("SELECT 1")))

    async def answer(self, result: Result, formats: list[int], describe: bool) -> None:
        if result.frame is None:
            self.writer.write(_message(b"C", _string(f"INSERT 0 {result.count}" if result.tag == "INSERT" else result.tag)))
            return
        kinds = result.kinds
        if describe:
            self.writer.write(_description(result.columns, kinds, formats))
        await self.rows(iter(await self.server.call(result.frame.toLocalIterator)), kinds, formats, 0)

    async def rows(self, rows: Iterator, kinds: list[str], formats: list[int], most: int) -> bool:
        """Sends rows, at most so many if not 0, and says whether there may be more."""
        n = 0
        while batch := await self.server.call(lambda: list(islice(rows, min(BATCH, most - n) if most else BATCH))):  # noqa: B023
            for row in batch:
                cells = b"".join(_cell(v, k, _format(formats, i)) for i, (v, k) in enumerate(zip(row, kinds, strict=True)))
                self.writer.write(_message(b"D", struct.pack("!h", len(row)) + cells))
            n += len(batch)
            await self.writer.drain()
            if n == most:
                self.writer.write(_message(b"s"))
                return True
        self.writer.write(_message(b"C", _string(f"SELECT {n}")))
        return False

    async def on_parse(self, body: bytes) -> None:
        name, sql, rest = body.split(b"\0", 2)
        n = struct.unpack("!h", rest[:2])[0]
        oids = list(struct.unpack(f"!{n}i", rest[2 : 2 + 4 * n]))
        text = sql.decode()
        command = None
        if text.strip(" ;\n\t") and not self.quiet(text) and not _builtin(text, self.settings, self.database, self.server.config.user):
            commands = parse(text)
            if len(commands) != 1:
                raise EngineError("a prepared statement is one statement")
            command = commands[0]
        self.statements[name.decode()] = _Statement(text, command, oids)
        self.writer.write(_message(b"1"))

    async def on_bind(self, body: bytes) -> None:
        portal, name, rest = body.split(b"\0", 2)
        statement = self.statements[name.decode()]
        at = 0

        def take(form: str) -> tuple:
            nonlocal at
            found = struct.unpack_from(form, rest, at)
            at += struct.calcsize(form)
            return found

        given = list(take(f"!{take('!h')[0]}h"))
        values, expected = [], _expected(self.server.db, statement.command)
        for i in range(take("!h")[0]):
            size = take("!i")[0]
            data = None if size < 0 else rest[at : at + size]
            at += max(size, 0)
            oid = statement.oids[i] if i < len(statement.oids) else 0
            values.append(_value(data, _format(given, i) == 1, oid, expected.get(i + 1)))
        values = [float(v) if expected.get(i + 1) == REAL and value_kind(v) == INT else v for i, v in enumerate(values)]
        formats = list(take(f"!{take('!h')[0]}h"))
        self.portals[portal.decode()] = _Portal(statement, _bound(statement.command, values), formats)
        self.writer.write(_message(b"2"))

    async def on_describe(self, body: bytes) -> None:
        name = body[1:-1].decode()
        if body[:1] == b"S":
            statement = self.statements[name]
            n = max(_count(statement.command), len(statement.oids))
            expected = _expected(self.server.db, statement.command)
            oids = [statement.oids[i] if i < len(statement.oids) and statement.oids[i] else OIDS[expected.get(i + 1, TEXT)][0] for i in range(n)]
            self.writer.write(_message(b"t", struct.pack(f"!h{n}i", n, *oids)))
            # Types do not depend on the values, so any of the right kind will do.
            sample = {INT: 0, TIMESTAMP: 0, REAL: 0.0, BOOL: False, TEXT: ""}
            portal = _Portal(statement, _bound(statement.command, [sample[expected.get(i + 1, TEXT)] for i in range(n)]), [])
        else:
            portal = self.portals[name]
        found = _builtin(portal.statement.sql, self.settings, self.database, self.server.config.user)
        if found:
            self.writer.write(_description([found[0]], [TEXT], portal.formats))
        elif isinstance(portal.command, (ir.Select, ir.Eval, ir.ShowTables, ir.Describe)):
            result = await self.server.call(self.server.db.run, portal.command, False)
            self.writer.write(_description(result.columns, result.kinds, portal.formats))
        else:
            self.writer.write(_message(b"n"))

    async def on_execute(self, body: bytes) -> None:
        name, most = body.split(b"\0", 1)
        portal = self.portals[name.decode()]
        sql, most = portal.statement.sql, max(0, struct.unpack("!i", most)[0])
        found = _builtin(sql, self.settings, self.database, self.server.config.user)
        if found:
            self.text_row(*found, describe=False)
        elif portal.command is None:
            self.writer.write(_message(b"C", _string("SET")) if self.quiet(sql) else _message(b"I"))
        else:
            if portal.rows is None:
                result = await self.server.call(self.server.db.run, portal.command)
                if result.frame is None:
                    return await self.answer(result, portal.formats, describe=False)
                portal.kinds, portal.rows = result.kinds, iter(await self.server.call(result.frame.toLocalIterator))
            if not await self.rows(portal.rows, portal.kinds, portal.formats, most):
                portal.rows = iter(())

    async def on_close(self, body: bytes) -> None:
        (self.statements if body[:1] == b"S" else self.portals).pop(body[1:-1].decode(), None)
        self.writer.write(_message(b"3"))


def _said(error: Exception) -> str:
    if isinstance(error, KeyError):
        return f"no such statement or portal: {error}"
    return str(error).splitlines()[0] if str(error) else type(error).__name__


class Server:
    def __init__(self, db: Database, config: Config):
        self.db, self.config = db, config

    @staticmethod
    async def call(function: Callable, *args: Any) -> Any:
        """Spark's calls block, so they run in threads and other clients are served meanwhile."""
        return await asyncio.get_running_loop().run_in_executor(None, function, *args)

    async def client(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        with contextlib.suppress(asyncio.IncompleteReadError, ConnectionError):
            await _Client(self, reader, writer).serve()
        writer.close()

    async def listen(self) -> asyncio.Server:
        return await asyncio.start_server(self.client, *self.config.address)

    async def run(self) -> None:
        async with await self.listen() as server:
            await server.serve_forever()


def main(argv: list[str] | None = None) -> int:
    try:
        found = config(sys.argv[1:] if argv is None else argv)
    except EngineError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    options = Options(row_group_size=found.row_group_size, sync_on_flush=found.sync_on_flush, query_threads=found.query_threads)
    with Database.open(found.database, options) as db, contextlib.suppress(KeyboardInterrupt):
        asyncio.run(Server(db, found).run())
    return 0


if __name__ == "__main__":
    sys.exit(main())
