import asyncio
import hashlib
import struct

import pytest

from logstrata import Database, EngineError, Options
from logstrata.server import Config, Server, config


class Client:
    """Just enough of the protocol to see what the server says."""

    async def open(self, port, user="logstrata", password="logstrata"):
        self.reader, self.writer = await asyncio.open_connection("127.0.0.1", port)
        body = struct.pack("!i", 196608) + f"user\0{user}\0database\0logs\0\0".encode()
        self.writer.write(struct.pack("!i", len(body) + 4) + body)
        kind, data = await self.read()
        assert kind == b"R" and struct.unpack("!i", data[:4]) == (5,)
        inner = hashlib.md5((password + user).encode()).hexdigest()
        self.send(b"p", ("md5" + hashlib.md5(inner.encode() + data[4:]).hexdigest()).encode() + b"\0")
        return await self.until(b"ZE")

    def send(self, kind, body=b""):
        self.writer.write(kind + struct.pack("!i", len(body) + 4) + body)

    async def read(self):
        kind = await self.reader.readexactly(1)
        return kind, await self.reader.readexactly(struct.unpack("!i", await self.reader.readexactly(4))[0] - 4)

    async def until(self, kinds=b"Z"):
        out = []
        while True:
            out.append(await asyncio.wait_for(self.read(), 60))
            if out[-1][0] in [bytes([k]) for k in kinds]:
                return out

    async def query(self, sql):
        self.send(b"Q", sql.encode() + b"\0")
        return await self.until()

    async def in_portions(self, sql, most, times):
        self.send(b"P", b"p\0" + sql.encode() + b"\0" + struct.pack("!h", 0))
        self.send(b"B", b"q\0p\0" + struct.pack("!hhh", 0, 0, 0))
        for _ in range(times):
            self.send(b"E", b"q\0" + struct.pack("!i", most))
        self.send(b"S")
        return await self.until()

    async def prepared(self, sql, values, oids=()):
        self.send(b"P", b"s\0" + sql.encode() + b"\0" + struct.pack(f"!h{len(oids)}i", len(oids), *oids))
        self.send(b"D", b"Ss\0")
        body = b"\0s\0" + struct.pack("!hh", 0, len(values))
        for v in values:
            body += struct.pack("!i", -1) if v is None else struct.pack("!i", len(v.encode())) + v.encode()
        self.send(b"B", body + struct.pack("!h", 0))
        self.send(b"D", b"P\0")
        self.send(b"E", b"\0" + struct.pack("!i", 0))
        self.send(b"S")
        return await self.until()


def cells(messages):
    out = []
    for kind, body in messages:
        if kind == b"D":
            at, row = 2, []
            for _ in range(struct.unpack("!h", body[:2])[0]):
                (size,) = struct.unpack_from("!i", body, at)
                at += 4
                row.append(None if size < 0 else body[at : at + size].decode())
                at += max(size, 0)
            out.append(tuple(row))
    return out


def tags(messages):
    return [body.rstrip(b"\0").decode() for kind, body in messages if kind == b"C"]


def columns(messages):
    """Names and type numbers of the last description."""
    body = [b for k, b in messages if k == b"T"][-1]
    out, at = [], 2
    for _ in range(struct.unpack("!h", body[:2])[0]):
        end = body.index(b"\0", at)
        out.append((body[at:end].decode(), struct.unpack_from("!ihi", body, end + 1)[2]))
        at = end + 19
    return out


def errors(messages):
    return [body.decode() for kind, body in messages if kind == b"E"]


def test_server(spark, tmp_path):
    async def run():
        with Database.open(str(tmp_path / "db"), Options(), spark) as db:
            listening = await Server(db, Config("", listen="127.0.0.1:0")).listen()
            port = listening.sockets[0].getsockname()[1]
            async with listening:
                assert errors(await Client().open(port, password="wrong"))
                client = Client()
                assert (await client.open(port))[-1][0] == b"Z"
                got = await client.query("CREATE TABLE logs (ts TIMESTAMP, service TEXT, x REAL, ok BOOL); INSERT INTO logs VALUES (1, 'api', 1.5, TRUE), (2, NULL, 2, FALSE); SELECT * FROM logs ORDER BY ts")
                assert tags(got) == ["CREATE TABLE", "INSERT 0 2", "SELECT 2"]
                assert cells(got) == [("1", "api", "1.5", "t"), ("2", None, "2.0", "f")]
                assert columns(got) == [("ts", 20), ("service", 25), ("x", 701), ("ok", 16)]
                assert columns(await client.query("SELECT COUNT(*) FROM logs WHERE ts > 99")) == [("count", 20)]
                assert "JOIN clauses" in errors(await client.query("SELECT * FROM a JOIN b ON a.x = b.x"))[0]
                assert tags(await client.query("SET x = 1")) == ["SET"]
                assert cells(await client.query("SHOW server_encoding;")) == [("UTF8",)]
                assert cells(await client.query("SELECT current_user")) == [("logstrata",)]
                assert cells(await client.query("SHOW TABLES")) == [("logs",)]
                # A quote in a value stays in the value.
                got = await client.prepared("INSERT INTO logs VALUES ($1, $2, $3, $4)", ["3", "it's'; DROP TABLE logs; --", "2", "true"])
                assert tags(got) == ["INSERT 0 1"] and not errors(got)
                assert [b for k, b in got if k == b"t"][0] == struct.pack("!h4i", 4, 20, 25, 701, 16)
                got = await client.prepared("SELECT service, x FROM logs WHERE ts IN ($1, $2) AND x >= $3", ["3", "1", "2"])
                assert cells(got) == [("it's'; DROP TABLE logs; --", "2.0")] and columns(got) == [("service", 25), ("x", 701)]
                assert "no value for parameter" in errors(await client.prepared("SELECT x FROM logs WHERE ts = $2", ["1"]))[0]
                assert cells(await client.query("SELECT 1.0 / 0.0 AS v, 2 + 3 AS w")) == [("Infinity", "5")]
                # Rows in portions: two, then the third and last, then none.
                got = await client.in_portions("SELECT ts FROM logs ORDER BY ts", 2, 3)
                assert [k for k, _ in got if k in b"DsC"] == [b"D", b"D", b"s", b"D", b"C", b"C"]
                assert cells(got) == [("1",), ("2",), ("3",)] and tags(got) == ["SELECT 1", "SELECT 0"]
                client.send(b"X")
                client.writer.close()

    asyncio.run(run())


def test_configuration():
    assert config(["db"], {}) == Config("db")
    env = {"LOGSTRATA_PATH": "x", "LOGSTRATA_ROW_GROUP_SIZE": "7", "LOGSTRATA_SYNC_ON_FLUSH": "off", "LOGSTRATA_USER": "u"}
    assert config(["--row-group-size", "9", "--query-threads", "2"], env) == Config("x", row_group_size=9, sync_on_flush=False, query_threads=2, user="u")
    with pytest.raises(EngineError):
        config([], {})
    with pytest.raises(EngineError):
        config(["db"], {"LOGSTRATA_QUERY_THREADS": "0"})
    with pytest.raises(SystemExit):
        config(["db", "--query-threads", "0"], {})
