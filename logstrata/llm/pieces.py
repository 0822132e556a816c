"""SentencePiece encoding with original byte spans, and decoding.

Every text is normalised here, by longest prefixes of the model's compiled character map, recording for every normalised byte the
source byte it stems from. The normalised text, and nothing else, is cut into the vocabulary's pieces by the library, with a copy of the
model that normalises no more; each piece is projected through the record to its byte span of the original text.

Cases: a null text counts as empty; an empty text has no ids and decodes to ''. Rows are treated one by one, so repeated rows,
ties and an empty table need no rule; other columns pass through, and an output column replaces an input column of that name.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from logstrata.llm.common import configure

SPACE = "▁"
#: Distinct units whose ids a worker keeps; beyond it the cache starts anew, which changes no result.
CACHED_UNITS = 300_000
#: Units of more characters are encoded without being kept.
CACHED_CHARS = 48

NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, followed by the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.text = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, where the replacement starts) of the longest key that is a prefix of data[at:]; (0, -1) if none."""
        units, found, node = self.units, (0, -1), 0
        node ^= self._step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._step(unit)
            if unit >> 8 & 1:
                found = (i - at + 1, units[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _step(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def replacement(self, at: int) -> bytes:
        return self.text[at : self.text.index(0, at)]


class Normaliser:
    """Normalised bytes of a text and, for each and the end, the source byte it comes from."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE.encode() if spec.escape_whitespaces else b" "
        self.plain = not self.map.units and not self.squeeze

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int32)
        if self.plain:  # an empty map: no key is a prefix of anything, so each byte stands for itself and spaces are written wider
            width = np.where(np.frombuffer(data, np.uint8) == 32, len(self.space), 1)
            align = np.repeat(np.arange(len(data), dtype=np.int32), width)
            head = self.space if self.prefix else b""
            return head + data.replace(b" ", self.space), np.concatenate([np.zeros(len(head), np.int32), align, np.array([len(data)], np.int32)])
        return self._mapped(data)

    def _chunks(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(data):
            size, where = self.map.longest(data, at) if self.map.units else (0, -1)
            if size:
                yield at, at + size, self.map.replacement(where)
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                yield at, at + size, data[at : at + size]
            at += size

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, align = bytearray(), []

        def put(piece: bytes, source: int) -> None:
            for byte in piece:
                step = self.space if byte == 32 else bytes([byte])
                out.extend(step)
                align.extend([source] * len(step))

        blank, end = self.squeeze, 0  # blank: spaces met now are dropped
        for start, stop, piece in self._chunks(data):
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                if not out and self.prefix:
                    put(b" ", start)
                put(piece, start)
                blank = self.squeeze and piece.endswith(b" ")
                end = stop
            elif not self.squeeze:
                end = stop
        while self.squeeze and out.endswith(self.space) and len(out) > 0:
            end = align[len(out) - len(self.space)]
            del out[len(out) - len(self.space) :], align[len(out) :]
        return bytes(out), np.array([*align, end], np.int32)


class Codec:
    """Encodes and decodes with one model file; made once in each worker."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalise = Normaliser(proto.normalizer_spec)
        self.space = self.normalise.space.decode()
        bare = sentencepiece_model_pb2.ModelProto()
        bare.CopyFrom(proto)
        bare.normalizer_spec.precompiled_charsmap = b""
        bare.normalizer_spec.add_dummy_prefix = bare.normalizer_spec.remove_extra_whitespaces = bare.normalizer_spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        kinds = np.array([p.type for p in proto.pieces])
        self.width = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.special = (kinds != NORMAL) & (kinds != BYTE)
        self.led = np.array([p.piece[:1] == SPACE for p in proto.pieces])  # pieces of which the first in a text loses its space
        self.kept = np.array([len(b) for b in self.bytes], np.int64)
        self.flat, self.begins = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.kept) - self.kept
        merged = [p.piece for p in proto.pieces if p.type == NORMAL]
        # Merges stay within a unit (spaces and what follows up to the next space or line feed) if no piece reaches across one.
        self.by_unit = (
            proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and self.space == SPACE
            and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in merged) and not any(p.type == USER for p in proto.pieces)
        )
        self.units: dict[str, tuple[bytes, str]] = {}
        self.numbers = [str(i) for i in range(len(proto.pieces))]
        self.pattern = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def _learn(self, units: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids of units, packed and as text."""
        number = self.numbers.__getitem__
        found = {u: (array("i", i).tobytes(), ",".join(map(number, i))) for u, i in zip(units, self.segmenter.encode(units, num_threads=1), strict=True)}
        if len(self.units) >= CACHED_UNITS:
            self.units.clear()
        self.units |= {u: f for u, f in found.items() if len(u) <= CACHED_CHARS} if max(map(len, units)) > CACHED_CHARS else found
        return found

    def ids(self, normal: bytes) -> tuple[np.ndarray, str]:
        """Ids of a normalised text, and these as decimal numbers joined by commas."""
        if not normal:
            return np.zeros(0, np.int32), ""
        text = normal.decode()
        if not self.by_unit or "\0" in text:
            ids = self.segmenter.encode(text)
            return np.array(ids, np.int32), ",".join(map(str, ids))
        units = self.pattern.findall(text)
        found = list(map(self.units.get, units))
        if None in found:
            new = self._learn(list({u for u, f in zip(units, found, strict=True) if f is None}))
            found = [f or new[u] for u, f in zip(units, found, strict=True)]
        return np.frombuffer(b"".join([f[0] for f in found]), np.int32), ",".join([f[1] for f in found])

    def encode(self, data: bytes) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """Ids, these as text, and begin and end of every piece in the bytes of the original text."""
        normal, align = self.normalise(data)
        ids, numbers = self.ids(normal)
        ends = np.cumsum(self.width[ids])
        if len(ids) and (ends[-1] != len(normal) or self.special[ids].any()):
            ends = np.cumsum([len(p.surface.encode()) if self.special[i] else self.width[i] for i, p in self._surfaces(normal, ids)])
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ids)]
        return ids, numbers, align[starts], align[ends]

    def _surfaces(self, normal: bytes, ids: np.ndarray):
        """Pieces with their surfaces, for unknown pieces, whose length the vocabulary does not tell."""
        return zip(ids.tolist(), self.segmenter.encode(normal.decode(), out_type="immutable_proto").pieces, strict=True)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if self.normalise.prefix and not self.normalise.squeeze and not self.special[ids].any():
            sizes = self.kept[ids]
            ends = np.cumsum(sizes)
            data = self.flat[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
            try:
                return (data[1:] if data[:1] == b" " and self.led[ids[0]] else data).decode()
            except UnicodeDecodeError:
                pass
        return self.processor.decode(ids.tolist())


_CODECS: dict[str, Codec] = {}


def codec(key: str, model: bytes) -> Codec:
    """A worker keeps the codec, with its units, from task to task."""
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _model(path: str) -> tuple[str, bytes]:
    with open(path, "rb") as f:
        model = f.read()
    return hashlib.sha256(model).hexdigest(), model


def _put(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch without columns of these names, and then with these."""
    left = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in left), *columns.values()], names=[*left, *columns])


def _schema(df: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in fields] + [T.StructField(n, t) for n, t in fields.items()])


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds ids, and begins and ends: the byte span of every piece in the original text.

    ``model_path`` is read on the driver; its bytes go to the workers with the function (vocabularies are megabytes).
    """
    configure(df.sparkSession)
    key, model = _model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, model)
        for batch in batches:
            rows = []
            for value in batch.column(text).to_pylist():
                ids, _, begins, ends = own.encode((value or "").encode())
                rows.append((ids, begins, ends))
            yield _put(batch, **{n: pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i, n in enumerate(("ids", "begins", "ends"))})

    ints = T.ArrayType(T.IntegerType())
    return df.mapInArrow(run, _schema(df, ids=ints, begins=ints, ends=ints))


def decode(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded: the text of the ids, as the library decodes them; null ids decode to ''."""
    configure(df.sparkSession)
    key, model = _model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, model)
        for batch in batches:
            yield _put(batch, decoded=pa.array([own.decode(np.array(v or [], np.int32)) for v in batch.column(ids).to_pylist()], pa.string()))

    return df.mapInArrow(run, _schema(df, decoded=T.StringType()))


def round_trip(df: DataFrame, model_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Encodes, projects, decodes, and returns digests: n_tokens, ids_sha256, decoded_sha256, covered_bytes (those of the source
    inside a piece's span) and exact (the decoded text is the source). One map without any exchange; a lost task is run again.
    """
    configure(df.sparkSession)
    key, model = _model(model_path)
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(key, model), hashlib.sha256
        for batch in batches:
            rows = []
            for value in batch.column(text):
                value = value.as_py() or ""
                data = value.encode()
                ids, numbers, begins, ends = own.encode(data)
                decoded = own.decode(ids).encode()
                rows.append((len(ids), sha(numbers.encode()).hexdigest(), sha(decoded).hexdigest(), int((ends - begins).sum()), decoded == data))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *(pa.array([r[i] for r in rows]) for i in range(5))], names=[id_column, *names])

    kinds = (T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.BooleanType())
    keep = df.select(id_column, text)
    return keep.mapInArrow(run, T.StructType([keep.schema[id_column], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))
