"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where a rolling hash of its last 32 bytes meets a mask, so equal texts are cut alike. Chunks become
identifiers, verified by their bytes: the least and the greatest content under a fingerprint are compared, and a fingerprint
with more than one content gives each its own number. A text then is its ordered list of identifiers, and texts are compared
by these lists. Chunk bytes cross the network once, for the verification; only lists and ids do afterwards.

Cases: a null text counts as empty, and all empty texts are equal; a null id sorts after all others; of rows that share the
smallest id and the text exactly one is kept; an empty table gives no rows; other columns pass through if
asked for, but one of an output's name gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import binary, carried, configure, materialise, neutral, raw, slices

#: A cut has an expected distance of 2**CUT_BITS bytes, at least CUT_LEAST and at most CUT_MOST.
CUT_BITS, CUT_LEAST, CUT_MOST = 11, 512, 16384
#: Chunks of shared fingerprints that the driver holds: 64 bits of 1e11 chunks are expected to have some hundreds. Where there are
#: more, identifiers are made of one fingerprint more each, until there are not.
MOST_COLLISIONS = 1000

_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 256, dtype=np.uint32)
_MASK = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def normalise(data: bytes) -> bytes:
    """Each run of spaces, tabs and line ends becomes one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    return (b" " if data[0] in b" \t\n\x0b\x0c\r" else b"") + b" ".join(words) + (b" " if data[-1] in b" \t\n\x0b\x0c\r" else b"")


def cuts(texts: pa.Array) -> list[list[int]]:
    """The ends of each text's chunks (none for an empty text)."""
    out: list[list[int]] = []
    for start, stop in slices(texts):
        data, at = raw(texts.slice(start, stop - start))
        base = int(at[0])
        h = _GEAR[data[base : int(at[-1])]]
        for shift in (1, 2, 4, 8, 16):  # h[i] = sum of gear[b[i-k]] << k over 32 bytes
            later = h[shift:] + (h[:-shift] << np.uint32(shift))
            h = np.concatenate([h[:shift], later])
        marks = np.flatnonzero((h & _MASK) == 0) + 1
        for i in range(stop - start):
            begin, end = int(at[i]) - base, int(at[i + 1]) - base
            inside = marks[np.searchsorted(marks, begin + 32, "left") : np.searchsorted(marks, end, "left")]  # windows within the text alone
            ends, last = [], begin
            for mark in [*inside.tolist(), end]:
                while mark - last > CUT_MOST:
                    last += CUT_MOST
                    ends.append(last - begin)
                if mark - last >= CUT_LEAST or mark == end > last:
                    last = mark
                    ends.append(last - begin)
            out.append(ends)
    return out


def _chunks(texts: pa.Array) -> Iterator[tuple[bytes, list[bytes]]]:
    normal = pa.array([normalise(d.as_py()) for d in texts], pa.large_binary())
    for data, ends in zip(normal, cuts(normal), strict=True):
        data, last, parts = data.as_py(), 0, []
        for end in ends:
            parts.append(data[last:end])
            last = end
        yield data, parts


def _fingerprint(part: bytes, bits: int, width: int) -> list[int]:
    """As many fingerprints as ``width``, signed, of so many bits."""
    values = [xxhash.xxh3_64_intdigest(part, seed) >> (64 - bits) for seed in range(width)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def collisions(docs: DataFrame, bits: int, width: int) -> dict[tuple[int, ...], list[bytes]] | None:
    """The fingerprints that stand for several contents, with those in order: none, as a rule. None if there are too many."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            for _, parts in _chunks(binary(batch.column(0))):
                for part in parts:
                    seen.setdefault(part, 0)
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(p, bits, width) for p in seen], pa.list_(pa.int64())), pa.array(list(seen), pa.binary())], names=["fingerprint", "chunk"])

    chunks = docs.select("__text").mapInArrow(explode, "fingerprint array<long>, chunk binary")
    several = chunks.groupBy("fingerprint").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).filter("least <> most").select("fingerprint").limit(MOST_COLLISIONS + 1).collect()
    if not several:
        return {}
    if len(several) > MOST_COLLISIONS:
        return None
    asked = docs.sparkSession.createDataFrame(several, "fingerprint array<long>")
    rows = chunks.join(F.broadcast(asked), "fingerprint").distinct().limit(MOST_COLLISIONS + 1).collect()
    if len(rows) > MOST_COLLISIONS:
        return None
    found: dict[tuple[int, ...], list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.fingerprint, bytes(r.chunk))):
        found.setdefault(tuple(r.fingerprint), []).append(bytes(r.chunk))
    return found


OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256", "n_chunks")


def exact_dedup(docs: DataFrame, text: str = "text", id_column: str = "doc_id", carry: Sequence[str] = ("doc_id",), bits: int = 64) -> DataFrame:
    """The columns ``carry`` of every row, with keep_id, group_size, kept, text_sha256 and n_chunks."""
    configure(docs.sparkSession)
    sent, passed = neutral(docs, carried(carry, OUTPUTS), __text=text, __id=id_column)
    width = 1
    while (found := collisions(sent, bits, width)) is None:
        width += 1
    known = docs.sparkSession.sparkContext.broadcast(found)  # at most MOST_COLLISIONS chunks
    kept = [c for c in sent.columns if c != "__text" or text in carry]
    added = {"__recipe": T.ArrayType(T.LongType()), "__chunks": T.IntegerType(), "__sha": T.StringType()}
    schema = T.StructType([*(sent.schema[c] for c in kept), *(T.StructField(n, t) for n, t in added.items())])

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = known.value
        for batch in batches:
            lists, sizes, digests = [], [], []
            for data, parts in _chunks(binary(batch.column("__text"))):
                ids = []
                for part in parts:
                    fingerprint = _fingerprint(part, bits, width)
                    ids += fingerprint
                    if several:  # a number for each content, beside every fingerprint alike
                        ids.append(several[tuple(fingerprint)].index(part) if tuple(fingerprint) in several else 0)
                lists.append(ids)
                sizes.append(len(parts))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lists, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(digests)], names=[*kept, *added])

    rows = materialise(sent.mapInArrow(recipes, schema).withColumn("__row", F.monotonically_increasing_id()), "recipes")
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("first")
    groups = rows.groupBy("__recipe").agg(first, F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    groups = materialise(groups.select(F.col("__recipe").alias("__of"), F.col("first.id").alias("__keep"), F.col("first.row").alias("__first"), "__size"), "groups")
    # Both sides come from tables: where a recipe is hot, adaptive execution splits its rows among tasks.
    joined = rows.join(groups, rows["__recipe"] == groups["__of"], "left")
    alone = F.col("__size").isNull()
    return joined.select(
        *passed,
        F.when(alone, F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__row") == F.col("__first"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        F.col("__chunks").alias("n_chunks"),
    )
