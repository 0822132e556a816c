"""Language-model scoring by a probabilistic suffix tree, and a unigram score of words beside it.

The tree predicts a text's words, joined by single spaces and ended by an end mark, from contexts of variable length: up to DEPTH bytes,
or the WORDS words before. A context is retained where a divergence test says that it predicts otherwise than its suffix: its count
times the divergence between the two next-symbol distributions is at least GAIN bits (for words WORD_GAIN bits beyond what writing them
down costs). That does not depend on the rest of the corpus,
so the tree grows with it. A retained context's distribution is smoothed towards its suffix's, and scoring takes the longest retained
suffix.

The next symbol of a context of bytes is a byte. This part of the tree is kept as two sorted tables, with entries only for the bytes that
followed a context, in which a text's distinct strings of DEPTH + 1 bytes are looked up together; it is broadcast, in slices of at most
TREE_BYTES by the contexts' last bytes, of which a worker holds one at a time. The next symbol of a context of words is a word
with the space or end after it, and its suffix's prediction the product over these bytes. Such contexts are as many as the corpus has
words, and they never leave the cluster's tables. One that no word follows twice in the training rows saves nothing, so a first pass finds
those that one may follow twice, from fingerprints of all strings of WORDS + 1 words; what it finds is broadcast as a bitmap, in slices of at
most TREE_BYTES, and only these contexts, with all their occurrences, are counted. A false find is counted, and then fails the test.

Counts cover all training rows. Byte counts are summed within tasks before the exchange. Frequent words' counts, at most FREQUENT, are
broadcast. For other words, and for contexts of words, tasks turn blocks of rows into numbered entries and lists of where they stand;
entries meet the counts, or each other, and their values return to the blocks as numbers. Contexts of words and fingerprints go sorted, as
differences, in compressed rows of PARTS parts. Of all these only words cross the network as text.

Cases: a null text is empty and consists of the end alone; words never trained count 0; without training rows all counts are 0 and
the tree is its root, which gives every byte the same probability; rows with equal ids or texts are scored each; ids keep their type; an
empty table gives no rows; other columns are not read. A byte 0 is read as a byte 1.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from logstrata.llm.common import binary, configure, materialise, neutral, raw, scratch, setting, slices

#: Bytes of the longest context; bits that a context must save, whatever the corpus; weight of the suffix's distribution.
DEPTH, GAIN, WEIGHT = 5, 20.0, 4.0
#: Words of a longer context, and gain and weight there.
WORDS, WORD_GAIN, WORD_WEIGHT = 4, 4.0, 0.5
#: Contexts of words are parted by the first bits of their hash. Bits of a fingerprint that come from the context, and from its next word; how
#: many fingerprints a task holds; and the bitmap's least and greatest size, as powers of two.
PART_BITS, CONTEXT_BITS, NEXT_BITS, POOL, MAP_BITS = 10, 32, 8, 1 << 22, (16, 32)
PARTS = 1 << PART_BITS
#: Removes the files of an exchange as soon as the table made from it is stored.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the tree's tables that are broadcast at once; words that are, and the length of the longest of them.
TREE_BYTES, FREQUENT, FREQUENT_LENGTH = 128 << 20, 200_000, 64
#: A context's key is its bytes, the latest highest (so that those with the same suffix lie together), with its length above them.
TAG = 8 * DEPTH
END = 10  # cannot occur in words joined by spaces
#: Text bytes that are indexed together: bounds a worker's memory and the rows of a word.
BLOCK_BYTES = 6 << 20
#: Postings hold a document's place in its block and a count below 1 << COUNT_BITS; greater counts take several.
COUNT_BITS = 12
_HELD, _HELD_WORDS = 1 << 21, 400_000  # distinct byte strings, and words, that a task holds before it passes their counts on


def plain(text: bytes) -> list[bytes]:
    """Words: A-Z in lower case, parted by ASCII blanks."""
    return text.lower().split()


def stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One array: an end mark, then each text's words with the mark after it; and where the texts end in it."""
    bodies = [b" ".join(words) for words in texts]
    data = np.frombuffer(b"\n" + b"".join(b + b"\n" for b in bodies), np.uint8)
    data = np.where(data == 0, 1, data).astype(np.uint8)
    return data, np.cumsum([len(b) + 1 for b in bodies]) + 1


def keyed(data: np.ndarray) -> np.ndarray:
    """(context, byte) for each byte of a stream but the first. The byte lies lowest, the latest of the context highest, 0 beyond a
    text's beginning."""
    wide = data.astype(np.int64)
    out = wide[1:].copy()
    for k in range(1, DEPTH + 1):
        out[k - 1 :] |= wide[: len(wide) - k] << 8 * (DEPTH + 1 - k)
    ends = np.flatnonzero(data == END)
    for d in range(1, DEPTH):  # so far behind an end, the bytes before it do not count
        behind = ends[ends + d <= len(out)] + d - 1
        out[behind] &= 255 | ((1 << 8 * d) - 1) << 8 * (DEPTH + 1 - d)
    return out


def distinct(keys: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a stream, sorted, and where each key is among them. Numbers are sorted much sooner than places by numbers, so
    keys are written shorter, by the order of the bytes that occur, with their places below."""
    there = np.unique(data)
    width, low = int(len(there)).bit_length(), int(len(keys)).bit_length()
    if (DEPTH + 1) * width + low > 63:
        return np.unique(keys, return_inverse=True)
    rank = np.zeros(256, np.int64)
    rank[there] = np.arange(1, len(there) + 1)  # 0 stands for nothing
    short = np.zeros(len(keys), np.int64)
    for b in range(DEPTH + 1):
        short |= rank[keys >> 8 * b & 255] << width * b + low
    short |= np.arange(len(keys))
    short.sort()
    at, new = short & (1 << low) - 1, np.ones(len(keys), bool)
    new[1:] = short[1:] >> low != short[:-1] >> low
    where = np.empty(len(keys), np.int64)
    where[at] = np.cumsum(new) - 1
    return keys[at[new]], where


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, byte) of a stream with counts."""
    return np.unique(keyed(data), return_counts=True)


def count_grams(rows: DataFrame, text: str) -> DataFrame:
    """(gram, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def batch_of(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1].astype(np.int64), pa.int64())], names=["gram", "n"])

        for batch in batches:
            texts = binary(batch.column(0))
            for start, stop in slices(texts):
                held.append(grams(stream([plain(t.as_py()) for t in texts.slice(start, stop - start)])[0]))
                if sum(len(h[0]) for h in held) > _HELD:
                    held = [merged()]
                    if len(held[0][0]) > _HELD // 2:
                        yield batch_of(held.pop())
        if held:
            yield batch_of(merged())

    return rows.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _bytes(length: int) -> Column:
    """The context of so many bytes of a gram."""
    return F.shiftright("gram", 8 * (DEPTH + 1 - length)) if length else F.lit(0).cast("long")


def contexts(counted: DataFrame) -> DataFrame:
    """(context, symbol, n) for all contexts that occur, of length 0 to DEPTH, from the grams."""
    symbol = F.col("gram").bitwiseAND(255)
    tables = []
    for k in range(DEPTH + 1):
        real = F.lit(True) if k < 2 else _bytes(k).bitwiseAND(255) != 0
        own = counted.filter(real).select(_bytes(k).bitwiseOR(k << TAG).alias("context"), symbol.alias("symbol"), "n")
        tables.append(own if k == DEPTH else own.groupBy("context", "symbol").agg(F.sum("n").alias("n")))  # grams are distinct
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def divergent(table: DataFrame, gain: float) -> set[int]:
    """The contexts that pass the divergence test against their suffix."""
    length = F.shiftright("context", TAG)
    suffix = F.expr(f"(shiftright(context & {(1 << TAG) - 1}, 8)) | shiftleft(shiftright(context, {TAG}) - 1, {TAG})")
    sums = table.groupBy("context").agg(F.sum("n").alias("all"))
    shares = materialise(table.join(sums, "context").withColumn("p", F.col("n") / F.col("all")), "shares")
    above = shares.select(F.col("context").alias("up"), F.col("symbol").alias("s"), F.col("p").alias("q"))
    longer = shares.filter(length > 0).withColumn("suffix", suffix)
    both = longer.join(above, (longer["suffix"] == above["up"]) & (longer["symbol"] == above["s"]))
    saved = both.groupBy("context").agg(F.sum(F.col("n") * F.log2(F.col("p") / F.col("q"))).alias("bits")).filter(F.col("bits") >= gain)
    return set(saved.select("context").toArrow().column(0).to_pylist())


def closed(chosen: set[int]) -> set[int]:
    """With all suffixes (which smoothing needs) and prefixes (so that a history's contexts follow on each other), and the root."""
    out, todo = {0}, list(chosen)
    while todo:
        key = todo.pop()
        if key not in out:
            out.add(key)
            k, value = key >> TAG, key & ((1 << TAG) - 1)
            todo.append((k - 1) << TAG | value >> 8)  # without the oldest byte
            if k > 1:
                todo.append((k - 1) << TAG | value & ((1 << 8 * (k - 1)) - 1))  # without the latest
    return out


class Tree:
    """Retained contexts with their totals, and the bytes that followed them with counts: both sorted, ended by a key beyond all."""

    def __init__(self, counts: dict[int, dict[int, int]], weight: float = WEIGHT):
        flat = [(key, symbol, n) for key, row in counts.items() for symbol, n in row.items()]
        self._fill(*(np.array([f[i] for f in flat], np.int64) for i in range(3)), weight)

    @classmethod
    def of(cls, found: pa.Table, weight: float = WEIGHT) -> Tree:
        """From a table (context, symbol, n) without repeated pairs."""
        tree = cls.__new__(cls)
        tree._fill(*(found.column(c).to_numpy().astype(np.int64) for c in ("context", "symbol", "n")), weight)
        return tree

    def _fill(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, weight: float) -> None:
        beyond = [np.iinfo(np.int64).max]
        entries = context << 8 | symbol
        order = np.argsort(entries)
        self.weight = weight
        self.entries, self.n = np.concatenate([entries[order], beyond]), np.concatenate([n[order], [0]])
        keys, place = np.unique(context, return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, place, n)
        self.contexts, self.totals = np.concatenate([keys, beyond]), np.concatenate([totals, [0]])
        self.states = max(1, len(keys))  # the root is always there
        # Probabilities of what followed: smoothed towards the suffix's, level by level. What follows a context follows its suffix.
        self.p = np.zeros(len(self.entries))
        length = self.entries[:-1] >> 8 + TAG
        for k in range(DEPTH + 1):
            own = np.flatnonzero(length == k)
            ctx, byte = self.entries[own] >> 8, self.entries[own] & 255
            suffix = (ctx & ((1 << TAG) - 1)) >> 8 | (k - 1) << TAG
            up = self.p[np.searchsorted(self.entries, suffix << 8 | byte)] if k else 1 / 256
            self.p[own] = (self.n[own] + weight * up) / (self.totals[np.searchsorted(self.contexts, ctx)] + weight)

    def chances(self, keys: np.ndarray) -> np.ndarray:
        """The probability of each (context, byte) by its longest retained context; quickest if sorted, as contexts then lie together.
        Where the byte never followed it, what smoothing leaves is the suffix's, and so on to all 256 bytes alike."""
        p, share, left = np.zeros(len(keys)), np.ones(len(keys)), np.arange(len(keys))
        for k in range(DEPTH, -1, -1):
            value = keys[left] >> 8 * (DEPTH + 1 - k) if k else np.zeros(len(left), np.int64)
            real = np.flatnonzero(value & 255) if k > 1 else np.arange(len(left))
            value = value[real]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            context, of = k << TAG | value[new], np.cumsum(new) - 1
            at = np.searchsorted(self.contexts, context)
            here = (self.contexts[at] == context)[of]
            real, of = real[here], of[here]
            entry = context[of] << 8 | keys[left[real]] & 255
            place = np.searchsorted(self.entries, entry)
            seen = self.entries[place] == entry
            p[left[real[seen]]] = share[left[real[seen]]] * self.p[place[seen]]
            share[left[real[~seen]]] *= self.weight / (self.totals[at[of[~seen]]] + self.weight)
            left = np.delete(left, real[seen])
        p[left] = share[left] / 256
        return p

    @property
    def nbytes(self) -> int:
        return self.entries.nbytes + self.p.nbytes + self.n.nbytes + self.contexts.nbytes + self.totals.nbytes

    def slices(self, limit: int) -> list[tuple[int, int, Tree]]:
        """Trees of at most ``limit`` bytes, if possible, with the range of last bytes whose contexts each has, besides the root."""
        if self.nbytes <= limit:
            return [(0, 256, self)]
        context, symbol = self.entries[:-1] >> 8, self.entries[:-1] & 255
        length = context >> TAG
        last = (context & ((1 << TAG) - 1)) >> 8 * np.maximum(length - 1, 0)
        size = np.bincount(last[length > 0], minlength=256) * 40
        out, first, held = [], 0, 0
        for b in range(257):
            if b == 256 or b > first and held + size[b] > limit:
                own = (length == 0) | (last >= first) & (last < b)
                tree = Tree.__new__(Tree)
                tree._fill(context[own], symbol[own], self.n[:-1][own], self.weight)
                out.append((first, b, tree))
                first, held = b, 0
            held += size[min(b, 255)]
        return out

    def logs(self, data: np.ndarray, first: int = 0, beyond: int = 256) -> np.ndarray:
        """log10 of the probability of each byte of a stream but the first, 0 where the byte before is not in the range."""
        keys, where = distinct(keyed(data), data)
        before = keys >> 8 * DEPTH & 255
        return np.where((first <= before) & (before < beyond), np.log10(self.chances(keys)), 0.0)[where]

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 of the probability of each text by contexts of bytes, its end included."""
        if not texts:
            return np.zeros(0)
        data, ends = stream(texts)
        return np.add.reduceat(self.logs(data), np.concatenate([[0], ends[:-1] - 1]))


def train(rows: DataFrame, text: str = "text", gain: float = GAIN) -> Tree:
    """A tree from all the rows given. The retained contexts, at most those of DEPTH bytes that occur, come to the driver as arrays."""
    configure(rows.sparkSession)
    with scratch(rows.sparkSession):  # nothing but the tree, which the driver holds, is left of these tables
        table = materialise(contexts(materialise(count_grams(rows, text), "grams")), "contexts")
        if table.isEmpty():
            return Tree({})
        keys = np.array(sorted(closed(divergent(table, gain))), np.int64)
        wanted = rows.sparkSession.createDataFrame(pa.table({"context": keys}))
        return Tree.of(table.join(F.broadcast(wanted), "context").toArrow())  # as large as the tree is


def word_counts(rows: DataFrame) -> DataFrame:
    """(w, c) of all words of the rows and of their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in binary(batch.column(0)):
                held.update(plain(text.as_py()))
                held[b"\n"] += 1
                if len(held) > _HELD_WORDS:
                    yield batch_of()
                    held.clear()
        yield batch_of()

    return rows.select("__text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed by the bytes of their numbers: the first of all, then the second, and so on."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    size, widths = int.from_bytes(data[:4], "little"), [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(data[4:], size * sum(widths), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + size * width].reshape(width, size).T).view(kind).ravel())
        at += size * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """The first number and the differences of a sorted array."""
    return np.diff(x, prepend=x.dtype.type(0))


def parted(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, beyond) of those that a sorted array has."""
    at = np.searchsorted(part, np.arange(PARTS + 1, dtype=part.dtype))
    return [(i, int(at[i]), int(at[i + 1])) for i in np.flatnonzero(at[1:] > at[:-1]).tolist()]


def strings(seen: list[np.ndarray], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of numbered words, with the end after each text's: the places in the text, and the texts, of those with a context of words; its
    hash; what tells the word; and where they stand in all."""
    word, place = np.concatenate(seen).astype(np.int64), np.repeat(np.arange(len(seen)), [len(s) for s in seen])
    sizes = np.array([len(s) for s in seen])
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    here = np.flatnonzero((at >= WORDS) & (at < sizes[place] - 1))
    h = np.zeros(len(here), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS, 0, -1):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[word[here - k]])
    last = at[here] == sizes[place[here]] - 2
    symbol = (hashes[word[here]] >> np.uint64(33)).astype(np.uint32) << np.uint32(1) | last
    return at[here], place[here], h, symbol, here


def repeated(rows: DataFrame, bits: int) -> DataFrame:
    """(part, map): the bitmap, by parts of the hash, of the contexts of words that some word may follow twice in the rows. None is missing.

    Fingerprints of all strings of WORDS + 1 words meet by part; those that a task has twice are marked.
    """
    low = CONTEXT_BITS + NEXT_BITS - PART_BITS  # bits of a fingerprint within its part

    def emitted(pool: list[np.ndarray]) -> pa.RecordBatch:
        prints, n = np.unique(np.concatenate(pool), return_counts=True)
        parts = parted(prints >> np.uint64(low))
        own = ((prints & np.uint64((1 << low) - 1)) << np.uint64(1) | (n > 1)).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in parts], pa.int32()), pa.array([packed(steps(own[a:b])) for _, a, b in parts], pa.binary())], names=["part", "prints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held = [], 0
        for batch in batches:
            texts = binary(batch.column(0))
            for start, stop in slices(texts):
                ids: defaultdict[bytes, int] = defaultdict(count().__next__)
                seen = [np.array([*map(ids.__getitem__, plain(t.as_py())), ids[b"\n"]], np.int32) for t in texts.slice(start, stop - start)]
                _, _, h, symbol, _ = strings(seen, ids)
                with np.errstate(over="ignore"):
                    after = _mix((h + symbol) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - NEXT_BITS)
                pool.append(h >> np.uint64(64 - CONTEXT_BITS) << np.uint64(NEXT_BITS) | after)
                held += len(h)
                if held >= POOL:
                    yield emitted(pool)
                    pool, held = [], 0
        if held:
            yield emitted(pool)

    def found(key: tuple, table: pa.Table) -> pa.Table:
        own = np.sort(np.concatenate([np.cumsum(unpacked(d, np.uint32)[0], dtype=np.uint32) for d in table.column("prints").to_pylist()]))
        twice = own[(own & np.uint32(1)) == 1] >> np.uint32(1)
        own >>= np.uint32(1)
        slots = np.concatenate([twice, own[1:][own[1:] == own[:-1]]]) >> np.uint32(NEXT_BITS + CONTEXT_BITS - bits)
        flags = np.zeros(1 << bits - PART_BITS, np.uint8)
        flags[slots] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "map": pa.array([packed(np.packbits(flags, bitorder="little"))], pa.binary())})

    return rows.select("__text").mapInArrow(run, "part int, prints binary").groupBy("part").applyInArrow(found, "part int, map binary")


def bitmaps(rows: DataFrame, total: int) -> list[tuple[int, int, object]]:
    """The bitmap's slices, of at most TREE_BYTES if possible, broadcast; with the range of parts that each has."""
    spark, (least, most) = rows.sparkSession, MAP_BITS
    bits = min(max((total // 2).bit_length(), least), most)
    size = (1 << bits - PART_BITS) // 8  # bytes of a part
    many = max(1, TREE_BYTES // size)
    with scratch(spark):
        table, out = materialise(repeated(rows, bits), "repeated"), []
        for first in range(0, PARTS, many):
            beyond = min(PARTS, first + many)
            whole = np.zeros((beyond - first, size), np.uint8)
            own = table.filter((F.col("part") >= first) & (F.col("part") < beyond)).toArrow()
            for part, data in zip(own.column("part").to_pylist(), own.column("map").to_pylist(), strict=True):
                whole[part - first] = unpacked(data, np.uint8)[0]
            out.append((first, beyond, spark.sparkContext.broadcast((bits, whole.ravel()))))
    return out


class Block:
    """Rows of a task that are indexed together: words by number, and for each row its words, scores and what to tell it by."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.seen: list[np.ndarray] = []
        self.held: list[bool] = []
        self.streams: list[tuple[np.ndarray, np.ndarray]] = []  # and where in them words begin (in an empty text, its end)

    def add(self, texts: list[list[bytes]], held: list[bool]) -> None:
        data, ends = stream(texts)
        starts = []
        for words, begin in zip(texts, [0, *(ends[:-1] - 1).tolist()], strict=True):
            own = list(map(self.ids.__getitem__, words))
            own.append(self.ids[b"\n"])
            self.seen.append(np.array(own, np.int32))
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            starts.append(begin + np.cumsum(sizes) - sizes if words else np.array([begin]))
        self.held += held
        self.streams.append((data, np.concatenate(starts)))

    def bytewise(self, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the probability of each word by contexts of bytes, where each text's begin, and each text's sum."""
        units = [np.zeros(len(starts)) for _, starts in self.streams]
        for part in parts:
            first, beyond, tree = part.value
            for own, (data, starts) in zip(units, self.streams, strict=True):
                own += np.add.reduceat(tree.logs(data, first, beyond), starts)
            if len(parts) > 1:
                del part._value  # a worker reads it again for the next block
        sizes = np.array([max(1, len(s) - 1) for s in self.seen])
        firsts = np.cumsum(sizes) - sizes
        whole = np.concatenate(units)
        return whole, firsts, np.add.reduceat(whole, firsts)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Words by number, with the ends, and the place of each."""
        return np.concatenate(self.seen).astype(np.int64), np.repeat(np.arange(len(self.seen)), [len(s) for s in self.seen])

    def words(self, frequent: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, list[bytes], tuple]:
        """Sums of logarithms and numbers of frequent words by place; and the others, with where they stand."""
        word, place = self.flat()
        keys, n = np.unique(word * len(self.seen) + place, return_counts=True)
        word, place = np.divmod(keys, len(self.seen))
        names = list(self.ids)
        logs = np.fromiter(map(frequent.get, names, repeat(np.nan)), np.float64, len(names))
        known = ~np.isnan(logs[word])
        base = np.bincount(place[known], weights=logs[word[known]] * n[known], minlength=len(self.seen))
        hits = np.bincount(place[known], weights=n[known], minlength=len(self.seen)).astype(np.int64)
        rare = np.flatnonzero(np.isnan(logs))
        number = np.cumsum(np.isnan(logs)) - 1
        return base, hits, [names[i] for i in rare.tolist()], postings(number[word[~known]], place[~known], n[~known], len(rare))

    def contexts(self, sparse: int, maps: list | None, units: np.ndarray, firsts: np.ndarray) -> tuple:
        """(contexts, next symbols, costs of these by bytes, trained counts) of the contexts of words that the tree may have, and
        where they stand."""
        at, place, h, symbol, _ = strings(self.seen, self.ids)
        kept = np.full(len(h), maps is None)
        for first, beyond, part in maps or ():
            bits, flags = part.value
            slot = (h >> np.uint64(64 - bits)).astype(np.int64)
            own = np.flatnonzero((slot >> bits - PART_BITS >= first) & (slot >> bits - PART_BITS < beyond))
            slot = slot[own] - (first << bits - PART_BITS)
            kept[own] = flags[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
            if len(maps) > 1:
                del flags, part._value  # as with the tree's slices
        if sparse > 1:
            kept &= h % np.uint64(sparse) == 0
        at, place, h, symbol = at[kept], place[kept], h[kept], symbol[kept]
        cost = (-units[firsts[place] + at]).astype(np.float32)  # half the bytes in every exchange
        order = np.lexsort((place, symbol, h))
        h, symbol, cost, where = h[order], symbol[order], cost[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (symbol[1:] != symbol[:-1])
        entry = np.cumsum(new) - 1
        keys, n = np.unique(entry * len(self.seen) + where, return_counts=True) if len(entry) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        entry, where = np.divmod(keys, max(1, len(self.seen)))
        entries = int(new.sum())
        trained = np.bincount(entry, weights=np.where(np.array(self.held)[where], 0, n), minlength=entries).astype(np.int64)
        return h[new], symbol[new], cost[new], trained, postings(entry, where, n, entries)


def postings(entry: np.ndarray, place: np.ndarray, n: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each entry has, and these numbers: places with counts. The arrays given are sorted by entry."""
    most = (1 << COUNT_BITS) - 1
    while (big := np.flatnonzero(n > most)).size:
        entry, place, n = np.insert(entry, big, entry[big]), np.insert(place, big, place[big]), np.insert(np.where(n > most, n - most, n), big, most)
    return np.bincount(entry, minlength=entries).astype(np.uint32), (place << COUNT_BITS | n).astype(np.uint32)


PAPER, LIST, WORD, CONTEXT = 0, 1, 2, 3


def _index(docs: DataFrame, tree: Tree, frequent: dict[bytes, float], sparse: int, maps: list | None) -> DataFrame:
    """Rows of kind PAPER, the documents with place, score by bytes, and sums over frequent words; of kind WORD, the other words of each
    block; of kind CONTEXT, for a part of the hashes (as place) pairs of a context of words and its next symbol, with costs and trained
    counts, from an entry on; and of kind LIST, for a block's words and for its pairs by entry, where they stand."""
    context = docs.sparkSession.sparkContext
    common = context.broadcast(frequent)  # FREQUENT words of FREQUENT_LENGTH bytes, at most
    parts = [context.broadcast(p) for p in tree.slices(TREE_BYTES)]
    schema = T.StructType.fromDDL("kind int, block long, place int, entry int, word binary, sizes binary, lists binary, score double, logs double, known long, tokens long, held_out boolean")
    schema = schema.add(T.StructField("doc_id", docs.schema["__id"].dataType))
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}

    def table(kind: int, block: int, size: int, /, **columns) -> pa.RecordBatch:
        columns |= {"kind": pa.array(np.full(size, kind, np.int32)), "block": pa.array(np.full(size, block))}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        block, ids = Block(next(numbers)), []

        def finished() -> Iterator[pa.RecordBatch]:
            base, hits, words, where = block.words(common.value)
            units, firsts, scores = block.bytewise(parts)
            yield table(
                PAPER, block.number, len(block.seen), place=pa.array(np.arange(len(block.seen), dtype=np.int32)), score=pa.array(scores), logs=pa.array(base), known=pa.array(hits),
                tokens=pa.array([len(s) for s in block.seen], pa.int64()), held_out=pa.array(block.held), doc_id=pa.concat_arrays(ids),
            )
            numbers_of = lambda n: pa.array(np.arange(n, dtype=np.int32))
            whole = [table(WORD, block.number, len(words), word=pa.array(words, pa.binary()), entry=numbers_of(len(words)))]
            ctx, symbol, cost, trained, there = block.contexts(sparse, maps, units, firsts)
            parts_of = parted(ctx >> np.uint64(64 - PART_BITS))
            data = [packed(steps(ctx[a:b]), symbol[a:b], cost[a:b], trained[a:b].astype(np.uint32)) for _, a, b in parts_of]
            whole.append(table(CONTEXT, block.number, len(data), place=pa.array([p for p, _, _ in parts_of], pa.int32()), entry=pa.array([a for _, a, _ in parts_of], pa.int32()), lists=pa.array(data, pa.binary())))
            both = lambda k: pa.array([packed(own[k]) for own in (there, where)], pa.binary())
            yield table(LIST, block.number, 2, place=numbers_of(2), sizes=both(0), lists=both(1))  # 0: contexts, 1: words
            for rows in whole:
                for i in range(0, rows.num_rows, 20_000):
                    yield rows.slice(i, 20_000)

        for batch in batches:
            texts, held = binary(batch.column("__text")), batch.column("held_out").to_pylist()
            at = raw(texts)[1]
            for start, stop in slices(texts):
                block.add([plain(t.as_py()) for t in texts.slice(start, stop - start)], held[start:stop])
                ids.append(batch.column("__id").slice(start, stop - start))
                block.size += int(at[stop] - at[start])
                if block.size >= BLOCK_BYTES or len(block.seen) >= 1 << 19:
                    yield from finished()
                    block, ids = Block(next(numbers)), []
        if block.seen:
            yield from finished()

    return docs.mapInArrow(run, schema)


def _grown(rows: DataFrame, gain: float) -> DataFrame:
    """(of, entry, data) for the rows of pairs, from the same entry on: what the logarithm of a pair's probability gains over its suffix's, NaN
    where the context is not retained.

    Contexts meet by parts of their hash. A block has a pair once, so even the commonest is there as often as there are blocks.
    """

    def judged(table: pa.Table) -> pa.Table:
        found = [unpacked(d, np.uint64, np.uint32, np.float32, np.uint32) for d in table.column("lists").to_pylist()]
        ctx, symbol = np.concatenate([np.cumsum(f[0], dtype=np.uint64) for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((symbol, ctx))
        ctx, symbol = ctx[order], symbol[order]
        cost, n = (np.concatenate([f[k] for f in found])[order].astype(np.float64) for k in (2, 3))
        new = np.concatenate([[True], ctx[1:] != ctx[:-1]])
        pair = np.concatenate([[True], symbol[1:] != symbol[:-1]]) | new
        of_pair, of_ctx = np.cumsum(pair) - 1, np.cumsum(new) - 1
        seen, m = (np.add.reduceat(x, np.flatnonzero(pair))[of_pair] for x in (n, np.ones(len(n))))
        # To write down a next symbol costs as much as its suffix asks for it, which is what it saves the first time.
        some = np.maximum(seen, 1)
        saved = np.where(seen > 0, some * np.log2(some) + (some - 1) * cost * np.log2(10.0), 0.0) / m
        total, bits = (np.add.reduceat(x, np.flatnonzero(new)) for x in (n, saved))
        kept = (total > 0) & (bits - total * np.log2(np.maximum(total, 1)) >= gain)
        total = total[of_ctx]
        by_words = (seen + WORD_WEIGHT * 10.0**-cost) / (total + WORD_WEIGHT)
        value = np.empty(len(n))
        value[order] = np.where(kept[of_ctx], np.where(seen > 0, cost + np.log10(by_words), np.log10(WORD_WEIGHT / (total + WORD_WEIGHT))), np.nan)
        data = [packed(v) for v in np.split(value, np.cumsum([len(f[0]) for f in found])[:-1])]
        return pa.table({"of": table.column("block"), "entry": table.column("entry"), "data": pa.array(data, pa.binary())})

    return rows.groupBy("place").applyInArrow(judged, "of long, entry int, data binary")


def score(docs: DataFrame, held_out: Column, text: str = "text", id_column: str = "doc_id", gain: float = GAIN, word_gain: float = WORD_GAIN, sparse: int = 1) -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score and score, trained on the rows that are not held out.

    All contexts of words count, unless ``sparse`` asks for those only whose hash it divides."""
    configure(docs.sparkSession)
    sent, _ = neutral(docs.withColumn("__held", held_out), (), __id=id_column, __text=text, held_out="__held")
    rows = sent.filter(~F.col("held_out"))
    with setting(docs.sparkSession, CLEANUP, "true"):
        tree = train(rows, "__text", gain)
        counts = materialise(word_counts(rows), "counts")
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        top = counts.filter(F.octet_length("w") <= FREQUENT_LENGTH).orderBy(F.desc("c"), "w").limit(FREQUENT).toArrow()
        frequent = dict(zip(top.column("w").to_pylist(), np.log10(top.column("c").to_numpy() + 1.0).tolist(), strict=True))
        # Without a gain asked for, contexts that no word follows twice stay too.
        maps = bitmaps(rows, int(total)) if word_gain > 0 else None
        index = materialise(_index(sent, tree, frequent, sparse, maps), "index")
        grown = materialise(_grown(index.filter(F.col("kind") == CONTEXT).select("place", "block", "entry", "lists"), word_gain), "grown")
    return _scored(index, counts, grown, int(total), int(distinct), id_column)


def _scored(index: DataFrame, counts: DataFrame, grown: DataFrame, total: int, distinct: int, id_column: str) -> DataFrame:
    kind = lambda k: index.filter(F.col("kind") == k)
    # Frequent words have a row for each block: the join's sides are tables, so their rows may be split among tasks.
    words = kind(WORD).select("block", "word", "entry").join(counts, F.col("word") == F.col("w"))
    words = words.select(F.col("block").alias("of"), F.lit(1).alias("hit"), "entry", F.log10(F.col("c") + 1.0).alias("value"), F.lit(None).cast("binary").alias("data"))
    contexts = grown.select("of", F.lit(0).alias("hit"), "entry", F.lit(None).cast("double").alias("value"), "data")
    papers = index.filter(F.col("kind") <= LIST).select("kind", "block", "place", "sizes", "lists", "doc_id", "held_out", "tokens", "known", "logs", "score")

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.filter(pc.equal(left.column("kind"), LIST))
        left = left.filter(pc.equal(left.column("kind"), PAPER))
        place = left.column("place").to_numpy()
        sums, hits = np.zeros((2, len(place))), np.zeros(len(place), np.int64)
        alone, many = (right.filter(pc.equal(right.column("hit"), k)) for k in (1, 0))
        for row in lists.to_pylist():
            sizes, data = (unpacked(row[c], np.uint32)[0] for c in ("sizes", "lists"))
            values = np.full(len(sizes), np.nan)
            if row["place"]:
                values[alone.column("entry").to_numpy()] = alone.column("value").to_numpy()
            else:
                for first, found in zip(many.column("entry").to_pylist(), many.column("data").to_pylist(), strict=True):
                    own = unpacked(found, np.float64)[0]
                    values[first : first + len(own)] = own
            there = ~np.isnan(values)
            some = np.repeat(there, sizes)
            where, times = data[some] >> COUNT_BITS, (data[some] & ((1 << COUNT_BITS) - 1)).astype(np.int64)
            sums[row["place"]] = np.bincount(where, weights=times * np.repeat(values, sizes)[some], minlength=len(place))
            if row["place"]:
                hits = np.bincount(where, weights=times, minlength=len(place)).astype(np.int64)
        known, logs, score = (left.column(c).to_numpy() + more[place] for c, more in (("known", hits), ("logs", sums[1]), ("score", sums[0])))
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": left.column("tokens"), "n_known": known, "logs": logs, "score": score})

    schema = T.StructType([index.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, logs double, score double")])
    joined = papers.groupBy("block").cogroup(words.unionByName(contexts).groupBy("of")).applyInArrow(gather, schema)
    norm = float(np.log10(total + distinct + 1.0))
    return joined.select(F.col("doc_id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
