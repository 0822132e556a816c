"""Benchmark decontamination: a prefix-filtered set join of document words with item-sized windows.

A window is matched exactly, so of its words, ordered by rarity over the whole corpus, the first is a sufficient prefix: no
document can hold the window without that word. Documents probe the index of prefix words; a hit at position p with the
word at offset o of a window of length n leaves one place for it, p - o, which the length and positional bounds admit only
if 0 <= p - o and p - o + n <= the document's words; there the window is verified word by word.

Cases: null texts have no words, and an item without words no window; an item text that occurs twice counts for each item_id;
null item_ids are left out of the digest but their words count as hit; documents are judged row by row, so repeated rows are
equal; empty tables give no rows, or rows without hits; other columns pass through if asked for, but one of an output's name gives
way to it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import binary, carried, configure, materialise, neutral

WINDOW = 13
#: Words of the items that one index may hold. Its size is thereby bounded (about 200 bytes a word and window), which is what
#: makes it fit to be broadcast; a larger benchmark is dealt with in blocks of so many words, all against all documents.
BLOCK_WORDS = 400_000

#: Letters to lower case, digits and bytes over 7F as they are, all else to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

_HITS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_HITS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_ITEMS = T.ArrayType(T.StringType())


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def windows_of(words: Sequence[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of an item: all runs of ``size`` words, or the whole of a shorter one."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Index:
    """Windows by their rarest word. ``places`` has, for a prefix word, the distinct (offset, length) of windows it leads to."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], rarity: dict[bytes, int], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str | None]] = {}
        places: dict[bytes, set[tuple[int, int]]] = {}
        for item, words in items:
            for window in windows_of(words, size):
                owners.setdefault(window, set()).add(item)
                offset = min(range(len(window)), key=lambda i: (rarity.get(window[i], 0), window[i], i))
                places.setdefault(window[offset], set()).add((offset, len(window)))
        sets: dict[frozenset, int] = {}  # windows with the same items share one set
        self.owner = {w: sets.setdefault(frozenset(o), len(sets)) for w, o in owners.items()}
        self.items = [sorted(i for i in o if i is not None) for o in sets]
        self.places = {w: sorted(p) for w, p in places.items()}
        self.prefixes = frozenset(self.places)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Maximal stretches (begin, end) of words inside windows that occur, and their items. What is held is bounded by the text
        and by the index, however many items share a window."""
        if self.prefixes.isdisjoint(words):
            return [], []
        places, owner, n = self.places, self.owner, len(words)
        reach, sets = {}, set()  # the farthest end of the windows that begin at a word
        for p, word in enumerate(words):
            if word in places:
                for offset, length in places[word]:
                    begin = p - offset
                    if 0 <= begin and begin + length <= n:
                        found = owner.get(tuple(words[begin : begin + length]))
                        if found is not None:
                            reach[begin] = max(reach.get(begin, 0), begin + length)
                            sets.add(found)
        return joined(sorted(reach.items())), sorted({i for s in sets for i in self.items[s]})


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _items(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of at most BLOCK_WORDS words (or one item), read from executors partition by partition."""
    block, held = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).sort(item, text).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        if words:
            block.append((row[0], words))
            held += len(words)
    yield block


def word_counts(documents: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each of the words occurs, over all documents. The result has at most ``len(words)`` entries."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = shared.value, Counter()
        for batch in batches:
            for data in binary(batch.column(0)):
                counts.update(wanted.intersection(words_of(data.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = documents.select("__text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def _judged(n: int, hits: list[tuple[int, int]], items: list[str], share: int) -> tuple:
    n_hit = sum(end - begin for begin, end in hits)
    return n, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and share * n_hit >= n


def _cells(found: list[tuple[list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    return [pa.array([[{"begin": b, "end": e} for b, e in hits] for hits, _ in found], _ARROW_HITS), pa.array([items for _, items in found], pa.list_(pa.string()))]


OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items")
_KINDS = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), _HITS, _ITEMS)
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, share: int = 20, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Every document with n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), hits (maximal
    stretches of words inside windows that occur) and items (sorted as strings), besides the columns ``keep``.

    Two scans of the documents for each block and no exchange of their text: one counts the block's words, one probes. Of several
    blocks each leaves the hits it finds, which are put together by the documents' rows at the end.
    """
    configure(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    sent, passed = neutral(documents, carried(keep, OUTPUTS), __text=text)
    judged = [T.StructField(n, k) for n, k in zip(OUTPUTS, _KINDS, strict=True)]

    def index_of(df: DataFrame, block: list):
        return context.broadcast(Index(block, word_counts(df, frozenset(w for _, ws in block for w in ws)), size))  # bounded by BLOCK_WORDS

    def verdicts(batch: pa.RecordBatch, sizes: list[int], found: list) -> pa.RecordBatch:
        rows = [_judged(n, *f, share) for n, f in zip(sizes, found, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(_ARROW)), *_cells(found)], names=[*batch.schema.names, *OUTPUTS])

    def whole(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                texts = [words_of(d.as_py()) for d in binary(batch.column("__text"))]
                yield verdicts(batch, list(map(len, texts)), [own.matches(words) for words in texts])

        return sent.mapInArrow(run, T.StructType([*sent.schema.fields, *judged])).select(*passed, *OUTPUTS)

    def marks(df: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                found = [(own.matches(words_of(d.as_py()))) for d in binary(batch.column("__text"))]
                some = pa.array([bool(hits) for hits, _ in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("__row"), *_cells(found)], names=["row", "hits", "items"]).filter(some)

        schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("hits", _HITS), T.StructField("items", _ITEMS)])
        return materialise(df.select("__row", "__text").mapInArrow(run, schema), "hits")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(joined(sorted((h["begin"], h["end"]) for hs in hits or () for h in hs)), sorted({i for own in items or () for i in own})) for hits, items in zip(batch.column("__hits").to_pylist(), batch.column("__items").to_pylist(), strict=True)]
            yield verdicts(batch.drop_columns(["__hits", "__items"]), batch.column("__words").to_pylist(), found)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(words_of(d.as_py())) for d in binary(batch.column("__text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], names=[*batch.schema.names, "__words"])

    blocks = _items(benchmark, item, item_text)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return whole(index_of(sent, block))
    # A benchmark of over BLOCK_WORDS words: the documents are written once, with numbers for their rows.
    numbered = T.StructType([*sent.schema.fields, T.StructField("__words", T.LongType())])
    rows = materialise(sent.mapInArrow(counted, numbered).withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    found = marks(rows, index_of(rows, block))
    while following is not None:
        found = found.union(marks(rows, index_of(rows, following)))
        following = next(blocks, None)
    by_row = materialise(found.groupBy("row").agg(F.collect_list("hits").alias("__hits"), F.collect_list("items").alias("__items")), "hits")
    left = rows if text in keep else rows.drop("__text")
    both = left.join(by_row, left["__row"] == by_row["row"], "left").drop("row", "__row")
    schema = T.StructType([*(f for f in both.schema if f.name not in ("__hits", "__items")), *judged])
    return both.mapInArrow(gathered, schema).select(*passed, *OUTPUTS)
