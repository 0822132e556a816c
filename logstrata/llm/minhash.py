"""Near-duplicate groups: fast similarity sketches, banding, and verification on the full sets.

A document's set are its distinct word shingles. A sketch fills T bins in rounds: round i throws every element into a hashed
bin with the value (i, hash), and bins keep the least value. After T rounds that may leave bins empty, round T + i throws all
elements into bin i, so every bin fills within 2 T rounds; usually one or a few do. Two sketches agree in a bin with the
probability of the sets' Jaccard similarity, with concentration as strong as for sampling. ROWS bins make a band; documents that
agree in one of BANDS bands are candidates. At similarity 0.8 one band agrees with probability 0.26, so a link escapes all 64
with probability (1 - 0.8 ** 6) ** 64 < 4e-9.

Hashes only lead to candidates. Sets are counted and compared as words: where two shingles of a document have one hash, their words
are compared; documents with equal hashes of all shingles are one class, represented by one of them. Where their words, all in order,
have one 256-bit BLAKE2 digest, they are equal; one text of each other digest is compared with the representative, and where the sets
differ, its digest makes a class of its own. Links are confirmed on the sets. Within a bucket not all pairs are formed: pivots are compared to those members that are not yet in the pivot's
component. A compared pivot is done, and the number of pivots grows by PIVOTS with each round, until each bucket is one component or all
its members but those of one component have been pivots; so each candidate pair of different components is verified, and no link is lost to a cap. Pairs that
cannot be links are left out by exact bounds: a set has no more in common with another than with all other candidates together, and
two sets that were compared with the same third share what both share with it, or else what lies beyond it and others have too.

Cases: a null text and one without words have the empty set and are linked with nothing; a text of fewer words than a shingle
has one element, the whole sequence; a null id sorts after all others; rows with the same id are different documents, of which
``kept_row`` marks one for each component; an empty table gives no rows; other columns pass through if asked for, but one of an
output's name gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import SLICE_BYTES, binary, broadcasts, carried, configure, materialise, neutral, setting, slices

BANDS, ROWS = 64, 6
BINS = BANDS * ROWS
#: Pivots of a bucket in the first round that has several; as many times more in each that follows.
PIVOTS = 16
#: Rounds before these in which each document is compared with one partner: they join most of large groups at little cost.
PROBES = 3
#: Rounds of connecting components after which a chain longer than 2**ROUNDS would be left; never met, and an error if so.
ROUNDS = 60
#: Parts of a text by which it is told where two sets agree with a third.
PARTS = 64
#: Members of a bucket that are dealt out together: larger buckets lie in several parts, so no task gets a whole large one.
SHARE = 64
#: Most that a table may have, by Spark's estimate, to be broadcast (a session's lesser bound holds): the driver builds these tables, and
#: several at once, and the estimate is by compressed files.
BROADCAST_BYTES = 256 << 10
#: Distinct words a worker keeps from one slice of texts to the next: few, as look-ups are quickest in a small table.
WORDS_KEPT = 20_000

_U = np.uint64
_STEP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Numbers of words, given as they are met, and a hash for each number."""

    def __init__(self, bits: int = 64) -> None:
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.hashes = np.zeros(0, np.uint64)

    def numbers(self, data: bytes) -> tuple[np.ndarray, bytes]:
        """The numbers of a text's words, and a digest of these in order. Long texts are taken in stretches that end with a word."""
        parts, at, digest = [], 0, hashlib.blake2b(digest_size=32)
        while at < len(data) or not parts:
            blank = _BLANK.search(data, at + SLICE_BYTES) if len(data) - at > SLICE_BYTES else None
            end = blank.start() if blank else len(data)
            words = data[at:end].lower().split()  # of bytes: only A-Z change, only ASCII blanks divide
            parts.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
            digest.update(b" ".join([*words, b""]))
            at = end
        return (np.concatenate(parts) if len(parts) > 1 else parts[0]), digest.digest()

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        """Hashes of words; their quality matters for speed alone, as sets are compared by words."""
        new = len(self.known) - len(self.hashes)
        if new:
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, islice(self.known, len(self.hashes), None)), np.uint64, new)
            self.hashes = np.concatenate([self.hashes, own >> _U(64 - self.bits)])
        return self.hashes[numbers]


def shingle_hashes(texts: pa.Array, size: int, words: Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document, hash) of each distinct shingle of a slice of texts, sorted, and a digest of each text's words. Shingles of one hash
    are told apart by their words."""
    if len(words.known) > WORDS_KEPT:
        words.clear()
    own, digests = zip(*(words.numbers(t.as_py()) for t in texts), strict=True) if len(texts) else ((), ())
    counts = np.array([len(w) for w in own], np.int64)
    word = np.concatenate(own) if own else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(own)), counts)
    place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)  # of the word in its document
    lead = np.flatnonzero((place + size <= counts[doc]) | (place == 0))
    owner, length = doc[lead], np.minimum(size, counts[doc[lead]])
    h, hashes = np.zeros(len(lead), np.uint64), words.hashed(word)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = slice(None) if k == 0 or not len(length) or int(length.min()) > k else k < length
            h[inside] = _mix(h[inside] * _U(_STEP[k % 4]) + hashes[lead[inside] + k] + _U(k + 1))
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(own) <= 1 << 16 else np.int64), kind="stable")]
    o, x, at, n = owner[order], h[order], lead[order], length[order]
    new = np.ones(len(o), bool)
    new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
    again = np.flatnonzero(~new)
    differ = np.zeros(len(again), bool)
    for k in range(size):
        differ |= (k < n[again]) & (word[np.minimum(at[again] + k, len(word) - 1)] != word[np.minimum(at[again - 1] + k, len(word) - 1)])
    if differ.any():  # one hash for several shingles: sorted by their words too
        keys = [np.where(k < length, word[np.minimum(lead + k, len(word) - 1)], -1) for k in range(size)]
        order = np.lexsort((*keys, h, owner))
        o, x, at = owner[order], h[order], lead[order]
        new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
    return o[new], x[new], list(digests)


def sketches(owner: np.ndarray, h: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """[n, bins]: the sketch of each of n sets; rows of empty sets hold the greatest value."""
    out = np.full(n * bins, ~_U(0), np.uint64)
    a, who, sizes = h, owner, np.bincount(owner, minlength=n)
    left, todo, grid = sizes > 0, np.flatnonzero(sizes), out.reshape(n, bins)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            x = a * (_mix(np.uint64(i + 1)) | _U(1))  # elements are hashes already: a multiplier of each round's own deals them out anew
            x = (x ^ (x >> _U(32))) * _U(_STEP[3])
            bin_ = (x >> _U(32)).astype(np.int64) * bins >> 32 if i < bins else np.full(len(x), i - bins)
            at = who * bins + bin_
            free = out[at] == ~_U(0) if i else slice(None)
            at, x = at[free], x[free]
            np.minimum.at(out, at, np.minimum(_mix(x + _U(i)), ~_U(1)))
            open_ = (grid[todo] == ~_U(0)).any(1)
            left[todo[~open_]] = False
            todo = todo[open_]
            if not len(todo):
                break
            if 5 * int(sizes[todo].sum()) < 4 * len(a):  # elements of filled sketches are done
                stay = left[who]
                a, who = a[stay], who[stay]
    return grid


def bands_of(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """[n, bands]: a hash of each band's bins and of its number."""
    grid = sketch.reshape(len(sketch), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(_STEP[1]), grid.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(grid.shape[2]):
            h = _mix(h * _U(_STEP[2]) + grid[:, :, k])
    return h.view(np.int64)


def shingle_set(data: bytes, size: int) -> set[tuple[bytes, ...]]:
    words = data.lower().split()
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _parted(data: bytes, size: int) -> dict[tuple[bytes, ...], int]:
    """The set, with the part of the text in which each shingle first stands."""
    words = data.lower().split()
    if len(words) <= size:
        return {tuple(words): 0} if words else {}
    n, out = len(words) - size + 1, {}
    for i, shingle in enumerate(zip(*(words[k:] for k in range(size)), strict=False)):
        out.setdefault(shingle, i * PARTS // n)
    return out


def _profile(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """The rows with __n (size of the set), __key (a digest of the set's hashes), __words (one of all words) and __bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(bits)
        for batch in batches:
            texts = binary(batch.column("__text"))
            sizes, keys, sequences, bands = [], [], [], []
            for start, stop in slices(texts):
                n = stop - start
                owner, h, digests = shingle_hashes(texts.slice(start, n), size, words)
                counts = np.bincount(owner, minlength=n)
                edges = np.concatenate([[0], np.cumsum(counts)])
                for i in range(n):
                    keys.append(hashlib.blake2b(h[edges[i] : edges[i + 1]].tobytes(), digest_size=16).digest() if counts[i] else None)
                # One sketch for copies within the slice.
                seen: dict[bytes, int] = {}
                lead = [seen.setdefault(k, i) if (k := keys[len(keys) - n + i]) else i for i in range(n)]
                chosen = np.array([l == i for i, l in enumerate(lead)])
                stay = chosen[owner]
                rank = np.cumsum(chosen) - 1
                own = bands_of(sketches(rank[owner[stay]], h[stay], int(chosen.sum())))
                sizes += counts.tolist()
                sequences += digests
                bands += [own[rank[l]] if counts[i] else None for i, l in enumerate(lead)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sequences, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[*batch.schema.names, "__n", "__key", "__words", "__bands"])

    added = [T.StructField("__n", T.LongType()), T.StructField("__key", T.BinaryType()), T.StructField("__words", T.BinaryType()), T.StructField("__bands", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added])).withColumn("__row", F.monotonically_increasing_id())


def _unlike(rows: DataFrame, doubtful: DataFrame, size: int) -> DataFrame:
    """(k, w) of the digests w of words in a class k whose set is not that of the class's first row, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes | None, set] = (None, set())
        for batch in batches:
            keys, differ = batch.column("k").to_pylist(), []
            for key, x, y in zip(keys, binary(batch.column("x")), binary(batch.column("y")), strict=True):
                if known[0] != key:  # rows of a class mostly come one after the other
                    known = (key, shingle_set(x.as_py(), size))
                differ.append(shingle_set(y.as_py(), size) != known[1])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("w")], names=["k", "w"]).filter(pa.array(differ, pa.bool_()))

    several = rows.select("__key", "__words", "__row").join(doubtful, F.col("__key") == F.col("k")).groupBy("k", "head", F.col("__words").alias("w")).agg(F.min("__row").alias("one"))
    texts = rows.select("__row", "__text")
    heads = texts.select(F.col("__row").alias("head"), F.col("__text").alias("x")).join(doubtful.select("head"), "head", "left_semi")
    both = several.filter("one <> head").join(texts.select(F.col("__row").alias("one"), F.col("__text").alias("y")), "one").join(heads, "head")
    return both.select("k", "w", "x", "y").mapInArrow(run, "k binary, w binary")


def _spread(small: DataFrame) -> DataFrame:
    """A row of each bucket, once for each of its parts, to be joined by bucket and part.

    Never broadcast: Spark judges its size by the rows before they are repeated, which a large bucket has in hundreds of parts, and
    by compressed files; the driver would have to hold all of them.
    """
    return small.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").hint("merge")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives, whether they are a link, and how many elements of each part of a's text b has too (shares)."""
    schema = "a long, b long, linked boolean, shares array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, dict] = (None, {})
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            parts, linked = [], []
            for i, (x, y) in enumerate(zip(binary(batch.column("ta")), binary(batch.column("tb")), strict=True)):
                if known[0] != a[i]:  # rows come sorted by a
                    known = (a[i], _parted(x.as_py(), size))
                one, other = known[1], shingle_set(y.as_py(), size)
                both = one.keys() & other
                common = len(both)
                parts.append(np.bincount([one[x] for x in both], minlength=PARTS) if common else np.zeros(PARTS, np.int64))
                linked.append(100 * common >= percent * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(parts, pa.list_(pa.int32()))], names=["a", "b", "linked", "shares"])

    own = texts.select(F.col("__row").alias("b"), F.col("__text").alias("tb"))
    other = texts.select(F.col("__row").alias("a"), F.col("__text").alias("ta"))
    # Sort-merge joins of tables: adaptive execution splits a pivot with very many partners.
    return pairs.join(own, "b").join(other, "a").select("a", "b", "ta", "tb").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b); root is the least node of the component.

    Each round halves paths: every node takes the least root among its own, its neighbours' and its root's. Tables are cut
    off in the shared folder; nothing but the number of changes comes to the driver.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("root").alias("near"))
        up = labels.select(F.col("node").alias("r"), F.col("root").alias("up"))
        new = labels.join(near, labels["node"] == near["x"]).join(up, labels["root"] == up["r"])
        new = new.select("node", F.least("root", "near", "up").alias("new"), "root")
        # The root's root learns of a lesser one too, or a long chain would need as many rounds.
        hook = new.filter("new < root").groupBy(F.col("root").alias("h")).agg(F.min("new").alias("to"))
        new = materialise(new.join(hook, new["node"] == hook["h"], "left").select("node", F.least("new", "to").alias("next"), "root"), "labels")
        changed = new.filter("next <> root").limit(1).count()
        labels = new.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _alone(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """(node, u): how many of a candidate's shingles no other candidate has; those with none are left out.

    Shingles count by their hashes here: two that collide only look shared, so u is never too great.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(bits)
        for batch in batches:
            data, nodes = binary(batch.column("__text")), batch.column("__row").to_numpy()
            for start, stop in slices(data):
                owner, h, _ = shingle_hashes(data.slice(start, stop - start), size, words)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[start:stop][owner]), pa.array(h.view(np.int64))], names=["node", "h"])

    owners = texts.mapInArrow(run, "node long, h long").groupBy("h").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("c"))
    return owners.filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))


def _can_link(percent: int) -> Column:
    """Whether sets can be as similar as that, by exact bounds on what they have in common.

    Of n and pn elements at most s and ps are common to anybody. Where both sets have been compared with the same third, what they
    share lies in one of its parts, of which each set has so many elements, or beyond it and is common to somebody.
    """
    enough = lambda most: F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n") + F.col("pn"))
    total = lambda shares: F.aggregate(shares, F.lit(0).cast("long"), lambda x, y: x + y)
    within = total(F.zip_with("shares", "pshares", lambda x, y: F.least(x, y)))
    beyond = F.least(F.col("s") - total(F.col("shares")), F.col("ps") - total(F.col("pshares")))
    known = (F.col("ref") == F.col("pref")) & F.col("shares").isNotNull() & F.col("pshares").isNotNull()
    return enough(F.least("s", "ps")) & F.when(known, enough(within + beyond)).otherwise(True)


def _open(members: DataFrame, percent: int) -> DataFrame:
    """Members (bucket, parts, part, node, n, s, ref, shares, root) that may still have a link to another component in their bucket.

    A member's partner can have no more elements than it shares with anybody, so it goes if the bucket's least set has more; and a
    bucket goes if one component is left.
    """
    sizes = _spread(members.groupBy("bucket").agg(F.min("n").alias("least"), F.max("parts").alias("parts")))
    fits = F.lit(percent) * F.col("least") <= F.lit(100 + percent) * F.col("s") - F.lit(percent) * F.col("n")
    left = members.join(sizes, ["bucket", "part"]).filter(fits).drop("least")
    several = left.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("parts").alias("parts")).filter("lo <> hi")
    return left.join(_spread(several.select("bucket", "parts")), ["bucket", "part"])


def _pivots(of: DataFrame, done: DataFrame | None, rank: Column, most: int) -> DataFrame:
    """The most central members of each bucket that have not been pivots; tasks keep as many of a bucket before the exchange.

    Members of a bucket's greatest component need not be pivots: each pair of two components has a member of another one.
    """
    counts = of.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.max("parts").alias("parts"))
    counts = _spread(counts.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("most"), F.max("parts").alias("parts")))
    free = of.join(counts, ["bucket", "part"]).filter(F.col("root") != F.col("most.root")).drop("most")
    free = free.join(done, ["bucket", "node"], "left_anti") if done is not None else free
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(rank))
    chosen = free.withColumn("place", place).filter(F.col("place") <= most)
    chosen = chosen.select("bucket", "parts", rank.alias("p"))
    return materialise(chosen.select("bucket", "parts", "p", *(f"p.{c}" for c in ("pn", "ps", "pref", "pshares", "pr"))), "pivots")


def links(profile: DataFrame, classes: DataFrame, size: int, percent: int, bits: int = 64) -> DataFrame | None:
    """Components (node, root) of the representatives' links; None where there are no candidates at all."""
    shared = classes.select("__row", "__n", F.explode("__bands").alias("bucket"))
    parts = F.floor((F.col("c") - 1) / SHARE).cast("int") + 1
    several = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket", parts.alias("parts"))
    part = F.pmod(F.xxhash64("__row"), F.col("parts")).cast("int")
    members = materialise(shared.join(several, "bucket").select("bucket", "parts", part.alias("part"), F.col("__row").alias("node"), F.col("__n").alias("n")), "members")
    if members.isEmpty():
        return None
    # The texts of candidates alone: all that verification moves from here on.
    texts = materialise(profile.select("__row", "__text").join(members.select(F.col("node").alias("__row")).distinct(), "__row", "left_semi"), "texts")
    alone = materialise(_alone(texts, size, bits), "alone")
    s = (F.col("n") - F.coalesce("u", F.lit(0))).alias("s")
    members = members.join(alone, "node", "left").select("bucket", "parts", "part", "node", "n", s).filter(F.lit(100) * F.col("s") >= F.lit(percent) * F.col("n"))
    itself = [F.col("node").alias("ref"), F.lit(None).cast("array<int>").alias("shares"), F.col("node").alias("root")]
    of = materialise(_open(members.select("*", *itself), percent), "open")
    # Central are members with the least share of shingles that only they have.
    far = ((F.col("n") - F.col("s")) * 1_000_000 / F.col("n")).cast("long").alias("far")
    rank = F.struct(far, "node", F.col("n").alias("pn"), F.col("s").alias("ps"), F.col("ref").alias("pref"), F.col("shares").alias("pshares"), F.col("root").alias("pr"))
    tried, found, labels, done, pivots, probe = None, None, None, None, PIVOTS, 0
    while True:
        if probe < PROBES:
            # Probes: each document is compared with one new partner, the most central that leads a bucket of its own.
            central = _spread(of.groupBy("bucket").agg(F.min(rank).alias("p"), F.max("parts").alias("parts")).select("bucket", "parts", "p", *(f"p.{c}" for c in ("pn", "ps", "pref", "pshares", "pr"))))
            fits = (F.col("p.node") != F.col("node")) & (F.col("root") != F.col("pr")) & _can_link(percent)
            options = of.join(central, ["bucket", "part"]).filter(fits).select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b"), "node", F.struct("p.far", "p.node").alias("p")).distinct()
            options = options.join(tried, ["a", "b"], "left_anti") if tried is not None else options
            pairs = options.groupBy("node").agg(F.min("p").alias("o")).select(F.col("o.node").alias("a"), F.col("node").alias("b"))
            probe += 1
        else:
            chosen = _pivots(of, done, rank, pivots)
            if not chosen.limit(1).count():
                return labels
            fits = (F.col("p.node") != F.col("node")) & (F.col("root") != F.col("pr")) & _can_link(percent)
            pairs = of.join(_spread(chosen), ["bucket", "part"]).filter(fits).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
            pairs = pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs
            turn = chosen.select("bucket", F.col("p.node").alias("node"))
            done = turn if done is None else done.union(turn)
            pivots *= PIVOTS
        pairs = materialise(pairs, "pairs")
        if not pairs.limit(1).count():
            probe = PROBES
            continue
        verified = materialise(_verify(pairs, texts, size, percent), "links")
        if tried is None:
            # What sets have been compared with is their first probe's partner.
            refs = verified.select(F.col("b").alias("node"), F.col("a").alias("r"), F.col("shares").alias("q"))
            of = of.drop("shares").join(refs, "node", "left").withColumns({"ref": F.coalesce("r", "ref"), "shares": F.col("q")}).drop("r", "q")
            of = materialise(of, "open")
        sides = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = sides if tried is None else tried.union(sides)
        new = verified.filter("linked").select("a", "b")
        if new.limit(1).count():
            found = new if found is None else found.union(new)
            labels = components(found)
            of = materialise(_open(of.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), percent), "open")


OUTPUTS = ("n_shingles", "class_id", "component_id", "kept", "kept_row")


def near_dedup(docs: DataFrame, text: str = "text", id_column: str = "doc_id", size: int = 5, percent: int = 80, carry: Sequence[str] = ("doc_id",), bits: int = 64) -> DataFrame:
    """The columns ``carry`` of every row with n_shingles, class_id and component_id (least ids of the class of equal sets and
    of the component), kept (the id is the component's) and kept_row (this very row represents the component). ``bits`` is the width
    of the words' hashes, which changes no result."""
    configure(docs.sparkSession)
    sent, passed = neutral(docs, carried(carry, OUTPUTS), __text=text, __id=id_column)
    with broadcasts(docs.sparkSession, BROADCAST_BYTES):
        rows = materialise(_profile(sent, size, bits), "profile")
        order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))

        def classed(rows: DataFrame) -> DataFrame:
            words = [F.min("__words").alias("lo"), F.max("__words").alias("hi")]
            return materialise(rows.filter("__n > 0").groupBy("__key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), *words), "classes")

        sets = classed(rows)
        doubtful = sets.filter("lo <> hi").select(F.col("__key").alias("k"), F.col("first.row").alias("head"))
        if not doubtful.isEmpty():  # equal hashes of texts that are not the same words
            unlike = materialise(_unlike(rows, doubtful, size), "unlike")
            apart = F.when(F.col("w").isNotNull(), F.concat("__key", "__words")).otherwise(F.col("__key"))
            rows = materialise(rows.join(unlike, (F.col("__key") == F.col("k")) & (F.col("__words") == F.col("w")), "left").withColumn("__key", apart).drop("k", "w"), "profile")
            sets = classed(rows)
        heads = sets.select(F.col("first.row").alias("__row"))
        classes = materialise(rows.select("__row", "__n", "__bands").join(heads, "__row"), "bands")
        # Parts of buckets are even; where a join's other side turns out small, reading map outputs as they lie would undo that.
        with setting(docs.sparkSession, "spark.sql.adaptive.localShuffleReader.enabled", "false"):
            labels = links(rows, classes, size, percent, bits)
        by_class = sets.select(F.col("__key").alias("__of"), "first", "copies")
        if labels is None:
            by_class = by_class.withColumn("top", F.col("first"))
        else:
            rooted = by_class.join(labels, by_class["first"]["row"] == labels["node"], "left").select("__of", "first", "copies", F.coalesce("root", F.col("first.row")).alias("root"))
            rooted = materialise(rooted, "rooted")
            tops = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("top"), F.sum("copies").alias("all"))
            by_class = rooted.join(tops, rooted["root"] == tops["r"]).drop("r", "root")
        by_class = materialise(by_class.select("__of", "first", "top"), "tops")
    joined = rows.drop("__bands", "__words").join(by_class, rows["__key"] == by_class["__of"], "left")
    empty = F.col("__of").isNull()
    top = F.when(empty, F.col("__id")).otherwise(F.col("top.id"))
    return joined.select(
        *passed,
        F.col("__n").alias("n_shingles"),
        F.when(empty, F.col("__id")).otherwise(F.col("first.id")).alias("class_id"),
        top.alias("component_id"),
        F.col("__id").eqNullSafe(top).alias("kept"),
        (empty | (F.col("top.row") == F.col("__row"))).alias("kept_row"),
    )
