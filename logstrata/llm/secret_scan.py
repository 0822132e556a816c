"""Secret scans with DataFrame functions only: patterns, and character Markov models of random strings and identifiers.

Base spans come from three patterns. The method adds runs of token characters that a first-order Markov model of random strings
explains better than one of ordinary identifiers, by a margin of the log-likelihood ratio. Both models are bigram counts of
labelled samples: the base spans' values of some rows are the random strings, the other runs met twice in these rows the identifiers.
Counting is an aggregation with at most 2 * 68 ** 2 groups; scoring looks each bigram up in one constant array of whole numbers.

Cases: a null text is empty and has no spans; a text without spans has '' as spans and the digest of ''; rows are scanned one by
one, so repeated rows give equal results; without labelled samples both models are uniform and the method adds nothing; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, and patterns whose matches are leftmost and do not overlap. Fixed values of the contract; the runs of the
#: last two are sought at their least length at once, which finds the same matches as dropping short ones afterwards.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

#: Characters of a run that the models know, and the length from which a run is judged.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LEAST = 8
RUN = r"[A-Za-z0-9+/_=-]"
#: Log-likelihood ratio (natural logarithm) from which a run counts as random: odds of e**40 against one.
MARGIN = 40.0
#: About so many rows are the labelled samples, chosen by a hash of their text; the bound of the models' training.
TRAIN_ROWS = 4000
SMOOTH = 1.0
#: Elements that one step of a running sum adds to an array, which copies it: sums of longer arrays go in two or three levels.
CHUNK = 256
_SCALE = 1000  # log ratios are whole thousandths, so sums do not depend on their order


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str = "int", levels: int = 3) -> Column:
    """For each element of an array, ``op`` over all up to and with it. The work grows in proportion to the array for up to CHUNK ** levels
    elements: chunks are summed up, their sums run over in the same way, and each chunk then starts from what lies before it."""

    def plain(chunk: Column, base: Column) -> Column:
        begin = F.struct(base.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: _let(op(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))
        return F.aggregate(chunk, begin, step, lambda acc: acc["out"])

    if levels == 1:
        return plain(values, zero)

    def chunked(chunks: Column) -> Column:
        sums = running(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero, op, kind, levels - 1)
        return _let(sums, lambda before: F.flatten(F.transform(chunks, lambda c, j: plain(c, F.when(j == 0, zero).otherwise(F.element_at(before, F.greatest(j, F.lit(1))))))))

    def whole(held: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))
        return F.when(F.size(held) <= CHUNK, plain(held, zero)).otherwise(_let(F.transform(cuts, lambda j: F.slice(held, j * CHUNK + 1, F.lit(CHUNK))), chunked))

    return _let(values, whole)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of the pattern's matches: the pieces between matches give their places."""
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(group)) if group else found
    cells = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def placed(hits: Column) -> Column:
        sizes = F.transform(hits, lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"]))

        def span(ends: Column) -> Column:
            return F.transform(hits, lambda x, i: _let(F.element_at(ends, i + 1), lambda e: F.struct((e - F.char_length(x["hit"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["value"].alias("value"))))

        return F.filter(_let(running(sizes, F.lit(0), lambda a, b: a + b), span), lambda s: F.char_length(s["value"]) >= least)

    # The last piece has no match after it.
    return F.when(F.regexp(text, regex), _let(F.filter(cells, lambda x: x["hit"].isNotNull()), placed)).otherwise(empty)


def _free(spans: Column) -> Column:
    """Sorted spans without those of the models that overlap one of a pattern: these begin after all that end late, and end before
    the next one begins."""
    most = F.lit((1 << 31) - 1)
    based = lambda s, value, other: F.when(s["kind"] < 3, value).otherwise(other)
    reach = running(F.transform(spans, lambda s: based(s, s["end"], F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b))
    after = F.reverse(running(F.reverse(F.transform(spans, lambda s: based(s, s["start"], most))), most, lambda a, b: F.least(a, b)))
    clear = lambda r, a: F.filter(spans, lambda s, i: (s["kind"] < 3) | ((F.element_at(r, i + 1) <= s["start"]) & (F.element_at(a, i + 1) >= s["end"])))
    return _let(reach, lambda r: _let(after, lambda a: clear(r, a)))


def base_spans(text: Column) -> Column:
    return F.concat(_spans(text, ASSIGN, 0, 1, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def _classes(run: Column) -> Column:
    """0 for the beginning, then each character's place in the alphabet, from 1 (0 for a character outside)."""
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0)), F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)))


def _bigrams(run: Column) -> Column:
    ids = _classes(run)
    n = F.size(ids) - 1
    return F.zip_with(F.slice(ids, 1, n), F.slice(ids, 2, n), lambda a, b: a * (len(ALPHABET) + 1) + b)


def _model(counts: dict[tuple[int, int], int], label: int) -> list[list[float]]:
    """Probabilities of each class after each, smoothed towards the classes' own frequencies."""
    width = len(ALPHABET) + 1
    grid = [[counts.get((label, a * width + b), 0) for b in range(width)] for a in range(width)]
    every = [sum(row[b] for row in grid) + 1 for b in range(width)]
    own = [n / sum(every) for n in every]
    return [[(n + SMOOTH * q) / (sum(row) + SMOOTH) for n, q in zip(row, own, strict=True)] for row in grid]


def _ratios(counts: dict[tuple[int, int], int]) -> list[int]:
    """Scaled log(P_random / P_identifier) for all pairs of classes, by place first * width + second.

    The samples of random strings know few alphabets, so half of that model is a draw from the whole alphabet.
    """
    uniform = 1 / (len(ALPHABET) + 1)
    rows = zip(_model(counts, 1), _model(counts, 0), strict=True)
    return [round(_SCALE * math.log((p + uniform) / 2 / q)) for one, other in rows for p, q in zip(one, other, strict=True)]


def train(docs: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> list[int]:
    """The table of log ratios, from about ``rows`` rows of the documents."""
    n = docs.count()
    if not n:
        return _ratios({})
    body = F.coalesce(F.col(text), F.lit(""))
    draw = F.pmod(F.xxhash64(body, F.lit(6)), F.lit(1 << 30))
    sample = docs.select(body.alias("t")).filter(draw < F.lit(int(min(1.0, rows / n) * (1 << 30)))).distinct()
    spans = sample.select("t", base_spans(F.col("t")).alias("s"))
    secret = spans.select(F.lit(1).alias("label"), F.explode("s.value").alias("run"))
    rest = F.lit(None).cast("string")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace("t" if pattern is ASSIGN else rest, pattern, " ")
    plain = sample.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(rest, F.lit(RUN + "{4,}"), F.lit(0))).alias("run"))
    # What is said but once may be a secret that no pattern knows, so identifiers are runs met again; each run counts once.
    runs = secret.union(plain).groupBy("label", "run").count().filter("label = 1 OR count > 1")
    pairs = runs.select("label", F.explode(_bigrams(F.col("run"))).alias("pair"))
    found = pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    return _ratios({(r["label"], r["pair"]): r["n"] for r in found})


def score(run: Column, ratios: list[int]) -> Column:
    """The scaled log-likelihood ratio of a run."""
    values = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded to a constant
    return F.aggregate(_bigrams(run), F.lit(0).cast("long"), lambda acc, pair: acc + F.element_at(values, pair + 1))


def scan(docs: DataFrame, ratios: list[int], text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, counts by kind, base_sha256 and spans as text, and found: all spans as (start, kind, end, value)."""
    rows = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.select(id_column, "__t", base_spans(F.col("__t")).alias("__base"))
    runs = _spans(F.col("__t"), RUN + "{%d,}" % RUN_LEAST, 3)
    random = F.filter(runs, lambda s: score(s["value"], ratios) >= int(MARGIN * _SCALE))
    rows = rows.select(id_column, "__base", random.alias("__more"))
    both = F.when(F.size("__more") == 0, F.array_sort("__base")).otherwise(_let(F.array_sort(F.concat("__base", "__more")), _free))
    rows = rows.select(id_column, "__base", both.alias("__both"))

    def said(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        id_column,
        *(count(F.col("__base"), k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(F.encode(said(F.array_sort("__base")), "UTF-8"), 256).alias("base_sha256"),
        said(F.col("__both")).alias("spans"),
        count(F.col("__both"), 3).alias("n_markov"),
        F.col("__both").alias("found"),
    )
