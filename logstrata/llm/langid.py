"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text yields the longest match from any place of a new text; parsing the text
greedily into such matches gives a number of phrases. Divided by the length it estimates the cross entropy between the two,
and the language that needs the fewest phrases wins.

Texts are folded to lower case, runs of other characters than letters to one space, with a space at either end. A parse is the run of
a finite automaton: a table gives, for a state and a byte, the next state and how many phrases ended there. Stretches of BLOCK bytes
are run side by side, each as if a phrase began with it. Then every stretch is run once more from the state that the one before it
ended in, until both runs meet, which they do after some phrases; from there on they are the same. So the count is that of one
parse of the whole text.

Cases: a null text, or one without letters, is ``und`` with score 0; labels that are null are not learned; where languages need
equally few phrases, the one with more training rows wins, then the first by name; without any labelled text all is ``und``;
rows are judged one by one, so repeated rows get the same answer; an empty table gives no rows; other columns pass through if
asked for, but one of an output's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import binary, carried, configure, neutral, raw, slices

#: Bytes of folded text that each language's automaton is built from, and characters of the windows that texts are cut into for it.
#: The first bounds the labelled sample: at most 2 * TRAIN_BYTES states for each language, whatever the size of the table.
TRAIN_BYTES, WINDOW = 16384, 512
#: Bytes of the automata's table, which is broadcast: where languages are so many that theirs do not fit in, each learns from fewer bytes.
TABLE_BYTES = 256 << 20
#: Bytes of a stretch, and of the stretches run together: the latter bounds the memory for a long text.
BLOCK, HELD = 512, 1 << 20

_SPACE = 0
#: Bytes of letters in UTF-8 stay, all others become spaces. Upper case has been folded before.
_KEEP = np.array([b if 97 <= b <= 122 or b > 127 else _SPACE for b in range(256)], np.uint8)
_KEPT = set(_KEEP.tolist())


def folded(texts: pa.Array) -> list[np.ndarray]:
    """The folded bytes of each text, with a space (0) at either end; none if no letter is left."""
    lower = pc.utf8_lower(texts)
    out = []
    for start, stop in slices(rows := binary(lower)):
        part = rows.slice(start, stop - start)
        data, at = raw(part)
        base = int(at[0])
        kept = _KEEP[data[base : int(at[-1])]]
        where = at[:-1] - base
        keep = kept != _SPACE
        keep[1:] |= kept[:-1] != _SPACE
        edges = np.concatenate([[0], np.cumsum(keep)])
        dense = kept[keep]
        for i in range(stop - start):
            a, b = int(edges[where[i]]), int(edges[int(at[i + 1]) - base])
            body = dense[a:b]
            if a < b and body[0] == _SPACE:
                body = body[1:]
            if len(body) and body[-1] == _SPACE:
                body = body[:-1]
            out.append(np.concatenate([np.zeros(1, np.uint8), body, np.zeros(1, np.uint8)]) if len(body) else body)
    return out


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton of all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in data:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = copy
                    p = link[p]
        last = new
    return step


class Parser:
    """Phrase counts against the languages' automata, in one table with a row for each state and a column for each byte class."""

    def __init__(self, texts: dict[str, bytes], weight: dict[str, int]):
        self.langs = sorted(texts, key=lambda l: (-weight.get(l, 0), l))
        seen = sorted({b for t in texts.values() for b in t})
        self.classes = np.full(256, len(seen), np.int32)  # the last class: bytes never seen, each a phrase of its own
        self.classes[seen] = np.arange(len(seen), dtype=np.int32)
        self.width = len(seen) + 2  # and one for the padding of short blocks, which changes nothing
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            steps = suffix_automaton(texts[lang])
            own = np.full((len(steps), self.width), -1, np.int64)
            for state, to in enumerate(steps):
                for symbol, target in to.items():
                    own[state, self.classes[symbol]] = target
            restart = own[0].copy()
            found = own >= 0
            missed = np.where(restart >= 0, restart, 0)  # the byte begins the next phrase, or is one by itself
            target = np.where(found, own, missed[None, :]) + base
            ended = (~found).astype(np.int64)
            ended[1:] += ~found[1:] & (restart < 0)[None, :]
            target[:, -1], ended[:, -1] = np.arange(len(steps)) + base, 0
            tables.append(target * self.width * 4 + ended)
            self.roots.append(base * self.width)
            base += len(steps)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        if len(self.table) < 1 << 29:  # as TABLE_BYTES provides for, unless one state were too much
            self.table = self.table.astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[languages, texts]: phrases of each text, the last of which its end may cut off."""
        if len(texts) == 1 and len(texts[0]) > HELD:  # stretch by stretch, each from the states that the one before ended in
            total, state = np.zeros((len(self.langs), 1), np.int64), None
            for start in range(0, len(texts[0]), HELD):
                n, state = self._run([texts[0][start : start + HELD]], state)
                total += n
        else:
            total, state = self._run(texts, None)
        return total + (state != np.array(self.roots, np.int64)[:, None])

    def _run(self, texts: list[np.ndarray], state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """[languages, texts]: phrases that end within the texts, and the last states, from the given ones or the beginning."""
        counts = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
        total = int(counts.sum())
        grid = np.full((total, BLOCK), self.width - 1, np.int32)
        firsts = np.cumsum(counts) - counts
        for text, row, n in zip(texts, firsts.tolist(), counts.tolist(), strict=True):
            grid[row : row + n].reshape(-1)[: len(text)] = self.classes[text]
        # No order by length is needed for the second run, whose stretches are few; the first takes full stretches first.
        sizes = (grid != self.width - 1).sum(1)
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        columns = np.ascontiguousarray(grid[order].T)
        alive = np.searchsorted(-sizes[order], -np.arange(BLOCK), side="left")  # stretches with more than i bytes come first
        inner = np.ones(total, bool)
        inner[firsts] = False
        later = np.flatnonzero(inner)  # stretches with one before them
        out, ends = np.zeros((len(self.langs), len(texts)), np.int64), np.zeros((len(self.langs), len(texts)), np.int64)
        track = np.zeros((BLOCK, total), self.table.dtype)  # the entries met, of stretches in the order taken
        for k, root in enumerate(self.roots):
            entry = np.full(total, root, np.int64)
            if state is not None:
                entry[firsts] = state[k]
            at, n = entry[order], np.zeros(total, np.int64)
            for i in range(BLOCK):
                m = int(alive[i])
                if not m:
                    break
                to = track[i, :m] = self.table[at[:m] + columns[i, :m]]
                n[:m] += to & 3
                at[:m] = to >> 2
            last = at[place]  # by stretch
            moved = later[last[later - 1] != entry[later]]
            while len(moved):
                entry[moved] = last[moved - 1]
                lanes, now = place[moved], entry[moved]
                for i in range(BLOCK):
                    inside = alive[i] > lanes
                    lanes, now = lanes[inside], now[inside]
                    if not len(lanes):
                        break
                    to, old = self.table[now + columns[i, lanes]], track[i, lanes]
                    n[lanes] += (to & 3).astype(np.int64) - (old & 3)
                    track[i, lanes] = to
                    at[lanes] = now = to >> 2
                    apart = now != old >> 2
                    at[lanes[~apart]] = last[order[lanes[~apart]]]  # both runs have met: the rest is known
                    lanes, now = lanes[apart], now[apart]
                last = at[place]
                moved = later[last[later - 1] != entry[later]]
            out[k] = np.add.reduceat(n[place], firsts)
            ends[k] = last[firsts + counts - 1]
        return out, ends

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and phrases a byte. The score is the second-best's lead lost: 1 - best / second."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        counts = self.phrases(texts)
        best = np.argmin(counts, axis=0)  # the first of equals
        low = counts[best, np.arange(len(texts))]
        rest = counts.copy()
        rest[best, np.arange(len(texts))] = np.iinfo(np.int64).max
        second = rest.min(0) if len(self.langs) > 1 else low * 2
        score = np.where(second > 0, 1.0 - low / np.maximum(second, 1), 0.0)
        size = np.array([max(1, len(t)) for t in texts])
        return [self.langs[b] for b in best], score.clip(0, 1).tolist(), (low / size).tolist()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Parser:
    """A parser from a bounded sample: of each language TRAIN_BYTES of distinct windows of its texts, chosen by a hash, or all if fewer."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    weights = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each label
    if not weights:
        return Parser({}, {})
    room = min(TRAIN_BYTES, TABLE_BYTES // (len(weights) * 2 * len(_KEPT) * 4))
    letters = F.trim(F.regexp_replace(F.col(text), r"[^a-zA-Z\x{80}-\x{10FFFF}]+", " "))
    windows = rows.select(F.col(lang).alias("l"), F.explode(F.regexp_extract_all(letters, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))).alias("t"))
    windows = windows.withColumn("h", F.xxhash64(F.col("t"), F.lit(5)))
    # Copies of a text, and heads that texts share, are one window: they neither lower a language's rate nor fill its bytes.
    distinct = windows.groupBy("l", "h").agg(F.max(F.octet_length("t")).alias("size"))
    sizes = {r[0]: r[1] for r in distinct.groupBy("l").agg(F.sum("size")).collect()}
    if not sizes:
        return Parser({}, {})
    wanted = 2.0 * max(room, 16 * WINDOW)  # so much that no language goes without a window
    rates = labelled.sparkSession.createDataFrame([(l, wanted / size) for l, size in sizes.items()], "l string, rate double")
    draw = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    drawn = windows.join(F.broadcast(rates), "l").filter(draw < F.col("rate")).select("l", "t", draw.alias("d")).distinct().collect()  # about ``wanted`` bytes a language
    found: dict[str, list[bytes]] = {}
    for l, t, _ in sorted(drawn, key=lambda r: (r[2], r[1])):
        found.setdefault(l, []).append(folded(pa.array([t]))[0].tobytes())
    return Parser({l: b"".join(ts)[:room] for l, ts in found.items() if any(ts)}, weights)


OUTPUTS = ("lang_pred", "score", "phrase_rate")


def identify(docs: DataFrame, parser: Parser, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with lang_pred, score (0 to 1) and phrase_rate (phrases a byte). No exchange."""
    configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # at most TABLE_BYTES
    sent, passed = neutral(docs, carried(carry, OUTPUTS), __text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("__text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
            names, scores, rates = [], [], []
            for start, stop in slices(binary(texts)):
                part = folded(texts.slice(start, stop - start))
                l, s, r = own.predict(part)
                names += l
                scores += s
                rates += r
            sure = [ok and n != "und" for ok, n in zip(letters, names, strict=True)]
            cells = [[n if ok else "und" for n, ok in zip(names, sure, strict=True)], [x if ok else 0.0 for x, ok in zip(scores, sure, strict=True)], [x if ok else 0.0 for x, ok in zip(rates, sure, strict=True)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[0], pa.string()), pa.array(cells[1], pa.float64()), pa.array(cells[2], pa.float64())], names=[*batch.schema.names, *OUTPUTS])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    found = sent.mapInArrow(run, T.StructType([*sent.schema.fields, *(T.StructField(n, k) for n, k in zip(OUTPUTS, kinds, strict=True))]))
    return found.select(*passed, *OUTPUTS)


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")), F.lit(folds))
