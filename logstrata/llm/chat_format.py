"""Chat formatting with role repair of least cost.

Legal conversations are the paths of an automaton: an optional system turn, then user and assistant in turn, an assistant last.
A turn is kept, relabelled, or merged into the turn before it, and empty turns may be inserted; dynamic programming over the
automaton's states finds the cheapest repair, and the repaired sequence is rendered.

A step is a matrix over (min, +), and matrices of stretches multiply, so a conversation of any length may lie across tasks: rows are
range-partitioned by conversation and turn, each task sums up its first and last stretch, the driver joins these summaries (two a
task, however many rows), and tasks then repair their stretches with the states and costs at their ends known. Of equally cheap
repairs the one is taken that, from the first turn on, takes the least state in the order of ROLES, whatever the partitions.

Cases: turns are ordered by turn, then role and text, nulls first; a null conversation id is a conversation; a null or unknown role
must be relabelled, at a cost of its own; a null text is empty; a control mark within a text is escaped, so that only the rendering
makes turns; repeated rows are turns of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logstrata.llm.common import configure, shared_dir

#: States: the role of the turn before; the first is the beginning. FOLLOW: what may come after each. LAST: where it may end.
ROLES = ("", "system", "user", "assistant")
FOLLOW = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = (0, 3)
KEEP, MERGE = 0, 1
#: Turns of one output row: longer conversations have several, in order of first_turn, whose texts follow each other.
BLOCK_TURNS = 256
_FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    name: int = 1  # to give a role to a turn of unknown role
    insert: int = 3


class Repair:
    """Step tables: for a turn's role (0: unknown) and a pair of states, cost and action."""

    def __init__(self, costs: Costs):
        n = len(ROLES)
        self.gap = [[self._inserted(s, x) for x in range(n)] for s in range(n)]
        self.steps: list[list[list[tuple[int, tuple]]]] = []
        for role in range(n):
            change = lambda x: 0 if x == role else costs.relabel if role else costs.name  # noqa: B023, E731
            table = [[(_FAR, ())] * n for _ in range(n)]
            for s in range(n):
                for x in range(1, n):
                    path = self.gap[s][x]
                    if path is not None:
                        table[s][x] = (change(x) + costs.insert * len(path), (KEEP, path, x))
                if s and costs.merge + change(s) < table[s][s][0]:
                    table[s][s] = (costs.merge + change(s), (MERGE, (), s))
            self.steps.append(table)
        self.ends = [min((costs.insert * len(p), p) for p in (self._to_end(s),)) for s in range(n)]
        self.costs = costs
        self._products: dict[tuple, tuple] = {}

    @staticmethod
    def _inserted(s: int, x: int) -> tuple[int, ...] | None:
        """The fewest turns to be inserted between a turn of state s and one of role x."""
        todo, seen = [((), s)], {s}
        while todo:
            path, at = todo.pop(0)
            if x in FOLLOW[at]:
                return path
            for y in FOLLOW[at]:
                if y not in seen:
                    seen.add(y)
                    todo.append(((*path, y), y))
        return None

    def _to_end(self, s: int) -> tuple[int, ...]:
        return () if s in LAST else min(((*(self._inserted(s, x) or ()), x) for x in LAST if x), key=len)

    identity = tuple(tuple(0 if a == b else _FAR for b in range(len(ROLES))) for a in range(len(ROLES)))

    def times(self, product: tuple, role: int) -> tuple[tuple, int]:
        """A stretch's matrix, less its least cost, after one more turn, and that least cost. Few differ, so they are kept."""
        found = self._products.get((product, role))
        if found is None:
            n, step = range(len(ROLES)), self.steps[role]
            rows = [[min(min(row[k] + step[k][b][0] for k in n), _FAR) for b in n] for row in product]
            least = min(min(row) for row in rows)
            found = self._products[product, role] = (tuple(tuple(min(v - least, _FAR) if v < _FAR else _FAR for v in row) for row in rows), least)
        return found

    def final(self) -> list[int]:
        return [cost for cost, _ in self.ends]

    def before(self, role: int, after: list[int]) -> list[int]:
        """Costs still to come before a turn, by state, from those after it."""
        return [min(min(c + a for (c, _), a in zip(row, after, strict=True)), _FAR) for row in self.steps[role]]

    def walk(self, roles: list[int], state: int, after: list[int]) -> tuple[list[tuple], int]:
        """The actions for a stretch from a state, and the state it ends in. ``after``: costs to come behind the stretch."""
        behind = [after]
        for role in reversed(roles):
            behind.append(self.before(role, behind[-1]))
        behind.reverse()
        actions = []
        for i, role in enumerate(roles):
            row = self.steps[role][state]
            state = min(range(len(ROLES)), key=lambda x: (row[x][0] + behind[i + 1][x], x))  # noqa: B023
            actions.append((row[state][0], *row[state][1]))
        return actions, state


def role_of(name: str | None) -> int:
    return ROLES.index(name) if name in ROLES[1:] else 0


_MARK = re.compile(r"<\|(\\*im_(?:start|end)\|>)")
_ESCAPED = re.compile(r"<\|\\(\\*im_(?:start|end)\|>)")


def escape(body: str) -> str:
    """The text with a backslash more in what looks like a control mark; ``unescape`` takes it away."""
    return _MARK.sub(r"<|\\\1", body)


def unescape(body: str) -> str:
    return _ESCAPED.sub(r"<|\1", body)


def opening(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSING = "<|im_end|>\n"


def _stretches(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[tuple[object, list[int], list[str]]]:
    """(conversation, roles, texts) of each stretch of a task's sorted rows."""
    key, roles, bodies, some = None, [], [], False
    for batch in batches:
        names, said = batch.column("role").to_pylist(), batch.column("text").to_pylist() if texts else [None] * batch.num_rows
        for conv, name, body in zip(batch.column("conv_id").to_pylist(), names, said, strict=True):
            if some and conv != key:
                yield key, roles, bodies
                roles, bodies = [], []
            key, some = conv, True
            roles.append(role_of(name))
            if texts:
                bodies.append(body or "")
    if some:
        yield key, roles, bodies


def _edges(repair: Repair, df: DataFrame) -> list[list[tuple]]:
    """For each task with rows, its first and last stretch: (task, conversation, turns, matrix), once if there is only one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for conv, roles, _ in _stretches(batches, False):
            product, base = repair.identity, 0
            for role in roles:
                product, more = repair.times(product, role)
                base += more
            found[1:] = [(conv, len(roles), [v + base if v < _FAR else _FAR for row in product for v in row])]
        task = TaskContext.get().partitionId()
        for place, (conv, n, values) in enumerate(found):
            yield pa.RecordBatch.from_pydict({"task": [task], "place": [place], "conv_id": pa.array([conv], kind), "n": [n], "matrix": pa.array([values], pa.list_(pa.int64()))})

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema["conv_id"].dataType)
    conv = df.schema["conv_id"].dataType.simpleString()
    rows = df.select("conv_id", "role").mapInArrow(run, f"task long, place long, conv_id {conv}, n long, matrix array<long>").collect()  # two rows a task
    rows.sort(key=lambda r: (r["task"], r["place"]))
    chains: list[list[tuple]] = []
    for r in rows:
        link = (r["task"], r["place"], r["conv_id"], r["n"], r["matrix"])
        if chains and chains[-1][-1][2] == r["conv_id"] and chains[-1][-1][0] != r["task"]:
            chains[-1].append(link)
        else:
            chains.append([link])
    return [c for c in chains if len(c) > 1]


def _joined(repair: Repair, df: DataFrame) -> dict[tuple[int, object], tuple[int, int, list[int], bool]]:
    """For a task and a conversation that reaches beyond it: state and turn at its beginning, costs to come, whether it ends."""
    chains, n = _edges(repair, df), len(ROLES)
    if not chains:
        return {}
    costs: dict[tuple[int, object], list[int]] = {}
    for chain in chains:
        after = repair.final()
        for task, _, conv, _, matrix in reversed(chain):
            costs[task, conv] = after
            after = [min(min(matrix[a * n + b] + after[b] for b in range(n)), _FAR) for a in range(n)]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for conv, roles, _ in _stretches(batches, False):
            if (task, conv) in costs:
                states = [repair.walk(roles, s, costs[task, conv])[1] for s in range(n)]
                yield pa.RecordBatch.from_pydict({"task": [task], "null": [conv is None], "name": [str(conv)], "ends": pa.array([states], pa.list_(pa.int64()))})

    found = {(r["task"], r["null"], r["name"]): r["ends"] for r in df.select("conv_id", "role").mapInArrow(ends, "task long, null boolean, name string, ends array<long>").collect()}
    out = {}
    for chain in chains:
        state, turn = 0, 0
        for i, (task, _, conv, turns, _) in enumerate(chain):
            out[task, conv] = (state, turn, costs[task, conv], i == len(chain) - 1)
            state, turn = found[task, conv is None, str(conv)][state], turn + turns
    return out


def format_chats(turns: DataFrame, costs: Costs = Costs(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for at most BLOCK_TURNS turns of a conversation: conv_id, first_turn (its place), n_turns, n_relabelled, n_merged,
    n_inserted, cost and rendered. A conversation's rows, in order, joined, are its text."""
    spark = turns.sparkSession
    configure(spark)
    shared_dir(spark)
    repair = Repair(costs)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = ["conv_id", "turn", "role", "text", "__row"]
    # A row number parts even rows that are alike, so no conversation, nor any turn, must lie within one task.
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = dealt.select("conv_id", "role", "text").checkpoint()
    spanning = spark.sparkContext.broadcast(_joined(repair, fixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for conv_id, roles, texts in _stretches(batches, True):
            state, first, after, ends = spanning.value.get((task, conv_id), (0, 0, repair.final(), True))
            actions, last = repair.walk(roles, state, after)
            for i in range(0, len(roles), BLOCK_TURNS):
                out, count = [], [0, 0, 0, 0]  # relabelled, merged, inserted, cost
                block = actions[i : i + BLOCK_TURNS]
                for (cost, action, path, x), own, body in zip(block, roles[i : i + BLOCK_TURNS], texts[i : i + BLOCK_TURNS], strict=True):
                    count[0] += x != own
                    count[1] += action == MERGE
                    count[2] += len(path)
                    count[3] += cost
                    if action == MERGE:
                        out.append("\n" + escape(body))
                        continue
                    if state or first + i:
                        out.append(CLOSING)
                    for y in path:
                        out.append(opening(y) + CLOSING)
                    out.append(opening(x) + escape(body))
                    state = x
                if ends and i + BLOCK_TURNS >= len(roles):
                    cost, path = repair.ends[last]
                    out.append(CLOSING + "".join(opening(y) + CLOSING for y in path))
                    count[2] += len(path)
                    count[3] += cost
                cells = [[first + i], [len(block)], *([c] for c in count)]
                yield pa.RecordBatch.from_arrays([pa.array([conv_id], kind), *(pa.array(c, pa.int64()) for c in cells), pa.array(["".join(out)])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["conv_id", "first_turn", "n_turns", "n_relabelled", "n_merged", "n_inserted", "cost", "rendered"]
    kind = to_arrow_type(fixed.schema["conv_id"].dataType)
    schema = T.StructType([fixed.schema["conv_id"], *(T.StructField(n, T.LongType()) for n in names[1:-1]), T.StructField("rendered", T.StringType())])
    return fixed.mapInArrow(run, schema)
