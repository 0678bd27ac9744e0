"""Chat formatting: minimum-cost repair of role order, then rendering.

A legal conversation is what an automaton accepts: an optional system turn, then user and assistant in turn, the assistant last.  Every turn is kept,
relabelled, or merged into the turn before it, and empty turns may be inserted; dynamic programming over the automaton's states finds the cheapest way.

One step is a (min, +) product with the 4 x 4 cost matrix of the turn's role, so a conversation of any length is cut
wherever its rows fall: rows are range-partitioned by conversation and turn, and a partition's first and last conversations may go on next door.
Those fragments (at most two a partition) are reduced to matrices, which the driver multiplies for the costs at each cut and then, from the end, for the states
there; each partition then repairs its own rows.  A conversation with a third of all rows is spread like any others, and the result doesn't depend on where the cuts are.

The result has a row per turn; concatenating ``rendered`` in order of (turn, role, text) gives the conversation.  Rows: null conversation ids form one
conversation; null turns sort first, ties by role and text; null or unknown roles must be relabelled or merged; null texts are empty; repeated rows are turns of their own; markers within
texts are broken up; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shared_root

ROLES = ("system", "user", "assistant")
START, STATES = 0, 4  # states: start, then the role of the last turn
SCHEMA = "conv_id long, turn long, role string, action string, new_role string, inserted_before string, inserted_after string, cost long, rendered string"


@dataclass(frozen=True)
class RepairCosts:
    merge: int = 1
    insert: int = 2
    relabel: int = 3
    merge_other: int = 4


def follows(state: int, role: int) -> bool:
    """Whether a turn of ``role`` (1 to 3) may come after ``state``."""
    return (state, role) in ((0, 1), (0, 2), (1, 2), (2, 3), (3, 2))


@lru_cache
def steps(role: str | None, costs: RepairCosts) -> tuple[tuple, tuple]:
    """(cost, way) by state before and after a turn of ``role``; a way is (action, inserted role or None)."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    cost = [[None] * STATES for _ in range(STATES)]
    way = [[None] * STATES for _ in range(STATES)]

    def offer(a: int, b: int, c: int, w: tuple) -> None:
        if cost[a][b] is None or c < cost[a][b]:
            cost[a][b], way[a][b] = c, w

    for a in range(STATES):
        for b in range(1, STATES):
            base, action = (0, "keep") if b == own else (costs.relabel, "relabel")
            if follows(a, b):
                offer(a, b, base, (action, None))
            for z in range(1, STATES):
                if follows(a, z) and follows(z, b):
                    offer(a, b, base + costs.insert, (action, z))
        if a:
            offer(a, a, costs.merge if a == own else costs.merge_other, ("merge", None))
    return tuple(map(tuple, cost)), tuple(map(tuple, way))


def endings(costs: RepairCosts) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """Cost and inserted roles with which a conversation ends, by state."""
    return ((0, ()), (2 * costs.insert, (2, 3)), (costs.insert, (3,)), (0, ()))


def advance(vector: list, role: str | None, costs: RepairCosts) -> list:
    """Least cost of every state after one more turn."""
    cost = steps(role, costs)[0]
    out = [None] * STATES
    for a, v in enumerate(vector):
        if v is not None:
            for b, c in enumerate(cost[a]):
                if c is not None and (out[b] is None or v + c < out[b]):
                    out[b] = v + c
    return out


def transfer(roles: list[str | None], costs: RepairCosts) -> list[list]:
    """(min, +) matrix of a run of turns."""
    rows = []
    for a in range(STATES):
        v = [None] * STATES
        v[a] = 0
        for r in roles:
            v = advance(v, r, costs)
        rows.append(v)
    return rows


def apply(vector: list, rows: list[list]) -> list:
    sums = lambda b: [v + rows[a][b] for a, v in enumerate(vector) if v is not None and rows[a][b] is not None]
    return [min(s) if (s := sums(b)) else None for b in range(STATES)]


def trace(vector: list, roles: list[str | None], end: int, costs: RepairCosts) -> list[int]:
    """States before the first and after each turn, for the cheapest way to ``end``; ties by the least state, from the end."""
    history = [vector]
    for r in roles:
        history.append(advance(history[-1], r, costs))
    path = [end]
    for k in range(len(roles) - 1, -1, -1):
        cost = steps(roles[k], costs)[0]
        b = path[-1]
        path.append(next(a for a in range(STATES) if history[k][a] is not None and cost[a][b] is not None and history[k][a] + cost[a][b] == history[k + 1][b]))
    return path[::-1]


def best_end(vector: list, costs: RepairCosts) -> int:
    ends = endings(costs)
    return min((v + ends[s][0], s) for s, v in enumerate(vector) if v is not None)[1]


def _open(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}"


def _plain(text: str | None) -> str:
    return (text or "").replace("<|", "<​|")


def render(roles: list[str | None], texts: list[str | None], path: list[int], last: bool, costs: RepairCosts) -> list[tuple]:
    """(action, new role, inserted before, inserted after, cost, rendered) of each turn along a path of states."""
    out = []
    for k, role in enumerate(roles):
        a, b = path[k], path[k + 1]
        cost, way = (x[a][b] for x in steps(role, costs))
        action, z = way
        text, close = _plain(texts[k]), "" if a == START else "<|end|>\n"
        if action == "merge":
            piece = "\n" + text
        else:
            piece = close + (_open(ROLES[z - 1], "") + "<|end|>\n" if z else "") + _open(ROLES[b - 1], text)
        after: tuple[int, ...] = ()
        if last and k == len(roles) - 1:
            extra, after = endings(costs)[b]
            cost += extra
            piece += "<|end|>\n" + "".join(_open(ROLES[x - 1], "") + "<|end|>\n" for x in after)
        out.append((action, ROLES[b - 1], ROLES[z - 1] if z else None, ",".join(ROLES[x - 1] for x in after) or None, cost, piece))
    return out


def repair(turns: list[tuple[str | None, str | None]], costs: RepairCosts = RepairCosts()) -> list[tuple]:
    """The repair of one conversation, held whole: what the distributed operator gives for (role, text) turns."""
    roles, texts = [r for r, _ in turns], [t for _, t in turns]
    vector = [0, None, None, None]
    for r in roles:
        vector = advance(vector, r, costs)
    return render(roles, texts, trace([0, None, None, None], roles, best_end(vector, costs), costs), True, costs)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[pa.RecordBatch]]]:
    """Conversations of a sorted partition, as lists of slices."""
    now, parts = None, []
    for batch in batches:
        ids = batch.column(0).to_pylist()
        a = 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or ids[k] != ids[a]:
                if parts and ids[a] != now:
                    yield now, parts
                    parts = []
                now = ids[a]
                parts.append(batch.slice(a, k - a))
                a = k
    if parts:
        yield now, parts


def format_chats(turns: DataFrame, costs: RepairCosts = RepairCosts()) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text): how it is repaired, and its piece of the rendered conversation."""
    spark = turns.sparkSession
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    # a checkpoint fixes which rows are in which partition, for all passes and for repeated tasks
    held = rows.repartitionByRange(tasks, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text").checkpoint()

    def reduce_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, edges, k = TaskContext.get().partitionId(), [], 0
        for conv, parts in _fragments(batches):
            roles = [r for x in parts for r in x.column(2).to_pylist()]
            edges = [*edges[:1], (conv, roles)] if edges else [(conv, roles)]
            k += 1
        for n, (conv, roles) in enumerate(edges):
            flat = [-1 if c is None else c for row in transfer(roles, costs) for c in row]
            yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([n]), pa.array([conv], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], names=["pid", "n", "conv_id", "m"])

    edges = sorted(held.mapInArrow(reduce_edges, "pid long, n long, conv_id long, m array<long>").collect(), key=lambda r: (r["pid"], r["n"]))
    # chains of fragments of one conversation over neighbouring partitions that hold rows
    chains, entry = [], {}
    for r in edges:
        if chains and chains[-1][-1]["conv_id"] == r["conv_id"] and chains[-1][-1]["pid"] != r["pid"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    for chain in chains:
        vector = [0, None, None, None]
        for r in chain:
            entry[r["pid"], r["conv_id"]] = vector
            m = [None if x < 0 else x for x in r["m"]]
            vector = apply(vector, [m[k : k + STATES] for k in range(0, STATES * STATES, STATES)])
        entry["end", chain[-1]["pid"], chain[-1]["conv_id"]] = best_end(vector, costs)
    vectors = spark.sparkContext.broadcast(entry)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for conv, parts in _fragments(batches):
            if (vector := vectors.value.get((pid, conv))) is not None:
                roles = [r for x in parts for r in x.column(2).to_pylist()]
                after = vector
                for r in roles:
                    after = advance(after, r, costs)
                to = [trace(vector, roles, s, costs)[0] if after[s] is not None else -1 for s in range(STATES)]
                yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([conv], pa.int64()), pa.array([to], pa.list_(pa.int64()))], names=["pid", "conv_id", "entry"])

    way = {(r["pid"], r["conv_id"]): r["entry"] for r in held.mapInArrow(back, "pid long, conv_id long, entry array<long>").collect()} if chains else {}
    ends = {}
    for chain in chains:
        state = entry["end", chain[-1]["pid"], chain[-1]["conv_id"]]
        for r in reversed(chain):
            ends[r["pid"], r["conv_id"]] = (entry[r["pid"], r["conv_id"]], state, r is chain[-1])
            state = way[r["pid"], r["conv_id"]][state]
    fixed = spark.sparkContext.broadcast(ends)
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith(" long") else pa.string()) for x in SCHEMA.split(", ")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for conv, parts in _fragments(batches):
            roles, texts = ([v for x in parts for v in x.column(c).to_pylist()] for c in (2, 3))
            vector, end, last = fixed.value.get((pid, conv), ([0, None, None, None], None, True))
            if end is None:
                after = vector
                for r in roles:
                    after = advance(after, r, costs)
                end = best_end(after, costs)
            done = render(roles, texts, trace(vector, roles, end, costs), last, costs)
            turn = [v for x in parts for v in x.column(1).to_pylist()]
            columns = [[conv] * len(roles), turn, roles, *zip(*done)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return held.mapInArrow(finish, SCHEMA)
