"""Chat formatting: conversations brought to legal turns at the least cost, and rendered.

Legal is [system] (user assistant)+. Going through a conversation's turns in order, each
either opens a turn under its own role or another (relabel), after as many empty turns
as the automaton needs in between (insert), or joins the turn before (merge); at the end
empty turns close what is open. A dynamic programme over the last role picks the choices
of least total cost; of equal ones the first in the order of STATES, merges last.

Costs of stretches of turns are 4 x 4 tables that combine as matrices do (with sums for
products and minima for sums), so a conversation may span any number of partitions: rows
are dealt by ranges and sorted, each partition gives the table of its first and of its
last conversation, and gets back the states in which its own stretch begins and ends.

Result: one row a turn, in its conversation's order; the pieces of a conversation,
joined, are its rendered text. `<|` in a text is broken up so that it can't open a turn.

Defined cases: a null text is empty; a role that is null or unknown is relabelled, at
UNKNOWN; turns with one number go by role, then by a hash of the text; a null turn comes first; rows with
a null conv_id make one conversation; repeated rows are turns of their own; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col, saved

STATES = ("start", "system", "user", "assistant")
RELABEL, UNKNOWN, INSERT, MERGE = 3, 1, 2, 1
SCHEMA = "conv_id long, turn long, role_in string, action string, role_out string, n_inserted int, cost int, piece string"
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_FAR = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The least empty turns between a state and the next role."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in range(4):
        at = [(s, ())]
        for state, path in at:
            for n in _NEXT[state]:
                if (s, n) not in out:
                    out[s, n] = path
                    at.append((n, (*path, n)))
    return out


PATHS = _paths()
CLOSE = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def choices(role: int) -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """(state, next state, cost, empty turns before, merged) for a turn of that role (0: unknown)."""
    out = []
    for s in range(4):
        for to in (1, 2, 3):
            other = 0 if to == role else RELABEL if role else UNKNOWN
            if (s, to) in PATHS:
                out.append((s, to, other + INSERT * len(PATHS[s, to]), PATHS[s, to], False))
            if s == to:
                out.append((s, to, other + MERGE, (), True))
    return out


CHOICES = [choices(r) for r in range(4)]


def step_table(role: int) -> np.ndarray:
    out = np.full((4, 4), _FAR)
    for s, to, cost, *_ in CHOICES[role]:
        out[s, to] = min(out[s, to], cost)
    return out


STEPS = [step_table(r) for r in range(4)]
END = np.array([INSERT * len(CLOSE[s]) for s in range(4)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(_FAR, (a[:, :, None] + b[None, :, :]).min(1))


def table_of(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4) > 0, 0, _FAR)
    for r in roles:
        out = times(out, STEPS[r])
    return out


def repair(roles: list[int], begin: int = 0, end: int | None = None) -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """The choices for turns of these roles from a state to a state, or to the conversation's end."""
    costs = [[0 if s == begin else _FAR for s in range(4)]]
    how: list[list] = []
    for r in roles:
        now, by = [_FAR] * 4, [None] * 4
        for c in CHOICES[r]:
            if costs[-1][c[0]] + c[2] < now[c[1]]:
                now[c[1]], by[c[1]] = costs[-1][c[0]] + c[2], c
        costs.append(now)
        how.append(by)
    s = min(range(4), key=lambda x: costs[-1][x] + END[x]) if end is None else end
    out = []
    for by in reversed(how):
        out.append(by[s])
        s = by[s][0]
    return out[::-1]


def _rows(batches) -> list[dict]:
    return [r for b in batches for r in b.to_pylist()]


def _stretches(rows: list[dict]) -> list[tuple[int, int]]:
    cut = [0, *(i for i in range(1, len(rows)) if rows[i]["conv_id"] != rows[i - 1]["conv_id"]), len(rows)]
    return list(zip(cut, cut[1:], strict=False)) if rows else []


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return STATES.index(name) if name in STATES[1:] else 0


def _ends(parts: list[tuple[int, int | None, int | None, list[int], list[int]]]) -> dict[int, tuple[int, int | None]]:
    """Per partition the states in which its first stretch begins and its last ends (None: the conversation's end).

    parts: (number, first and last conversation, tables of the two; one stretch: its table twice), in order.
    """
    out = {p[0]: [0, None] for p in parts}
    i = 0
    while i < len(parts):
        # a run of partitions through which one conversation goes on
        j = i
        while j + 1 < len(parts) and parts[j + 1][1] == parts[j][2] and (j == i or parts[j][1] == parts[j][2]):
            j += 1
        if j > i:
            tables = [np.array(parts[k][4] if k == i else parts[k][3]).reshape(4, 4) for k in range(i, j + 1)]
            ahead = [np.array([0, _FAR, _FAR, _FAR])]
            for t in tables:
                ahead.append(np.minimum(_FAR, (ahead[-1][:, None] + t).min(0)))
            s = int(np.argmin(ahead[-1] + END))
            for k in range(len(tables) - 1, 0, -1):
                s = int(np.argmin(ahead[k] + tables[k][:, s]))
                out[parts[i + k][0]][0], out[parts[i + k - 1][0]][1] = s, s
        i = max(j, i + 1)
    return {k: tuple(v) for k, v in out.items()}


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: how it was repaired, at what cost, and its piece of the rendered conversation."""
    named = turns.select(col(conv_id).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), col(role).alias("role"), col(text).alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last two order equal turns, and let even one conversation of equal turns be dealt out
    order = ("conv_id", "turn", "role", "th", "rid")
    named = named.withColumn("th", F.xxhash64("text")).withColumn("rid", F.monotonically_increasing_id())
    dealt = saved(named.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("th", "rid"))

    def ends(batches):
        rows = _rows(b.select(["conv_id", "role"]) for b in batches)
        if cut := _stretches(rows):
            first, last = ([_role(r["role"]) for r in rows[i:j]] for i, j in (cut[0], cut[-1]))
            yield batch_of(part=pa.array([TaskContext.get().partitionId()], pa.int64()), a=pa.array([rows[0]["conv_id"]], pa.int64()), z=pa.array([rows[-1]["conv_id"]], pa.int64()), first=pa.array([table_of(first).ravel().tolist()], pa.list_(pa.int64())), last=pa.array([table_of(last).ravel().tolist()], pa.list_(pa.int64())))

    parts = dealt.mapInArrow(ends, "part long, a long, z long, first array<long>, last array<long>").orderBy("part").collect()
    states = turns.sparkSession.sparkContext.broadcast(_ends([tuple(p) for p in parts]))

    def run(batches):
        rows = _rows(batches)
        begin, end = states.value.get(TaskContext.get().partitionId(), (0, None))
        cut = _stretches(rows)
        for i, j in cut:
            first, last = (i, j) == cut[0], (i, j) == cut[-1]
            s = begin if first else 0
            done = repair([_role(r["role"]) for r in rows[i:j]], s, end if last else None)
            out: list[list] = [[] for _ in range(8)]
            for k, (r, (a, b, cost, empty, merged)) in enumerate(zip(rows[i:j], done, strict=True)):
                here, closing = _role(r["role"]), CLOSE[b] if k == j - i - 1 and not (last and end is not None) else None
                body = (r["text"] or "").replace("<|", "< |")
                piece = "\n" + body if merged else ("<|end|>\n" if a else "") + "".join(f"<|{STATES[x]}|>\n<|end|>\n" for x in empty) + f"<|{STATES[b]}|>\n{body}"
                if closing is not None:
                    piece += "<|end|>\n" + "".join(f"<|{STATES[x]}|>\n<|end|>\n" for x in closing)
                action = "+".join(["insert"] * bool(empty or closing) + ["relabel"] * (here != b) + ["merge"] * merged) or "keep"
                for x, v in zip(out, (r["conv_id"], r["turn"], r["role"], action, STATES[b], len(empty) + len(closing or ()), cost + INSERT * len(closing or ()), piece), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield batch_of(**{f.split()[0]: pa.array(x, k) for f, x, k in zip(SCHEMA.split(", "), out, kinds, strict=True)})

    return dealt.mapInArrow(run, SCHEMA)
