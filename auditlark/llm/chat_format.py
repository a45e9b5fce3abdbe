"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

Legal conversations: an optional system turn, then user and assistant in turn, with an assistant's at the end. Each
turn is kept, merged into the turn before, or relabelled; empty turns may be inserted. Costs are non-negative, and
dynamic programming over (turn, state) finds the least total. A conversation is cut into segments of bounded size:
a segment is a 4 x 4 matrix of least costs between states, matrices combine in (min, +), and once the states at the
cuts are known every segment is decoded by itself. So no conversation, however long, has to be in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import written

# Roles, states after a turn of that role (0 is the start), the moves that are legal, and costs.
ROLES = ("system", "user", "assistant")
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
MERGE, MERGE_OTHER, RELABEL, INSERT = 1.0, 5.0, 4.0, 2.5
FINAL = 3
SEGMENT = 4096


def insertions() -> tuple[np.ndarray, list[list[list[int]]]]:
    """Least cost, and the roles inserted, to get from each state to each by empty turns."""
    cost = np.full((4, 4), np.inf)
    path: list[list[list[int]]] = [[[] for _ in range(4)] for _ in range(4)]
    for s in range(4):
        cost[s, s] = 0
    for _ in range(4):
        for s in range(4):
            for a, b in sorted(LEGAL):
                if cost[s, a] + INSERT < cost[s, b]:
                    cost[s, b], path[s][b] = cost[s, a] + INSERT, [*path[s][a], b]
    return cost, path


def step(role: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs (state before, state after) of a turn of a role (1 to 3; 0 for any other), and the entry state of the
    turn itself after insertions; an entry of -1 - s is a merge in state s."""
    gap, _ = insertions()
    cost, via = np.full((4, 4), np.inf), np.full((4, 4), -9, np.int64)
    for s in range(4):
        for m in range(4):
            if m and (c := gap[s, m] + (MERGE if role == m else MERGE_OTHER)) < cost[s, m]:
                cost[s, m], via[s, m] = c, -1 - m
            for t in range(1, 4):
                if (m, t) in LEGAL and (c := gap[s, m] + (0.0 if role == t else RELABEL)) < cost[s, t]:
                    cost[s, t], via[s, t] = c, m
    return cost, via


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def decode(roles: list[int], enter: int, leave: int, steps, path) -> list[tuple[list[int], int, bool]]:
    """For each turn: roles of the empty turns before it, its role, and whether it starts a turn."""
    best = np.full(4, np.inf)
    best[enter] = 0
    back = np.zeros((len(roles), 4), np.int8)
    for i, r in enumerate(roles):
        total = best[:, None] + steps[r][0]
        back[i] = total.argmin(axis=0)
        best = total.min(axis=0)
    out, state = [], leave
    for i in range(len(roles) - 1, -1, -1):
        before = int(back[i, state])
        via = int(steps[roles[i]][1][before, state])
        out.append((path[before][via], state, True) if via >= 0 else (path[before][-1 - via], state, False))
        state = before
    return out[::-1]


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers the sorted rows of a partition by segment; the last row of each carries the segment's matrix."""
    steps = [step(r)[0] for r in range(4)]
    part, count, held, out = TaskContext.get().partitionId() << 32, 0, [], []

    def close() -> None:
        nonlocal count, held
        m = steps[held[0][2]]
        for r in held[1:]:
            m = product(m, steps[r[2]])
        last = len(held) - 1
        out.extend((*r, part + count, k, m.ravel().tolist() if k == last else None) for k, r in enumerate(held))
        count, held = count + 1, []

    def flushed() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["conv_id", "rid", "role", "seg", "pos", "matrix"])
        out.clear()
        return frame

    for frame in frames:
        for row in zip(frame.conv_id.tolist(), frame.rid.tolist(), frame.role.tolist(), strict=True):
            if held and (held[-1][0] != row[0] or len(held) == SEGMENT):
                close()
            held.append(row)
        if out:
            yield flushed()
    if held:
        close()
        yield flushed()


def _joints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matrices of each conversation in order -> states at the segments' ends, and the least cost."""
    gap, _ = insertions()
    out: list[tuple] = []

    def solve(segs: list[int], matrices: list[np.ndarray]) -> None:
        best, backs = np.array([0, np.inf, np.inf, np.inf]), []
        for m in matrices:
            total = best[:, None] + m
            backs.append(total.argmin(axis=0))
            best = total.min(axis=0)
        state, cost, ends = int((best + gap[:, FINAL]).argmin()), float((best + gap[:, FINAL]).min()), []
        for b in reversed(backs):
            ends.append((int(b[state]), state))
            state = int(b[state])
        out.extend((seg, enter, leave, k == len(segs) - 1, cost) for k, (seg, (enter, leave)) in enumerate(zip(segs, reversed(ends), strict=True)))

    def flushed() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["of", "enter", "leave", "last", "cost"])
        out.clear()
        return frame

    conv, segs, matrices = None, [], []
    for frame in frames:
        for c, s, m in zip(frame.conv_id.tolist(), frame.seg.tolist(), frame.matrix.tolist(), strict=True):
            if segs and c != conv:
                solve(segs, matrices)
                segs, matrices = [], []
            conv = c
            segs.append(s)
            matrices.append(np.asarray(m, float).reshape(4, 4))
        if out:
            yield flushed()
    if segs:
        solve(segs, matrices)
        yield flushed()


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole segments in order -> turns made: which input row, role, and how many turns began so far."""
    _, path = insertions()
    steps = [step(r) for r in range(4)]
    out: list[tuple] = []

    def make(rows: list[tuple]) -> None:
        seg, _, _, _, enter, leave, last, cost, conv = rows[0]
        began = k = 0
        for row, (before, role, new) in zip(rows, decode([r[2] for r in rows], enter, leave, steps, path), strict=True):
            for r in before:
                began, k = began + 1, k + 1
                out.append((seg, k, began, r, None, conv, cost))
            began, k = began + new, k + 1
            out.append((seg, k, began, role, row[1], conv, cost))
        for r in path[leave][FINAL] if last else ():
            began, k = began + 1, k + 1
            out.append((seg, k, began, r, None, conv, cost))

    def flushed() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["seg", "k", "began", "role", "rid", "conv_id", "cost"])
        frame["rid"] = pd.array([r[4] for r in out], "Int64")
        out.clear()
        return frame

    held: list[tuple] = []
    for frame in frames:
        for row in zip(*(frame[c].tolist() for c in ("seg", "rid", "role", "pos", "enter", "leave", "last", "cost", "conv_id")), strict=True):
            if held and held[-1][0] != row[0]:
                make(held)
                held = []
            held.append(row)
        if out:
            yield flushed()
    if held:
        make(held)
        yield flushed()


def repair_chats(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, out_turn (from 0), role, text, n_source (turns in it), cost.

    Input turns are ordered by turn (null first), role, and text hash. A role other than the three (in any case
    and with blanks around), null too, is nobody's: it is relabelled or merged. Null text is empty. Texts merge with
    a line feed between. cost is that of the whole conversation. Null conv_ids are one conversation. Equal rows are
    turns of their own. An empty table gives no rows; extra columns are ignored. A merged turn's text is one value.
    """
    role = F.lower(F.trim(F.col("role").cast("string")))
    code = F.coalesce(F.array_position(F.array(*(F.lit(r) for r in ROLES)), role).cast("int"), F.lit(0))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"))
    # rows get numbers once, in the written copy that every later step reads
    kept = written(ordered.withColumn("rid", F.monotonically_increasing_id()), "chat-rows")
    lean = kept.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), "rid", "role").repartitionByRange("rid").sortWithinPartitions("rid")
    cut = written(lean.mapInPandas(_cut, "conv_id string, rid long, role int, seg long, pos int, matrix array<double>"), "chat-segments")
    matrices = cut.where("matrix is not null").select("conv_id", "seg", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    joints = written(matrices.mapInPandas(_joints, "of long, enter int, leave int, last boolean, cost double"), "chat-joints")
    jobs = cut.drop("matrix").join(joints, F.col("seg") == F.col("of")).drop("of").repartition("seg").sortWithinPartitions("seg", "pos")
    made = written(jobs.mapInPandas(_decoded, "seg long, k int, began int, role int, rid long, conv_id string, cost double"), "chat-made")
    began = made.groupBy("conv_id", "seg").agg(F.max("began").alias("n"))
    offset = began.select(F.col("seg").alias("at"), F.expr("coalesce(sum(n) over (partition by conv_id order by seg rows between unbounded preceding and 1 preceding), 0)").alias("offset"))
    placed = made.join(offset, F.col("seg") == F.col("at")).select("conv_id", (F.col("offset") + F.col("began") - 1).alias("out_turn"), "role", "rid", "cost", "seg", "k")
    texts = placed.join(kept.select(F.col("rid").alias("of"), "text"), F.col("rid") == F.col("of"), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("rid").isNotNull(), F.struct("seg", "k", F.coalesce("text", F.lit("")).alias("text")))))
    grouped = texts.groupBy("conv_id", "out_turn").agg(F.max("role").alias("role"), parts.alias("parts"), F.max("cost").alias("cost"))
    names = F.array(*(F.lit(r) for r in ROLES))
    return grouped.select(F.when(F.col("conv_id") != "", F.col("conv_id").cast("long")).alias("conv_id"), "out_turn", F.element_at(names, F.col("role")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.size("parts").cast("long").alias("n_source"), "cost")


def rendered(repaired: DataFrame) -> DataFrame:
    """Adds rendered: the turn between its role's mark and the end mark; a conversation is its turns in order.

    Texts stay as they are: a mark inside a text is not escaped, so clean texts first where readers trust marks.
    """
    return repaired.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))
