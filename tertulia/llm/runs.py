"""Runs of consecutive turns that are one event going on: boundaries by lookup, then one aggregation."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tertulia.llm.roles import INTERVIEWER, INTERVIEWER_LABELS, SUBJECT, SUBJECT_LABELS, folded, with_subject_types
from tertulia.operators.intervals import chunk_of

#: A chunk holds the turns of one interview whose pos agree but for these low bits: 4,096 at most.
POS_BITS = 12
MAX_PAUSE_MS = 2_000
#: Chunks of 16 neighbouring interviews are folded together: 65,536 turns at most.
BLOCK_BITS = 4


def spoken_turns(turns: DataFrame, interviews: DataFrame, bits: int = POS_BITS) -> DataFrame:
    """(interview_id, chunk, pos, start_ms, end_ms, who, split): the turns with text, re-deliveries once.

    who is the role, or the label itself if it is neither a role nor a subject type of the
    interview, or '' for null and blank. Of several deliveries that differ the least by
    (start_ms, end_ms, label) stays, nulls first. Rows without interview_id or pos stay out:
    they belong to no run. split: whether the interview has several chunks.
    """
    plain = folded("speaker")
    unnumbered = F.regexp_extract(plain, r"^(.*?)(?: \d+)?$", 1)
    label = F.when(unnumbered.isin(INTERVIEWER_LABELS), INTERVIEWER).when(unnumbered.isin(SUBJECT_LABELS), SUBJECT).otherwise(plain)
    once = (
        turns.where(F.regexp_like("text", F.lit(r"[^\s\x{a0}]")) & F.col("interview_id").isNotNull() & F.col("pos").isNotNull())
        .groupBy("interview_id", "pos")
        .agg(F.min(F.struct(F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"), label.alias("label"))).alias("_t"))
        .select(F.col("interview_id").cast("int"), chunk_of("pos", bits).alias("chunk"), F.col("pos").cast("bigint").alias("pos"), "_t.*")
    )
    typed = with_subject_types(once, interviews, "chunk")
    is_subject = F.coalesce(F.array_contains("types", F.col("label")), F.lit(False))
    return typed.select("interview_id", "chunk", "pos", "start_ms", "end_ms", F.when(is_subject, SUBJECT).otherwise(F.col("label")).alias("who"), "split")


def _fold(rows: list[tuple], k: int, pause: int, known: dict[int, tuple]) -> tuple:
    """(who, first, reach) at the end of rows if a run starts with row k; looked up from the first start in known."""
    pos, start, end, who = rows[k]
    first, reach, now = pos, end, who
    for j in range(k + 1, len(rows)):
        pos, start, end, who = rows[j]
        if who != now or (start is not None and reach is not None and start > reach + pause):
            if j in known:
                return known[j]
            first, reach, now = pos, end, who
        elif end is not None and (reach is None or end > reach):
            reach = end
    return now, first, reach


def _effect(rows: list[tuple], pause: int) -> tuple[list[int], list[tuple], int | None]:
    """What a chunk makes of a run that comes in, whatever its greatest end is: (limits, outs, reach).

    Up to the chunk's first change of speaker the run breaks at the first turn that starts
    beyond both its own reach and the chunk's ends before that turn. Only turns with a new
    greatest start can be first; their starts less the pause are limits, in rising order, so
    the break is found by binary search of the incoming reach. outs has the outgoing run for
    each limit, then for no break (first None: the incoming run goes on, its reach at least
    reach), for an incoming run without any end, and for a speaker other than the first turn's.
    """
    change = next((k for k, r in enumerate(rows) if r[3] != rows[0][3]), len(rows))
    limits, at, reach, unended = [], [], None, None
    for k, (_, start, end, _) in enumerate(rows[:change]):
        if start is not None and (reach is None or start - pause > reach):
            if not limits or start - pause > limits[-1]:
                limits.append(start - pause)
                at.append(k)
            if reach is not None and unended is None:
                unended = k
        if end is not None and (reach is None or end > reach):
            reach = end
    known: dict[int, tuple] = {}
    for k in sorted({change, *at, *([] if unended is None else [unended]), 0} - {len(rows)}, reverse=True):
        known[k] = _fold(rows, k, pause, known)
    unbroken = known.get(change, (rows[0][3], None, reach))
    return limits, [*(known[k] for k in at), unbroken, unbroken if unended is None else known[unended], known[0]], reach


_EFFECT = pa.schema(
    [("interview_id", pa.int32()), ("chunk", pa.int64()), ("who", pa.string()), ("limits", pa.list_(pa.int64())), ("reach", pa.int64())]
    + [("outs", pa.list_(pa.struct([("who", pa.string()), ("first", pa.int64()), ("reach", pa.int64())])))]
)
_EFFECT_DDL = "interview_id int, chunk bigint, who string, limits array<bigint>, reach bigint, outs array<struct<who:string,first:bigint,reach:bigint>>"
_STATE = pa.schema([("interview_id", pa.int32()), ("chunk", pa.int64()), ("in_who", pa.string()), ("in_first", pa.int64()), ("in_reach", pa.int64())])
_STATE_DDL = "interview_id int, chunk bigint, in_who string, in_first bigint, in_reach bigint"
_PART = pa.schema([("interview_id", pa.int32())] + [(n, pa.int64()) for n in ("first_pos", "last_pos", "n_turns", "start_ms", "end_ms")] + [("speaker", pa.string())])
_PART_DDL = "interview_id int, first_pos bigint, last_pos bigint, n_turns bigint, start_ms bigint, end_ms bigint, speaker string"


def _effects(pause: int):
    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("pos")
        rows = list(zip(*(chunk[c].to_pylist() for c in ("pos", "start_ms", "end_ms", "who"))))
        limits, outs, reach = _effect(rows, pause)
        row = {"interview_id": chunk["interview_id"][0].as_py(), "chunk": chunk["chunk"][0].as_py(), "who": rows[0][3], "limits": limits, "reach": reach, "outs": [dict(zip(("who", "first", "reach"), o)) for o in outs]}
        return pa.Table.from_pylist([row], schema=_EFFECT)

    return run


def _incoming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The run that comes into each chunk of an interview but the first. Input sorted by chunk."""
    at = who = first = reach = None
    for b in batches:
        found = []
        for r in b.to_pylist():
            if at is not None:
                if r["chunk"] < at:
                    raise RuntimeError(f"chunks of interview {r['interview_id']} out of order: {at}, then {r['chunk']}")
                found.append({"interview_id": r["interview_id"], "chunk": r["chunk"], "in_who": who, "in_first": first, "in_reach": reach})
            at, n = r["chunk"], len(r["limits"])
            out = r["outs"][n + 2 if who != r["who"] else n + 1 if reach is None else bisect_right(r["limits"], reach)]
            if out["first"] is None:
                reach = max((x for x in (reach, r["reach"]) if x is not None), default=None)
            else:
                who, first, reach = out["who"], out["first"], out["reach"]
        yield pa.RecordBatch.from_pylist(found, schema=_STATE)


def _run_starts(entity: np.ndarray, start: list, end: list, who: list, in_who: list, in_reach: list, pause: int) -> np.ndarray:
    """Numbers of the rows that begin a run, in rising order; rows sorted by interview and pos, each interview's first row with the run that comes in."""
    found, now, reach, same = [], None, None, None
    for k, (i, s, e, w) in enumerate(zip(entity.tolist(), start, end, who)):
        if i != same:
            same, now, reach = i, in_who[k], in_reach[k]
        if w != now or (s is not None and reach is not None and s > reach + pause):
            found.append(k)
            now, reach = w, e
        elif e is not None and (reach is None or e > reach):
            reach = e
    return np.array(found, np.int64)


def _parts(pause: int):
    """For each run the part of it in one chunk of neighbouring interviews."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("interview_id", "ascending"), ("pos", "ascending")])
        entity, pos = (block[c].to_numpy() for c in ("interview_id", "pos"))
        start, end, who, in_who, in_first, in_reach = (block[c].to_pylist() for c in ("start_ms", "end_ms", "who", "in_who", "in_first", "in_reach"))
        starts = _run_starts(entity, start, end, who, in_who, in_reach, pause)
        heads = np.flatnonzero(np.diff(entity, prepend=entity[0] - 1))  # a run that comes in has its part begin with the chunk
        bounds = np.union1d(starts, heads)
        of = np.searchsorted(bounds, np.arange(len(pos)), "right") - 1  # each turn's run by binary search
        counts = np.bincount(of, minlength=len(bounds))
        low = np.minimum.reduceat(np.array([2**62 if x is None else x for x in start], np.int64), bounds)
        high = np.maximum.reduceat(np.array([-(2**62) if x is None else x for x in end], np.int64), bounds)
        opened = np.isin(bounds, starts)
        column = {
            "interview_id": pa.array(entity[bounds], pa.int32()),
            "first_pos": pa.array([int(pos[k]) if o else in_first[k] for k, o in zip(bounds, opened)], pa.int64()),
            "last_pos": pa.array(pos[bounds + counts - 1], pa.int64()),
            "n_turns": pa.array(counts, pa.int64()),
            "start_ms": pa.array(low, pa.int64(), mask=low == 2**62),
            "end_ms": pa.array(high, pa.int64(), mask=high == -(2**62)),
            "speaker": pa.array([who[k] for k in bounds], pa.string()),
        }
        return pa.Table.from_arrays(list(column.values()), schema=_PART)

    return run


def event_runs(turns: DataFrame, interviews: DataFrame, min_turns: int = 1, max_pause_ms: int = MAX_PAUSE_MS, bits: int = POS_BITS) -> DataFrame:
    """(interview_id, first_pos, last_pos, n_turns, speaker, start_ms, end_ms, duration_ms): each run as one event.

    In order of pos, turns of one speaker form a run, however the speaker is written. A turn
    that starts more than max_pause_ms after the run's greatest end so far begins another; if
    its start or all those ends are null it goes on. Blank turns are left out beforehand,
    re-deliveries count once. start_ms and end_ms are the least start and the greatest end,
    null if all are; duration_ms is their difference, 0 where it would be negative, null if
    either is. An empty table gives no rows; other columns are ignored.

    Chunks of pos are folded apart. A chunk tells for any incoming reach which run goes out;
    those effects are applied in order (one small row a chunk, 2**19 for the longest interview
    that INT positions allow), and each chunk then gets the run that comes in. Each step is a
    grouping that the planner knows of, so a plan that changes while it runs keeps chunks whole;
    a chunk is sorted where it is folded.
    """
    spoken = spoken_turns(turns, interviews, bits)
    plain = ["interview_id", "chunk", "pos", "start_ms", "end_ms", "who"]
    effects = spoken.where("split").select(*plain).groupBy("interview_id", "chunk").applyInArrow(_effects(max_pause_ms), _EFFECT_DDL)
    states = effects.repartition("interview_id").sortWithinPartitions("interview_id", "chunk").groupBy("interview_id").applyInArrow(_incoming, _STATE_DDL)
    known = spoken.select(*plain).join(states, ["interview_id", "chunk"], "left").select(*plain, "in_who", "in_first", "in_reach")
    parts = known.groupBy(F.shiftright("interview_id", BLOCK_BITS).alias("block"), "chunk").applyInArrow(_parts(max_pause_ms), _PART_DDL)
    whole = parts.groupBy("interview_id", "first_pos").agg(
        F.max("last_pos").alias("last_pos"), F.sum("n_turns").alias("n_turns"), F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    duration = F.greatest(F.col("end_ms") - F.col("start_ms"), F.when(F.col("end_ms").isNotNull() & F.col("start_ms").isNotNull(), F.lit(0)))
    return whole.where(F.col("n_turns") >= min_turns).withColumn("duration_ms", duration)
