"""Interval algebra per entity: continuous periods, gaps, and carried window state.

A hot entity may own a third of all rows, so no window here is partitioned by the entity
alone. Rows are cut into chunks of a sort key (``key >> CHUNK_BITS``); a chunk's window runs
over at most ``2 ** CHUNK_BITS`` distinct keys, and what one chunk hands to the next is one
summary row, so the per-entity window sees only a row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: 2**20 ms are about 17 minutes: a chunk has at most that many distinct start times, an entity
#: whose times span a year has about 30,000 chunks.
CHUNK_BITS = 20
CHUNK_KEY = "__k"


def chunk_of(key: str | Column, bits: int = CHUNK_BITS) -> Column:
    """The chunk of an integer sort key; order of chunks is the order of keys."""
    return F.shiftright((F.col(key) if isinstance(key, str) else key).cast("bigint"), bits)


def keyed(df: DataFrame, entity: list[str], chunk: str) -> DataFrame:
    """df with CHUNK_KEY, one key for entity and chunk: never null itself, and equal where both parts are, null or not.

    Joins and windows by it share one partitioning, so rows shuffle once for all of them.
    """
    return df if CHUNK_KEY in df.columns else df.withColumn(CHUNK_KEY, F.struct(*entity, chunk))


def with_carry(df: DataFrame, entity: list[str], chunk: str, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """df with CHUNK_KEY and columns that summarise all earlier chunks of its entity.

    summary: per-chunk aggregates. carry: the carried columns, as expressions over the summary
    columns to be evaluated over the entity's earlier chunks. An entity that is null is an
    entity of its own.
    """
    df = keyed(df, entity, chunk)
    over = Window.partitionBy(*(F.col(f"{CHUNK_KEY}.{k}") for k in entity)).orderBy(F.col(f"{CHUNK_KEY}.{chunk}")).rowsBetween(Window.unboundedPreceding, -1)
    each = df.groupBy(CHUNK_KEY).agg(*(c.alias(n) for n, c in summary.items()))
    return df.join(each.select(CHUNK_KEY, *(c.over(over).alias(n) for n, c in carry.items())), CHUNK_KEY, "left")


def islands(intervals: DataFrame, entity: str = "interview_id", start: str = "start_ms", end: str = "end_ms", bits: int = CHUNK_BITS) -> DataFrame:
    """(entity, start, end, gap_from): each continuous period, and where the gap before it began.

    Intervals count if both ends are not null and end > start; touching intervals belong to one
    period. gap_from is null for an entity's first period. Repeated rows and ties of start
    collapse beforehand into the longest interval (combined before the shuffle), a null entity
    is an entity of its own, an empty table gives no rows, other columns are ignored.
    """
    flat = (
        intervals.select(F.col(entity).alias("_e"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_t"))
        .where(F.col("_s").isNotNull() & (F.col("_t") > F.col("_s")))
        .groupBy("_e", "_s")
        .agg(F.max("_t").alias("_t"))
        .withColumn("_chunk", chunk_of("_s", bits))
    )
    before = Window.partitionBy(CHUNK_KEY).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(CHUNK_KEY).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    carried = with_carry(flat, ["_e"], "_chunk", {"most": F.max("_t")}, {"_carry": F.max("most")})
    reach = F.greatest("_carry", F.max("_t").over(before))  # null only for the entity's first interval
    opened = carried.withColumn("_reach", reach).withColumn("_opens", F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")))
    counted = with_carry(opened, ["_e"], "_chunk", {"n": F.sum(F.col("_opens").cast("bigint"))}, {"_offset": F.sum("n")})
    label = F.coalesce("_offset", F.lit(0)) + F.sum(F.col("_opens").cast("bigint")).over(upto)
    return (
        counted.withColumn("_label", label)
        .groupBy("_e", "_label")
        .agg(F.min("_s").alias(start), F.max("_t").alias(end), F.min(F.when(F.col("_opens"), F.col("_reach"))).alias("gap_from"))
        .select(F.col("_e").alias(entity), start, end, "gap_from")
    )


def periods_and_gaps(intervals: DataFrame, entity: str = "interview_id", start: str = "start_ms", end: str = "end_ms", max_gap: int | None = 1_800_000, bits: int = CHUNK_BITS) -> DataFrame:
    """(entity, kind, start, end): kind 'period' for each island, 'gap' between successive ones.

    Gaps longer than max_gap are left out (None: all stay). Nulls, reversed and empty
    intervals, ties and repeats as in islands().
    """
    found = islands(intervals, entity, start, end, bits)
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias(start), F.col(b).alias(end))
    is_gap = F.col("gap_from").isNotNull()
    if max_gap is not None:
        is_gap = is_gap & (F.col(start) - F.col("gap_from") <= max_gap)
    both = F.array(row("period", start, end), F.when(is_gap, row("gap", "gap_from", start)))
    return found.select(entity, F.explode(F.array_compact(both)).alias("_row")).select(entity, "_row.*")
