"""Window state over ordered rows of an entity without a window over the whole entity.

Rows are cut into chunks of their position (chunk_of); each function adds what the rows before
in other chunks contribute through with_carry(), so results equal those of a window
over the entity, and a hot entity is many small windows. order is a column, or several: then
the first, an integer, cuts the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.operators.intervals import CHUNK_KEY, chunk_of, keyed, with_carry

POS_BITS = 12


def _columns(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else order


def _place(order: str | list[str]) -> Column:
    """What rows are compared by."""
    return F.col(order) if isinstance(order, str) else F.struct(*order)


def chunked(df: DataFrame, entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS) -> DataFrame:
    return keyed(df.withColumn("__chunk", chunk_of(_columns(order)[0], bits)), [entity], "__chunk")


def _over(order: str | list[str]):
    return Window.partitionBy(CHUNK_KEY).orderBy(*_columns(order))


def _so_far(order: str | list[str]):
    return _over(order).rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, name: str = "pos", before: dict[str, Column] | None = None, counts: dict[str, Column] | None = None, entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS) -> DataFrame:
    """df with name the number of the row in its entity, from 0; with the values of the row before, and running counts of flags, the row itself included.

    All of it from one carry, so the rows shuffle once.
    """
    before, counts = before or {}, {"__n": F.lit(True), **(counts or {})}
    df = chunked(df, entity, order, bits).withColumns({f"__f{k}": c.cast("bigint") for k, c in enumerate(counts.values())})
    row = F.struct(*(c.alias(n) for n, c in before.items())) if before else F.lit(None)
    summary = {f"s{k}": F.sum(f"__f{k}") for k in range(len(counts))} | {"last_row": F.max_by(row, _place(order))}
    carried = with_carry(df, [entity], "__chunk", summary, {f"__o{k}": F.sum(f"s{k}") for k in range(len(counts))} | {"__last": F.last("last_row")})
    first = F.row_number().over(_over(order)) == 1
    total = [F.coalesce(f"__o{k}", F.lit(0)) + F.sum(f"__f{k}").over(_so_far(order)) for k in range(len(counts))]
    out = carried.withColumns({f"__t{k}": c for k, c in enumerate(total)} | ({"__before": F.when(first, F.col("__last")).otherwise(F.lag(row).over(_over(order)))} if before else {}))
    extra = {n: F.col(f"__t{k}") for k, n in enumerate(counts) if k} | {n: F.col(f"__before.{n}") for n in before} | {name: F.col("__t0") - 1}
    dropped = [f"__{x}{k}" for k in range(len(counts)) for x in "fot"] + ["__last", "__before", "__chunk", CHUNK_KEY]
    return out.withColumns(extra).drop(*dropped)


def renumbered(df: DataFrame, name: str = "pos", entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS) -> DataFrame:
    """df with name the number of the row in its entity, from 0."""
    return numbered(df, name, None, None, entity, order, bits)


def lagged(df: DataFrame, values: dict[str, Column], entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS) -> DataFrame:
    """df with a column for each value of the row before, null at an entity's first row, and is_first."""
    return numbered(df, "__no", values, None, entity, order, bits).withColumn("is_first", F.col("__no") == 0).drop("__no")


def counted(df: DataFrame, flag: Column, name: str, entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS) -> DataFrame:
    """df with the running count of rows where flag holds, the row itself included."""
    return numbered(df, "__no", None, {name: flag}, entity, order, bits).drop("__no")


def labelled(df: DataFrame, value: Column, name: str, entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS) -> DataFrame:
    """df with name the number, from 1, of the series of equal neighbouring values (null like null) that the row is in.

    A chunk hands on its first and last value and how many series begin within it, so one carry
    tells where a series crosses chunks.
    """
    df = chunked(df, entity, order, bits).withColumn("__value", F.struct(value.alias("v")))
    inner = F.coalesce((~F.col("__value").eqNullSafe(F.lag("__value").over(_over(order)))) & (F.row_number().over(_over(order)) > 1), F.lit(False))
    opened = df.withColumn("__opens", inner.cast("bigint"))
    place = _place(order)
    along = Window.partitionBy(F.col(f"{CHUNK_KEY}.{entity}")).orderBy(F.col(f"{CHUNK_KEY}.__chunk"))
    chunks = opened.groupBy(CHUNK_KEY).agg(F.min_by("__value", place).alias("a"), F.max_by("__value", place).alias("z"), F.sum("__opens").alias("n"))
    head = (~F.col("a").eqNullSafe(F.lag("z").over(along))).cast("bigint")
    offset = chunks.withColumn("head", head).withColumn("__offset", F.coalesce(F.sum(F.col("head") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("head"))
    both = opened.join(offset.select(CHUNK_KEY, "__offset"), CHUNK_KEY, "left")
    return both.withColumn(name, F.col("__offset") + F.sum("__opens").over(_so_far(order))).drop("__value", "__opens", "__offset", "__chunk", CHUNK_KEY)


def running(df: DataFrame, value: Column, name: str, how, entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS, itself: bool = True) -> DataFrame:
    """df with how (F.max, F.min or F.sum) of value over the rows so far, the row itself included or not."""
    df = chunked(df, entity, order, bits).withColumn("__value", value)
    carried = with_carry(df, [entity], "__chunk", {"so_far": how("__value")}, {"__carry": how("so_far")})
    own = how("__value").over(_over(order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1))
    both = F.coalesce(F.col("__carry") + own, "__carry", own) if how is F.sum else (F.greatest if how is F.max else F.least)("__carry", own)
    return carried.withColumn(name, both).drop("__value", "__carry", "__chunk", CHUNK_KEY)


def filled(df: DataFrame, value: str, name: str, entity: str = "interview_id", order: str | list[str] = "pos", bits: int = POS_BITS) -> DataFrame:
    """df with the last non-null value so far."""
    df = chunked(df, entity, order, bits)
    kept = F.max_by(value, F.when(F.col(value).isNotNull(), _place(order)))
    carried = with_carry(df, [entity], "__chunk", {"last_value": kept}, {"__carry": F.last("last_value", True)})
    own = F.last(value, True).over(_so_far(order))
    return carried.withColumn(name, F.coalesce(own, "__carry")).drop("__carry", "__chunk", CHUNK_KEY)


def with_neighbours(df: DataFrame, value: str, reach: int, name: str, entity: str = "interview_id", order: str = "pos", bits: int = POS_BITS) -> DataFrame:
    """df with an array of the values up to reach rows before and behind; positions must be dense.

    A chunk's edge rows are also sent to the chunk beside it, so no window crosses chunks.
    """
    low = F.col(order).bitwiseAND(F.lit((1 << bits) - 1))
    there = F.array_compact(F.array(F.lit(0), F.when(low < reach, F.lit(-1)), F.when(low >= (1 << bits) - reach, F.lit(1))))
    sent = keyed(df.withColumn("_to", F.explode(there)).withColumn("__chunk", chunk_of(order, bits) + F.col("_to")), [entity], "__chunk")
    near = F.collect_list(F.col(value))
    before = near.over(_over(order).rowsBetween(-reach, -1))
    behind = near.over(_over(order).rowsBetween(1, reach))
    return sent.withColumn(name, F.concat(before, behind)).where("_to = 0").drop("_to", "__chunk", CHUNK_KEY)
