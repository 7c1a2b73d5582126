"""Size checks in front of broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows and bytes up to which a reference table is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 * 1024**2


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it has been measured to have at most max_rows rows and max_bytes bytes (as JSON).

    A larger df comes back unmarked, so a join with it shuffles (and adaptive execution
    splits skewed keys). At most max_rows + 1 rows are measured.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
