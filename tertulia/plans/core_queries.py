"""Queries of the core package's own operators over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tertulia.operators.intervals import periods_and_gaps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "turns"))


P5_SQL = """
WITH v AS (SELECT interview_id, start_ms, end_ms FROM turns WHERE end_ms > start_ms),
r AS (SELECT *, max(end_ms) OVER (PARTITION BY interview_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
l AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY interview_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS label FROM r),
p AS (SELECT interview_id, label, min(start_ms) AS s, max(end_ms) AS e FROM l GROUP BY 1, 2),
g AS (SELECT interview_id, lag(e) OVER (PARTITION BY interview_id ORDER BY label) AS s, s AS e FROM p)
SELECT interview_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL SELECT interview_id, 'gap' AS kind, s AS start_ms, e AS end_ms FROM g WHERE e - s <= 1800000
"""

QUERIES = {"p5_found": p5_found}
ORACLES = {"p5_found": P5_SQL}
