"""Canonical inputs of the queries over the supplied tables, each as a DataFrame and as SQL.

Segments and acoustic turns are derived from the delivered turns: the tables have no recogniser's
output, so known faults (phrases, dense copies, loops, missing punctuation, a stray third
voice) are planted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tertulia.functions.text import trim
from tertulia.operators.catalog import current_interviews
from tertulia.operators.ordered import numbered

LOOP = "Entonces seguimos con el formulario de ingreso."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_interviews(table(spark, sf_dir, "interviews").drop("keywords").distinct())


def interviews_with_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_interviews(table(spark, sf_dir, "interviews"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "interview_jobs").distinct()


def role(speaker: Column) -> Column:
    key = F.lower(F.trim(speaker))
    return F.when(key.isin("interviewer", "subject"), key)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivered turn once: of several deliveries the least row, nulls first."""
    least = F.min(F.struct("start_ms", "end_ms", "speaker", "text"))
    t = table(spark, sf_dir, "turns").groupBy("interview_id", "pos").agg(least.alias("_t")).select("interview_id", "pos", "_t.*")
    return t.withColumn("speaker", role(F.col("speaker"))).withColumn("text", F.coalesce(trim("text"), F.lit("")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = turns(spark, sf_dir).where("text <> '' and end_ms > start_ms").select("interview_id", F.col("pos").alias("_old"), F.floor(F.col("start_ms") / 10).alias("t0"), F.floor(F.col("end_ms") / 10).alias("t1"), "text")
    dense = numbered(valid, "pos", {"_before": F.col("text")}, order="_old")
    p = F.col("pos")
    bare = F.regexp_replace("text", "[.,?!¿]", "")
    text = (
        F.when(p % 17 == 3, "Gracias por ver el video").when(p % 29 == 7, "Subtítulos por la comunidad").when((p % 23 == 11) & F.col("_before").isNotNull(), F.col("_before"))
        .when((p % 40).between(20, 23), LOOP).when((p % 30).between(5, 14), bare).otherwise(F.col("text"))
    )
    t1 = F.when(p % 17 == 3, F.col("t0") + 200).when(p % 23 == 11, F.col("t0") + 12).otherwise(F.col("t1"))
    return dense.select("interview_id", p.cast("int").alias("pos"), "t0", t1.alias("t1"), text.alias("text"))


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("pos") % 37 == 5, 7).when(F.col("speaker") == "interviewer", 1).when(F.col("speaker") == "subject", 2).otherwise(3)
    t = turns(spark, sf_dir).where("end_ms > start_ms")
    return t.select("interview_id", (F.col("start_ms") + 400).alias("start_ms"), (F.col("end_ms") + 400).alias("end_ms"), who.alias("speaker_id")).distinct()


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as (interview_id, id, s, e) in ms."""
    return segments(spark, sf_dir).select("interview_id", F.col("pos").alias("id"), (F.col("t0") * 10).alias("s"), (F.col("t1") * 10).alias("e"))


_TRIM = "' ' || chr(9) || chr(13) || chr(10)"
INTERVIEWS_SQL = "i AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, status) AS rn FROM interviews) WHERE rn = 1)"
JOBS_SQL = "j AS (SELECT DISTINCT * FROM interview_jobs)"
TURNS_SQL = f"""t0 AS (SELECT *, row_number() OVER (PARTITION BY interview_id, pos ORDER BY start_ms NULLS FIRST, end_ms NULLS FIRST, speaker NULLS FIRST, text NULLS FIRST) AS nth FROM turns),
t AS (SELECT interview_id, pos, start_ms, end_ms, CASE WHEN lower(trim(speaker)) IN ('interviewer', 'subject') THEN lower(trim(speaker)) END AS speaker, coalesce(trim(text, {_TRIM}), '') AS text FROM t0 WHERE nth = 1)"""
SEGMENTS_SQL = f"""{TURNS_SQL},
s0 AS (SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY pos) - 1 AS pos, start_ms // 10 AS t0, end_ms // 10 AS t1, text FROM t WHERE text <> '' AND end_ms > start_ms),
s1 AS (SELECT *, lag(text) OVER (PARTITION BY interview_id ORDER BY pos) AS b FROM s0),
s AS (SELECT interview_id, pos, t0, CASE WHEN pos % 17 = 3 THEN t0 + 200 WHEN pos % 23 = 11 THEN t0 + 12 ELSE t1 END AS t1,
  CASE WHEN pos % 17 = 3 THEN 'Gracias por ver el video' WHEN pos % 29 = 7 THEN 'Subtítulos por la comunidad' WHEN pos % 23 = 11 AND b IS NOT NULL THEN b
  WHEN pos % 40 BETWEEN 20 AND 23 THEN '{LOOP}' WHEN pos % 30 BETWEEN 5 AND 14 THEN regexp_replace(text, '[.,?!¿]', '', 'g') ELSE text END AS text FROM s1)"""
VOICES_SQL = """d AS (SELECT DISTINCT interview_id, start_ms + 400 AS start_ms, end_ms + 400 AS end_ms,
  CASE WHEN pos % 37 = 5 THEN 7 WHEN speaker = 'interviewer' THEN 1 WHEN speaker = 'subject' THEN 2 ELSE 3 END AS speaker_id FROM t WHERE end_ms > start_ms)"""
