"""Queries of the subpackage's operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tertulia.llm import mixing, mojibake, pii, roles, runs, tokens, transcripts, vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.mapped_fields(table(spark, sf_dir, "interviews"), table(spark, sf_dir, "glossary_changes"), table(spark, sf_dir, "glossary_terms"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("field", "interview_id", "item", "term_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that stand for no entry, and how often each field has them."""
    return _mapped(spark, sf_dir).where("term_id = -1").groupBy("value", "field").count().withColumnRenamed("count", "n")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry within the allowed edits of each distinct value."""
    typed = vocabulary.typed_values(table(spark, sf_dir, "interviews"), table(spark, sf_dir, "glossary_changes"))
    return vocabulary.all_matches(typed, table(spark, sf_dir, "glossary_terms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.event_runs(table(spark, sf_dir, "turns"), table(spark, sf_dir, "interviews"), min_turns=2)
    return found.selectExpr("interview_id", "cast(first_pos as int) first_pos", "cast(last_pos as int) last_pos")


def p2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.event_runs(table(spark, sf_dir, "turns"), table(spark, sf_dir, "interviews"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_kinds(table(spark, sf_dir, "turns"), ["interview_id", "pos"])


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered turn with personal data replaced."""
    return pii.redacted(table(spark, sf_dir, "turns"), ["interview_id", "pos"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and speaker of every clean turn; its text, without repeated captions, is made as well."""
    return p4_turns(spark, sf_dir).select("interview_id", "start_ms", "speaker").distinct()


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.clean_turns(table(spark, sf_dir, "import_turns"), table(spark, sf_dir, "interviews"))


def p4_paused_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn starts where turns also end at pauses beyond the calibrated one."""
    rows, interviews = table(spark, sf_dir, "import_turns"), table(spark, sf_dir, "interviews")
    return transcripts.turn_starts(rows, interviews, transcripts.calibrated_pause(rows, interviews).first().pause_ms)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_turns": p3_turns, "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p1_matches": p1_matches, "p8_found": p8_found, "p8_restored": p8_restored, "p4_found": p4_found, "p4_turns": p4_turns, "p4_paused_turns": p4_paused_turns, "p2_found": p2_found, "p2_events": p2_events, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares}
_ACCENTED, _PLAIN = roles.ACCENTED, roles.PLAIN
_LIST = lambda labels: ", ".join(f"'{x}'" for x in labels)
#: Each turn of the interviews one after the other: a recursive query with one step for each row.
_RUNS_SQL = rf"""WITH RECURSIVE f AS (SELECT interview_id, pos, start_ms, end_ms, trim(regexp_replace(translate(lower(coalesce(speaker, '')), '{_ACCENTED}', '{_PLAIN}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS plain FROM turns WHERE regexp_matches(text, '[^\s\x{{a0}}]')),
l AS (SELECT *, CASE WHEN regexp_replace(plain, ' \d+$', '') IN ({_LIST(roles.INTERVIEWER_LABELS)}) THEN 'interviewer' WHEN regexp_replace(plain, ' \d+$', '') IN ({_LIST(roles.SUBJECT_LABELS)}) THEN 'subject' ELSE plain END AS label FROM f),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interview_id, pos ORDER BY start_ms NULLS FIRST, end_ms NULLS FIRST, label) AS nth FROM l) WHERE nth = 1),
s AS (SELECT DISTINCT id, trim(regexp_replace(translate(lower(interview_subject_type), '{_ACCENTED}', '{_PLAIN}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS type FROM interviews),
n AS (SELECT o.interview_id, pos, start_ms, end_ms, CASE WHEN s.id IS NOT NULL THEN 'subject' ELSE label END AS who, row_number() OVER (PARTITION BY o.interview_id ORDER BY pos) AS k FROM o LEFT JOIN s ON s.id = o.interview_id AND s.type = o.label AND s.type <> ''),
r AS (SELECT interview_id, k, pos, who, start_ms, end_ms, end_ms AS reach, pos AS first_pos FROM n WHERE k = 1
UNION ALL SELECT n.interview_id, n.k, n.pos, n.who, n.start_ms, n.end_ms,
CASE WHEN n.who <> r.who OR coalesce(n.start_ms > r.reach + {runs.MAX_PAUSE_MS}, false) THEN n.end_ms ELSE greatest(r.reach, n.end_ms) END,
CASE WHEN n.who <> r.who OR coalesce(n.start_ms > r.reach + {runs.MAX_PAUSE_MS}, false) THEN n.pos ELSE r.first_pos END FROM r JOIN n ON n.interview_id = r.interview_id AND n.k = r.k + 1)"""
ORACLES: dict[str, str] = {
    "p2_found": _RUNS_SQL + " SELECT interview_id, first_pos, max(pos) AS last_pos FROM r GROUP BY 1, 2 HAVING count(*) >= 2",
    "p2_events": _RUNS_SQL + """ SELECT interview_id, first_pos, max(pos) AS last_pos, count(*) AS n_turns, min(who) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
CASE WHEN min(start_ms) IS NOT NULL AND max(end_ms) IS NOT NULL THEN greatest(max(end_ms) - min(start_ms), 0) END AS duration_ms FROM r GROUP BY 1, 2""",
}
