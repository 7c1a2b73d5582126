"""Queries on read models and on transforms that take a model's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tertulia.functions import formats
from tertulia.functions.text import words
from tertulia.operators import documents, transforms
from tertulia.plans import segment_sql, views
from tertulia.plans.views import INTERVIEWS_SQL, TURNS_SQL
from tertulia.operators.ordered import renumbered
from tertulia.operators.sizes import small_side
from tertulia.schema import DOCUMENT_JSON, WORDS
from tertulia.operators.speakers import projected_words
from tertulia.session import shared_folder
from tertulia.sources import files

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BLOCKS = f"""{TURNS_SQL}, p AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS o FROM t WHERE text <> '' WINDOW w AS (PARTITION BY interview_id ORDER BY pos)),
q AS (SELECT *, sum(o) OVER (PARTITION BY interview_id ORDER BY pos) AS block FROM p),
b AS (SELECT interview_id, CAST(block AS BIGINT) AS block, arg_min_null(start_ms, pos) AS start_ms, arg_max(end_ms, pos) FILTER (end_ms IS NOT NULL) AS end_ms, min(speaker) AS speaker, count(*) AS n_turns, string_agg(text, ' ' ORDER BY pos) AS text FROM q GROUP BY 1, 2)"""


@query("w3_merge_turns", f"WITH {_BLOCKS} SELECT * FROM b")
def w3(spark, d):
    return documents.merged(views.turns(spark, d))


@query("w4_render", f"""WITH {_BLOCKS}, {INTERVIEWS_SQL}, h AS (SELECT interview_id, bool_or(speaker IS NOT NULL) AS has FROM t GROUP BY 1),
l AS (SELECT b.interview_id, block, CASE WHEN b.speaker = 'interviewer' THEN 'Investigador: ' WHEN b.speaker = 'subject' THEN CASE WHEN coalesce(trim(i.interview_subject_type), '') = '' THEN 'Entrevistado' ELSE trim(i.interview_subject_type) END || ': ' ELSE '' END || text AS line FROM b LEFT JOIN i ON i.id = b.interview_id)
SELECT interview_id, string_agg(line, chr(10) ORDER BY block) || chr(10) AS text FROM l WHERE interview_id IN (SELECT interview_id FROM h WHERE has) GROUP BY 1
UNION ALL SELECT interview_id, string_agg(text, chr(10) ORDER BY pos) || chr(10) AS text FROM t WHERE interview_id IN (SELECT interview_id FROM h WHERE NOT has) GROUP BY 1""")  # fmt: skip
def w4(spark, d):
    return documents.rendered(views.turns(spark, d), views.interviews(spark, d))


@query("a10_flags", f"WITH {TURNS_SQL} SELECT interview_id, bool_or(speaker IS NOT NULL) AS has_speakers, bool_or(start_ms IS NOT NULL) AS has_timestamps FROM t GROUP BY 1")
def a10(spark, d):
    return documents.flags(views.turns(spark, d))


@query("p13_spoken", f"WITH {TURNS_SQL} SELECT interview_id, pos, text FROM t WHERE text <> ''")
def p13(spark, d):
    return documents.spoken(views.turns(spark, d)).select("interview_id", "pos", "text")


@query("p14_labels", f"""WITH {TURNS_SQL}, {INTERVIEWS_SQL} SELECT t.interview_id, t.pos, CASE WHEN speaker = 'interviewer' THEN 'Investigador' WHEN speaker = 'subject' THEN CASE WHEN coalesce(trim(interview_subject_type), '') = '' THEN 'Entrevistado' ELSE trim(interview_subject_type) END ELSE '' END AS label
FROM t LEFT JOIN i ON i.id = t.interview_id""")  # fmt: skip
def p14(spark, d):
    who = views.interviews(spark, d).select(F.col("id").alias("interview_id"), "interview_subject_type")
    return views.turns(spark, d).join(who, "interview_id", "left").select("interview_id", "pos", documents.label(F.col("speaker"), F.col("interview_subject_type")).alias("label"))


@query("p15_swap", f"WITH {TURNS_SQL} SELECT interview_id, pos, CASE speaker WHEN 'interviewer' THEN 'subject' WHEN 'subject' THEN 'interviewer' END AS speaker FROM t")
def p15(spark, d):
    return documents.swapped(views.turns(spark, d)).select("interview_id", "pos", "speaker")


@query("p16_disclaimer", f"WITH {TURNS_SQL}, h AS (SELECT interview_id, bool_or(speaker IS NOT NULL) AS has FROM t GROUP BY 1) SELECT interview_id, CASE WHEN interview_id % 5 = 0 THEN 'edited' WHEN has THEN 'diarization' ELSE 'none' END AS note FROM h")
def p16(spark, d):
    f = documents.flags(views.turns(spark, d))
    return f.select("interview_id", documents.disclaimer(F.when(F.col("has_speakers"), "diarization").otherwise("none"), F.col("interview_id") % 5 == 0).alias("note"))


@query("p17_changed", f"WITH {TURNS_SQL} SELECT DISTINCT interview_id FROM t WHERE speaker IS NOT NULL")
def p17(spark, d):
    t = views.turns(spark, d)
    return documents.changed(documents.swapped(t), t)


@query("pred6_to_ms", f"WITH {TURNS_SQL} SELECT interview_id, pos, CAST(round(1000 * (CASE WHEN pos % 3 = 0 THEN CAST(start_ms AS DOUBLE) / 2000 WHEN pos % 3 = 1 THEN -CAST(start_ms AS DOUBLE) / 2000 ELSE CAST(start_ms AS DOUBLE) / 1000 END)) AS BIGINT) AS ms FROM t")
def p6(spark, d):
    """Half of each start, before and after zero, so that every other one is to be rounded; and whole starts."""
    k = F.col("pos") % 3
    seconds = F.when(k == 0, F.col("start_ms") / 2000).when(k == 1, -F.col("start_ms") / 2000).otherwise(F.col("start_ms") / 1000)
    return views.turns(spark, d).withColumn("s", seconds).select("interview_id", "pos", documents.to_ms("s").alias("ms"))


def _edits(spark, d):
    """Edited blocks of every interview, with faults planted by position and length of the text."""
    t, size = views.turns(spark, d), F.char_length("text")
    who = F.when((F.col("pos") == 4) & (size % 5 == 0), "nadie").otherwise(F.coalesce("speaker", F.lit("")))
    said = F.when((F.col("pos") == 6) & (size % 7 == 0), F.concat("text", F.lit("x\x07"))).otherwise(F.col("text"))
    return t.select("interview_id", "pos", who.alias("speaker"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), said.alias("text"))


_EDITS = f"""{TURNS_SQL}, e AS (SELECT interview_id, pos, CASE WHEN pos = 4 AND length(text) % 5 = 0 THEN 'nadie' ELSE coalesce(speaker, '') END AS speaker, start_ms, end_ms, CASE WHEN pos = 6 AND length(text) % 7 = 0 THEN text || 'x' || chr(7) ELSE text END AS text FROM t),
f AS (SELECT *, CASE WHEN text = '' THEN NULL WHEN strlen(text) > {documents.EDIT_BYTES} THEN 'too_long' WHEN contains(text, chr(7)) THEN 'control_char' WHEN speaker = 'nadie' THEN 'unknown_speaker' WHEN start_ms < 0 OR end_ms < 0 OR start_ms > end_ms THEN 'bad_times' END AS fault FROM e),
g AS (SELECT interview_id, count(*) AS n, arg_min(pos, pos) FILTER (fault IS NOT NULL) AS pos, arg_min(fault, pos) FILTER (fault IS NOT NULL) AS fault, count(*) FILTER (text <> '') AS said FROM f GROUP BY 1),
x AS (SELECT interview_id, CASE WHEN n <= {documents.EDIT_BLOCKS} THEN pos END AS pos, CASE WHEN n > {documents.EDIT_BLOCKS} THEN 'too_many' WHEN fault IS NOT NULL THEN fault WHEN said = 0 THEN 'empty' END AS fault FROM g)"""
_GOOD = "text <> '' AND interview_id NOT IN (SELECT interview_id FROM x WHERE fault IS NOT NULL)"


@query("p5_edit_faults", f"WITH {_EDITS} SELECT interview_id, pos, fault FROM x WHERE fault IS NOT NULL")
def p5(spark, d):
    return documents.edit_faults(_edits(spark, d))


@query("p5_saved_edits", f"WITH {_EDITS} SELECT interview_id, pos, start_ms, end_ms, CASE WHEN speaker <> '' THEN speaker END AS speaker, text FROM e WHERE {_GOOD}")
def p5_saved(spark, d):
    return documents.saved_edits(_edits(spark, d))


@query("j7_overlay", f"WITH {_EDITS}, g2 AS (SELECT interview_id, pos, text FROM e WHERE {_GOOD}) SELECT interview_id, pos, text, 'edited' AS source FROM g2 UNION ALL SELECT interview_id, pos, text, 'pipeline' AS source FROM t WHERE interview_id NOT IN (SELECT interview_id FROM g2)")
def j7(spark, d):
    """The saved edits where an interview's may be saved, else what was delivered."""
    keep = ["interview_id", "pos", "text"]
    return documents.overlaid(documents.saved_edits(_edits(spark, d)).select(*keep), views.turns(spark, d).select(*keep))


@query("w7_effective_start", f"WITH {TURNS_SQL} SELECT interview_id, pos, last_value(start_ms IGNORE NULLS) OVER (PARTITION BY interview_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS start_eff FROM t")
def w7(spark, d):
    return documents.effective_starts(views.turns(spark, d)).select("interview_id", "pos", "start_eff")


@query("j5_active_block", """WITH b0 AS (SELECT interview_id, start_ms, row_number() OVER (PARTITION BY interview_id ORDER BY start_ms, pos) - 1 AS pos FROM (SELECT DISTINCT interview_id, pos, start_ms FROM turns) WHERE start_ms IS NOT NULL),
q AS (SELECT DISTINCT interview_id, end_ms AS time_ms FROM turns WHERE end_ms IS NOT NULL), g AS (SELECT interview_id, start_ms, min(pos) AS first_pos, max(pos) AS last_pos FROM b0 GROUP BY 1, 2)
SELECT q.interview_id, q.time_ms, g.first_pos, g.last_pos FROM q ASOF JOIN g ON q.interview_id = g.interview_id AND q.time_ms >= g.start_ms""")  # fmt: skip
def j5(spark, d):
    t = views.table(spark, d, "turns").select("interview_id", "pos", "start_ms").distinct().where("start_ms is not null")
    rising = renumbered(t.withColumnRenamed("pos", "_old"), "pos", order=["start_ms", "_old"], bits=20).drop("_old")
    times = views.table(spark, d, "turns").where("end_ms is not null").select("interview_id", F.col("end_ms").alias("time_ms")).distinct()
    return documents.active_blocks(rising, times)


@query("a11_match_count", f"""WITH {TURNS_SQL}, u AS (SELECT interview_id, text FROM t UNION ALL SELECT interview_id, text FROM documents WHERE source = 'resumen' AND interview_id IN (SELECT interview_id FROM t))
SELECT interview_id, CAST(sum(coalesce(len(regexp_extract_all(text, '(?i)programa')), 0)) AS BIGINT) AS n_matches FROM u GROUP BY 1""")  # fmt: skip
def a11(spark, d):
    """Over the turns of each interview and the summaries among the documents."""
    turns = views.turns(spark, d)
    summaries = views.table(spark, d, "documents").where("source = 'resumen'").select("interview_id", F.col("text").alias("summary"))
    return documents.match_counts(turns, "Programa", summaries=summaries.join(turns.select("interview_id").distinct(), "interview_id", "left_semi"))


@query("a12_markers", "SELECT interview_id, CAST(coalesce(sum(len(regexp_extract_all(text, '\\[[A-ZÁÉÍÓÚÑ]+(?:_[A-ZÁÉÍÓÚÑ0-9]+)*\\]'))), NULL) AS BIGINT) AS n_markers FROM (SELECT DISTINCT * FROM import_turns) GROUP BY 1")
def a12(spark, d):
    return documents.marker_counts(views.table(spark, d, "import_turns").distinct())


@query("x15_highlights", "SELECT interview_id, pos, array_to_string(regexp_extract_all(text, '\\[[A-ZÁÉÍÓÚÑ]+(?:_[A-ZÁÉÍÓÚÑ0-9]+)*\\]|(?i:sede)'), '|') AS marks FROM (SELECT DISTINCT interview_id, pos, text FROM import_turns)")
def x15(spark, d):
    return views.table(spark, d, "import_turns").select("interview_id", "pos", "text").distinct().select("interview_id", "pos", F.array_join(formats.highlights("text", "sede"), "|").alias("marks"))


def _paragraphs_sql(src: str, key: str) -> str:
    """pg (key, first_pos, start_ms, end_ms, n_lines, text) of src (key, k from 1, pos, start_ms, end_ms, text)."""
    shut = lambda n, t: f"({n} >= {documents.PARAGRAPH_MIN} AND right({t}, 1) IN ('.', '?', '!', ':')) OR {n} >= {documents.PARAGRAPH_MAX}"
    return f"""pw AS (SELECT {key}, k, pos, start_ms, end_ms, text, 1 AS n, 1 AS no FROM {src} WHERE k = 1
UNION ALL SELECT x.{key}, x.k, x.pos, x.start_ms, x.end_ms, x.text, CASE WHEN {shut("w.n", "w.text")} THEN 1 ELSE w.n + 1 END, CASE WHEN {shut("w.n", "w.text")} THEN w.no + 1 ELSE w.no END FROM pw w JOIN {src} x ON x.{key} = w.{key} AND x.k = w.k + 1),
pg AS (SELECT {key}, min(pos) AS first_pos, arg_min_null(start_ms, pos) AS start_ms, arg_max(end_ms, pos) FILTER (end_ms IS NOT NULL) AS end_ms, count(*) AS n_lines, string_agg(text, ' ' ORDER BY pos) AS text FROM pw GROUP BY {key}, no)"""


@query("f3_paragraphs", f"WITH RECURSIVE {TURNS_SQL}, y AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY pos) AS k FROM t WHERE text <> ''), {_paragraphs_sql('y', 'interview_id')} SELECT * FROM pg")
def f3(spark, d):
    return documents.paragraphs(views.turns(spark, d).withColumn("speaker", F.lit(None).cast("string")))


def _texts(spark, d):
    """Every document with text, under its doc_id."""
    return views.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("interview_id"), "text")


_TRIMMED = "' ' || chr(9) || chr(13) || chr(10)"
_LINES = f"""n0 AS (SELECT doc_id AS interview_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
n1 AS (SELECT interview_id, generate_subscripts(ls, 1) AS pos, trim(unnest(ls), {_TRIMMED}) AS line FROM n0), n AS MATERIALIZED (SELECT * FROM n1 WHERE line <> ''),
m AS MATERIALIZED (SELECT *, regexp_matches(line, '^[^:\\[\\]]{{1,40}}:\\s+.+$') AS l FROM n), h AS (SELECT interview_id, count(*) AS n_lines, count(*) FILTER (l) AS n_labelled, count(*) FILTER (l) * 2 >= count(*) AS has_speakers FROM m GROUP BY 1)"""


@query("a14_label_share", f"WITH {_LINES} SELECT * FROM h")
def a14(spark, d):
    return documents.label_share(_texts(spark, d))


@query("f5_legacy_blocks", f"""WITH {_LINES}, a AS (SELECT interview_id, pos, CASE WHEN l THEN regexp_extract(line, '^([^:\\[\\]]{{1,40}}):\\s+(.+)$', 1) END AS label, CASE WHEN l THEN regexp_extract(line, '^([^:\\[\\]]{{1,40}}):\\s+(.+)$', 2) ELSE line END AS said FROM m WHERE interview_id IN (SELECT interview_id FROM h WHERE has_speakers)),
b AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY interview_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS who FROM a), c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(who) OVER w IS DISTINCT FROM who THEN 1 ELSE 0 END AS o FROM b WINDOW w AS (PARTITION BY interview_id ORDER BY pos)),
g AS (SELECT *, sum(o) OVER (PARTITION BY interview_id ORDER BY pos) AS block FROM c) SELECT interview_id, CAST(block AS BIGINT) AS block, min(who) AS speaker, string_agg(said, ' ' ORDER BY pos) AS text FROM g GROUP BY 1, 2""")  # fmt: skip
def f5(spark, d):
    return documents.legacy_blocks(_texts(spark, d))


@query("f4_legacy_paragraphs", f"""WITH RECURSIVE {_LINES}, y AS MATERIALIZED (SELECT interview_id, CAST(row_number() OVER (PARTITION BY interview_id ORDER BY pos) - 1 AS BIGINT) AS pos, row_number() OVER (PARTITION BY interview_id ORDER BY pos) AS k, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms, line AS text FROM m WHERE interview_id IN (SELECT interview_id FROM h WHERE NOT has_speakers)),
{_paragraphs_sql('y', 'interview_id')} SELECT interview_id, first_pos, n_lines, text FROM pg""")  # fmt: skip
def f4(spark, d):
    return documents.legacy_paragraphs(_texts(spark, d))


_STORED = f"""{TURNS_SQL}, r AS (SELECT interview_id, pos, CASE WHEN speaker = 'interviewer' THEN 'Investigador: ' WHEN speaker = 'subject' AND pos % 7 = 3 THEN 'Entrevistado:' WHEN speaker = 'subject' THEN 'Entrevistado: ' ELSE '' END || text AS line, speaker, text FROM t)"""


@query("x22_stored_texts", f"""WITH {_STORED}, v AS (SELECT *, sum(CASE WHEN speaker IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY interview_id) * 2 >= sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY interview_id) AS has FROM r WHERE line <> ''),
w AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY interview_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS who FROM v WHERE has), o AS (SELECT *, CASE WHEN row_number() OVER a = 1 OR lag(who) OVER a IS DISTINCT FROM who THEN 1 ELSE 0 END AS o FROM w WINDOW a AS (PARTITION BY interview_id ORDER BY pos)),
g AS (SELECT *, sum(o) OVER (PARTITION BY interview_id ORDER BY pos) AS block FROM o)
SELECT interview_id, CAST(block AS BIGINT) AS block, min(who) AS speaker, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (text <> ''), '') AS text, CASE WHEN interview_id % 3 = 0 THEN '[AVISO] sin anonimizar' || chr(10) || 'Investigador: no es un turno' END AS notice FROM g GROUP BY 1, 2""")  # fmt: skip
def x22(spark, d):
    """Every interview stored as a plain text with known labels, a third of them behind a notice of two lines, and read again."""
    head = F.when(F.col("speaker") == "interviewer", "Investigador: ").when((F.col("speaker") == "subject") & (F.col("pos") % 7 == 3), "Entrevistado:").when(F.col("speaker") == "subject", "Entrevistado: ").otherwise("")
    lines = views.turns(spark, d).select("interview_id", "pos", F.concat(head, "text").alias("line"))
    stored = lines.groupBy("interview_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    notice = F.when(F.col("interview_id") % 3 == 0, "[AVISO] sin anonimizar\nInvestigador: no es un turno\n\n").otherwise("")
    parted = documents.without_notice(stored.withColumn("text", F.concat(notice, "text")))
    return documents.legacy_blocks(parted, documents.LEGACY_ROLES).join(parted.select("interview_id", "notice"), "interview_id")


@query("x21_documents", f"""WITH {_BLOCKS}, {INTERVIEWS_SQL}, z AS (SELECT interview_id, bool_or(speaker IS NOT NULL) AS s, bool_or(start_ms IS NOT NULL) AS st, count(*) AS n, string_agg(text, '|' ORDER BY block) AS texts, string_agg(coalesce(CAST(start_ms // 1000 AS VARCHAR), '-'), '|' ORDER BY block) AS starts FROM b GROUP BY 1)
SELECT interview_id, coalesce(s, false) AS has_speakers, coalesce(st, false) AS has_timestamps, 'diarization' AS source, interview_id % 5 = 0 AS edited, CASE WHEN coalesce(trim(i.interview_subject_type), '') = '' THEN 'Entrevistado' ELSE trim(i.interview_subject_type) END AS subject_label, n AS n_blocks, texts, starts FROM z JOIN i ON i.id = interview_id""")  # fmt: skip
def x21(spark, d):
    """The JSON of every interview's merged turns, read again field by field."""
    blocks = documents.merged(views.turns(spark, d)).withColumn("pos", F.col("block"))
    headers = blocks.select("interview_id").distinct().select("interview_id", F.lit("diarization").alias("speaker_source"), (F.col("interview_id") % 5 == 0).alias("edited"), F.lit(None).cast("string").alias("notice"), F.lit(None).cast("string").alias("summary"))
    made = documents.serialized(blocks, headers, views.interviews(spark, d))
    read = made.select("interview_id", F.from_json("value", DOCUMENT_JSON).alias("d"))
    start = F.transform("d.blocks", lambda b: F.coalesce(F.floor(b["start"]).cast("string"), F.lit("-")))
    return read.select(
        "interview_id", "d.has_speakers", "d.has_timestamps", F.col("d.speaker_source").alias("source"), "d.edited", F.col("d.speakers")[1]["label"].alias("subject_label"), F.size("d.blocks").cast("bigint").alias("n_blocks"), F.array_join("d.blocks.text", "|").alias("texts"), F.array_join(start, "|").alias("starts")
    )


@query("x13_paragraphs", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279) || chr(8232) || chr(8233))), lambda p: p <> ''), '¶') AS parts FROM documents WHERE text IS NOT NULL""")
def x13(spark, d):
    return views.table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(formats.paragraphs("text"), "¶").alias("parts"))


@query("f12_edits", f"""WITH {_BLOCKS}, y AS (SELECT interview_id, block - 1 AS pos, start_ms, end_ms, speaker, text, count(*) OVER (PARTITION BY interview_id) > {documents.EDIT_BLOCKS} AS long, trim(substr(text, 1, 10)) AS p1, trim(substr(text, 11)) AS p2 FROM b),
s1 AS (SELECT *, pos = 0 AND p1 <> '' AND p2 <> '' AND NOT long AS cut FROM y),
s2 AS (SELECT interview_id, long, pos, 0 AS part, start_ms, CASE WHEN cut THEN NULL ELSE end_ms END AS end_ms, speaker, CASE WHEN cut THEN p1 ELSE text END AS text FROM s1 UNION ALL SELECT interview_id, long, pos, 1 AS part, NULL AS start_ms, end_ms, speaker, p2 AS text FROM s1 WHERE cut),
s3 AS (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY pos, part) - 1 AS q FROM s2),
s4 AS (SELECT a.interview_id, a.long, a.q, a.start_ms, CASE WHEN a.q = 2 AND z.q IS NOT NULL THEN coalesce(z.end_ms, a.end_ms) ELSE a.end_ms END AS end_ms, a.speaker, CASE WHEN a.q = 2 AND z.q IS NOT NULL THEN trim(trim(a.text) || ' ' || trim(z.text)) ELSE a.text END AS text
FROM s3 a LEFT JOIN s3 z ON z.interview_id = a.interview_id AND a.q = 2 AND z.q = 3 AND NOT a.long WHERE a.long OR a.q <> 3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY q) - 1 AS r FROM s4)
SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY r) - 1 AS pos, start_ms, end_ms, speaker, text FROM s5 WHERE long OR r <> 4""")  # fmt: skip
def f12(spark, d):
    """Every interview's merged blocks with the first one split, the third merged and the last removed."""
    blocks = documents.merged(views.turns(spark, d)).withColumn("pos", F.col("block") - 1)
    rows = F.array(*(F.struct(F.lit(s).alias("seq"), F.lit(o).alias("op"), F.lit(p).alias("pos"), F.lit(a).alias("at")) for s, o, p, a in ((1, "split", 0, 10), (2, "merge", 3, 0), (3, "remove", 4, 0))))
    log = blocks.select("interview_id").distinct().select("interview_id", F.explode(rows).alias("e")).select("interview_id", "e.*")
    return documents.edited_blocks(blocks, log)


@query("s4_s5_transcript_json", f"WITH {TURNS_SQL} SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY pos) - 1 AS pos, start_ms, end_ms, speaker, text FROM t")
def s4(spark, d):
    t = views.turns(spark, d)
    headers = t.select("interview_id").distinct().withColumn("speaker_source", F.lit("manual")).withColumn("notice", F.lit(None).cast("string"))
    return files.parsed_transcripts(files.transcript_rows(t, headers))[0]


@query("s9_download", "SELECT doc_id, chr(65279) || text AS text FROM documents WHERE text IS NOT NULL")
def s9(spark, d):
    return views.table(spark, d, "documents").where("text is not null").select("doc_id", files.download("text").alias("text"))


@query("s13_byte_ranges", """WITH h AS (SELECT doc_id, n_chars AS size, CASE doc_id % 5 WHEN 0 THEN 'bytes=0-' WHEN 1 THEN 'bytes=-500' WHEN 2 THEN 'bytes=100-199' WHEN 3 THEN 'bytes=-0' ELSE 'bytes=99999-' END AS header FROM documents WHERE n_chars > 0),
r AS (SELECT doc_id, size, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN greatest(size - 500, 0) WHEN 2 THEN 100 WHEN 3 THEN NULL ELSE 99999 END AS a, CASE doc_id % 5 WHEN 2 THEN least(199, size - 1) ELSE size - 1 END AS z FROM h)
SELECT doc_id, CASE WHEN a < size AND z >= a THEN a END AS first, CASE WHEN a < size AND z >= a THEN least(z, a + 2097151) END AS last FROM r""")  # fmt: skip
def s13(spark, d):
    k = F.col("doc_id") % 5
    header = F.when(k == 0, "bytes=0-").when(k == 1, "bytes=-500").when(k == 2, "bytes=100-199").when(k == 3, "bytes=-0").otherwise("bytes=99999-")
    sized = views.table(spark, d, "documents").where("n_chars > 0").select("doc_id", files.range_of(header, F.col("n_chars")).alias("r"))
    return sized.select("doc_id", "r.first", "r.last")


@query("x16_x17_x18_small_forms", f"""WITH {TURNS_SQL}, w AS (SELECT *, list_filter(string_split_regex({segment_sql.low("text")}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS ws FROM t)
SELECT interview_id, pos, floor(start_ms / 1000.0 * 2) / 2 AS half, printf('%.3f', CAST(pos % 16 AS DOUBLE) / 16) AS score, array_to_string(list_transform(ws[2:4], lambda x: {segment_sql.fold("x")}), ' ') AS words FROM w""")  # fmt: skip
def x16(spark, d):
    t = views.turns(spark, d)
    return t.select("interview_id", "pos", formats.half_seconds(F.col("start_ms") / 1000).alias("half"), formats.score_text(F.col("pos") % 16 / 16).alias("score"), formats.joined(words("text"), 1, 4).alias("words"))


@query("s8_change_report", """WITH g AS (SELECT interview_id, line, min(original) AS original, min(term) AS term FROM glossary_changes WHERE original IS NOT NULL AND term IS NOT NULL GROUP BY 1, 2)
SELECT interview_id, string_agg('linea ' || line || ': ' || original || ' -> ' || term, chr(10) ORDER BY line) AS text FROM g GROUP BY 1""")  # fmt: skip
def s8(spark, d):
    """The report of all changes, written as text files and read again."""
    g = views.table(spark, d, "glossary_changes").where("original is not null and term is not null").groupBy("interview_id", "line").agg(F.min("original").alias("original"), F.min("term").alias("term"))
    folder = shared_folder(spark, "reports")
    files.write_texts(transforms.change_report(g), folder)
    return spark.read.text(folder, wholetext=True).select("interview_id", F.rtrim(F.col("value"), F.lit("\n")).alias("text"))


@query("s6_s7_segments_json", f"WITH {TURNS_SQL} SELECT interview_id, pos, start_ms, end_ms, text, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n_words FROM t")
def s6(spark, d):
    """All turns with their words, written as JSON and read again."""
    folder = shared_folder(spark, "segments")
    placed = files.gathered(views.turns(spark, d).select("interview_id", "pos", "start_ms", "end_ms", "text"))
    files.write_segments(projected_words(placed), folder, **{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"})
    read = spark.read.schema(f"interview_id int, pos int, start_ms bigint, end_ms bigint, text string, words {WORDS}").json(folder)
    return read.select("interview_id", "pos", "start_ms", "end_ms", "text", F.size("words").cast("bigint").alias("n_words"))


@query("s10_s11_wav", """WITH p AS (SELECT DISTINCT interview_id, pos FROM turns), v AS (SELECT interview_id, (pos % 200 - 100) / 128.0 AS x FROM p)
SELECT interview_id, count(*) AS n_samples, count(*) / 16000.0 AS duration_s, min(x) AS low, max(x) AS high, sum(x) AS total FROM v GROUP BY 1""")  # fmt: skip
def s10(spark, d):
    """A sound for each interview, made into a WAV file and read again."""
    samples = views.table(spark, d, "turns").select("interview_id", "pos").distinct().groupBy("interview_id").agg(F.collect_list((F.col("pos") % 200 - 100) / 128).alias("x"))
    sounds = samples.select(F.col("interview_id").cast("string").alias("path"), files.wav_file("x").alias("content")).withColumn("length", F.length("content").cast("bigint"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.wav_samples(sounds).select(F.col("path").cast("int").alias("interview_id"), "n_samples", "duration_s", F.array_min("samples").cast("double").alias("low"), F.array_max("samples").cast("double").alias("high"), total.alias("total"))


@query("l1_answers", """WITH t AS (SELECT DISTINCT interview_id, line, term FROM glossary_changes WHERE term IS NOT NULL), a AS (SELECT term, min(alias) AS alias FROM glossary_terms GROUP BY 1)
SELECT interview_id, line, t.term AS text, alias AS answer FROM t LEFT JOIN a ON a.term = t.term""")  # fmt: skip
def l1(spark, d):
    prompts = views.table(spark, d, "glossary_changes").where("term is not null").select("interview_id", "line", F.col("term").alias("text")).distinct()
    responses = views.table(spark, d, "glossary_terms").groupBy("term").agg(F.min("alias").alias("answer")).select(F.col("term").alias("prompt"), "answer")
    return transforms.answered(prompts, responses)


@query("x20_envelope", f"""WITH {TURNS_SQL}, h AS (SELECT interview_id, bool_or(speaker IS NOT NULL) AS s, bool_or(start_ms IS NOT NULL) AS st FROM t GROUP BY 1)
SELECT interview_id, '{{{{"success":true,"data":{{{{"has_speakers":' || s || ',"has_timestamps":' || st || '}}}},"error":null}}}}' AS body FROM h""".replace("{{", "{").replace("}}", "}"))
def x20(spark, d):
    rows = documents.flags(views.turns(spark, d))
    return rows.select("interview_id", formats.envelope(F.struct("has_speakers", "has_timestamps")).alias("body"))


def _spaced(x: str) -> str:
    """x with a mark on both sides of everything that is no part of a word, so that whole words are what marks or the ends of the text enclose."""
    return f"regexp_replace({x}, '([^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])', chr(1) || '\\1' || chr(1), 'g')"


def _replaced(src: str, lists: str, out: str, whole: bool = True) -> str:
    """out (interview_id, pos, step, text, hit) of src (interview_id, pos, grp, text): one row for each step, replacements of lists (interview_id, grp, nth from 1, original, put) in turn."""
    word = f"'(^|' || chr(1) || ')' || regexp_escape({_spaced('l.original')}) || '(' || chr(1) || '|$)'"
    by = f"'\\1' || replace({_spaced('l.put')}, '\\', '\\\\') || '\\2'"
    new, hit = (f"regexp_replace(w.text, {word}, {by}, 'g')", f"regexp_matches(w.text, {word})") if whole else ("replace(w.text, l.original, l.put)", "contains(w.text, l.original)")
    return f"""{out} AS (SELECT interview_id, pos, grp, 0 AS step, {_spaced("text") if whole else "text"} AS text, false AS hit FROM {src}
UNION ALL SELECT w.interview_id, w.pos, w.grp, w.step + 1, {new}, {hit} FROM {out} w JOIN {lists} l ON l.interview_id = w.interview_id AND l.grp IS NOT DISTINCT FROM w.grp AND l.nth = w.step + 1)"""


# Transforms: proposals, answers and entities are taken from the glossary tables.


def _glossary(spark, d):
    """Each interview's terms: those of its glossary changes that are on the reference list."""
    g = views.table(spark, d, "glossary_changes").select("interview_id", "term", "line").where("term is not null").distinct()
    return g.select("interview_id", F.col("line").cast("int").alias("pos"), "term").dropDuplicates(["interview_id", "pos"])


def _noted(spark, d):
    """Turns as segments with the original of a glossary change set in where its line is, and the proposals."""
    g = views.table(spark, d, "glossary_changes").where("original is not null and term is not null").groupBy("interview_id", "line").agg(F.min("original").alias("original"), F.min("term").alias("term"))
    dense = renumbered(views.turns(spark, d).withColumnRenamed("pos", "_old"), "pos", order="_old").withColumn("pos", F.col("pos").cast("int"))
    noted = dense.join(g.select("interview_id", (F.col("line") - 1).cast("int").alias("pos"), "original"), ["interview_id", "pos"], "left")
    segments = noted.select("interview_id", "pos", F.when(F.col("original").isNotNull(), F.concat("text", F.lit(" ("), "original", F.lit(")."))).otherwise(F.col("text")).alias("text"))
    proposals = g.select("interview_id", F.floor((F.col("line") - 1) / transforms.GLOSSARY_BLOCK).cast("int").alias("block"), F.col("line").cast("int").alias("pos"), "original", "term")
    return segments, proposals


@query("j8_canonical_terms", """WITH g AS (SELECT interview_id, CAST(line AS INT) AS pos, min(term) AS term FROM glossary_changes WHERE term IS NOT NULL GROUP BY 1, 2)
SELECT interview_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, arg_min(term, pos) AS term FROM g GROUP BY 1, 2""")  # fmt: skip
def j8(spark, d):
    return transforms.canonical_terms(_glossary(spark, d))


_NOTED = f"""{TURNS_SQL}, g0 AS (SELECT interview_id, line, min(original) AS original, min(term) AS term FROM glossary_changes WHERE original IS NOT NULL AND term IS NOT NULL GROUP BY 1, 2),
z AS (SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY pos) - 1 AS pos, text FROM t),
sg AS MATERIALIZED (SELECT z.interview_id, pos, pos // {transforms.GLOSSARY_BLOCK} AS grp, CASE WHEN g0.original IS NOT NULL THEN text || ' (' || g0.original || ').' ELSE text END AS text FROM z LEFT JOIN g0 ON g0.interview_id = z.interview_id AND g0.line - 1 = z.pos),
gk AS (SELECT interview_id, CAST(line AS INT) AS pos, min(term) AS term FROM glossary_changes WHERE term IS NOT NULL GROUP BY 1, 2),
kn AS MATERIALIZED (SELECT interview_id, {segment_sql.low("term")} AS key, arg_min(term, pos) AS term FROM gk GROUP BY 1, 2),
pr AS (SELECT g0.interview_id, (line - 1) // {transforms.GLOSSARY_BLOCK} AS grp, line AS pos, trim(original, ' ' || chr(9) || chr(13) || chr(10)) AS original, kn.term FROM g0 JOIN kn ON kn.interview_id = g0.interview_id AND kn.key = {segment_sql.low("g0.term")}),
fi AS (SELECT *, {segment_sql.norm("original")} AS no, {segment_sql.norm("term")} AS nt FROM pr WHERE original <> '' AND strlen(original) <= {transforms.TERM_BYTES} AND original <> term),
fr AS (SELECT interview_id, grp, original, arg_min(term, pos) AS put FROM fi WHERE strlen(no) > 0 AND strlen(nt) > 0 AND 2 * levenshtein(no, nt) <= greatest(strlen(no), strlen(nt)) AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.interview_id = fi.interview_id AND kn.key = {segment_sql.low("fi.original")}) GROUP BY 1, 2, 3),
ac AS (SELECT * FROM fr l WHERE EXISTS (SELECT 1 FROM sg w WHERE w.interview_id = l.interview_id AND w.grp = l.grp AND regexp_matches({_spaced("w.text")}, '(^|' || chr(1) || ')' || regexp_escape({_spaced("l.original")}) || '(' || chr(1) || '|$)'))),
li AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY interview_id, grp ORDER BY strlen(original) DESC, original, put) AS nth FROM ac), {_replaced("sg", "li", "wk")}"""


@query("l2_glossary", f"WITH RECURSIVE {_NOTED} SELECT interview_id, pos, replace(arg_max(text, step), chr(1), '') AS text FROM wk GROUP BY 1, 2")
def l2(spark, d):
    segments, proposals = _noted(spark, d)
    return transforms.glossary_applied(segments, transforms.accepted_proposals(segments, _glossary(spark, d), proposals)).select("interview_id", "pos", "text")


@query("l3_change_log", f"WITH RECURSIVE {_NOTED} SELECT wk.interview_id, wk.pos + 1 AS line, original, put AS term FROM wk JOIN li ON li.interview_id = wk.interview_id AND li.grp = wk.grp AND li.nth = wk.step WHERE hit")
def l3(spark, d):
    segments, proposals = _noted(spark, d)
    return transforms.change_log(transforms.glossary_applied(segments, transforms.accepted_proposals(segments, _glossary(spark, d), proposals)))


def _dense(spark, d):
    t = documents.spoken(views.turns(spark, d)).withColumnRenamed("pos", "_old")
    return renumbered(t, "pos", order="_old").select("interview_id", F.col("pos").cast("int").alias("pos"), "text")


_DENSE = f"{TURNS_SQL}, z AS (SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY pos) - 1 AS pos, text FROM t WHERE text <> '')"


@query("w12_blocks", f"WITH {_DENSE} SELECT interview_id, pos, pos // 60 AS chunk, pos % 60 + 1 AS idx FROM z")
def w12(spark, d):
    return transforms.blocks_of(_dense(spark, d), transforms.CORRECTION_BLOCK).select("interview_id", "pos", "chunk", "idx")


@query("w13_continuity", f"WITH {_DENSE} SELECT interview_id, pos // 60 + 1 AS chunk, string_agg(text, chr(10) ORDER BY pos) AS context FROM z WHERE pos % 60 >= 57 GROUP BY 1, 2")
def w13(spark, d):
    return transforms.continuity(_dense(spark, d))


@query("j9_l4_corrected", f"""WITH {_DENSE}, c AS (SELECT *, CASE WHEN pos % 4 = 0 THEN trim(upper(text)) WHEN pos % 4 = 1 THEN 'no' END AS a FROM z)
SELECT interview_id, pos, coalesce(a IS NOT NULL AND CASE WHEN strlen(text) < 15 THEN strlen(a) < 40 ELSE strlen(a) * 10 >= strlen(text) * 6 AND strlen(a) * 10 <= strlen(text) * 16 END, false) AS corrected,
CASE WHEN a IS NOT NULL AND CASE WHEN strlen(text) < 15 THEN strlen(a) < 40 ELSE strlen(a) * 10 >= strlen(text) * 6 AND strlen(a) * 10 <= strlen(text) * 16 END THEN a ELSE text END AS text FROM c""")  # fmt: skip
def l4(spark, d):
    z = _dense(spark, d)
    placed = transforms.blocks_of(z, transforms.CORRECTION_BLOCK)
    answer = F.when(F.col("pos") % 4 == 0, F.upper("text")).when(F.col("pos") % 4 == 1, "no")
    line = F.concat(F.lit("["), "idx", F.lit("] (Investigador) "), answer)
    responses = placed.where("pos % 4 < 2").select("interview_id", "chunk", "pos", line.alias("line"))
    return transforms.corrected_turns(z, responses)


_CHUNKED = f"""{_DENSE}, ck AS MATERIALIZED (SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY pos) AS k, pos, text, strlen(text) + 1 AS size FROM z),
cw AS (SELECT interview_id, k, text, size AS used, 0 AS chunk FROM ck WHERE k = 1 UNION ALL SELECT c.interview_id, c.k, c.text, CASE WHEN w.used + c.size > {transforms.CHUNK_BYTES} THEN c.size ELSE w.used + c.size END, CASE WHEN w.used + c.size > {transforms.CHUNK_BYTES} THEN w.chunk + 1 ELSE w.chunk END FROM cw w JOIN ck c ON c.interview_id = w.interview_id AND c.k = w.k + 1),
ch AS MATERIALIZED (SELECT interview_id, chunk, string_agg(text, chr(10) ORDER BY k) AS text FROM cw GROUP BY 1, 2)"""


@query("f6_chunks", f"WITH RECURSIVE {_CHUNKED} SELECT * FROM ch")
def f6(spark, d):
    return transforms.text_chunks(_dense(spark, d))


def _entities(spark, d):
    """The reference list's terms that an interview's keywords name, as entities of their domain."""
    terms = views.table(spark, d, "glossary_terms").select("term", F.upper("domain").alias("type"))
    k = views.interviews_with_keywords(spark, d).select(F.col("id").alias("interview_id"), F.posexplode("keywords").alias("pos", "text")).where("trim(text) <> ''")
    return k.join(small_side(terms), k.text == terms.term).select("interview_id", F.floor(F.col("pos") / 3).cast("int").alias("chunk"), "pos", "text", "type")


_ENTITIES = f"""{INTERVIEWS_SQL}, k AS (SELECT id AS interview_id, generate_subscripts(keywords, 1) - 1 AS pos, unnest(keywords) AS text FROM i),
e AS (SELECT k.interview_id, pos, text, upper(g.domain) AS type FROM k JOIN glossary_terms g ON g.term = k.text WHERE trim(text) <> ''),
u AS (SELECT interview_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, arg_min(text, pos) AS original, arg_min(type, pos) AS type FROM e GROUP BY 1, 2),
ph AS (SELECT interview_id, original, type, '[' || type || '_' || row_number() OVER (PARTITION BY interview_id, type ORDER BY key) || ']' AS placeholder FROM u)"""


@query("m9_a13_placeholders", f"WITH {_ENTITIES} SELECT * FROM ph")
def m9(spark, d):
    return transforms.placeholders(_entities(spark, d))


_SUBS = f"""{_DENSE}, {_ENTITIES}, li AS MATERIALIZED (SELECT interview_id, 0 AS grp, original, placeholder AS put, row_number() OVER (PARTITION BY interview_id ORDER BY strlen(original) DESC, original, placeholder) AS nth FROM ph), sg AS (SELECT *, 0 AS grp FROM z)"""


@query("l5_anonymize", f"WITH RECURSIVE {_SUBS}, {_replaced('sg', 'li', 'wk', False)} SELECT interview_id, pos, arg_max(text, step) AS text FROM wk GROUP BY 1, 2")
def l5(spark, d):
    return transforms.anonymized(_dense(spark, d), _entities(spark, d))


@query("l5_anonymize_whole_words", f"WITH RECURSIVE {_SUBS}, {_replaced('sg', 'li', 'wk')} SELECT interview_id, pos, replace(arg_max(text, step), chr(1), '') AS text FROM wk GROUP BY 1, 2")
def l5w(spark, d):
    return transforms.anonymized(_dense(spark, d), _entities(spark, d), "whole_word")


@query("x12_entities", """WITH g AS (SELECT DISTINCT interview_id, line, coalesce(original, '') || '|' || coalesce(term, '') AS l FROM glossary_changes), s AS (SELECT interview_id, line, trim(split_part(l, '|', 1), ' ' || chr(9) || chr(13) || chr(10)) AS text, trim(split_part(l, '|', 2), ' ' || chr(9) || chr(13) || chr(10)) AS type FROM g)
SELECT interview_id, line, text, type FROM s WHERE text <> '' AND type <> ''""")  # fmt: skip
def x12(spark, d):
    g = views.table(spark, d, "glossary_changes").distinct()
    answer = F.concat(F.coalesce("original", F.lit("")), F.lit("|"), F.coalesce("term", F.lit("")))
    return g.select("interview_id", "line", formats.entity_line(answer).alias("e")).where("e is not null").select("interview_id", "line", "e.*").distinct()


_FIRST = lambda x: f"CASE WHEN regexp_matches({x}, '[.?!]') THEN regexp_extract({x}, '^[^.?!]*[.?!]') ELSE {x} END"


@query("l6_summary", f"""WITH RECURSIVE {_CHUNKED}, an AS (SELECT interview_id, chunk, {_FIRST("text")} AS answer FROM ch), jo AS (SELECT interview_id, count(*) AS n, string_agg(answer, chr(10) ORDER BY chunk) AS text FROM an GROUP BY 1)
SELECT interview_id, CASE WHEN n = 1 THEN text ELSE {_FIRST("text")} END AS summary FROM jo""")  # fmt: skip
def l6(spark, d):
    return transforms.summarized(transforms.text_chunks(_dense(spark, d)), transforms.first_sentence)


@query("l7_phases", """WITH r AS (SELECT DISTINCT interview_id FROM interview_jobs), o AS (SELECT interview_id, interview_id % 2 = 0 AS enhance, interview_id % 3 <> 0 AS summary, interview_id % 10 = 2 AS fc, interview_id % 10 = 4 AS fa, interview_id % 10 = 6 AS fs FROM r)
SELECT interview_id, CASE WHEN NOT enhance THEN 'skipped' WHEN fc THEN 'error' ELSE 'done' END AS correction, CASE WHEN NOT enhance OR fc THEN 'skipped' WHEN fa THEN 'failed' ELSE 'done' END AS anonymization,
CASE WHEN NOT summary OR (enhance AND fc) OR (enhance AND NOT fc AND fa) THEN 'skipped' WHEN fs THEN 'failed' ELSE 'done' END AS summary FROM o""")  # fmt: skip
def l7(spark, d):
    n = F.col("interview_id")
    r = views.jobs(spark, d).select("interview_id").distinct().withColumn("enhance", n % 2 == 0).withColumn("include_summary", n % 3 != 0)
    phase = F.when(n % 10 == 2, "correction").when(n % 10 == 4, "anonymization").when(n % 10 == 6, "summary")
    return transforms.phase_outcomes(r, r.select("interview_id", phase.alias("phase")).where("phase is not null"))
