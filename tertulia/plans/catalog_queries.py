"""Queries on the catalogue: interviews, jobs, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from tertulia.functions import formats
from tertulia.operators import catalog
from tertulia.plans import views
from tertulia.plans.views import INTERVIEWS_SQL, JOBS_SQL
from tertulia.session import shared_folder
from tertulia.streaming import jobs as stream_jobs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("a1_status_counts", f"""WITH {INTERVIEWS_SQL}, dom(status) AS (VALUES ('all'), ('pending_audio'), ('pending_processing'), ('processing'), ('completed'), ('failed'))
SELECT dom.status, CASE WHEN dom.status = 'all' THEN (SELECT count(*) FROM i) ELSE (SELECT count(*) FROM i WHERE i.status = dom.status) END AS n FROM dom""")  # fmt: skip
def a1(spark, d):
    return catalog.status_counts(views.interviews(spark, d))


@query("p1_lookup", f"WITH {INTERVIEWS_SQL} SELECT id, status, interview_type FROM i WHERE id = 1")
def lookup(spark, d):
    return views.interviews(spark, d).where("id = 1").select("id", "status", "interview_type")


@query("p3_search", f"WITH {INTERVIEWS_SQL} SELECT id, status FROM i WHERE (contains(lower(coalesce(interview_type, '')), 'terreno') OR contains(lower(coalesce(interview_subject_type, '')), 'terreno') OR contains(CAST(id AS VARCHAR), 'terreno')) AND status = 'completed'")
def search(spark, d):
    return catalog.search(views.interviews(spark, d), " Terreno", "completed").select("id", "status")


@query("p3_search_id", f"WITH {INTERVIEWS_SQL} SELECT id FROM i WHERE contains(CAST(id AS VARCHAR), '12') OR contains(lower(coalesce(interview_type, '')), '12') OR contains(lower(coalesce(interview_subject_type, '')), '12')")
def search_id(spark, d):
    return catalog.search(views.interviews(spark, d), "12").select("id")


@query("o1_newest_first", f"WITH {INTERVIEWS_SQL} SELECT id, status FROM i ORDER BY id DESC")
def o1(spark, d):
    return catalog.newest_first(views.interviews(spark, d)).select("id", "status")


@query("o2_sorted_list", f"WITH {INTERVIEWS_SQL} SELECT id, interview_date FROM i ORDER BY interview_date, id")
def o2(spark, d):
    return catalog.by_date(views.interviews(spark, d)).select("id", "interview_date")


@query("p2_exists", f"WITH {INTERVIEWS_SQL} SELECT DISTINCT g.interview_id + 3 AS id, EXISTS (SELECT 1 FROM i WHERE i.id = g.interview_id + 3) AS found FROM glossary_changes g")
def p2(spark, d):
    wanted = views.table(spark, d, "glossary_changes").select((F.col("interview_id") + 3).alias("id")).distinct()
    return catalog.exists(views.interviews(spark, d), wanted)


@query("w1_latest_job", f"WITH {JOBS_SQL} SELECT interview_id, id, status, current_step FROM (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY id DESC) AS r FROM j) WHERE r = 1")
def w1(spark, d):
    return catalog.latest_job(views.jobs(spark, d)).select("interview_id", "id", "status", "current_step")


@query("w1_current_step", f"WITH {JOBS_SQL} SELECT interview_id, arg_max(current_step, id) AS current_step FROM j WHERE status = 'running' GROUP BY 1")
def w1_step(spark, d):
    return catalog.current_step(views.jobs(spark, d))


@query("w2_latest_duration", f"WITH {JOBS_SQL} SELECT interview_id, date_sub('second', started_at, finished_at) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY id DESC) AS r FROM j WHERE started_at IS NOT NULL AND finished_at IS NOT NULL) WHERE r = 1")
def w2(spark, d):
    return catalog.latest_duration(views.jobs(spark, d))


@query("w16_step_views", f"""WITH {JOBS_SQL}, st(ordinal, step) AS (VALUES (0, 'normalizando_audio'), (1, 'transcribiendo'), (2, 'diarizando'), (3, 'aplicando_glosario'), (4, 'corrigiendo_texto'), (5, 'anonimizando'), (6, 'generando_resumen')),
c AS (SELECT interview_id, arg_max(current_step, id) AS cs FROM j WHERE status = 'running' GROUP BY 1), n AS (SELECT c.interview_id, coalesce(st.ordinal, -1) AS o FROM c LEFT JOIN st ON st.step = c.cs)
SELECT interview_id, step, ordinal, CASE WHEN ordinal < o THEN 'done' WHEN ordinal = o THEN 'current' ELSE 'pending' END AS state FROM n, st""")  # fmt: skip
def w16(spark, d):
    return catalog.step_views(views.jobs(spark, d))


def _audio(spark, d):
    """Audio and result rows of every interview whose latest attempt left a path."""
    return views.jobs(spark, d).where("raw_transcript_path is not null").groupBy("interview_id").agg(F.max("raw_transcript_path").alias("p"))


@query("j1_detail", f"""WITH {INTERVIEWS_SQL}, {JOBS_SQL}, a AS (SELECT interview_id, max(raw_transcript_path) AS p FROM j WHERE raw_transcript_path IS NOT NULL GROUP BY 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY id DESC) AS r FROM j) WHERE r = 1), c AS (SELECT interview_id, arg_max(current_step, id) AS current_step FROM j WHERE status = 'running' GROUP BY 1),
w AS (SELECT interview_id, date_sub('second', started_at, finished_at) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY id DESC) AS r FROM j WHERE started_at IS NOT NULL AND finished_at IS NOT NULL) WHERE r = 1)
SELECT i.id, i.status, a.p AS interview_audio_path, a.p AS interview_transcription_file_path, l.id AS job_id, l.status AS job_status, l.error_message, c.current_step, w.seconds, i.id IN (SELECT interview_id FROM glossary_changes) AS edited
FROM i LEFT JOIN a ON a.interview_id = i.id LEFT JOIN l ON l.interview_id = i.id LEFT JOIN c ON c.interview_id = i.id LEFT JOIN w ON w.interview_id = i.id""")  # fmt: skip
def j1(spark, d):
    a = _audio(spark, d)
    audio = a.select("interview_id", F.col("p").alias("interview_audio_path"))
    results = a.select("interview_id", F.col("p").alias("interview_transcription_file_path"), F.lit(None).cast("string").alias("summary_file_path"))
    edited = views.table(spark, d, "glossary_changes").select("interview_id")
    found = catalog.details(views.interviews(spark, d), views.jobs(spark, d), audio, results, edited)
    return found.select("id", "status", "interview_audio_path", "interview_transcription_file_path", "job_id", "job_status", "error_message", "current_step", "seconds", "edited")


@query("j6_no_active_job", f"WITH {INTERVIEWS_SQL}, {JOBS_SQL} SELECT id FROM i WHERE id NOT IN (SELECT interview_id FROM j WHERE status IN ('pending', 'running'))")
def j6(spark, d):
    return catalog.idle(views.interviews(spark, d), views.jobs(spark, d)).select("id")


@query("m4_upsert", f"""WITH {INTERVIEWS_SQL}, n AS (SELECT CAST(interview_id + 100 AS INT) AS id, 'completed' AS status FROM interview_jobs WHERE status = 'completed' GROUP BY 1)
SELECT id, status FROM i WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")  # fmt: skip
def m4(spark, d):
    new = views.jobs(spark, d).where("status = 'completed'").select((F.col("interview_id") + 100).alias("id"), F.lit("completed").alias("status")).distinct()
    return catalog.upserted(views.interviews(spark, d).select("id", "status"), new, ["id"])


@query("m6_cascade", f"WITH {INTERVIEWS_SQL}, {JOBS_SQL} SELECT id, interview_id FROM j WHERE interview_id NOT IN (SELECT id FROM i WHERE status = 'failed')")
def m6(spark, d):
    gone = views.interviews(spark, d).where("status = 'failed'")
    return catalog.removed(views.jobs(spark, d), gone).select("id", "interview_id")


@query("m8_truncate", f"WITH {JOBS_SQL} SELECT 'interviews' AS name, 0 AS n UNION ALL SELECT 'interview_jobs', count(*) FROM j")
def m8(spark, d):
    """Rows after a truncation, which covers interviews but not jobs."""
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count(catalog.truncated(views.interviews(spark, d)), "interviews").unionByName(count(views.jobs(spark, d), "interview_jobs"))


@query("m7_audio_replaced", f"""WITH {INTERVIEWS_SQL}, {JOBS_SQL}, a AS (SELECT interview_id, max(raw_transcript_path) AS p FROM j WHERE raw_transcript_path IS NOT NULL GROUP BY 1),
n AS (SELECT DISTINCT interview_id + 4 AS id FROM j WHERE interview_id % 2 = 0), q AS (SELECT n.id, CASE WHEN n.id NOT IN (SELECT id FROM i) THEN 'not_found' WHEN n.id IN (SELECT interview_id FROM j WHERE status IN ('pending', 'running')) THEN 'busy' ELSE 'ok' END AS outcome FROM n)
SELECT q.id AS interview_id, outcome, CASE WHEN outcome = 'ok' THEN a.p END AS replaced_path, CASE WHEN outcome = 'ok' THEN 'pending_processing' ELSE i.status END AS status, CASE WHEN outcome = 'ok' THEN 'nuevo/' || q.id || '.wav' ELSE a.p END AS audio_path, a.p IS NOT NULL AND outcome <> 'ok' AS has_result
FROM q LEFT JOIN i ON i.id = q.id LEFT JOIN a ON a.interview_id = q.id""")  # fmt: skip
def m7(spark, d):
    """New audio for the interviews after every other one with a job: what became of it, of the old file, the status and the result."""
    jobs, old = views.jobs(spark, d), _audio(spark, d)
    audio = old.select("interview_id", F.col("p").alias("interview_audio_path"), F.lit("wav").alias("interview_audio_format"), F.lit(1).cast("bigint").alias("interview_audio_size"))
    ids = jobs.where("interview_id % 2 = 0").select((F.col("interview_id") + 4).alias("interview_id")).distinct()
    new = ids.select("interview_id", F.concat(F.lit("nuevo/"), "interview_id", F.lit(".wav")).alias("interview_audio_path"), F.lit("wav").alias("interview_audio_format"), F.lit(2).cast("bigint").alias("interview_audio_size"))
    found, put, results, outcomes = catalog.audio_replaced(views.interviews(spark, d), audio, old.select("interview_id"), jobs, new)
    joined = outcomes.join(found.select(F.col("id").alias("interview_id"), "status"), "interview_id", "left").join(put.select("interview_id", F.col("interview_audio_path").alias("audio_path")), "interview_id", "left")
    return joined.join(results.select("interview_id", F.lit(True).alias("_r")), "interview_id", "left").select("interview_id", "outcome", "replaced_path", "status", "audio_path", F.coalesce("_r", F.lit(False)).alias("has_result"))


@query("w16_optional_steps", f"""WITH {JOBS_SQL}, st(ordinal, step) AS (VALUES (0, 'normalizando_audio'), (1, 'transcribiendo'), (2, 'diarizando'), (3, 'aplicando_glosario'), (4, 'corrigiendo_texto'), (5, 'anonimizando'), (6, 'generando_resumen')),
c AS (SELECT interview_id, arg_max(current_step, id) AS cs FROM j WHERE status = 'running' GROUP BY 1), n AS (SELECT c.interview_id, coalesce(st.ordinal, -1) AS o FROM c LEFT JOIN st ON st.step = c.cs),
k AS (SELECT interview_id, count(*) AS n FROM glossary_changes WHERE interview_id % 3 <> 1 GROUP BY 1),
x AS (SELECT interview_id, step, ordinal, o, CASE WHEN ordinal = o OR ordinal < 3 THEN true WHEN ordinal = 3 THEN interview_id IN (SELECT interview_id FROM k) WHEN ordinal = 6 THEN CASE WHEN interview_id % 4 <> 0 THEN interview_id % 2 = 0 END
WHEN o IN (4, 5) THEN true WHEN interview_id % 4 <> 0 THEN interview_id % 3 = 0 END AS shown FROM n, st)
SELECT interview_id, step, ordinal, CASE WHEN shown IS NULL THEN 'optional' WHEN ordinal < o THEN 'done' WHEN ordinal = o THEN 'current' ELSE 'pending' END AS state FROM x WHERE coalesce(shown, true)""")  # fmt: skip
def w16_optional(spark, d):
    """The steps of running jobs, some without terms, and some without a known choice."""
    jobs, n = views.jobs(spark, d), F.col("interview_id")
    terms = views.table(spark, d, "glossary_changes").where("interview_id % 3 <> 1").groupBy("interview_id").agg(F.count("*").alias("n_keywords"))
    options = jobs.select("interview_id").distinct().where("interview_id % 4 <> 0").select("interview_id", (n % 2 == 0).alias("include_summary"), (n % 3 == 0).alias("enhance"))
    return catalog.step_views(jobs, terms, options)


@query("p11_p12_chosen_files", f"""WITH {JOBS_SQL}, f AS (SELECT id, CASE id % 6 WHEN 0 THEN 'a.b.MP4' WHEN 1 THEN 'x.wav' WHEN 2 THEN 'x.txt' WHEN 3 THEN 'mp3' WHEN 4 THEN 'nada' ELSE '.m4a' END AS name, CASE WHEN id % 5 = 0 THEN 1073741825 ELSE 1073741824 END AS size FROM j)
SELECT id, CASE id % 6 WHEN 2 THEN 'type' WHEN 4 THEN 'type' ELSE CASE WHEN size > 1073741824 THEN 'size' END END AS fault, id % 6 = 0 AS video FROM f""")  # fmt: skip
def p12(spark, d):
    k = F.col("id") % 6
    name = F.when(k == 0, "a.b.MP4").when(k == 1, "x.wav").when(k == 2, "x.txt").when(k == 3, "mp3").when(k == 4, "nada").otherwise(".m4a")
    size = F.when(F.col("id") % 5 == 0, F.lit(1024**3 + 1)).otherwise(F.lit(1024**3))
    return views.jobs(spark, d).select("id", catalog.client_fault(name, size).alias("fault"), catalog.is_video(formats.extension(name)).alias("video"))


@query("r1_r2_r3_job_stream", f"""WITH {JOBS_SQL} SELECT id AS job_id, interview_id, CASE status WHEN 'pending' THEN 1 WHEN 'running' THEN 3 ELSE 4 END AS n_states, status, CASE WHEN status = 'running' THEN 'diarizando' END AS step,
CASE status WHEN 'pending' THEN 'pending_processing' WHEN 'running' THEN 'processing' ELSE status END AS interview_status FROM j""")  # fmt: skip
def r1(spark, d):
    """The events of all jobs, read as a stream of files and driven through the states; the last state of each, and how many it had."""
    jobs = views.jobs(spark, d)
    final = F.when(F.col("status") == "completed", "complete").when(F.col("status") == "failed", "fail")
    events = F.array(F.lit("enqueue"), F.lit("start"), F.lit("step"), final, F.lit("start"))
    upto = F.when(F.col("status") == "pending", 1).when(F.col("status") == "running", 3).otherwise(5)
    each = jobs.select(F.col("id").alias("job_id"), "interview_id", F.posexplode(F.slice(events, F.lit(1), upto)).alias("k", "event"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k"))
    rows = each.select("job_id", "interview_id", "event", F.when(F.col("event") == "step", "diarizando").alias("step"), at.alias("at"))
    folder, states, kept = (shared_folder(spark, x) for x in ("events", "states", "stream"))
    rows.write.json(folder)
    entered = stream_jobs.job_states(stream_jobs.event_stream(spark, folder))
    stream_jobs.run_queue(entered, lambda batch, n: batch.write.mode("overwrite").parquet(f"{states}/batch={n}"), kept).awaitTermination()
    last = F.max(F.struct("at", "status", "step", "interview_status", "interview_id")).alias("_l")
    return spark.read.parquet(states).groupBy("job_id").agg(F.count("*").alias("n_states"), last).select("job_id", "_l.interview_id", "n_states", "_l.status", "_l.step", "_l.interview_status")


@query("m3_append", f"WITH {JOBS_SQL}, n AS (SELECT interview_id, 'pending' AS status, row_number() OVER (ORDER BY interview_id) AS k FROM (SELECT DISTINCT interview_id FROM j WHERE status = 'failed')) SELECT id, interview_id, status FROM j UNION ALL SELECT CAST((SELECT max(id) FROM j) + k AS INT), interview_id, status FROM n")
def m3(spark, d):
    jobs = views.jobs(spark, d)
    new = jobs.where("status = 'failed'").select("interview_id", F.lit("pending").alias("status")).distinct()
    return catalog.appended(jobs.select("id", "interview_id", "status"), new, "interview_id")


@query("r4_reclaimed", f"""WITH {JOBS_SQL} SELECT id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('pending', 'running') THEN 'interrumpido por reinicio' ELSE error_message END AS error_message,
CASE WHEN status NOT IN ('pending', 'running') THEN current_step END AS current_step FROM j""")  # fmt: skip
def r4(spark, d):
    return catalog.reclaimed(views.jobs(spark, d)).select("id", "status", "error_message", "current_step")


@query("a17_reclaimed_count", f"WITH {JOBS_SQL} SELECT count(*) FILTER (status IN ('pending', 'running')) AS n_reclaimed FROM j")
def a17(spark, d):
    return catalog.reclaimed_count(views.jobs(spark, d))


@query("r6_admission", f"""WITH {INTERVIEWS_SQL}, {JOBS_SQL}, q AS (SELECT DISTINCT interview_id + 5 AS id FROM j)
SELECT id, CASE WHEN id NOT IN (SELECT id FROM i) THEN 'not_found' WHEN id NOT IN (SELECT interview_id FROM j WHERE raw_transcript_path IS NOT NULL) THEN 'audio_required' WHEN id IN (SELECT interview_id FROM j WHERE status IN ('pending', 'running')) THEN 'already_queued' ELSE 'queued' END AS outcome FROM q""")  # fmt: skip
def r6(spark, d):
    jobs = views.jobs(spark, d)
    return catalog.admission(views.interviews(spark, d), _audio(spark, d), jobs, jobs.select((F.col("interview_id") + 5).alias("id")).distinct())


@query("p4_keywords", f"""WITH {INTERVIEWS_SQL}, k AS (SELECT id, generate_subscripts(keywords, 1) AS p, unnest(keywords) AS w FROM i),
c AS (SELECT id, p, trim(w, ' ' || chr(9)) AS w FROM k WHERE trim(w, ' ' || chr(9)) <> ''),
f AS (SELECT id, p, w, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM c), o AS (SELECT id, min(p) AS p, arg_min(w, p) AS w FROM f GROUP BY id, l),
e AS (SELECT id, arg_min(CASE WHEN regexp_matches(w, '[\\x00-\\x1F\\x7F]') THEN 'control_char' ELSE 'too_long' END, p) AS error FROM f WHERE regexp_matches(w, '[\\x00-\\x1F\\x7F]') OR strlen(w) > 80 GROUP BY 1)
SELECT i.id, CASE WHEN e.error IS NULL THEN coalesce((SELECT string_agg(w, '|' ORDER BY p) FROM o WHERE o.id = i.id), '') END AS keywords, e.error FROM i LEFT JOIN e ON e.id = i.id""")  # fmt: skip
def p4(spark, d):
    return catalog.keywords(views.interviews_with_keywords(spark, d)).select("id", F.array_join("keywords", "|").alias("keywords"), "error")


@query("a16_keyword_variety", f"""WITH {INTERVIEWS_SQL}, k AS (SELECT unnest(keywords) AS w FROM i) SELECT count(*) AS n_items, count(DISTINCT translate(trim(w, ' ' || chr(9)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS n_distinct FROM k WHERE trim(w) <> ''""")
def a16(spark, d):
    return catalog.keyword_variety(views.interviews_with_keywords(spark, d))


@query("s16_keyword_file", """WITH x AS (SELECT DISTINCT interview_id, line, coalesce(original, '') || ', ' || coalesce(term, '') || ';' || coalesce(upper(original), '') AS f FROM glossary_changes),
p AS (SELECT interview_id, line, generate_subscripts(string_split_regex(f, '[,;\\r\\n]+'), 1) AS p, trim(unnest(string_split_regex(f, '[,;\\r\\n]+')), ' ' || chr(9) || chr(160)) AS w FROM x),
o AS (SELECT interview_id, line, min(p) AS p, arg_min(w, p) AS w FROM p WHERE w <> '' GROUP BY interview_id, line, lower(w))
SELECT x.interview_id, x.line, coalesce((SELECT string_agg(w, '|' ORDER BY p) FROM o WHERE o.interview_id = x.interview_id AND o.line = x.line), '') AS keywords FROM x""")  # fmt: skip
def s16(spark, d):
    g = views.table(spark, d, "glossary_changes").distinct()
    text = F.concat(F.coalesce("original", F.lit("")), F.lit(", "), F.coalesce("term", F.lit("")), F.lit(";"), F.coalesce(F.upper("original"), F.lit("")))
    return g.select("interview_id", "line", F.array_join(formats.keyword_list(text), "|").alias("keywords")).distinct()


@query("w11_token_budget", """WITH g AS (SELECT DISTINCT interview_id, line, term FROM glossary_changes WHERE term IS NOT NULL), c AS (SELECT *, sum(length(term) // 4 + 1) OVER (PARTITION BY interview_id ORDER BY line) AS cost_so_far FROM g)
SELECT interview_id, line AS pos, term, cost_so_far FROM c WHERE cost_so_far <= 150""")  # fmt: skip
def w11(spark, d):
    g = views.table(spark, d, "glossary_changes").where("term is not null").select("interview_id", F.col("line").alias("pos"), "term").distinct()
    return catalog.within_token_budget(g, F.floor(F.char_length("term") / 4) + 1)


@query("p8_required_fields", f"WITH {INTERVIEWS_SQL} SELECT id FROM i WHERE interview_date IS NOT NULL AND interview_type IS NOT NULL AND interview_subject_type IS NOT NULL")
def p8(spark, d):
    return catalog.required_fields(views.interviews(spark, d)).select("id")


@query("p9_integer_header", f"WITH {JOBS_SQL}, h AS (SELECT id, id || CASE WHEN id % 3 = 0 THEN 'abc' WHEN id % 3 = 1 THEN '' ELSE ' x' END AS v FROM j) SELECT id, TRY_CAST(regexp_extract(v, '^([0-9]+)', 1) AS INT) AS header FROM h")
def p9(spark, d):
    v = F.concat(F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "abc").when(F.col("id") % 3 == 1, "").otherwise(" x"))
    return views.jobs(spark, d).select("id", catalog.integer_header(v).alias("header"))


@query("pred7_body_defaults", f"WITH {JOBS_SQL} SELECT id, status = 'completed' AS include_summary, false AS enhance FROM j")
def p7(spark, d):
    body = F.concat(F.lit('{"includeSummary": '), (F.col("status") == "completed").cast("string"), F.lit(', "enhanceTranscript": "yes"}'))
    return views.jobs(spark, d).select("id", catalog.process_options(body).alias("o")).select("id", "o.*")


# First bytes of eight kinds of file and the type each is declared to be.
_HEADS = [("524946460000000057415645", "audio/wav"), ("524946460000000041564920", "audio/wav"), ("4F6767530000000000000000", "audio/ogg"), ("494433040000000000000000", "audio/mpeg"), ("FFFB90640000000000000000", "audio/mpeg"), ("00000018667479706D703432", "video/mp4"), ("4F6767530000000000000000", "audio/mpeg"), ("494433040000000000000000", "text/plain")]
_MIMES = ["audio/wav", "audio/ogg", "audio/mpeg", "video/mp4"]


@query("p10_upload_guard", f"""WITH {JOBS_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'size' WHEN id % 8 = 7 THEN 'type' WHEN id % 8 IN (1, 6) THEN 'content' END AS fault FROM j""")
def p10(spark, d):
    """Eight kinds of upload: a good one of each signature, a wrong container, a wrong type, one that is not taken; every fifth too large."""
    pick = lambda n: F.element_at(F.array(*(F.lit(h[n]) for h in _HEADS)), (F.col("id") % 8 + 1).cast("int"))
    size = F.when(F.col("id") % 5 == 0, F.lit(2147483648)).otherwise(F.col("id") * 1000)
    head, mime = F.unhex(pick(0)), pick(1)
    return views.jobs(spark, d).select("id", catalog.upload_fault(F.lit("a.wav"), size, mime, formats.known_type(head, mime), _MIMES).alias("fault"))


@query("r3_status_rank", f"WITH {JOBS_SQL} SELECT id, CASE status WHEN 'pending' THEN 1 WHEN 'running' THEN 2 WHEN 'completed' THEN 3 WHEN 'failed' THEN 4 ELSE 0 END AS rank FROM j")
def r3(spark, d):
    return views.jobs(spark, d).select("id", catalog.job_status_order(F.col("status")).alias("rank"))


_MONTHS = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"


@query("x1_spanish_date", f"WITH {INTERVIEWS_SQL} SELECT id, day(interview_date) || ' de ' || {_MONTHS}[month(interview_date)] || ' de ' || year(interview_date) || ', ' || strftime(interview_date, '%H:%M') || ' hs' AS date_text FROM i WHERE interview_date IS NOT NULL")
def x1(spark, d):
    return views.interviews(spark, d).where("interview_date is not null").select("id", formats.spanish_date(F.date_format("interview_date", "yyyy-MM-dd HH:mm:ss")).alias("date_text"))


@query("x2_x3_sizes_and_durations", f"""WITH {JOBS_SQL}, w AS (SELECT id, date_sub('second', started_at, finished_at) AS s FROM j WHERE started_at IS NOT NULL AND finished_at IS NOT NULL)
SELECT id, CASE WHEN s >= 3600 THEN format('{{}} h {{}} min', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{{}} min {{}} s', s // 60, s % 60) ELSE format('{{}} s', s) END AS duration,
CASE WHEN s >= 3600 THEN format('{{}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{{}}:{{:02d}}', s // 60, s % 60) END AS clock, format('{{:02d}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) AS stamp FROM w""")  # fmt: skip
def x3(spark, d):
    s = F.expr("timestampdiff(SECOND, started_at, finished_at)")
    done = views.jobs(spark, d).where("started_at is not null and finished_at is not null")
    return done.select("id", formats.duration_text(s).alias("duration"), formats.stopwatch(s).alias("clock"), formats.timestamp_text(s).alias("stamp"))


@query("x6_x9_file_names", f"WITH {JOBS_SQL} SELECT id, string_split(raw_transcript_path, '/')[-1] AS name, '.json' AS ext, coalesce(regexp_extract(error_message, '(\\.[^.]*)$', 1), '') AS error_ext FROM j WHERE raw_transcript_path IS NOT NULL")
def x6(spark, d):
    p = views.jobs(spark, d).where("raw_transcript_path is not null")
    return p.select("id", formats.base_name("raw_transcript_path").alias("name"), formats.extension("raw_transcript_path").alias("ext"), F.coalesce(formats.extension("error_message"), F.lit("")).alias("error_ext"))


@query("x7_roman", "SELECT term_id, repeat('X', term_id // 10) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][term_id % 10 + 1] AS numeral FROM glossary_terms")
def x7(spark, d):
    return views.table(spark, d, "glossary_terms").select("term_id", formats.roman("term_id").alias("numeral"))


@query("x8_datetime_text", f"WITH {INTERVIEWS_SQL} SELECT id, strftime(interview_date, '%Y-%m-%d %H:%M') || ':00' AS value FROM i WHERE interview_date IS NOT NULL")
def x8(spark, d):
    return views.interviews(spark, d).where("interview_date is not null").select("id", formats.to_datetime_text(F.date_format("interview_date", "yyyy-MM-dd'T'HH:mm")).alias("value"))
