"""The catalogue of interviews and jobs: append logs with latest-wins views, lookups, validation and mutations as new frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.functions.text import lower_ascii
from tertulia.operators.ordered import renumbered, running
from tertulia.schema import ACTIVE_JOB, INTERVIEW_STATUS, JOB_STATUS, STEPS

# Limits of keywords.
KEYWORD_BYTES, KEYWORDS_MAX = 80, 100
UPLOAD_MAX_BYTES = 1024**3
VIDEO_EXTENSIONS = [".mp4"]
ACCEPTED_EXTENSIONS = ["mp3", "wav", "ogg", "m4a", "mp4"]


def latest(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """One whole row for each key: the first by the given order. Rows combine before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    return ranked.where("_r = 1").select(*key, *others)


def current_interviews(versions: DataFrame) -> DataFrame:
    """M4 and M5: the latest version of each interview by updated_at; of ties the least status."""
    return latest(versions, ["id"], [F.desc("updated_at"), F.col("status")])


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """M4: changes by key over the table; keys that the table has not are inserted."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def appended(table: DataFrame, new: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """M3: new rows with ids that follow the greatest one, in order of an integer column."""
    top = table.agg(F.max(id_col)).first()[0] or 0
    in_order = renumbered(new.withColumn("_all", F.lit(0)), "_n", "_all", order)
    with_ids = in_order.withColumn(id_col, (F.lit(top + 1) + F.col("_n")).cast("int")).drop("_n", "_all")
    return table.unionByName(with_ids, allowMissingColumns=True)


def removed(children: DataFrame, gone: DataFrame, key: str = "interview_id") -> DataFrame:
    """M6: rows that do not belong to a removed interview (id)."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def audio_replaced(interviews: DataFrame, audio: DataFrame, results: DataFrame, jobs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """M7: (interviews, audio, results, outcomes) after new audio (interview_id, interview_audio_path, interview_audio_format, interview_audio_size), one row an interview.

    Only interviews that are there and have no active job take it; outcomes (interview_id,
    outcome, replaced_path) tells 'ok', 'not_found' or 'busy', and which old file goes. Where an
    audio is replaced its result goes; an interview that takes one is pending_processing.
    """
    known = exists(interviews, new.select(F.col("interview_id").alias("id"))).withColumnRenamed("id", "interview_id")
    busy = known.join(active(jobs).withColumn("_b", F.lit(True)), "interview_id", "left")
    outcome = F.when(~F.col("found"), "not_found").when(F.col("_b").isNotNull(), "busy").otherwise("ok")
    judged = busy.select("interview_id", outcome.alias("outcome"))
    old = audio.select("interview_id", F.col("interview_audio_path").alias("_old"))
    with_old = judged.join(old, "interview_id", "left").join(new.select("interview_id", F.col("interview_audio_path").alias("_new")), "interview_id")
    outcomes = with_old.select("interview_id", "outcome", F.when((F.col("outcome") == "ok") & ~F.col("_old").eqNullSafe(F.col("_new")), F.col("_old")).alias("replaced_path"))
    taken = judged.where("outcome = 'ok'").select("interview_id")
    put = upserted(audio, new.join(taken, "interview_id", "left_semi"), ["interview_id"])
    replaced = taken.join(audio.select("interview_id"), "interview_id", "left_semi").withColumnRenamed("interview_id", "id")
    waiting = interviews.join(taken.select(F.col("interview_id").alias("id"), F.lit("pending_processing").alias("_s")), "id", "left")
    return waiting.withColumn("status", F.coalesce("_s", "status")).drop("_s").select(*interviews.columns), put, removed(results, replaced), outcomes


def truncated(table: DataFrame) -> DataFrame:
    """M8: the table without rows."""
    return table.limit(0)


def search(interviews: DataFrame, needle: str = "", status: str | None = None) -> DataFrame:
    """Type or subject type contains the needle in any case, or the id's digits do; blank finds all."""
    n = needle.strip().lower()
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(n))
    found = interviews.where(has("interview_type") | has("interview_subject_type") | F.contains(F.col("id").cast("string"), F.lit(n)))
    return found if status is None else found.where(F.col("status") == status)


def status_counts(interviews: DataFrame) -> DataFrame:
    """A1: (status, n) for each status of the domain, 0 included, and 'all' in total."""
    domain = interviews.sparkSession.createDataFrame([(s,) for s in ["all", *INTERVIEW_STATUS]], "status string")
    counts = interviews.groupBy("status").count()
    totals = counts.unionByName(counts.agg(F.lit("all").alias("status"), F.sum("count").alias("count")))
    return domain.join(totals, "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def newest_first(interviews: DataFrame) -> DataFrame:
    """O1."""
    return interviews.orderBy(F.desc("id"))


def by_date(interviews: DataFrame, ascending: bool = True) -> DataFrame:
    """O2."""
    order = [F.col("interview_date"), F.col("id")]
    return interviews.orderBy(*(c.asc() if ascending else c.desc() for c in order))


def latest_job(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Each interview's job with the greatest id, of one status if given."""
    some = jobs if status is None else jobs.where(F.col("status") == status)
    return some.groupBy("interview_id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "interview_id"]), "id").alias("_j")).select("interview_id", "_j.*")


def current_step(jobs: DataFrame) -> DataFrame:
    """(interview_id, current_step) of the latest running job."""
    return latest_job(jobs, "running").select("interview_id", "current_step")


def latest_duration(jobs: DataFrame) -> DataFrame:
    """(interview_id, seconds) of the latest job with both times, cut to whole seconds."""
    done = jobs.where("started_at is not null and finished_at is not null")
    last = done.groupBy("interview_id").agg(F.max_by(F.struct("started_at", "finished_at"), "id").alias("_j"))
    return last.select("interview_id", F.expr("timestampdiff(SECOND, _j.started_at, _j.finished_at)").alias("seconds"))


def details(interviews: DataFrame, jobs: DataFrame, audio: DataFrame, results: DataFrame, edited: DataFrame) -> DataFrame:
    """Each interview with audio, result, latest job, running step, duration and whether it has an edited transcript."""
    parts = [
        audio.select("interview_id", "interview_audio_path"),
        results.select("interview_id", "interview_transcription_file_path", "summary_file_path"),
        latest_job(jobs).select("interview_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"), "error_message"),
        current_step(jobs),
        latest_duration(jobs),
        edited.select("interview_id").distinct().withColumn("edited", F.lit(True)),
    ]
    base = interviews.withColumn("interview_id", F.col("id"))
    joined = reduce(lambda a, b: a.join(b, "interview_id", "left"), parts, base)
    return joined.withColumn("edited", F.coalesce("edited", F.lit(False))).drop("interview_id")


def active(jobs: DataFrame) -> DataFrame:
    """Interviews with a pending or running job."""
    return jobs.where(F.col("status").isin(ACTIVE_JOB)).select("interview_id").distinct()


def idle(interviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """Interviews that may take audio or edits: none of their jobs is active."""
    return interviews.join(active(jobs).withColumnRenamed("interview_id", "id"), "id", "left_anti")


def exists(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Wanted keys with whether the table has them."""
    there = table.select(key).distinct().withColumn("found", F.lit(True))
    return wanted.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def admission(interviews: DataFrame, audio: DataFrame, jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, outcome) of processing requests: not_found, audio_required, already_queued or queued."""
    known = exists(interviews, requests.select("id")).withColumnRenamed("found", "_i")
    with_audio = known.join(audio.select(F.col("interview_id").alias("id")).distinct().withColumn("_a", F.lit(True)), "id", "left")
    busy = with_audio.join(active(jobs).select(F.col("interview_id").alias("id")).withColumn("_b", F.lit(True)), "id", "left")
    outcome = F.when(~F.col("_i"), "not_found").when(F.col("_a").isNull(), "audio_required").when(F.col("_b").isNotNull(), "already_queued").otherwise("queued")
    return busy.select("id", outcome.alias("outcome"))


def reclaimed(jobs: DataFrame, message: str = "interrumpido por reinicio") -> DataFrame:
    """Pending and running jobs as failed, with the message and without a step."""
    stuck = F.col("status").isin(ACTIVE_JOB)
    return jobs.withColumns(
        {"error_message": F.when(stuck, message).otherwise(F.col("error_message")), "current_step": F.when(stuck, F.lit(None).cast("string")).otherwise(F.col("current_step")), "status": F.when(stuck, "failed").otherwise(F.col("status"))}
    )


def reclaimed_count(jobs: DataFrame) -> DataFrame:
    """A17."""
    return jobs.agg(F.count_if(F.col("status").isin(ACTIVE_JOB)).alias("n_reclaimed"))


def keywords(interviews: DataFrame) -> DataFrame:
    """(id, keywords, error) with items trimmed of spaces and tabs, blanks skipped, repeats in any ASCII case once, first form and order kept.

    error is 'control_char' or 'too_long' of the first bad item, or 'too_many'; then keywords
    is null. Interviews without keywords have none.
    """
    items = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x.isNotNull() & (x != ""))
    fault = F.transform(items, lambda x: F.when(F.rlike(x, F.lit(r"[\x00-\x1F\x7F]")), "control_char").when(F.octet_length(x) > KEYWORD_BYTES, "too_long"))
    prepared = interviews.select("id", items.alias("_i"), F.get(F.array_compact(fault), F.lit(0)).alias("_f"))
    lowered = F.transform("_i", lower_ascii)
    once = F.filter("_i", lambda x, k: F.array_position(lowered, lower_ascii(x)) == k + 1)
    ready = prepared.withColumn("_k", once).withColumn("error", F.coalesce("_f", F.when(F.size("_k") > KEYWORDS_MAX, "too_many")))
    return ready.select("id", F.when(F.col("error").isNull(), F.col("_k")).alias("keywords"), "error")


def keyword_variety(interviews: DataFrame) -> DataFrame:
    """(n_items, n_distinct) of all keywords, repeats in any ASCII case once."""
    items = interviews.select(F.explode("keywords").alias("k")).where("trim(k) <> ''")
    return items.agg(F.count("*").alias("n_items"), F.countDistinct(lower_ascii(F.btrim("k", F.lit(" \t")))).alias("n_distinct"))


def within_token_budget(terms: DataFrame, cost: Column, budget: int = 150) -> DataFrame:
    """Terms (interview_id, pos, term) in order up to the first whose running cost exceeds the budget."""
    return running(terms, cost, "cost_so_far", F.sum).where(F.col("cost_so_far") <= budget)


def upload_fault(name: Column, size: Column, mime: Column, signature_ok: Column, mimes: list[str]) -> Column:
    """P10: 'size', 'type' or 'content' of an upload, null if it may come in."""
    return F.when(size > UPLOAD_MAX_BYTES, "size").when(~mime.isin(mimes), "type").when(~signature_ok, "content")


def client_fault(name: Column, size: Column) -> Column:
    """P12: 'type' or 'size' of a chosen file by what follows its last dot, in any case (the whole name without a dot), null if it may be sent."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(~F.coalesce(ext, F.lit("")).isin(ACCEPTED_EXTENSIONS), "type").when(size > UPLOAD_MAX_BYTES, "size")


def is_video(extension: Column) -> Column:
    """P11."""
    return lower_ascii(extension).isin(VIDEO_EXTENSIONS)


def required_fields(requests: DataFrame) -> DataFrame:
    """Requests with date, type and subject type."""
    return requests.where("interview_date is not null and interview_type is not null and interview_subject_type is not null")


def integer_header(value: Column) -> Column:
    """The integer at the start of a header, null if there is none."""
    return F.regexp_extract(F.ltrim(value), r"^([+-]?\d+)", 1).try_cast("int")


def process_options(body: Column) -> DataFrame | Column:
    """struct(include_summary, enhance) of a JSON body, false where missing or no boolean."""
    flag = lambda k: F.coalesce(F.when(F.get_json_object(body, f"$.{k}").isin("true", "false"), F.get_json_object(body, f"$.{k}") == "true"), F.lit(False))
    return F.struct(flag("includeSummary").alias("include_summary"), flag("enhanceTranscript").alias("enhance"))


def step_views(jobs: DataFrame, terms: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """(interview_id, step, ordinal, state) of each interview's latest running job: done, current, pending or, where nobody knows whether it was asked for, optional.

    With terms (interview_id, n_keywords) the glossary step is left out where there are none,
    and the steps of correction, anonymisation and summary are those of options (interview_id,
    include_summary, enhance), optional without a row; the current step is always shown. Without
    terms every step is shown, known.
    """
    at = F.coalesce(F.array_position(F.array(*map(F.lit, STEPS)), F.col("current_step")) - 1, F.lit(-1))
    steps = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(x).alias("step")) for k, x in enumerate(STEPS)))
    each = current_step(jobs).select("interview_id", at.alias("_now"), F.explode(steps).alias("s")).select("interview_id", "_now", "s.*")
    shown = F.lit(True)
    if terms is not None:
        each = each.join(terms.select("interview_id", "n_keywords"), "interview_id", "left")
        none = each.select("interview_id").limit(0).selectExpr("interview_id", "cast(null as boolean) include_summary", "cast(null as boolean) enhance")
        each = each.join((none if options is None else options).select("interview_id", "include_summary", "enhance"), "interview_id", "left")
        rewriting = F.col("_now").isin(STEPS.index("corrigiendo_texto"), STEPS.index("anonimizando"))
        shown = (
            F.when((F.col("ordinal") == F.col("_now")) | (F.col("ordinal") < STEPS.index("aplicando_glosario")), True).when(F.col("step") == "aplicando_glosario", F.coalesce("n_keywords", F.lit(0)) > 0)
            .when(F.col("step") == "generando_resumen", F.col("include_summary")).when(rewriting, True).otherwise(F.col("enhance"))
        )
    state = F.when(shown.isNull(), "optional").when(F.col("ordinal") < F.col("_now"), "done").when(F.col("ordinal") == F.col("_now"), "current").otherwise("pending")
    return each.withColumn("_shown", shown).withColumn("state", state).where(F.coalesce("_shown", F.lit(True))).select("interview_id", "step", "ordinal", "state")


def job_status_order(status: Column) -> Column:
    """Rank of a job status: pending, running, then the two final ones."""
    return F.array_position(F.array(*map(F.lit, JOB_STATUS)), status)
