"""Segment quality: loops, known hallucinations, density, prompt echo, gaps and unpunctuated stretches.

Segments are rows (interview_id, pos, t0, t1, text) with times in centiseconds and dense
positions from 0 in each interview.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.text import clock_cs, col, common_substring, folded, has_punctuation, normalized, words
from tertulia.operators.folds import streamed
from tertulia.operators.ordered import counted, renumbered, running, with_neighbours
from tertulia.session import checkpointed

# Texts that recognisers make up, without spaces and accents.
HALLUCINATION_PHRASES = ["graciasporverelvideo", "graciasporver", "suscribetealcanal", "noolvidessuscribirte", "subtitulosrealizadosporlacomunidaddeamaraorg"]
HALLUCINATION_PARTS = ["amaraorg", "subtitulospor", "subtituladopor", "transcripcionysubtitulos"]
# Limits, in centiseconds, bytes and rows.
#: Times in centiseconds that agree but for these bits, 22 minutes, are a chunk.
TIME_BITS = 17
PHRASE_MAX_CS, GAP_MIN_CS, UNPUNCTUATED_MIN_CS = 300, 800, 6_000
LONG_BYTES, LONG_REPEATS, SHORT_REPEATS = 15, 3, 4
ECHO_BYTES, NEIGHBOURS = 25, 3
MARK_BYTES = ECHO_BYTES - 3 * 3
STYLE_PROMPT = "¿Y cómo lo hacen ustedes? Bueno, depende del caso, pero en general sí."


def plain(text: str | Column) -> Column:
    """Normalised and without accents: what phrases and prompts are compared by."""
    return folded(normalized(text))


def known_hallucination(text: str | Column, t0: str | Column, t1: str | Column) -> Column:
    """Q1: has a subtitle credit at any length, or is a known phrase of at most PHRASE_MAX_CS."""
    n = plain(text)
    part = F.exists(F.array(*map(F.lit, HALLUCINATION_PARTS)), lambda p: F.contains(n, p))
    return part | (n.isin(HALLUCINATION_PHRASES) & (col(t1) - col(t0) <= PHRASE_MAX_CS))


def too_dense(text: str | Column, t0: str | Column, t1: str | Column) -> Column:
    """Q2: more than 35 characters a second and 10 besides."""
    return F.char_length(col(text)) * 100 > F.greatest(col(t1) - col(t0), F.lit(0)) * 35 + 1000


def with_repeats(segments: DataFrame) -> DataFrame:
    """Column repeats, whether a neighbour within three rows contains the text or is contained in it (normalised, non-empty)."""
    n = segments.withColumn("_n", normalized("text"))
    near = with_neighbours(n, "_n", NEIGHBOURS, "_near")
    hit = F.exists("_near", lambda x: (x != "") & (F.contains(x, F.col("_n")) | F.contains(F.col("_n"), x)))
    return near.withColumn("repeats", (F.col("_n") != "") & hit).drop("_n", "_near")


def with_echo(segments: DataFrame, prompt: str = STYLE_PROMPT) -> DataFrame:
    """Q4: column echo, whether at least 25 bytes and half of the plain text are a stretch of the prompt.

    Built-in functions tell the texts that share no MARK_BYTES with the prompt, which no stretch
    can do without; only the others go through Python.
    """
    flat = _plain_text(prompt)
    may = reduce(lambda a, b: a | b, (F.contains(F.col("_p"), F.lit(m)) for m in _marks(flat)), F.lit(False))
    asked = segments.withColumn("_p", plain("text")).withColumn("_c", common_substring(F.when((F.octet_length("_p") >= ECHO_BYTES) & may, F.col("_p")), F.lit(flat)))
    return asked.withColumn("echo", F.coalesce((F.col("_c") >= ECHO_BYTES) & (2 * F.col("_c") >= F.octet_length("_p")), F.lit(False))).drop("_c", "_p")


def _plain_text(text: str) -> str:
    """plain() of a Python string."""
    kept = "".join((c.lower() if c < "\x80" else c) for c in text if c > "\x7f" or c.isalnum())
    return kept.translate(str.maketrans("áéíóúüñ", "aeiouun", "¿¡"))


def _marks(flat: str) -> list[str]:
    """From each character on, the fewest characters of MARK_BYTES; of any ECHO_BYTES, which may cut a character at either end, one is a part."""
    found = []
    for k in range(len(flat)):
        end = next((e for e in range(k + 1, len(flat) + 1) if len(flat[k:e].encode()) >= MARK_BYTES), None)
        if end:
            found.append(flat[k:end])
    return sorted(set(found))


def with_drop_reason(segments: DataFrame, prompt: str = STYLE_PROMPT) -> DataFrame:
    """Q5: column reason: 'known', 'dense_repeat' (Q3) or 'prompt_echo', the first that holds, null for rows to keep."""
    seen = with_echo(with_repeats(segments), prompt)
    reason = F.when(known_hallucination("text", "t0", "t1"), "known").when(too_dense("text", "t0", "t1") & F.col("repeats"), "dense_repeat").when(F.col("echo"), "prompt_echo")
    return seen.withColumn("reason", reason).drop("repeats", "echo")


def same_utterance(a: str, b: str) -> bool:
    """Equal, or both of LONG_BYTES and one within the other; an empty text is like no other."""
    if not a or not b:
        return False
    return a == b or (min(len(a.encode()), len(b.encode())) >= LONG_BYTES and (a in b or b in a))


def _repeat_fold():
    state = {"anchor": None, "first": None, "last": None, "n": 0}

    def close() -> list[tuple]:
        long = state["anchor"] is not None and len(state["anchor"].encode()) >= LONG_BYTES
        if state["anchor"] and state["n"] >= (LONG_REPEATS if long else SHORT_REPEATS):
            return [(state["entity"], state["first"], state["last"], state["n"])]
        return []

    def step(entity, pos, text) -> list[tuple]:
        if state["n"] and same_utterance(state["anchor"], text or ""):
            state.update(last=pos, n=state["n"] + 1)
            return []
        found = close() if state["n"] else []
        state.update(entity=entity, anchor=text or "", first=pos, last=pos, n=1)
        return found

    return step, lambda: close() if state["n"] else []


def repeat_runs(segments: DataFrame) -> DataFrame:
    """(interview_id, first_pos, last_pos, n): runs of texts like the run's first one, of three (long text) or four (short) rows."""
    texts = segments.select("interview_id", F.col("pos").cast("bigint").alias("pos"), normalized("text").alias("_n"))
    return streamed(texts, ["pos", "_n"], "first_pos bigint, last_pos bigint, n bigint", _repeat_fold)


def marked_loops(segments: DataFrame, loops: DataFrame) -> DataFrame:
    """(interview_id, run_id, pos, t0, t1, text) of loops (interview_id, run_id, first_pos, last_pos) without a retry: the first row, and one without words that names the rest as not transcribed."""
    covered = loops.select("interview_id", "run_id", "first_pos", "last_pos", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    rows = segments.join(covered, ["interview_id", "pos"]).where("pos = first_pos or pos = last_pos")
    columns = ["t0", "t1", "text", *_words_of(segments)]
    first = rows.where("pos = first_pos").select("interview_id", "run_id", F.lit(0).alias("pos"), *columns)
    span = rows.groupBy("interview_id", "run_id").agg(F.min_by("t1", "pos").alias("t0"), F.max_by("t1", "pos").alias("t1"))
    note = F.concat(F.lit("[audio no transcrito "), clock_cs("t0"), F.lit("-"), clock_cs("t1"), F.lit("]"))
    return first.unionByName(span.select("interview_id", "run_id", F.lit(1).alias("pos"), "t0", "t1", note.alias("text")), allowMissingColumns=True)


def loops_replaced(segments: DataFrame, retries: DataFrame | None = None) -> DataFrame:
    """Q6: each loop (F1) replaced by its retry rows (run_id is the loop's first pos) if there are any and they have no loop, else by F2; positions are renumbered."""
    loops = checkpointed(repeat_runs(segments).withColumn("run_id", F.col("first_pos")))
    key = ["interview_id", "run_id"]
    if retries is None:
        return spliced(segments, loops, marked_loops(segments, loops))
    good = checkpointed(with_loops(retries.join(loops.select(*key), key, "left_semi")).where("not has_loop").drop("has_loop"))
    lost = marked_loops(segments, loops.join(good.select(*key).distinct(), key, "left_anti"))
    return spliced(segments, loops, lost.unionByName(good.select("interview_id", "run_id", "pos", "t0", "t1", "text", *_words_of(good)), allowMissingColumns=True))


def _words_of(segments: DataFrame) -> list[str]:
    """The column of words, where there is one."""
    return [c for c in ("words",) if c in segments.columns]


def gaps(segments: DataFrame, audio_end: DataFrame | None = None, least: int = GAP_MIN_CS) -> DataFrame:
    """(interview_id, gap_start, gap_end): stretches of at least least cs before a row that no earlier row covers.

    The lead-in from 0 counts, and with audio_end (interview_id, end_cs) the tail.
    """
    rows = segments.select("interview_id", F.col("pos").cast("bigint").alias("pos"), "t0", "t1")
    if audio_end is not None:
        tail = audio_end.select("interview_id", F.lit(2**40).cast("bigint").alias("pos"), F.col("end_cs").alias("t0"), F.col("end_cs").alias("t1"))
        rows = rows.unionByName(tail)
    reached = running(rows, F.col("t1"), "_reach", F.max, itself=False)
    start = F.coalesce("_reach", F.lit(0))
    return reached.where(F.col("t0") - start >= least).select("interview_id", start.alias("gap_start"), F.col("t0").alias("gap_end"))


def unpunctuated_runs(segments: DataFrame, least: int = UNPUNCTUATED_MIN_CS) -> DataFrame:
    """(interview_id, first_pos, last_pos, n, span_cs): consecutive rows without punctuation that span least cs, last end less first start by position."""
    # rows without punctuation between the same two with it have the same count of those
    marked = counted(segments.withColumn("_p", has_punctuation("text")), F.col("_p"), "_run")
    grouped = marked.where(~F.col("_p")).groupBy("interview_id", "_run")
    runs = grouped.agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"), (F.max_by("t1", "pos") - F.min_by("t0", "pos")).alias("span_cs"))
    return runs.where(F.col("span_cs") >= least).drop("_run")


def word_counts(segments: DataFrame) -> DataFrame:
    """(interview_id, n_segments, n_punctuated, n_words)."""
    return segments.groupBy("interview_id").agg(F.count("*").alias("n_segments"), F.count_if(has_punctuation("text")).alias("n_punctuated"), F.sum(F.size(words("text"))).cast("bigint").alias("n_words"))


def retry_accepted(n: Column, punctuated: Column, retry_words: Column, old_words: Column, has_loop: Column) -> Column:
    """At least half of the retry's rows punctuated, at least 70 % of the words, and no loop."""
    return (punctuated * 2 >= n) & (retry_words * 10 >= old_words * 7) & ~has_loop


def spliced(segments: DataFrame, ranges: DataFrame, retries: DataFrame) -> DataFrame:
    """M2: rows of each range (interview_id, run_id, first_pos, last_pos) replaced by the retry rows of its run_id, renumbered."""
    covered = ranges.select("interview_id", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    kept = ["t0", "t1", "text", *_words_of(segments)]
    keep = segments.join(covered, ["interview_id", "pos"], "left_anti").select("interview_id", F.col("pos").cast("bigint").alias("p"), F.lit(-1).cast("bigint").alias("q"), *kept)
    new = retries.join(ranges.select("interview_id", "run_id", "first_pos"), ["interview_id", "run_id"])
    new = new.select("interview_id", F.col("first_pos").cast("bigint").alias("p"), F.col("pos").cast("bigint").alias("q"), "t0", "t1", "text", *_words_of(retries))
    both = keep.unionByName(new, allowMissingColumns=True)
    return renumbered(both, "pos", order=["p", "q"]).select("interview_id", F.col("pos").cast("int").alias("pos"), *kept)


def _apart(retries: DataFrame) -> DataFrame:
    """Rows (interview_id, run_id, pos, …) of all runs of an interview in one order, pos as _at: blank rows, which are like no other row, stand between the runs."""
    blank = [F.lit(k - NEIGHBOURS).cast("bigint") for k in range(NEIGHBOURS)]
    rows = retries.withColumn("_at", F.col("pos").cast("bigint")).drop("pos")
    between = rows.select("interview_id", "run_id").distinct().select("*", F.explode(F.array(*blank)).alias("_at"))
    both = rows.unionByName(between.withColumn("text", F.lit("")), allowMissingColumns=True)
    return renumbered(both, "pos", order=["run_id", "_at"])


def _looped(apart: DataFrame) -> DataFrame:
    starts = repeat_runs(apart).select("interview_id", F.col("first_pos").alias("pos"))
    loops = apart.join(starts, ["interview_id", "pos"]).select("interview_id", "run_id", F.lit(True).alias("has_loop")).distinct()
    judged = apart.where("_at >= 0").join(loops, ["interview_id", "run_id"], "left").withColumn("has_loop", F.coalesce("has_loop", F.lit(False)))
    return judged.drop("pos").withColumnRenamed("_at", "pos")


def with_loops(retries: DataFrame) -> DataFrame:
    """Rows (interview_id, run_id, pos from 0, t0, t1, text) with has_loop, whether their run, taken alone, has a loop (F1)."""
    return _looped(checkpointed(_apart(retries)))


def judged_retries(retries: DataFrame, prompt: str = STYLE_PROMPT) -> DataFrame:
    """Retry rows (interview_id, run_id, pos from 0, t0, t1, text) less those with a drop reason (Q5), and has_loop, whether what is left of their run has a loop (F1); each run is judged alone."""
    return _looped(checkpointed(with_drop_reason(checkpointed(_apart(retries)), prompt).where("reason is null").drop("reason")))


def repaired(segments: DataFrame, ranges: DataFrame, retries: DataFrame, prompt: str = STYLE_PROMPT) -> DataFrame:
    """Q7: rows of each range (interview_id, run_id, first_pos, last_pos) replaced by what is kept of its retry, if that is accepted (A9); else the originals stay."""
    judged = checkpointed(judged_retries(retries, prompt))
    n_words = F.sum(F.size(words("text")))
    new = judged.groupBy("interview_id", "run_id").agg(F.count("*").alias("_n"), F.count_if(has_punctuation("text")).alias("_p"), n_words.alias("_new"), F.bool_or("has_loop").alias("_loop"))
    covered = ranges.select("interview_id", "run_id", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    old = segments.join(covered, ["interview_id", "pos"]).groupBy("interview_id", "run_id").agg(n_words.alias("_old"))
    both = ranges.join(new, ["interview_id", "run_id"]).join(old, ["interview_id", "run_id"])
    accepted = both.where(retry_accepted(*map(F.col, ("_n", "_p", "_new", "_old", "_loop")))).select("interview_id", "run_id", "first_pos", "last_pos")
    return spliced(segments, checkpointed(accepted), judged.drop("has_loop"))


def accepted_recovered(recovered: DataFrame, prompt: str = STYLE_PROMPT) -> DataFrame:
    """Q8: recovered rows (interview_id, run_id, pos, t0, t1, text; a run_id for each gap) less those with a drop reason and those of gaps with a loop."""
    return judged_retries(recovered, prompt).where("not has_loop").drop("has_loop", "run_id")


def with_recovered(segments: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered rows put in by start, originals first on ties, then by position; renumbered."""
    rows = segments.withColumn("_source", F.lit(0)).unionByName(recovered.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    dense = renumbered(rows.withColumnRenamed("pos", "_old"), "pos", order=["t0", "_source", "_old"], bits=TIME_BITS)
    return dense.withColumn("pos", F.col("pos").cast("int")).drop("_source", "_old")


def cleaned(segments: DataFrame, prompt: str = STYLE_PROMPT, loop_retries: DataFrame | None = None, stretch_retries: DataFrame | None = None, recovered: DataFrame | None = None) -> DataFrame:
    """Q9: (interview_id, pos, start_ms, end_ms, text and words, if there are): loops (Q6), hallucinations (Q5), unpunctuated stretches (Q7), gaps (Q8), then times in ms.

    The recogniser's second attempts are tables, none where left out: loop_retries and
    stretch_retries with the first pos of their loop or stretch as run_id, at the positions of
    the step they belong to, and recovered rows of gaps, a run_id for each.
    """
    rows = checkpointed(loops_replaced(checkpointed(segments), loop_retries))
    rows = with_drop_reason(rows, prompt).where("reason is null").drop("reason")
    rows = renumbered(rows.withColumnRenamed("pos", "_old"), "pos", order="_old").drop("_old").withColumn("pos", F.col("pos").cast("int"))
    if stretch_retries is not None:
        rows = checkpointed(rows)
        ranges = checkpointed(unpunctuated_runs(rows).withColumn("run_id", F.col("first_pos")))
        rows = repaired(rows, ranges, stretch_retries.join(ranges.select("interview_id", "run_id"), ["interview_id", "run_id"], "left_semi"), prompt)
    if recovered is not None:
        rows = with_recovered(rows, accepted_recovered(recovered, prompt))
    return rows.select("interview_id", "pos", (F.col("t0") * 10).alias("start_ms"), (F.col("t1") * 10).alias("end_ms"), "text", *_words_of(rows))
