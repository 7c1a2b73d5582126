"""Text transforms that take a language model's answers as tables: glossary, correction, anonymisation, summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.functions.formats import entity_line, indexed_line, plausible_correction
from tertulia.functions.text import count_whole_words, lines, lower_ascii, plausible_pair, replace_whole_words, trim
from tertulia.operators.folds import streamed

# Block sizes in rows, limits in bytes.
GLOSSARY_BLOCK, CORRECTION_BLOCK, CONTINUITY_LINES = 40, 60, 3
TERM_BYTES, CHUNK_BYTES = 80, 3_000


def canonical_terms(glossary: DataFrame) -> DataFrame:
    """(interview_id, key, term): the first form of each term in any ASCII case."""
    keyed = glossary.select("interview_id", lower_ascii("term").alias("key"), F.struct("pos", "term").alias("_p"))
    return keyed.groupBy("interview_id", "key").agg(F.min("_p").alias("_p")).select("interview_id", "key", F.col("_p.term").alias("term"))


def accepted_proposals(segments: DataFrame, glossary: DataFrame, proposals: DataFrame) -> DataFrame:
    """L2: proposals (interview_id, block, pos, original, term) worth applying, with the canonical term.

    The term is in the glossary, the original is not empty, of at most TERM_BYTES, not the term,
    no term itself, sounds like it, and stands in the block as a whole word. Repeats in a block count once.
    """
    known = canonical_terms(glossary)
    named = proposals.withColumn("key", lower_ascii("term")).withColumn("original", trim("original")).drop("term").join(known, ["interview_id", "key"])
    fit = named.where((F.col("original") != "") & (F.octet_length("original") <= TERM_BYTES) & (F.col("original") != F.col("term")) & plausible_pair("original", "term"))
    free = fit.drop("key").withColumn("key", lower_ascii("original")).join(known.select("interview_id", "key"), ["interview_id", "key"], "left_anti").drop("key")
    first = free.groupBy("interview_id", "block", "original").agg(F.min(F.struct("pos", "term")).alias("_p")).select("interview_id", "block", "original", "_p.*")
    texts = segments.select("interview_id", F.floor(F.col("pos") / GLOSSARY_BLOCK).cast("int").alias("block"), "text")
    found = texts.join(first, ["interview_id", "block"]).where(count_whole_words("text", "original") > 0)
    return first.join(found.select("interview_id", "block", "original").distinct(), ["interview_id", "block", "original"], "left_semi")


def glossary_applied(segments: DataFrame, accepted: DataFrame) -> DataFrame:
    """Segments with the accepted proposals of their block put in, longest original first (O6), each seeing what the ones before left; changes is the array of (line, original, term)."""
    longest = F.sort_array(F.collect_list(F.struct((-F.octet_length("original")).alias("n"), "original", "term")))
    lists = accepted.groupBy("interview_id", "block").agg(longest.alias("_p"))
    joined = segments.withColumn("block", F.floor(F.col("pos") / GLOSSARY_BLOCK).cast("int")).join(lists, ["interview_id", "block"], "left")
    start = F.struct(F.col("text").alias("text"), F.array().cast("array<struct<line:bigint,original:string,term:string>>").alias("changes"))

    def one(acc: Column, p: Column) -> Column:
        change = F.struct((F.col("pos").cast("bigint") + 1).alias("line"), p["original"].alias("original"), p["term"].alias("term"))
        hit = count_whole_words(acc["text"], p["original"]) > 0
        return F.struct(replace_whole_words(acc["text"], p["original"], p["term"]).alias("text"), F.when(hit, F.concat(acc["changes"], F.array(change))).otherwise(acc["changes"]).alias("changes"))

    done = joined.withColumn("_d", F.aggregate(F.coalesce("_p", F.array().cast(lists.schema["_p"].dataType)), start, one))
    return done.withColumn("text", F.col("_d.text")).withColumn("changes", F.col("_d.changes")).drop("_d", "_p", "block")


def change_log(applied: DataFrame) -> DataFrame:
    """L3: (interview_id, line, original, term)."""
    return applied.select("interview_id", F.explode("changes").alias("c")).select("interview_id", "c.*")


def change_report(log: DataFrame) -> DataFrame:
    """(interview_id, text) listing each change on a line."""
    row = F.format_string("linea %d: %s -> %s", "line", "original", "term")
    return log.groupBy("interview_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", row.alias("r")))), lambda x: x["r"]), "\n").alias("text"))


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Rows with chunk and idx, the block of so many rows and the 1-based place in it."""
    return rows.withColumn("chunk", F.floor(F.col("pos") / size).cast("int")).withColumn("idx", (F.col("pos") % size + 1).cast("int"))


def corrected_turns(turns: DataFrame, responses: DataFrame) -> DataFrame:
    """Turns with the answer for their place where it is plausible; responses (interview_id, chunk, pos, line), the first for a place wins."""
    parsed = responses.withColumn("_l", indexed_line("line")).where("_l is not null")
    first = parsed.groupBy("interview_id", "chunk", F.col("_l.idx").alias("idx")).agg(F.min_by("_l.text", "pos").alias("_new"))
    joined = blocks_of(turns, CORRECTION_BLOCK).join(first, ["interview_id", "chunk", "idx"], "left")
    good = F.col("_new").isNotNull() & plausible_correction("text", "_new")
    return joined.withColumn("corrected", F.coalesce(good, F.lit(False))).withColumn("text", F.when(F.col("corrected"), F.col("_new")).otherwise(F.col("text"))).drop("chunk", "idx", "_new")


def continuity(turns: DataFrame, size: int = CORRECTION_BLOCK) -> DataFrame:
    """(interview_id, chunk, context): the last lines of the block before."""
    placed = blocks_of(turns, size).where(F.col("idx") > size - CONTINUITY_LINES)
    tail = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return placed.groupBy("interview_id", (F.col("chunk") + 1).alias("chunk")).agg(tail.alias("context"))


def _chunk_fold():
    state = {"chunk": 0, "size": 0}

    def step(entity, pos, size) -> list[tuple]:
        if state["size"] > 0 and state["size"] + size + 1 > CHUNK_BYTES:
            state.update(chunk=state["chunk"] + 1, size=0)
        state["size"] += size + 1
        return [(entity, pos, state["chunk"])]

    return step, lambda: []


def text_chunks(rows: DataFrame) -> DataFrame:
    """(interview_id, chunk, text): lines packed in order up to CHUNK_BYTES with a line feed each; a longer line is a chunk of its own."""
    line = rows.select("interview_id", F.col("pos").cast("bigint").alias("pos"), trim("text").alias("text")).where("text <> ''")
    placed = streamed(line.withColumn("_n", F.octet_length("text").cast("bigint")), ["pos", "_n"], "pos bigint, chunk int", _chunk_fold)
    joined = line.join(placed, ["interview_id", "pos"])
    return joined.groupBy("interview_id", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def entities_of(answers: DataFrame) -> DataFrame:
    """(interview_id, chunk, pos, text, type) of model answers (interview_id, chunk, text), lines ENTITY|TYPE."""
    each = answers.select("interview_id", "chunk", F.posexplode(lines("text")).alias("pos", "line")).withColumn("_e", entity_line("line"))
    return each.where("_e is not null").select("interview_id", "chunk", "pos", F.col("_e.text").alias("text"), F.col("_e.type").alias("type"))


def placeholders(entities: DataFrame) -> DataFrame:
    """(interview_id, original, type, placeholder): each entity once in any ASCII case, the first form kept, numbered by type in order of the lower-case form."""
    first = entities.groupBy("interview_id", lower_ascii("text").alias("key")).agg(F.min(F.struct("chunk", "pos", "text", "type")).alias("_e"))
    number = F.row_number().over(Window.partitionBy("interview_id", "_e.type").orderBy("key"))
    return first.select("interview_id", F.col("_e.text").alias("original"), F.col("_e.type").alias("type"), F.concat(F.lit("["), F.col("_e.type"), F.lit("_"), number, F.lit("]")).alias("placeholder"))


def anonymized(rows: DataFrame, entities: DataFrame, mode: str = "compat") -> DataFrame:
    """Texts with each entity replaced, longest first; mode 'compat' also within words, 'whole_word' not."""
    subs = placeholders(entities).groupBy("interview_id").agg(F.sort_array(F.collect_list(F.struct((-F.octet_length("original")).alias("n"), "original", "placeholder"))).alias("_s"))
    joined = rows.join(subs, "interview_id", "left")
    swap = (lambda t, s: F.replace(t, s["original"], s["placeholder"])) if mode == "compat" else (lambda t, s: replace_whole_words(t, s["original"], s["placeholder"]))
    return joined.withColumn("text", F.aggregate(F.coalesce("_s", F.array().cast(subs.schema["_s"].dataType)), F.col("text"), swap)).drop("_s")


def answered(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """L1 by table: prompts with the stored answer for their text, null if there is none."""
    return prompts.join(responses.select(F.col("prompt").alias("text"), "answer"), "text", "left")


def chat(prompts: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """L1 by a client that is built from plain Python: answer for each prompt (id, text), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "answer": [client(t) for t in b["text"]]})

    return prompts.select("id", "text").mapInPandas(run, "id string, answer string")


def summarized(chunks: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """(interview_id, summary): the answer for each chunk, and where there are several the answer for those answers."""
    parts = chat(chunks.select(F.concat_ws("/", "interview_id", "chunk").alias("id"), "text"), client)
    named = parts.select(F.split("id", "/")[0].cast("int").alias("interview_id"), F.split("id", "/")[1].cast("int").alias("chunk"), "answer")
    joined = named.groupBy("interview_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "answer"))), lambda x: x["answer"]), "\n").alias("text"))
    single = joined.where("n = 1").select("interview_id", F.col("text").alias("summary"))
    reduced = chat(joined.where("n > 1").select(F.col("interview_id").cast("string").alias("id"), "text"), client)
    return single.unionByName(reduced.select(F.col("id").cast("int").alias("interview_id"), F.col("answer").alias("summary")))


def first_sentence(text: str) -> str:
    """A stand-in for a summarising model: everything up to the first sentence end."""
    ends = [k for k in (text.find(m) for m in ".?!") if k >= 0]
    return text[: min(ends) + 1] if ends else text


def phase_outcomes(requests: DataFrame, failures: DataFrame) -> DataFrame:
    """(interview_id, correction, anonymization, summary) of requests (interview_id, enhance, include_summary) and failed phases (interview_id, phase).

    A failed correction ends the run as 'error'; after a failed anonymisation there is no summary.
    """
    failed = failures.groupBy("interview_id").agg(F.collect_set("phase").alias("_f"))
    joined = requests.join(failed, "interview_id", "left").withColumn("_f", F.coalesce("_f", F.array().cast("array<string>")))
    has = lambda p: F.array_contains("_f", p)
    correction = F.when(~F.col("enhance"), "skipped").when(has("correction"), "error").otherwise("done")
    anonymization = F.when(correction != "done", "skipped").when(has("anonymization"), "failed").otherwise("done")
    summary = F.when(~F.col("include_summary") | (correction == "error") | (anonymization == "failed"), "skipped").when(has("summary"), "failed").otherwise("done")
    return joined.select("interview_id", correction.alias("correction"), anonymization.alias("anonymization"), summary.alias("summary"))
