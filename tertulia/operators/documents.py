"""Read models: merged turns, paragraphs, rendered text, overlays of edits and lookups along the time axis.

Turns are (interview_id, pos, start_ms, end_ms, speaker, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.formats import MARKER, match_count
from tertulia.functions.text import ends_sentence, lines, single_line, trim
from tertulia.operators.folds import streamed
from tertulia.operators.ordered import filled, labelled, running

# Lines of a paragraph; limits of edits.
PARAGRAPH_MIN, PARAGRAPH_MAX = 4, 9
EDIT_BLOCKS, EDIT_BYTES = 20_000, 20_000
INTERVIEWER_LABEL, SUBJECT_LABEL = "Investigador", "Entrevistado"


def spoken(turns: DataFrame) -> DataFrame:
    """Turns with text, trimmed."""
    return turns.withColumn("text", trim("text")).where("text <> ''")


def flags(turns: DataFrame) -> DataFrame:
    """A10: (interview_id, has_speakers, has_timestamps)."""
    return turns.groupBy("interview_id").agg(F.bool_or(F.col("speaker").isNotNull()).alias("has_speakers"), F.bool_or(F.col("start_ms").isNotNull()).alias("has_timestamps"))


def _text(piece: str = "text") -> Column:
    """The texts of a group in order of pos, with single spaces."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece))), lambda x: x[piece]), " ")


def merged(turns: DataFrame) -> DataFrame:
    """Consecutive spoken turns of one speaker (null like null) as one block: (interview_id, block, start_ms, end_ms, speaker, n_turns, text).

    start is the first turn's, even if null; end the last one that is not null.
    """
    blocks = labelled(spoken(turns), F.col("speaker"), "block")
    end = F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), F.col("pos")))
    return blocks.groupBy("interview_id", "block").agg(F.min_by("start_ms", "pos").alias("start_ms"), end.alias("end_ms"), F.first("speaker").alias("speaker"), F.count("*").alias("n_turns"), _text().alias("text"))


def manual_blocks(turns: DataFrame) -> DataFrame:
    """W3 for edited transcripts: each spoken turn a block of its own."""
    return spoken(turns)


def label(role: Column, subject_type: Column) -> Column:
    """The reading label of a role; '' for null."""
    named = F.when(F.coalesce(trim(subject_type), F.lit("")) == "", SUBJECT_LABEL).otherwise(trim(subject_type))
    return F.when(role == "interviewer", INTERVIEWER_LABEL).when(role == "subject", named).otherwise("")


def rendered(turns: DataFrame, interviews: DataFrame, notice: DataFrame | None = None) -> DataFrame:
    """(interview_id, text) as plain text, a line for each block with its label, each turn a line where nobody has a role; a notice (interview_id, notice) first."""
    one_line = turns.withColumn("text", single_line("text"))
    known = flags(turns).select("interview_id", "has_speakers")
    plain = one_line.join(known.where(~F.col("has_speakers")), "interview_id", "left_semi").groupBy("interview_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("k"), "text"))).alias("_l"))
    labelled = merged(one_line.join(known.where("has_speakers"), "interview_id", "left_semi"))
    who = labelled.join(interviews.select(F.col("id").alias("interview_id"), "interview_subject_type"), "interview_id", "left")
    name = label(F.col("speaker"), F.col("interview_subject_type"))
    line = F.concat(F.when(name != "", F.concat(name, F.lit(": "))).otherwise(""), F.col("text"))
    blocks = who.groupBy("interview_id").agg(F.sort_array(F.collect_list(F.struct(F.col("block").cast("bigint").alias("k"), line.alias("text")))).alias("_l"))
    body = plain.unionByName(blocks).select("interview_id", F.concat(F.array_join("_l.text", "\n"), F.lit("\n")).alias("text"))
    if notice is None:
        return body
    with_notice = body.join(notice, "interview_id", "left")
    return with_notice.select("interview_id", F.concat(F.when(F.coalesce(F.col("notice"), F.lit("")) != "", F.concat("notice", F.lit("\n\n"))).otherwise(""), "text").alias("text"))


def _paragraph_fold():
    held: list[tuple] = []

    def close() -> list[tuple]:
        if not held:
            return []
        entity, first = held[0][0], held[0][1]
        ends = [h[3] for h in held if h[3] is not None]
        out = [(entity, first, held[0][2], ends[-1] if ends else None, len(held), " ".join(h[4] for h in held))]
        held.clear()
        return out

    def step(entity, pos, start, end, text, closes) -> list[tuple]:
        held.append((entity, pos, start, end, text))
        return close() if (len(held) >= PARAGRAPH_MIN and closes) or len(held) >= PARAGRAPH_MAX else []

    return step, close


def paragraphs(turns: DataFrame) -> DataFrame:
    """turns without speakers as paragraphs, closed from four lines on at a sentence end (or colon), always at nine."""
    ready = spoken(turns).withColumn("_c", ends_sentence("text", ".?!:")).withColumn("pos", F.col("pos").cast("bigint"))
    return streamed(ready, ["pos", "start_ms", "end_ms", "text", "_c"], "first_pos bigint, start_ms bigint, end_ms bigint, n_lines bigint, text string", _paragraph_fold)


LEGACY_LABEL = r"^([^:\[\]]{1,40}):\s+(.+)$"
# Labels of stored plain texts and the roles they stand for; how a notice begins.
LEGACY_ROLES = {INTERVIEWER_LABEL: "interviewer", SUBJECT_LABEL: "subject"}
NOTICE_PREFIX = "[AVISO"


def without_notice(texts: DataFrame, prefix: str = NOTICE_PREFIX) -> DataFrame:
    """Texts (interview_id, text) with the column notice: what stands before the first blank line of a text that begins with the prefix, trimmed; text is the rest, '' without a blank line. Else notice is null."""
    has = F.startswith("text", F.lit(prefix))
    at = F.instr("text", "\n\n")
    notice = F.when(has, trim(F.when(at > 0, F.substring(F.col("text"), F.lit(1), at - 1)).otherwise(F.col("text"))))
    body = F.when(~has, F.col("text")).when(at > 0, F.substring(F.col("text"), at + 2, F.length("text"))).otherwise("")
    return texts.select("*", notice.alias("notice"), body.alias("_body")).withColumn("text", F.col("_body")).drop("_body")


def legacy_lines(texts: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(interview_id, pos, line, label, said) of stored plain texts (interview_id, text), blank lines left out.

    label and said are null where a line does not start with a label. labels maps known labels,
    each directly before a colon, to what stands for them; without it any short beginning with a
    colon and a space is its own label.
    """
    each = texts.select("interview_id", F.posexplode(lines("text")).alias("pos", "line"))
    if labels is None:
        found = F.rlike("line", F.lit(LEGACY_LABEL))
        return each.withColumn("label", F.when(found, F.regexp_extract("line", LEGACY_LABEL, 1))).withColumn("said", F.when(found, F.regexp_extract("line", LEGACY_LABEL, 2)))
    head = F.substring_index("line", ":", 1)
    role = F.when(F.contains("line", F.lit(":")), F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[head])
    return each.withColumn("label", role).withColumn("said", F.when(F.col("label").isNotNull(), trim(F.substring(F.col("line"), F.length(head) + 2, F.length("line")))))


def label_share(texts: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(interview_id, n_lines, n_labelled, has_speakers): half of the lines labelled."""
    return legacy_lines(texts, labels).groupBy("interview_id").agg(F.count("*").alias("n_lines"), F.count("label").alias("n_labelled")).withColumn("has_speakers", F.col("n_labelled") * 2 >= F.col("n_lines"))


def legacy_blocks(texts: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(interview_id, block, speaker, text) of labelled texts: a line without a label goes to the block before it, or to one without a speaker; what is blank adds nothing."""
    marked = legacy_lines(texts, labels).join(label_share(texts, labels).where("has_speakers"), "interview_id", "left_semi")
    blocks = labelled(filled(marked, "label", "_who"), F.col("_who"), "block").withColumn("text", F.nullif(F.coalesce("said", "line"), F.lit("")))
    return blocks.groupBy("interview_id", "block").agg(F.first("_who").alias("speaker"), F.coalesce(_text(), F.lit("")).alias("text"))


def legacy_paragraphs(texts: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """unlabelled texts as paragraphs, without times."""
    marked = legacy_lines(texts, labels).join(label_share(texts, labels).where(~F.col("has_speakers")), "interview_id", "left_semi")
    none = F.lit(None).cast("bigint")
    return paragraphs(marked.select("interview_id", "pos", none.alias("start_ms"), none.alias("end_ms"), F.col("line").alias("text"))).select("interview_id", "first_pos", "n_lines", "text")


def serialized(blocks: DataFrame, headers: DataFrame, interviews: DataFrame) -> DataFrame:
    """(interview_id, value): the JSON of each document, blocks (interview_id, pos, speaker, start_ms, end_ms, text) in order with times in seconds.

    headers: (interview_id, speaker_source, edited, notice, summary). Flags are those of the
    blocks (A10); the two speakers have the labels of P14. A header without blocks has none.
    """
    second = lambda c: F.col(c) / 1000.0
    block = F.struct(F.col("pos").alias("p"), F.struct("speaker", second("start_ms").alias("start"), second("end_ms").alias("end"), "text").alias("b"))
    nested = blocks.groupBy("interview_id").agg(F.sort_array(F.collect_list(block)).alias("_b"), F.bool_or(F.col("speaker").isNotNull()).alias("_s"), F.bool_or(F.col("start_ms").isNotNull()).alias("_t"))
    whole = headers.join(nested, "interview_id", "left").join(interviews.select(F.col("id").alias("interview_id"), F.col("interview_subject_type").alias("_type")), "interview_id", "left")
    named = lambda role: F.struct(F.lit(role).alias("key"), label(F.lit(role), F.col("_type")).alias("label"))
    body = F.struct(
        F.col("interview_id").alias("id"), F.coalesce("_s", F.lit(False)).alias("has_speakers"), F.coalesce("_t", F.lit(False)).alias("has_timestamps"), "speaker_source", "edited", "notice", "summary",
        F.array(named("interviewer"), named("subject")).alias("speakers"), F.coalesce(F.col("_b.b"), F.array().cast("array<struct<speaker:string,start:double,end:double,text:string>>")).alias("blocks"),
    )
    return whole.select("interview_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def overlaid(edited: DataFrame, pipeline: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """The rows of the edited version where an interview has one, else of the pipeline, else of the legacy text; source tells which."""
    parts, seen = [edited.withColumn("source", F.lit("edited"))], edited.select("interview_id").distinct()
    for name, rows in (("pipeline", pipeline), ("legacy", legacy)):
        if rows is not None:
            parts.append(rows.join(seen, "interview_id", "left_anti").withColumn("source", F.lit(name)))
            seen = seen.unionByName(rows.select("interview_id").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def edit_faults(blocks: DataFrame) -> DataFrame:
    """P5: (interview_id, pos, fault) of the first block (interview_id, pos, speaker, start, end, text) that may not be saved; of too many or only blank blocks pos is null.

    fault: too_many, too_long, control_char, unknown_speaker, bad_times or empty. Valid edits give no row.
    """
    t = trim("text")
    bad_time = (F.col("start") < 0) | (F.col("end") < 0) | (F.col("start") > F.col("end"))
    fault = (
        F.when(F.octet_length(t) > EDIT_BYTES, "too_long").when(F.rlike(t, F.lit(r"[\x00-\x08\x0B-\x1F\x7F]")), "control_char")
        .when((F.col("speaker") != "") & ~F.col("speaker").isin("interviewer", "subject"), "unknown_speaker").when(F.coalesce(bad_time, F.lit(False)), "bad_times")
    )
    judged = blocks.withColumn("_t", t).withColumn("_f", F.when(F.col("_t") != "", fault))
    per = judged.groupBy("interview_id").agg(F.count("*").alias("_n"), F.count_if(F.col("_t") != "").alias("_s"), F.min(F.when(F.col("_f").isNotNull(), F.struct("pos", "_f"))).alias("_w"))
    found = F.when(F.col("_n") > EDIT_BLOCKS, "too_many").otherwise(F.coalesce("_w._f", F.when(F.col("_s") == 0, "empty")))
    return per.select("interview_id", F.when(F.col("_n") <= EDIT_BLOCKS, F.col("_w.pos")).alias("pos"), found.alias("fault")).where("fault is not null")


def to_ms(seconds: str) -> Column:
    """Seconds as ms, halves away from zero."""
    return F.round(F.col(seconds) * 1000).cast("bigint")


def saved_edits(blocks: DataFrame) -> DataFrame:
    """P5: blocks of valid edits as turns of a manual transcript, blank ones left out."""
    good = blocks.join(edit_faults(blocks).select("interview_id"), "interview_id", "left_anti").withColumn("text", trim("text")).where("text <> ''")
    return good.select("interview_id", "pos", to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"), F.when(F.col("speaker") != "", F.col("speaker")).alias("speaker"), "text")


def swapped(turns: DataFrame) -> DataFrame:
    """The two roles exchanged, null stays."""
    return turns.withColumn("speaker", F.when(F.col("speaker") == "interviewer", "subject").when(F.col("speaker") == "subject", "interviewer"))


def changed(draft: DataFrame, original: DataFrame) -> DataFrame:
    """Interviews whose draft differs from the original: some row, repeats counted, is not as often in the one as in the other.

    Rows are compared by a hash of 256 bits of their JSON, so texts do not shuffle, and equal
    rows are taken off against each other before they do.
    """
    row = F.to_json(F.struct(*(F.col(c) for c in original.columns)), {"ignoreNullFields": "false"})
    side = lambda df, n: df.select("interview_id", F.sha2(row, 256).alias("_h"), F.lit(n).alias("_n"))
    counts = side(draft, 1).unionByName(side(original, -1)).groupBy("interview_id", "_h").agg(F.sum("_n").alias("_n"))
    return counts.where("_n <> 0").select("interview_id").distinct()


def effective_starts(blocks: DataFrame) -> DataFrame:
    """Column start_eff, the block's start or the last one before it."""
    return filled(blocks, "start_ms", "start_eff")


def active_blocks(blocks: DataFrame, times: DataFrame) -> DataFrame:
    """(interview_id, time_ms, first_pos, last_pos) of the blocks heard at each time: the last start not after it, with the blocks that share it.

    Starts must rise with pos. Times before the first start have no row. Both sides meet along
    one sorted time axis, so no pair of a time and an earlier block is made.
    """
    groups = effective_starts(blocks).where("start_eff is not null").groupBy("interview_id", "start_eff").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    marks = groups.select("interview_id", (F.col("start_eff") * 2).alias("_o"), F.struct("start_eff", "first_pos", "last_pos").alias("_g"), F.lit(None).cast("bigint").alias("time_ms"))
    asks = times.select("interview_id", (F.col("time_ms") * 2 + 1).alias("_o"), F.lit(None).cast(marks.schema["_g"].dataType).alias("_g"), F.col("time_ms").cast("bigint").alias("time_ms"))
    swept = running(marks.unionByName(asks), F.col("_g"), "_now", F.max, order="_o", bits=21)
    return swept.where("time_ms is not null and _now is not null").select("interview_id", "time_ms", "_now.first_pos", "_now.last_pos").distinct()


def match_counts(blocks: DataFrame, needle: str, text: str = "text", summaries: DataFrame | None = None) -> DataFrame:
    """(interview_id, n_matches) over the blocks and, where given, summaries (interview_id, summary); a match does not cross blocks."""
    if summaries is not None:
        blocks = blocks.select("interview_id", text).unionByName(summaries.select("interview_id", F.coalesce("summary", F.lit("")).alias(text)))
    return blocks.groupBy("interview_id").agg(F.sum(match_count(text, needle)).cast("bigint").alias("n_matches"))


def marker_counts(blocks: DataFrame, text: str = "text") -> DataFrame:
    """(interview_id, n_markers): anonymisation markers such as [PERSONA_1]."""
    return blocks.groupBy("interview_id").agg(F.sum(F.regexp_count(F.col(text), F.lit(MARKER))).cast("bigint").alias("n_markers"))


def disclaimer(source: Column, edited: Column) -> Column:
    """Which note on speakers the reading view shows."""
    return F.when(edited, "edited").when(source == "manual", "manual").when(source == "diarization", "diarization").when(source == "llm", "llm").otherwise("none")


def _edit_fold():
    blocks: list[list] = []
    passed = 0  # blocks of a transcript too long to be edited, which are handed on as they come

    def step(entity, seq, op, pos, at, start, end, speaker, text) -> list[tuple]:
        nonlocal passed
        if op == "row":
            blocks.append([entity, start, end, speaker, text or ""])
            if len(blocks) > EDIT_BLOCKS or passed:
                out = [(b[0], passed + k, *b[1:]) for k, b in enumerate(blocks)]
                passed += len(blocks)
                blocks.clear()
                return out
        elif op == "split" and pos < len(blocks):
            b = blocks[pos]
            first, second = b[4][:at].strip(), b[4][at:].strip()
            if first and second:
                blocks[pos : pos + 1] = [[b[0], b[1], None, b[3], first], [b[0], None, b[2], b[3], second]]
        elif op == "merge" and 0 < pos < len(blocks):
            a, b = blocks[pos - 1], blocks[pos]
            a[4], a[2] = f"{a[4].strip()} {b[4].strip()}".strip(), b[2] if b[2] is not None else a[2]
            del blocks[pos]
        elif op == "remove" and pos < len(blocks):
            del blocks[pos]
        return []

    return step, lambda: [(b[0], k, *b[1:]) for k, b in enumerate(blocks)]


def edited_blocks(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """blocks after an edit log (interview_id, seq, op, pos, at): split at a character, merge with the block before, remove.

    Edits that name a block which is not there do nothing, nor does a split that leaves one side
    blank. Transcripts of more than EDIT_BLOCKS blocks may not be saved (P5): they come out
    unedited, so a task holds no more than those of one interview.
    """
    none = lambda t: F.lit(None).cast(t)
    rows = blocks.select("interview_id", (F.col("pos").cast("bigint") - 2**40).alias("seq"), F.lit("row").alias("op"), F.col("pos").cast("int").alias("pos"), none("int").alias("at"), "start_ms", "end_ms", "speaker", "text")
    edits = log.select("interview_id", F.col("seq").cast("bigint").alias("seq"), "op", F.col("pos").cast("int").alias("pos"), F.col("at").cast("int").alias("at"), none("bigint").alias("start_ms"), none("bigint").alias("end_ms"), none("string").alias("speaker"), none("string").alias("text"))
    return streamed(rows.unionByName(edits), ["seq", "op", "pos", "at", "start_ms", "end_ms", "speaker", "text"], "pos int, start_ms bigint, end_ms bigint, speaker string, text string", _edit_fold, order=["seq"])
