"""Typed and imported transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tertulia.llm.roles import RoleReader, with_subject_types
from tertulia.operators.intervals import CHUNK_BITS, CHUNK_KEY, chunk_of, keyed, with_carry
from tertulia.session import checkpointed

#: A chunk of positions has 4,096 at most.
POS_BITS = 12
#: Words that the end of one row and the start of the next must share to count as a repeated caption.
OVERLAP_WORDS = 3

_CLOCK = r"(\d{1,3}(?::\d{2}){1,2})(?:[.,](\d{1,3}))?"
_ARROW = r"(?:\s*(?:-->|-|–)(?=\s|$))?"
BOXED_MARK = re.compile(rf"[\[({{<#]\s*(?:min\.?\s+)?{_CLOCK}\s*[\])}}>#]{_ARROW}")
FIRST_MARK = re.compile(rf"\s*(?:min\.?\s+)?{_CLOCK}{_ARROW}(?=\s|$)", re.I)
LAST_MARK = re.compile(rf"(?:^|(?<=\s))(min\.?\s+)?{_CLOCK}(\s*(?:-->|-))?\s*$", re.I)
SPOKEN_CLOCK = re.compile(r"\blas?[\s,.]*$", re.I)

# Words of which one stands in a sound annotation in round brackets.
SOUNDS = "tos tose tosen llora lloran llanto ríe rie ríen risa risas suspira suspiro suena suenan ladra ladran ladrido ladridos golpe golpes ruido ruidos silencio pausa música inaudible ininteligible aplausos carraspea interrupción interrumpe murmullo susurra grita timbre teléfono celular bocina"
_SOUND = "|".join(SOUNDS.split())
ANNOTATION = re.compile(
    rf"\(\([^()]*\)\)|<<[^<>]*>>|<[^<>]{{1,60}}>|\{{[^{{}}]{{1,60}}\}}|\*[^*\n]{{1,60}}\*|♪[^♪\n]{{0,60}}♪|♪|\((?=[^()]{{0,60}}\b(?:{_SOUND})\b)[^()]{{1,60}}\)|\[(?!(?-i:[A-ZÁÉÍÓÚÑ]+_[A-ZÁÉÍÓÚÑ0-9_]+)\])[^\[\]]{{1,60}}\]",
    re.I,
)
HESITATION = re.compile(r"(?<!\w)(?:e+h+m*|e+m+|m{2,}|h+m+|u+h*m+|u+h+)(?!\w)(?:\.\.\.|…)?,?", re.I)
FILLER = re.compile(r"(?<!\w)(?:¿cach[áa]i\?,?|(?:este|digamos|o sea)(?:(?:\.\.\.|…),?|,))(?=\s|$)", re.I)
# a label ahead of the text: <X>, [X], **X:**, X>>, X.-, X: or X -
LABEL = re.compile(r"\s*(?:<([^<>\n]{1,40})>|\[([^\[\]\n]{1,40})\]|\*\*([^*\n]{1,40}?):?\*\*:?|([^\W\d_][^:<>\[\]\n*]{0,38}?)\s*(?:>>|\.-|:|\s-(?=\s)))")


def _ms(clock: str, part: str | None) -> int:
    seconds = 0
    for x in clock.split(":"):
        seconds = seconds * 60 + int(x)
    return seconds * 1000 + (int(part.ljust(3, "0")) if part else 0)


def read_row(text: str | None, reader: RoleReader) -> tuple[int | None, str | None, str, bool]:
    """(time mark, role of the label, readable text, whether it is speech) of one row's text.

    Labels, time marks and annotations ahead of the speech are taken in any order; a time mark
    may also stand in brackets anywhere or bare at the end, unless it is a time of day that is
    spoken of ("a las 12:30").
    """
    text, at, role = text or "", None, None

    def boxed(m: re.Match) -> str:
        nonlocal at
        at = _ms(m[1], m[2]) if at is None else at
        return " "

    text = BOXED_MARK.sub(boxed, text)
    while True:
        if m := FIRST_MARK.match(text):
            at = _ms(m[1], m[2]) if at is None else at
            text = text[m.end() :]
            continue
        if role is None and (m := LABEL.match(text)) and (found := reader.role(m[1] or m[2] or m[3] or m[4])):
            role, text = found, text[m.end() :]
            continue
        bare = text.lstrip()
        if (m := ANNOTATION.match(bare)) or (m := HESITATION.match(bare)):
            rest = bare[m.end() :]
            if FIRST_MARK.match(rest) or (role is None and (n := LABEL.match(rest)) and reader.role(n[1] or n[2] or n[3] or n[4])):
                text = rest
                continue
        break
    text = ANNOTATION.sub(" ", text)
    if m := LAST_MARK.search(text):
        ahead = FILLER.sub(" ", HESITATION.sub(" ", text[: m.start()]))
        if m[1] or m[4] or m[2].count(":") == 2 or not SPOKEN_CLOCK.search(re.sub(r"\b(?:este|digamos|o sea)\s*$", "", ahead.rstrip())):
            at = _ms(m[2], m[3]) if at is None else at
            text = text[: m.start()]
    text = HESITATION.sub(" ", text)
    speech = any(c.isalnum() for c in text)
    text = FILLER.sub(" ", text)
    text = re.sub(r"\s+([,.;:?!…])", r"\1", re.sub(r"\s+", " ", text)).strip(" ,")
    return at, role, text, speech


_ROW_DDL = "interview_id int, pos bigint, at bigint, end_ms bigint, role string, text string"
_ROW = pa.schema([("interview_id", pa.int32()), ("pos", pa.int64()), ("at", pa.int64()), ("end_ms", pa.int64()), ("role", pa.string()), ("text", pa.string())])


@functools.lru_cache(maxsize=50_000)
def _reader(types: tuple[str, ...]) -> RoleReader:
    return RoleReader(types)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: list[list] = [[] for _ in _ROW]
        for i, pos, start, end, speaker, text, types in zip(*(c.to_pylist() for c in b.columns)):
            reader = _reader(tuple(types or ()))
            at, role, clean, speech = read_row(text, reader)
            if speech:
                row = (i, pos, at if start is None else start, end, reader.role(speaker, 2) or role, clean)
                for column, x in zip(found, row):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _ROW)], schema=_ROW)


def speech_rows(rows: DataFrame, interviews: DataFrame, bits: int = POS_BITS) -> DataFrame:
    """(interview_id, pos, at, end_ms, role, text): the rows with speech, cleaned, each (interview_id, pos) once."""
    plain = rows.where(F.col("interview_id").isNotNull() & F.col("pos").isNotNull() & F.col("text").isNotNull()).select(
        F.col("interview_id").cast("int"), F.col("pos").cast("bigint"), F.col("start_ms").cast("bigint"), F.col("end_ms").cast("bigint"), "speaker", "text", chunk_of("pos", bits).alias("chunk")
    )
    typed = with_subject_types(plain, interviews, "chunk").select("interview_id", "pos", "start_ms", "end_ms", "speaker", "text", "types")
    once = typed.mapInArrow(_read, _ROW_DDL).groupBy("interview_id", "pos").agg(F.min(F.struct("at", "end_ms", "role", "text")).alias("_r"))
    return once.select("interview_id", "pos", "_r.*")


def anchored_rows(spoken: DataFrame, bits: int = POS_BITS) -> DataFrame:
    """speech_rows() by the time and anchor, the pos, of the row they follow: a row without a time has those of the last row by pos that has one, null and -1 without any."""
    timed = F.when(F.col("at").isNotNull(), F.struct("at", F.col("pos").alias("anchor")))
    within = Window.partitionBy(CHUNK_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    by_chunk = spoken.withColumn("_pc", chunk_of("pos", bits))
    carried = with_carry(by_chunk, ["interview_id"], "_pc", {"last_timed": F.max_by(timed, F.when(F.col("at").isNotNull(), F.col("pos")))}, {"_before": F.last("last_timed", True)})
    anchored = carried.withColumn("_a", F.coalesce(F.last(timed, True).over(within), F.col("_before")))
    return anchored.select("interview_id", "pos", F.col("_a.at").alias("at"), F.coalesce("_a.anchor", F.lit(-1)).alias("anchor"), "end_ms", "role", "text")


def swept_rows(anchored: DataFrame, pause_ms: int | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """anchored_rows() in order of (at, anchor, pos), with role filled from the row before, _prev, the text and _gap, the time since the row before, _opens, whether a turn begins with it, and turn, that turn's number.

    Rows before any time come first. A turn begins where the role changes and, with pause_ms,
    where more time than that has passed. One summary row a chunk of time is carried on: its
    first and last known role, its last time and text, and how many turns begin in it for
    certain; what comes in then tells whether turns begin with its first row and its first known role.
    """
    entity, place = "interview_id", F.struct("at", "anchor", "pos")
    rows = keyed(anchored.withColumn("chunk", chunk_of("at", bits)), [entity], "chunk")
    order = Window.partitionBy(CHUNK_KEY).orderBy("at", "anchor", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    paused = lambda now, before: F.coalesce(now - before > pause_ms, F.lit(False)) if pause_ms is not None else F.lit(False)
    told = rows.withColumn("_role", F.last("role", True).over(upto)).withColumn("_n", F.row_number().over(order))
    seen = told.withColumns({"_was": F.lag("_role").over(order), "_at": F.lag("at").over(order), "_prev": F.lag("text").over(order)})
    inner = F.col("_n") > 1
    long = inner & paused(F.col("at"), F.col("_at"))
    known_first = inner & F.col("_role").isNotNull() & F.col("_was").isNull()
    sure = long | (inner & F.col("_was").isNotNull() & (F.col("_role") != F.col("_was")))
    flagged = seen.withColumns({"_sure": F.coalesce(sure, F.lit(False)), "_first_known": known_first & ~long})
    each = flagged.groupBy(CHUNK_KEY).agg(
        F.min_by("role", F.when(F.col("role").isNotNull(), place)).alias("a"), F.max_by("role", F.when(F.col("role").isNotNull(), place)).alias("z"), F.count_if("_sure").alias("n"), F.bool_or("_first_known").alias("later"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("text", place).alias("last_text"),
    )
    along = Window.partitionBy(F.col(f"{CHUNK_KEY}.{entity}")).orderBy(F.col(f"{CHUNK_KEY}.chunk"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    came = each.withColumns({"_in": F.last("z", True).over(earlier), "_in_at": F.last("last_at").over(earlier), "_in_text": F.last("last_text").over(earlier), "_start": F.row_number().over(along) == 1})
    changes = F.col("a").isNotNull() & ~F.col("a").eqNullSafe(F.col("_in"))
    head = F.col("_start") | paused(F.col("first_at"), F.col("_in_at")) | (changes & ~F.col("later"))
    total = F.col("n") + head.cast("bigint") + (changes & F.col("later")).cast("bigint")
    carry = came.withColumn("_total", total).withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).withColumn("_head", head)
    both = flagged.join(carry.select(CHUNK_KEY, "_in", "_in_at", "_in_text", "_offset", "_head", "_start"), CHUNK_KEY, "left")
    opens = F.when(~inner, F.col("_head")).otherwise(F.col("_sure") | (F.col("_first_known") & ~F.col("_role").eqNullSafe(F.col("_in"))))
    out = both.withColumns({"_opens": opens.cast("bigint"), "role": F.coalesce("_role", "_in"), "_gap": F.col("at") - F.when(inner, F.col("_at")).otherwise(F.col("_in_at")), "_prev": F.when(inner, F.col("_prev")).otherwise(F.col("_in_text"))})
    return out.withColumn("turn", F.col("_offset") + F.sum("_opens").over(upto)).select(entity, "pos", "at", "anchor", "end_ms", "role", "text", "_prev", "_gap", "_opens", "turn")


def ordered_rows(rows: DataFrame, interviews: DataFrame, pause_ms: int | None = None, bits: int = POS_BITS, time_bits: int = CHUNK_BITS) -> DataFrame:
    """swept_rows() of the rows with speech. Rows are parsed once: what is read of them is written to the checkpoint folder."""
    return swept_rows(anchored_rows(checkpointed(speech_rows(rows, interviews, bits)), bits), pause_ms, time_bits)


def turn_starts(rows: DataFrame, interviews: DataFrame, pause_ms: int | None = None, **bits: int) -> DataFrame:
    """(interview_id, start_ms, speaker): one row for each clean turn.

    Rows without interview_id, pos or text stay out; duplicates of (interview_id, pos) that
    differ count as the least of them; times that tie keep the order of pos; an empty table
    gives no rows; other columns are ignored. A turn before any known time has start_ms null,
    one before any known role speaker null.
    """
    opening = ordered_rows(rows, interviews, pause_ms, **bits).where("_opens = 1")
    return opening.select("interview_id", F.col("at").alias("start_ms"), F.col("role").alias("speaker"))


def without_overlap(before: str | None, text: str) -> str:
    """text less the words at its start that repeat the end of the row before it.

    Only a suffix of before that is a prefix of text counts, compared in lower case without
    punctuation, of at least OVERLAP_WORDS words.
    """
    if not before:
        return text
    flat = lambda w: "".join(c for c in w.lower() if c.isalnum())
    words = text.split()
    new = [flat(w) for w in words]
    fall, n = [0] * len(new), 0  # of each prefix of new, the longest shorter one that it ends with
    for k in range(1, len(new)):
        while n and new[k] != new[n]:
            n = fall[n - 1]
        n = fall[k] = n + (new[k] == new[n])
    n = 0
    for w in map(flat, before.split()):
        while n and (n == len(new) or w != new[n]):
            n = fall[n - 1]
        n += bool(new) and w == new[n]
    if n >= OVERLAP_WORDS:
        return " ".join(words[n:])
    return text


def clean_turns(rows: DataFrame, interviews: DataFrame, pause_ms: int | None = None, **bits: int) -> DataFrame:
    """(interview_id, turn, start_ms, end_ms, speaker, n_rows, text): the turns of turn_starts() with their text.

    Within a turn each row's words that repeat the end of the row before it are taken out.
    end_ms is the greatest known end, null if there is none.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *kept, old, new, opens = b.columns
            text = [n if o else without_overlap(p, n) for p, n, o in zip(old.to_pylist(), new.to_pylist(), opens.to_pylist())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string())], names=_KEPT)

    kinds = "interview_id int, turn bigint, at bigint, anchor bigint, pos bigint, end_ms bigint, role string, text string"
    ready = ordered_rows(rows, interviews, pause_ms, **bits).select(*_KEPT[:-1], "_prev", "text", "_opens")
    parts = ready.mapInArrow(strip, kinds).groupBy("interview_id", "turn").agg(
        F.min(F.struct("at", "anchor", "pos"))["at"].alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("role").alias("speaker"), F.count("*").alias("n_rows"),
        F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("at", "anchor", "pos", "text")))).alias("_t"),
    )
    return parts.withColumn("text", F.array_join("_t.text", " ")).drop("_t")


_KEPT = ["interview_id", "turn", "at", "anchor", "pos", "end_ms", "role", "text"]


def calibrated_pause(rows: DataFrame, interviews: DataFrame, quantile: float = 0.99, least_ms: int = 3_000, **bits: int) -> DataFrame:
    """(pause_ms): the quantile of the times between successive rows of one turn, at least least_ms; null without any.

    For turn_starts() and clean_turns(), where turns shall also end at long silences.
    """
    gaps = ordered_rows(rows, interviews, **bits).where("_opens = 0 and _gap is not null").select(F.col("_gap").alias("gap"))
    return gaps.agg(F.greatest(F.percentile_approx("gap", quantile), F.lit(least_ms)).alias("pause_ms"))
