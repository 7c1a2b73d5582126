"""Formats for people and parsers of small text forms, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tertulia.functions.text import col, trim

# Spanish month names.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
DATE = r"^(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}):(\d{2}))?"
# What counts as white space when texts are trimmed for reading.
WHITE = " \t\n\r\v\f\u00a0\ufeff\u2028\u2029"
MARKER = r"\[[A-ZÁÉÍÓÚÑ]+(?:_[A-ZÁÉÍÓÚÑ0-9]+)*\]"


def spanish_date(value: str | Column) -> Column:
    """X1: '2026-08-24 14:30:00' as '24 de agosto de 2026, 14:30 hs'; the time may lack, other text comes back unchanged."""
    v = col(value)
    part = lambda n: F.regexp_extract(v, DATE, n)
    month = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.expr("1") * part(2).try_cast("int"))
    day = F.concat(part(3).try_cast("int").cast("string"), F.lit(" de "), month, F.lit(" de "), part(1))
    time = F.when(part(4) != "", F.concat(F.lit(", "), part(4), F.lit(":"), part(5), F.lit(" hs"))).otherwise("")
    return F.when(F.rlike(v, F.lit(DATE)), F.concat(day, time)).otherwise(v)


def size_text(size: str | Column) -> Column:
    """Bytes as KB, MB or GB with 0, 1 or 2 decimals."""
    n = col(size)
    return (
        F.when(n < 1024**2, F.format_string("%.0f KB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))
    )


def duration_text(seconds: str | Column) -> Column:
    """X3: '1 h 2 min', '21 min 34 s' or '5 s'."""
    s = F.floor(col(seconds) + 0.5).cast("bigint")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d h %d min", h, m)).when(m > 0, F.format_string("%d min %d s", m, rest)).otherwise(F.format_string("%d s", rest))


def stopwatch(seconds: str | Column) -> Column:
    """M:ss or h:mm:ss, fractions cut, below zero as zero."""
    s = F.greatest(F.lit(0), F.floor(col(seconds))).cast("bigint")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def timestamp_text(seconds: str | Column) -> Column:
    """HH:MM:SS."""
    s = F.floor(col(seconds)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def base_name(path: str | Column) -> Column:
    """What follows the last slash or backslash; the whole path if that is empty."""
    last = F.element_at(F.split(col(path), r"[\\/]"), -1)
    return F.when(last != "", last).otherwise(col(path))


def roman(n: str | Column) -> Column:
    """Roman numeral of a positive number from X, IX, V, IV and I; '' for 0."""
    units = F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]))
    v = col(n).cast("int")
    return F.concat(F.repeat(F.lit("X"), F.floor(v / 10).cast("int")), F.element_at(units, v % 10 + 1))


def to_datetime_text(local: str | Column) -> Column:
    """X8: '2026-08-24T14:30' as '2026-08-24 14:30:00'."""
    return F.concat(F.replace(col(local), F.lit("T"), F.lit(" ")), F.lit(":00"))


def extension(name: str | Column) -> Column:
    """The part from the last dot on, '' without one."""
    return F.regexp_extract(col(name), r"(\.[^.]*)$", 1)


def plausible_correction(original: str | Column, corrected: str | Column) -> Column:
    """Non-empty; below 40 bytes if the original has fewer than 15, else 0.6 to 1.6 times as long."""
    a, b = F.octet_length(col(original)), F.octet_length(col(corrected))
    return (b > 0) & F.when(a < 15, b < 40).otherwise((b * 10 >= a * 6) & (b * 10 <= a * 16))


def indexed_line(line: str | Column) -> Column:
    """X11: struct(idx, text) of '[n] (label) text'; null if there is no index. The label goes if it closes within 60 characters."""
    rest = trim(F.regexp_extract(trim(line), r"(?s)^\[\d+\](.*)$", 1))
    bare = F.when(F.rlike(rest, F.lit(r"^\([^)]{0,58}\)")), trim(F.regexp_replace(rest, r"^\([^)]*\)", ""))).otherwise(rest)
    idx = F.regexp_extract(trim(line), r"^\[(\d+)\]", 1).try_cast("int")
    return F.when(idx.isNotNull(), F.struct(idx.alias("idx"), bare.alias("text")))


def entity_line(line: str | Column) -> Column:
    """struct(text, type) of 'ENTITY|TYPE', cut at the first bar; null unless both are non-empty."""
    parts = F.split(col(line), r"\|", 2)
    text, kind = trim(F.get(parts, F.lit(0))), trim(F.get(parts, F.lit(1)))
    return F.when((text != "") & (kind != ""), F.struct(text.alias("text"), kind.alias("type")))


def paragraphs(text: str | Column) -> Column:
    """Parts between blank lines without outer white space of any kind, empty ones left out."""
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n"), lambda p: F.btrim(p, F.lit(WHITE))), lambda p: p != "")


def half_seconds(seconds: str | Column) -> Column:
    """Times in steps of half a second."""
    return F.floor(col(seconds) * 2) / 2


def score_text(score: str | Column) -> Column:
    """Three decimals; exact halves, which are multiples of a sixteenth, to the even digit."""
    v = col(score).cast("double")
    tie = v * 16 == F.floor(v * 16)
    return F.format_string("%.3f", F.when(tie, F.bround(v.cast("decimal(20,6)"), 3).cast("double")).otherwise(v))


def joined(words: str | Column, start: int | Column, stop: int | Column) -> Column:
    """Words from start up to, not including, stop (counted from 0) with single spaces."""
    return F.array_join(F.slice(col(words), F.lit(start) + 1, F.greatest(F.lit(stop) - F.lit(start), F.lit(0))), " ")


def role_of(key: str | Column) -> Column:
    """A known role key, else null."""
    return F.when(col(key).isin("interviewer", "subject"), col(key))


def source_of(key: str | Column) -> Column:
    """A known speaker source, else 'none'."""
    return F.coalesce(F.when(col(key).isin("diarization", "manual"), col(key)), F.lit("none"))


def envelope(data: Column, error: Column | None = None) -> Column:
    """JSON of success, data and error."""
    err = F.lit(None).cast("string") if error is None else error
    return F.to_json(F.struct(err.isNull().alias("success"), data.alias("data"), err.alias("error")), {"ignoreNullFields": "false"})


def highlights(text: str | Column, needle: str) -> Column:
    """What the reading view marks: anonymisation markers and, from two characters on, matches of the needle in any case."""
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pattern = MARKER if len(needle.strip()) < 2 else f"{MARKER}|(?iu:{quoted})"
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def match_count(text: str | Column, needle: str) -> Column:
    """A11 of one text: matches of a literal in any case; 0 for a needle under two characters (X14 quotes it)."""
    if len(needle.strip()) < 2:
        return F.lit(0)
    return F.regexp_count(col(text), F.lit("(?iu)\\Q" + needle.strip().replace("\\E", "\\E\\\\E\\Q") + "\\E"))


def keyword_list(text: str | Column) -> Column:
    """Items between commas, semicolons and line ends, trimmed, non-empty, repeats in any case once, the first form kept."""
    items = F.filter(F.transform(F.split(col(text), r"[,;\r\n]+"), lambda x: F.btrim(x, F.lit(" \t\v\f\u00a0"))), lambda x: x != "")
    seen = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(items, F.array().cast("array<string>"), seen)


def known_type(head: str | Column, mime: str | Column) -> Column:
    """Whether the first bytes fit the declared audio or video type."""
    h = F.hex(F.substring(col(head), 1, 12))
    riff = h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645")
    mp3 = h.startswith("494433") | F.rlike(h, F.lit("^FF[EF][0-9A-F]"))
    return (
        F.when(col(mime).isin("audio/wav", "audio/x-wav", "audio/wave"), riff).when(col(mime).isin("audio/ogg", "audio/opus"), h.startswith("4F676753"))
        .when(col(mime).isin("audio/mp4", "video/mp4", "audio/x-m4a", "audio/m4a"), F.substring(h, 9, 8) == "66747970").when(col(mime).isin("audio/mpeg", "audio/mp3"), mp3).otherwise(F.lit(False))
    )
