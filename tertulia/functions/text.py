"""Text primitives as Column expressions. Lengths are of UTF-8 bytes unless said otherwise, lower case is ASCII only."""

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

BLANKS = " \t\r\n"
WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(s: str | Column) -> Column:
    """Without outer spaces, tabs, carriage returns and line feeds; other white space stays."""
    return F.btrim(col(s), F.lit(BLANKS))


def lower_ascii(s: str | Column) -> Column:
    """A to Z in lower case, accented letters unchanged."""
    return F.translate(col(s), string.ascii_uppercase, string.ascii_lowercase)


def as_bytes(s: str | Column) -> Column:
    """A string with one character for each UTF-8 byte of s."""
    return F.decode(F.encode(col(s), "UTF-8"), "ISO-8859-1")


def levenshtein_bytes(a: str | Column, b: str | Column) -> Column:
    """Edit distance over UTF-8 bytes."""
    return F.levenshtein(as_bytes(a), as_bytes(b))


def normalized(s: str | Column) -> Column:
    """T4: ASCII letters and digits and everything beyond ASCII, in ASCII lower case."""
    return lower_ascii(F.regexp_replace(col(s), rf"[^{WORD}]", ""))


def folded(s: str | Column) -> Column:
    """T5: lower-case Spanish accents off, ¿ and ¡ deleted."""
    return F.translate(col(s), "áéíóúüñ¿¡", "aeiouun")


def words(s: str | Column) -> Column:
    """Array of lower-case words without accents; a lone ¿ leaves an empty one."""
    parts = F.split(lower_ascii(s), rf"[^{WORD}]+")
    return F.transform(F.filter(parts, lambda x: x != ""), folded)


def common_substring(a: str | Column, b: str | Column) -> Column:
    """Length of the longest common substring in bytes; null if either is null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(x: str | None, y: str | None) -> int | None:
            if x is None or y is None:
                return None
            p, q = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
            if len(p) > len(q):
                p, q = q, p
            best, run_lengths = 0, np.zeros(len(q) + 1, np.int32)
            for byte in p:  # run_lengths[j + 1]: matching bytes that end with byte and q[j]
                run_lengths[1:] = np.where(q == byte, run_lengths[:-1] + 1, 0)
                best = max(best, int(run_lengths.max()))
            return best

        for x, y in batches:
            yield pd.Series([one(i, j) for i, j in zip(x, y)], dtype="Int32")

    return F.pandas_udf(run, "int")(col(a), col(b))


def has_punctuation(s: str | Column) -> Column:
    """T9."""
    return F.rlike(col(s), F.lit("[.,?!¿]"))


def ends_sentence(s: str | Column, marks: str = ".?!") -> Column:
    """T10; T11 with marks '.?!:'."""
    return F.right(col(s), F.lit(1)).isin(*marks)


def is_question(s: str | Column) -> Column:
    """T12."""
    return F.rlike(col(s), F.lit("[?¿]"))


def valid_text(raw: str | Column) -> Column:
    """Bytes as text, with U+FFFD for each byte that begins no sequence or whose sequence the end cuts off, and one for each sequence of the length its first byte tells that has a wrong byte in it.

    Well-formed input, which a built-in function tells, never goes through Python. What is UTF-8
    in form but not in value (overlong, surrogate) is U+FFFD too.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else _repaired(bytes(x)) for x in b], dtype="object")

    c = col(raw)
    valid = F.is_valid_utf8(c.cast("string"))
    repaired = F.pandas_udf(run, "string")(F.when(~valid, c))
    return F.when(valid, c.cast("string")).otherwise(repaired)


# The first byte of a sequence tells its length by its leading ones.
_SEQUENCE = re.compile(rb"[\x00-\x7f]+|[\xc0-\xdf].|[\xe0-\xef]..|[\xf0-\xf7]...|.", re.S)


def _repaired(raw: bytes) -> str:
    return "".join(m[0].decode("utf-8", "strict") if _decodes(m[0]) else "\ufffd" for m in _SEQUENCE.finditer(raw))


def _decodes(part: bytes) -> bool:
    try:
        part.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def single_line(s: str | Column) -> Column:
    """Line breaks as spaces, trimmed."""
    return trim(F.translate(col(s), "\n\r", "  "))


def lines(s: str | Column, keep_empty: bool = False) -> Column:
    """Array of trimmed lines."""
    parts = F.transform(F.split(col(s), "\n"), trim)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def whole_word_pattern(term: str | Column) -> Column:
    """Regular expression of a literal that no word character (ASCII letter, digit, beyond ASCII) touches."""
    quoted = F.concat(F.lit("\\Q"), F.replace(col(term), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit(rf"(?<![{WORD}])"), quoted, F.lit(rf"(?![{WORD}])"))


def replace_whole_words(s: str | Column, term: str | Column, by: str | Column) -> Column:
    """T16."""
    literal = F.replace(F.replace(col(by), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(col(s), whole_word_pattern(term), literal)


def count_whole_words(s: str | Column, term: str | Column) -> Column:
    return F.regexp_count(col(s), whole_word_pattern(term))


def clock_cs(cs: str | Column) -> Column:
    """Centiseconds as mm:ss, minutes unbounded."""
    seconds = F.floor(col(cs) / 100)
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def plausible_pair(original: str | Column, term: str | Column) -> Column:
    """Whether the byte distance of the normalised texts is at most half the longer one, both non-empty."""
    a, b = normalized(original), normalized(term)
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return (F.octet_length(a) > 0) & (F.octet_length(b) > 0) & (2 * levenshtein_bytes(a, b) <= longest)
