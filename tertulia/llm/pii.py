"""Personal data in free text: found by the character BiLSTM-CRF of pii_model and replaced by typed placeholders.

The model alone decides; its spans are only set on whole words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tertulia.llm.pii_model import WEIGHTS, Tagger, load

#: What stands for each kind in the text.
PLACEHOLDERS = {"email": "[CORREO]", "phone": "[TELEFONO]", "id_number": "[DOCUMENTO]", "address": "[DIRECCION]", "name": "[PERSONA]"}
#: Sentences whose spans a worker keeps; then it starts anew. Only speed depends on it.
KEPT_SENTENCES = 300_000

# A sentence ends at a mark behind a word of three letters or a number, before a capital: not behind initials and short forms.
SENTENCE_END = re.compile(r"(?:(?<=[^\W\d_]{3}[.?!])|(?<=[\d)][.?!]))\s+(?=[¿¡]?[A-ZÁÉÍÓÚÑ])")


def on_whole_words(text: str, a: int, b: int) -> tuple[int, int]:
    """The span from its first to its last letter or digit, grown to whole words; an opening +, ( or # and a bracket that it closes stay."""
    while a < b and not (text[a].isalnum() or text[a] in "+(#"):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    while 0 < a < b and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while a < b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    return a, b


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset, sentence) of the whole text, without outer white space; blank ones are left out."""
    found, a = [], 0
    for m in SENTENCE_END.finditer(text):
        found.append((a, text[a : m.start()]))
        a = m.end()
    found.append((a, text[a:]))
    return [(o + len(s) - len(s.lstrip()), s.strip()) for o, s in found if s.strip()]


class Finder:
    """Finds spans of texts; each distinct sentence is scored once as long as it is kept."""

    def __init__(self, weights: bytes):
        self.tagger = Tagger(load(weights))
        self.kept: dict[str, tuple] = {}

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text (start, end, kind) of its spans in order; none for null."""
        parts = [sentences(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_SENTENCES:
            self.kept.clear()
        new = list({s: None for p in parts for _, s in p if s not in self.kept})
        for lo in range(0, len(new), 8192):
            some = new[lo : lo + 8192]
            for s, spans in zip(some, self.tagger.spans(some)):
                edges = [(*on_whole_words(s, a, b), kind) for a, b, kind in spans]
                self.kept[s] = tuple((a, b, kind) for a, b, kind in edges if a < b)
        return [[(a + o, b + o, k) for o, s in p for a, b, k in self.kept[s]] for p in parts]


@functools.lru_cache(maxsize=1)
def _finder(weights: bytes) -> Finder:
    return Finder(weights)


def _weights(path: str | None) -> bytes:
    with open(path or WEIGHTS, "rb") as f:
        return f.read()


def found_kinds(turns: DataFrame, keys: list[str], text_col: str = "text", weights: str | None = None) -> DataFrame:
    """keys' columns and kind: one row for each kind of personal data in the texts of a key.

    Null, empty and blank texts give no row; rows repeated with the same key count once; null
    keys stay; other columns are not read. The weights (some 50 KB) are broadcast; texts do not
    shuffle, only the kinds found do.
    """
    kept = turns.sparkSession.sparkContext.broadcast(_weights(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(kept.value)
        for b in batches:
            spans = finder.spans(b.column(len(keys)).to_pylist())
            at = [(k, kind) for k, x in enumerate(spans) for kind in sorted({s[2] for s in x})]
            rows = pa.array([k for k, _ in at], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[: len(keys)]), pa.array([kind for _, kind in at], pa.string())], names=[*keys, "kind"])

    kinds = ", ".join(f"`{k}` {turns.schema[k].dataType.simpleString()}" for k in keys)
    return turns.select(*keys, F.col(text_col).alias("_text")).where("_text is not null").mapInArrow(run, f"{kinds}, kind string").distinct()


def redacted(turns: DataFrame, keys: list[str], text_col: str = "text", weights: str | None = None) -> DataFrame:
    """keys' columns, text and n_spans: every row's text with its spans replaced by PLACEHOLDERS, the rest unchanged; null stays null."""
    kept = turns.sparkSession.sparkContext.broadcast(_weights(weights))

    def clean(text: str, spans: list[tuple[int, int, str]]) -> str:
        parts, at = [], 0
        for a, b, kind in spans:
            parts += [text[at:a], PLACEHOLDERS[kind]]
            at = b
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(kept.value)
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            spans = finder.spans(texts)
            new = [None if t is None else clean(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(new, pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=[*keys, "text", "n_spans"])

    kinds = ", ".join(f"`{k}` {turns.schema[k].dataType.simpleString()}" for k in keys)
    return turns.select(*keys, F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, text string, n_spans int")
