"""Encoding a corpus with a public byte-level BPE vocabulary through a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for each byte; each merge
(a, b) -> c, in order of rank, applies one merge gadget: wherever a path a, b can be taken, an
arc c leads to the same place, and a's arcs are led to a copy of their target that has no arc b.
After all merges it accepts exactly the correct tokenizations, so the bytes of a word have one
accepting path; its arc labels are the ids.

All arcs with one label end in one state, so the automaton is stored as a target for each token
and, for each state, the state it was copied from, at which merge, and which arc it lost. Whether
a state has an arc follows from that and is kept in a transition table as it is asked for.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Fixed value of the vocabulary: how text is split into words before the merges. Its \s is
#: the White_Space property, spelled out because Python's \s also has U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Words whose ids a worker keeps at most; then it starts anew. Only speed depends on it.
KEPT_WORDS = 400_000
#: Transitions a worker keeps at most.
KEPT_ARCS = 4_000_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    return import_module("public_tokenizers").path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of a byte-level BPE vocabulary (JSON of vocab and merges)."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.label = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        size = max(ids.values()) + 1
        self.left, self.made = [-1] * size, [-1] * size
        self.target = [0] * size
        self.origin, self.copied, self.lost = [-1], [-1], [-1]
        self.arcs: dict[int, bool] = {}
        live = [ids[t] for t in letters]
        for rank, merge in enumerate(model["merges"]):
            a_text, b_text = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = ids[a_text], ids[b_text], ids[a_text + b_text]
            if self.made[c] >= 0 or not self._has(self.target[a], b):
                continue  # no path a, b is left: the merge never applies
            self.left[c], self.made[c] = a, rank
            self.target[c] = self.target[b]
            self.origin.append(self.target[a])
            self.copied.append(rank)
            self.lost.append(b)
            self.target[a] = len(self.origin) - 1
            live.append(c)
        self.node: dict[int, int] = {}
        self.token_at = [-1]
        for t in live:
            at = 0
            for byte in self.label[t]:
                key = at << 8 | byte
                if key not in self.node:
                    self.token_at.append(-1)
                    self.node[key] = len(self.token_at) - 1
                at = self.node[key]
            self.token_at[at] = t
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def _has(self, state: int, token: int) -> bool:
        """Whether state has an arc labelled token."""
        while state:
            rank = self.copied[state]
            while self.made[token] >= rank:  # arcs added after the copy exist where that of their left part does
                token = self.left[token]
            if token == self.lost[state]:
                return False
            state = self.origin[state]
        return True

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one pre-split word: the labels of its only accepting path."""
        size = len(word)
        last, start = [-1] * (size + 1), [-1] * (size + 1)
        node, token_at, target, arcs = self.node, self.token_at, self.target, self.arcs
        for i in range(size):
            if i and last[i] < 0:
                continue
            state = target[last[i]] if i else 0
            at, k = 0, i
            while k < size:
                at = node.get(at << 8 | word[k], -1)
                if at < 0:
                    break
                k += 1
                t = token_at[at]
                if t >= 0:
                    key = state << 20 | t
                    there = arcs.get(key)
                    if there is None:
                        if len(arcs) >= KEPT_ARCS:
                            arcs.clear()
                        there = arcs[key] = self._has(state, t)
                    if there:
                        last[k], start[k] = t, i
        found = []
        while size:
            found.append(last[size])
            size = start[size]
        return found[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, special tokens' strings being ordinary text; none for null and ''."""
        found: list[int] = []
        words = self.words
        for w in self.split(text or ""):
            ids = words.get(w)
            if ids is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                ids = words[w] = self.word_ids(w.encode("utf-8", "surrogatepass"))
            found += ids
        return found

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def automaton(vocabulary: bytes) -> Automaton:
    return Automaton(vocabulary)


def _read(path: str | None) -> bytes:
    with open(path or vocabulary_path(), "rb") as f:
        return f.read()


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every row's whole text, in one pass and without a shuffle.

    Null and empty texts have the empty list, blank ones the ids of their white space. Repeated
    rows stay repeated, a null id stays null, an empty table gives no rows, other columns are
    not read. vocabulary is the path of the JSON vocabulary (fixed size, 1.5 MB); the driver
    reads it once and broadcasts it, so executors need no such file.
    """
    kept = documents.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(kept.value)
        for batch in batches:
            ids = [known.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            for lo in range(0, len(ids), 2048):
                hi = min(lo + 2048, len(ids))
                flat = np.fromiter((i for x in ids[lo:hi] for i in x), np.int32, int(ends[hi] - ends[lo]))
                lists = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=[id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """keep's columns and n_tokens BIGINT, the number of ids encode_corpus() would give; 0 for null."""
    kept = documents.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(kept.value)
        for batch in batches:
            n = pa.array([len(known.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_corpus(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts behind lists of ids; '' for the empty list, null for null."""
    kept = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(kept.value)
        for batch in batches:
            text = pa.array([None if x is None else known.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
