"""Text decoded with the wrong character encoding: found and restored by minimum description length.

A document is cut into lines and sentences. For each, chains of "was read as X, is Y" are
undone where that is possible; the chain is chosen that makes the document shortest when
compressed with dictionaries of its possible languages, its own cost included. Where no chain
pays, nothing is changed.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

#: The dictionaries are fitted on at most so many documents, of at most so many characters each.
FIT_DOCUMENTS = 4_000
FIT_CHARACTERS = 4_000
DICTIONARY_BYTES = 64 * 1024
#: Languages with the most fitted documents that get a dictionary; each needs so many documents.
LANGUAGES, LEAST_DOCUMENTS = 12, 20
#: Bytes that a chain costs a document for each step, and each part of the document it is applied to:
#: a valid UTF-8 sequence hardly comes about by chance, a swap of single bytes is always possible.
#: Fitted by mojibake_costs on held-out documents.
STEP_COST, PART_COST = {True: 1, False: 1}, {True: 0, False: 1}
#: Bytes that a character which comes out odd costs: one that a UTF-8 sequence of its kind accounts for, and any
#: other, C1 controls and letters that a swap leaves standing alone among them.
ODD_COST, STRANGE_COST = 2, 8
#: A character is usual if so many documents in 10,000 have it, two at least.
USUAL_SHARE = 20
#: Sizes that a worker keeps at most; only speed depends on it.
KEPT_SIZES = 100_000
#: Characters on both sides of what a chain changes that are measured by themselves as well.
AROUND = 12

# Encodings that multi-byte UTF-8 is commonly read as, and single-byte pairs (read as, true).
READ_UTF8_AS = ["cp1252", "cp1252 lower", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-15"]
SINGLE_BYTE = [("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman")]
#: Marks that clean text has besides letters.
MARKS = set("¿¡–—‘’“”…•ºª°«»€̧̀́̂̃̈ ")

#: A letter that is a word by itself.
LONE = re.compile(r"(?<![^\W\d_])[^\W\d_](?![^\W\d_])")
PARTS = re.compile(r"[^\n.!?…]*(?:[.!?…]+[\"”»)]*[^\S\n]*|\n|$)")


def _byte(encoding: str, b: int) -> str:
    """The character that a lenient reader makes of a byte: C1 controls where the encoding has none."""
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@functools.lru_cache(maxsize=None)
def _high(encoding: str) -> dict[str, int]:
    """Character to byte for the upper half of an encoding, and for the C1 controls themselves if free."""
    if encoding.endswith(" lower"):  # read wrongly, then put in lower case
        plain = _high(encoding.removesuffix(" lower"))
        return plain | {c.lower(): b for c, b in plain.items() if 0xC2 <= b <= 0xDF and c.lower() != c}
    table = {_byte(encoding, b): b for b in range(128, 256)}
    if encoding == "cp1252":
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


@functools.lru_cache(maxsize=None)
def _sequences(encoding: str) -> re.Pattern:
    """Characters of an encoding that look like one UTF-8 sequence of two to four bytes."""
    table = _high(encoding)
    kind = lambda lo, hi: "[" + re.escape("".join(c for c, b in table.items() if lo <= b <= hi)) + "]"
    tail = kind(0x80, 0xBF)
    return re.compile(f"{kind(0xC2, 0xDF)}{tail}|{kind(0xE0, 0xEF)}{tail}{{2}}|{kind(0xF0, 0xF4)}{tail}{{3}}")


def undo_utf8(text: str, encoding: str) -> str:
    """text with each group of characters replaced that is a valid UTF-8 sequence in the encoding."""
    table = _high(encoding)

    def restore(m: re.Match) -> str:
        try:
            found = bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        if encoding.endswith(" lower"):
            return m[0] if found < "\xa0" else found.lower()
        return found

    return _sequences(encoding).sub(restore, text)


@functools.lru_cache(maxsize=None)
def _swap(read_as: str, true: str) -> dict[int, str]:
    return {ord(c): _byte(true, b) for c, b in _high(read_as).items()}


class Restorer:
    """Restores texts, given fitted dictionaries and the characters that clean text has."""

    def __init__(self, dictionaries: list[bytes], usual: str):
        made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in dictionaries]
        for d in made:
            d.precompute_compress(level=3)
        how = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by_language = [zstandard.ZstdCompressor(dict_data=d, **how) for d in made] or [zstandard.ZstdCompressor(level=3, **how)]
        self.sizes: dict[str, int] = {}
        self.usual = set(usual)
        lower = "a-z" + re.escape("".join(sorted(c for c in self.usual if c.islower())))
        upper = re.escape("".join(sorted(c for c in self.usual if c.isupper())))
        odd = "[^\x00-\x7f" + re.escape("".join(sorted(self.usual))) + "]" + (f"|(?<=[{lower}])[{upper}]" if upper else "")
        self.odd = re.compile(odd)
        self.suspect = re.compile(f"{odd}|{_sequences('cp1252').pattern}")

    def size(self, part: str) -> int:
        """Bytes of the part compressed with the dictionary of the language that suits it best."""
        got = self.sizes.get(part)
        if got is None:
            if len(self.sizes) >= KEPT_SIZES:
                self.sizes.clear()
            data = part.encode("utf-8", "surrogatepass")
            got = self.sizes[part] = min(len(c.compress(data)) for c in self.by_language)
        return got

    def _odd(self, part: str) -> Counter:
        """Characters that clean text has not, or not there: capitals within a word of small letters."""
        return Counter(self.odd.findall(part))

    def chains(self, part: str) -> dict[tuple[str, ...], str]:
        """Chain to candidate text: every chain of UTF-8 sequences undone until nothing changes, and every swap of the part's upper half or of its odd characters alone."""
        found: dict[tuple[str, ...], str] = {}
        layer = {(): part}
        while layer:  # each step makes the text shorter
            deeper: dict[tuple[str, ...], str] = {}
            made = set()
            for chain, text in layer.items():
                for x in READ_UTF8_AS:
                    if (new := undo_utf8(text, x)) != text and new not in made:
                        made.add(new)
                        deeper[(*chain, f"{x}>utf-8")] = new
            found |= deeper
            layer = deeper
        odd = self._odd(part)
        if odd:
            for read_as, true in SINGLE_BYTE:
                table = _swap(read_as, true)
                if all(ord(c) in table for c in odd):
                    found[f"{read_as}>{true}",] = part.translate(table)
                    found[f"{read_as}>{true}, odd",] = self.odd.sub(lambda m: table[ord(m[0])], part)  # noqa: B023
        return {c: t for c, t in found.items() if t != part}

    def worth(self, part: str, chain: tuple[str, ...], new: str) -> int:
        """Bytes that a chain saves on a part, its cost for the part and for what comes out odd taken off.

        Of a swap, what the characters save by themselves, without their surroundings, does not
        count: letters are shorter than signs whether they make words or not.
        """
        utf8 = _is_utf8(chain)
        before, after = self._odd(part), self._odd(new)
        odd = list((after - before).elements())
        strange = sum("\x80" <= x < "\xa0" for x in new)
        cost = PART_COST[utf8] + ODD_COST * len(odd)
        if utf8:
            cost -= ODD_COST * sum((before - after).values())  # the dictionaries think too little of what they have never seen
            foreign = [c for c in odd if "\xff" < c < "\u0800"]  # a word of another script, or two letters that happen to be a sequence
            strange += len(foreign) if len(foreign) < 3 or not all(c.isalpha() and c >= "\u0370" for c in foreign) else 0
        else:
            strange += len(odd) + sum(new[m.start()] != part[m.start()] for m in LONE.finditer(new))
        cost += STRANGE_COST * strange
        if cost >= 2 * self.size(part):  # no text is shorter by more than the part and its surroundings are long
            return -cost
        saved = self.gain(part, new)
        if not utf8:
            swapped = [(x, y) for x, y in zip(part, new) if x != y]
            saved -= 2 * max(0, self.size(" ".join(x for x, _ in swapped)) - self.size(" ".join(y for _, y in swapped)))
        return saved - cost

    def gain(self, part: str, new: str) -> int:
        """Bytes by which new is shorter than part: as a whole, and once more what differs with AROUND characters on both sides."""
        low = next((k for k, (a, b) in enumerate(zip(part, new)) if a != b), min(len(part), len(new)))
        same = next((k for k, (a, b) in enumerate(zip(reversed(part[low:]), reversed(new[low:]))) if a != b), min(len(part), len(new)) - low)
        low, tail = max(0, low - AROUND), max(0, same - AROUND)
        return self.size(part) - self.size(new) + self.size(part[low : len(part) - tail]) - self.size(new[low : len(new) - tail])

    def restore(self, text: str) -> tuple[str, str]:
        """(text with what is wrong restored, the chains used, '' for none).

        The chain that saves most over the parts it makes shorter is used if it saves more than
        it costs, then the next on the other parts. A chain in use also restores parts that it
        does not make shorter (a swap: at the cost of the part), but for a part where two
        chains could.
        """
        if not self.suspect.search(text):
            return text, ""
        parts = PARTS.findall(text)
        gains: dict[tuple[str, ...], dict[int, int]] = defaultdict(dict)
        made: dict[tuple, str] = {}
        for k, p in enumerate(parts):
            if self.suspect.search(p):
                for chain, new in self.chains(p).items():
                    gains[chain][k], made[chain, k] = self.worth(p, chain, new), new
        used = []
        saved = lambda c: sum(x for x in gains[c].values() if x > 0) - STEP_COST[_is_utf8(c)] * len(c)
        while gains:
            best = max(gains, key=lambda c: (saved(c), -len(c), c))
            if saved(best) <= 0:
                break
            done = [k for k, x in gains.pop(best).items() if x > 0 or (_is_utf8(best) or x >= -PART_COST[False]) and x >= max((g.get(k, -99) for g in gains.values()), default=-99)]
            for k in done:
                parts[k] = made[best, k]
            used.append("+".join(best))
            gains = defaultdict(dict, {c: kept for c, g in gains.items() if (kept := {k: x for k, x in g.items() if k not in done})})
        return "".join(parts), "; ".join(used)


def _is_utf8(chain: tuple[str, ...]) -> bool:
    return chain[-1].endswith(">utf-8")


def _clean(part: str) -> bool:
    return all(c < "\x80" or c in MARKS or (c <= "\xff" and c.isalpha()) for c in part)


def usual_characters(documents: DataFrame, text_col: str = "text") -> str:
    """Characters beyond ASCII that clean text has, counted over all documents: in sentences whose characters beyond ASCII are Latin-1 letters or common marks, capitals within words of small letters left out."""
    marks = re.escape("".join(sorted(MARKS)))
    # a class in which every character of clean text is, so that one other ends the search
    other = rf"[^\x00-\x7f{marks}ªµº\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{ff}}]"
    clean = F.filter(F.split(text_col, r"[.!?…\n]"), lambda p: ~F.regexp_like(p, F.lit(other)))
    letters = F.array_distinct(F.split(F.regexp_replace(F.array_join(clean, "\n"), r"[\x00-\x7f]+|(?<=\p{Ll})\p{Lu}", ""), ""))
    texts = documents.where(F.regexp_like(text_col, F.lit(r"[^\x00-\x7F]")))
    # one row a character: no more than Unicode has
    rows = texts.select(F.explode(letters).alias("c")).where("c <> ''").groupBy("c").count().collect()
    least = max(2, texts.count() * USUAL_SHARE // 10_000)
    usual = {r.c for r in rows if r["count"] >= least} | MARKS
    return "".join(sorted(usual | {c.upper() for c in usual if len(c.upper()) == 1}))


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = FIT_DOCUMENTS) -> tuple[list[bytes], str]:
    """(dictionary of each language, usual characters): dictionaries fitted on the limit documents with the least hashed ids, characters counted over all.

    Only parts whose characters beyond ASCII are Latin-1 letters or common marks are used, of
    texts of up to FIT_CHARACTERS; languages are those of the label in lower case, rare and
    missing ones form one. Bounds of the fitted sample: limit, FIT_CHARACTERS, LANGUAGES,
    DICTIONARY_BYTES.
    """
    # ids beyond a bound that far more than limit documents stay under cannot be among the least:
    # without it every partition would send limit texts to the driver
    key = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2**40))
    bound = 2**40 * min(1.0, 8 * limit / max(1, documents.count()))
    fitting = documents.where(key < F.lit(int(bound))).where(F.col(text_col).isNotNull() & (F.length(text_col) <= FIT_CHARACTERS) & ~F.contains(text_col, F.lit("�")))
    rows = fitting.select(F.lower(F.trim(lang_col)).alias("l"), F.col(text_col).alias("t")).orderBy(key, F.col(id_col)).limit(limit).collect()
    return dictionaries([(r.l, r.t) for r in rows]), usual_characters(documents, text_col)


def dictionaries(texts: list[tuple[str | None, str]]) -> list[bytes]:
    """A dictionary for each language of (language, text), from their clean parts."""
    counts = Counter(x for x, _ in texts if x)
    kept = {x for x, n in counts.most_common(LANGUAGES) if n >= LEAST_DOCUMENTS}
    by_language: dict[str, list[bytes]] = defaultdict(list)
    for x, t in texts:
        by_language[x if x in kept else ""] += [p.encode() for p in PARTS.findall(t) if p.strip() and _clean(p)]
    found = []
    for x in sorted(by_language):
        try:
            found.append(zstandard.train_dictionary(DICTIONARY_BYTES, by_language[x]).as_bytes())
        except zstandard.ZstdError:  # too few samples: the parts themselves are the dictionary
            found.append(b"".join(by_language[x])[-DICTIONARY_BYTES:] or b" " * 8)
    return found


_restorer = functools.lru_cache(maxsize=2)(Restorer)


class _Shared:
    """Broadcast model, made into a Restorer once in each Python worker."""

    def __init__(self, kept):
        self.kept = kept

    def restorer(self) -> Restorer:
        dictionaries, usual = self.kept.value
        return _restorer(_Frozen(dictionaries), usual)


class _Frozen(list):
    def __hash__(self):
        return hash(tuple(self))


def restored(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = FIT_DOCUMENTS) -> DataFrame:
    """(id, text, chains, lost): the documents whose text was read wrongly, wholly or in part.

    text is restored as far as it can be; lost tells that characters were replaced by U+FFFD, so
    the original is not known there. Other documents give no row, nor do null, empty and pure
    ASCII texts. A repeated row is repeated, a null id stays null, other columns are not read.
    One pass over all documents after the bounded fit; no shuffle.
    """
    shared = _Shared(documents.sparkSession.sparkContext.broadcast(fit(documents, id_col, text_col, lang_col, limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = shared.restorer()
        for b in batches:
            found = []
            for k, t in enumerate(b.column(1).to_pylist()):
                new, chains = restorer.restore(t)
                lost = "�" in t
                if chains or lost:
                    found.append((k, new, chains, lost))
            at, *columns = zip(*found) if found else ((),) * 4
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=[id_col, "text", "chains", "lost"])

    foreign = documents.where(F.regexp_like(text_col, F.lit(r"[^\x00-\x7F]"))).select(id_col, text_col)
    return foreign.mapInArrow(run, f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, text string, chains string, lost boolean")
