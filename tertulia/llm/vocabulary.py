"""Mapping freely typed values to a reference list: a trie searched with Levenshtein automata."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tertulia.llm.roles import fold
from tertulia.operators.sizes import small_side
from tertulia.session import checkpointed

#: A value may differ from an entry of so many letters and digits by 1, 2 or 3 edits.
TWO_EDITS_FROM, THREE_EDITS_FROM = 9, 12
#: Reference entries that are broadcast at most; a longer list is refused.
MAX_ENTRIES = 1_000_000
#: Values whose result a worker keeps at most.
KEPT_VALUES = 200_000
#: Tasks among which the rows of one value are spread where the mapped values are too many to broadcast.
SALTS = 16

# Letters that are heard alike.
ALIKE = [set(x) for x in ("bv", "szcx", "ck", "kq", "gj", "iy", "mn", "td", "pb", "uv", "ao", "rl", "lf")]
KEYBOARD = ["qwertyuiop", "asdfghjklñ", "zxcvbnm"]


def edits_for(length: int) -> int:
    """Edits within which a value stands for an entry of this length."""
    return 1 + (length >= TWO_EDITS_FROM) + (length >= THREE_EDITS_FROM)


@functools.lru_cache(maxsize=1)
def _near() -> frozenset[tuple[str, str]]:
    """Pairs of letters that are heard alike or lie side by side on the keyboard."""
    at = {c: (x + y / 2, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
    beside = {(a, b) for a in at for b in at if a != b and abs(at[a][0] - at[b][0]) <= 1 and abs(at[a][1] - at[b][1]) <= 1}
    return frozenset(beside | {(a, b) for s in ALIKE for a in s for b in s if a != b})


def likeness(a: str, b: str) -> float:
    """Edit distance with swaps in which likely slips (doubled, alike and neighbouring letters) count a little less."""
    near = _near()
    before: list[float] = []
    above = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            doubled = 0.8 if i > 1 and x == a[i - 2] else 1.0
            cost = min(above[j] + doubled, row[-1] + 0.95, above[j - 1] + (0.0 if x == y else 0.85 if (x, y) in near else 1.05))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, before[j - 2] + 0.9)
            row.append(cost)
        before, above = above, row
    return above[-1]


class Vocabulary:
    """Entries (id, text), a term and its aliases alike, in a trie of folded letters.

    Each entry also has a path for each rotation of its words, as in "apellido, nombre".
    Spaces are no letters, so a value may be run together or cut apart.
    """

    def __init__(self, entries: list[tuple[int, str]]):
        self.entries = entries
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(entries):
            words = fold(text).split()
            paths = {"".join(words[r:] + words[:r]): r for r in reversed(range(len(words)))}
            for path, r in paths.items():
                at = 0
                for c in path:
                    if c not in self.next[at]:
                        self.next.append({})
                        self.next[at][c] = len(self.next) - 1
                    at = self.next[at][c]
                self.ends.setdefault(at, []).append((k, bool(r)))
        self.length = [len(fold(t).replace(" ", "")) for _, t in entries]
        self.known: dict[str, tuple] = {}

    def within(self, value: str, most: int) -> dict[int, tuple[int, bool]]:
        """Entry number to (edits, whether its words are rotated), all entries within most edits of the folded value.

        The automaton of the value is run along the trie: bit i of level e is set if i letters
        of the value are read with e edits; a branch ends where no bit is left.
        """
        size = len(value)
        mask: dict[str, int] = {}
        for i, c in enumerate(value):
            mask[c] = mask.get(c, 0) | 2 << i
        full = (2 << size) - 1
        start = tuple((2 << min(e, size)) - 1 for e in range(most + 1))
        found: dict[int, tuple[int, bool]] = {}
        stack = [(0, start, None, 0)]
        while stack:
            at, state, earlier, came = stack.pop()
            for k, rotated in self.ends.get(at, ()):
                e = next((e for e, s in enumerate(state) if s >> size & 1), None)
                if e is not None and (k not in found or (e, rotated) < found[k]):
                    found[k] = (e, rotated)
            for c, child in self.next[at].items():
                m = mask.get(c, 0)
                level = state[0] << 1 & m
                new = [level]
                for e in range(1, most + 1):
                    less = state[e - 1]
                    level = (state[e] << 1 & m) | less | less << 1 | level << 1
                    if earlier is not None:
                        level |= earlier[e - 1] << 2 & m << 1 & came
                    level &= full
                    new.append(level)
                if level:
                    stack.append((child, tuple(new), state, m))
        return found

    def matches(self, value: str, most: int | None = None) -> list[tuple[int, int, float]]:
        """(entry number, edits, likeness), best first: all entries within the edits that their length allows, and most if given."""
        plain = fold(value).replace(" ", "")
        if not plain:
            return []
        near = self.within(plain, edits_for(len(plain) + 3) if most is None else most)
        found = []
        for k, (e, rotated) in near.items():
            if e <= edits_for(self.length[k]):
                target = fold(self.entries[k][1]).replace(" ", "")
                found.append((k, e, float(e) if rotated else likeness(plain, target)))
        exact = unicodedata.normalize("NFC", value.strip().lower())
        return sorted(found, key=lambda x: (x[1], x[2], likeness(exact, unicodedata.normalize("NFC", self.entries[x[0]][1].lower())), self.entries[x[0]][0]))

    def best(self, value: str) -> tuple[int, int | None, str | None]:
        """(id, edits, matched text) of the closest entry; (-1, None, None) if there is none."""
        got = self.known.get(value)
        if got is None:
            if len(self.known) >= KEPT_VALUES:
                self.known.clear()
            # few edits first: what is found with fewer comes before all that needs more
            found = next((x for most in range(edits_for(len(value) + 3) + 1) if (x := self.matches(value, most))), [])
            got = self.known[value] = (self.entries[found[0][0]][0], found[0][1], self.entries[found[0][0]][1]) if found else (-1, None, None)
        return got


@functools.lru_cache(maxsize=2)
def _vocabulary(entries: tuple[tuple[int, str], ...]) -> Vocabulary:
    return Vocabulary(list(entries))


def reference_entries(terms: DataFrame, id_col: str = "term_id", term_col: str = "term", alias_col: str | None = "alias") -> tuple[tuple[int, str], ...]:
    """The list's entries, terms and aliases, for the trie. Blank ones and null ids are left out, repeats count once.

    The list is the fixed side of the task: it is broadcast, and more than MAX_ENTRIES raise ValueError.
    """
    names = F.array(term_col, alias_col) if alias_col else F.array(term_col)
    rows = terms.select(F.col(id_col).alias("i"), F.explode(names).alias("t")).where("i is not null and trim(t) <> ''").distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} reference entries")
    return tuple(sorted((r.i, r.t) for r in rows))


def spread(values: DataFrame) -> DataFrame:
    """Distinct values in as many partitions as shuffles have. The count is given, as adaptive execution would join partitions by their few bytes, and the key is a hash of the value, as the planner drops a repartition by the value itself behind the distinct."""
    return values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))


def mapped_values(values: DataFrame, terms: DataFrame, value_col: str = "value", **reference: str) -> DataFrame:
    """(value, term_id, edits, matched): each distinct value and the entry it stands for; term_id -1 if none.

    Null values give no row. Distinct values are found before the search (combined before the
    shuffle), so a value that fills a third of the rows is looked up once; they are spread by
    hash, as a search costs far more than its value's bytes tell.
    """
    entries = values.sparkSession.sparkContext.broadcast(reference_entries(terms, **reference))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(entries.value)
        for b in batches:
            found = [known.best(v) for v in b.column(0).to_pylist()]
            columns = [b.column(0), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "term_id", "edits", "matched"])

    distinct = values.select(F.col(value_col).cast("string").alias("value")).where("value is not null").distinct()
    return spread(distinct).mapInArrow(run, "value string, term_id int, edits int, matched string")


def joined_back(rows: DataFrame, mapped: DataFrame, places: list[str]) -> DataFrame:
    """rows with what mapped_values() has for their value: mapped is broadcast if it is measured to be small; if not, it has a copy for each of SALTS, so that the rows of one value, told apart by the columns places, go to as many tasks."""
    small = small_side(mapped)
    if small is not mapped:
        return rows.join(small, "value")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*places), F.lit(SALTS)))
    return salted.join(mapped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["value", "_salt"]).drop("_salt")


def all_matches(values: DataFrame, terms: DataFrame, value_col: str = "value", **reference: str) -> DataFrame:
    """(value, term_id, edits, matched, place): every entry within the allowed edits of each distinct value, the best at place 1."""
    entries = values.sparkSession.sparkContext.broadcast(reference_entries(terms, **reference))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(entries.value)
        for b in batches:
            rows = [(v, *known.entries[k], e, n) for v in b.column(0).to_pylist() for n, (k, e, _) in enumerate(known.matches(v), 1)]
            value, ids, matched, edits, place = zip(*rows) if rows else ((),) * 5
            columns = [pa.array(value, pa.string()), pa.array(ids, pa.int32()), pa.array(edits, pa.int32()), pa.array(matched, pa.string()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "term_id", "edits", "matched", "place"])

    distinct = values.select(F.col(value_col).cast("string").alias("value")).where("value is not null").distinct()
    return spread(distinct).mapInArrow(run, "value string, term_id int, edits int, matched string, place int")


def typed_values(interviews: DataFrame, changes: DataFrame) -> DataFrame:
    """(field, interview_id, item, value): items of keywords and values of glossary changes that are not blank, repeats once."""
    keywords = interviews.select(F.lit("keywords").alias("field"), F.col("id").alias("interview_id"), F.posexplode("keywords").alias("item", "value"))
    both = changes.select(F.explode(F.array(F.struct(F.lit("original").alias("field"), F.col("original").alias("value")), F.struct(F.lit("term").alias("field"), F.col("term").alias("value")))).alias("_v"), "interview_id", "line")
    rows = keywords.withColumn("item", F.col("item").cast("bigint")).unionByName(both.select("_v.field", "interview_id", F.col("line").cast("bigint").alias("item"), "_v.value"))
    return rows.where(F.regexp_like("value", F.lit(r"[^\s\x{a0}]"))).distinct()


def mapped_fields(interviews: DataFrame, changes: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, interview_id, item, value, term_id, edits, matched) of each typed value that is not itself a term.

    Null and blank values and empty arrays give no row; term_id is -1 where nothing is near
    enough. Rows with a null interview_id or line stay, at null. Empty tables give no rows;
    with an empty list every value is -1. Distinct values are searched and written to the
    checkpoint folder, then joined back.
    """
    typed = typed_values(interviews, changes)
    exact = small_side(terms.select(F.col("term").alias("value")).where("value is not null").distinct())
    asked = typed.join(exact, "value", "left_anti")
    keep = ["field", "interview_id", "item"]
    mapped = checkpointed(mapped_values(asked, terms))
    return joined_back(asked, mapped, keep).select(*keep, "value", "term_id", "edits", "matched")
