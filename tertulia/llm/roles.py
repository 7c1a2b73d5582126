"""Who speaks: role labels in their many spellings, and the labels that an interview's subject has."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

INTERVIEWER, SUBJECT = "interviewer", "subject"

# Labels of the two roles, folded (lower case, no accents).
INTERVIEWER_LABELS = ["interviewer", "investigador", "investigadora", "entrevistador", "entrevistadora", "moderador", "moderadora", "pregunta", "preg", "inv", "p"]
SUBJECT_LABELS = ["subject", "sujeto", "entrevistado", "entrevistada", "participante", "respuesta", "respondent", "informante", "resp", "part", "suj", "r"]

ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc"


def fold(text: str) -> str:
    """Lower case without accents, outer white space and punctuation; inner runs of them are one space."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in flat).split())


def folded(label: str | Column) -> Column:
    """fold() as a Spark expression; '' for null and blank."""
    c = F.col(label) if isinstance(label, str) else label
    flat = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(flat, r"[^\p{L}\p{N}]+", " "))


def subject_types(interviews: DataFrame) -> DataFrame:
    """(interview_id, types): the folded subject types each interview has been given, blank ones left out."""
    named = interviews.select(F.col("id").alias("interview_id"), folded("interview_subject_type").alias("_type"))
    return named.where("_type <> ''").groupBy("interview_id").agg(F.sort_array(F.collect_set("_type")).alias("types"))


def with_subject_types(rows: DataFrame, interviews: DataFrame, chunk: str) -> DataFrame:
    """rows with the columns types, the subject types of their interview (null if it has none), and split, whether the interview has several chunks.

    The small side gets a copy for each chunk of an interview, so the join's key is
    (interview_id, chunk) and an interview with a third of all rows meets in many tasks.
    """
    chunks = rows.select("interview_id", chunk).distinct()
    whether = chunks.groupBy("interview_id").agg((F.min(chunk) < F.max(chunk)).alias("split")).join(subject_types(interviews), "interview_id", "left")
    each = chunks.join(whether, "interview_id").select("interview_id", chunk, "types", "split")
    return rows.join(each, ["interview_id", chunk])


def swaps_apart(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 if it is greater than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, above = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, above = above, row
    return above[-1]


class RoleReader:
    """Reads labels of one set of subject types: exact, as the first word of a type, or with one slip (two in a column)."""

    def __init__(self, types: tuple[str, ...]):
        names = dict.fromkeys(INTERVIEWER_LABELS, INTERVIEWER) | dict.fromkeys(SUBJECT_LABELS, SUBJECT)
        for t in types:
            names.setdefault(t.split()[0], SUBJECT)
            names[t] = SUBJECT
        self.names, self.read = names, {}

    def role(self, label: str | None, slips: int = 1) -> str | None:
        """'interviewer', 'subject' or None if the label is blank or neither."""
        key = (label, slips)
        if key not in self.read:
            if len(self.read) > 100_000:
                self.read.clear()
            self.read[key] = self._role(fold(label or ""), slips)
        return self.read[key]

    def _role(self, plain: str, slips: int) -> str | None:
        unnumbered = plain.rstrip("0123456789 ")
        for x in (plain, unnumbered):
            if x in self.names:
                return self.names[x]
        near = []
        for name, role in self.names.items():
            most = min(slips, len(name) // 4)
            if most:
                tails = (plain, unnumbered) if plain != unnumbered else (plain,)
                d = min(swaps_apart(x, name, most) for x in [*tails, plain[:-1].rstrip() if plain[-1:].isdigit() else plain])
                if d <= most:
                    near.append((d, name, role))
        return min(near)[2] if near else None
