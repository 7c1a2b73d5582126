import random

from tertulia.llm.roles import RoleReader
from tertulia.llm.transcripts import calibrated_pause, clean_turns, read_row, turn_starts, without_overlap

ROWS = "interview_id int, pos int, start_ms bigint, end_ms bigint, speaker string, text string"
INTERVIEWS = "id int, interview_subject_type string"
READER = RoleReader(("docente rural",))


def literal(rows):
    """The rule read aloud on marks and labels in the columns only."""
    found = []
    for i in sorted({r[0] for r in rows}):
        own = sorted({r[1]: r for r in rows if r[0] == i and r[5] and any(c.isalnum() for c in r[5])}.values(), key=lambda r: r[1])
        timed, line = None, []
        for r in own:
            timed = (r[2], r[1]) if r[2] is not None else timed
            line.append(((-1, -1) if timed is None else timed, r[1], None if timed is None else timed[0], r[4]))
        role, before = None, "none yet"
        for _, _, at, who in sorted(line):
            role = who or role
            if role != before:
                found.append((i, at, role))
            before = role
    return sorted(found, key=repr)


def test_against_the_rule_with_small_chunks(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1, 20):
        for pos in range(rng.randint(0, 50)):
            at = rng.choice([None, pos * 10 + rng.choice([0, 0, -30, 45, 5])])
            rows.append((i, pos, at if at is None or at >= 0 else 0, None, rng.choice([None, "interviewer", "subject"]), rng.choice(["a", "a", "eh", "..."]).replace("eh", "")))
    rows += rows[::7]
    rng.shuffle(rows)
    d, i = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1, "Docente rural")], INTERVIEWS)
    for bits in ({}, {"bits": 2, "time_bits": 5}, {"bits": 0, "time_bits": 0}):
        assert sorted(map(tuple, turn_starts(d, i, **bits).collect()), key=repr) == literal(rows)


def test_rows_as_they_are_typed():
    assert read_row("[00:01:44.862] subject - Le dije o sea, que no.", READER) == (104862, "subject", "Le dije que no.", True)
    assert read_row("00:01:05,597 --> **Docnete rural:** El niño (tos) dormía", READER) == (65597, "subject", "El niño dormía", True)
    assert read_row("eh, Nos vimos a las 12:30", READER)[:2] == (None, None)
    assert read_row("Nos vimos a las digamos, 12:30", READER)[0] is None
    assert read_row("Nos vimos ayer. min 2:05", READER)[0] == 125000
    assert read_row("Nota: (el de marzo) [PERSONA_1] vino", READER)[1:] == (None, "Nota: (el de marzo) [PERSONA_1] vino", True)
    assert read_row("[PERSONA_1]", READER)[3] and read_row("[Usuario]", READER)[3] is False
    for empty in (None, "", "  ", "[risas] eh... <Preg.> {0:10}", "♪♪ mmm", "[00:03:41] *ríe*"):
        assert not read_row(empty, READER)[3]
    assert read_row("palabra " * 100_000, READER)[3]


def test_rolling_captions():
    assert without_overlap("y al final de la tarde vino", "de la tarde vino el comité") == "el comité"
    assert without_overlap("de la tarde", "la tarde fue") == "la tarde fue"
    assert without_overlap(None, "x") == "x"


def test_long_captions():
    long = [f"w{k}" for k in range(301)]
    assert without_overlap(" ".join(["x", *long]), " ".join([*long, "fin"])) == "fin"
    rng = random.Random(5)
    for _ in range(3000):
        old, new = ([rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(2))
        n = max((k for k in range(3, min(len(old), len(new)) + 1) if old[-k:] == new[:k]), default=0)
        assert without_overlap(" ".join(old), " ".join(new)) == " ".join(new[n:])


def test_pause_across_chunks(spark):
    rows = [(1, 0, 0, None, "subject", "a"), (1, 1, 1_000, None, None, "b"), (1, 2, 5_001_000, None, None, "c"), (1, 3, 9_000_000, None, "interviewer", "d")]
    d, i = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1, None)], INTERVIEWS)
    for bits in ({}, {"bits": 0, "time_bits": 0}):
        assert calibrated_pause(d, i, 1.0, **bits).first().pause_ms == 5_000_000
    assert turn_starts(d, i, 4_000_000).count() == 3


def test_edges(spark):
    i = spark.createDataFrame([(1, "Docente rural"), (1, "DOCENTE"), (2, None)], INTERVIEWS)
    rows = [(1, 0, 5, 9, "Docente", "uno dos tres", "c", 1), (1, 1, 9, None, None, "uno dos tres cuatro", "c", 2), (1, 2, None, None, "Preg.", "¿y?", "c", 3), (None, 1, 1, 1, "subject", "a", "c", 4), (2, None, 1, 1, "subject", "a", "c", 5)]
    d = spark.createDataFrame(rows, ROWS + ", chunk string, at int")
    got = sorted(((r.start_ms, r.end_ms, r.speaker, r.n_rows, r.text) for r in clean_turns(d, i).collect()), key=repr)
    assert got == [(5, 9, "subject", 2, "uno dos tres cuatro"), (9, None, "interviewer", 1, "¿y?")]
    assert turn_starts(d.limit(0), i).count() == 0
