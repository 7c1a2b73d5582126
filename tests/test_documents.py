import json

import duckdb
from pyspark.sql import functions as F

from tertulia.operators import documents, transforms
from tertulia.plans import document_queries

TURNS = "interview_id int, pos int, start_ms bigint, end_ms bigint, speaker string, text string"
EDITS = "interview_id int, pos int, speaker string, start double, end double, text string"


def test_merged_turns(spark):
    rows = [(1, 0, None, 5, "subject", "a"), (1, 1, 5, 6, "interviewer", " "), (1, 2, 6, None, "subject", "b"), (1, 3, 7, 8, None, "c"), (1, 4, 8, None, None, "d"), (1, 5, 9, 9, "subject", "e")]
    got = [(r.start_ms, r.end_ms, r.speaker, r.n_turns, r.text) for r in documents.merged(spark.createDataFrame(rows, TURNS)).orderBy("block").collect()]
    assert got == [(None, 5, "subject", 2, "a b"), (7, 8, None, 2, "c d"), (9, 9, "subject", 1, "e")]
    texts = " ".join(x[4] for x in got)
    assert texts == "a b c d e" and documents.merged(spark.createDataFrame([], TURNS)).count() == 0


def test_rendered(spark):
    rows = [(1, 0, 0, 1, "subject", "uno\ndos"), (1, 1, 1, 2, "interviewer", "¿y?"), (1, 2, 2, 3, None, "x"), (2, 0, 0, 1, None, "a"), (2, 1, 0, 1, None, " "), (2, 2, 0, 1, None, "b")]
    i = spark.createDataFrame([(1, "Paciente"), (2, None)], "id int, interview_subject_type string")
    notice = spark.createDataFrame([(2, "[AVISO] sin anonimizar")], "interview_id int, notice string")
    got = {r.interview_id: r.text for r in documents.rendered(spark.createDataFrame(rows, TURNS), i, notice).collect()}
    assert got == {1: "Paciente: uno dos\nInvestigador: ¿y?\nx\n", 2: "[AVISO] sin anonimizar\n\na\n\nb\n"}


def test_paragraphs(spark):
    d = lambda ends: spark.createDataFrame([(1, k, k, k + 1, None, "x" + e) for k, e in enumerate(ends)], TURNS)
    sizes = lambda ends: [r.n_lines for r in documents.paragraphs(d(ends)).orderBy("first_pos").collect()]
    assert sizes([":"] * 4 + [""]) == [4, 1]
    assert sizes([""] * 11) == [9, 2]
    assert sizes(["", ".", "", "", "", ".", "?"]) == [6, 1]


def test_legacy(spark):
    t = spark.createDataFrame([(1, "hola\nAna: uno\n dos\nAna: tres\nLuis: ¿y?\n"), (2, "a\nb.\nc\nd.\ne")], "interview_id int, text string")
    assert [(r.speaker, r.text) for r in documents.legacy_blocks(t).orderBy("block").collect()] == [(None, "hola"), ("Ana", "uno dos tres"), ("Luis", "¿y?")]
    assert [(r.n_lines, r.text) for r in documents.legacy_paragraphs(t).orderBy("first_pos").collect()] == [(4, "a b. c d."), (1, "e")]


def test_texts_of_no_interview(spark, tmp_path):
    d = spark.createDataFrame([(1, 7, "Ana: uno\nLuis: dos"), (2, None, "Ana: uno\nLuis: dos"), (3, None, "a\nb"), (4, 7, None), (2**40, 7, "c")], "doc_id bigint, interview_id int, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ids = lambda name: {r.interview_id for r in document_queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert ids("f5_legacy_blocks") == {1, 2} and ids("f4_legacy_paragraphs") == {3, 2**40} and ids("a14_label_share") == {1, 2, 3, 2**40}
    assert {r[0] for r in c.execute(document_queries.ORACLES["a14_label_share"]).fetchall()} == {1, 2, 3, 2**40}


def test_edits(spark):
    ok = [(1, 0, "", 0.0, 1.0005, " a\tb\n"), (1, 1, "interviewer", None, None, " ")]
    bad = [(2, 0, "nadie", None, None, "x"), (3, 0, None, 2.0, 1.0, "x"), (4, 0, None, -1.0, None, "x"), (5, 0, None, None, None, " "), (6, 3, None, None, None, "a\x01"), (7, 0, None, None, None, "ñ" * 10_001)]
    e = spark.createDataFrame(ok + bad, EDITS)
    assert {(r.interview_id, r.pos, r.fault) for r in documents.edit_faults(e).collect()} == {(2, 0, "unknown_speaker"), (3, 0, "bad_times"), (4, 0, "bad_times"), (5, None, "empty"), (6, 3, "control_char"), (7, 0, "too_long")}
    saved = documents.saved_edits(e).collect()
    assert [(r.start_ms, r.end_ms, r.speaker, r.text) for r in saved] == [(0, 1001, None, "a\tb")]
    t = spark.createDataFrame([(1, 0, 0, 9, "subject", "p"), (2, 0, 0, 9, "interviewer", "q")], TURNS)
    both = documents.overlaid(documents.saved_edits(e), t).collect()
    assert {(r.interview_id, r.source) for r in both} == {(1, "edited"), (2, "pipeline")}
    assert documents.swapped(documents.swapped(t)).exceptAll(t).count() == 0


def test_edits_of_every_interview(spark, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE turns AS SELECT 1 AS interview_id, CAST(k AS INT) AS pos, k * 10 AS start_ms, k * 10 + 5 AS end_ms, 'subject' AS speaker, 'abc' AS text FROM range(20001) r(k)")
    c.execute("INSERT INTO turns SELECT i, k, k * 10, k * 10 + 5, 'subject', CASE WHEN i = 2 AND k = 4 THEN 'abcde' WHEN i = 3 AND k = 6 THEN 'abcdefg' ELSE 'abc' END FROM range(2, 5) a(i), range(8) r(k)")
    c.execute(f"COPY turns TO '{tmp_path}/turns.parquet'")
    expected = {"p5_edit_faults": {(1, None, "too_many"), (2, 4, "unknown_speaker"), (3, 6, "control_char")}, "p5_saved_edits": {(4, k, k * 10, k * 10 + 5, "subject", "abc") for k in range(8)}}
    for name, rows in expected.items():
        assert set(map(tuple, document_queries.QUERIES[name](spark, str(tmp_path)).collect())) == rows
        assert set(c.execute(document_queries.ORACLES[name]).fetchall()) == rows


def test_edit_log(spark):
    b = spark.createDataFrame([(1, 0, 0, 9, "subject", "uno dos"), (1, 1, 9, 20, "interviewer", "tres"), (1, 2, 20, None, "subject", "x")], TURNS)
    log = spark.createDataFrame([(1, 1, "split", 0, 3), (1, 2, "merge", 2, 0), (1, 3, "remove", 2, 0), (1, 4, "merge", 99, 0)], "interview_id int, seq int, op string, pos int, at int")
    got = [(r.start_ms, r.end_ms, r.text) for r in documents.edited_blocks(b, log).orderBy("pos").collect()]
    assert got == [(0, None, "uno"), (None, 20, "dos tres")]


def test_edits_of_a_transcript_that_is_too_long_or_blank_on_one_side(spark):
    n = documents.EDIT_BLOCKS
    b = spark.range(n + 5).selectExpr("1 interview_id", "cast(id as int) pos", "id start_ms", "id end_ms", "'subject' speaker", "'uno dos' text")
    few = spark.createDataFrame([(2, 0, 0, 9, "subject", "uno dos"), (2, 1, 9, 9, None, None)], TURNS)
    log = spark.createDataFrame([(1, 1, "remove", 0, 0), (2, 1, "split", 0, 0), (2, 2, "split", 0, 99), (2, 3, "merge", 1, 0)], "interview_id int, seq int, op string, pos int, at int")
    got = documents.edited_blocks(b.unionByName(few), log)
    assert got.where("interview_id = 1").agg(F.count("*"), F.countDistinct("pos"), F.max("pos")).first() == (n + 5, n + 5, n + 4)
    assert [(r.pos, r.text) for r in got.where("interview_id = 2").collect()] == [(0, "uno dos")]


def test_stored_texts(spark):
    t = spark.createDataFrame([(1, "[AVISO] uno\ndos\n\nInvestigador: ¿y?\nEntrevistado:sí\nbueno\nOtro: x"), (2, "[AVISO] solo"), (3, "hola\n\nInvestigador sin dos puntos"), (4, None)], "interview_id int, text string")
    parted = documents.without_notice(t)
    assert {r.interview_id: r.notice for r in parted.collect()} == {1: "[AVISO] uno\ndos", 2: "[AVISO] solo", 3: None, 4: None}
    assert [(r.speaker, r.text) for r in documents.legacy_blocks(parted, documents.LEGACY_ROLES).orderBy("block").collect()] == [("interviewer", "¿y?"), ("subject", "sí bueno Otro: x")]
    assert [(r.interview_id, r.text) for r in documents.legacy_paragraphs(parted, documents.LEGACY_ROLES).collect()] == [(3, "hola Investigador sin dos puntos")]


def test_documents_as_json(spark):
    b = spark.createDataFrame([(1, 1, 1500, None, "subject", "b"), (1, 0, None, 900, None, 'a "x"')], TURNS)
    h = spark.createDataFrame([(1, "manual", True, None, "corto"), (2, "none", False, "aviso", None)], "interview_id int, speaker_source string, edited boolean, notice string, summary string")
    got = {r.interview_id: json.loads(r.value) for r in documents.serialized(b, h, spark.createDataFrame([(1, "Docente")], "id int, interview_subject_type string")).collect()}
    assert got[1] == {"id": 1, "has_speakers": True, "has_timestamps": True, "speaker_source": "manual", "edited": True, "notice": None, "summary": "corto", "speakers": [{"key": "interviewer", "label": "Investigador"}, {"key": "subject", "label": "Docente"}], "blocks": [{"speaker": None, "start": None, "end": 0.9, "text": 'a "x"'}, {"speaker": "subject", "start": 1.5, "end": None, "text": "b"}]}
    assert got[2]["blocks"] == [] and got[2]["notice"] == "aviso" and not got[2]["has_speakers"]


def test_changed(spark):
    a = spark.createDataFrame([(1, 0, 1, 2, "subject", "x"), (1, 0, 1, 2, "subject", "x"), (2, 0, 1, 2, None, "y"), (3, 0, None, None, None, None)], TURNS)
    b = spark.createDataFrame([(1, 0, 1, 2, "subject", "x"), (2, 0, 1, 2, None, "y"), (3, 0, None, None, None, None), (4, 0, 1, 1, None, "z")], TURNS)
    assert sorted(r[0] for r in documents.changed(a, b).collect()) == [1, 4] and documents.changed(a, a).count() == 0


def test_active_blocks(spark):
    b = spark.createDataFrame([(1, 0, 10), (1, 1, None), (1, 2, 20), (1, 3, 20), (1, 4, 30)], "interview_id int, pos int, start_ms bigint")
    t = spark.createDataFrame([(1, x) for x in (9, 10, 19, 20, 29, 99)], "interview_id int, time_ms bigint")
    got = {r.time_ms: (r.first_pos, r.last_pos) for r in documents.active_blocks(b, t).collect()}
    assert got == {10: (0, 1), 19: (0, 1), 20: (2, 3), 29: (2, 3), 99: (4, 4)}


def test_counts(spark):
    d = spark.createDataFrame([(1, "Ánimo [PERSONA_1] ánimo [LUGAR]"), (1, None), (2, "[abc] a.b")], "interview_id int, text string")
    assert {r[0]: r[1] for r in documents.match_counts(d, "ánimo").collect()} == {1: 2, 2: 0}
    assert {r[0]: r[1] for r in documents.match_counts(d, "a.b").collect()} == {1: 0, 2: 1}
    assert {r[0]: r[1] for r in documents.match_counts(d, "a").collect()} == {1: 0, 2: 0}
    assert {r[0]: r[1] for r in documents.marker_counts(d).collect()} == {1: 2, 2: 0}


def test_glossary(spark):
    s = spark.createDataFrame([(1, 0, "el ges y el gees. GESTA"), (1, 1, "nada"), (1, 40, "ges")], "interview_id int, pos int, text string")
    g = spark.createDataFrame([(1, 0, "GES"), (1, 1, "ges"), (1, 2, "Fonasa")], "interview_id int, pos int, term string")
    p = spark.createDataFrame(
        [(1, 0, 0, "gees", "ges"), (1, 0, 1, "el gees", "GES"), (1, 0, 2, "nada", "GES"), (1, 0, 3, "gees", "otro"), (1, 0, 4, "fonasa", "GES"), (1, 0, 5, "gesx", "GES"), (1, 0, 6, "", "GES"), (1, 1, 0, "gees", "GES")],
        "interview_id int, block int, pos int, original string, term string",
    )
    ok = transforms.accepted_proposals(s, g, p)
    assert {(r.block, r.original, r.term) for r in ok.collect()} == {(0, "gees", "GES"), (0, "el gees", "GES")}
    done = transforms.glossary_applied(s, ok)
    assert {r.pos: r.text for r in done.collect()} == {0: "el ges y GES. GESTA", 1: "nada", 40: "ges"}
    assert [tuple(r) for r in transforms.change_log(done).collect()] == [(1, 1, "el gees", "GES")]


def test_anonymize(spark):
    rows = spark.createDataFrame([(1, 0, "Ana y Anabel Soto, ana"), (2, 0, "Ana")], "interview_id int, pos int, text string")
    e = spark.createDataFrame([(1, 0, 0, "Ana", "PERSONA"), (1, 1, 0, "ANA", "PERSONA"), (1, 1, 1, "Anabel Soto", "PERSONA"), (1, 1, 2, "Sur", "LUGAR")], "interview_id int, chunk int, pos int, text string, type string")
    assert {(r.original, r.placeholder) for r in transforms.placeholders(e).collect()} == {("Ana", "[PERSONA_1]"), ("Anabel Soto", "[PERSONA_2]"), ("Sur", "[LUGAR_1]")}
    assert {r.interview_id: r.text for r in transforms.anonymized(rows, e).collect()} == {1: "[PERSONA_1] y [PERSONA_2], ana", 2: "Ana"}
    short = spark.createDataFrame([(1, 0, 0, "Ana", "P")], "interview_id int, chunk int, pos int, text string, type string")
    one = rows.where("interview_id = 1")
    assert transforms.anonymized(one, short).first().text == "[P_1] y [P_1]bel Soto, ana"
    assert transforms.anonymized(one, short, "whole_word").first().text == "[P_1] y Anabel Soto, ana"


def test_chunks_and_answers(spark):
    rows = spark.createDataFrame([(1, 0, "a" * 1500), (1, 1, "b" * 1498), (1, 2, "c" * 3001), (1, 3, "d"), (1, 4, " ")], "interview_id int, pos int, text string")
    got = [r.text for r in transforms.text_chunks(rows).orderBy("chunk").collect()]
    assert [len(x) for x in got] == [2999, 3001, 1]
    t = spark.createDataFrame([(1, 0, "hola qué tal estás hoy"), (1, 1, "sí"), (1, 2, "no")], "interview_id int, pos int, text string")
    r = spark.createDataFrame([(1, 0, 0, "[1] (Investigador) Hola, ¿qué tal estás hoy?"), (1, 0, 1, "[1] otra"), (1, 0, 2, "[2] " + "x" * 40), (1, 0, 3, "sin número"), (1, 0, 4, "[3] No.")], "interview_id int, chunk int, pos int, line string")
    assert [x.text for x in transforms.corrected_turns(t, r).orderBy("pos").collect()] == ["Hola, ¿qué tal estás hoy?", "sí", "No."]
    c = spark.createDataFrame([(1, 0, "Uno. Dos."), (1, 1, "Tres. Cuatro."), (2, 0, "Solo.")], "interview_id int, chunk int, text string")
    assert {x.interview_id: x.summary for x in transforms.summarized(c, transforms.first_sentence).collect()} == {1: "Uno.", 2: "Solo."}
    assert transforms.continuity(spark.range(125).selectExpr("1 interview_id", "cast(id as int) pos", "cast(id as string) text")).where("chunk = 1").first().context == "57\n58\n59"


def test_labels(spark):
    d = spark.createDataFrame([("interviewer", "X"), ("subject", " X "), ("subject", " "), (None, "X")], "r string, s string")
    assert [x[0] for x in d.select(documents.label(F.col("r"), F.col("s"))).collect()] == ["Investigador", "X", "Entrevistado", ""]
