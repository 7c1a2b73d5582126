from pyspark.sql import functions as F

from tertulia.functions import formats
from tertulia.operators import catalog
from tertulia.schema import JOBS


def value(spark, s, f, kind="string"):
    return spark.createDataFrame([(s,)], f"v {kind}").select(f("v")).first()[0]


def test_formats(spark):
    assert value(spark, "2026-08-04 14:30:00", formats.spanish_date) == "4 de agosto de 2026, 14:30 hs"
    assert value(spark, "2026-08-24", formats.spanish_date) == "24 de agosto de 2026" and value(spark, "ayer", formats.spanish_date) == "ayer"
    assert [value(spark, n, formats.size_text, "bigint") for n in (2048, 3 * 1024**2, 5 * 1024**3)] == ["2 KB", "3.0 MB", "5.00 GB"]
    assert [value(spark, n, formats.duration_text, "double") for n in (5.0, 1294.0, 3720.4)] == ["5 s", "21 min 34 s", "1 h 2 min"]
    assert [value(spark, n, formats.stopwatch, "double") for n in (-1.0, 81.9, 3725.0)] == ["0:00", "1:21", "1:02:05"]
    assert value(spark, "a/b\\c.mp3", formats.base_name) == "c.mp3" and value(spark, "x/", formats.base_name) == "x/"
    assert [value(spark, n, formats.roman, "int") for n in (1, 4, 9, 14, 38)] == ["I", "IV", "IX", "XIV", "XXXVIII"]
    assert value(spark, "2026-08-24T14:30", formats.to_datetime_text) == "2026-08-24 14:30:00" and value(spark, "a.b.mp4", formats.extension) == ".mp4"
    assert value(spark, "a, A;b\r\n c ,, b", formats.keyword_list) == ["a", "b", "c"]
    assert value(spark, "uno\n \n\ndos", formats.paragraphs) == ["uno", "dos"] and value(spark, 1.74, formats.half_seconds, "double") == 1.5
    assert value(spark, "[3] (x) hola", formats.indexed_line)["text"] == "hola" and value(spark, "[x] hola", formats.indexed_line) is None
    assert value(spark, "Ana|PERSONA|x", formats.entity_line)["type"] == "PERSONA|x" and value(spark, "Ana|", formats.entity_line) is None
    assert value(spark, "manual", formats.source_of) == "manual" and value(spark, None, formats.source_of) == "none" and value(spark, "x", formats.role_of) is None
    assert value(spark, ["a", "b", "c"], lambda v: formats.joined(v, 1, 3), "array<string>") == "b c"
    assert value(spark, "hola [PERSONA_1] Hola", lambda v: formats.highlights(v, "hola")) == ["hola", "[PERSONA_1]", "Hola"]
    for a, b, ok in (("x" * 14, "y" * 39, True), ("x" * 14, "y" * 40, False), ("x" * 100, "y" * 59, False), ("x" * 100, "y" * 60, True), ("x" * 100, "y" * 160, True), ("x" * 100, "y" * 161, False), ("x", "", False)):
        assert value(spark, a, lambda v: formats.plausible_correction(v, F.lit(b))) == ok  # noqa: B023
    for head, mime, ok in ((b"RIFF1234WAVE", "audio/wav", True), (b"texto plano!", "audio/wav", False), (b"OggS", "audio/ogg", True), (b"0000ftypmp42", "video/mp4", True), (b"ID3xx", "audio/mpeg", True), (b"\xff\xfbxx", "audio/mpeg", True)):
        assert value(spark, bytearray(head), lambda v: formats.known_type(v, F.lit(mime)), "binary") == ok  # noqa: B023


def test_keywords(spark):
    rows = [(1, [" GES", "ges", "", None, "Fonasa\t"]), (2, ["ñ" * 41]), (3, ["a\x07b"]), (4, None), (5, [str(k) for k in range(101)]), (6, ["ñ" * 40])]
    got = {r.id: (r.keywords, r.error) for r in catalog.keywords(spark.createDataFrame(rows, "id int, keywords array<string>")).collect()}
    assert got == {1: (["GES", "Fonasa"], None), 2: (None, "too_long"), 3: (None, "control_char"), 4: ([], None), 5: (None, "too_many"), 6: (["ñ" * 40], None)}


def test_jobs(spark):
    t = "cast('2024-01-01 00:00:%s' as timestamp_ntz)"
    rows = [(1, 1, "failed", "transcribiendo", 0, 10), (2, 1, "running", "diarizando", 5, None), (3, 2, "pending", None, None, None), (4, 3, "completed", None, 1, 2)]
    j = spark.createDataFrame([], JOBS)
    for i, n, s, step, a, b in rows:
        at = lambda x: "cast(null as timestamp_ntz)" if x is None else t % f"{x:02d}"
        j = j.unionByName(spark.sql(f"select {i} id, {n} interview_id, '{s}' status, {'null' if step is None else repr(step)} current_step, {at(a)} started_at, {at(b)} finished_at"), allowMissingColumns=True)
    assert {(r.interview_id, r.seconds) for r in catalog.latest_duration(j).collect()} == {(1, 10), (3, 1)}
    assert [tuple(r) for r in catalog.current_step(j).collect()] == [(1, "diarizando")]
    i = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r.id for r in catalog.idle(i, j).collect()] == [3]
    assert {r.status for r in catalog.reclaimed(j).collect()} == {"failed", "completed"} and catalog.reclaimed_count(j).first()[0] == 2
    audio = spark.createDataFrame([(1,), (3,)], "interview_id int")
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id int")
    assert {r.id: r.outcome for r in catalog.admission(i, audio, j, asked).collect()} == {1: "already_queued", 2: "audio_required", 3: "queued", 9: "not_found"}
    assert {r.id for r in catalog.removed(j, i.where("id = 1")).collect()} == {3, 4}
    assert catalog.upserted(i.withColumn("x", F.lit(1)), spark.createDataFrame([(3, 2), (4, 2)], "id int, x int"), ["id"]).count() == 4
    assert sorted(r.id for r in catalog.appended(i, spark.createDataFrame([(7,), (3,)], "x int"), "x").collect()) == [1, 2, 3, 4, 5]
    assert {r.step: r.state for r in catalog.step_views(j).collect()}["diarizando"] == "current"
    assert catalog.truncated(i).count() == 0
    assert value(spark, "12abc", lambda v: catalog.integer_header(F.col(v))) == 12 and value(spark, "abc", lambda v: catalog.integer_header(F.col(v))) is None
    assert value(spark, '{"includeSummary": true, "enhanceTranscript": 1}', lambda v: catalog.process_options(F.col(v))).asDict() == {"include_summary": True, "enhance": False}
    assert value(spark, ".MP4", lambda v: catalog.is_video(F.col(v)))


def test_lists(spark):
    d = spark.createDataFrame([(1, "Grupal", "Médico", "failed"), (12, "piloto", None, "completed")], "id int, interview_type string, interview_subject_type string, status string")
    assert [r.id for r in catalog.search(d, " MÉDICO ").collect()] == [1] and catalog.search(d).count() == 2 and [r.id for r in catalog.search(d, "1", "completed").collect()] == [12]
    assert {r.status: r.n for r in catalog.status_counts(d).collect()} == {"all": 2, "pending_audio": 0, "pending_processing": 0, "processing": 0, "completed": 1, "failed": 1}
    assert [r.id for r in catalog.newest_first(d).collect()] == [12, 1]
