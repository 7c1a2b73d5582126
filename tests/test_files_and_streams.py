import datetime
import struct

import pytest
from pyspark.sql import functions as F

from tertulia import session
from tertulia.functions import text
from tertulia.operators import catalog, speakers
from tertulia.schema import SEGMENTS
from tertulia.sources import files
from tertulia.streaming import jobs

TURNS = "interview_id int, pos int, start_ms bigint, end_ms bigint, speaker string, text string"


def test_transcripts_there_and_back(spark, tmp_path):
    t = spark.createDataFrame([(1, 0, None, 5, "subject", "á\n\"x\""), (1, 1, 5, None, None, ""), (2, 0, 1, 2, "interviewer", "y")], TURNS)
    h = spark.createDataFrame([(1, "diarization", None), (2, "raro", "aviso"), (3, None, None)], "interview_id int, speaker_source string, notice string")
    files.write_transcripts(files.transcript_rows(t, h), str(tmp_path / "t"))
    turns, headers = files.read_transcripts(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, turns.select(*t.columns).collect()), key=repr) == sorted(map(tuple, t.collect()), key=repr)
    assert {(r.interview_id, r.version, r.speaker_source, r.notice) for r in headers.collect()} == {(1, 1, "diarization", None), (2, 1, "none", "aviso"), (3, 1, "none", None)}
    odd = spark.createDataFrame([(1, '{"turns": [{"speaker": "nadie"}]}'), (2, "no json")], "interview_id int, value string")
    turns, headers = files.parsed_transcripts(odd)
    assert [(r.speaker, r.text) for r in turns.collect()] == [(None, "")] and headers.count() == 1


def test_audio(spark, tmp_path):
    data = struct.pack("<4h", 0, 16384, -32768, 32767)
    wav = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"LIST" + struct.pack("<I", 2) + b"ab" + b"data" + struct.pack("<I", len(data)) + data
    (tmp_path / "a.wav").write_bytes(wav)
    (tmp_path / "b.wav").write_bytes(b"nada")
    got = {r.path[-5:]: r for r in files.wav_samples(files.audio_files(spark, str(tmp_path))).collect()}
    assert got["a.wav"].n_samples == 4 and got["a.wav"].samples[1:3] == [0.5, -1.0] and got["b.wav"].error == "no_wav"


def test_large_audio_keeps_its_row_and_files_are_written(spark, monkeypatch):
    d = spark.createDataFrame([("x", [0.5, -1.0, 2.0, 1e-9]), ("y", []), ("z", None)], "path string, samples array<float>").select("path", files.wav_file("samples").alias("content"))
    assert bytes(d.where("path = 'x'").first().content)[:44] == b"RIFF" + struct.pack("<I", 44) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 8)
    sized = d.withColumn("length", F.when(F.col("path") == "y", F.lit(2**31)).otherwise(F.length("content")))
    got = {r.path: r for r in files.wav_samples(sized).collect()}
    assert got["x"].samples == [0.5, -1.0, 32767 / 32768, 0.0] and got["y"].error == "too_large" and got["y"].samples is None and set(got) == {"x", "y", "z"}


def test_database_there_and_back(spark):
    url, rows = "jdbc:derby:memory:tertulia;create=true", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    files.write_jdbc(rows, url, "things", **options)
    more = catalog.appended(files.jdbc_table(spark, url, "things", **options).selectExpr("ID id", "NAME name"), spark.createDataFrame([(9, "z"), (7, "y")], "k int, name string"), "k")
    files.write_jdbc(more.where("id > 2").select("id", "name"), url, "things", **options)
    assert sorted(map(tuple, files.jdbc_table(spark, url, "things", **options).collect())) == [(1, "a"), (2, "b"), (3, "y"), (4, "z")]


def test_script_of_tables_runs_twice(spark, tmp_path):
    script = f"CREATE TABLE IF NOT EXISTS t_uno (id INT) USING parquet LOCATION '{tmp_path}/uno';\nCREATE TABLE IF NOT EXISTS t_dos (id INT) USING parquet LOCATION '{tmp_path}/dos';\n"
    try:
        files.created_tables(spark, script)
        files.created_tables(spark, script)
        assert spark.table("t_uno").count() == spark.table("t_dos").count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS t_uno")
        spark.sql("DROP TABLE IF EXISTS t_dos")


def test_shared_folders_need_a_name_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://x:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session(), "x")


def test_bytes_as_text(spark):
    cases = [(b"abc \xc3", "abc \ufffd"), (b"a\xe2\x82z\xc3\xa1", "a\ufffd\u00e1"), ("ñá".encode(), "ñá"), (b"\xff\xfe", "\ufffd\ufffd"), (None, None), (b"\xf0\x9f\x98", "\ufffd" * 3), (b"", ""), (b"\xc3(x", "\ufffdx"), (b"\n\xc3\xb1\n", "\nñ\n")]
    d = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, b binary")
    assert [r.t for r in d.select("k", text.valid_text("b").alias("t")).orderBy("k").collect()] == [t for _, t in cases]


def test_ranges(spark):
    cases = {"bytes=0-": (0, 2097151), "bytes=-500": (2999500, 2999999), "bytes=5-7": (5, 7), "bytes=3000000-": None, "bytes=-0": None, "bytes=7-5": None, "x": None, "bytes=-": None, "bytes=-9999999": (0, 2097151)}
    d = spark.createDataFrame([(h,) for h in cases], "h string").select("h", files.range_of("h", F.lit(3_000_000)).alias("r"))
    assert {r.h: r.r and (r.r["first"], r.r["last"]) for r in d.collect()} == cases
    b = spark.createDataFrame([(bytearray(b"abcdef"), "bytes=2-3")], "c binary, h string")
    assert bytes(b.select(files.bytes_in("c", files.range_of("h", F.length("c")))).first()[0]) == b"cd"
    assert spark.range(1).select(files.download(F.lit("x"))).first()[0] == "﻿x"


def test_tables_and_texts(spark, tmp_path):
    files.write_texts(spark.createDataFrame([(1, "a"), (2, "b")], "interview_id int, text string"), str(tmp_path / "x"))
    assert {r.interview_id: r.value for r in spark.read.text(str(tmp_path / "x")).collect()} == {1: "a", 2: "b"}
    files.write_segments(spark.createDataFrame([(1, 0, "a")], "interview_id int, pos int, text string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1


def test_segments_need_few_files_however_many_interviews(spark, tmp_path):
    rows = [(k % 301 or None, k // 301, k, k + 9, f"uno dos {k}" if k % 7 else "") for k in range(2408)]
    d = spark.createDataFrame(rows, "interview_id int, pos int, start_ms bigint, end_ms bigint, text string")
    folder = tmp_path / "s"
    files.write_segments(speakers.projected_words(files.gathered(d.repartition(8))), str(folder), compression="gzip")
    assert len(list(folder.rglob("part-*"))) <= files.FOLDERS and all(p.name.endswith(".json.gz") for p in folder.rglob("part-*"))
    read = spark.read.schema(SEGMENTS).json(str(folder))
    assert sorted((r.interview_id or 0, r.pos, r.start_ms, r.end_ms, r.text, [w.text for w in r.words]) for r in read.collect()) == sorted((i or 0, *rest, said, said.split()) for i, *rest, said in rows)
    plain = tmp_path / "plain"
    files.write_segments(d.repartition(8).drop("pos"), str(plain))
    assert len(list(plain.rglob("part-*"))) <= files.FOLDERS and spark.read.json(str(plain)).count() == len(rows)
    homes = spark.read.json(str(plain)).select("interview_id", F.regexp_extract(F.input_file_name(), "folder=([0-9]+)", 1).alias("f")).distinct()
    assert homes.count() == 301


def test_job_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 7, "enqueue", None, at(0)), (1, 7, "start", None, at(1)), (1, 7, "step", "diarizando", at(2)), (1, 7, "complete", None, at(3)), (1, 7, "start", None, at(4)), (2, 8, "start", None, at(0)), (3, 9, "enqueue", None, at(0)), (3, 9, "fail", None, at(1))]
    spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.json(str(tmp_path / "in"))
    q = jobs.job_states(jobs.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.job_id, r.status, r.step, r.interview_status) for r in spark.table("states").orderBy("job_id", "at").collect()]
    assert got == [(1, "pending", None, "pending_processing"), (1, "running", None, "processing"), (1, "running", "diarizando", "processing"), (1, "completed", None, "completed"), (3, "pending", None, "pending_processing"), (3, "failed", None, "failed")]
    seen = []
    jobs.run_queue(jobs.event_stream(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(60)
    assert sum(seen) == len(rows)


def test_hourly_events(spark):
    d = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 5), "view", 1.0), (datetime.datetime(2024, 1, 1, 0, 55), "view", 2.0)], "ts timestamp, event_type string, value double")
    assert [(r.n, r.total) for r in jobs.hourly_events(d).collect()] == [(2, 3.0)]
