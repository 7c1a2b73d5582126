"""Sources and sinks: transcript JSON, plain texts, WAV files, byte ranges, and JDBC tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tertulia.functions.formats import source_of
from tertulia.schema import TRANSCRIPT_JSON

RANGE_CAP = 2 * 1024**2
#: Bytes of a WAV file up to which its samples come out in one row; a row holds no more than 2 GiB.
WAV_MAX_BYTES = 512 * 1024**2
#: Folders of written segments, and the column that names them.
FOLDERS, FOLDER = 64, "folder"
# Sampling of normalised audio.
SAMPLE_RATE, SAMPLE_BITS = 16_000, 16


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table or query of a database; with partitionColumn, lowerBound, upperBound and numPartitions read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Rows appended to a database table, with batches and partitions as the options say; ids come from catalog.appended()."""
    rows.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()


def created_tables(spark: SparkSession, script: str) -> None:
    """S3: runs a script of CREATE TABLE IF NOT EXISTS statements, which may be run again."""
    for statement in (s.strip() for s in script.split(";")):
        if statement:
            spark.sql(statement)


def transcript_rows(turns: DataFrame, headers: DataFrame) -> DataFrame:
    """(interview_id, value): the JSON document of each interview: turns nested in order, header (interview_id, speaker_source, notice)."""
    turn = F.struct("pos", "start_ms", "end_ms", "speaker", F.make_valid_utf8("text").alias("text"))
    nested = turns.groupBy("interview_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t.dropFields("pos")).alias("turns"))
    whole = headers.join(nested, "interview_id", "left")
    body = F.struct(F.lit(1).alias("version"), source_of("speaker_source").alias("speaker_source"), "notice", F.coalesce("turns", F.array().cast(nested.schema["turns"].dataType)).alias("turns"))
    return whole.select("interview_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_transcripts(documents: DataFrame, path: str) -> None:
    """One folder for each interview; the committer makes the files appear at once."""
    documents.write.mode("overwrite").partitionBy("interview_id").text(path)


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, headers) of what write_transcripts wrote; unreadable documents are left out, missing fields have their defaults."""
    return parsed_transcripts(spark.read.text(path, wholetext=True))


def parsed_transcripts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, headers) of JSON documents (interview_id, value)."""
    read = documents.withColumn("d", F.from_json("value", TRANSCRIPT_JSON)).where(F.col("d").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")))
    headers = read.select("interview_id", F.coalesce("d.version", F.lit(1)).alias("version"), source_of("d.speaker_source").alias("speaker_source"), F.col("d.notice").alias("notice"))
    each = read.select("interview_id", F.posexplode("d.turns").alias("pos", "t"))
    role = F.when(F.col("t.speaker").isin("interviewer", "subject"), F.col("t.speaker"))
    return each.select("interview_id", "pos", "t.start_ms", "t.end_ms", role.alias("speaker"), F.coalesce("t.text", F.lit("")).alias("text")), headers


def gathered(segments: DataFrame) -> DataFrame:
    """segments with the folder of their interview, an interview's rows together and in order. Folders of much are cut into
    several tasks, small ones share one. To be done before words are added, as the rows are shuffled and sorted."""
    order = [c for c in ("pos", "start_ms") if c in segments.columns]
    placed = segments.withColumn(FOLDER, F.pmod(F.hash("interview_id"), F.lit(FOLDERS))).hint("rebalance", F.col(FOLDER))
    return placed.sortWithinPartitions(FOLDER, "interview_id", *order)


def write_segments(segments: DataFrame, path: str, **options: str) -> None:
    """Segments with their words, or acoustic turns, as JSON lines. All lines of an interview are in one of
    FOLDERS folders, so files grow with the bytes and not with interviews times tasks."""
    placed = segments if FOLDER in segments.columns else gathered(segments)
    placed.write.mode("overwrite").partitionBy(FOLDER).options(**options).json(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Plain texts (interview_id, text), a folder for each interview."""
    texts.select("interview_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("interview_id").text(path)


def download(text: str | Column) -> Column:
    """A text with a byte order mark ahead."""
    return F.concat(F.lit("﻿"), F.col(text) if isinstance(text, str) else text)


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _wav(content: bytes) -> tuple:
    """(number of samples, seconds, samples, error) of a mono 16-bit WAV file."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None, None, None, "no_wav"
    at, rate = 12, SAMPLE_RATE
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = memoryview(content)[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 8:
            rate = int.from_bytes(body[4:8], "little") or SAMPLE_RATE
        if name == b"data":
            values = np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
            return len(values), len(values) / rate, values, None
        at += 8 + size + size % 2
    return None, None, None, "no_data"


def wav_samples(files: DataFrame) -> DataFrame:
    """(path, n_samples, duration_s, samples, error) of mono 16-bit WAV files: samples as floats in [-1, 1).

    error is 'no_wav' or 'no_data' where there is no RIFF/WAVE head or no data chunk, and
    'too_large' of files over WAV_MAX_BYTES, which keep a row without samples: those are read by
    S13's ranges. Files are read one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                n, seconds, samples, error = _wav(content.as_py()) if content.is_valid else (None, None, None, "too_large")
                values = pa.array([samples], pa.list_(pa.float32())) if samples is None else pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(samples))
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n], pa.int64()), pa.array([seconds], pa.float64()), values, pa.array([error], pa.string())], names=["path", "n_samples", "duration_s", "samples", "error"])

    kept = F.when(F.col("length") <= WAV_MAX_BYTES, F.col("content"))
    return files.select("path", kept.alias("content")).mapInArrow(run, "path string, n_samples bigint, duration_s double, samples array<float>, error string")


def wav_file(samples: str | Column) -> Column:
    """The bytes of a mono 16-bit WAV file of SAMPLE_RATE: a head of 44 bytes and the samples, an array of floats in [-1, 1] that are cut to that range."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else _wav_bytes(np.asarray(x, np.float32)) for x in b])

    return F.pandas_udf(run, "binary")(F.col(samples) if isinstance(samples, str) else samples)


def _wav_bytes(samples: np.ndarray) -> bytes:
    data = np.clip(np.rint(samples * 32768), -32768, 32767).astype("<i2").tobytes()
    width = SAMPLE_BITS // 8
    form = struct.pack("<HHIIHH", 1, 1, SAMPLE_RATE, SAMPLE_RATE * width, width, SAMPLE_BITS)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    return chunk(b"RIFF", b"WAVE" + chunk(b"fmt ", form) + chunk(b"data", data))


def range_of(header: str | Column, size: str | Column) -> Column:
    """struct(first, last) of a Range header over a file's size, null where it cannot be served (416).

    'bytes=a-b', 'bytes=a-' and 'bytes=-n' are known; at most RANGE_CAP bytes come at once.
    """
    h, n = (F.col(x) if isinstance(x, str) else x for x in (header, size))
    a, b = (F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", k).try_cast("bigint") for k in (1, 2))
    first = F.when(a.isNotNull(), a).otherwise(F.greatest(n - b, F.lit(0)))
    last = F.least(F.coalesce(F.when(a.isNotNull(), b), n - 1), n - 1, first + RANGE_CAP - 1)
    good = F.rlike(h, F.lit(r"^bytes=(\d+-\d*|-\d+)$")) & (first < n) & (last >= first) & (a.isNotNull() | (b > 0))
    return F.when(good, F.struct(first.alias("first"), last.alias("last")))


def bytes_in(content: str | Column, span: Column) -> Column:
    """The bytes of a content in a range_of() span."""
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(c, (span["first"] + 1).cast("int"), (span["last"] - span["first"] + 1).cast("int"))
