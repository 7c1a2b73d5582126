import random

from tertulia.llm.runs import event_runs

TURNS = "interview_id int, pos int, start_ms bigint, end_ms bigint, speaker string, text string"
INTERVIEWS = "id int, interview_subject_type string, status string"


def literal(rows, pause=2000):
    """The rule read aloud, one turn after the other."""
    found, once = [], {}
    for i, pos, start, end, who, text in rows:
        if text and text.strip():
            once[i, pos] = (start, end, (who or "").strip().lower())
    run, entity = None, None
    for (i, pos), (start, end, who) in sorted(once.items()):
        ends = [] if run is None else [e for e in run["ends"] if e is not None]
        goes_on = i == entity and who == run["who"] and not (start is not None and ends and start > max(ends) + pause)
        if not goes_on:
            run, entity = {"who": who, "first": pos, "ends": [], "n": 0}, i
            found.append((i, run))
        run["last"], run["n"] = pos, run["n"] + 1
        run["ends"].append(end)
    return sorted((i, r["first"], r["last"], r["n"]) for i, r in found)


def got(spark, rows, **how):
    t, i = spark.createDataFrame(rows, TURNS), spark.createDataFrame([(1, "Docente rural", "x"), (2, None, None)], INTERVIEWS)
    return sorted((r.interview_id, r.first_pos, r.last_pos, r.n_turns) for r in event_runs(t, i, **how).collect())


def test_against_the_rule_with_small_chunks(spark):
    rng = random.Random(7)
    maybe = lambda x: None if rng.random() < 0.25 else x
    rows = []
    for i in range(1, 25):
        at = 0
        for pos in range(rng.randint(1, 60)):
            at += rng.choice([0, 500, 1500, 2500, 9000])
            start = at - rng.choice([0, 0, 4000])
            rows.append((i, pos, maybe(start), maybe(start + rng.choice([-500, 0, 800, 6000])), rng.choice(["a1", "a1", "a1", "b1", None, " "]), rng.choice(["hola", "hola", " ", None])))
    rows += [r for r in rows if rng.random() < 0.1]
    rng.shuffle(rows)
    for bits in (0, 1, 3, 12):
        assert got(spark, rows, bits=bits) == literal(rows)


def test_spellings_nulls_and_repeats(spark):
    rows = [
        (1, 0, 0, 10, "INTERVIEWER ", "a"), (1, 1, 10, 20, "Entrevistadora:", "a"), (1, 1, 10, 20, "Entrevistadora:", " a "), (1, 2, 20, 30, "docente  RURAL", "a"),
        (1, 3, 30, 40, "Sujeto 1", "a"), (1, 4, 50, 60, None, "a"), (1, 5, None, None, "  ", "a"), (1, 6, 99, 99, "sujeto", None), (2, 0, 0, 1, "Docente rural", "a"),
        (2, 1, 0, 1, "subject", "a"), (None, 1, 0, 1, "subject", "a"), (2, None, 0, 1, "subject", "a"), (2, 2, 10**13, 10**13 + 1, "subject", "x" * 100_000),
    ]
    assert got(spark, rows) == [(1, 0, 1, 2), (1, 2, 3, 2), (1, 4, 5, 2), (2, 0, 0, 1), (2, 1, 1, 1), (2, 2, 2, 1)]


def test_empty_table_and_extra_columns(spark):
    assert got(spark, []) == []
    t = spark.createDataFrame([(1, 0, 0, 5, "subject", "a", "x", 1), (1, 1, 5, 9, "subject", "a", "y", 2)], TURNS + ", chunk string, types int")
    i = spark.createDataFrame([(1, "Docente", "x", "y")], INTERVIEWS + ", split string")
    r = event_runs(t, i).collect()
    assert [(x.n_turns, x.start_ms, x.end_ms, x.duration_ms, x.speaker) for x in r] == [(2, 0, 9, 9, "subject")]


def test_plans_that_change_while_they_run(spark, tmp_path):
    """Joins turned into broadcasts or split for skew at run time must not cut chunks apart; nor must tables beyond the static broadcast limit."""
    rng, rows = random.Random(3), []
    for i in range(1, 40):
        at = 0
        for pos in range(3000 if i == 1 else rng.randint(1, 200)):
            at += rng.choice([0, 500, 1500, 2500, 9000])
            rows.append((i, pos, at, at + rng.choice([0, 800, 6000]), rng.choice(["a1", "a1", "b1"]), "hola " * 5))
    rng.shuffle(rows)
    spark.createDataFrame(rows, TURNS).repartition(6).write.parquet(str(tmp_path / "turns"))
    spark.createDataFrame([(i, "Docente", "x") for i in range(1, 40)], INTERVIEWS).write.parquet(str(tmp_path / "interviews"))
    every = {
        "late broadcast": {"spark.sql.autoBroadcastJoinThreshold": "1KB", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"},
        "skew split": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"},
        "static": {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1KB"},
    }
    for name, conf in every.items():
        conf |= {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.localShuffleReader.enabled": "true"}
        old = {k: spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            for bits in (4, 12):
                found = event_runs(spark.read.parquet(str(tmp_path / "turns")), spark.read.parquet(str(tmp_path / "interviews")), bits=bits)
                assert sorted((r.interview_id, r.first_pos, r.last_pos, r.n_turns) for r in found.collect()) == literal(rows), (name, bits)
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
