import random

from pyspark.sql import functions as F

from tertulia.operators.intervals import islands, periods_and_gaps
from tertulia.operators.ordered import counted, filled, lagged, renumbered, running, with_neighbours

TURNS = "interview_id int, start_ms bigint, end_ms bigint"


def literal(rows, max_gap):
    found = []
    for i in {r[0] for r in rows}:
        merged = []
        for s, e in sorted((s, e) for j, s, e in rows if j == i and s is not None and e is not None and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        found += [(i, "period", s, e) for s, e in merged]
        found += [(i, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if max_gap is None or b[0] - a[1] <= max_gap]
    return sorted(found, key=repr)


def test_periods_and_gaps_with_small_chunks(spark):
    rng = random.Random(2)
    rows = []
    for i in [None, *range(12)]:
        for _ in range(rng.randint(0, 60)):
            s = rng.randint(-50, 400)
            rows.append((i, rng.choice([None, s, s, s, s]), rng.choice([None, s - 3, s, s + 1, s + 4, s + 9, s + 120])))
    rows += rows[::5]
    d = spark.createDataFrame(rows, TURNS)
    for bits in (0, 2, 5, 20):
        for most in (7, None):
            assert sorted(map(tuple, periods_and_gaps(d, max_gap=most, bits=bits).collect()), key=repr) == literal(rows, most)


def test_interval_edges(spark):
    d = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b"), (1, 21, 2**45, "c"), (2, 5, 5, "d")], TURNS + ", gap_from string").withColumn("kind", F.lit(1))
    assert sorted(map(tuple, periods_and_gaps(d).collect())) == [(1, "gap", 20, 21), (1, "period", 0, 20), (1, "period", 21, 2**45)]
    assert periods_and_gaps(d.limit(0)).count() == 0 and islands(d.where("interview_id = 2")).count() == 0


def test_ordered_state_equals_whole_windows(spark):
    rng = random.Random(5)
    rows = [(i, p, rng.choice([None, 1, 2, 3, 9])) for i in range(6) for p in sorted(rng.sample(range(200), rng.randint(1, 60)))]
    d = spark.createDataFrame(rows, "interview_id int, pos int, v int")
    whole = {}
    for i in range(6):
        own, best, last = [r for r in rows if r[0] == i], None, None
        for k, (_, p, v) in enumerate(own):
            prior = best
            best = v if best is None else best if v is None else max(best, v)
            last = v if v is not None else last
            whole[i, p] = (k, None if k == 0 else own[k - 1][2], k == 0, prior, best, last, sum(1 for x in own[: k + 1] if x[2] == 1))
    for bits in (0, 2, 4, 12):
        x = lagged(d, {"before": F.col("v")}, bits=bits)
        x = running(running(x, F.col("v"), "prior", F.max, bits=bits, itself=False), F.col("v"), "best", F.max, bits=bits)
        x = counted(filled(x, "v", "last", bits=bits), F.coalesce(F.col("v") == 1, F.lit(False)), "ones", bits=bits)
        x = renumbered(x.withColumn("_old", F.col("pos")).drop("pos"), "k", order="_old", bits=bits)
        got = {(r.interview_id, r["_old"]): (r.k, r.before, r.is_first, r.prior, r.best, r["last"], r.ones) for r in x.collect()}
        assert got == whole
    dense = spark.createDataFrame([(1, p, str(p)) for p in range(25)], "interview_id int, pos int, t string")
    for bits in (2, 3, 12):
        near = {r.pos: r.near for r in with_neighbours(dense, "t", 3, "near", bits=bits).collect()}
        assert near == {p: [str(q) for q in range(max(0, p - 3), min(25, p + 4)) if q != p] for p in range(25)}
