import random

import pytest
from pyspark.sql import functions as F

from tertulia.functions import text
from tertulia.operators import quality

SEGMENTS = "interview_id int, pos int, t0 bigint, t1 bigint, text string"


def frame(spark, texts, step=100, length=100):
    return spark.createDataFrame([(1, k, k * step, k * step + length, t) for k, t in enumerate(texts)], SEGMENTS)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "s string").select(expression("s")).first()[0]


def test_text_primitives(spark):
    assert one(spark, "\t Ánimo \r\n", text.trim) == "Ánimo"
    assert one(spark, "ÁBC", text.lower_ascii) == "Ábc"
    assert one(spark, "ñandu", lambda s: text.levenshtein_bytes(s, F.lit("nandu"))) == 2
    assert one(spark, "¿Qué, tal?", text.normalized) == "¿quétal"
    assert one(spark, "¿Qué — sí", text.words) == ["que", "—", "si"]
    assert one(spark, "a\n\n b \n", text.lines) == ["a", "b"]
    for s, n in (("GES.", 1), ("gestión GES", 1), ("¿GES?", 0), ("GESTA", 0)):
        assert one(spark, s, lambda c: text.count_whole_words(c, F.lit("GES"))) == n
    assert one(spark, "el a$b dijo", lambda s: text.replace_whole_words(s, F.lit("a$b"), F.lit("c\\d$1"))) == "el c\\d$1 dijo"
    assert one(spark, "xxabcdñyy", lambda s: text.common_substring(s, F.lit("zabcdñz"))) == 6
    assert one(spark, "7265", lambda s: text.clock_cs(F.col(s).cast("bigint"))) == "01:12"


def test_hallucinations_and_density(spark):
    rows = [("Gracias por ver", 300, True), ("Gracias por ver", 301, False), ("Subtítulos por X", 6000, True), ("gracias", 10, False)]
    for t, length, known in rows:
        d = spark.createDataFrame([(1, 0, 0, length, t)], SEGMENTS)
        assert d.select(quality.known_hallucination("text", "t0", "t1")).first()[0] == known
    d = spark.createDataFrame([(1, 0, 0, 100, "x" * 45), (1, 1, 0, 100, "x" * 46), (1, 2, 5, 0, "x" * 11)], SEGMENTS)
    assert [r[0] for r in d.select(quality.too_dense("text", "t0", "t1")).collect()] == [False, True, True]
    dense = "esto se dijo una vez y otra vez y otra vez más"
    d = spark.createDataFrame([(1, 0, 0, 900, dense), (1, 1, 900, 910, dense), (1, 2, 910, 1900, "otra cosa"), (1, 3, 1900, 1905, "un texto denso pero único que se queda")], SEGMENTS)
    assert {r.pos: r.reason for r in quality.with_drop_reason(d).collect()} == {0: None, 1: "dense_repeat", 2: None, 3: None}


def test_echo(spark):
    prompt = "abcdefghijklmnopqrstuvwxyzabc"
    d = frame(spark, ["abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwxy", "abcdefghijklmnopqrstuvwxy" + "0" * 25, "abcdefghijklmnopqrstuvwxy" + "0" * 26, None])
    assert [r.echo for r in quality.with_echo(d, prompt).orderBy("pos").collect()] == [False, True, True, False, False]


def literal_runs(texts):
    runs, k = [], 0
    while k < len(texts):
        j = k + 1
        while j < len(texts) and quality.same_utterance(texts[k], texts[j]):
            j += 1
        if texts[k] and j - k >= (3 if len(texts[k].encode()) >= 15 else 4):
            runs.append((1, k, j - 1, j - k))
        k = j
    return runs


def test_loops(spark):
    rng = random.Random(3)
    pool = ["abc", "abcd", "", "estoeslargoylargo", "estoeslargoylargoymas", "yestoeslargoylargo", "ñañañañañañañá"]
    for _ in range(4):
        texts = [t for _ in range(40) for t in [rng.choice(pool)] * rng.choice([1, 1, 2, 3, 4])]
        assert sorted(map(tuple, quality.repeat_runs(frame(spark, texts)).collect())) == literal_runs(texts)
    d = quality.loops_replaced(frame(spark, ["hola", *["así fue la cosa entonces"] * 3, "chao"])).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in d] == [(0, "hola"), (1, "así fue la cosa entonces"), (2, "[audio no transcrito 00:02-00:04]"), (3, "chao")]
    assert quality.repeat_runs(frame(spark, ["a"]).limit(0)).count() == 0


def test_gaps_and_unpunctuated(spark):
    d = spark.createDataFrame([(1, 0, 900, 5000, "a"), (1, 1, 1000, 1100, "b"), (1, 2, 5799, 5800, "c"), (1, 3, 6600, 6700, "d")], SEGMENTS)
    end = spark.createDataFrame([(1, 7500)], "interview_id int, end_cs bigint")
    assert sorted(map(tuple, quality.gaps(d, end).collect())) == [(1, 0, 900), (1, 5800, 6600), (1, 6700, 7500)]
    for length, n in ((5999, 0), (6000, 1)):
        s = spark.createDataFrame([(1, 0, 0, 10, "a."), (1, 1, 10, 500, "b"), (1, 2, 500, 10 + length, "c"), (1, 3, 9000, 9100, "d?")], SEGMENTS)
        assert quality.unpunctuated_runs(s).count() == n
    s = frame(spark, ["a", "b", "c", "d"])
    ranges = spark.createDataFrame([(1, 7, 1, 2)], "interview_id int, run_id int, first_pos int, last_pos int")
    retry = spark.createDataFrame([(1, 7, 0, 100, 150, "x."), (1, 7, 1, 150, 190, "y."), (1, 7, 2, 190, 299, "z.")], "interview_id int, run_id int, pos int, t0 bigint, t1 bigint, text string")
    assert [r.text for r in quality.spliced(s, ranges, retry).orderBy("pos").collect()] == ["a", "x.", "y.", "z.", "d"]


@pytest.mark.parametrize(("n", "p", "words", "loop", "ok"), [(4, 2, 70, False, True), (4, 1, 70, False, False), (4, 2, 69, False, False), (4, 4, 100, True, False)])
def test_retry(spark, n, p, words, loop, ok):
    d = spark.range(1).select(quality.retry_accepted(F.lit(n), F.lit(p), F.lit(words), F.lit(100), F.lit(loop)))
    assert d.first()[0] == ok


RETRY = "interview_id int, run_id int, pos int, t0 bigint, t1 bigint, text string"
LONG = "así fue la cosa entonces."


def retries(spark, texts):
    """texts: run_id to the texts of its rows."""
    return spark.createDataFrame([(1, run, k, run * 1000 + k * 300, run * 1000 + k * 300 + 299, t) for run, x in texts.items() for k, t in enumerate(x)], RETRY)


def test_retries_that_are_no_better_are_not_taken(spark):
    s = frame(spark, [f"{a} uno dos tres" for a in "abcdefghijklmn"])
    ranges = spark.createDataFrame([(1, p, p, p + 1) for p in (0, 2, 4, 6, 8, 10, 12)], "interview_id int, run_id int, first_pos int, last_pos int")
    tried = {
        0: ["A uno dos.", "B dos tres."], 2: [LONG] * 3, 4: ["corto."], 6: ["sin punto alguno aquí", "ni aquí tampoco hay uno", "uno dos."],
        8: ["Subtítulos por la comunidad."], 10: ["Gracias por ver", "uno dos tres.", "cuatro cinco seis."],
    }
    got = [r.text for r in quality.repaired(s, ranges, retries(spark, tried)).orderBy("pos").collect()]
    old = [r.text for r in s.orderBy("pos").collect()]
    assert got == ["A uno dos.", "B dos tres.", *old[2:10], "uno dos tres.", "cuatro cinco seis.", *old[12:]]


def test_recovered_gaps_are_judged_alone(spark):
    tried = {1: [LONG] * 2, 2: [LONG] * 2, 3: [LONG] * 3, 4: ["Subtítulos por la comunidad", "sí"]}
    got = sorted((r.t0, r.text) for r in quality.accepted_recovered(retries(spark, tried)).collect())
    assert got == [(1000, LONG), (1300, LONG), (2000, LONG), (2300, LONG), (4300, "sí")]


def test_positions_beyond_24_bits(spark):
    far = 2**24
    s = spark.createDataFrame([(1, p, 100 * k, 100 * k + 50, f"r{k}", [(p, p, "w")]) for k, p in enumerate([0, 1, far - 1, far, far + 1, 2**30])], SEGMENTS + ", words array<struct<start_ms:bigint,end_ms:bigint,text:string>>")
    ranges = spark.createDataFrame([(1, 7, far, far + 1)], "interview_id int, run_id int, first_pos int, last_pos int")
    retry = spark.createDataFrame([(1, 7, far + k, 300 + k, 310, f"n{k}") for k in range(3)], RETRY)
    got = quality.spliced(s, ranges, retry).orderBy("pos").collect()
    assert [(r.pos, r.text, r.words is None) for r in got] == [(0, "r0", False), (1, "r1", False), (2, "r2", False), (3, "n0", True), (4, "n1", True), (5, "n2", True), (6, "r5", False)]
    late = spark.createDataFrame([(1, far * 3 + k, 100, 110, f"x{k}") for k in (1, 0)], SEGMENTS)
    assert [r.text for r in quality.with_recovered(s, late).orderBy("pos").collect()] == ["r0", "r1", "x0", "x1", "r2", "r3", "r4", "r5"]


def test_every_step_of_the_clean_up(spark):
    loop = ["así fue la cosa entonces"] * 3
    s = frame(spark, ["Hola.", *loop, "Subtítulos por la comunidad", *[f"uno dos tres {c}" for c in "abcdefg"], "Fin.", *["otra cosa que se repite"] * 3], 1000, 1000)
    retry = retries(spark, {1: ["Así fue.", "La cosa."], 13: [LONG] * 3})
    stretch = retries(spark, {3: [f"uno dos tres {c}." for c in "abcdefg"]})
    found = spark.createDataFrame([(1, 0, 0, 500, 600, "perdido"), (1, 1, 0, 510, 600, "Gracias por ver")], RETRY)
    got = [(r.pos, r.text) for r in quality.cleaned(s, loop_retries=retry, stretch_retries=stretch, recovered=found).orderBy("pos").collect()]
    assert [t for _, t in got] == ["Hola.", "perdido", "Así fue.", "La cosa.", *[f"uno dos tres {c}." for c in "abcdefg"], "Fin.", "otra cosa que se repite", "[audio no transcrito 02:20-02:40]"]
    assert [p for p, _ in got] == list(range(len(got)))


def test_echo_filter_loses_nothing(spark):
    rng = random.Random(2)
    flat = quality._plain_text(quality.STYLE_PROMPT)
    assert flat == one(spark, quality.STYLE_PROMPT, quality.plain)
    texts = []
    for _ in range(300):
        a = rng.randrange(len(flat))
        texts.append("".join(rng.choice("abxyz") for _ in range(rng.randint(0, 20))) + flat[a : a + rng.randint(10, 40)] + rng.choice(["", "zz"]))
    expected = [len(t) >= 25 and (n := max(j - i for i in range(len(t)) for j in range(i, len(t) + 1) if t[i:j] in flat)) >= 25 and 2 * n >= len(t) for t in texts]
    assert [r.echo for r in quality.with_echo(frame(spark, texts)).orderBy("pos").collect()] == expected and any(expected) and not all(expected)
