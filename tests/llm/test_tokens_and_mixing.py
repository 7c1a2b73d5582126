import random

import pytest

from tertulia.llm import mixing
from tertulia.llm.tokens import Automaton, count_tokens, decode_corpus, encode_corpus, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    theirs = tokenizers.Tokenizer.from_file(vocabulary_path())
    theirs.encode_special_tokens = True
    with open(vocabulary_path(), "rb") as f:
        return Automaton(f.read()), theirs


def test_same_ids_as_the_public_tokenizer(both):
    ours, theirs = both
    rng = random.Random(5)
    odd = [chr(c) for c in [*range(0, 0x250), *range(0x2000, 0x2070), 0x3000, 0x1680, 0xFEFF, 0x1F600, 0x4E00, 0x661]]
    texts = ["", " ", "<|endoftext|>", "aaaaaaaaaaaaaaaa", "  \n\n x", "a" * 30_000]
    for _ in range(4000):
        pool = odd if rng.random() < 0.5 else list("aeinst 'd\n\t1290ñ")
        texts.append("".join(rng.choices(pool, k=rng.randint(1, 40))))
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode(t, add_special_tokens=False).ids
        assert ours.decode(ids) == t


def test_corpus(spark):
    rows = [(1, "Hola, ¿qué tal?", 9), (2, None, 9), (3, "", 9), (4, " \n", 9), (None, "x", 9), (1, "Hola, ¿qué tal?", 9), (5, "largo " * 50_000, 9)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode_corpus(d)
    by = {r.doc_id: r.ids for r in got.collect()}
    assert got.count() == 7 and by[2] == [] and by[3] == [] and len(by[4]) == 2 and len(by[5]) >= 50_000
    back = {r.doc_id: r.text for r in decode_corpus(got).collect()}
    assert back[1] == rows[0][1] and back[2] == "" and back[5] == rows[-1][1]
    assert {(r.doc_id, r.n_tokens) for r in count_tokens(d, ["doc_id"]).collect()} == {(k, len(v)) for k, v in by.items()}
    assert encode_corpus(d.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(1)
    rows = [(k, "uno dos tres " * rng.randint(1, 30), rng.choice(["a", "a", "a", "a", "b", "c", None, "z"])) for k in range(3000)]
    rows += rows[:50] + [(9000, None, "a"), (9001, "", "b"), (None, "x", "a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("repeats", mixing.F.lit(1))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, t)
    drawn = mixed.collect()
    assert len({r.doc_id for r in drawn}) == len(drawn) and {r.source for r in drawn} == {"a", "b", "c"}
    assert all(r.repeats <= {"a": 1, "b": 2, "c": 4}[r.source] for r in drawn)
    got = {r.source: r for r in mixing.shares(mixed, t).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[s].actual_share - share / 0.9) < 0.005
    assert got["none"].n_docs == 0 and got["none"].actual_share == 0
    # one source gives all it may, to the last document
    assert any(got[s].most_repeats == m and got[s].n_draws == m * sum(r.source == s for r in drawn) for s, m in (("a", 1), ("b", 2), ("c", 4)))
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mixing.mix(d.repartition(7), t).collect()))
    less = {r.source: r.n_tokens for r in mixing.shares(mixing.mix(d, t, total_tokens=9000), t).collect()}
    assert abs(sum(less.values()) - 9000) < 150
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


def test_chunks_follow_the_size_of_the_largest_source():
    assert [mixing.chunk_shift(n) for n in (0, 1, 4096, 4097, 10**6, 10**10)] == [32, 32, 32, 31, 24, 10]
