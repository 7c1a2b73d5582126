import random

from tertulia.llm import vocabulary
from tertulia.llm.roles import fold, swaps_apart
from tertulia.llm.vocabulary import Vocabulary, all_matches, edits_for, mapped_fields, mapped_values

TERMS = [(1, "NOBEFE", None), (2, "Plan Caracola", "LIBAK"), (3, "Cerro Talebién", None), (4, "derivación asistida", " "), (5, "Monitora de ingreso", None), (6, None, "ZARAZ"), (None, "Nada", None), (5, "Monitora de ingreso", None)]


def test_automaton_against_the_distance():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(150)]
    v = Vocabulary(list(enumerate(words)))
    for _ in range(300):
        value = "".join(rng.choices("abcde", k=rng.randint(1, 10)))
        for most in (0, 1, 2, 3):
            near = {k: d for k, w in enumerate(words) if (d := swaps_apart(value, w, 9)) <= most}
            assert {k: e for k, (e, _) in v.within(value, most).items()} == near


def test_values():
    v = Vocabulary([(i, t) for i, t, _ in TERMS if t] + [(2, "LIBAK"), (6, "ZARAZ")])
    for value, i in [("nobefe", 1), ("«NOVEFE»", 1), ("no befe", 1), ("libac", 2), ("PlanCaracla", 2), ("kerro taleven", 3), ("asistida, derivación", 4), ("Asistida derivasión", 4), ("monitoradeingrezo", 5), ("n/a", -1), ("plan", -1), ("quesillo", -1), ("...", -1), ("x" * 50_000, -1)]:
        assert v.best(value)[0] == i, value
    assert [edits_for(n) for n in (1, 8, 9, 11, 12, 40)] == [1, 1, 2, 2, 3, 3]
    assert fold(" ¡Él  niño! ") == "el nino"


def test_fields(spark):
    terms = spark.createDataFrame(TERMS, "term_id int, term string, alias string")
    i = spark.createDataFrame([(1, ["nobefe", None, " ", "NOBEFE", "zarz"], "a"), (1, ["nobefe", None, " ", "NOBEFE", "zarz"], "b"), (2, None, "c"), (3, [], "d")], "id int, keywords array<string>, value string")
    g = spark.createDataFrame([(1, 4, "plan karacola", "Plan Caracola"), (1, 4, "plan karacola", "Plan Caracola"), (2, None, None, "libak"), (None, 7, "xx", "\t"), (3, 1, "Nada", "")], "interview_id int, line bigint, original string, term string")
    got = [(r.field, r.interview_id, r.item, r.term_id) for r in mapped_fields(i, g, terms).collect()]
    assert sorted(got, key=repr) == sorted([("keywords", 1, 0, 1), ("keywords", 1, 4, 6), ("original", 1, 4, 2), ("term", 2, None, 2), ("original", None, 7, -1)], key=repr)
    assert mapped_fields(i.limit(0), g.limit(0), terms).count() == 0
    assert {r.term_id for r in mapped_fields(i, g, terms.limit(0)).collect()} == {-1}
    values = spark.createDataFrame([("zarz",), ("zarz",), (None,), ("nope nope",)], "value string")
    assert {(r.value, r.term_id, r.edits) for r in mapped_values(values, terms).collect()} == {("zarz", 6, 1), ("nope nope", -1, None)}
    assert [(r.value, r.term_id, r.place) for r in all_matches(values, terms).collect()] == [("zarz", 6, 1)]


def test_a_hot_value_is_searched_once_and_salted(spark, monkeypatch):
    terms = spark.createDataFrame(TERMS, "term_id int, term string, alias string")
    rows = spark.range(3000).selectExpr("cast(id % 50 as int) interview_id", "id line", "if(id % 3 = 0, 'novefe', concat('xyz', id)) original", "cast(null as string) term")
    empty = spark.createDataFrame([], "id int, keywords array<string>")
    small = {(r.item, r.term_id) for r in mapped_fields(empty, rows, terms).collect()}
    assert small == {(k, 1 if k % 3 == 0 else -1) for k in range(3000)}
    asked = mapped_values(rows, terms, "original")
    assert asked.where("term_id = 1").count() == 1
    monkeypatch.setattr(vocabulary, "small_side", lambda df, *_: df)
    assert {(r.item, r.term_id) for r in mapped_fields(empty, rows, terms).collect()} == small
