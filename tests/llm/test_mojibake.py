import pytest

from tertulia.llm import mojibake

DOCS = "doc_id bigint, text string, lang string"
CLEAN = ["¿Qué cambió después de la mudanza?", "El trámite resultó práctico y la mañana fue útil.", "También está la compañía, así que había confianza.", "Según entiendo, la reunión será rápida.", "A capacitación no llegó nadie más."]
NOT_WRONG = ["AMANHÃ NÃO HÁ SESSÃO.", "Õ, Ã, Ç: as letras do cartaz.", "┌────┬────┐\n│ Sí │ No │\n└────┴────┘", "Grupo β: 12 personas; grupo µ: 7.", "«Спасибо» dijo la visita.", "第3組 y 👍🏽 → ½ taza ± 2"]


@pytest.fixture(scope="module")
def docs(spark):
    good = [(k, " ".join((CLEAN * 3)[k % 5 : k % 5 + 4]), "es") for k in range(300)]
    wrong = [
        (1000, CLEAN[0].encode().decode("latin-1"), "es"), (1001, "Hola. " + CLEAN[1].encode().decode("mac_roman") + " " + CLEAN[2], None),
        (1002, CLEAN[3].encode().decode("cp1252").encode().decode("cp1252"), "ES"), (1003, (CLEAN[1] + " " + CLEAN[2]).encode("cp1252").decode("cp437"), "pt"),
    ]
    rest = [(2000 + k, t, "es") for k, t in enumerate(NOT_WRONG)] + [(3000, None, "es"), (3001, "", None), (3002, " ", "x"), (3003, "la maña�a " * 20_000, "es"), (3000, None, "es"), (None, "cafÃ©", "es")]
    return spark.createDataFrame(good + wrong + rest, DOCS)


def test_found_and_restored(docs):
    got = {r.doc_id: r for r in mojibake.restored(docs.repartition(3)).collect()}
    assert set(got) == {1000, 1001, 1002, 1003, 3003, None}
    assert got[1000].text == CLEAN[0] and got[1001].text == "Hola. " + CLEAN[1] + " " + CLEAN[2]
    assert got[1002].text == CLEAN[3] and got[1003].text == CLEAN[1] + " " + CLEAN[2]
    assert got[3003].lost and not got[1000].lost and got[None].text == "café"


def test_empty_table_and_extra_columns(spark, docs):
    assert mojibake.restored(docs.limit(0)).count() == 0
    more = docs.withColumn("chains", docs.lang).withColumn("lost", docs.doc_id)
    assert mojibake.restored(more).count() == 6


def test_every_upper_byte_survives_a_round_trip():
    for e in mojibake.READ_UTF8_AS:
        if e.endswith("lower"):
            continue
        text = "año, está; – “sí” 👍"
        read = "".join(c if c < "\x80" else "".join(mojibake._byte(e, b) for b in c.encode()) for c in text)
        assert mojibake.undo_utf8(read, e) == text
