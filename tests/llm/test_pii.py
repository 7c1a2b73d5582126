import itertools
import random

import numpy as np
import pytest

from tertulia.llm import pii
from tertulia.llm.pii_labels import FRAMES, Inventor, Labeller
from tertulia.llm.pii_model import LABELS, WEIGHTS, Tagger, fresh, gradients, load

TURNS = "interview_id int, pos int, text string"
CASES = {
    "Mire, el correo es luna.sur74@correo-norte.example.": {"email"},
    "Anote: turno guion bajo azul3 arroba mailsur punto test.": {"email"},
    "Me dejó el celular, 9-0263-6224, y no contestó.": {"phone"},
    "mi teléfono es nueve cero nueve cuatro uno siete tres cinco dos": {"phone"},
    "El carnet, 44 116 660 guion 5. Mhm.": {"id_number"},
    "Vivo en Av. Piedra Escrita N° 608.": {"address"},
    "la carta llegó a calle las norias de piedra número cuatrocientos doce": {"address"},
    "Preguntó por Paz y nadie sabía.": {"name"},
    "J. Barzabideño evita un examen de sangre, mi rut es 42.838.601-9.": {"name", "id_number"},
    "La calle principal se inunda siempre, porque así se hacía antes.": set(),
    "Ahí anotaron el número de serie 926352419, nada más.": set(),
    "También está la Villa Santa Inés, que funciona en la sede.": set(),
    "Eso quedó en el código de muestra 2016-0675-33, por puro cariño.": set(),
}


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(WEIGHTS.read_bytes())


def test_gradients_against_differences():
    p, r = fresh(4, 0), np.random.default_rng(0)
    x, y, lengths = r.integers(2, 30, (3, 6)).astype(np.uint8), r.integers(0, 6, (3, 6)), np.array([6, 3, 5])
    _, g = gradients(p, x, y, lengths)
    for k in p:
        i = (x[0, 0], 1) if k.startswith("wx") else tuple(r.integers(0, n) for n in p[k].shape)
        near = []
        for sign in (1, -1):
            q = {a: b.copy() for a, b in p.items()}
            q[k][i] += sign * 1e-2
            near.append(gradients(q, x, y, lengths)[0])
        assert abs((near[0] - near[1]) / 2e-2 - g[k][i]) < 2e-3


def test_decoding_against_all_paths():
    r = np.random.default_rng(1)
    p = fresh(3, 1)
    p["trans"] = r.normal(0, 1, p["trans"].shape).astype(np.float32)
    t = Tagger(p)
    each = [r.normal(0, 1.5, (n, len(LABELS))).astype(np.float32) for n in (1, 2, 4, 5, 3, 0)]
    for e, got in zip(each, t.decode(each)):
        score = lambda path: t.start[path[0]] + sum(e[k][x] for k, x in enumerate(path)) + sum(t.trans[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(len(LABELS)), repeat=len(e)), key=score) if len(e) else ()
        assert (got is None and not any(best)) or list(got) == list(best)


def test_windows_of_a_long_text_agree_with_one_window(finder):
    text = "el niño dormía y la matrona recibe la ficha " * 10 + "me llamo Íñigo Barzabideño y mi correo es luna_sur64@casa.invalid " + "en la sede pasa lo mismo y nadie contesta " * 30
    short, long = Tagger(load(WEIGHTS.read_bytes())), Tagger(load(WEIGHTS.read_bytes()))
    long.WINDOW, long.OVERLAP = len(text) + 10, 5
    assert short.spans([text]) == long.spans([text])


def test_kinds(finder):
    got = finder.spans(list(CASES))
    assert {t: {k for *_, k in s} for t, s in zip(CASES, got)} == CASES


def test_invented_data_of_another_seed(finder):
    inventor, texts, truth = Inventor(99, ["los telares menores", "piedra escrita"]), [], []
    for _ in range(600):
        text, spans = inventor.mixed("Nosotros llegamos en la feria cuando empezó el programa.", [])
        texts.append(text)
        truth.append({k for *_, k in spans})
    got = [{k for *_, k in s} for s in finder.spans(texts)]
    hit, made, there = (sum(map(len, x)) for x in ([a & b for a, b in zip(got, truth)], got, truth))
    assert hit / made > 0.93 and hit / there > 0.93


# Names and forms that neither the rules nor the training have.
NAMES = "Amaranta Evaristo Prudencia Lisandro Ximena Facundo Renata Thiago Milagros Abelardo Quintina Rigoberto Zulema Macarena Leandro Edelmira Orlando Griselda Baltasar Perpetua".split()
SURNAMES = "Quispe Huenchumilla Sandoval Etcheverry Almonacid Bascuñán Goycoolea Paillalef Mondragón Villalobos".split()
PHONES, IDS = ["0800 ### ####", "## ## ## ## ##", "+## (##) ### ####", "#### ## ## ##"], ["##-########-#", "@-######", "## ### ###-*", "@#######@"]
STREETS = ["transversal ", "bulevar ", "calle larga ", "Av. "]
ROADS = ["Los Copihues", "Presidente Mondaca", "El Roble Viejo", "Santa Clemencia", "Tres Marías", "Manuel Bulnes Prieto"]


def held_out(n=800, seed=5):
    """(text, kinds) with names and forms that were never seen, and as many texts without any."""
    r = random.Random(seed)
    inventor = Inventor(seed, [])
    for _ in range(n):
        kind = r.choice(["name", "phone", "id_number", "address", "email", ""])
        if kind == "name":
            span = r.choice([f"{r.choice(NAMES)} {r.choice(SURNAMES)}", r.choice(NAMES), f"{r.choice('ABCDE')}. {r.choice(SURNAMES)}"])
        elif kind in ("phone", "id_number"):
            span = inventor.form(PHONES if kind == "phone" else IDS)
        elif kind == "address":
            span = r.choice(STREETS) + r.choice(ROADS) + r.choice([" {}", " N° {}", " #{}", ", casa {}"]).format(r.randint(3, 2999))
        elif kind == "email":
            span = f"{r.choice(NAMES).lower()}+{r.choice(['lista', 'casa'])}@{r.choice(['correo', 'webmail', 'udec'])}.{r.choice(['net', 'cl', 'gob.cl'])}"
        if kind:
            frame = r.choice(FRAMES[kind])
            yield frame.replace("{}", span), {kind}
        else:
            yield inventor.sentence("")[0], set()


HELD_OUT_PRECISION = HELD_OUT_RECALL = 0.95


def test_names_and_forms_that_no_rule_lists(finder):
    given = list(held_out())
    got = [{k for *_, k in s} for s in finder.spans([t for t, _ in given])]
    hit, made, there = (sum(map(len, x)) for x in ([a & b for a, (_, b) in zip(got, given)], got, [b for _, b in given]))
    assert hit / made > HELD_OUT_PRECISION and hit / there > HELD_OUT_RECALL, (hit / made, hit / there)


def test_rules_label_what_they_should():
    rules = Labeller(["calle Las Norias de Piedra #3, x"] * 2)
    assert rules.spans("Vivo en calle Las Norias de Piedra número cuatrocientos doce.") == [(8, 60, "address")]


def test_frames(spark):
    rows = [(1, 0, "Mi rut es 42.838.601-9, soy Maite Barzabideño."), (1, 0, " Mi rut es 42.838.601-9, soy Maite Barzabideño. "), (1, 1, None), (1, 2, ""), (1, 3, "  "), (None, 4, "Fono 555 14 95."), (2, 5, "Ya. " * 20_000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", kind string, n_spans int")
    assert sorted(map(tuple, pii.found_kinds(d, ["interview_id", "pos"]).collect()), key=repr) == sorted([(1, 0, "id_number"), (1, 0, "name"), (None, 4, "phone")], key=repr)
    clean = {(r.interview_id, r.pos): r for r in pii.redacted(d, ["interview_id", "pos"]).collect()}
    assert clean[1, 0].text.strip() == "Mi rut es [DOCUMENTO], soy [PERSONA]." and clean[1, 1].text is None and clean[1, 3].text == "  " and clean[2, 5].text == rows[-1][2]
    assert pii.found_kinds(d.limit(0), ["interview_id", "pos"]).count() == 0
