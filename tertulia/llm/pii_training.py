"""python -m tertulia.llm.pii_training DATA_DIR [SECONDS [more]]: fits the weights of pii_model on labelled spans and writes pii_weights.npz; with "more" it goes on from those that are there.

Bounds: MAX_TEXTS distinct turn texts (those with the least hash) of at most MAX_LENGTH
characters, labelled by the rules of pii_labels; to half of each batch invented spans are added.
"""

from __future__ import annotations

import hashlib
import sys
import time

import numpy as np
import pandas as pd

from tertulia.llm.pii_labels import Inventor, Labeller, streets
from tertulia.llm.pii_model import LABELS, WEIGHTS, Adam, Tagger, codes, fresh, gradients, load, save

MAX_TEXTS, MAX_LENGTH = 60_000, 400
HIDDEN, BATCH, SIZE = 24, 96, 160
KIND_CODE = {k: n for n, k in enumerate(LABELS)}


def batches(texts: list[str], labeller: Labeller, inventor: Inventor, seed: int):
    """(codes, labels, lengths) without end; turns with spans are drawn as often as turns without."""
    labelled = [(t, labeller.spans(t)) for t in texts]
    with_spans, without = [x for x in labelled if x[1]], [x for x in labelled if not x[1]]
    r = np.random.default_rng(seed)
    draw = lambda pool: pool[r.integers(len(pool))]
    while True:
        x, y, lengths = np.zeros((BATCH, SIZE), np.uint8), np.zeros((BATCH, SIZE), np.int64), np.zeros(BATCH, np.int64)
        for row in range(BATCH):
            text, spans = draw(with_spans if r.random() < 0.35 else without)
            if r.random() < 0.5:
                if len(text) > 110:
                    text, spans = draw(without)
                text, spans = inventor.mixed(text, spans)
            labels = np.zeros(len(text), np.int64)
            for a, b, k in spans:
                labels[a:b] = KIND_CODE[k]
            a = int(r.integers(0, len(text) - SIZE + 1)) if len(text) > SIZE else 0
            cut = codes(text[a : a + SIZE])
            lengths[row] = max(1, len(cut))
            x[row, : len(cut)], y[row, : len(cut)] = cut, labels[a : a + SIZE]
        yield x, y, lengths


def fit(texts: list[str], places: list[str], seconds: float, hidden: int = HIDDEN, seed: int = 1, start: dict[str, np.ndarray] | None = None, log=print) -> dict[str, np.ndarray]:
    """Weights fitted for so many seconds with a falling rate, a third of it if they go on from start."""
    texts = sorted((t for t in set(texts) if t.strip() and len(t) <= MAX_LENGTH), key=lambda t: hashlib.md5(t.encode()).digest())[:MAX_TEXTS]
    labeller = Labeller(texts, places)
    held, feed = texts[::20], batches([t for k, t in enumerate(texts) if k % 20], labeller, Inventor(seed, streets(texts)), seed)
    p, began, step = start or fresh(hidden, seed), time.time(), 0
    rate = 2e-3 if start else 6e-3
    adam = Adam(p)
    while (done := (time.time() - began) / seconds) < 1:
        loss, g = gradients(p, *next(feed))
        adam.step(p, g, rate * min(1, (step + 1) / 50) * (1 - done) ** 0.8 + 1e-5)
        step += 1
        if step % 100 == 0:
            log(f"{time.time() - began:.0f} s, step {step}, loss {loss:.3f}", flush=True)
        if step % 500 == 0:
            log(evaluate(p, held, labeller), flush=True)
            save(p)
    log(evaluate(p, held, labeller), flush=True)
    return p


def evaluate(p: dict[str, np.ndarray], texts: list[str], labeller: Labeller) -> str:
    """Precision and recall by turn and kind on held-out turns, against the rules."""
    got = Tagger(p).spans(texts)
    counts = {k: [0, 0, 0] for k in LABELS[1:]}
    for t, spans in zip(texts, got):
        a, b = {k for *_, k in spans}, {k for *_, k in labeller.spans(t)}
        for k in counts:
            counts[k][0] += k in a and k in b
            counts[k][1] += k in a
            counts[k][2] += k in b
    return ", ".join(f"{k}: precision {n / max(1, a):.3f} recall {n / max(1, b):.3f} of {b}" for k, (n, a, b) in counts.items())


def main(folder: str, seconds: str = "900", more: str = "") -> None:
    turns = pd.read_parquet(f"{folder}/turns.parquet", columns=["text"]).text.dropna().tolist()
    terms = pd.read_parquet(f"{folder}/glossary_terms.parquet").term.dropna()
    start = load(WEIGHTS.read_bytes()) if more else None
    save(fit(turns, [t for t in terms if " " in t], float(seconds), seed=2 if more else 1, start=start))


if __name__ == "__main__":
    main(*sys.argv[1:])
