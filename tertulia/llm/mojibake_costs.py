"""python -m tertulia.llm.mojibake_costs DATA_DIR: fits the costs of mojibake on held-out sentences.

Dictionaries are fitted on FIT documents (least hash); from HELD others come clean sentences
with characters beyond ASCII. Each is judged as it is, with signs and foreign names that people
write set in, and after a wrong reading of one letter or of all. A cost is better the fewer
sentences are judged wrongly. Bounds: FIT, HELD, SENTENCES.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import sys
from collections import Counter

import pandas as pd

from tertulia.llm import mojibake

FIT, HELD, SENTENCES = 4_000, 4_000, 1_500
# What clean text may have besides its letters.
SIGNS = "± ² ³ ½ ¼ ¾ © ® § ¶ µ × ÷ £ ¥ ¢ ° · † ‡ ™ → ← ≤ ≥ ≠ ∞ α β γ π Ω │ ─ ■ ✓ ☺ 5±2 10² ½ 3¾ 2×3 ±4 (©) §7".split()
NAMES = "Søren Müller Åsa Čapek Łukasz Gößler Dvořák Škoda Çelik Ærø Þór Nagyné-Kőszegi Đoković Жанна Αθήνα".split()


def samples(texts: list[str], r: random.Random) -> list[tuple[str, bool]]:
    """(sentence, whether it was read wrongly)."""
    found = []
    for t in texts:
        words = t.split(" ")
        at = r.randrange(1, len(words) + 1)
        found += [(t, False), (" ".join([*words[:at], r.choice(SIGNS + NAMES), *words[at:]]), False)]
        if r.random() < 0.5:
            encoding = r.choice([x for x in mojibake.READ_UTF8_AS if not x.endswith("lower")])
            wrong = {c: "".join(mojibake._byte(encoding, b) for b in c.encode()) for c in set(t) if c > "\x7f"}
        else:
            read_as, true = r.choice(mojibake.SINGLE_BYTE[:5])
            back = {mojibake._byte(true, b): mojibake._byte(read_as, b) for b in range(128, 256)}
            wrong = {c: back[c] for c in set(t) if c in back}
        places = [k for k, c in enumerate(t) if c in wrong and wrong[c] != c]
        some = set(places if r.random() < 0.5 else places and [r.choice(places)])
        if some:
            found.append(("".join(wrong[c] if k in some else c for k, c in enumerate(t)), True))
    return found


def errors(restorer: mojibake.Restorer, given: list[tuple[str, bool]]) -> tuple[int, int]:
    """(clean sentences that are changed, wrong ones that are not)."""
    judged = Counter((wrong, bool(restorer.restore(t)[1])) for t, wrong in given)
    return judged[False, True], judged[True, False]


def main(folder: str) -> None:
    d = pd.read_parquet(f"{folder}/documents.parquet", columns=["text", "lang"])
    d = d[d.text.notna()]
    d = d[(d.text.str.len() <= mojibake.FIT_CHARACTERS) & ~d.text.str.contains("\ufffd")].drop_duplicates("text")
    d = d.iloc[d.text.map(lambda t: hashlib.md5(t.encode()).digest()).argsort()]
    fitted, held = d[:FIT], d[FIT : FIT + HELD]
    letters = Counter(c for t in fitted.text for c in {x for p in mojibake.PARTS.findall(t) if mojibake._clean(p) for x in p if x > "\x7f"})
    usual = {c for c, n in letters.items() if n >= max(2, len(fitted) * mojibake.USUAL_SHARE // 10_000)} | mojibake.MARKS
    restorer = mojibake.Restorer(mojibake.dictionaries([(str(x).strip().lower() if x else None, t) for x, t in zip(fitted.lang, fitted.text)]), "".join(usual | {c.upper() for c in usual if len(c.upper()) == 1}))
    parts = sorted({p.strip() for t in held.text for p in mojibake.PARTS.findall(t) if not p.isascii() and mojibake._clean(p) and not restorer.odd.search(p)}, key=lambda p: hashlib.md5(p.encode()).digest())
    given = samples(parts[:SENTENCES], random.Random(1))
    print(len(given), "sentences,", sum(w for _, w in given), "read wrongly; costs: clean ones changed, wrong ones missed")
    for step, part, odd, strange in itertools.product([1, 2], [1, 2, 3], [1, 2, 3], [8]):
        mojibake.STEP_COST, mojibake.PART_COST, mojibake.ODD_COST, mojibake.STRANGE_COST = {True: 1, False: step}, {True: 0, False: part}, odd, strange
        print(f"step {step}, part {part}, odd {odd}, strange {strange}:", *errors(restorer, given), flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
