"""Small fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, hits string"
VOCABULARY = {
    "en": "the of and river stone walks under bright morning while people carry water across old bridge".split(),
    "de": "der die und fluss stein geht unter heller morgen während leute wasser über alte brücke tragen".split(),
}


def prose(rnd: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(rnd.choice(VOCABULARY[lang]) + str(rnd.randrange(40) or "") for _ in range(n))


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    passage = prose(rnd, 70)
    texts = [prose(rnd, rnd.choice((3, 20, 60, 150, 400)), rnd.choice(("en", "de"))) for _ in range(n)]
    for i in range(0, n, 5):  # near copies in chains
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        if len(w) > 30:
            w[len(w) // 3] = "again"
            texts.append(" ".join(w).upper())
    texts += [texts[3]] * 4 + [prose(rnd, 30) + "\n" + passage + "\t" + prose(rnd, 40) for _ in range(3)]
    texts += [prose(rnd, 9000), "", "   ", "one", "a b", "é" * 500, "x " * 300, "x" * 900, passage + " " + passage]
    out = [(10 + 3 * i, t, "en", ("s1", "s2", None)[i % 3], len(t), "clash", "clash", "clash") for i, t in enumerate(texts)]
    out.append((5000, None, None, None, None, None, None, None))
    out.append((5001, None, None, None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
