"""Collocations against plain counting with Python's whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import collocations
from tickloom.llm.collocations import Links, runs

from .corpora import frame, prose, rows


def by_hand(data: list[tuple], least: int, most: int) -> list[tuple]:
    f: dict = {}
    n: Counter = Counter()
    for text, lang in data:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (q := p[i : i + k]) and 100 * a >= 100 * c[q]}
        best = []
        for p, a in found.items():
            if p not in inside:
                cuts = [(1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


def corpus() -> list[tuple]:
    rnd = random.Random(21)
    out = [(d[1], d[2]) for d in rows()]
    line = "All rights reserved, the FIRST party; may not copy this text without a licence\n"
    out += [(prose(rnd, 30) + " " + line * rnd.randrange(4) + prose(rnd, 10), rnd.choice(("en", "de", None))) for _ in range(80)]
    words = ["a", "b", "c", "aé", "ÀB", "q\x1c", " "]
    out += [("".join(rnd.choice(words) + rnd.choice((" ", " ", "\t", "  ", ".", "\v", "\n")) for _ in range(rnd.randrange(60))), rnd.choice(("en", "x"))) for _ in range(150)]
    return out + [("", "en"), (" . , ", "zz"), (None, None), ("lone", "lone")]


@pytest.mark.parametrize(("least", "most", "shard"), [(3, 10_000, 1_000_000), (3, 25, 300), (12, 40, 1)])
def test_equal_plain_counting(spark, monkeypatch, least, most, shard):
    data = corpus()
    monkeypatch.setattr(collocations, "SHARD", shard)
    docs = frame(spark, [(i, t, lang, *[None] * 5) for i, (t, lang) in enumerate(data)])
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, most).collect())
    assert got == by_hand(data, least, most)
    assert len(got) > 20


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    data = corpus()
    monkeypatch.setattr(collocations, "WORD_BITS", 1 << 15)
    monkeypatch.setattr(collocations, "PAIR_BITS", 1 << 15)
    docs = frame(spark, [(i, t, lang, *[None] * 5) for i, (t, lang) in enumerate(data)])
    assert sorted(tuple(r) for r in collocations.collocations(docs, 2, 500).collect()) == by_hand(data, 2, 500)


def test_no_documents(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, *[None] * 5)])).collect() == []


def test_products_past_64_bits(spark):
    big = 9 * 10**12
    phrases = spark.createDataFrame([("en", "a b c", 3, big)], "lang string, phrase string, size int, a long")
    counts = spark.createDataFrame([("en", p, f) for p, f in (("a", big + 7), ("b c", big + 1), ("a b", big + 3), ("c", 10**13))], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    r = collocations.scored(phrases, counts, totals).collect()[0]
    cuts = [(1000 * big * 10**15 // ((big + 7) * (big + 1)), big + 7, big + 1), (1000 * big * 10**15 // ((big + 3) * 10**13), big + 3, 10**13)]
    assert (r.score, r.l, r.r) == min(cuts)


def test_states_are_the_classes_of_end_places():
    rnd = random.Random(5)
    for _ in range(60):
        word = np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 50))])
        first = np.array([rnd.random() < 0.15 for _ in word])
        first[0] = True
        ok = np.array([rnd.random() < 0.9 for _ in word])
        run = runs(ok, first)
        ends: dict = {}
        for i in range(len(word)):
            for k in range(2, min(int(run[i]), 5) + 1):
                ends.setdefault(tuple(word[i - k + 1 : i + 1].tolist()), set()).add(i)
        classes: dict = {}
        for p, e in ends.items():
            classes.setdefault(frozenset(e), []).append(p)
        want = sorted((max(p, key=len), min(map(len, p)), len(e)) for e, p in classes.items())
        got = sorted((tuple(word[p - k + 1 : p + 1].tolist()), low, c) for p, k, low, c in zip(*(x.tolist() for x in Links(word, run, 5).states()), strict=True))
        assert got == want
