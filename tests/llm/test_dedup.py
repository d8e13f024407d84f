"""The operators on pairs and repeated strings, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from tickloom.llm import anchors, common, ngram_jaccard, suffixes

from .corpora import frame, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_by_hand(data):
    sets = {r[0]: shingle_set(r[1]) for r in data}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {(i, len(s), top(i)) for i, s in sets.items()}


def found(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def test_ngram_jaccard_equals_all_pairs(spark):
    data = rows()
    assert found(ngram_jaccard.linked(frame(spark, data))) == jaccard_by_hand(data)


def test_ngram_jaccard_large_group_and_borderline(spark):
    rnd = random.Random(3)
    base = prose(rnd, 64).split()
    data = []
    for i in range(90):  # around the threshold: zero to eight words changed, in many places
        w = list(base)
        for _ in range(i % 9):
            w[rnd.randrange(64)] = f"n{rnd.randrange(10**6)}"
        data.append((i, " ".join(w), None, None, None, None, None, None))
    assert found(ngram_jaccard.linked(frame(spark, data))) == jaccard_by_hand(data)


def test_ngram_jaccard_counts_all_links(spark, monkeypatch):
    rnd = random.Random(5)
    base, data = prose(rnd, 64).split(), rows()
    for i in range(90):
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(64)] = f"n{rnd.randrange(10**6)}"
        data.append((6000 + i, " ".join(w), None, None, None, None, None, None))
    sets = [(r[0], shingle_set(r[1])) for r in data]
    hand = {i: sum(j != i and bool(x & y) and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets) for i, x in sets}
    for classes in (ngram_jaccard.LINK_CLASSES, 20):  # in one block, and in several
        monkeypatch.setattr(ngram_jaccard, "LINK_CLASSES", classes)
        assert {r.doc_id: r.n_links for r in ngram_jaccard.linked(frame(spark, data)).collect()} == hand


def test_one_of_each_keeps_smallest_ids(spark):
    data = rows()
    kept = {r.doc_id for r in ngram_jaccard.one_of_each(frame(spark, data)).collect()}
    assert kept == {i for i, _, c in jaccard_by_hand(data) if i == c}


def test_repeated_looks_past_done_records():
    r = {"key": np.array([7, 7, 7, 9, 7], dtype=np.uint64), "done": np.array([False, True, False, False, True]), "more": np.array([True, True, False, False, True]), "check": np.zeros(5, dtype=np.uint32)}
    assert common.repeated(r).tolist() == [True, True, True, False, True]


def repeats_by_hand(data, width=400):
    raw = {r[0]: (r[1] or "").encode() for r in data}
    seen: dict[bytes, int] = {}
    for t in raw.values():
        for p in range(len(t) - width + 1):
            k = t[p : p + width]
            seen[k] = seen.get(k, 0) + 1
    out = set()
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.add((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    data = [r for r in rows() if len(r[1] or "") < 5000]
    assert {tuple(r) for r in suffixes.removal_digest(frame(spark, data)).collect()} == repeats_by_hand(data)


def passages_by_hand(data, width=50):
    least: dict[tuple, int] = {}
    texts = {r[0]: words(r[1]) for r in data}
    for i, w in texts.items():
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            least[k] = min(i, least.get(k, i))
    out = set()
    for i, w in texts.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_anchor_dedup_equals_brute_force(spark):
    data = rows()
    assert {tuple(r) for r in anchors.removal_digest(frame(spark, data)).collect()} == passages_by_hand(data)


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_texts_that_collide_in_polynomial_hashes_differ(spark):
    data = []
    for n in (1024, 2048):  # as one word, and as words of which windows differ in their first one alone
        x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        data += ["".join(x), "".join(y), " ".join(x), " ".join(y)]
        data += [" ".join(["".join(w), *prose(random.Random(n), 49).split()]) for w in (x, y)]
    data = [(i, t, *[None] * 6) for i, t in enumerate(data)]
    assert found(ngram_jaccard.linked(frame(spark, data))) == jaccard_by_hand(data)
    assert {tuple(r) for r in anchors.removal_digest(frame(spark, data)).collect()} == passages_by_hand(data)
    assert {tuple(r) for r in suffixes.removal_digest(frame(spark, data)).collect()} == repeats_by_hand(data)


@pytest.mark.parametrize("op", [ngram_jaccard.linked, suffixes.removal_digest, anchors.removal_digest])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).collect() == []


@pytest.mark.parametrize("op", [ngram_jaccard.linked, suffixes.removal_digest, anchors.removal_digest])
def test_null_and_repeated_ids(spark, op):
    text = prose(random.Random(1), 120)
    data = [(i, t, *[None] * 6) for i, t in ((None, text), (None, text), (4, text), (4, text), (4, "other words"), (None, None))]
    got = op(frame(spark, data)).collect()
    assert len(got) == len(data) and sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in data)


MADE = [("bhegifrxeaquvkiqphfwhulqzmydbwyt", "taqhhtpojtavkhqpvcipmvripzmpdvqv"), ("vehkztpjpscgsdoznvwfefbkverkwinw", "mbjnwoezzymkvaclfbggmmnapxorgwhj")]


@pytest.mark.parametrize(("one", "other"), MADE)
def test_words_made_to_collide_in_a_sum_of_bytes_differ(spark, one, other):
    rest = " ".join(f"w{i}" for i in range(49))
    docs = frame(spark, [(1, f"{one} {rest}", *[None] * 6), (2, f"{other} {rest}", *[None] * 6)])
    assert {r.doc_id: r.n_removed for r in anchors.removal_digest(docs).collect()} == {1: 0, 2: 0}
    docs = frame(spark, [(1, one, *[None] * 6), (2, other, *[None] * 6)])
    assert {r.doc_id: (r.component_id, r.n_links) for r in ngram_jaccard.linked(docs).collect()} == {1: (1, 0), 2: (2, 0)}


def test_word_hashes():
    import random

    from tickloom.llm.common import new_key, words

    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("abAB\0é") for _ in range(rnd.choice((1, 2, 7, 8, 9, 16, 17, 40, 300)))) for _ in range(40)) for _ in range(20)]
    raw = [t.encode() for t in texts]
    for lower in (False, True):
        key = new_key()
        h, start, end, offs = words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), lower, key)
        flat = [w for t in raw for w in t.split(b" ")]
        assert [b"".join(raw)[a:b] for a, b in zip(start, end, strict=True)] == flat
        if lower:
            flat = [w.replace(b"A", b"a").replace(b"B", b"b") for w in flat]
        seen: dict = {}
        for w, v in zip(flat, h.tolist(), strict=True):
            assert seen.setdefault(w, v) == v
        assert len(set(seen.values())) == len(seen)
        assert list(offs) == list(np.cumsum([0, *(len(t.split(b" ")) for t in raw)]))
        again = words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), lower, new_key())[0]
        assert (again != h).all()
