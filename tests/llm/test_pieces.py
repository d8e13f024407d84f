"""Encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tickloom.llm import pieces

from .corpora import frame, rows

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def awkward(library) -> list[str]:
    rnd = random.Random(11)
    out = ["", " ", "  ", "a", " lead", "trail ", "a  b   c", "\t\n", "<s> </s> <unk> <0x41>", "▁x▁ ▁y", "日本語 テキスト", "a" * 3000, "ab" * 700 + "c", "\x00\x01", "🎉 \U0010ffff �"]
    for letters in ("aábcdeéx .,\n\t▁0123日🎉-_=", "abe", "a "):
        out += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(400)]
    return out + ["".join(library.id_to_piece(rnd.randrange(3, 32000)).replace("▁", " ") for _ in range(rnd.randrange(30))) for _ in range(1500)]


def test_ids_equal_the_library(path, library):
    texts = awkward(library)
    ids, offsets = pieces.load(path).encode(texts)
    want = library.encode(texts, num_threads=1)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want[i], text


def test_any_ids_decode_as_in_the_library(path, library):
    rnd = random.Random(12)
    lists = [[rnd.choice((rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3))) for _ in range(rnd.randrange(12))] for _ in range(4000)]
    got = pieces.load(path).decode(np.array(sum(lists, []), dtype=np.int32), np.cumsum([0, *map(len, lists)]))
    assert got == [library.decode(x) for x in lists]
    with pytest.raises(ValueError):
        pieces.load(path).decode(np.array([32000]), np.array([0, 1]))


def test_merges_that_bring_up_a_better_pair_are_made_one_at_a_time():
    """Against a plain loop, with ranks that are not in order of length."""
    rnd = random.Random(3)
    for _ in range(150):
        ranks = {c: 0 for c in "ab"}
        while len(ranks) < 9:
            x, y = rnd.choice(list(ranks)), rnd.choice(list(ranks))
            ranks.setdefault(x + y, rnd.randrange(4))
        names = list(ranks)
        m = object.__new__(pieces.Model)
        m.size = len(names)
        m.char = np.full(128, -1, dtype=np.int32)
        m.char[97], m.char[98] = names.index("a"), names.index("b")
        m.rank = np.array([*ranks.values(), pieces._NONE], dtype=np.int32)
        pairs = [(names.index(p[:k]), names.index(p[k:]), i) for i, p in enumerate(names) for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
        left, right, made = (np.array(x) for x in zip(*pairs, strict=True))
        m.pairs = pieces.Table(left, right, made)
        m.near = pieces.Table(np.array([97, 97, 98, 98]), np.array([97, 98, 97, 98]), np.zeros(4))
        m.single = np.bincount(m.rank[:-1], minlength=9)[m.rank[:-1]] > 1
        for side in (left, right):
            m.single[side[m.rank[made] <= m.rank[side]]] = True
        words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 25))) for _ in range(20)]
        starts = np.cumsum([0, *map(len, words)])
        sym, at = m.merged(np.frombuffer("".join(words).encode(), dtype=np.uint8).astype(np.int64), starts[:-1])
        for w, a, b in zip(words, starts[:-1], starts[1:], strict=True):
            parts = list(w)
            while True:
                found = [(ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
                if not found:
                    break
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert [names[s] for s in sym[(at >= a) & (at < b)]] == parts, (ranks, w)


def test_query_columns(spark, path, library):
    data = rows() + [(9000 + i, t, *[None] * 6) for i, t in enumerate(awkward(library)[:40])] + [(None, "no id", *[None] * 6)]
    docs = frame(spark, data)
    encoded = pieces.encode(docs, path)
    back = {r.doc_id: r.text for r in pieces.decode(encoded, path).collect()}
    got = {r.doc_id: r for r in pieces.digests(encoded, path).collect()}
    assert len(got) == len({d[0] for d in data})
    for d in data:
        ids = library.encode(d[1] or "")
        assert got[d[0]].n_tokens == len(ids)
        assert got[d[0]].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert back[d[0]] == library.decode(ids)
        assert got[d[0]].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digests(pieces.encode(frame(spark, []), path), path).collect() == []
    assert [r.text for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).collect()] == [""]
