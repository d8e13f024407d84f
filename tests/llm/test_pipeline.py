"""The stages of the corpus pipeline and run(), against plain Python on a small fixture."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from tickloom.llm import decontam

from .corpora import SCHEMA, frame, prose, rows
from .test_dedup import jaccard_by_hand, words

CLASHING = ("times", "place", "doc", "_in", "_times", "id", "n", "text_hash", "_k")


def clashing(df):
    for c in CLASHING:
        df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df


ITEM = "seven quick geese flew over the frozen lake before anyone in the village could count them all"


def corpus():
    rnd = random.Random(11)
    data = rows(n=30)
    data += [(6000 + i, f"{prose(rnd, 30)} {ITEM} {prose(rnd, 30)}", "en", "s1", None, None, None, None) for i in range(3)]
    data.append((None, f"{prose(rnd, 25)} {ITEM}", "en", "s1", None, None, None, None))
    return data


def folder(spark, tmp_path):
    frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_language_id_keeps_clean_documents_and_columns(spark, tmp_path):
    out = corpus_pipeline.language_id(spark, frame(spark, corpus()), folder(spark, tmp_path))
    kept = {r.doc_id for r in out.collect()}
    clean = {r[0] for r in corpus() if r[0] is not None and len(words(r[1])) >= 20}
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert clean <= kept and not kept & {r[0] for r in corpus() if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}


def test_near_duplicates_keep_one_of_each_group(spark, tmp_path):
    data = [r for r in corpus() if r[0] is not None]
    out = corpus_pipeline.near_duplicates(spark, clashing(frame(spark, data)), "")
    assert {r.doc_id for r in out.collect()} == {i for i, _, c in jaccard_by_hand(data) if i == c}
    assert out.columns[-len(CLASHING) :] == list(CLASHING)


def test_decontamination_takes_rows_without_an_id_too(spark, tmp_path):
    out = corpus_pipeline.decontamination(spark, clashing(frame(spark, corpus())), folder(spark, tmp_path)).collect()
    assert Counter(r.text for r in out) == Counter(r[1] for r in corpus() if ITEM not in (r[1] or ""))


def test_decontamination_tells_rows_of_one_id_apart(spark):
    data = [(7, prose(random.Random(1), 40), *[None] * 6), (7, f"so {ITEM} it is", *[None] * 6)]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r.text for r in decontam.clean(frame(spark, data), bench).collect()] == [data[0][1]]


def test_source_mix_repeats_whole_documents(spark):
    rnd = random.Random(2)
    data = [(i, prose(rnd, 40), "en", f"s{i % 3 if i < 280 else 0}", None, None, None, None) for i in range(300)]
    out = corpus_pipeline.source_mix(spark, clashing(frame(spark, data)), "").collect()
    times = Counter(r.doc_id for r in out)
    assert set(times.values()) <= {1, 2, 3} and {r.times for r in out} == {"times"}
    size, total = Counter(r[3] for r in data), len(data)
    share = {"s0": 5 / 8, "s1": 2 / 8, "s2": 1 / 8}
    got = Counter(data[r.doc_id][3] for r in out)
    for s, w in share.items():
        assert got[s] == pytest.approx(min(3 * size[s], w * total), rel=0.1)


def test_source_mix_of_nothing(spark):
    assert corpus_pipeline.source_mix(spark, frame(spark, []), "").collect() == []


def test_run_gives_the_tokens_of_what_the_stages_keep(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = folder(spark, tmp_path)
    docs = frame(spark, corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), SCHEMA)
    kept = sorted((r for r in docs.collect()), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in kept)
    out = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want
