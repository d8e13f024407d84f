"""The SQL of the queries on the awkward fixtures, beside the loops that the operators are held against."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tickloom.llm import anchors, collocations, conversations, ngram_jaccard, oracles, suffixes

from .corpora import frame, rows
from .test_conversations import data as turns


def same(got, want):
    c = sorted(got.columns)
    assert c == sorted(want.columns)
    a, b = (x[c].astype(object).where(x[c].notna(), None).sort_values(c, key=lambda s: s.map(str)).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def documents(data):
    return pd.DataFrame([r[:3] for r in data], columns=["doc_id", "text", "lang"]).astype({"text": object, "lang": object})


@pytest.mark.parametrize(
    ("sql", "run"),
    [
        (oracles.NEAR_COPIES, lambda d: ngram_jaccard.linked(d, counted=False)),
        (oracles.STRINGS, suffixes.removal_digest),
        (oracles.PASSAGES, anchors.removal_digest),
        (oracles.COLLOCATIONS, collocations.collocations),
    ],
)
def test_documents(spark, sql, run):
    data = rows()
    con = duckdb.connect()
    con.register("documents", documents(data))
    same(run(frame(spark, data)).toPandas(), con.execute(sql).df())


def test_conversations(spark):
    given = turns(80)
    con = duckdb.connect()
    con.register("given", pd.DataFrame(given, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("create view conversations as select * from given")
    got = conversations.repair(conversations.damaged(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")))
    want = con.execute(oracles.CONVERSATIONS).df()
    assert len(want) == got.count()
    keys = [k for k in got.columns if k != "conv_id"]
    rows_ = lambda df: sorted(tuple(str(r[k]) for k in keys) for r in df)
    assert rows_(r.asDict() for r in got.collect()) == rows_(want.to_dict("records"))
