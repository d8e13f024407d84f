"""Which fixed-length windows of a corpus occur elsewhere: the machinery of both substring operators.

A difference cover D modulo v holds, for every difference, two members that far apart. So any two equal
windows of W units have, at one and the same offset below v, a start position whose place modulo v lies in D
in both documents, and the L = W - v + 1 units from there on are equal too. The first pass hashes L units at
the cover's places alone and finds the repeated ones; the second pass hashes all W units, at all places that
a repeated anchor leaves possible, and decides. Unrepeated text drops out after the first pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOB, SLOTS, WHOLE, among, apart_from, as_slots, bucket_count, by_document, chunks, dealt, exchange, grown, id_table, marked, materialize, not_least, owners, positions, repeated, sparing, without


def difference_cover(p: int) -> tuple[int, np.ndarray]:
    """(v, D) with v = p*p + p + 1 and p + 1 members, p prime: Singer's construction.

    Powers of x in the field of p**3 elements that have no x*x part, for a generating polynomial
    x**3 = a x**2 + b x + c; whether one generates is seen from the result.
    """
    v = p * p + p + 1
    for a, b, c in product(range(p), range(p), range(1, p)):
        power, members = (0, 0, 1), []
        for i in range(v):
            if not power[0]:
                members.append(i)
            high = power[0]
            power = ((power[1] + a * high) % p, (power[2] + b * high) % p, c * high % p)
        if len({(x - y) % v for x in members for y in members}) == v and len(members) == p + 1:
            return v, np.array(members)
    raise ValueError(f"no cover for {p}")


@dataclass(frozen=True)
class Finder:
    """width: units of a window. p: of the cover. units(data, offsets) gives a namer and document offsets in units,
    where namer(starts, length, wide) is stretches() on them. least: whether only smaller ids count."""

    width: int
    p: int
    units: Callable
    least: bool = False

    def __post_init__(self):
        v, members = difference_cover(self.p)
        object.__setattr__(self, "v", v)
        object.__setattr__(self, "residue", np.isin(np.arange(v), members))
        if self.width - v + 1 < 1:
            raise ValueError("the cover's period exceeds the window")

    @property
    def anchor(self) -> int:
        return self.width - self.v + 1


#: Null ids stand behind all others, in an order of their own that follows from the text.
NULLS = 1 << 62


def key_of(docs: DataFrame) -> Column:
    """doc_id, or from NULLS on."""
    return F.coalesce(F.col("doc_id").cast("long"), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(NULLS)) + NULLS)


def keyed(docs: DataFrame) -> DataFrame:
    """(k, h, doc_id, text): k is doc_id, or from NULLS on; h tells rows with one id and different texts apart.

    h is 0 for ids that occur once, apart from few, as random bits would be most of what travels with a record.
    """
    k = key_of(docs)
    often = materialize(docs.groupBy(k.alias("k")).count().filter("count > 1").select("k"))
    rows = docs.select(k.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return marked(rows, often, "k").select("k", F.when(F.col("_in"), F.xxhash64("text")).otherwise(0).cast("long").alias("h"), "doc_id", "text")


def _collected(hits: DataFrame) -> DataFrame:
    # bounded by the length of a document
    return hits.groupBy("k", "h").agg(F.collect_list("hits").alias("hits"))


def _anchors(rows: DataFrame, f: Finder, buckets: int) -> DataFrame:
    def parts(batches):
        for batch in batches:
            for some, data, offs in chunks(batch):
                name, offs = f.units(data, offs)
                own = owners(offs)
                place = np.arange(offs[-1]) - offs[own]
                at = np.flatnonzero(f.residue[place % f.v] & (place + f.anchor <= np.diff(offs)[own]))
                yield name(at, f.anchor)[0], own[at], place[at], id_table(some), None  # the second pass decides

    return rows.select("k", "h", "text").mapInArrow(sparing(lambda batches: dealt(parts(batches), buckets)), BLOB)


def _candidates(rows: DataFrame, f: Finder, buckets: int) -> DataFrame:
    def parts(batches):
        for batch in batches:
            for some, data, offs in chunks(batch):
                name, offs = f.units(data, offs)
                step = np.zeros(offs[-1] + 1, dtype=np.int32)
                for i, hits in enumerate(some.column(3)):
                    p = positions(hits.as_py()) + offs[i]
                    np.add.at(step, np.maximum(p - f.v + 1, offs[i]), 1)
                    np.subtract.at(step, p + 1, 1)
                own = owners(offs)
                at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                at = at[at + f.width <= offs[1:][own[at]]]
                key, check = name(at, f.width, True)
                yield key, own[at], at - offs[own[at]], id_table(some), check

    return rows.select("k", "h", "text", "hits").mapInArrow(sparing(lambda batches: dealt(parts(batches), buckets, least=f.least)), BLOB)


def repeated_windows(rows: DataFrame, f: Finder, units_total: int) -> DataFrame:
    """(k, h, hits): places of the windows that start elsewhere too, or in a smaller id, in rows of keyed().

    Copies of whole texts are told by 128 bits of hashes and their lengths. One of each goes through the passes; of
    the others all windows are hits, and with `least` not set those of the first too.
    """
    spark = rows.sparkSession
    alike = ["x", "y", "size"]
    prints = materialize(rows.select("k", "h", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), F.octet_length("text").alias("size")))
    classes = prints.groupBy(*alike).agg(F.min(F.struct("k", "h")).alias("rep"), F.count("*").alias("copies")).filter("copies > 1 and size > 0")
    copies = materialize(prints.join(grown(classes), alike).select("k", "h", (F.struct("k", "h") != F.col("rep")).alias("gone")))
    own = without(rows, copies.filter("gone").select("k", "h"))
    whole = (copies.filter("gone") if f.least else copies).select("k", "h", F.lit(WHOLE).alias("hits"))
    sampled = units_total * (f.p + 1) // f.v
    n = bucket_count(spark, sampled)
    found = exchange(_anchors(own, f, n), lambda r: as_slots(r, repeated(r), n), SLOTS)
    found = materialize(by_document(found), release=True)
    some = among(own, found, "k").join(grown(_collected(found)), ["k", "h"])
    decide = not_least if f.least else repeated
    # what stays is less than all units; buckets for a quarter of them are small enough if all stayed
    m = bucket_count(spark, units_total // 4)
    windows = materialize(by_document(exchange(_candidates(some, f, m), lambda r: as_slots(r, decide(r), m), SLOTS)), release=True)
    return windows.union(whole)


def with_windows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `hits`, a list or null; texts without hits stay where they are, apart from few."""
    hit = among(rows, found, "k").join(grown(_collected(found)), ["k", "h"], "left")
    return hit.unionByName(apart_from(rows, found, "k").withColumn("hits", F.lit(None).cast("array<binary>")))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units a window of that width at one of the starts covers; -1 alone stands for all starts."""
    if len(starts) == 1 and starts[0] < 0:
        return np.full(n, n >= width)
    step = np.zeros(n + 1, dtype=np.int32)
    starts = np.unique(starts)
    step[starts] += 1
    np.subtract.at(step, starts + width, 1)
    return np.cumsum(step[:-1]) > 0


def digest(rows: DataFrame, one: Callable, schema: str) -> DataFrame:
    """one(text as bytes, window starts) -> the values of a row after doc_id."""

    def run(batches):
        for batch in batches:
            values = [one(t.as_py().encode(), positions(h.as_py())) for t, h in zip(batch.column(1), batch.column(2), strict=True)]
            cols = list(zip(*values, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    names = [x.split()[0] for x in schema.split(",")]
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(",")]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "hits").mapInArrow(sparing(run), f"doc_id long, {schema}")
