"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the point frac((i + 1) / golden ratio). The source whose share of the cumulative
draws holds the point owns the slot; the slots of a source are ranked; and slot of rank r takes block
r modulo the source's number of blocks. Blocks are equal stretches of words of the source's documents, laid
in an order shuffled by hash; a small source has smaller ones, and its draws are as many as its target asks.
Golden-ratio points are spread so evenly that each source gets its share of any stretch of the schedule to
within a few slots. At the end each source's ranks are filled up or cut to its draws, and its last one to the
words that its target leaves, so that every source takes its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Fixed values of the contract: weights by rank of the source, repeating; how often a source may be used.
WEIGHTS, REPEATS = (5.0, 2.0, 1.0), 3
#: Blocks of an average source, as far as blocks of MOST_WORDS allow; cells of the point-to-source join.
BLOCKS, MOST_WORDS, CELLS = 4096, 1024, 1024
#: Blocks of a small source at least, as far as it has words.
LEAST_BLOCKS = 64
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(sid, source, source_size, target) from (source, size): weighted shares of all words, none above repeats x size.

    Sources by code point, null last, take the weights in turn. What a full source leaves is reshared by
    weight: in order of size / weight, source i is full if the level that the sources from it on would share
    exceeds it. One row a source meets in one task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("most", F.col("source_size") * repeats)
    full = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("is_full", F.col("most") <= F.col("level") * F.col("weight"))
    by = by.withColumn("level", F.first(F.when(~F.col("is_full"), F.col("level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return by.select("sid", "source", "source_size", F.when(F.col("is_full"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank): which source owns each of the slots, and its place among that source's slots.

    Points meet shares through an equi-join on cells of the unit interval, so neither side is broadcast;
    ranks come from counts a chunk of slots and places within the chunk, so no source's slots meet in one task.
    """
    spark = targets.sparkSession
    to = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    shares = targets.withColumn("hi", F.sum("target").over(to)).withColumn("lo", F.col("hi") - F.col("target")).withColumn("all", F.sum("target").over(every)).filter("target > 0")
    shares = shares.select("sid", (F.col("lo") / F.col("all")).alias("lo"), F.when(F.col("hi") >= F.col("all") * (1 - 1e-12), 2.0).otherwise(F.col("hi") / F.col("all")).alias("hi"))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(0.9999999)) * CELLS))))
    x = (F.col("slot") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * CELLS))
    owned = points.join(cells, "cell").filter("x >= lo and x < hi").select("slot", "sid", F.shiftright("slot", 14).alias("chunk"))
    own = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = owned.groupBy("sid", "chunk").count().withColumn("before", F.coalesce(F.sum("count").over(own), F.lit(0)))
    inside = owned.withColumn("place", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    return inside.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("place")).alias("rank"))


def draws(targets: DataFrame, most: int, repeats: int) -> DataFrame:
    """(sid, block, blocks, full, cut, target) of sources with words: words of a block, blocks, whole draws, words of one
    more, and all draws, as the schedule's target."""
    goal = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * repeats)
    by = targets.filter("source_size > 0").select("sid", "source_size", goal.alias("goal"))
    by = by.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    by = by.withColumn("blocks", F.expr("(source_size + block - 1) div block")).withColumn("rest", F.col("goal") % F.col("source_size"))
    by = by.withColumn("full", F.expr("goal div source_size * blocks + rest div block")).withColumn("cut", F.col("rest") % F.col("block"))
    return by.select("sid", "block", "blocks", "full", "cut", (F.col("full") + (F.col("cut") > 0).cast("long")).alias("target"))


def lay_out(sizes: DataFrame, n_docs: int, seed: str) -> DataFrame:
    """Adds `at`, the words of the source before the document in shuffled order.

    Sums go by cells of the hash that orders documents, so a source of any size is laid out in many tasks.
    """
    cells = max(1, n_docs // 4096)
    h = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.withColumn("h", h).withColumn("cell", F.floor((F.shiftrightunsigned("h", 33) / float(1 << 31)) * cells))
    rows = rows.withColumn("h", F.shiftrightunsigned("h", 1))  # the cell's order and the hash's agree
    by = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("sid", "cell").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(by), F.lit(0))).select("sid", "cell", "before")
    own = Window.partitionBy("sid", "cell").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("place", F.row_number().over(own)).withColumn("inside", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before, ["sid", "cell"]).withColumn("at", F.col("before") + F.col("inside"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Null sources are a source of their own, sorted last; null texts have size 0. Rows without words are never
    taken. Repeated rows are documents of their own, which share a place in the shuffle. A source takes its target,
    to the nearest word. No block is used more than `repeats` times, so no document is taken more often. An empty table gives an empty result.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra))
    targets = materialize(source_targets(sizes, weights, repeats))
    total, n, n_sources = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.countDistinct("source")).first()
    block = max(1, min(MOST_WORDS, total // (BLOCKS * max(1, n_sources))))
    plan = materialize(draws(targets, block, repeats))
    known = sizes.join(targets.select("sid", F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = materialize(lay_out(known, n, seed))
    n_slots = plan.agg(F.coalesce(F.sum("target"), F.lit(0))).first()[0]
    ranks = materialize(schedule(plan, n_slots).select("sid", "rank"))
    got = ranks.groupBy("sid").agg(F.count("*").alias("got"))
    short = plan.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < target")
    ranks = ranks.unionByName(short.select("sid", F.explode(F.sequence("got", F.col("target") - 1)).alias("rank")))
    slots = ranks.join(plan, "sid").filter("rank < target")
    uses = slots.groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block")).agg(
        F.sum((F.col("rank") < F.col("full")).cast("long")).alias("uses"), F.max(F.when(F.col("rank") == F.col("full"), F.col("cut")).otherwise(0)).alias("cut")
    )
    end = F.col("at") + F.col("size")
    pieces = laid.filter("size > 0").join(plan.select("sid", F.col("block").alias("each")), "sid")
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.expr("at div each"), F.expr("(at + size - 1) div each"))))
    start = F.col("block") * F.col("each")
    upto = lambda limit: F.greatest(F.lit(0), F.least(end, limit) - F.greatest("at", start))
    words = upto(start + F.col("each")) * F.col("uses") + upto(start + F.col("cut"))
    row = ["sid", "cell", "place"]
    taken = pieces.join(uses, ["sid", "block"]).groupBy(row).agg(F.sum(words).alias("taken"))
    return laid.join(taken, row, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *extra)
