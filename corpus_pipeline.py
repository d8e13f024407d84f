"""The corpus pipeline: stages over documents, each written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontam, langid, mixing, ngram_jaccard, sst
from tickloom.llm.common import bounded_batches, discard, documents, fresh, grown, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null, letterless and undecided texts go."""
    bounded_batches(spark)
    return langid.kept_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; a repeat is a row more."""
    doc, times, place = fresh(docs, "doc"), fresh(docs, "times"), fresh(docs, "place")
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(doc)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    rounded = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    counts = materialize(taken.select(doc, rounded.alias(times)).filter(F.col(times) > 0), release=True)
    rows = docs.join(grown(counts), F.col("doc_id").eqNullSafe(F.col(doc)))
    return rows.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in id order, and what they hold of each document."""
    import public_tokenizers

    return sst.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token output", token_output),
]

#: Learned language models and shuffles by hash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), release=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
