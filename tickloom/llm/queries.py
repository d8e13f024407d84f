"""The queries over the text operators, and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, collocations, conversations, decontam, langid, mixing, ngram_jaccard, oracles, pieces, quality, secrets, sst, suffixes, token_counts
from .common import bounded_batches, documents


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id. Null, empty and wordless texts have no shingles, no links and their own id as
    component; null ids come out as null; repeated rows link with each other.
    """
    return ngram_jaccard.linked(documents(spark, sf_dir), counted=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. A null text counts as empty; ids may be null or repeated; other
    columns are not read.
    """
    return token_counts.token_counts(documents(spark, sf_dir), _path("piece_bpe_32k.model"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken. Null sources are one source, sorted last; texts without words have
    size 0 and are never taken; repeated rows count for themselves.
    """
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score. `und` and 0 for null texts and texts without a letter; ties go to the
    first language by name; with nothing to learn from, all is `und`.
    """
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. A null text counts as empty; the digest of no spans
    is that of the empty string; repeated rows are scanned each for itself.
    """
    return secrets.scan(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. A null text counts as empty; texts under 400 bytes keep
    all; repeated rows both lose what they share.
    """
    return suffixes.removal_digest(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_windows of contaminated documents. Null and empty texts match nothing on either side;
    repeated rows count once; documents without an id come out under a null id.
    """
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. A null text has no words; null ids stand behind all others; rows
    that share an id remove nothing from each other.
    """
    return anchors.removal_digest(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the four statistics, base_failed, kept. A null text has no words and fails the base rules;
    without labelled rows no rule is learned and the base rules decide.
    """
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files. A null text counts as empty; null ids come
    first; rows of one id stand in the order of their texts.
    """
    return sst.token_output(documents(spark, sf_dir), _path("byte_bpe_50k.json"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. A null text counts as empty: no ids, the digests are those of the
    empty string; ids may be null or repeated; other columns are not read.
    """
    return pieces.digests(pieces.encode(documents(spark, sf_dir), _path("piece_bpe_32k.model")), _path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 after the damage. A null role or
    text reads as one space; rows of one turn stand in order of role and text; a null conv_id is one conversation.
    """
    bounded_batches(spark)
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: 2000 phrases of a language at most. A null text has no words, a null lang
    is `und`; repeated rows count each for itself; ids are not read.
    """
    return collocations.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_token_counts, op3_source_mix, op4_language_id, op5_secret_scan,
        op6_suffix_dedup, op7_decontamination, op8_anchor_dedup, op9_quality_rules, op10_token_shards,
        op11_sentencepiece, op12_conversation_repair, op13_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NEAR_COPIES,
    "op6_suffix_dedup": oracles.STRINGS,
    "op8_anchor_dedup": oracles.PASSAGES,
    "op12_conversation_repair": oracles.CONVERSATIONS,
    "op13_collocations": oracles.COLLOCATIONS,
}
