"""Phrases that stand together more often than their parts let expect, by language.

A shard is the words that a task reads at a time. Its generalised suffix automaton, down to a depth of five words, is
held as its tree of suffix links: a node at depth k is a phrase of k words with the number of its places, its link the
node without the first word; a state is a run of nodes along the links with equal numbers. A row a state (longest phrase,
shortest length, number of places) leaves a shard; Spark adds the numbers up, phrase by phrase, as strings.

Phrases that can't reach the least count are left out before: words, then pairs of words, are counted over the whole
corpus, and what reaches the count is marked in bitmaps of a fixed size. A bitmap also lets some others pass, never
fewer, and the counts of those that pass are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, grown, materialize, mix, sparing
from .pieces import spread

#: Words that a task holds at a time: a shard. A longer text is a shard of its own.
SHARD = 1_000_000
#: Longest phrase, in words.
DEPTH = 5
#: Sizes of the bitmaps of frequent words and of frequent pairs: 8 and 16 MB, whatever the input.
WORD_BITS, PAIR_BITS = 1 << 26, 1 << 27
#: States whose phrases are written out at once.
AT_ONCE = 1 << 16
#: Shares that the best of a language are found in before the best of all.
SHARES = 64

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 what parts words, 2 what parts pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, length of each, its document, whether it begins a piece) of lower-cased texts."""
    n = len(data)
    kind = _KIND[data]
    inside = kind == 0
    cut = offs[(offs > 0) & (offs < n)]
    edge = np.empty(n, dtype=bool)
    edge[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=edge[1:])
    edge[cut] = inside[cut]
    start = np.flatnonzero(edge)
    np.greater(inside[:-1], inside[1:], out=edge[:-1])
    edge[n - 1] = inside[n - 1]
    edge[cut - 1] = inside[cut - 1]
    size = np.flatnonzero(edge) + 1 - start
    at = np.searchsorted(start, offs)
    first = np.zeros(len(start) + 1, dtype=bool)
    first[at] = True
    first[np.searchsorted(start, np.flatnonzero(kind == 2))] = True  # the first word behind what parts pieces
    return _LOWER[data[inside]], size, np.repeat(np.arange(len(offs) - 1), np.diff(at)), first[:-1]


class Shard:
    """Words as whole numbers: word[i] names the (language, word) of place i, `first` the places where pieces begin."""

    def __init__(self, parts: list[tuple], langs: list[str]):
        data, size, lang, self.first = (np.concatenate(x) for x in zip(*parts, strict=True))
        offsets = np.append(0, np.cumsum(size))
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        n = len(texts.dictionary)
        key = lang * n + texts.indices.to_numpy()
        count = np.bincount(key, minlength=n * len(langs))
        key_of = np.flatnonzero(count)
        dense = np.empty(len(count), dtype=np.int32)
        dense[key_of] = np.arange(len(key_of))
        self.word, self.count = dense[key], count[key_of]
        self.langs, self.lang = langs, key_of // n
        self.names = texts.dictionary.take(pa.array(key_of % n)).cast(pa.large_string())

    def hashes(self) -> np.ndarray:
        """The hash of each (language, word), as Spark's xxhash64 gives it."""
        from xxhash import xxh64_intdigest

        seeds = [xxh64_intdigest(x.encode(), 42) for x in self.langs]
        return np.array([xxh64_intdigest(w, seeds[x]) for x, w in zip(self.lang.tolist(), self.names.to_pylist(), strict=True)], dtype=_U)

    def lang_of(self, words: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[words]))


def shards(batches):
    """The shards of a task's batches (text, lang)."""
    held, count, langs = [], 0, {}
    for batch in batches:
        data, offs = buffers(batch.column(0))
        if len(data):
            words, size, doc, first = split(data, offs)
            code = np.array([langs.setdefault(x, len(langs)) for x in batch.column(1).to_pylist()], dtype=np.int64)
            held.append((words, size, code[doc], first))
            count += len(size)
        if count >= SHARD:
            yield Shard(held, list(langs))
            held, count, langs = [], 0, {}
    if count:
        yield Shard(held, list(langs))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of each key, how many there are)."""
    import pandas as pd

    codes, found = pd.factorize(keys)
    return codes, len(found)


def runs(word_ok: np.ndarray, first: np.ndarray, pair_ok: np.ndarray | None = None) -> np.ndarray:
    """For each word, how many words up to it stand together in its piece, where words and pairs are let pass; 0 for others."""
    begins = first | ~word_ok
    begins[1:] |= ~word_ok[:-1]
    if pair_ok is not None:
        begins |= ~pair_ok
    at = np.arange(len(first))
    return np.where(word_ok, at - np.maximum.accumulate(np.where(begins, at, 0)) + 1, 0)


class Links:
    """The tree of suffix links of a shard's automaton, level by level down to `depth` words.

    levels[k - 1] is (a place where the phrase ends, link to the node without the first word, number of places) of the
    nodes of k words.
    """

    def __init__(self, word: np.ndarray, run: np.ndarray, depth: int):
        self.levels = []
        base = int(word.max()) + 1 if len(word) else 1
        at = np.flatnonzero(run >= 1)
        node = np.zeros(len(at), dtype=np.int64)
        for k in range(1, depth + 1):
            if k > 1:
                keep = run[at] >= k
                at, node = at[keep], node[keep]
            if not len(at):
                break
            above, (node, n) = node, numbered(node * base + word[at - k + 1])
            place, link = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            place[node], link[node] = at, above
            self.levels.append((place, link, np.bincount(node, minlength=n)))

    def states(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, longest, shortest, number of places) of each state, for phrases of two words and more.

        Nodes along a link with one number have the same places: they are one state, whose phrases are the ends of the
        longest.
        """
        out, last = [], None
        for k, (place, link, count) in enumerate(self.levels, 1):
            if k < 2:
                continue
            low, end = np.full(len(count), k), np.ones(len(count), dtype=bool)
            if last is not None:
                same = last[3][link] == count
                low[same] = last[2][link[same]]
                last[4][link[same]] = False
            last = (place, np.full(len(count), k), low, count, end)
            out.append(last)
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 4
        return tuple(np.concatenate([x[j][x[4]] for x in out]) for j in range(4))


# ---- passes over the corpus ---------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words, and (lang, null, n): the number of words of a language."""

    def run(batches):
        for s in shards(batches):
            total = np.bincount(s.lang, weights=s.count, minlength=len(s.langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([s.lang_of(np.arange(len(s.count))), s.names.cast(pa.string()), pa.array(s.count)], names=["lang", "word", "f"])
            yield pa.RecordBatch.from_arrays([pa.array(s.langs, pa.string()), pa.nulls(len(total), pa.string()), pa.array(total)], names=["lang", "word", "f"])

    return _texts(docs).mapInArrow(sparing(run), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _pairs(hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(hashes[left]) * _U(0xD6E8FEB86659FD93) + hashes[right])


def pair_counts(docs: DataFrame, words: Bitmap) -> DataFrame:
    """(key, f) of pairs of words that `words` lets pass; keys are hashes, so f is that of a pair at least."""

    def run(batches):
        for s in shards(batches):
            h = s.hashes()
            run = runs(words.has(h)[s.word], s.first)
            links = Links(s.word, run, 2)
            if len(links.levels) < 2:
                continue
            place, _, count = links.levels[1]
            key = _pairs(h, s.word[place - 1], s.word[place])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "f"])

    return _texts(docs).mapInArrow(sparing(run), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, words: Bitmap, pairs: Bitmap) -> DataFrame:
    """(lang, phrase, size, a) of phrases of 2 to DEPTH words whose words and pairs pass; the counts are exact."""

    def run(batches):
        for s in shards(batches):
            h = s.hashes()
            ok = words.has(h)[s.word]
            both = np.zeros(len(ok), dtype=bool)
            at = np.flatnonzero(ok[1:] & ok[:-1] & ~s.first[1:]) + 1
            both[at] = pairs.has(_pairs(h, s.word[at - 1], s.word[at]))
            place, high, low, count = Links(s.word, runs(ok, s.first, both), DEPTH).states()
            for at in range(0, len(place), AT_ONCE):
                p, k, some = (x[at : at + AT_ONCE] for x in (place, high, low))
                texts = s.names.take(pa.array(s.word[spread(p - k + 1, k)])).cast(pa.string())
                phrase = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)).astype(np.int32)), texts), " ")
                yield pa.RecordBatch.from_arrays([s.lang_of(s.word[p]), phrase, pa.array(k.astype(np.int32)), pa.array(some.astype(np.int32)), pa.array(count[at : at + AT_ONCE])], names=["lang", "phrase", "high", "low", "f"])

    states = _texts(docs).mapInArrow(sparing(run), "lang string, phrase string, high int, low int, f long")
    # along the links: the phrases of a state are the ends of its longest one
    each = states.select("lang", "phrase", F.explode(F.sequence("low", "high")).alias("size"), "f")
    each = each.select("lang", F.expr("substring_index(phrase, ' ', -size)").alias("phrase"), "size", "f")
    return each.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("a"))


class Bitmap:
    """A set of hashes in a fixed number of bits; has() may be true of others too."""

    def __init__(self, keys: DataFrame, bits: int):
        """keys(key): hashes as long. The bitmap is collected in rows of 4 kB and broadcast, bits / 8 bytes in all."""
        spark = keys.sparkSession
        slot = F.pmod(F.col("key"), F.lit(bits)) + 1  # from 1, as bitmap buckets count
        rows = keys.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
        held = np.zeros(bits // 8, dtype=np.uint8)
        for r in rows.toLocalIterator():
            at = (r.b - 1) * 4096
            held[at : at + 4096] = np.frombuffer(r.bits, dtype=np.uint8)[: len(held) - at]
        self.bits = bits
        self.held = spark.sparkContext.broadcast(held)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes.astype(_U) % _U(self.bits)
        return self.held.value[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8) & 1 == 1


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases(lang, phrase, size, a) with the counts l and r of the parts at the cut of the lowest score, n and score.

    counts(lang, phrase, f) has every part; totals(lang, n) a row a language. Products keep 38 digits.
    """
    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - size)")
    cuts = cuts.withColumn("first", first).withColumn("rest", rest)
    l = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    r = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(grown(l), ["lang", "first"]).join(grown(r), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def apart(phrases: DataFrame) -> DataFrame:
    """phrases less those inside a longer one that stands as often.

    If a longer one does, so does one of a word more, which is a candidate itself: so a phrase is compared with its
    suffix link, the phrase without its first word, and with that without its last.
    """
    longer = phrases.filter("size > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - size)"), F.expr("substring_index(phrase, ' ', size - 1)"))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    return phrases.join(grown(most), ["lang", "phrase"], "left").filter("_most is null or 100 * _most < 100 * a").drop("_most")


def best(scores: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language with their rank; first within shares of a language, then of what is left."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = scores.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    part = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= most)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most).drop("share")


def phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates(lang, phrase, size, a), counts(lang, phrase, f), totals(lang, n)) of docs(text, lang).

    A candidate has 2 to DEPTH words and stands at `least` places; counts has candidates and words.
    """
    words = materialize(word_counts(docs).filter((F.col("f") >= least) | F.col("word").isNull()))
    totals = words.filter("word is null").select("lang", F.col("f").alias("n"))
    frequent = words.filter(F.col("word").isNotNull() & (F.col("f") >= least))
    word_map = Bitmap(frequent.select(F.xxhash64("lang", "word").alias("key")), WORD_BITS)
    pair_map = Bitmap(pair_counts(docs, word_map).filter(F.col("f") >= least).select("key"), PAIR_BITS)
    found = materialize(phrase_counts(docs, word_map, pair_map).filter(F.col("a") >= least))
    counts = found.select("lang", "phrase", F.col("a").alias("f")).unionByName(frequent.select("lang", F.col("word").alias("phrase"), "f"))
    return found, counts, totals


def collocations(docs: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` best phrases of each language.

    Texts are lower-cased (A-Z); a null or empty text has no words, a null language is `und`. Repeated rows count each
    for itself. Ties stand in order of a, from the largest, then of the phrase by bytes. Other columns are not read.
    """
    found, counts, totals = phrases(docs, least)
    out = best(scored(apart(found), counts, totals), most)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

