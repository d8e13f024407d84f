"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ORDER bytes holds how often each byte followed. A byte that
was never seen after a context escapes to the next shorter one with probability D / (N + D), where N counts
what followed the context and D the different bytes among it (method C); below the empty context all 256
bytes are alike. The counts are frozen, so code lengths are exact sums, held in units of 1/1024 bit. The
language with the shortest code wins; the score is its posterior under equal priors.

Text is folded first: ASCII and Latin-1 letters to lower case, runs of other ASCII characters to one blank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, sparing

ORDER = 3
UNIT = 1024
#: Bytes of text whose code lengths are summed at once, within a text too: a hundred bytes of memory go to each.
PART = 1 << 18
UND = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def fold(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of concatenated texts, and their offsets."""
    if not len(data):
        return data, offs
    out = _FOLD[data]
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out = out + (latin * np.uint8(32))
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[offs[:-1][offs[:-1] < len(out)]] = True
    return out[keep], np.cumsum([0, *(np.count_nonzero(keep[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True))])


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one integer; before a text stand blanks."""
    out = data.astype(np.int64)
    starts = offs[:-1]
    for k in range(1, ORDER + 1):
        prev = np.full(len(data), 32, dtype=np.int64)
        prev[k:] = data[:-k]
        for j in range(k):
            at = (starts + j)[(starts + j < len(data)) & (j < np.diff(offs))]
            prev[at] = 32
        out |= prev << (8 * k)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def gram_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(language's place, gram, n) over docs(text, lang), summed on the executors."""

    def run(batches):
        for batch in batches:
            for some, data, offs in chunks(batch):
                lang = np.array([languages.index(x) for x in some.column(1).to_pylist()], dtype=np.int64)
                data, offs = fold(data, offs)
                parts = []
                for begin in range(0, len(data), PART):
                    end, low = min(begin + PART, len(data)), max(0, begin - ORDER)
                    g = grams(data[low:end], np.clip(offs - low, 0, end - low))[begin - low :]
                    parts.append(np.unique(lang[np.searchsorted(offs, np.arange(begin, end), side="right") - 1] << 32 | g, return_counts=True))
                if not parts:
                    continue
                key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["k", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(sparing(run), "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))


class PpmModel:
    """Code lengths of all languages, as tables that a gram leads to in two steps."""

    def __init__(self, languages: list[str], k: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.languages = languages
        seen = np.unique(gram & 0xFF)
        self.symbols = np.zeros(256, dtype=np.int64)  # 0: a byte that no language has
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.a = a = len(seen) + 1
        part = [self.symbols[gram >> (8 * j) & 0xFF] for j in range(ORDER + 1)]  # part[0] follows the others
        context = (part[3] * a + part[2]) * a + part[1]
        contexts = np.unique(context)
        self.place = np.full(a**3, -1, dtype=np.int32)
        self.place[contexts] = np.arange(len(contexts))
        self.low = np.empty((a**3, len(languages)), dtype=np.int32)
        self.high = np.empty((len(contexts) * a, len(languages)), dtype=np.int32)
        for lang in range(len(languages)):
            own = k == lang
            w, p0, p1, p2 = n[own].astype(float), part[0][own], part[1][own], part[2][own]
            p = np.full((1, a), 1 / 256)
            # each step: the contexts one byte longer, and which shorter context each of them escapes to
            steps = (
                (np.zeros_like(p0), 1, np.zeros(1, dtype=np.int64)),
                (p1, a, np.zeros(a, dtype=np.int64)),
                (p2 * a + p1, a * a, np.arange(a * a) % a),
                (self.place[context[own]], len(contexts), contexts % (a * a)),
            )
            for depth, (ctx, size, shorter) in enumerate(steps):
                counts = np.bincount(ctx * a + p0, weights=w, minlength=size * a).reshape(size, a)
                total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
                escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
                p = np.where(counts > 0, counts / np.maximum(total + kinds, 1), escape * p[shorter])
                if depth == 2:
                    self.low[:, lang] = np.rint(-np.log2(p.reshape(-1)) * UNIT)
            self.high[:, lang] = np.rint(-np.log2(p.reshape(-1)) * UNIT)

    def lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each folded text in each language, in 1/UNIT bits.

        PART bytes at a time, with the ORDER bytes before them, so that a text of any length takes the same memory.
        """
        out = np.zeros((len(offs) - 1, len(self.languages)), dtype=np.int64)
        for begin in range(0, len(data), PART):
            end, low = min(begin + PART, len(data)), max(0, begin - ORDER)
            g = grams(data[low:end], np.clip(offs - low, 0, end - low))[begin - low :]
            s = [self.symbols[g >> (8 * j) & 0xFF] for j in range(ORDER + 1)]
            at = self.place[(s[3] * self.a + s[2]) * self.a + s[1]]
            cost = np.where((at >= 0)[:, None], self.high[np.maximum(at, 0) * self.a + s[0]] if len(self.high) else 0, self.low[(s[2] * self.a + s[1]) * self.a + s[0]])
            total = np.zeros((len(cost) + 1, len(self.languages)), dtype=np.int64)
            np.cumsum(cost, axis=0, out=total[1:])
            within = np.clip(offs - begin, 0, end - begin)
            out += total[within[1:]] - total[within[:-1]]
        return out


def fit(docs: DataFrame, fit_docs: int = 800) -> PpmModel | None:
    """A model from docs(doc_id, text, lang) that are not held out; None if there are none.

    Learns from a sample of about `fit_docs` whole documents a language at most: those whose hashed id falls
    below the share that gives this many. Its counts come to the driver, bounded by the sample.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").collect()}
    if not sizes:
        return None
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, fit_docs / n))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    rows = rows.filter(draw < share[F.col("lang")])
    languages = list(sizes)
    got = gram_counts(rows, languages).collect()
    return PpmModel(languages, *(np.array([r[i] for r in got], dtype=np.int64) for i in range(3))) if got else None


def identify(docs: DataFrame, model: PpmModel | None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; the text alone decides.

    Null texts and texts without a letter give `und` and 0.0; so does a model of nothing. Ties go to the
    language that sorts first. Null ids are never held out; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for some, data, offs in chunks(batch, "text", PART):
                bits = m.lengths(*fold(data, offs)) / UNIT
                best = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
                score = 1 / np.exp2(-gap).sum(axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array([m.languages[i] for i in best]), pa.array(score)], names=["doc_id", "held_out", "lettered", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.col("text"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), lettered.alias("lettered"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows.mapInArrow(sparing(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lettered boolean, lang_pred string, score double")
    return out.select("doc_id", "held_out", F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UND).alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))


def kept_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found, with all their columns: `und` and scores below `least` go.

    The prediction is made for the row itself, so repeated ids don't matter.
    """
    model = fit(docs)
    spark, schema = docs.sparkSession, docs.schema
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        m = sent.value
        for batch in batches:
            for some, data, offs in chunks(batch, "text", PART):
                bits = m.lengths(*fold(data, offs)) / UNIT
                score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)).sum(axis=1)
                yield some.filter(pa.array(score >= least))

    if model is None:
        return docs.limit(0)
    return docs.filter(docs.columns[at] + r" rlike '\\p{L}'").mapInArrow(sparing(run), schema)
