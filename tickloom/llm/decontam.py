"""Benchmark decontamination with template canonicalisation.

Words become template tokens: numbers, units and names are typed placeholders, all others lower-case letters
without the marks around them. Windows of WINDOW tokens of the documents are hash-joined with those of the
benchmark. Where enough windows of an item lie on one diagonal of a document, the slots must agree: a value
of the item stands for one value of the document, and the other way round. So a question with other numbers
or names is found, and a chance likeness of templates is not.

Items of fewer than WINDOW words are looked for at their own length; items of little but numbers and names
are looked for word for word. A capitalised word that starts a sentence within an item is a literal.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _RI, among, apart_from, chunks, fresh, grown, id_table, materialize, mix, powers, prefix_hash, span_hash, sparing
from .windows import key_of, keyed

#: Tokens of a window; literal tokens among them at least; windows of an item on one diagonal (or all it has).
WINDOW, LITERAL, RUN = 8, 4, 6
#: Benchmark windows up to which their hashes (8 bytes each) go to every executor; beyond, windows meet in a join.
SENT_WINDOWS = 2_000_000

#: Words that a worker keeps the tokens of; beyond, it starts anew.
LEXICON = 400_000

#: Words that count as units.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh km/h m/s dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit watt watts volt volts amp amps joule joules newton newtons".split())

_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
_EDGE = re.compile(r"^\W+|\W+$")
#: Tells keys of words as written from those of templates.
_EXACT = np.uint64(0x6D1F3B5A97C2E48B)


class Lexicon(dict):
    """word -> hash of its literal token with flags below: 1 may be a name, 2 ends a sentence, 4 is a number or unit.

    Without `typed`, numbers and units are hashed as they are written."""

    def __init__(self, typed: bool = True):
        self.typed = typed

    def __missing__(self, word: bytes) -> int:
        if len(self) > LEXICON:
            self.clear()
        text = word.decode(errors="replace")
        core = _EDGE.sub("", text)
        ends = 2 if text.rstrip("\"')]}*&$%#")[-1:] in (".", "!", "?", ":") else 0
        if self.typed and _NUMBER.fullmatch(core):
            token = "<num>"
        elif self.typed and core.lower() in UNITS:
            token = "<unit>"
        else:
            token = core.lower()
        named = 1 if token[:1] != "<" and core[:1].isupper() and core[1:].islower() else 0
        h = xxhash.xxh64_intdigest(token.encode())
        self[word] = out = h & ~7 | named | ends | (4 if token in ("<num>", "<unit>") else 0)
        return out


_NAME_HASH = np.uint64(0x5A3C96E1D2B4F788)


class Template(NamedTuple):
    """The words of texts laid end to end; end is the end of a word's text."""

    token: np.ndarray
    slot: np.ndarray  # the token is a placeholder
    literal: np.ndarray
    cased: np.ndarray  # a name or a literal, by what stands before it
    end: np.ndarray


def template(words: list[bytes], lexicon: Lexicon, counts: list[int] | None = None) -> Template:
    """The template of one text's words, or of several texts with these counts of words."""
    counts = np.array([len(words)] if counts is None else counts, dtype=np.int64)
    code = np.fromiter(map(lexicon.__getitem__, words), dtype=np.uint64, count=len(words))
    end = np.cumsum(counts)
    starts = np.ones(len(code), dtype=bool)
    starts[1:] = (code[:-1] & np.uint64(2)) > 0
    starts[(end - counts)[counts > 0]] = True
    cased, literal = (code & np.uint64(1)) > 0, mix(code & ~np.uint64(7))
    name = cased & ~starts
    return Template(np.where(name, _NAME_HASH, literal), name | (code & np.uint64(4) > 0), literal, cased, np.repeat(end, counts))


def windows(t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of `size` tokens that hold LITERAL words or more, or literals alone.

    What stands before a window is not part of it, so a capitalised first word counts both as a name and as a
    literal: such a place may have two hashes.
    """
    at = np.arange(max(0, len(t.token) - size + 1))
    at = at[at + size <= t.end[at]]
    plain = np.concatenate([[0], np.cumsum(~t.slot)])
    least, held = min(LITERAL, size), plain[at + size] - plain[at]
    c = prefix_hash(t.token)
    raw = (c[at + size] - c[at]) * powers(len(c), _RI)[at]
    slot = t.slot[at]
    one, two = held >= least, t.cased[at] & (np.where(slot, held + 1, held - 1) >= least)
    other = raw[two] - t.token[at[two]] + np.where(slot[two], t.literal[at[two]], _NAME_HASH)
    return np.concatenate([at[one], at[two]]), mix(np.concatenate([raw[one], other]))


def exact_windows(words: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all windows of words as they are written, less case and marks."""
    at = np.arange(max(0, len(words.literal) - size + 1))
    at = at[at + size <= words.end[at]]
    return at, mix(span_hash(prefix_hash(words.literal), at, at + size) ^ _EXACT)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(key, item_id, size, exact) of the windows of the benchmark.

    An item of fewer than WINDOW words is one window. One whose windows hold too few literals has an exact key
    of its first words instead, and is compared as a whole. Null and empty items have no windows; items of one text
    have the same keys, and a document that holds the text is reported for each of them.
    """

    def run(batches):
        lexicon, plain = Lexicon(), Lexicon(typed=False)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (t or "").encode().split()
                size = min(WINDOW, len(words))
                if not size:
                    continue
                _, key = windows(template(words, lexicon), size)
                exact = not len(key)
                if exact:
                    key = exact_windows(template(words, plain), size)[1][:1]
                key = np.unique(key)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([i] * len(key), batch.schema.field(0).type), pa.array([size] * len(key), pa.int32()), pa.array([exact] * len(key), pa.bool_())], names=["key", "item_id", "size", "exact"])

    return benchmark.select("item_id", "text").mapInArrow(sparing(run), f"key long, item_id {dict(benchmark.dtypes)['item_id']}, size int, exact boolean")


def _hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(k, h, key): the windows that a document and the benchmark have."""
    keys = items.select("key").distinct()
    kinds = sorted((r["exact"], r["size"]) for r in items.select("exact", "size").distinct().collect())  # 2 x WINDOW at most
    sent = None
    if items.count() <= SENT_WINDOWS:
        sent = rows.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in keys.collect()], dtype=np.int64).view(np.uint64)))

    def run(batches):
        lexicon, plain = Lexicon(), Lexicon(typed=False)
        known = sent.value if sent is not None else None
        for batch in batches:
            for some, data, offs in chunks(batch) if kinds else ():
                ids, raw = id_table(some), data.tobytes()
                words, counts = [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    own = raw[a:b].split()
                    words += own
                    counts.append(len(own))
                typed = template(words, lexicon, counts)
                written = template(words, plain, counts) if kinds[-1][0] else None
                of = np.repeat(np.arange(len(counts)), counts)
                docs, found = [], []
                for exact, size in kinds:
                    at, key = exact_windows(written, size) if exact else windows(typed, size)
                    if known is not None:
                        on = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                        at, key = at[on], key[on]
                    docs.append(of[at])
                    found.append(key)
                docs, found = np.concatenate(docs), np.concatenate(found)
                order = np.lexsort((found, docs))
                docs, found = docs[order], found[order]
                new = np.ones(len(docs), dtype=bool)
                new[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
                docs, found = docs[new], found[new]
                yield pa.RecordBatch.from_arrays([pa.array(ids["id"][docs]), pa.array(ids["h"][docs]), pa.array(found.view(np.int64))], names=["k", "h", "key"])

    found = rows.select("k", "h", "text").mapInArrow(sparing(run), "k long, h long, key long")
    return found if sent is not None else found.join(keys, "key", "left_semi").select("k", "h", "key")


def agree(item: list[bytes], text: list[bytes]) -> bool:
    """Whether slot values correspond one to one."""
    there, back = {}, {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(item, text, strict=True))


def _strip(word: bytes) -> str:
    return _EDGE.sub("", word.decode(errors="replace")).lower()


def matched(item: bytes, text: bytes, lexicon: Lexicon) -> int:
    """Windows of the item that lie on the text's best diagonal with agreeing slots; 0 if there are too few.

    An item with too few literals for windows has to be there word for word.
    """
    a, b = item.split(), text.split()
    ta, tb, size = template(a, lexicon), template(b, lexicon), min(WINDOW, len(a))
    (pa_, ka), (pb, kb) = windows(ta, size), windows(tb, size)
    if len(a) and not len(ka):
        x, y = list(map(_strip, a)), list(map(_strip, b))
        return (len(a) - size + 1) * any(y[i] == x[0] and y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    if not len(ka) or not len(kb):
        return 0
    order = np.argsort(ka, kind="stable")
    lo, hi = np.searchsorted(ka[order], kb), np.searchsorted(ka[order], kb, side="right")
    n = hi - lo
    which = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    pairs = np.unique(np.stack([np.repeat(pb, n) - pa_[which], pa_[which]], axis=1), axis=0)
    need = min(RUN, len(np.unique(pa_)))
    best = 0
    for shift, count in zip(*np.unique(pairs[:, 0], return_counts=True), strict=True):
        if count < max(need, best + 1):
            continue
        at = np.unique((pairs[pairs[:, 0] == shift, 1][:, None] + np.arange(size)).ravel())
        there = at + shift
        # first words that differ have met as names
        slots = at[ta.slot[at] & tb.slot[there] | ta.cased[at] & tb.cased[there] & (ta.literal[at] != tb.literal[there])]
        if agree([_strip(a[i]) for i in slots], [_strip(b[i + shift]) for i in slots]):
            best = int(count)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows): documents that hold a benchmark item or a re-parameterised copy of it.

    Null and empty texts match nothing, on either side; null item ids are compared like any other. A document
    without an id is found under a null id. Repeated rows count once. Either table may be empty.
    """
    return _found(docs, benchmark).select("doc_id", "item_id", "n_windows").distinct()


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k, text_hash, doc_id, item_id, n_windows): contaminated documents, told apart where they share an id or have none."""
    rows = keyed(docs)
    items = materialize(item_windows(benchmark))
    hits = materialize(_hits(rows, items))
    pairs = materialize(hits.join(items.select("key", "item_id"), "key").groupBy("k", "h", "item_id").agg(F.count("*").alias("n")))
    texts = among(rows, pairs, "k")
    named = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("item_text"))
    both = pairs.join(texts, ["k", "h"]).join(named.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i"))).select("doc_id", "item_id", "text", "item_text", "k", F.xxhash64("text").alias("text_hash"))

    def run(batches):
        lexicon = Lexicon()
        for batch in batches:
            n = [matched(i.as_py().encode(), t.as_py().encode(), lexicon) for t, i in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (4, 5, 0, 1)), pa.array(n, pa.int64())], names=["k", "text_hash", "doc_id", "item_id", "n_windows"])

    found = both.mapInArrow(sparing(run), f"k long, text_hash long, doc_id long, item_id {dict(benchmark.dtypes)['item_id']}, n_windows long")
    return found.filter("n_windows > 0")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows without an id, or with one that several texts share, go or stay by their own text.
    """
    k, text_hash = fresh(docs, "k"), fresh(docs, "text_hash")
    gone = materialize(_found(docs, benchmark).select(F.col("k").alias(k), F.col("text_hash").alias(text_hash)).distinct())
    rows = docs.withColumn(k, key_of(docs)).withColumn(text_hash, F.xxhash64(F.coalesce("text", F.lit(""))))
    rest = among(rows, gone, k).join(grown(gone), [k, text_hash], "left_anti")
    return apart_from(rows, gone, k).select(*docs.columns).unionByName(rest.select(*docs.columns))
