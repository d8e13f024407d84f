"""N-gram Jaccard join by parity sketches.

A document's shingles are XOR-hashed into a bit sketch: each shingle flips one bit. What two sets share
cancels out, so the Hamming distance of their sketches is at most the size of their symmetric difference,
which is at most (a + b) / 9 for sets of sizes a and b with a Jaccard similarity of 0.8.

The join works on wide, sparse sketches cut into segments, a segment being known by the XOR of its shingles'
hashes. In a size band whose pairs differ in k shingles at most, k + 1 segments or more have one that no
difference touches (pigeonhole). Documents of a band, and those of the band below, meet on equal segments.

Candidates of a segment are compared in stars first: its smallest id against all others. Links found by exact
verification form components. What is left are pairs of one segment in different components: pairs of small
groups meet in a join, and groups beyond SMALL members are compared in blocks by narrow sketches, whose
Hamming distance throws out pairs before they are made. So no two documents that links connect stay apart, though
not every link is verified for that. The number of links comes last: a component's classes of equal sets are
compared in full, in blocks, by products of incidence matrices of the shingles that two blocks share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB, Key, among, apart_from, bucket_count, chunks, dealt, exchange, grown, id_table, materialize, mix, new_key, owners, pack, repeated, sparing, unpack, without, words
from .components import components
from .windows import NULLS, keyed

#: Words of a shingle; similarity as a ratio of integers: 100 * both >= 80 * either.
SHINGLE, NUM, DEN = 5, 80, 100
RATIO = 1.25
#: Members of a segment up to which its pairs meet in a join; ids of a block beyond; bits of a narrow sketch.
SMALL, BLOCK = 24, 128
SKETCH_BITS = 2048
#: Classes and shingles of a block of a component, on average; shared shingles whose incidence is multiplied at a time.
LINK_CLASSES, LINK_SHINGLES, SLAB = 512, 500_000, 2048

_M = np.uint64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, offs: np.ndarray, key: Key = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, and document offsets into them; words are hashed under the key."""
    h, _, _, offs = words(data, offs, lower=True, key=key)
    n = np.diff(offs)
    own = owners(offs)
    place = np.arange(len(h)) - offs[own]
    whole = np.flatnonzero(place + SHINGLE <= n[own])
    value = h[whole].copy()
    for k in range(1, SHINGLE):
        value = mix(value * _M + h[whole + k])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        acc = n[short].astype(np.uint64)  # the number of words tells sequences of different lengths apart
        for k in range(SHINGLE - 1):
            on = k < n[short]
            acc = np.where(on, mix(acc * _M) + h[np.minimum(offs[short] + k, len(h) - 1)], acc)
        value, doc = np.concatenate([mix(value), mix(acc ^ _M)]), np.concatenate([own[whole], short])
    else:
        value, doc = mix(value), own[whole]
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16) if len(n) < 65536 else doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def _bands(most: int) -> np.ndarray:
    """Lower limits of size bands: 1, 2, 3, ... and then each RATIO times the one before."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out)


def _segments(band: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, segments) of bands: differences of its pairs at most, and a few segments more than k + 1.

    The surplus makes up for segments that are empty in both documents and so say nothing.
    """
    largest = bands[band + 1] - 1
    k = 2 * largest * (DEN - NUM) // (DEN + NUM)
    return k, k + 1 + k // 8 + 1


def segment_keys(value: np.ndarray, offs: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of all segments by which documents may meet."""
    n = np.diff(offs)
    keys, docs = [], []
    own_band = np.searchsorted(bands, n, side="right") - 1
    for up in (0, 1):
        band = own_band + up
        # the next band only where a document of it can be similar: NUM / DEN of its least size at most n
        active = (n > 0) & (n * DEN >= bands[np.minimum(band, len(bands) - 1)] * NUM) & (band + 1 < len(bands))
        d = np.flatnonzero(active)
        if not len(d):
            continue
        k, s = _segments(band[d], bands)
        base = np.cumsum(s) - s
        slot_of = np.full(len(n), -1)
        slot_of[d] = np.arange(len(d))
        own = slot_of[owners(offs)]
        v, own = value[own >= 0], own[own >= 0]
        slot = base[own] + (v >> np.uint64(20)).astype(np.int64) % s[own]
        order = np.argsort(slot, kind="stable")
        ordered, at = slot[order], np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
        parity = np.zeros(int(s.sum()), dtype=np.uint64)
        full = np.zeros(int(s.sum()), dtype=bool)
        parity[ordered[at]] = np.bitwise_xor.reduceat(v[order], at)
        full[ordered[at]] = True
        of = np.repeat(np.arange(len(d)), s)
        empty = np.bincount(of, weights=~full, minlength=len(d))
        # where empty segments could be the only ones untouched, they count too
        use = full | (empty >= s - k)[of]
        place = (np.arange(len(of)) - base[of]).astype(np.uint64)
        salt = mix(place + (band[d][of].astype(np.uint64) << np.uint64(32)))
        keys.append(mix(parity ^ salt)[use])
        docs.append(d[of][use])
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


PRINT = "k long, h long, doc_id long, n_shingles long, x long, y long, sketch binary"


def sketches(value: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Parity sketches: each shingle flips one of SKETCH_BITS bits of its document's."""
    n = len(offs) - 1
    cell = owners(offs) * SKETCH_BITS + (value >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    bits = np.packbits((np.bincount(cell, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)
    return [row.tobytes() for row in bits]


def fingerprints(rows: DataFrame, key: Key) -> DataFrame:
    """(k, h, doc_id, n_shingles, x, y, sketch): x and y are 64-bit sums over the set, equal for equal sets."""

    def run(batches):
        for batch in batches:
            for some, data, offs in chunks(batch):
                v, offs = shingles(data, offs, key)
                x = np.concatenate([[np.uint64(0)], np.cumsum(v)])[offs]
                y = np.concatenate([[np.uint64(0)], np.cumsum(mix(v ^ _M))])[offs]
                columns = [*(some.column(i) for i in range(3)), pa.array(np.diff(offs)), pa.array(np.diff(x).view(np.int64)), pa.array(np.diff(y).view(np.int64)), pa.array(sketches(v, offs), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PRINT.split(", ")])

    return rows.select("k", "h", "doc_id", "text").mapInArrow(sparing(run), PRINT)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of sketches."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def possible(distance: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and this distance at least can be similar."""
    return (distance * (DEN + NUM) <= (n + m) * (DEN - NUM)) & (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM)


def near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs(a, b) that their sketches and sizes leave possible."""
    side = prints.select("k", "n_shingles", "sketch")
    both = pairs.join(grown(side.toDF("a", "n", "x")), "a").join(grown(side.toDF("b", "m", "y")), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, SKETCH_BITS // 64) for c in (4, 5))
            ok = possible(apart(x, y), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(sparing(run), "a long, b long").distinct()


def _postings(rows: DataFrame, most: int, buckets: int, key: Key) -> DataFrame:
    """(key, k) of segments that two or more documents have."""
    import pandas as pd

    bands = _bands(most)

    def parts(batches):
        for batch in batches:
            for some, data, offs in chunks(batch):
                v, offs = shingles(data, offs, key)
                segment, doc = segment_keys(v, offs, bands)
                ids = id_table(some)
                ids["h"] = 0  # not asked for here
                yield segment, doc, np.zeros(len(segment), dtype=np.uint32), ids, None

    def reduce(r):
        hit = repeated(r)
        return pd.DataFrame({"key": r["key"][hit].view(np.int64), "k": r["ids"]["id"][r["doc"][hit]]})

    entries = rows.select("k", "h", "text").mapInArrow(sparing(lambda batches: dealt(parts(batches), buckets, keep=True)), BLOB)
    return exchange(entries, reduce, "key long, k long")


def verified(pairs: DataFrame, rows: DataFrame, key: Key) -> DataFrame:
    """The pairs(a, b) whose shingle sets are similar, by their whole texts."""
    ids = pairs.select(F.col("a").alias("k")).union(pairs.select("b"))
    texts = among(rows, ids, "k").select("k", "text")
    both = pairs.join(grown(texts.toDF("a", "ta")), "a").join(grown(texts.toDF("b", "tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for c in range(0, batch.num_rows, 500):
                some = batch.slice(c, 500)
                sets, keep = {}, []
                for pair in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    for t in pair:
                        if t not in sets:
                            raw = np.frombuffer(t.encode(), dtype=np.uint8)
                            sets[t] = shingles(raw, np.array([0, len(raw)]), key)[0]
                    x, y = map(sets.__getitem__, pair)
                    z = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((z[1:] == z[:-1]).sum())
                    keep.append(common > 0 and DEN * common >= NUM * (len(x) + len(y) - common))
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(sparing(run), "a long, b long")


def _block_pairs(large: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs in different components within segments of many members: large(key, k, component, size)."""
    known = large.join(grown(prints.select("k", F.col("n_shingles").alias("n"), "sketch")), "k")
    known = known.join(large.groupBy("key", "component").agg(F.count("*").alias("own")), ["key", "component"])
    # a component of many members has blocks to itself, which need no comparison with each other
    alone = F.col("own") > BLOCK
    label = F.when(alone, F.pmod(F.xxhash64("k"), F.ceil(F.col("own") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("size") / BLOCK)))
    packed = known.groupBy("key", F.xxhash64(F.when(alone, F.col("component")).otherwise(-1), label).alias("id"))
    packed = packed.agg(F.collect_list(F.struct("k", "component", "n", "sketch")).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    left, right = packed.select("key", F.col("m").alias("x"), F.col("id").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1")), packed.select("key", F.col("m").alias("y"), F.col("id").alias("j"), "lo", "hi")
    meets = left.join(right, "key").filter("i <= j and not (lo1 = hi1 and lo = hi and lo1 = lo)").select("x", "y")

    def run(batches):
        def columns(cell):
            m = cell.as_py()
            return (*(np.array([e[c] for e in m]) for c in ("k", "component", "n")), np.frombuffer(b"".join(e["sketch"] for e in m), dtype=np.uint64).reshape(len(m), -1))

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                (kx, cx, nx, sx), (ky, cy, ny, sy) = columns(x), columns(y)
                ok = (cx[:, None] != cy[None, :]) & possible(apart(sx[:, None, :], sy[None, :, :]), nx[:, None], ny[None, :])
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(kx[i], ky[j])), pa.array(np.maximum(kx[i], ky[j]))], names=["a", "b"])

    return meets.mapInArrow(sparing(run), "a long, b long")


SETS = "component long, own long, blocks long, sets binary"


def similar(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Which sets of x are similar to which of y, from their distinct shingles v and counts n."""
    both = np.intersect1d(x["v"], y["v"])
    common = np.zeros((len(x["n"]), len(y["n"])), dtype=np.float32)
    at = []
    for side in (x, y):
        place = np.minimum(np.searchsorted(both, side["v"]), max(0, len(both) - 1))
        on = both[place] == side["v"] if len(both) else np.zeros(len(place), dtype=bool)
        row, column = np.repeat(np.arange(len(side["n"])), side["n"])[on], place[on]
        order = np.argsort(column, kind="stable")
        at.append((row[order], column[order]))
    for c in range(0, len(both), SLAB):
        width, parts = min(SLAB, len(both) - c), []
        for side, (row, column) in zip((x, y), at, strict=True):
            lo, hi = np.searchsorted(column, (c, c + width))
            m = np.zeros((len(side["n"]), width), dtype=np.float32)
            m[row[lo:hi], column[lo:hi] - c] = 1
            parts.append(m)
        common += parts[0] @ parts[1].T
    common = common.astype(np.int64)
    return (common > 0) & (DEN * common >= NUM * (x["n"][:, None] + y["n"][None, :] - common))


def link_counts(classes: DataFrame, rows: DataFrame, key: Key) -> DataFrame:
    """(rep, rep_h, others): rows whose sets are similar to a class's and not equal, from (component, rep, rep_h, n_shingles, weight).

    A component of many classes is cut into blocks, each of which meets each other once.
    """
    sizes = classes.groupBy("component").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("all")).filter("members > 1")
    blocks = F.ceil(F.greatest(F.col("members") / LINK_CLASSES, F.col("all") / LINK_SHINGLES)).cast("long")
    placed = classes.join(sizes, "component").withColumn("blocks", blocks).select(F.col("rep").alias("k"), F.col("rep_h").alias("h"), "component", "weight", "blocks")
    placed = materialize(placed.withColumn("own", F.pmod(F.xxhash64("k", "h"), F.col("blocks"))))
    texts = among(rows, placed, "k").select("k", "h", "text").join(grown(placed), ["k", "h"])
    packed = texts.groupBy("component", "own", "blocks").agg(F.collect_set(F.struct("k", "h", "weight", "text")).alias("m"))

    def sets(batches):
        for batch in batches:
            for r in batch.to_pylist():
                m = r["m"]
                raw = [e["text"].encode() for e in m]
                v, offs = shingles(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), key)
                blob = pack(v=v, n=np.diff(offs).astype(np.int64), **{c: np.array([e[c] for e in m], dtype=np.int64) for c in ("k", "h", "weight")})
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]]) for c in ("component", "own", "blocks")), pa.array([blob], pa.binary())], names=["component", "own", "blocks", "sets"])

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for bx, by in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unpack(bx)
                y = x if by is None else unpack(by)
                ok = similar(x, y)
                if by is None:
                    np.fill_diagonal(ok, False)
                for side, n in ((x, ok @ y["weight"]), (y, x["weight"] @ ok))[: 1 if by is None else 2]:
                    for c, v in zip(out, (side["k"], side["h"], n), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64)) for c in out], names=["rep", "rep_h", "others"])

    packed = materialize(packed.mapInArrow(sparing(sets), SETS), release=True)
    left = packed.filter("own + 1 < blocks").select("component", F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)).alias("own"), F.col("sets").alias("x"))
    meets = left.join(packed.select("component", "own", F.col("sets").alias("y")), ["component", "own"]).select("x", "y")
    meets = packed.select(F.col("sets").alias("x"), F.lit(None).cast("binary").alias("y")).union(meets)
    return meets.mapInArrow(sparing(run), "rep long, rep_h long, others long").groupBy("rep", "rep_h").agg(F.sum("others").alias("others"))


def linked(docs: DataFrame, counted: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, and n_links (how many other rows it links with).

    Links join documents whose sets of lower-cased (A-Z) five-word shingles have 80 % or more in common; a text
    of fewer words is one shingle. component_id is the smallest doc_id that links reach. Texts without words
    (null too) link with nothing. Equal sets form a class, of which one document takes part in the join.
    Null ids are larger than any other, and come out as null; rows with the same id are one document with
    several texts, which joins what they link with. n_links is counted for each row, equal rows included, and
    only if `counted`.
    """
    rows, key = keyed(docs), new_key()
    prints = materialize(fingerprints(rows, key))
    classes = prints.filter("n_shingles > 0").groupBy("n_shingles", "x", "y").agg(F.min(F.struct("k", "h")).alias("r"), F.count("*").alias("weight"))
    classes = classes.select("n_shingles", "x", "y", F.col("r.k").alias("rep"), F.col("r.h").alias("rep_h"), "weight")
    members = materialize(prints.join(grown(classes), ["n_shingles", "x", "y"], "left").select("k", "h", "doc_id", "n_shingles", "rep", "rep_h", "weight"))
    total, most = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.coalesce(F.max("n_shingles"), F.lit(0))).first()
    # only one document of each class goes on; texts of the others are told apart by a filter, then exactly
    gone = materialize(members.filter("rep is null or k != rep").select("k", "h"))
    postings = materialize(_postings(without(rows, gone), most, bucket_count(docs.sparkSession, total * 3 // 5), key), release=True)
    lone = prints.join(grown(gone), ["k", "h"], "left_anti")
    hubs = postings.groupBy("key").agg(F.min("k").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    star = postings.join(grown(hubs), "key").filter("k != hub").select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()
    star = materialize(near(star, lone), release=True)
    links = materialize(verified(star, rows, key), release=True)
    found = components(links)
    # what the stars leave open: segments whose members lie in several components
    placed = postings.join(grown(found.withColumnRenamed("id", "k")), "k", "left").select("key", "k", F.coalesce("component", "k").alias("component"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key", "size")
    left = materialize(placed.join(grown(open_keys), "key"), release=True)
    small = left.filter(F.col("size") <= SMALL)
    other = small.select("key", F.col("k").alias("b"), F.col("component").alias("cb"))
    pairs = small.select("key", F.col("k").alias("a"), F.col("component").alias("ca")).join(grown(other), "key").filter("a < b and ca != cb").select("a", "b")
    pairs = pairs.distinct().union(_block_pairs(left.filter(F.col("size") > SMALL), lone)).distinct().join(grown(star), ["a", "b"], "left_anti")
    more = materialize(verified(materialize(near(pairs, lone), release=True), rows, key), release=True)
    found = materialize(components(links.union(more)).withColumnRenamed("id", "rep"))
    component = F.coalesce("component", "rep")
    out = members.join(grown(found), "rep", "left")
    if not counted:
        return out.select("doc_id", *_placed())
    # similar classes are always of one component, so its pairs are all that can link
    one = members.filter("rep is not null").select("rep", "rep_h", "n_shingles", "weight").distinct()
    one = one.join(grown(found), "rep", "left").withColumn("component", component)
    others = link_counts(one, rows, key)
    n_links = F.coalesce("others", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    return out.join(grown(others), ["rep", "rep_h"], "left").select("doc_id", *_placed(), n_links.cast("long").alias("n_links"))


def _placed():
    smallest = F.coalesce("component", "rep", "doc_id")
    return "n_shingles", F.when(smallest < NULLS, smallest).alias("component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stand for their group, with all columns: the smallest id of each component.

    Rows without an id stay, as no id says which of them to drop.
    """
    gone = materialize(linked(docs, counted=False).filter("doc_id != component_id").select("doc_id"))
    return apart_from(docs, gone).unionByName(among(docs, gone).join(grown(gone), "doc_id", "left_anti").select(*docs.columns))
