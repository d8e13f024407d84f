"""Shared pieces of the text operators: the shared folder, vectorised word hashing, blob exchange, id filters.

Words are maximal runs of characters other than space and 0x09-0x0D. They are hashed straight from
Arrow string buffers, so no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
import secrets
import struct
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, as a Java and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task hashes at once; a longer document is one chunk.
CHUNK = 1 << 20

_U = np.uint64
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_RI = pow(_R, -1, 1 << 64)


# ---- the shared folder -------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, a local one is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tickloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, release: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of lineage that survives lost executors.

    With `release`, the shuffle files of the finished step are let go at once: Spark's cleaner removes them
    when the driver's garbage is collected, which a small driver may not do for long.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if release:
        let_go(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tickloom_path = path
    return out


def let_go(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the shuffle files of finished steps.

    The listeners hold on to a finished query for a moment, so a collection right behind it would find nothing.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark._jvm.System.gc()


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers live from task to task, beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sparing(run: Callable) -> Callable:
    """run over a task's batches, with give_back() behind it."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; only for tables that nothing reads again."""
    spark, path = df.sparkSession, getattr(df, "_tickloom_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of text that Spark hands to a Python worker at a time; Arrow holds a few times that, outside the heap.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as texts of any length make a bound on rows alone no bound on memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def grown(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the corpus: it is joined by shuffle at every size, never broadcast."""
    return df.hint("merge")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows(k, h, ...) less the pairs in gone(k, h); only texts whose id may be among them are shuffled."""
    return apart_from(rows, gone, "k").unionByName(among(rows, gone, "k").join(grown(gone), ["k", "h"], "left_anti").select(*rows.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits (wraps modulo 2**64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _R) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 8), _U(base), dtype=_U)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_R))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """C with C[0] = 0 and C[i + 1] = C[i] + values[i] * R**i, for span_hash()."""
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


_A, _B = _U(0xD6E8FEB86659FD93), _U(0xA3B195354A39B70D)


def _triple(x: np.ndarray, y: np.ndarray, z: np.ndarray, other: bool = False) -> np.ndarray:
    a, b = (_B, _A) if other else (_A, _B)
    return mix(mix(x * a + y) * b + z)


def stretches(units: np.ndarray, at: np.ndarray, n: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Names of the stretches of n units from the places `at`, and 32 bits more of each if `wide`.

    A name of 3**(k + 1) units is made of three names of 3**k, and the last one of three that overlap. Every step
    is mixed, so no algebra of the units carries over to the names.
    """
    names, size = units, 1
    while size * 3 <= n:
        names = _triple(names[: len(names) - 2 * size], names[size : len(names) - size], names[2 * size :])
        size *= 3
    parts = (names[at], names[at + (n - size) // 2], names[at + n - size])
    return _triple(*parts), (_triple(*parts, other=True) >> _U(32)).astype(np.uint32) if wide else None


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that does not depend on where the span lies."""
    return mix((c[end] - c[start]) * powers(len(c), _RI)[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if not n or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `size` bytes of text each, with their bytes and offsets."""
    data, offs = buffers(batch.column(batch.schema.get_field_index(text)))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        b = min(b, n)
        yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


#: A key for the hashes of words, two numbers below 2**64: an operator draws one a run and gives it to all its tasks,
#: so that no one can make two words of one hash beforehand.
Key = tuple[int, int]
#: Bytes from which a word is hashed by itself, under the same key.
LONG_WORD = 256


def new_key() -> Key:
    return secrets.randbits(64), secrets.randbits(64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: Key) -> np.ndarray:
    """A keyed hash of each data[start:end]: a chain of mixed steps over its length and its blocks of eight bytes."""
    a, b = _U(key[0]), _U(key[1] | 1)
    length = end - start
    blocks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))
    h = mix(length.astype(_U) * b ^ a)
    at, left = np.flatnonzero(length <= LONG_WORD), 0
    while len(at):
        rest = length[at] - left
        block = blocks[start[at] + left]
        block[rest < 8] &= (_U(1) << (rest[rest < 8] * 8).astype(_U)) - _U(1)
        h[at] = mix((h[at] ^ block) * b)
        left += 8
        at = at[rest > 8]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=struct.pack("<QQ", *key)).digest()
        h[i] ^= _U(int.from_bytes(digest, "little"))
    return mix(h ^ a)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, key: Key = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word and n + 1 offsets of documents into the words."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(_U), z, z, np.zeros(len(offs), dtype=np.int64)
    inside = ~_IS_SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = inside[0], False
    np.greater(inside[1:], inside[:-1], out=edge[1:n])
    cut = offs[(offs > 0) & (offs < n)]
    edge[cut] |= inside[cut]
    start = np.flatnonzero(edge)
    edge[1:n] = inside[:-1] & ~inside[1:]
    edge[0], edge[n] = False, inside[-1]
    edge[cut] |= inside[cut - 1]
    end = np.flatnonzero(edge)
    h = word_hashes(_LOWER[data] if lower else data, start, end, key)
    return h, start, end, np.searchsorted(start, offs)


def owners(doc_offs: np.ndarray) -> np.ndarray:
    """For each item, the document it belongs to."""
    return np.repeat(np.arange(len(doc_offs) - 1), np.diff(doc_offs))


# ---- exchange of many small records as few binary rows ------------------------------------------
# A record is (key, document, position). A map task sorts its records by bucket = key % buckets and
# sends one binary value a bucket, so that Spark moves thousands of rows and not hundreds of millions.

BLOB = "bucket int, blob binary"
#: How a document is named in them: its id, and what tells rows of one id apart.
ID = np.dtype([("id", "<i8"), ("h", "<i8")])
#: Records that a task deals at a time.
DEAL = 500_000

_NAMES = ("id", "h", "n", "step", "low", "high", "check", "bucket", "more", "key", "known", "p", "v", "k", "weight", "done")
_TYPES = ("|u1", "<u2", "<u4", "<u8", "<i8", "|b1")
_HEAD = struct.Struct("<BBII")


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one binary value; each is zstd-compressed where that makes it shorter."""
    out = []
    for k, v in arrays.items():
        raw = np.ascontiguousarray(v).tobytes()
        z = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 64 else raw
        z = z if len(z) < len(raw) else raw
        out += (_HEAD.pack(_NAMES.index(k), _TYPES.index(v.dtype.str), len(raw), len(z)), z)
    return b"".join(out)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    while at < len(blob):
        k, dtype, raw, z = _HEAD.unpack_from(blob, at)
        body = blob[at + _HEAD.size : at + _HEAD.size + z]
        body = pa.decompress(body, decompressed_size=raw, codec="zstd", asbytes=True) if raw != z else body
        out[_NAMES[k]] = np.frombuffer(body, dtype=_TYPES[dtype])
        at += _HEAD.size + z
    return out


def small(x: np.ndarray) -> np.ndarray:
    """x in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def named(ids: np.ndarray) -> dict[str, np.ndarray]:
    """Documents in order of id, as arrays to pack: steps from id to id, and h where one is not 0."""
    step = np.diff(ids["id"].astype(_U), prepend=_U(0))
    return {"id": small(step)} | ({"h": ids["h"]} if ids["h"].any() else {})


def names(x: dict[str, np.ndarray]) -> np.ndarray:
    """The documents that named() packed."""
    out = np.zeros(len(x["id"]), dtype=ID)
    out["id"] = np.cumsum(x["id"].astype(_U)).view(np.int64)
    if "h" in x:
        out["h"] = x["h"]
    return out


def in_order(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, ids) with the documents in order of their ids."""
    if (ids["id"][1:] > ids["id"][:-1]).all():
        return doc, ids
    order = np.lexsort((ids["h"], ids["id"]))
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    return place[doc], ids[order]


def steps(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records in order of document and position as (documents, records of each, step from one position to the next)."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, dtype=np.int64)
    step = np.diff(pos.astype(np.int64), prepend=0)
    step[first] = pos[first]
    return doc[first], small(np.diff(np.append(first, len(doc)))), small(step)


def places(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the document, position) of the records that steps() packed."""
    count, step = x["n"].astype(np.int64), x["step"].astype(np.int64)
    total, start = np.cumsum(step), np.cumsum(count) - count
    return np.repeat(np.arange(len(count)), count), total - np.repeat(total[start] - step[start], count)


def differ(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def deal(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, check: np.ndarray, buckets: int, least: bool = False, keep: bool = False) -> pa.RecordBatch:
    """Records of a task as (bucket, blob) rows; doc indexes ids, a structured array of (id, h).

    Copies of a key within the records dealt at a time meet here. One record, marked `more`, stands for them in the
    exchange; the others are `done`, as their key is known to repeat, and travel by their document, with the key only
    to `keep` it. With `least`, the records of the smallest id stand for the key and those of larger ids are done.
    Either way a key of any frequency sends one record, or one document's, for each DEAL records of the corpus.

    40 bits of a key and its bucket travel for it; `check` (32 bits, or nothing) makes it longer.
    """
    doc, ids = in_order(doc, ids)
    wide = len(check) > 0
    if (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        keys, doc, pos, check = keys[order], doc[order], pos[order], check[order] if wide else check
    known = (check, keys) if wide else (keys,)
    order = np.lexsort((doc, *known)) if least else np.lexsort(known) if wide else np.argsort(keys, kind="stable")
    new = differ(*(c[order] for c in known))
    if least and len(order):
        group = np.cumsum(new) - 1
        owner = ids["id"][doc[order]]
        stay = owner == owner[new][group]
        more = np.zeros(int(stay.sum()), dtype=bool)
    else:
        stay = new
        more = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    stays, copied = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    stays[order[stay]], copied[order[stay]] = True, more
    first, done = np.flatnonzero(stays), np.flatnonzero(~stays)  # both in order of documents
    rows_b, rows = [], []
    for at, flag, b in ((first, copied, keys[first] % _U(buckets)), (done, None, doc[done] % buckets)):
        b = b.astype(np.uint16 if buckets < 65536 else np.int64)
        o = np.argsort(b, kind="stable")
        at, b = at[o], b[o]
        if not len(b):
            continue
        lim = np.flatnonzero(differ(b))
        for x, y in zip(lim, [*lim[1:], len(b)], strict=True):
            part = at[x:y]
            used, n, step = steps(doc[part], pos[part])
            own = {}
            if flag is not None or keep:
                k = keys[part]
                own = {"low": k.astype(np.uint32), "high": (k >> _U(32)).astype(np.uint8), "bucket": small(k[:1] % _U(buckets) if flag is not None else k % _U(buckets))}
                own |= {"check": check[part]} if wide else {}
            own |= {"more": np.packbits(flag[part])} if flag is not None else {"done": np.zeros(1, dtype=np.uint8)}
            rows_b.append(int(b[x]))
            rows.append(pack(**named(ids[used]), n=n, step=step, **own))
    return pa.RecordBatch.from_arrays([pa.array(rows_b, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "blob"])


def dealt(parts: Iterable[tuple], buckets: int, **how) -> Iterator[pa.RecordBatch]:
    """deal() over the parts (keys, documents, positions, ids, check or None) of a task, DEAL records or a part more at a time."""
    held: list[tuple] = []
    count = base = 0
    for keys, doc, pos, ids, check in parts:
        held.append((keys, doc.astype(np.int32) + np.int32(base), pos.astype(np.uint32), ids, np.zeros(0, dtype=np.uint32) if check is None else check))
        count, base = count + len(keys), base + len(ids)
        if count >= DEAL:
            yield deal(*map(np.concatenate, zip(*held, strict=True)), buckets, **how)
            held, count, base = [], 0, 0
    if count:
        yield deal(*map(np.concatenate, zip(*held, strict=True)), buckets, **how)


def gathered(blobs) -> dict[str, np.ndarray]:
    """All records of a bucket: key, check, doc (a place in ids), pos, more, done, and the table ids."""
    cols: dict[str, list] = {"key": [], "check": [], "doc": [], "pos": [], "more": [], "done": [], "ids": []}
    at = 0
    for x in map(unpack, blobs):
        doc, pos = places(x)
        n, done = len(pos), "done" in x
        key = x["low"].astype(_U) | x["high"].astype(_U) << _U(32) | x["bucket"].astype(_U) << _U(40) if "low" in x else np.zeros(n, dtype=_U)
        cols["key"].append(key)
        cols["check"].append(x.get("check", np.zeros(n, dtype=np.uint32)))
        cols["doc"].append(doc.astype(np.int32) + np.int32(at))
        cols["pos"].append(pos.astype(np.uint32))
        cols["more"].append(np.ones(n, dtype=bool) if done else np.unpackbits(x["more"], count=n).astype(bool))
        cols["done"].append(np.full(n, done))
        cols["ids"].append(names(x))
        at += len(x["id"])
    return {k: np.concatenate(v) for k, v in cols.items()}


def repeated(r: dict[str, np.ndarray]) -> np.ndarray:
    """Which records have a key that another record has too."""
    order = np.flatnonzero(~r["done"])  # those may lie between two others of their key
    order = order[np.lexsort((r["check"][order], r["key"][order])) if r["check"].any() else np.argsort(r["key"][order])]
    same = ~differ(r["key"][order], r["check"][order])
    out = np.zeros(len(r["key"]), dtype=bool)
    out[order[same]] = True
    out[order[:-1][same[1:]]] = True
    return out | r["more"]


def not_least(r: dict[str, np.ndarray]) -> np.ndarray:
    """Which records have a key that a smaller id has too."""
    out = r["done"].copy()
    at = np.flatnonzero(~out)
    owner = r["ids"]["id"][r["doc"][at]]
    order = np.lexsort((owner, r["check"][at], r["key"][at]))
    new = differ(r["key"][at][order], r["check"][at][order])
    if len(order):
        out[at[order]] = owner[order] > owner[order][new][np.cumsum(new) - 1]
    return out


#: What is known of a document's hits: its id and text hash, and packed places in it.
HITS = "k long, h long, hits binary"
#: How hits travel from the buckets of keys to those of documents.
SLOTS = "slot int, blob binary"


def as_slots(r: dict[str, np.ndarray], hit: np.ndarray, slots: int):
    """The records under `hit` dealt by document, as rows of SLOTS, as pandas: one row a slot, not one a document."""
    import pandas as pd

    doc, ids = in_order(r["doc"][hit], r["ids"])
    slot = (mix(ids["id"].astype(_U) ^ mix(ids["h"].astype(_U))) % _U(slots)).astype(np.int64)
    pos = r["pos"][hit].astype(np.int64)
    order = np.lexsort((pos, doc, slot[doc]))
    doc, pos = doc[order], pos[order]
    of = slot[doc]
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, dtype=np.int64)
    out = []
    for a, b in zip(at, [*at[1:], len(of)], strict=False):
        used, n, step = steps(doc[a:b], pos[a:b])
        out.append(pack(**named(ids[used]), n=n, step=step))
    return pd.DataFrame({"slot": of[at].astype(np.int32), "blob": out})


def by_document(slots: DataFrame) -> DataFrame:
    """(k, h, hits), one row a document, from rows of SLOTS."""

    def one(pdf):
        import pandas as pd

        tables, docs, pos, base = [], [], [], 0
        for x in map(unpack, pdf["blob"]):
            doc, p = places(x)
            tables.append(names(x))
            docs.append(doc + base)
            pos.append(p)
            base += len(tables[-1])
        table = np.concatenate(tables)
        order = np.lexsort((table["h"], table["id"]))
        new = differ(table["id"][order], table["h"][order])
        place = np.empty(len(table), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        docs, at = table[order][new], np.sort(place[np.concatenate(docs)] << 32 | np.concatenate(pos))
        pos, lim = at.astype(np.uint32), np.searchsorted(at >> 32, np.arange(len(docs) + 1))
        return pd.DataFrame({"k": docs["id"], "h": docs["h"], "hits": [pack(p=np.diff(pos[a:b], prepend=np.uint32(0))) for a, b in zip(lim[:-1], lim[1:], strict=True)]})

    return slots.groupBy("slot").applyInPandas(one, HITS)


#: In place of packed positions: every window of the document.
WHOLE = b""


def positions(hits: list[bytes] | None) -> np.ndarray:
    """Positions of packed hits; -1 alone for all there are."""
    if hits and WHOLE in hits:
        return np.array([-1])
    found = [np.cumsum(unpack(h)["p"].astype(np.int64)) for h in hits or ()]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def id_table(batch: pa.RecordBatch) -> np.ndarray:
    """The first two columns, k and h, as one structured array."""
    out = np.empty(batch.num_rows, dtype=ID)
    out["id"], out["h"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    return out


def exchange(entries: DataFrame, reduce: Callable, schema: str) -> DataFrame:
    """Groups blobs by bucket; reduce gets the records of one bucket and returns a pandas frame."""

    def one(pdf):
        try:
            return reduce(gathered(pdf["blob"]))
        finally:
            give_back()

    return entries.groupBy("bucket").applyInPandas(one, schema)


def bucket_count(spark: SparkSession, records: int, each: int = 1_000_000) -> int:
    """Buckets of about `each` records at most, and one a shuffle partition at least."""
    return max(partitions(spark), -(-records // each))


# ---- a filter on ids with a fixed size ----------------------------------------------------------

#: Bits of an id filter: 1 MB, whatever the input. A full filter lets all rows pass, so results stay right.
FILTER_BITS = 1 << 23


def marked(df: DataFrame, ids: DataFrame, column: str = "doc_id", flag: str = "_in") -> DataFrame:
    """df with `flag`: true for all rows whose id is in ids(column), and for few others.

    A bitmap of FILTER_BITS bits, in rows of 4 kB, is broadcast: 1 MB whatever the input. It is only a shortcut
    before an exact join, and keeps texts that no row of ids needs out of the shuffle.
    """
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS)) + 1  # from 1, as bitmap buckets count
    bucket, place, bits, byte = fresh(df, "bucket"), fresh(df, "place"), fresh(df, "bits"), fresh(df, "byte")
    maps = ids.select(F.bitmap_bucket_number(slot).alias(bucket), F.bitmap_bit_position(slot).alias("p")).groupBy(bucket).agg(F.bitmap_construct_agg("p").alias(bits))
    rows = df.withColumn(bucket, F.bitmap_bucket_number(slot)).withColumn(place, F.bitmap_bit_position(slot)).join(F.broadcast(maps), bucket, "left")
    held = F.conv(F.hex(F.substring(bits, F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftright({byte}, cast({place} % 8 as int)) & 1")
    return rows.withColumn(byte, held).select(*(F.col(c) for c in df.columns), (F.coalesce(bit, F.lit(0)) == 1).alias(flag))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in have:
        name = f"_{name}"
    return name


def among(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of df whose id is in ids, and few others."""
    flag = fresh(df, "in")
    return marked(df, ids, column, flag).filter(flag).drop(flag)


def apart_from(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows that among() leaves out: none of them has an id in ids."""
    flag = fresh(df, "in")
    return marked(df, ids, column, flag).filter(f"not {flag}").drop(flag)
