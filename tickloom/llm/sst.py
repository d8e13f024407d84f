"""Token shards as sorted string tables.

A shard is: data blocks, an index, a Bloom filter, a footer.
  data block  zstd of entries in key order: varint shared, varint unshared, varint value bytes, key suffix, value.
              The first entry of every RESTART shares nothing with the one before it.
  index       for each block: first key, offset, stored bytes, plain bytes, entries (a sparse index)
  bloom       BLOOM_BITS bits a key, BLOOM_HASHES probes
  footer      fixed size: offsets and sizes of index and bloom, entries, tokens, id width, magic
A key is 0x00 for a null id, or 0x01 and the id as 8 big-endian bytes with the sign bit flipped, so byte
order is id order. A value is the ids as little-endian unsigned integers of 2 or 4 bytes.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, shared_dir, sparing

MAGIC = b"TLSST001"
FOOTER = struct.Struct("<QQQQQQI8s")
INDEX = struct.Struct("<9sQIII")
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 16, 10, 7
#: A writer starts the next file at this size, so that a reader holds no more in memory.
SHARD_BYTES = 16 << 20
#: Distinct units that a worker keeps the ids of.
MEMO = 300_000
#: Characters of a longer one, which is not kept.
LONG_UNIT = 256


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes entries in key order and gives the parts of the file as they become complete."""

    def __init__(self, width: int):
        self.width, self.at, self.n, self.tokens = width, 0, 0, 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._begin()

    def _begin(self):
        self.block, self.first, self.last, self.in_block = bytearray(), b"", b"", 0

    def add(self, key: bytes, value: bytes) -> bytes:
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.first = self.first or key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.keys.append(key)
        self.n += 1
        self.tokens += len(value) // self.width
        return self.flush() if len(self.block) >= BLOCK_BYTES else b""

    def flush(self) -> bytes:
        if not self.in_block:
            return b""
        z = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
        self.index.append(INDEX.pack(self.first, self.at, len(z), len(self.block), self.in_block))
        self.at += len(z)
        self._begin()
        return z

    def finish(self) -> bytes:
        tail = self.flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * self.n)
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = self.at
        return tail + index + bytes(bloom) + FOOTER.pack(at, len(index), at + len(index), bits, self.n, self.tokens, self.width, MAGIC)


class ShardReader:
    """Lookups and scans in one shard."""

    def __init__(self, content: bytes):
        if content[-8:] != MAGIC:
            raise ValueError("not a token shard")
        at, size, bloom, self.bits, self.n, self.tokens, self.width, _ = FOOTER.unpack(content[-FOOTER.size :])
        self.content, self.index = content, [INDEX.unpack_from(content, at + i) for i in range(0, size, INDEX.size)]
        self.bloom = content[bloom : len(content) - FOOTER.size]

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, plain, _ = self.index[k]
        b, at, key = pa.decompress(self.content[at : at + size], decompressed_size=plain, codec="zstd", asbytes=True), 0, b""
        while at < len(b):
            shared, at = _read_varint(b, at)
            own, at = _read_varint(b, at)
            n, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + own]
            yield key, b[at + own : at + own + n]
            at += own + n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._block(k):
                yield id_of(key), np.frombuffer(value, dtype=f"<u{self.width}")

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.bits))

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (the first of several with its id), or None: Bloom filter, then binary search."""
        key = key_of(doc_id)
        if not self.index or not self.may_hold(doc_id):
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:  # blocks whose first key is below the key come before it
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0].rstrip(b"\x00") < key.rstrip(b"\x00") else (lo, mid)
        for k in range(max(0, lo - 1), min(lo + 1, len(self.index))):
            for found, value in self._block(k):
                if found == key:
                    return np.frombuffer(value, dtype=f"<u{self.width}")
        return None


# ---- encoding ----------------------------------------------------------------------------------


#: Latin letters and ASCII marks, which every version of Unicode takes for letters and for neither letters,
#: digits nor blanks.
_LETTERS, _MARKS, _BLANKS = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u024F", r"!-/:-@\[-`{-~", r" \t\n\r"
#: What a byte-level pre-tokenizer cuts a text into that has no other characters, and what those others are.
_TOKENS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
_OTHER = re.compile(rf"[^{_LETTERS}0-9{_MARKS}{_BLANKS}]")
#: Units of the texts that have them: a single blank and what follows it.
_UNITS = re.compile(r" [^ ]+|[^ ]+")


@functools.cache
def _tokenizer(path: str):
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    # in a byte-level vocabulary each character of a token stands for one byte
    lengths = np.zeros(t.get_vocab_size(), dtype=np.int64)
    for token, i in t.get_vocab().items():
        lengths[i] = len(token)
    how = json.loads(t.to_str())
    cuts = how["normalizer"] is None and how["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return t, [a.content for a in t.get_added_tokens_decoder().values()], 2 if t.get_vocab_size() <= 65536 else 4, lengths, cuts


#: By tokenizer; a worker process keeps it from task to task.
_memos: dict[str, dict[str, bytes]] = {}


def _cut(t, keys: list[str], lengths: np.ndarray, dtype: str) -> Iterator[bytes]:
    """Ids of each key of keys that stay apart in one text: it is encoded at once and cut by the tokens' bytes."""
    ids = np.array(t.encode_batch_fast(["".join(keys)], add_special_tokens=False)[0].ids, dtype=dtype)
    ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum([len(k.encode()) for k in keys])) + 1
    raw, at = ids.tobytes(), 0
    for end in (ends * ids.itemsize).tolist():
        yield raw[at:end]
        at = end


def encode(texts: list[str], path: str, memo: dict[str, bytes]) -> list[bytes]:
    """Ids of whole texts as packed little-endian integers, as the library gives them without added specials.

    Merges never cross what the byte-level pre-tokenizer cuts a text into, so each such piece is encoded once and
    remembered. Texts with characters other than Latin letters, digits, ASCII marks and blanks are cut at single blanks
    alone, which it never joins characters over; of these, those with other blanks, and all texts with special strings,
    go whole to the library.
    """
    t, specials, width, lengths, cuts = _tokenizer(path)
    dtype = f"<u{width}"
    parts: list[list] = []  # of each text, the ids of its pieces
    # pieces that are not remembered, their places and how many a text has: flat lists, as Python's collector visits tuples
    missed, places, counts = [], [], []
    for text in texts:
        if any(s in text for s in specials):
            keys = [text]
        elif cuts and not _OTHER.search(text):
            keys = _TOKENS.findall(text)
        else:
            keys = [text] if "  " in text or text.endswith(" ") else _UNITS.findall(text)
        found = list(map(memo.get, keys))
        at = -1
        for _ in range(n := found.count(None)):
            at = found.index(None, at + 1)
            places.append(at)
            missed.append(keys[at])
        parts.append(found)
        counts.append(n)
    new = list(dict.fromkeys(missed))
    fresh: dict[str, bytes] = {}
    after_blank = [k for k in new if k[0] == " " and k.count(" ") == 1 and not k.isspace() and not any(s in k for s in specials)]
    words = [k for k in new if k.isalpha()]  # a line feed before each keeps them apart
    for a in range(0, len(after_blank), 2000):
        some = after_blank[a : a + 2000]
        fresh |= zip(some, _cut(t, some, lengths, dtype), strict=True)
    for a in range(0, len(words), 2000):
        some = words[a : a + 2000]
        fresh |= zip(some, list(_cut(t, [x for k in some for x in ("\n", k)], lengths, dtype))[1::2], strict=True)
    rest = [k for k in new if k not in fresh]
    for k, e in zip(rest, t.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        fresh[k] = np.array(e.ids, dtype=dtype).tobytes()
    holes = zip(places, missed, strict=True)
    for found, n in zip(parts, counts, strict=True):
        for at, k in islice(holes, n):
            found[at] = fresh[k]
    if len(memo) < MEMO:  # what comes first is what comes often; later finds are kept for their batch alone
        memo.update((k, v) for k, v in fresh.items() if len(k) <= LONG_UNIT)
    return list(map(b"".join, parts))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token shards in ascending id order below path; returns (shard, n_docs, n_tokens), one row a file.

    Rows are dealt by ranges of the id, each task sorts its range and streams it to files of at most about
    SHARD_BYTES. Names follow from range and place, and a file appears by a rename when it is complete, so a
    task that runs again writes the same files. Null texts count as empty; null ids come first; rows with the
    same id are all kept, in order of their text; other columns are not written.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    folder = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)  # an empty table writes no file

    def run(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        width = _tokenizer(tokenizer)[2]
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        part, memo, made, writer = TaskContext.get().partitionId(), _memos.setdefault(tokenizer, {}), [], None

        def close():
            out.write(writer.finish())
            out.close()
            name = f"{root}/{part:07d}-{len(made):05d}.sst"
            store.move(temp, name)
            made.append((f"{part:07d}-{len(made):05d}", writer.n, writer.tokens))

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                for i, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist(), tokenizer, memo), strict=True):
                    if writer is None:
                        writer, temp = ShardWriter(width), f"{root}/_{uuid.uuid4().hex}"
                        out = store.open_output_stream(temp)
                    out.write(writer.add(key_of(i), ids + end))
                    if writer.at >= SHARD_BYTES:
                        close()
                        writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    return materialize(parts.mapInArrow(sparing(run), "shard string, n_docs long, n_tokens long"))


def read_shards(spark, path: str) -> DataFrame:
    """(shard, place, doc_id, ids) of all shards below path, ids as the array of token ids."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(ShardReader(content.as_py()))
                for a in range(0, len(found), 1000):
                    some = found[a : a + 1000]
                    flat = np.concatenate([x[1] for x in some]).astype(np.int32)
                    offs = np.cumsum([0, *(len(x[1]) for x in some)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(a, a + len(some)), pa.int64()), pa.array([x[0] for x in some], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["shard", "place", "doc_id", "ids"])

    return _files(spark, path).mapInArrow(sparing(run), "shard string, place long, doc_id long, ids array<int>")


def _files(spark, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.sst").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.sst$", 1).alias("shard"), "content")


def digests(spark, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the shards below path."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, sizes, crc = [], [], []
                for i, x in ShardReader(content.as_py()):
                    ids.append(i)
                    sizes.append(len(x))
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                sizes = np.array(sizes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    per_doc = _files(spark, path).mapInArrow(sparing(run), "shard string, doc_id long, before long, n_tokens long, ids_crc32 long")
    # one row a shard meets in one task here: some dozen bytes for each SHARD_BYTES of the corpus
    bases = manifest.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("base"))
    return per_doc.join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes shards (see write_shards) to path or a new shared folder and returns their digests."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    return digests(spark, path, write_shards(docs, path, tokenizer, end_id))
