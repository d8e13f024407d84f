"""Sentencepiece BPE encoding and decoding by vectorised merge rounds.

A text becomes units (a run of blanks and what follows up to the next blank), each distinct unit of a batch is merged
once. Symbols of all units lie in flat arrays. A round finds the best-ranked pair of each word by a segmented minimum,
merges its occurrences from the left at once, and closes the gaps; words without a pair leave. The library is not
called: the model file gives the pieces and their scores alone.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sparing

BLANK = "▁"
#: Characters of text that a worker merges at once; a longer text is taken whole.
AT_ONCE = 1 << 20
#: Ids of one text that are written out for a digest at once.
DIGITS_AT_ONCE = 1 << 16
_NONE = np.int32(2**31 - 1)
_UNK, _CONTROL, _USER, _BYTE = 2, 3, 4, 6  # fixed values: types of pieces in a model file


class Table:
    """A static map from pairs of whole numbers under 2**31 to int32 values, looked up by arrays; -1 where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, values: np.ndarray):
        keys, first = np.unique(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), return_index=True)
        values = values[first].astype(np.int32)
        self.bits = max(10, int(len(keys)).bit_length() + 4)
        self.levels = []
        seed = 0x9E3779B97F4A7C15
        while True:  # what shares a slot goes on to the next level, under another multiplier
            at = self._slot(keys, np.uint64(seed))
            _, one = np.unique(at, return_index=True)
            slots, kept = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, -1, dtype=np.int32)
            slots[at[one]], kept[at[one]] = keys[one], values[one]
            self.levels.append((np.uint64(seed), slots, kept))
            rest = np.ones(len(keys), dtype=bool)
            rest[one] = False
            if not rest.any():
                break
            keys, values, seed = keys[rest], values[rest], seed * 0xD6E8FEB86659FD93 % (1 << 64) | 1

    def _slot(self, keys: np.ndarray, seed: np.uint64) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * seed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int32)
        for seed, slots, values in self.levels:
            at = self._slot(keys, seed)
            np.copyto(out, values[at], where=slots[at] == keys)
        return out


class Model:
    """The pieces of a model file, as arrays. Symbols are pieces by id, then characters that only pieces hold."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        if t.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that change no characters are encoded here")
        if any(p.type in (_USER, 5) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not encoded here")
        self.prefix = n.add_dummy_prefix
        self.size = len(m.pieces)
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in normal)
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == _UNK)
        self.byte = np.full(256, -1, dtype=np.int32)
        for i, p in enumerate(m.pieces):
            if p.type == _BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
        self.fallback = bool(t.byte_fallback)
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, self.size + len(symbols))
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        # ranks by score, best first; equal scores share a rank
        scores = np.array([p.score for p in m.pieces], dtype=np.float32)
        order = np.unique(-scores)
        rank = np.searchsorted(order, -scores).astype(np.int32)
        self.rank = np.append(rank, _NONE)
        pairs = [(symbols[p[:k]], symbols[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        left, right, out = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.pairs = Table(left, right, out)
        # One at a time: pieces whose merge can bring up a better pair, or whose rank another piece has too.
        self.single = np.bincount(rank, minlength=len(order))[self.rank[: self.size]] > 1
        for side in (left, right):
            known = side < self.size
            early = known & (self.rank[out] <= self.rank[np.where(known, side, 0)])
            self.single[side[early]] = True
        near = {(a, b) for p in normal for a, b in zip(p, p[1:], strict=False)}
        a, b = (np.array([ord(x[k]) for x in near], dtype=np.int64) for k in (0, 1))
        self.near = Table(a, b, np.zeros(len(a)))
        # bytes that an id stands for, a blank as a space
        surface = [b"" if p.type == _CONTROL else (t.unk_surface.encode() if p.type == _UNK else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(BLANK, " ").encode()) for p in m.pieces]
        self.is_byte = np.array([p.type == _BYTE for p in m.pieces])
        self.starts_blank = np.array([p.type == 1 and p.piece[:1] == BLANK for p in m.pieces])
        self.control = np.array([p.type == _CONTROL for p in m.pieces])
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.ends = np.cumsum([len(s) for s in surface])
        self.lengths = np.array([len(s) for s in surface], dtype=np.int64)

    # ---- encoding ------------------------------------------------------------------------------

    def merged(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first character of each) of words of code points that begin at `starts`; -1 for unknown characters."""
        n = len(points)
        word = np.zeros(n, dtype=np.int64)
        word[starts] = 1
        word[1:] |= self.near(points[:-1], points[1:]) < 0  # no piece holds both characters: nothing merges across
        word = np.cumsum(word)
        sym, at = self.char[points], np.arange(n, dtype=np.int64)
        done_sym, done_at = [], []

        def pair(i: np.ndarray) -> np.ndarray:
            """The piece that the symbols at i and i + 1 make, or -1."""
            a, b = sym[i], sym[i + 1]
            out = self.pairs(np.maximum(a, 0), np.maximum(b, 0))
            out[(word[i] != word[i + 1]) | (a < 0) | (b < 0)] = -1
            return out

        made = np.append(pair(np.arange(n - 1)), np.int32(-1)) if n else np.zeros(0, dtype=np.int32)
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            rank = self.rank[made]  # -1 reads the last entry, which is worst
            best = np.minimum.reduceat(rank, first)
            if (best == _NONE).any():  # words that are done leave
                stay = np.repeat(best != _NONE, size)
                done_sym.append(sym[~stay])
                done_at.append(at[~stay])
                sym, at, word, made, rank = sym[stay], at[stay], word[stay], made[stay], rank[stay]
                keep = best != _NONE
                best, size = best[keep], size[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            new = word[hit]
            lead = np.append(True, new[1:] != new[:-1])
            run = np.append(True, hit[1:] != hit[:-1] + 1) | lead
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(lead | ~self.single[made[hit]]) & (place % 2 == 0)]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # where they lie once the gaps are closed
            sym, at, word, made = sym[keep], at[keep], word[keep], made[keep]
            for i in (hit, hit[hit > 0] - 1):
                last = i == len(sym) - 1
                made[i[last]] = -1
                made[i[~last]] = pair(i[~last])
        if not done_sym:
            return sym, at
        sym, at = np.concatenate(done_sym), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return sym[order], at[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        whole = [(BLANK if self.prefix else "") + t.replace(" ", BLANK) if t else "" for t in texts]
        doc = np.cumsum([0, *map(len, whole)])
        points = np.frombuffer("".join(whole).encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        begins = np.zeros(len(points), dtype=bool)
        if self.apart:
            blank = points == ord(BLANK)
            begins[1:] = blank[1:] & ~blank[:-1]
        begins[doc[:-1][doc[:-1] < doc[1:]]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(points)) * 4
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(points)]).dictionary_encode()
        distinct = units.dictionary
        limits = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        points = np.frombuffer(distinct.buffers()[2], dtype=np.uint32)[limits[0] // 4 : limits[-1] // 4]
        limits = (limits - limits[0]) // 4
        sym, at = self.merged(points.astype(np.int64), limits[:-1])
        ids, count = self._ids(sym, points[at])
        # ids of the distinct units, then of every unit in turn
        per = np.add.reduceat(count, np.searchsorted(at, limits[:-1])) if len(count) else np.zeros(0, dtype=np.int64)
        begin = np.cumsum(per) - per
        unit = units.indices.to_numpy()
        out = ids[spread(begin[unit], per[unit])]
        total = np.append(0, np.cumsum(per[unit]))
        return out, total[np.searchsorted(starts, doc)]

    def _ids(self, sym: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, and how many each has: characters that are no piece stand as their bytes."""
        alien = (sym < 0) | (sym >= self.size)
        count = np.ones(len(sym), dtype=np.int64)
        if not self.fallback:
            return np.where(alien, self.unk, sym).astype(np.int32), count
        p = points[alien].astype(np.int64)
        more = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
        count[alien] = more
        out = np.repeat(np.where(alien, -1, sym), count)
        raw = np.frombuffer("".join(map(chr, p)).encode(), dtype=np.uint8)
        out[out < 0] = self.byte[raw]
        return out.astype(np.int32), count

    # ---- decoding ------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts that the ids between offsets stand for. Bytes that are no UTF-8 become U+FFFD, one each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id lies outside the vocabulary")
        size = self.lengths[ids]
        data = self.surface[spread((self.ends - self.lengths)[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))
        control = self.control[ids]
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            # the first piece with a text loses the blank that encoding put before it
            lead = next((i for i in range(a, b) if not control[i]), b)
            skip = int(self.prefix and lead < b and self.starts_blank[ids[lead]])
            raw = data[ends[a] + skip : ends[b]]
            try:
                text = None if control[a:b].any() else raw.decode()
            except UnicodeDecodeError:
                text = None
            out.append(self._mended(ids[a:b], data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], skip) if text is None else text)
        return out

    def _mended(self, ids: np.ndarray, data: bytes, ends: np.ndarray, skip: int) -> str:
        """Runs of byte pieces are read by themselves: a character never joins bytes of different runs, not even of
        runs that only a control id parts."""
        flag = self.is_byte[ids]
        edges = np.flatnonzero(np.append(True, flag[1:] != flag[:-1]))
        parts = []
        for a, b in zip(edges, [*edges[1:], len(ids)], strict=True):
            raw = data[ends[a] : ends[b]]
            parts.append(_by_character(raw) if flag[a] else raw.decode())
        return "".join(parts)[skip:]


def _by_character(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that begins no character."""
    out, at = [], 0
    while at < len(raw):
        b = raw[at]
        n = 1 if b < 0x80 else 2 if 0xC0 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF8 else 0
        try:
            out.append(raw[at : at + n].decode() if n else "�")
            at += max(n, 1)
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1], and so on."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - count), count)


@functools.cache
def load(path: str) -> Model:
    """The model of a worker process, read once."""
    return Model(path)


def portions(sizes: np.ndarray, most: int):
    """(from, to) of slices whose sizes sum up to `most`; a larger item is a slice of its own."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per input row.

    A null or empty text has no ids. Repeated rows give repeated rows, a null id stays null, other columns are not
    read. The same ids as the library's encode(), without begin and end.
    """

    def run(batches):
        model = load(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(np.array([len(t) for t in texts], dtype=np.int64), AT_ONCE):
                ids, offsets = model.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sparing(run), "doc_id long, ids array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and n + 1 offsets of a list column; null counts as empty."""
    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]] if len(offsets) else values[:0], offsets - offsets[:1]


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text), one row per input row, as the library's decode() gives it; null ids are an empty text."""

    def run(batches):
        model = load(model_path)
        for batch in batches:
            ids, offsets = _lists(batch.column(1))
            for a, b in portions(np.diff(offsets), AT_ONCE):
                texts = model.decode(ids[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(sparing(run), "doc_id long, text string")


def digests(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the rows of encode(): digests of the decimal ids joined by
    commas, and of the text that the ids decode to."""

    def run(batches):
        model = load(model_path)
        for batch in batches:
            ids, offsets = _lists(batch.column(1))
            for a, b in portions(np.diff(offsets), AT_ONCE):
                own = offsets[a : b + 1] - offsets[a]
                part = ids[offsets[a] : offsets[b]]
                texts = model.decode(part, own)
                shas = [_decimal_sha(part[x:y]) for x, y in zip(own[:-1], own[1:], strict=True)]
                cols = [batch.column(0)[a:b], pa.array(np.diff(own)), pa.array(shas), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(sparing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decimal_sha(ids: np.ndarray) -> str:
    h = hashlib.sha256()
    for a in range(0, len(ids), DIGITS_AT_ONCE):
        h.update((("," if a else "") + ",".join(map(str, ids[a : a + DIGITS_AT_ONCE].tolist()))).encode())
    return h.hexdigest()
