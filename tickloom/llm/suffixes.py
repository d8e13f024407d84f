"""Suffix-array deduplication on bytes, cut at the depth that matters.

The difference-cover suffix sort names short stretches at sampled places, recurses on the names, and merges
the other suffixes through them. Here only equality of the first WIDTH bytes of neighbours is asked, so names
are hashes of triples, recursively (a name of 3**(k+1) bytes is made of three names of 3**k), in place of
global ranks: neighbours in the order of their names are equal or not, just as in a suffix array. Sampled
places are those of a difference cover; records are dealt by name, sorted within a task and compared with
their neighbour; and only suffixes next to a repeated sample are named in full and compared in the same way.
So no ranks are made and no suffixes are merged through ranks; the passes are those of windows.py, over bytes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, stretches
from .windows import Finder, covered, digest, keyed, repeated_windows, with_windows

WIDTH = 400


def _byte_units(data, offs):
    return partial(stretches, _BYTE[data]), offs


#: Period 183 of 14 members: samples of 218 bytes at a thirteenth of all places.
FINDER = Finder(WIDTH, 13, _byte_units)


def repeated_strings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): the keyed rows of docs, and the places of strings of WIDTH bytes that also start elsewhere."""
    rows = keyed(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return rows, repeated_windows(rows, FINDER, total)


def _kept(text: bytes, starts) -> tuple[np.ndarray, bytes]:
    gone = covered(starts, WIDTH, len(text))
    return gone, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: the bytes that stay; a character that is cut in two is replaced."""
    rows, found = repeated_strings(docs)
    return digest(with_windows(rows, found), lambda t, s: (_kept(t, s)[1].decode(errors="replace"),), "text string")


def removal_digest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    Null texts count as empty; texts shorter than WIDTH keep all. Repeated rows are copies of each other, so
    both lose what they share. Ids may be null or repeated; other columns are not read.
    """
    rows, found = repeated_strings(docs)

    def one(text, starts):
        if not len(starts):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        gone, kept = _kept(text, starts)
        return len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()

    return digest(with_windows(rows, found), one, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
