"""Substring deduplication with difference-cover anchors, on words.

Windows of WIDTH words that start in a document with a smaller id are removed; see windows.py for the
anchors. A word window is named by a hash of its words' hashes, of 72 bits and those of its bucket; the words' hashes
are keyed, by a key drawn anew for each run, so that equal names of different words can't be made on purpose.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Key, new_key, stretches, words
from .windows import Finder, covered, digest, keyed, repeated_windows, with_windows

WIDTH = 50


def _word_units(data, offs, key: Key):
    h, _, _, offs = words(data, offs, key=key)
    return partial(stretches, h), offs


def finder() -> Finder:
    """Period 31 of 6 members: anchors of 20 words at a fifth of all places."""
    return Finder(WIDTH, 5, partial(_word_units, key=new_key()), least=True)


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): the keyed rows of docs, and the places of windows that a document with a smaller id has."""
    rows = keyed(docs)
    # a word and what separates it take two bytes at least; six are usual here, and only bucket sizes depend on it
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    return rows, repeated_windows(rows, finder(), total)


def _kept(text: bytes, starts) -> tuple[int, int, bytes]:
    w = text.split()  # bytes split at exactly space and 0x09-0x0D
    if not len(starts):
        return len(w), 0, b" ".join(w)
    gone = covered(starts, WIDTH, len(w))
    return len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: each text's kept words joined by one space."""
    rows, found = repeated_passages(docs)
    return digest(with_windows(rows, found), lambda t, s: (_kept(t, s)[2].decode(),), "text string")


def removal_digest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Null texts have no words. A null id is larger than any other; rows that share an id remove nothing from
    each other. Documents of fewer words than a window keep all. Other columns are not read.
    """
    rows, found = repeated_passages(docs)

    def one(text, starts):
        n, removed, kept = _kept(text, starts)
        return n, removed, hashlib.sha256(kept).hexdigest()

    return digest(with_windows(rows, found), one, "n_words long, n_removed long, kept_sha256 string")
