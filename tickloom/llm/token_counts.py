"""Token counts of a sentencepiece BPE model, with a whole-token shortcut.

A unit is a run of blanks with the characters up to the next blank. Where no piece of the vocabulary has
a blank after another character, no merge crosses units, so a text's count is the sum over its units.
`whole_tokens` proves offline which vocabulary strings the model gives back as one token; a unit among
them counts 1. All other units are merged by the library, each distinct one once a batch.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Distinct units that a worker keeps the counts of; beyond it starts anew.
MEMO = 400_000


def splits_at_blanks(processor) -> bool:
    """Whether no piece has a blank after a non-blank, and the model neither normalises nor has user symbols.

    Then a text's tokens are those of its units, one after another.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(processor.serialized_model_proto())
    n = m.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    return plain and not any(p.type == 4 or BLANK in p.piece.lstrip(BLANK) for p in m.pieces)


def whole_tokens(processor) -> dict[str, int]:
    """Vocabulary strings after one blank that encode, alone, as exactly one token: the proof is the encoding."""
    strings = [p[1:] for p in (processor.id_to_piece(i) for i in range(processor.get_piece_size())) if p[0] == BLANK and len(p) > 1 and BLANK not in p[1:]]
    return {s: 1 for s, ids in zip(strings, processor.encode(strings, num_threads=1), strict=True) if len(ids) == 1}


@functools.cache
def _load(path: str):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return p, splits_at_blanks(p), whole_tokens(p)


def count_tokens(texts: list[str], processor, memo: dict[str, int]) -> list[int]:
    """Token counts of texts whose model splits at blanks; memo maps units (less their first blank) to counts."""
    parts = [t.replace(BLANK, " ").split(" ") if t else [] for t in texts]  # the model reads both as a blank
    out, pending = [], []
    for k, units in enumerate(parts):
        # an empty part is a blank that belongs to the next unit, or ends the text
        if "" in units:
            joined, blanks = [], 0
            for u in units:
                if u:
                    joined.append(" " * blanks + u)
                    blanks = 0
                else:
                    blanks += 1
            if blanks:
                joined.append(" " * (blanks - 1))
            parts[k] = joined
        pending.append([u for u in parts[k] if u not in memo])
    new = list(dict.fromkeys(u for p in pending for u in p))
    for u, ids in zip(new, processor.encode(new, num_threads=1) if new else [], strict=True):
        memo[u] = len(ids)
    blank = len(processor.encode(" "))  # what the model gives for "▁▁", a text of one blank
    memo[""] = 1 if blank == 1 else memo.get("", 1)
    for units in parts:
        out.append(sum(map(memo.__getitem__, units)))
    return out


#: By model; a worker process keeps it from task to task.
_memos: dict[str, dict[str, int]] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows, a null id stays null,
    other columns are not read. A model whose pieces cross blanks is counted by the library alone.
    """

    def run(batches):
        processor, apart, whole = _load(model_path)
        memo = _memos.setdefault(model_path, dict(whole))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if len(memo) > MEMO + len(whole):
                memo.clear()
                memo.update(whole)
            if apart:
                counts = count_tokens(texts, processor, memo)
            else:
                counts = [len(x) for x in processor.encode(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(counts, dtype=np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
