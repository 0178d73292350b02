"""Token counts of whole texts by a byte-level BPE file, lengths only.

A task encodes in groups of about equal bytes; texts are split where the tokenizer's own pattern
always starts a new token, and pieces that were seen lately are not encoded again (``pieces``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import map_texts
from ebbline.llm.pieces import piece_ids


def _counter(path: str) -> Callable[[], Callable[[list[str | None]], Sequence]]:
    def make() -> Callable[[list[str | None]], Sequence]:
        work = piece_ids(path)
        width = work.kind.itemsize
        return lambda texts: ([len((t or "").encode()) for t in texts], np.asarray(pc.binary_length(work.arrays(pa.array(texts, pa.string())))) // width)

    return make


def count_tokens(
    df: DataFrame, tokenizer_path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", limit: int = 1024,
) -> DataFrame:
    """``keep`` with n_bytes, n_tokens and over_limit (n_tokens > limit), one row per input row.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows stay, each with its count.  An
    empty table gives an empty table.  A kept column named like a result gives way to it.  The
    tokenizer file must lie at the same path on every machine, as an installed package does.
    """
    counted = map_texts(df, keep, text, "n_bytes long, n_tokens long", _counter(tokenizer_path))
    kept = [c for c in counted.columns if c != "over_limit"]
    return counted.select(*kept, (F.col("n_tokens") > limit).alias("over_limit"))
