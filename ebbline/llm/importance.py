"""Importance resampling towards a target distribution, on Arrow kernels.

Features of a text are its words and pairs of neighbouring words, hashed into buckets.  A group of
texts is lower-cased, split and flattened by Arrow kernels and dictionary-encoded; two shifted rows of
dictionary indices are the pairs, and only distinct words and pairs are hashed.  The gain of a bucket
is the log ratio of its share in the target and in the source; a text's weight is the mean gain,
summed per segment.  Gumbel noise from the row's id turns the weights into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import GROUP_BYTES, byte_groups, new_folder, ship_package, store
from ebbline.llm.line_dedup import with_offsets

BUCKETS = 10_000
#: What lies between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WORDS = 20


class Features:
    """The features of a group of texts: flat buckets, grouped by text, and the words of each text."""

    def __init__(self, texts: pa.Array, buckets: int):
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
        owner = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        index, words = np.asarray(coded.indices).astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()]
        if b"" in words:  # in front of a leading separator and behind a trailing one
            real = index != words.index(b"")
            index, owner = index[real], owner[real]
        codes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        same = owner[1:] == owner[:-1]
        pairs, pair = np.unique(index[:-1][same] * len(words) + index[1:][same], return_inverse=True)
        heads = [zlib.crc32(b" ", int(c)) for c in codes]
        pair_codes = np.fromiter(
            (zlib.crc32(words[b], heads[a]) for a, b in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(words)))))), np.int64, len(pairs)
        )
        self.word_buckets, self.pair_buckets = (codes % buckets)[index], (pair_codes % buckets)[pair]
        self.n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.n_pairs = np.maximum(self.n_words - 1, 0)

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.word_buckets, minlength=buckets) + np.bincount(self.pair_buckets, minlength=buckets)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Per text the sum of its features' gains."""
        return segment_sums(gains[self.word_buckets], self.n_words) + segment_sums(gains[self.pair_buckets], self.n_pairs)


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, group_bytes: int = GROUP_BYTES) -> np.ndarray:
    """How often each bucket occurs over all texts; a task sends its sums, the driver receives one number per bucket."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in byte_groups(batch, 0, group_bytes):
                total += Features(part.column(0), buckets).counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = df.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) per bucket, each bucket counted once more than it occurs."""
    n = float(len(source))
    s_all, t_all = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """key, n_words, n_features and weight (floored mean gain; 0 without features), one row per input row."""
    ship_package(df.sparkSession)
    shared, names = df.sparkSession.sparkContext.broadcast(gains), [key, "n_words", "n_features", "weight"]
    source = df.select(key, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            for part in byte_groups(batch, 1, group_bytes):
                found = Features(part.column(1), len(gains))
                n = found.n_words + found.n_pairs
                weight = found.sums(gains) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.n_words), pa.array(n), pa.array(weight)], names=names)

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """key, n_words, n_features, weight, score and rank (null: not drawn), one row per document.

    ``share`` per cent (floored) of the documents with at least ``least_words`` words are drawn: those
    of highest score, ties to the smaller key.  score is the weight plus Gumbel noise that depends on
    seed and key alone.

    A null or empty text has no features, weight 0, and is not drawn.  A null key counts as an empty
    one in the noise and comes last among equal scores.  Repeated rows each have their rank.  With an
    empty target all documents still have weights; an empty table gives an empty one.

    The drawn rows are numbered in ranges of the order, so no task holds them all.  The histogram of
    scores on the driver is bounded: weights lie between the least and the greatest gain and the noise
    has 2^32 values within 26 units, so there are some 100,000 whole scores at most.
    """
    folder = new_folder(docs.sparkSession, "importance")
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, gains, key, text).withColumns({"score": F.col("weight") + noise, "tie": F.monotonically_increasing_id()})
    scored = store(scored, folder, "scored")
    fit = F.col("n_words") >= least_words
    histogram = sorted(((r["score"], r["n"]) for r in scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted, found, lowest = share * sum(n for _, n in histogram) // 100, 0, None
    for value, n in histogram:
        if found >= wanted:
            break
        lowest, found = value, found + n
    columns = [key, "n_words", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = fit & (F.col("score") >= lowest)
    order = {"o1": -F.col("score"), "o2": F.col(key).isNull(), "one": F.lit(1)}
    numbered = with_offsets(scored.filter(near).withColumns(order), ["o1", "o2", key, "tie"], "one", folder, "ranked")
    place = F.col("offset") + 1
    drawn = numbered.select(*columns, F.when(place <= wanted, place).alias("rank"))
    return drawn.unionByName(scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
