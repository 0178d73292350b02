"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become rows of integer terms (the components).  Similar rows are put side by side, then cut
into blocks with the least and greatest value of each term.  A query's bound on a block is the sum
over the terms of the most that the block can add; blocks are scored through their forward index (the
rows themselves) from the highest bound down, until a bound falls below the k-th score so far.

Blocks are held in shards of bounded size.  A query first meets its own shard, whose k-th score
prunes the others.  Queries travel to the shards in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import batch_rows, new_folder, store

BLOCK_ROWS = 256
SHARD_ROWS = 16_384
#: Rows, chosen by hash, that neighbours are grouped around.  Only the order depends on them, no result.
PIVOTS = 128


def codes(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 64) -> DataFrame:
    """(id, code): floor(scale * x) of each component.

    Rows with a null id, a null vector or a null or non-finite component are left out.  Of rows that
    repeat an id the one with the least code counts, so equal rows count once.
    """
    usable = f"{embedding} IS NOT NULL AND NOT exists({embedding}, x -> x IS NULL OR isnan(x) OR abs(double(x)) = double('inf'))"
    rows = vectors.filter(F.col(vec_id).isNotNull()).filter(usable)
    coded = rows.select(F.col(vec_id).cast("long").alias("id"), F.expr(f"transform({embedding}, x -> CAST(floor({scale} * double(x)) AS BIGINT))").alias("code"))
    return coded.groupBy("id").agg(F.min("code").alias("code"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to the width."""
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def pack(codes: np.ndarray) -> tuple[bytes, str]:
    """The narrowest integers that hold all values."""
    top = int(np.abs(codes).max(initial=0))
    kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"
    return codes.astype(kind).tobytes(), kind


class Shard:
    """Rows in blocks, with the range of each term."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.starts = np.arange(0, len(ids), BLOCK_ROWS)
        self.low = np.minimum.reduceat(codes, self.starts, axis=0)
        self.high = np.maximum.reduceat(codes, self.starts, axis=0)

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, ids and scores of all that may be in a query's top k, and each query's k-th score.

        ``floor``: a score below which nothing counts for the query.
        """
        most = int(np.abs(queries).max(initial=0)) * int(np.abs(self.codes).max(initial=0)) * queries.shape[1]
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64  # exact in each
        data, wanted = self.codes.astype(kind), queries.astype(kind)
        bounds = np.maximum(wanted, 0) @ self.high.astype(kind).T + np.minimum(wanted, 0) @ self.low.astype(kind).T
        order = np.argsort(-bounds, axis=1, kind="stable")
        limit, (q, d, s) = floor.copy(), (np.zeros(0, np.int64),) * 3
        alive, done, step = np.arange(len(ids)), 0, 1
        while len(alive) and done < len(self.starts):
            # each query's next blocks, as many again as before; those behind the first hopeless one are hopeless too
            block = order[alive, done : done + step]
            row, turn = np.nonzero(np.take_along_axis(bounds[alive], block, 1) >= limit[alive, None])
            found = [(q, d, s)]
            chosen, rows = block[row, turn], alive[row]
            by_block = np.argsort(chosen, kind="stable")
            for some in np.split(by_block, np.flatnonzero(np.diff(chosen[by_block])) + 1) if len(chosen) else ():
                asking, start = rows[some], int(self.starts[chosen[some[0]]])
                scores = wanted[asking] @ data[start : start + BLOCK_ROWS].T
                x, y = np.nonzero(scores >= limit[asking, None].astype(kind))
                other = self.ids[start + y] != ids[asking[x]]
                x, y = x[other], y[other]
                found.append((asking[x], self.ids[start + y], scores[x, y].astype(np.int64)))
            q, d, s = first_k(*(np.concatenate(x) for x in zip(*found)), k)
            full = np.flatnonzero(np.bincount(q, minlength=len(ids)) == k)
            limit[full] = np.maximum(limit[full], s[np.searchsorted(q, full, side="right") - 1])
            alive = alive[np.bincount(row, minlength=len(alive)) == block.shape[1]]
            done, step = done + step, done + step
        return q, d, s, limit


def first_k(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k highest scores, ties to the smaller id; sorted by query."""
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], d[top], s[top]


def top_k(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest scores, ties to the smaller id.

    All other rows are candidates; with fewer than k of them all are returned, with none the query has
    no row.  Codes of unequal length count as padded with zeros.  Empty tables give an empty one.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "blocks")
    rows = store(rows.withColumn("is_query", is_query), folder, "codes")
    width = rows.agg(F.max(F.size("code"))).first()[0] or 0
    pivots = [r["code"] for r in rows.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(PIVOTS).select("code").collect()]
    centres = np.zeros((len(pivots), width))
    for row, code in zip(centres, pivots):
        row[: len(code)] = code
    shared = spark.sparkContext.broadcast(centres / np.maximum(1e-9, np.linalg.norm(centres, axis=1, keepdims=True)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = np.argmax(matrix(batch.column(1), width) @ shared.value.T, axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=["id", "code", "is_query", "cell"])

    placed = store(rows.select("id", "code", "is_query").mapInArrow(place, "id long, code array<long>, is_query boolean, cell int"), folder, "cells")
    shards, plan = 0, {}
    room = 0
    for r in placed.groupBy("cell").count().orderBy("cell").collect():  # as many rows as pivots at most
        parts = -(-r["count"] // SHARD_ROWS)
        if parts > 1 or r["count"] > room:
            shards, room = shards + parts, SHARD_ROWS * (parts == 1)
        plan[r["cell"]] = (shards - parts, parts)
        room -= r["count"]
    where = spark.createDataFrame([(c, first, parts) for c, (first, parts) in plan.items()], "cell int, first int, parts int")
    dealt = placed.join(F.broadcast(where), "cell").withColumn(
        "shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    ).select("shard", "id", "code", "is_query", "cell")
    packed = "shard int, ids binary, codes binary, kind string, q_ids binary, q_codes binary, floors binary"

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, found = np.asarray(table["id"]), matrix(table["code"].combine_chunks(), width)
        asked = np.asarray(table["is_query"].fill_null(False))
        floors = np.full(asked.sum(), np.iinfo(np.int64).min)
        if asked.any() and width and k:
            floors = Shard(ids, found).search(ids[asked], found[asked], floors, k)[3]
        data, kind = pack(found)
        row = {"shard": table["shard"][0].as_py(), "ids": ids.tobytes(), "codes": data, "kind": kind, "q_ids": ids[asked].tobytes(), "q_codes": found[asked].astype(kind).tobytes(), "floors": floors.tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("kind", pa.string()), ("q_ids", pa.binary()), ("q_codes", pa.binary()), ("floors", pa.binary())]))

    built = store(dealt.groupBy("shard").applyInArrow(build, packed), folder, "shards")
    groups = built.filter(F.length("q_ids") > 0).select("q_ids", "q_codes", "floors", F.col("kind").alias("q_kind"))
    pairs = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards - 1, 0)))))
    joined = pairs.join(built.select("shard", "ids", "codes", "kind"), "shard").select("ids", "codes", "kind", "q_ids", "q_codes", "q_kind", "floors")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not width:
                    continue
                ids, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                shard = Shard(ids, np.frombuffer(r["codes"], r["kind"]).reshape(len(ids), width).astype(np.int64))
                queries = np.frombuffer(r["q_codes"], r["q_kind"]).reshape(len(asked), width).astype(np.int64)
                q, d, s, _ = shard.search(asked, queries, np.frombuffer(r["floors"], np.int64), k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(d), pa.array(s)], names=["query_id", "vec_id", "score"])

    with batch_rows(spark, 4):  # a row holds a shard and a group
        found = store(joined.mapInArrow(score, "query_id long, vec_id long, score long"), folder, "scores")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
