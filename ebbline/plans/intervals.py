"""Label points with the interval that covers them.

``latest_covering`` answers, per key, "of all intervals [lo, hi] that hold this moment,
which comes last in the given order?".  Two ways, both exact:

* A key with at most ``ARRAY_LIMIT`` intervals: they travel as one sorted array, and each
  point picks the last element that covers it.  No row is multiplied.
* A crowded key: its intervals are first turned into a step function of time (disjoint
  pieces, each with its winner), then points and steps are merged in time order and every
  point takes the step before it.  The work is m log m in the intervals and linear in the
  points; no pairs of points and intervals are formed.

The intervals per key are counted first; the second way enters the plan only if a key is
crowded.  The broadcast list of crowded keys holds at most ``intervals / ARRAY_LIMIT`` keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.plans.skew import (
    HOT_ROWS, SLICE, earlier_slices, is_sliced, keys_above, rank_in_series, slice_hot_keys,
    slice_keys, sliced_only,
)

ARRAY_LIMIT = 1000


def latest_covering(
    points: DataFrame,
    spans: DataFrame,
    *,
    key: str,
    ts: str,
    lo: str,
    hi: str,
    order: Sequence[str],
    label: str,
    known: str,
    array_limit: int = ARRAY_LIMIT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Points plus ``label`` (NULL if nothing covers) and ``known`` (the key has intervals).

    ``order`` starts with ``lo``; ``label`` is a column of ``spans``.
    """
    fields = list(dict.fromkeys([*order, hi, label]))
    spans = spans.filter(F.col(key).isNotNull()).select(key, *fields)
    crowded = keys_above(
        spans.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, array_limit
    )
    if crowded is None:
        return _pick_from_lists(points, spans, key, ts, lo, hi, fields, label, known)
    crowded = F.broadcast(crowded)
    ordinary = _pick_from_lists(
        points.join(crowded, key, "left_anti"), spans.join(crowded, key, "left_anti"),
        key, ts, lo, hi, fields, label, known,
    )
    steps = _step_function(
        spans.join(crowded, key, "left_semi"), key, lo, hi, order, label, hot_rows
    )
    merged = _take_step_before(
        points.join(crowded, key, "left_semi"), steps, key, ts, label, hot_rows
    )
    return ordinary.unionByName(merged.withColumn(known, F.lit(True)))


def _pick_from_lists(points, spans, key, ts, lo, hi, fields, label, known) -> DataFrame:
    lists = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_spans"))
    covering = F.filter("_spans", lambda s: F.col(ts).between(s[lo], s[hi]))
    return points.join(lists, key, "left").select(
        *points.columns,
        F.try_element_at(covering, F.lit(-1))[label].alias(label),
        F.col("_spans").isNotNull().alias(known),
    )


def _step_function(spans, key, lo, hi, order, label, hot_rows) -> DataFrame:
    """(key, t, at, after): the winner at each interval end t, and from there to the next end.

    Positions 2i (the moment of end i) and 2i+1 (the stretch after it) make every interval a
    range of whole positions.  A range is cut into at most two aligned blocks per power of
    two, the best interval is kept per block, and a position looks up the blocks above it.
    """
    ends = spans.select(key, F.explode(F.array(lo, hi)).alias("t")).distinct()
    ends = rank_in_series(slice_hot_keys(ends, key, "t", hot_rows), [key], [F.col("t")], "i").drop(SLICE)
    ends = ends.withColumn("i", F.col("i").cast("long") - 1)

    winner = F.struct(*order, label)
    placed = (
        spans.filter(F.col(lo) <= F.col(hi))
        .select(key, lo, hi, winner.alias("w"))
        .join(ends.select(key, F.col("t").alias(lo), (F.col("i") * 2).alias("l")), [key, lo])
        .join(ends.select(key, F.col("t").alias(hi), (F.col("i") * 2 + 1).alias("r")), [key, hi])
        .select(key, "l", "r", "w")
    )
    blocks = (
        placed.withColumn("k", F.explode(F.expr("sequence(0, cast(floor(log2(r - l)) as int))")))
        .withColumns({
            "from": F.expr("shiftright(l + shiftleft(1L, k) - 1, k)"),
            "to": F.expr("shiftright(r, k)"),
        })
        .withColumn("node", F.explode(F.expr(
            "array_compact(array("
            "  case when `from` < `to` and `from` % 2 = 1 then `from` end,"
            "  case when `from` < `to` and `to` % 2 = 1 then `to` - 1 end))"
        )))
        .groupBy(key, "k", "node")
        .agg(F.max("w").alias("w"))
    )
    tops = ends.groupBy(key).agg(F.expr("cast(floor(log2(2 * count(1))) as int)").alias("top"))
    lookups = (
        ends.join(tops, key)
        .select(key, "t", F.explode(F.array(F.col("i") * 2, F.col("i") * 2 + 1)).alias("c"), "top")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("top"))))
        .withColumn("node", F.expr("shiftright(c, k)"))
    )
    return (
        lookups.join(blocks, [key, "k", "node"], "left")
        .groupBy(key, "t")
        .agg(
            F.max(F.when(F.col("c") % 2 == 0, F.col("w")))[label].alias("at"),
            F.max(F.when(F.col("c") % 2 == 1, F.col("w")))[label].alias("after"),
        )
    )


def _take_step_before(points, steps, key, ts, label, hot_rows) -> DataFrame:
    """As-of merge: each point takes the last step at or before it."""
    columns = points.columns
    step = F.struct("t", "at", "after")
    stream = points.select(
        key, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_point")
    ).unionByName(
        steps.select(key, F.col("t").alias("_t"), F.lit(0).alias("_kind"), step.alias("_step")),
        allowMissingColumns=True,
    )
    stream = slice_hot_keys(stream, key, "_t", hot_rows)
    in_order = Window.partitionBy(*slice_keys(stream, key)).orderBy("_t", "_kind")
    seen = stream.withColumn("_seen", F.last("_step", ignorenulls=True).over(in_order))
    if is_sliced(stream):
        carried = (
            sliced_only(stream).groupBy(key, SLICE).agg(F.max("_step").alias("_last"))
            .select(key, SLICE, F.max("_last").over(earlier_slices([key])).alias("_carried"))
        )
        seen = seen.join(carried, [key, SLICE], "left").withColumn(
            "_seen", F.coalesce("_seen", "_carried")
        )
    return seen.filter("_kind = 1").select(
        "_point.*",
        F.when(F.col("_seen.t") == F.col("_t"), F.col("_seen.at"))
        .when(F.col("_t").isNotNull(), F.col("_seen.after"))
        .alias(label),
    )
