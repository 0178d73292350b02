"""Segments between service cutoffs, and sample windows counted back from their ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.columns import whole_mean_months
from ebbline.operators.series import at
from ebbline.plans.skew import (
    HOT_ROWS, SLICE, earlier_slices, is_sliced, rank_in_series, slice_hot_keys, slice_keys,
    sliced_only, spread_over_slices,
)

KEY = "occupant_id"
MONTH = "INTERVAL 1 MONTH"  # a calendar step: keeps the time of day, clamps to the month end


def ranked_cutoffs(cutoffs: DataFrame, ref: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cutoffs up to the reference date: rank among the customer's (0-based) and the one before."""
    past = cutoffs.filter(F.col(KEY).isNotNull() & (F.col("cutoff_at") <= at(ref))).select(
        KEY, "id", "cutoff_at"
    )
    sliced = slice_hot_keys(past, KEY, "cutoff_at", hot_rows)
    order = [F.col("cutoff_at"), F.col("id")]
    within = Window.partitionBy(*slice_keys(sliced, KEY)).orderBy(*order)
    ranked = rank_in_series(sliced, [KEY], order, "rank").withColumn(
        "previous", F.lag("cutoff_at").over(within)
    )
    if is_sliced(sliced):
        newest = (
            sliced_only(sliced).groupBy(KEY, SLICE).agg(F.max("cutoff_at").alias("_c"))
            .select(KEY, SLICE, F.max("_c").over(earlier_slices([KEY])).alias("_carried"))
        )
        ranked = ranked.join(newest, [KEY, SLICE], "left").withColumn(
            "previous", F.coalesce("previous", "_carried")
        )
    return ranked.select(KEY, "cutoff_at", (F.col("rank") - 1).cast("int").alias("rank"), "previous")


def cutoff_segments(bounds: DataFrame, ranked: DataFrame) -> DataFrame:
    """One interval [lo, hi] per cutoff that falls after the first record and no later than a
    month after the last one.

    It starts with the series, or a month after the cutoff before, and ends at the cutoff.
    Label 2.  ``n_cut_prior`` counts all earlier cutoffs, ``segment`` only those inside the
    series.  Two cutoffs less than a month apart give an empty interval that keeps its number.
    """
    placed = ranked.join(bounds.select(KEY, "first", "last"), KEY)
    early = placed.groupBy(KEY).agg(F.expr("int(count_if(cutoff_at <= first)) AS _early"))
    return (
        placed.filter(f"cutoff_at > first AND cutoff_at <= last + {MONTH}")
        .join(early, KEY)
        .selectExpr(
            KEY,
            "rank - _early AS segment",
            f"CASE WHEN previous > first THEN previous + {MONTH} ELSE first END AS lo",
            "cutoff_at AS hi",
            "2 AS label",
            "rank AS n_cut_prior",
        )
    )


def tail_segments(bounds: DataFrame, ranked: DataFrame, keep_tail: bool = False) -> DataFrame:
    """The stretch after the last cutoff inside the series, up to a month after its last record.

    It exists only if a later cutoff follows (label 1).  ``keep_tail`` also keeps it without
    a later cutoff (label 0).
    """
    inside = f"cutoff_at > first AND cutoff_at <= last + {MONTH}"
    per = (
        ranked.join(bounds.select(KEY, "first", "last"), KEY)
        .groupBy(KEY, "first", "last")
        .agg(
            F.expr(f"int(count_if({inside})) AS segment"),
            F.expr(f"max(CASE WHEN {inside} THEN cutoff_at END) AS _newest"),
            F.expr(f"int(count_if(cutoff_at <= last + {MONTH})) AS n_cut_prior"),
            F.expr(f"int(count_if(cutoff_at > last + {MONTH}) > 0) AS label"),
        )
        .selectExpr(
            KEY, "segment", f"coalesce(_newest + {MONTH}, first) AS lo", f"last + {MONTH} AS hi",
            "label", "n_cut_prior",
        )
    )
    return per.filter("lo < hi" if keep_tail else "lo < hi AND label = 1")


def single_segments(bounds: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The whole series of each customer without any cutoff row, of whatever date."""
    ever = cutoffs.filter(F.col(KEY).isNotNull()).select(KEY).distinct()
    return bounds.join(ever, KEY, "left_anti").selectExpr(
        KEY, "0 AS segment", "first AS lo", "last AS hi", "0 AS label", "0 AS n_cut_prior"
    )


def all_segments(
    bounds: DataFrame, cutoffs: DataFrame, ranked: DataFrame, keep_tail: bool = False
) -> DataFrame:
    """Segments of one series; ``ranked`` is ``ranked_cutoffs`` of the same cutoffs."""
    return (
        cutoff_segments(bounds, ranked)
        .unionByName(tail_segments(bounds, ranked, keep_tail))
        .unionByName(single_segments(bounds, cutoffs))
    )


def pair_segments(charge_segments: DataFrame, volume_segments: DataFrame) -> DataFrame:
    """Segments of both series paired by number; label and prior count come from the charges."""
    v = volume_segments.select(KEY, "segment", F.col("lo").alias("v_lo"), F.col("hi").alias("v_hi"))
    return charge_segments.join(v, [KEY, "segment"]).select(
        KEY, "segment", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"),
        "v_lo", "v_hi", "label", "n_cut_prior",
    )


def records_in_segments(sliced: DataFrame, segments: DataFrame, ts: str, ref: str) -> DataFrame:
    """Sliced records joined with the segment that holds them.

    Empty intervals are dropped first; those left are a month apart, so a customer has at most
    12 per year, and they are disjoint, so a record meets one of them.
    """
    open_ = segments.filter(F.col("lo") <= F.col("hi"))
    spread = spread_over_slices(open_, sliced, KEY, "lo", "hi")
    return (
        sliced.filter(F.col(ts) <= at(ref))
        .join(spread, slice_keys(sliced, KEY))
        .filter(F.col(ts).between(F.col("lo"), F.col("hi")))
        .drop("lo", "hi")
    )


def number_windows(
    in_segments: DataFrame, ts: str, record_id: str, n_samples: Sequence[int]
) -> DataFrame:
    """Add ``n_samples`` and ``window``: 0 for the newest n records of a segment, then backwards.

    All lengths come from one ordering.  Incomplete windows are still in; whoever aggregates
    keeps those with n records.
    """
    order = [F.col(ts).desc(), F.col(record_id).desc()]
    ranked = rank_in_series(in_segments, [KEY, "segment"], order, "_rn", newest_first=True)
    return (
        ranked.withColumn("n_samples", each_length(n_samples))
        .withColumn("window", F.expr("cast((_rn - 1) div n_samples as int)"))
        .drop("_rn")
    )


def each_length(n_samples: Sequence[int]) -> Column:
    return F.expr(f"explode(array({', '.join(str(int(n)) for n in n_samples)}))")


def window_label(label, window):
    """Window 0 carries the segment's label; older ones of a cutoff customer carry 1."""
    return F.when((window == 0) | (label == 0), label).otherwise(F.lit(1))


def future_labels(cutoffs: DataFrame, ref: str, n_samples: int) -> DataFrame:
    """Customers cut off after the reference date: 2 if within n months, else 1."""
    ahead = cutoffs.filter(F.col(KEY).isNotNull() & (F.col("cutoff_at") > at(ref)))
    months = whole_mean_months(at(ref), F.col("_c"))
    return ahead.groupBy(KEY).agg(F.min("cutoff_at").alias("_c")).select(
        KEY, F.when(months <= n_samples, 2).otherwise(1).alias("label")
    )


def prior_cutoffs(cutoffs: DataFrame, ref: str) -> DataFrame:
    """Cutoffs up to the reference date per customer that has any cutoff."""
    return cutoffs.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count_if(F.col("cutoff_at") <= at(ref)).cast("int").alias("nCutPrior")
    )


def sliced_series(records: DataFrame, ts: str, counts: DataFrame, hot_rows: int, tie: str | None = None) -> DataFrame:
    return slice_hot_keys(records.filter(F.col(KEY).isNotNull()), KEY, ts, hot_rows, counts, tie)
