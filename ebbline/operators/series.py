"""Per-customer series: usable records, logs, standardized anomalies.

A customer's series is its records dated up to the reference date.  One aggregation
(``profile``) yields everything later steps need about a series as a whole; it combines
on the map side, so a huge customer costs one row per input task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions.columns import LOG_VOLUME
from ebbline.plans.skew import (
    HOT_ROWS, SLICE, rank_in_series, slice_hot_keys, slice_keys, spread_over_slices,
)
from ebbline.sources.warehouse import new_folder, store

KEY = "occupant_id"
CHARGE_TS, CHARGE_ID = "billing_period_end", "charge_id"
VOLUME_TS, VOLUME_ID = "meter_read_at", "charge_id"


def at(ref: str | dt.datetime):
    """A reference date as a timestamp literal without zone."""
    return F.lit(str(ref)).cast("timestamp_ntz")


def clip_history(records: DataFrame, ts: str, ref: str) -> DataFrame:
    return records.filter(F.col("occupant_id").isNotNull() & (F.col(ts) <= at(ref)))


def profile(records: DataFrame, ts: str, ref: str, volume: bool = False) -> DataFrame:
    """occupant_id, first, last, n and, for readings, mean and population spread.

    ``last`` is the newest record of all, but no later than the reference date; customers
    without a record up to that date are left out.
    """
    used, day = f"{ts} <= timestamp_ntz'{ref}'", f"timestamp_ntz'{ref}'"
    stats = [
        f"min({ts}) AS first", f"least(max({ts}), {day}) AS last", f"count_if({used}) AS n",
    ]
    if volume:
        stats += [
            f"avg(_v) FILTER (WHERE {used}) AS mean", f"stddev_pop(_v) FILTER (WHERE {used}) AS std",
            f"avg(_g) FILTER (WHERE {used}) AS log_mean",
            f"stddev_pop(_g) FILTER (WHERE {used}) AS log_std",
        ]
    known = records.filter(f"{KEY} IS NOT NULL AND {ts} IS NOT NULL")
    if volume:
        known = known.selectExpr(KEY, ts, "volume_kgals AS _v", f"{LOG_VOLUME} AS _g")
    return known.groupBy(KEY).agg(*[F.expr(e) for e in stats]).filter("n > 0")


def stored_profile(records: DataFrame, ts: str, ref: str, volume: bool = False) -> DataFrame:
    """The profile as a written table: one row per customer, read by several later steps.

    The records themselves are then read only twice, here and where they meet their segments.
    """
    stats = profile(records, ts, ref, volume)
    return store(stats, new_folder(records.sparkSession, "profile"), ts)


def both_series(charge_profile: DataFrame, volume_profile: DataFrame) -> DataFrame:
    """Customers with both charges and readings, with the counts."""
    return charge_profile.selectExpr(KEY, "n AS n_charge").join(
        volume_profile.selectExpr(KEY, "n AS n_volume"), KEY
    )


def usable_series(charge: DataFrame, volume: DataFrame, ref: str) -> DataFrame:
    """Customers with both charges and readings up to the reference date, with the counts."""
    return both_series(profile(charge, CHARGE_TS, ref), profile(volume, VOLUME_TS, ref))


def with_log_volume(volume: DataFrame) -> DataFrame:
    return volume.withColumn("vol_log", F.expr(LOG_VOLUME))


def anomaly_columns(df: DataFrame, seasonal: bool = True) -> DataFrame:
    """Anomalies of volume and log volume from the profile columns n, mean, std, log_mean, log_std.

    0 throughout for series of fewer than 3 records or without spread.  The seasonal anomaly
    needs more than 24 records and is 0 where it is undefined.
    """
    out = {}
    for x, m, sd in (("volume_kgals", "mean", "std"), ("vol_log", "log_mean", "log_std")):
        z = f"({x} - {m}) / {sd}"
        out[f"{x}_anom"] = F.expr(f"CASE WHEN n > 2 AND {sd} > 0 THEN {z} ELSE 0D END")
        if seasonal:
            out[f"{x}_manom"] = F.expr(f"CASE WHEN n > 24 AND {sd} > 0 THEN coalesce({z}, 0D) ELSE 0D END")
    return df.withColumns(out)


def _with_profile(volume: DataFrame, ref: str, hot_rows: int) -> DataFrame:
    """Readings with the profile of their customer; a huge customer is joined slice by slice."""
    series = clip_history(volume, VOLUME_TS, ref)
    stats = stored_profile(volume, VOLUME_TS, ref, volume=True)
    sliced = slice_hot_keys(series, "occupant_id", VOLUME_TS, hot_rows, stats)
    return with_log_volume(sliced).join(
        spread_over_slices(stats, sliced, "occupant_id", "first", "last"),
        slice_keys(sliced, "occupant_id"),
    )


def anomalies(
    volume: DataFrame, ref: str, seasonal: str = "global", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Readings up to the reference date with four anomaly columns.

    ``seasonal='global'``: the seasonal anomaly uses the mean and spread of the whole series,
    needs more than 24 records and is 0 where it is undefined.  ``seasonal='by_month'``: the
    mean and spread of the records at the same place in a 12-record cycle.
    """
    joined = anomaly_columns(_with_profile(volume, ref, hot_rows), seasonal == "global")
    if seasonal == "by_month":
        joined = _anomalies_by_phase(joined)
    elif seasonal != "global":
        raise ValueError(f"seasonal {seasonal!r}: expected global or by_month")
    return joined.drop("first", "last", "n", "mean", "std", "log_mean", "log_std", SLICE)


def _anomalies_by_phase(sliced: DataFrame) -> DataFrame:
    """Seasonal anomalies against the customer's records of the same phase (position mod 12)."""
    order = [F.col(VOLUME_TS), F.col(VOLUME_ID)]
    phased = rank_in_series(sliced, ["occupant_id"], order, "_pos").withColumn(
        "_phase", F.pmod(F.col("_pos") - 1, F.lit(12))
    )
    stats = phased.groupBy("occupant_id", "_phase").agg(
        F.avg("volume_kgals").alias("_m"), F.stddev_pop("volume_kgals").alias("_s"),
        F.avg("vol_log").alias("_lm"), F.stddev_pop("vol_log").alias("_ls"),
    )
    joined = phased.join(stats, ["occupant_id", "_phase"])
    z = "CASE WHEN n > 24 AND {s} > 0 THEN coalesce(({x} - {m}) / {s}, 0D) ELSE 0D END"
    return joined.withColumns({
        "volume_kgals_manom": F.expr(z.format(x="volume_kgals", m="_m", s="_s")),
        "vol_log_manom": F.expr(z.format(x="vol_log", m="_lm", s="_ls")),
    }).drop("_pos", "_phase", "_m", "_s", "_lm", "_ls")
