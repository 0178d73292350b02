"""Ordering inside one customer's series when that series may be a third of the data.

A plain ``Window.partitionBy(customer).orderBy(date)`` sends a whole customer to one task.
``slice_hot_keys`` counts the records per customer first (a map-side combined aggregation
over the key column).  If no customer has more than ``HOT_ROWS`` records, the plain window
is right and the plan stays as simple as that.  Otherwise these customers are cut into
calendar days ("slices"): the window runs per (customer, slice), and what earlier slices
contribute (a row count, a last value) comes from one pre-aggregated row per slice.  A day that is
itself too large is cut at quantiles of its rows' places in the order, from one sketch per customer and
day.  Rows without a date have slices of their own, which come first, as NULL does in an ascending order.

The list of hot customers is written to the shared folder, counted, and broadcast if it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.sources.warehouse import new_folder, store

HOT_ROWS = 1_000_000
SLICE = "_slice"
#: A slice is a number: the day's times PARTS, plus the part of the day.
PARTS, EPOCH = 4096, "1600-01-01"
WHOLE = -(10**15)  # the slice of a customer that is not cut
UNDATED = "0001-01-01"  # the day of a hot customer's rows without a date: before all others
#: Keys of a list that may be broadcast; beyond that the join's sides are left to adaptive execution.
BROADCAST_KEYS = 1_000_000


def whole() -> Column:
    return F.lit(WHOLE).cast("bigint")


def day_of(ts: str) -> Column:
    return F.datediff(F.coalesce(F.to_date(ts), F.lit(UNDATED).cast("date")), F.lit(EPOCH).cast("date")).cast("bigint")


def bounded(keys: DataFrame) -> DataFrame:
    """The stored key list, with a broadcast hint if it is counted to be small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keys_above(counts: DataFrame, key: str, limit: int) -> DataFrame | None:
    """The keys whose count ``n`` exceeds the limit, stored; None if there are none."""
    above = counts.filter(F.col("n") > limit).select(key)
    if above.isEmpty():
        return None
    return store(above, new_folder(above.sparkSession, "keys"), key)


def slice_hot_keys(
    df: DataFrame, key: str, ts: str, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None, tie: str | None = None
) -> DataFrame:
    """Add the slice column if any key is hot; otherwise return the rows as they are.

    ``counts`` (key, n) may be given if it is known already.  ``tie``: the number that orders rows of
    one moment; without it such rows stay together, as rows of one moment and one number do.
    """
    if counts is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = keys_above(counts, key, hot_rows)
    if hot is None:
        return df
    marked = (
        df.join(bounded(hot).withColumn("_hot", F.lit(True)), key, "left")
        .withColumn(SLICE, F.when(F.col("_hot"), day_of(ts) * PARTS).otherwise(whole()))
        .drop("_hot")
    )
    return _cut_days(marked, key, ts, hot_rows, tie)


def _cut_days(sliced: DataFrame, key: str, ts: str, hot_rows: int, tie: str | None) -> DataFrame:
    """Slices above the limit are cut at quantiles of the rows' order inside the day."""
    moment = F.coalesce(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), F.col(ts)).cast("double"), F.lit(0.0))
    number = F.col(tie).cast("double") if tie else F.lit(0.0)
    crowded = sliced_only(sliced).groupBy(key, SLICE).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("_low"), F.max(number).alias("_high")
    ).filter(F.col("n") > hot_rows)
    most = crowded.agg(F.max("n")).first()[0]
    if most is None:
        return sliced
    crowded = store(crowded.drop("n"), new_folder(sliced.sparkSession, "days"), "crowded")
    # second of the day, and behind the point the place between the day's least and greatest number
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1.0))
    place = F.floor(moment * 1000) * 4096 + F.floor(F.coalesce((number - F.col("_low")) / span, F.lit(0.0)) * 4095)
    parts = min(PARTS - 1, -(-most // hot_rows))
    cuts = F.percentile_approx("_place", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10 * parts) if parts > 1 else F.array().cast("array<double>")
    keys = [key, SLICE]
    hot = sliced_only(sliced).join(bounded(crowded), keys).withColumn("_place", place)
    sketches = store(hot.groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts"), F.first("_low").alias("_low"), F.first("_high").alias("_high")),
                     new_folder(sliced.sparkSession, "days"), "cuts")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_place"))), F.lit(0))
    placed = sliced.join(bounded(sketches), keys, "left").withColumn("_place", place)
    return placed.withColumn(SLICE, F.when(F.col("_cuts").isNull(), F.col(SLICE)).otherwise(F.col(SLICE) + part)).drop("_cuts", "_low", "_high", "_place")


def is_sliced(df: DataFrame) -> bool:
    return SLICE in df.columns


def slice_keys(df: DataFrame, *keys: str) -> list[str]:
    """What to partition or join by: the keys, and the slice where there is one."""
    return [*keys, SLICE] if is_sliced(df) else list(keys)


def sliced_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col(SLICE) != whole())


def earlier_slices(keys: Sequence[str], newest_first: bool = False):
    """Window over the per-slice rows of a key: every slice before the current one."""
    order = F.col(SLICE).desc() if newest_first else F.col(SLICE).asc()
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def rank_in_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "rn",
    newest_first: bool = False,
) -> DataFrame:
    """1-based position of each row in its series.

    ``order`` starts with the slicing timestamp, descending if ``newest_first``.
    """
    within = Window.partitionBy(*slice_keys(df, *keys)).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(within))
    if not is_sliced(df):
        return ranked
    per_slice = sliced_only(df).groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    carried = per_slice.select(
        *keys, SLICE, F.sum("_n").over(earlier_slices(keys, newest_first)).alias("_before")
    )
    return (
        ranked.join(carried, [*keys, SLICE], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_before")
    )


def spread_over_slices(
    intervals: DataFrame, records: DataFrame, key: str, lo: str, hi: str
) -> DataFrame:
    """Give each interval of a hot key the slices it overlaps, so that records can be joined
    with it by equality on (key, slice).  Nothing is multiplied for other keys."""
    if not is_sliced(records):
        return intervals
    slices = sliced_only(records).select(F.col(key).alias("_k"), F.col(SLICE).alias("_part")).distinct()
    day = F.floor(F.col("_part") / PARTS)
    def number(ts: str) -> Column:
        return F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date"))

    overlap = (F.col(key) == F.col("_k")) & (day >= number(lo)) & (day <= number(hi))
    return (
        intervals.join(slices, overlap, "left")
        .withColumn(SLICE, F.coalesce("_part", whole()))
        .drop("_k", "_part")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so a hot key
    sends one row per input task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def md5_rank(
    df: DataFrame, keys: Sequence[str], digest: Column, ties: Sequence[Column] = (), out: str = "rn"
) -> DataFrame:
    """1-based position of each row inside a large group, in order of an md5 digest.

    The digest's first four hex digits split a group evenly into 65,536 buckets.  Rows are
    numbered inside (group, bucket); the counts of the lower buckets are added.
    """
    keyed = df.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, 4)})
    sizes = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy("_digest", *ties)
    return (
        keyed.withColumn(out, F.row_number().over(within))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_digest", "_bucket", "_before")
    )
