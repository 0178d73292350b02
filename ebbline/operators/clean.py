"""Cleaning: occupancy labels, monthly alignment, outliers, gaps, late flag."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.columns import assemble_date, late_flag, month_of, null_for_nan, occupant_key
from ebbline.plans.intervals import ARRAY_LIMIT, latest_covering
from ebbline.plans.skew import (
    HOT_ROWS, SLICE, earlier_slices, first_per_key, is_sliced, rank_in_series, slice_hot_keys,
    slice_keys, sliced_only, spread_over_slices, UNDATED,
)
from ebbline.schemas import CHARGE_DATA, VOLUME_DATA

# Open ends of an occupancy.
FIRST_DAY = "1800-01-01"
LAST_DAY = "2099-12-31"

Tables = dict[str, DataFrame]
Stage = Callable[[DataFrame, str], DataFrame]


def dedupe_occupants(occupant: DataFrame) -> DataFrame:
    """Drop the open rows of an occupant listed more than once at a location.

    If all rows of such an occupant are open, all go.  Rows without a key go too.  The open
    rows that stay are alone in their group, so an aggregate returns them whole and no
    group is brought together in one task.
    """
    keys = ["location_id", "cis_occupant_id"]
    rest = [c for c in occupant.columns if c not in keys]
    keyed = occupant.filter(" and ".join(f"{k} is not null" for k in keys))
    lone_open = (
        keyed.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count("move_out_date").alias("_closed"),
            *[F.max(c).alias(c) for c in rest],
        )
        .filter("_n = 1 and _closed = 0")
        .select(*occupant.columns)
    )
    return keyed.filter(F.col("move_out_date").isNotNull()).unionByName(lone_open)


def fill_occupancy_dates(occupant: DataFrame) -> DataFrame:
    return occupant.withColumns({
        "move_in_date": F.coalesce("move_in_date", F.lit(FIRST_DAY).cast("timestamp_ntz")),
        "move_out_date": F.coalesce("move_out_date", F.lit(LAST_DAY).cast("timestamp_ntz")),
    })


def parse_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without zone; text that is no date raises, as it should."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def with_occupant_key(df: DataFrame) -> DataFrame:
    return df.withColumn("occupant_id", occupant_key(F.col("location_id"), F.col("cis_occupant_id")))


def label_records(
    records: DataFrame,
    occupant: DataFrame,
    ts: str,
    *,
    array_limit: int = ARRAY_LIMIT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give each charge or reading the occupant living there at ``ts`` (both ends included).

    Overlapping occupancies: the later one wins, by move-in, occupant number, move-out.
    A location without any occupant row gets the occupant 0.  Otherwise NULL.
    """
    labelled = latest_covering(
        records, occupant,
        key="location_id", ts=ts, lo="move_in_date", hi="move_out_date",
        order=["move_in_date", "cis_occupant_id", "move_out_date"], label="occupant_id",
        known="_known", array_limit=array_limit, hot_rows=hot_rows,
    )
    fallback = F.when(
        ~F.col("_known") & F.col(ts).isNotNull(), occupant_key(F.col("location_id"), F.lit(0))
    )
    return labelled.withColumn("occupant_id", F.coalesce("occupant_id", fallback)).drop("_known")


def geocode(location: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of the first gazetteer entry for the address without its last 5 characters."""
    entries = first_per_key(
        gazetteer.select("address_key", "latitude", "longitude"),
        ["address_key"], [F.col("latitude"), F.col("longitude")],
    )
    address_key = F.substring(
        F.col("meter_address"), F.lit(1), F.greatest(F.lit(0), F.length("meter_address") - 5)
    )
    return (
        location.withColumn("address_key", address_key)
        .join(entries, "address_key", "left")
        .drop("address_key")
    )


def _address_key() -> Column:
    return F.substring(F.col("meter_address"), F.lit(1), F.greatest(F.lit(0), F.length("meter_address") - 5))


def _normal(text: str) -> Column:
    """Upper case, with one space for whatever is no letter or digit."""
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "))


def geocode_best(location: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of the best gazetteer entry, as a service gives them, and ``geocode_step``.

    Step 0: the entry of the same text; 1: of the same text but for case and punctuation; 2: one
    letter apart from that (inserted, deleted or replaced); none: NULL.  Ties go to the first entry
    in text order.  Candidates of step 2 share a text that is left when one letter is taken out, or
    the text itself, so an address meets its near entries alone; each distinct address is looked up once.
    """
    entries = first_per_key(
        gazetteer.select("address_key", "latitude", "longitude"), ["address_key"], [F.col("latitude"), F.col("longitude")]
    ).withColumn("normal", _normal("address_key"))
    asked = location.select(_address_key().alias("asked")).filter("asked IS NOT NULL").distinct()
    exact = asked.join(entries.withColumnRenamed("address_key", "entry"), F.col("asked") == F.col("entry")).select(
        "asked", "entry", "latitude", "longitude", F.lit(0).alias("step"))
    rest = asked.join(exact.select("asked"), "asked", "left_anti").withColumn("normal", _normal("asked")).filter("normal <> ''")
    parts = F.expr("""explode(array_distinct(concat(array(normal), transform(sequence(1, length(normal)),
        i -> concat(substring(normal, 1, i - 1), substring(normal, i + 1))))))""")
    near = rest.select("asked", F.col("normal").alias("own"), parts.alias("part")).join(
        entries.filter("normal <> ''").select(F.col("address_key").alias("entry"), "latitude", "longitude", "normal", parts.alias("part")), "part")
    apart = F.levenshtein("own", "normal", 1)
    near = near.withColumn("step", F.when(apart == 0, 1).when(apart == 1, 2)).filter("step IS NOT NULL")
    found = exact.unionByName(near.select("asked", "entry", "latitude", "longitude", "step"))
    best = first_per_key(found, ["asked"], [F.col("step"), F.col("entry")])
    return location.withColumn("asked", _address_key()).join(
        best.select("asked", "latitude", "longitude", F.col("step").alias("geocode_step")), "asked", "left").drop("asked")


def align_monthly(
    records: DataFrame,
    ts: str,
    data_columns: Sequence[str],
    mode: str = "pad",
    dedupe: bool = True,
    key: str = "occupant_id",
) -> DataFrame:
    """One row per month from the first to the last month of each series.

    The first record of a month stands for it.  ``pad``: a gap month repeats the month before
    with its data columns emptied, on the same day of the month (clamped).  ``sum`` and
    ``mean``: numeric columns are aggregated; a gap month has no data and falls on day 1; a
    missing value sums to 0.  ``dedupe=False`` aggregates all records of a month.  A series
    with one month is dated to the first of it and keeps its values.

    The records shrink to one row per customer and month before anything is ordered, so a
    series has at most 12 rows per year when the window runs over it.
    """
    if mode not in ("pad", "sum", "mean"):
        raise ValueError(f"align mode {mode!r}: expected pad, sum or mean")
    numeric = {"double", "float", "int", "bigint", "smallint"}
    kinds = dict(records.dtypes)
    others = [c for c in records.columns if c not in (key, ts)]
    source = records.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(
        "_m", month_of(F.col(ts))
    )
    if mode != "pad":
        others = [c for c in others if kinds[c] in numeric]
    if dedupe or mode == "pad":
        # Records of one moment are told apart by their other columns.
        source = first_per_key(source, [key, "_m"], [F.col(ts), *[F.col(c) for c in others]])
    if mode == "pad":
        monthly = source.select(key, "_m", F.dayofmonth(ts).alias("_day"), *others)
    else:
        how: Callable[[str], Column] = {
            "sum": lambda c: F.coalesce(F.sum(c), F.lit(0).cast(kinds[c])),
            "mean": lambda c: F.avg(c) if kinds[c] in ("double", "float") else F.max(c),
        }[mode]
        monthly = source.groupBy(key, "_m").agg(
            F.avg(F.dayofmonth(ts)).cast("int").alias("_day"),
            *[how(c).alias(c) for c in others],
        )

    series = Window.partitionBy(key)
    span = monthly.withColumns({
        "_next": F.lead("_m").over(series.orderBy("_m")),
        "_months": F.count(F.lit(1)).over(series),
    })
    rows = span.withColumn(
        "_month",
        F.explode(F.sequence(
            F.col("_m"),
            F.coalesce(F.add_months("_next", -1), F.col("_m")),
            F.make_ym_interval(F.lit(0), F.lit(1)),
        )),
    )
    gap = F.col("_month") != F.col("_m")

    def value(c: str) -> Column:
        if c in data_columns:
            return F.when(~gap, F.col(c)).alias(c)
        if mode == "pad":
            return F.col(c)
        return F.when(gap, F.lit(0)).otherwise(F.col(c)).cast(kinds[c]).alias(c)

    carried_day = F.col("_day") if mode == "pad" else F.when(gap, F.lit(1)).otherwise(F.col("_day"))
    day = F.when(F.col("_months") == 1, F.lit(1)).otherwise(carried_day)
    dated = rows.select(
        key,
        assemble_date(F.year("_month"), F.month("_month"), day).alias(ts),
        *[value(c) for c in others],
    )
    return dated.withColumns({
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts),
    })


def align_tables(charge: DataFrame, volume: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Monthly padding of both series, with the data columns of each table."""
    return (
        align_monthly(charge, "billing_period_end", CHARGE_DATA),
        align_monthly(volume, "meter_read_at", VOLUME_DATA),
    )


def null_invalid(volume: DataFrame) -> DataFrame:
    return volume.withColumns({
        "volume_kgals": F.when(F.col("volume_kgals") >= 0, F.col("volume_kgals")),
        "location_id": F.when(F.col("location_id") > 0, F.col("location_id")),
        "meter_id": F.when(F.col("meter_id") > 0, F.col("meter_id")),
    })


def _with_unlabelled(work: Callable[[DataFrame], DataFrame], volume: DataFrame) -> DataFrame:
    """Readings without an occupant pass unchanged: they are no series, only leftovers."""
    done = work(volume.filter(F.col("occupant_id").isNotNull()))
    return done.unionByName(volume.filter(F.col("occupant_id").isNull()))


def _spread(volume: DataFrame) -> DataFrame:
    return volume.groupBy("occupant_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("volume_kgals").alias("_mean"),
        F.stddev_samp("volume_kgals").alias("_std"),
    )


def _drop_outliers(labelled: DataFrame, spread: DataFrame, limit: float) -> DataFrame:
    ends = spread.select(
        "occupant_id", "_mean", "_std",
        F.lit(UNDATED).cast("timestamp_ntz").alias("_lo"),
        F.lit(LAST_DAY).cast("timestamp_ntz").alias("_hi"),
    )
    known = spread_over_slices(ends, labelled, "occupant_id", "_lo", "_hi").drop("_lo", "_hi")
    z = F.when(F.col("_std") > 0, (F.col("volume_kgals") - F.col("_mean")) / F.col("_std"))
    kept = F.when(~F.coalesce(z > limit, F.lit(False)), F.col("volume_kgals"))
    return labelled.join(known, slice_keys(labelled, "occupant_id"), "left").select(*[
        kept.alias(c) if c == "volume_kgals" else F.col(c) for c in labelled.columns
    ])


def null_outliers(volume: DataFrame, limit: float = 5.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Empty readings more than ``limit`` sample deviations above their customer's mean."""
    def work(labelled: DataFrame) -> DataFrame:
        spread = _spread(labelled)
        sliced = slice_hot_keys(labelled, "occupant_id", "meter_read_at", hot_rows, spread, tie="charge_id")
        return _drop_outliers(sliced, spread, limit).drop(SLICE)

    return _with_unlabelled(work, volume)


def _interpolate(sliced: DataFrame) -> DataFrame:
    carried_ids = ["location_id", "meter_id"]
    order = [F.col("meter_read_at"), F.col("charge_id")]
    ranked = rank_in_series(sliced, ["occupant_id"], order, "_pos")
    values = [*carried_ids, "volume_kgals"]

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct("_pos", F.col(c).alias("v")))

    in_slice = Window.partitionBy(*slice_keys(ranked, "occupant_id")).orderBy(*order)
    upto = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    onward = in_slice.rowsBetween(0, Window.unboundedFollowing)
    seen = ranked.withColumns({
        **{f"_prev_{c}": F.last(known(c), ignorenulls=True).over(upto) for c in values},
        **{f"_next_{c}": F.first(known(c), ignorenulls=True).over(onward) for c in values},
    })
    if is_sliced(ranked):
        per_slice = sliced_only(ranked).groupBy("occupant_id", SLICE).agg(
            *[F.max(known(c)).alias(f"_last_{c}") for c in values],
            *[F.min(known(c)).alias(f"_first_{c}") for c in values],
        )
        before = earlier_slices(["occupant_id"])
        after = earlier_slices(["occupant_id"], newest_first=True)
        carried = per_slice.select(
            "occupant_id", SLICE,
            *[F.max(f"_last_{c}").over(before).alias(f"_cprev_{c}") for c in values],
            *[F.min(f"_first_{c}").over(after).alias(f"_cnext_{c}") for c in values],
        )
        seen = seen.join(carried, ["occupant_id", SLICE], "left").withColumns({
            **{f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_cprev_{c}") for c in values},
            **{f"_next_{c}": F.coalesce(f"_next_{c}", f"_cnext_{c}") for c in values},
        })

    def prev(c: str) -> Column:
        return F.col(f"_prev_{c}")

    def next_(c: str) -> Column:
        return F.col(f"_next_{c}")

    p, q = prev("volume_kgals"), next_("volume_kgals")
    weight = (F.col("_pos") - p["_pos"]) / (q["_pos"] - p["_pos"])
    linear = (
        F.when(F.col("volume_kgals").isNotNull(), F.col("volume_kgals"))
        .when(q.isNull(), p["v"])
        .when(p.isNotNull(), p["v"] + (q["v"] - p["v"]) * weight)
    )
    return seen.select(*[
        linear.alias(c) if c == "volume_kgals"
        else F.coalesce(prev(c)["v"], next_(c)["v"]).alias(c) if c in carried_ids
        else F.col(c)
        for c in sliced.columns
    ])


def interpolate_readings(volume: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill missing readings per customer, linearly by position in date order.

    A trailing gap repeats the last reading, a leading one stays.  Ids are not numbers to
    interpolate: they take the last known value, then the next.
    """
    def work(labelled: DataFrame) -> DataFrame:
        sliced = slice_hot_keys(labelled, "occupant_id", "meter_read_at", hot_rows, tie="charge_id")
        return _interpolate(sliced).drop(SLICE)

    return _with_unlabelled(work, volume)


def zero_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0.0, subset=list(columns))


def with_late_flag(charge: DataFrame) -> DataFrame:
    return charge.withColumn("late", late_flag(F.col("late_charge")))


def clean_tables(
    raw: Tables,
    gazetteer: DataFrame,
    *,
    align: bool = False,
    outlier_limit: float = 5.0,
    stage: Stage | None = None,
    array_limit: int = ARRAY_LIMIT,
    hot_rows: int = HOT_ROWS,
) -> Tables:
    """The whole cleaning, as six lazy tables.

    ``align`` pads the series to full months first.  The labelled readings are used three
    times (spread, outliers and gaps, leftovers) and the spread per customer twice;
    ``stage(df, name)`` may write and reopen them, so that the interval join and the
    aggregation run once.  Outliers and gaps share one exchange on (customer, slice).
    """
    stage = stage or (lambda df, name: df)
    opened = {name: null_for_nan(df) for name, df in raw.items()}
    occupant = with_occupant_key(fill_occupancy_dates(parse_dates(
        dedupe_occupants(opened["occupant"]), "move_in_date", "move_out_date"
    )))
    cutoffs = with_occupant_key(parse_dates(opened["cutoffs"], "cutoff_at"))

    charge = label_records(
        parse_dates(opened["charge"], "billing_period_end"), occupant, "billing_period_end",
        array_limit=array_limit, hot_rows=hot_rows,
    )
    volume = label_records(
        parse_dates(opened["volume"], "meter_read_at"), occupant, "meter_read_at",
        array_limit=array_limit, hot_rows=hot_rows,
    )
    if align:
        calendar = ["year", "month", "day"]
        charge, volume = (t.drop(*calendar) for t in align_tables(charge, volume))
        # Gap months of a bill have no location; the customer key still holds it.
        own_location = F.regexp_extract("occupant_id", "^(-?[0-9]+)-", 1).cast("long")
        charge = charge.withColumn("location_id", F.coalesce("location_id", own_location))
    volume = stage(null_invalid(volume), "volume_labelled")

    def outliers_and_gaps(labelled: DataFrame) -> DataFrame:
        spread = stage(_spread(labelled), "volume_spread")
        sliced = slice_hot_keys(labelled, "occupant_id", "meter_read_at", hot_rows, spread, tie="charge_id")
        return _interpolate(_drop_outliers(sliced, spread, outlier_limit)).drop(SLICE)

    volume = zero_missing(_with_unlabelled(outliers_and_gaps, volume), "volume_kgals")
    charge = with_late_flag(zero_missing(charge, "total_charge", "late_charge"))
    return {
        "meter": opened["meter"],
        "location": geocode(opened["location"], gazetteer),
        "occupant": occupant,
        "volume": volume,
        "charge": charge,
        "cutoffs": cutoffs,
    }
