"""The feature table: customer data, window statistics, imputation, all window lengths at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.columns import md5_of
from ebbline.operators import segments as seg
from ebbline.operators import series
from ebbline.operators.series import CHARGE_ID, CHARGE_TS, VOLUME_ID, VOLUME_TS, at
from ebbline.plans.skew import HOT_ROWS, first_per_key, md5_rank, slice_hot_keys
from ebbline.schemas import FEATURE_COLUMNS, IMPUTED_STATS
from ebbline.sources.warehouse import new_folder, store

KEY = "occupant_id"
WINDOW_KEY = [KEY, "segment", "window", "n_samples"]
MODES = ("train", "predict")
MISSING = " OR ".join(f"{c} IS NULL" for c in IMPUTED_STATS)


# -- customers -----------------------------------------------------------------------------

def eligible_occupants(occupant: DataFrame, ref: str, mode: str = "train") -> DataFrame:
    """One row per customer (its earliest): moved in by the reference date for training, not
    moved out before it for prediction."""
    first = first_per_key(
        occupant.filter(F.col(KEY).isNotNull()), [KEY],
        [F.col("move_in_date"), F.col("move_out_date"), F.col("location_id")],
    )
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: expected one of {MODES}")
    inside = F.col("move_in_date") <= at(ref) if mode == "train" else F.col("move_out_date") >= at(ref)
    return first.filter(F.coalesce(inside, F.lit(True)))


def ever_cutoff(occupants: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``cutoff``: 1 for a customer with any cutoff row, of whatever date."""
    ever = cutoffs.filter(F.col(KEY).isNotNull()).select(KEY).distinct().withColumn("_c", F.lit(1))
    return occupants.join(ever, KEY, "left").withColumn(
        "cutoff", F.coalesce("_c", F.lit(0))
    ).drop("_c")


def customer_metadata(occupants: DataFrame, location: DataFrame, meter: DataFrame) -> DataFrame:
    """First location row and first meter of each customer.

    A default stands in only where the row is missing; a NULL inside a found row stays.
    """
    place = first_per_key(
        location.selectExpr(
            "location_id", "latitude AS _lat", "longitude AS _lon", "meter_address AS _address",
            "municipality AS _town", "true AS _place",
        ),
        ["location_id"], [F.expr("_address"), F.expr("_lat"), F.expr("_lon")],
    )
    first_meter = meter.filter("location_id IS NOT NULL").groupBy("location_id").agg(
        F.expr("min(meter_id) AS meter_id")
    )
    device = first_per_key(
        meter.selectExpr(
            "meter_id", "location_id AS _at", "cust_type AS _type", "cust_type_code AS _code",
            "meter_size AS _size", "true AS _device",
        ),
        ["meter_id"], [F.expr("_at")],
    )
    return (
        occupants.join(place, "location_id", "left")
        .join(first_meter, "location_id", "left")
        .join(device, "meter_id", "left")
        .selectExpr(
            *[f"`{c}`" for c in occupants.columns],
            "CASE WHEN _place THEN _lat ELSE 0D END AS latitude",
            "CASE WHEN _place THEN _lon ELSE 0D END AS longitude",
            "CASE WHEN _place THEN _address ELSE 'unknown' END AS meter_address",
            "CASE WHEN _place THEN _town ELSE -1 END AS municipality",
            "CASE WHEN _device THEN _type ELSE 'unknown' END AS cust_type",
            "CASE WHEN _device THEN _code ELSE -1 END AS cust_type_code",
            "CASE WHEN _device THEN _size ELSE -1D END AS meter_size",
        )
    )


# -- window statistics ---------------------------------------------------------------------

def charge_aggregates() -> list[Column]:
    return [
        F.expr("avg(late) AS f_late"),
        F.expr("avg(total_charge) AS mean_charge_tot"),
        F.expr("avg(late_charge) AS mean_charge_late"),
    ]


def usage_aggregates() -> list[Column]:
    """Mean, share of zero readings, absolute biased skewness.

    Skewness is undefined if a reading is missing, and 0 for a constant window.
    """
    return [
        F.expr("avg(volume_kgals) AS mean_vol"),
        F.expr("count_if(volume_kgals = 0) / first(n_samples) AS f_zero_vol"),
        F.expr(
            "CASE WHEN count(volume_kgals) = count(1)"
            " THEN coalesce(abs(skewness(volume_kgals)), 0D) END AS skew_vol"
        ),
    ]


def anomaly_aggregates(kind: str) -> list[Column]:
    """Share of records beyond 3, 4, 5 deviations and the largest deviation.

    ``kind`` is anom or manom.  The denominator counts the volume anomalies, for the
    logarithms too.
    """
    known = f"count(volume_kgals_{kind})"
    out: list[Column] = []
    for column, name in (("volume_kgals", "vol"), ("vol_log", "vol_log")):
        size = f"abs({column}_{kind})"
        out += [
            F.expr(f"try_divide(count_if({size} > {k}), {known}) AS f_{kind}{k}_{name}")
            for k in (3, 4, 5)
        ]
        out.append(F.expr(f"CASE WHEN {known} > 0 THEN max({size}) END AS max_{kind}_{name}"))
    return out


def volume_aggregates() -> list[Column]:
    return usage_aggregates() + anomaly_aggregates("anom") + anomaly_aggregates("manom")


def coverage_aggregates() -> list[Column]:
    return [
        F.expr("count(1) AS n_records"),
        F.expr("count(volume_kgals_anom) AS n_anom"),
        F.expr("count(volume_kgals_manom) AS n_manom"),
    ]


def full_windows(numbered: DataFrame, aggregates: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """Aggregate each (customer, segment, window, length) and keep the complete ones.

    The partial aggregation runs where the records were ordered, before the exchange.
    """
    return (
        numbered.groupBy(*WINDOW_KEY, *extra)
        .agg(F.count(F.lit(1)).alias("_n"), *aggregates)
        .filter(F.col("_n") == F.col("n_samples"))
        .drop("_n")
    )


def charge_windows(
    charge: DataFrame, cutoffs: DataFrame, ref: str, n_samples: Sequence[int],
    keep_tail: bool = False, hot_rows: int = HOT_ROWS, ranked: DataFrame | None = None,
) -> DataFrame:
    """Numbered charge records of all training windows, with segment label and prior count."""
    bounds = series.stored_profile(charge, CHARGE_TS, ref)
    if ranked is None:
        ranked = seg.ranked_cutoffs(cutoffs, ref, hot_rows)
    segments = seg.all_segments(bounds, cutoffs, ranked, keep_tail)
    sliced = seg.sliced_series(
        charge.select(KEY, CHARGE_TS, CHARGE_ID, "late", "total_charge", "late_charge"),
        CHARGE_TS, bounds, hot_rows, CHARGE_ID,
    )
    joined = seg.records_in_segments(sliced, segments, CHARGE_TS, ref)
    return seg.number_windows(joined, CHARGE_TS, CHARGE_ID, n_samples)


def volume_windows(
    volume: DataFrame, cutoffs: DataFrame, ref: str, n_samples: Sequence[int],
    keep_tail: bool = False, seasonal: str = "global", hot_rows: int = HOT_ROWS,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Numbered readings of all training windows with their anomalies.

    Anomalies are taken against the whole series up to the reference date, so a training
    window knows the spread of the months after it.
    """
    stats = series.stored_profile(volume, VOLUME_TS, ref, volume=True)
    if ranked is None:
        ranked = seg.ranked_cutoffs(cutoffs, ref, hot_rows)
    segments = seg.all_segments(stats, cutoffs, ranked, keep_tail).drop("label", "n_cut_prior")
    readings = volume.select(KEY, VOLUME_TS, VOLUME_ID, "volume_kgals")
    if seasonal == "global":
        # The profile rides on the segments: one join gives segment and anomalies.
        profile = stats.select(KEY, "n", "mean", "std", "log_mean", "log_std")
        sliced = seg.sliced_series(readings, VOLUME_TS, stats, hot_rows, VOLUME_ID)
        joined = seg.records_in_segments(sliced, segments.join(profile, KEY), VOLUME_TS, ref)
        joined = series.anomaly_columns(series.with_log_volume(joined))
    else:
        scored = series.anomalies(readings, ref, seasonal, hot_rows)
        sliced = slice_hot_keys(scored, KEY, VOLUME_TS, hot_rows)
        joined = seg.records_in_segments(sliced, segments, VOLUME_TS, ref)
    return seg.number_windows(joined, VOLUME_TS, VOLUME_ID, n_samples)


def _training_windows(charge, volume, cutoffs, ref, n_samples, keep_tail, seasonal, hot_rows):
    ranked = seg.ranked_cutoffs(cutoffs, ref, hot_rows)
    c = full_windows(
        charge_windows(charge, cutoffs, ref, n_samples, keep_tail, hot_rows, ranked),
        [*charge_aggregates(), F.first("label").alias("_label"), F.first("n_cut_prior").alias("nCutPrior")],
    )
    v = full_windows(
        volume_windows(volume, cutoffs, ref, n_samples, keep_tail, seasonal, hot_rows, ranked),
        volume_aggregates(),
    )
    return c.join(v, WINDOW_KEY).withColumn(
        "label", seg.window_label(F.col("_label"), F.col("window"))
    ).drop("_label")


def latest_records(
    records: DataFrame, ts: str, record_id: str, ref: str, n_samples: Sequence[int]
) -> DataFrame:
    """The newest n records of each series up to the reference date, for each length n.

    The ``rn <= n`` limit is applied per input task before the exchange.
    """
    newest = Window.partitionBy(KEY).orderBy(F.col(ts).desc(), F.col(record_id).desc())
    return (
        series.clip_history(records, ts, ref)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= max(n_samples))
        .withColumn("n_samples", seg.each_length(n_samples))
        .filter(F.col("_rn") <= F.col("n_samples"))
        .withColumns({"segment": F.lit(0), "window": F.lit(0)})
        .drop("_rn")
    )


def _current_windows(charge, volume, cutoffs, ref, n_samples, seasonal, hot_rows):
    lengths = seg.each_length(n_samples).alias("n_samples")
    charge_profile = series.stored_profile(charge, CHARGE_TS, ref)
    volume_profile = series.stored_profile(volume, VOLUME_TS, ref, volume=True)
    customers = series.both_series(charge_profile, volume_profile).select(
        KEY, F.lit(0).alias("segment"), F.lit(0).alias("window"), lengths
    )
    c = full_windows(latest_records(
        charge.select(KEY, CHARGE_TS, CHARGE_ID, "late", "total_charge", "late_charge"),
        CHARGE_TS, CHARGE_ID, ref, n_samples,
    ), charge_aggregates())
    readings = volume.select(KEY, VOLUME_TS, VOLUME_ID, "volume_kgals")
    if seasonal == "global":
        stats = volume_profile.drop("first", "last")
        newest = latest_records(readings, VOLUME_TS, VOLUME_ID, ref, n_samples).join(stats, KEY)
        newest = series.anomaly_columns(series.with_log_volume(newest))
    else:
        scored = series.anomalies(readings, ref, seasonal, hot_rows)
        newest = latest_records(scored, VOLUME_TS, VOLUME_ID, ref, n_samples)
    v = full_windows(newest, volume_aggregates())
    labels = None
    for n in n_samples:
        part = seg.future_labels(cutoffs, ref, n).withColumn("n_samples", F.lit(int(n)))
        labels = part if labels is None else labels.unionByName(part)
    return (
        customers.join(c, WINDOW_KEY, "left")
        .join(v, WINDOW_KEY, "left")
        .join(labels, [KEY, "n_samples"], "left")
        .withColumn("label", F.coalesce("label", F.lit(0)))
        .join(seg.prior_cutoffs(cutoffs, ref), KEY, "left")
        .withColumn("nCutPrior", F.coalesce("nCutPrior", F.lit(0)))
    )


def feature_tables(
    tables: dict[str, DataFrame],
    ref: str,
    mode: str = "train",
    n_samples: Sequence[int] = (6,),
    *,
    keep_tail: bool = False,
    seasonal: str = "global",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Feature rows for all window lengths in one job: ``n_samples`` + the 38 feature columns.

    Segments, anomalies and record order are computed once; a length only decides which
    records fall together.
    """
    charge, volume, cutoffs = tables["charge"], tables["volume"], tables["cutoffs"]
    customers = customer_metadata(
        ever_cutoff(eligible_occupants(tables["occupant"], ref, mode), cutoffs),
        tables["location"], tables["meter"],
    )
    if mode == "train":
        windows = _training_windows(
            charge, volume, cutoffs, ref, n_samples, keep_tail, seasonal, hot_rows
        )
    else:
        windows = _current_windows(charge, volume, cutoffs, ref, n_samples, seasonal, hot_rows)
    return (
        windows.join(customers, KEY)
        .withColumns({
            "cutoff_strict": F.expr("int(label = 2)"), "cut_prior": F.expr("int(nCutPrior > 0)"),
        })
        .select("n_samples", *FEATURE_COLUMNS)
    )


def feature_table(
    tables: dict[str, DataFrame], ref: str, mode: str = "train", n_samples: int = 6, **options
) -> DataFrame:
    """The 38 feature columns for one window length."""
    return feature_tables(tables, ref, mode, [n_samples], **options).drop("n_samples")


# -- missing statistics --------------------------------------------------------------------

def impute_cutoff_stats(features: DataFrame, label: str = "cutoff_strict") -> DataFrame:
    """Training: fill missing statistics of cutoff customers with the values of other cutoff rows.

    For each of the 21 columns, a customer with a missing value in a label-1 row draws one
    label-1 row that has the value, and the value is written to all rows of that customer.
    The draw is arithmetic, so it can be repeated: donors are numbered in md5 order and the
    customer takes number ``(location_id * 7919 + column number) mod donors``.
    """
    position = {c: i + 1 for i, c in enumerate(IMPUTED_STATS)}
    scope = ["n_samples"] if "n_samples" in features.columns else []
    cut = features.filter(F.col(label) == 1)

    def cells(wanted: str, value: str) -> str:
        """One row per column number for which the condition holds."""
        parts = ", ".join(
            f"CASE WHEN {wanted.format(c=c)} THEN named_struct('column', {i}, 'value', {value.format(c=c)}) END"
            for c, i in position.items()
        )
        return f"inline(array_compact(array({parts})))"

    donors = cut.selectExpr(*scope, KEY, "segment", "`window`", cells("{c} IS NOT NULL", "{c}"))
    ranked = md5_rank(
        donors, [*scope, "column"], md5_of(KEY, "segment", "window"), out="number"
    ).selectExpr(*scope, "`column`", "number - 1 AS number", "value")
    pool = donors.groupBy(*scope, "column").agg(F.expr("count(1) AS donors"))

    receivers = (
        cut.groupBy(*scope, KEY)
        .agg(
            F.expr("first(location_id) AS location_id"),
            *[F.expr(f"max({c} IS NULL) AS {c}") for c in IMPUTED_STATS],
        )
        .selectExpr(*scope, KEY, "location_id", cells("{c}", "NULL"))
        .join(F.broadcast(pool), [*scope, "column"])  # 21 rows per window length
        .withColumn("number", F.expr("pmod(location_id * 7919 + `column`, donors)"))
    )
    drawn = (
        receivers.drop("value").join(ranked, [*scope, "column", "number"])
        .groupBy(*scope, KEY)
        .agg(*[
            F.expr(f"max(CASE WHEN `column` = {i} THEN value END) AS _{c}") for c, i in position.items()
        ])
    )
    return features.join(drawn, [*scope, KEY], "left").selectExpr(*[
        f"coalesce(_{c}, {c}) AS {c}" if c in position else f"`{c}`" for c in features.columns
    ])


def drop_incomplete_occupants(features: DataFrame, label: str = "cutoff_strict") -> DataFrame:
    """Training: a customer with a missing statistic in a label-0 row loses all rows."""
    scope = ["n_samples"] if "n_samples" in features.columns else []
    bad = features.filter(f"{label} = 0 AND ({MISSING})").select(*scope, KEY).distinct()
    return features.join(bad, [*scope, KEY], "left_anti").select(*features.columns)


def zero_missing_stats(features: DataFrame) -> DataFrame:
    """Prediction: missing statistics become 0."""
    return features.fillna(0.0, subset=IMPUTED_STATS)


def choose_label(strict: bool) -> str:
    return "cutoff_strict" if strict else "cutoff"


def complete_features(features: DataFrame, mode: str = "train", strict: bool = True) -> DataFrame:
    """Imputation and removal for training, zeros for prediction.

    Cleaned series leave nothing missing in training windows.  One scan of the statistics
    tells, and spares the joins of the whole table that would change nothing.
    """
    if mode == "predict":
        return zero_missing_stats(features)
    label = choose_label(strict)
    cut, nocut = features.filter(MISSING).agg(
        F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ).first()
    if cut:
        features = impute_cutoff_stats(features, label)
    return drop_incomplete_occupants(features, label) if nocut else features


def feature_sweep(
    tables: dict[str, DataFrame], ref: str, mode: str = "train",
    n_samples: Sequence[int] = (4, 6, 8, 10, 12), strict: bool = True, **options
) -> DataFrame:
    """Completed feature tables of all window lengths, told apart by ``n_samples``.

    Completion reads the raw features several times, so they are written once.
    """
    raw = feature_tables(tables, ref, mode, n_samples, **options)
    if mode == "train":
        raw = store(raw, new_folder(raw.sparkSession, "features"), "raw")
    return complete_features(raw, mode, strict)


def coverage_report(numbered_readings: DataFrame) -> DataFrame:
    """Complete windows with fewer anomalies than records, as rows instead of printed warnings."""
    return full_windows(numbered_readings, coverage_aggregates()).filter(
        (F.col("n_anom") < F.col("n_samples")) | (F.col("n_manom") < F.col("n_samples"))
    )


def short_series_report(charges: DataFrame, readings: DataFrame) -> DataFrame:
    """series, occupant, segment, window, n_samples, n_records: windows that the other series fills and this one does not.

    Takes the numbered records of both series.  A segment should have the windows that the longer
    series fills; what each series has is counted per window first, so no record is joined.
    """
    key = [KEY, "segment", "n_samples"]
    counts = None
    for name, records in (("charge", charges), ("volume", readings)):
        part = records.groupBy(*key, "window").agg(F.count(F.lit(1)).alias("n_records")).select(F.lit(name).alias("series"), *key, "window", "n_records")
        counts = part if counts is None else counts.unionByName(part)
    full = counts.filter(F.col("n_records") == F.col("n_samples")).groupBy(*key).agg(F.max("window").alias("last"))
    expected = full.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("last").cast("int")))).withColumn(
        "series", F.explode(F.array(F.lit("charge"), F.lit("volume")))).drop("last")
    there = counts.withColumn("window", F.col("window").cast("int"))
    return expected.join(there, ["series", *key, "window"], "left").withColumn("n_records", F.coalesce("n_records", F.lit(0))).filter(
        F.col("n_records") < F.col("n_samples")).select("series", KEY, "segment", "window", "n_samples", "n_records")
