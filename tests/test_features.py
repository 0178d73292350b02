import random

import pytest
from pyspark.sql import functions as F

from ebbline.catalog.fixtures import PREDICT_REF, TRAIN_REF
from ebbline.operators import features, segments, series
from ebbline.plans.skew import SLICE, is_sliced, rank_in_series, slice_hot_keys
from ebbline.schemas import FEATURE_COLUMNS, IMPUTED_STATS, STATS

from .conftest import frame, rows

CUT = "occupant_id string, id bigint, cutoff_at ts"
BOUNDS = "occupant_id string, first ts, last ts"
REF = "2000-12-31"


def segs(spark, first, last, cutoffs, ref=REF, keep_tail=False, hot_rows=10**6):
    bounds = frame(spark, [("a", first, last)], BOUNDS)
    cuts = frame(spark, [("a", i, c) for i, c in enumerate(cutoffs)], CUT)
    ranked = segments.ranked_cutoffs(cuts, ref, hot_rows)
    out = segments.all_segments(bounds, cuts, ranked, keep_tail)
    return [(r[1], str(r[2])[:10], str(r[3])[:10], r[4], r[5]) for r in rows(out, "segment")]


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_cutoff_segments(spark, hot_rows):
    # the first is on the first record (excluded), then one inside, then one in the month after the end
    got = segs(spark, "2000-01-10", "2000-06-10", ["2000-01-10", "2000-03-05", "2000-07-10"], hot_rows=hot_rows)
    assert got == [
        (0, "2000-01-10", "2000-03-05", 2, 1), (1, "2000-04-05", "2000-07-10", 2, 2),
    ]


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_equal_cutoffs_give_an_empty_segment_that_counts(spark, hot_rows):
    got = segs(spark, "2000-01-10", "2000-06-10", ["2000-03-05", "2000-03-05", "2000-06-01"], hot_rows=hot_rows)
    assert got == [
        (0, "2000-01-10", "2000-03-05", 2, 0), (1, "2000-04-05", "2000-03-05", 2, 1),
        (2, "2000-04-05", "2000-06-01", 2, 2),
    ]


def test_tail_only_before_a_later_cutoff(spark):
    with_later = segs(spark, "2000-01-10", "2000-06-10", ["2000-03-05", "2000-09-01"])
    assert with_later[1:] == [(1, "2000-04-05", "2000-07-10", 1, 1)]
    assert len(segs(spark, "2000-01-10", "2000-06-10", ["2000-03-05"])) == 1
    kept = segs(spark, "2000-01-10", "2000-06-10", ["2000-03-05"], keep_tail=True)
    assert kept[1:] == [(1, "2000-04-05", "2000-07-10", 0, 1)]


def test_customer_with_only_later_cutoffs_has_no_segment(spark):
    assert segs(spark, "2000-01-10", "2000-06-10", ["2001-03-05"]) == []
    assert segs(spark, "2000-01-10", "2000-06-10", []) == [(0, "2000-01-10", "2000-06-10", 0, 0)]


def months(n):
    return [f"{1998 + i // 12}-{1 + i % 12:02d}-15" for i in range(n)]


def small_tables(spark, n_charge, n_volume, cutoffs=()):
    charge = frame(spark, [("a", ts, i, i % 2, float(i), 0.0) for i, ts in enumerate(months(n_charge))],
                   "occupant_id string, billing_period_end ts, charge_id bigint, late int, total_charge double, late_charge double")
    volume = frame(spark, [("a", ts, i, float(i)) for i, ts in enumerate(months(n_volume))],
                   "occupant_id string, meter_read_at ts, charge_id bigint, volume_kgals double")
    return charge, volume, frame(spark, [("a", i, c) for i, c in enumerate(cutoffs)], CUT)


@pytest.mark.parametrize("n_charge, n_volume, windows", [(3, 9, 0), (4, 4, 1), (7, 20, 1), (8, 9, 2), (12, 7, 1)])
def test_number_of_windows(spark, n_charge, n_volume, windows):
    charge, volume, cuts = small_tables(spark, n_charge, n_volume)
    c = features.full_windows(features.charge_windows(charge, cuts, REF, [4]), features.charge_aggregates())
    v = features.full_windows(features.volume_windows(volume, cuts, REF, [4]), features.usage_aggregates())
    assert c.join(v, features.WINDOW_KEY).count() == windows


def test_grace_month_belongs_to_no_segment_and_labels(spark):
    charge, volume, cuts = small_tables(spark, 20, 20, ["1998-09-20"])
    numbered = features.charge_windows(charge, cuts, "1999-08-31", [4])
    ids = sorted(r[0] for r in numbered.select("charge_id").collect())
    assert ids == list(range(9))  # up to the cutoff; nothing after it, no later cutoff follows
    windows = features.full_windows(numbered, [F.first("label").alias("l")]).withColumn(
        "label", segments.window_label(F.col("l"), F.col("window"))
    )
    assert [(r["window"], r["label"]) for r in windows.orderBy("window").collect()] == [(0, 2), (1, 1)]


@pytest.mark.parametrize("values, want", [
    ([1.0, 2.0], [0.0, 0.0]),                 # too short
    ([3.0, 3.0, 3.0, None], [0.0, 0.0, 0.0, 0.0]),  # no spread
    ([1.0, 2.0, 3.0, None], [-1.224745, 0.0, 1.224745, None]),
])
def test_z_scores(spark, values, want):
    volume = frame(spark, [("a", ts, i, v) for i, (ts, v) in enumerate(zip(months(9), values))],
                   "occupant_id string, meter_read_at ts, charge_id bigint, volume_kgals double")
    got = rows(series.anomalies(volume, REF).select("charge_id", "volume_kgals_anom"), "charge_id")
    assert [None if g is None else round(g, 6) for _, g in got] == want


@pytest.mark.parametrize("n, zero", [(24, True), (25, False)])
def test_seasonal_scores_need_25_records(spark, n, zero):
    _, volume, _ = small_tables(spark, 1, n)
    got = series.anomalies(volume, REF).agg(F.max(F.abs("volume_kgals_manom"))).first()[0]
    assert (got == 0) is zero


def test_constant_window_has_no_skew_and_a_gap_has_none(spark):
    _, volume, cuts = small_tables(spark, 1, 8)
    flat = volume.withColumn("volume_kgals", F.when(F.col("charge_id") < 4, 7.1)
                             .when(F.col("charge_id") != 6, F.col("volume_kgals")))
    got = features.full_windows(features.volume_windows(flat, cuts, REF, [4]), features.usage_aggregates())
    assert [r["skew_vol"] for r in got.orderBy("window").collect()] == [None, 0.0]


@pytest.mark.parametrize("mode, ref", [("train", TRAIN_REF), ("predict", PREDICT_REF)])
@pytest.mark.parametrize("seasonal", ["global", "by_month"])
def test_hot_customers_give_the_same_features(spark, clean_stage, mode, ref, seasonal):
    def table(hot_rows):
        df = features.feature_tables(clean_stage, ref, mode, [4, 6], seasonal=seasonal, hot_rows=hot_rows)
        return rows(df.select("n_samples", *[F.round(c, 8) if c in STATS else F.col(c) for c in FEATURE_COLUMNS]),
                    "n_samples", "occupant_id", "segment", "window")

    plain = table(10**6)
    assert plain and table(10) == plain


def test_feature_properties(spark, clean_stage):
    df = features.feature_tables(clean_stage, TRAIN_REF, n_samples=[4, 12]).cache()
    assert df.columns == ["n_samples", *FEATURE_COLUMNS] and len(FEATURE_COLUMNS) == 38
    fractions = [c for c in STATS if c.startswith("f_")]
    assert df.filter(" or ".join(f"{c} < 0 or {c} > 1" for c in fractions)).count() == 0
    assert df.filter("f_anom5_vol > f_anom4_vol or f_anom4_vol > f_anom3_vol").count() == 0
    keys = ["n_samples", "occupant_id", "segment", "window"]
    assert df.select(keys).distinct().count() == df.count()


def test_row_order_of_the_input_does_not_matter(spark, clean_stage):
    shuffled = {k: v.orderBy(F.rand(7)).repartition(3) for k, v in clean_stage.items()}
    key = ["occupant_id", "segment", "window"]

    def table(t):
        return rows(features.feature_table(t, TRAIN_REF).select(
            *[F.round(c, 8) if c in STATS else F.col(c) for c in FEATURE_COLUMNS]), *key)

    assert table(shuffled) == table(clean_stage)


def stats_frame(spark, data):
    """(occupant, location, segment, window, label, value): value goes into every statistic."""
    df = spark.createDataFrame(data, "occupant_id string, location_id bigint, segment int, window int, cutoff_strict int, v double")
    return df.withColumn("cutoff", F.col("cutoff_strict")).withColumns({c: F.col("v") for c in IMPUTED_STATS}).drop("v")


def test_imputed_value_goes_to_all_rows_of_the_customer(spark):
    df = stats_frame(spark, [
        ("a", 1, 0, 0, 1, None), ("a", 1, 0, 1, 0, 5.0), ("b", 2, 0, 0, 1, 9.0), ("c", 3, 0, 0, 0, None),
    ])
    got = {(r["occupant_id"], r["window"]): r["f_late"] for r in features.impute_cutoff_stats(df).collect()}
    assert got == {("a", 0): 9.0, ("a", 1): 9.0, ("b", 0): 9.0, ("c", 0): None}
    kept = {r["occupant_id"] for r in features.complete_features(df).collect()}
    assert kept == {"a", "b"}


def test_imputation_without_donors_changes_nothing(spark):
    df = stats_frame(spark, [("a", 1, 0, 0, 1, None), ("b", 2, 0, 0, 0, 1.0)])
    assert features.impute_cutoff_stats(df).filter("f_late is null").count() == 1


def test_rank_over_slices_equals_plain_rank(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("aab"), f"2000-01-{rnd.randrange(1, 20):02d} {rnd.randrange(24):02d}:00:00", i) for i in range(300)]
    df = frame(spark, data, "k string, t ts, i bigint")
    for newest in (False, True):
        order = [F.col("t").desc(), F.col("i").desc()] if newest else [F.col("t"), F.col("i")]
        hot = slice_hot_keys(df, "k", "t", 120)
        assert is_sliced(hot) and hot.select(SLICE).distinct().count() > 10
        got = rank_in_series(hot, ["k"], order, newest_first=newest).select("i", "rn")
        want = rank_in_series(df, ["k"], order, newest_first=newest).select("i", "rn")
        assert rows(got, "i") == rows(want, "i")


@pytest.mark.parametrize("moments", [1, 2, 50])
def test_a_hot_day_is_cut_too(spark, moments):
    """One customer, one date: its rows fall into many slices, and the order over them stays the same."""
    rnd = random.Random(moments)
    data = [("a", f"2000-01-05 0{m % 10}:{m:02d}:00", rnd.choice([i, i // 40, None])) for i in range(400) for m in [rnd.randrange(moments)]]
    data += [("a", None, i) for i in range(100)] + [("b", "2000-01-05 00:00:00", 1)]
    df = frame(spark, data, "k string, t ts, i bigint").withColumn("n", F.monotonically_increasing_id())
    df = df.cache()
    hot = slice_hot_keys(df, "k", "t", 50, tie="i")
    sizes = [r["count"] for r in hot.filter("k = 'a'").groupBy(SLICE).count().collect()]
    assert len(sizes) >= 5 and sum(sizes) == 500 and max(sizes) < 300
    for newest in (False, True):
        order = [F.col("t").desc(), F.col("i").desc(), F.col("n").desc()] if newest else [F.col("t"), F.col("i"), F.col("n")]
        got = rank_in_series(hot, ["k"], order, newest_first=newest).select("k", "t", "i", "rn")
        want = rank_in_series(df, ["k"], order, newest_first=newest).select("k", "t", "i", "rn")
        assert rows(got, "k", "rn") == rows(want, "k", "rn")
    plain = slice_hot_keys(df, "k", "t", 50)  # without a number, rows of one moment stay together
    assert plain.filter("k = 'a'").groupBy("t").agg(F.count_distinct(SLICE).alias("n")).filter("n > 1").count() == 0


def test_a_series_that_is_too_short_is_reported(spark):
    """Windows of two: readings fill windows 0 to 2 of the first segment, charges 0 and half of 1; the second segment is even."""
    def numbered(counts):
        data = [(o, s, 2, w) for (o, s, w), n in counts.items() for _ in range(n)]
        return spark.createDataFrame(data, "occupant_id string, segment int, n_samples int, window int")

    charges = numbered({("a", 0, 0): 2, ("a", 0, 1): 1, ("a", 1, 0): 2, ("b", 0, 0): 1})
    readings = numbered({("a", 0, 0): 2, ("a", 0, 1): 2, ("a", 0, 2): 2, ("a", 1, 0): 2, ("b", 0, 0): 1})
    got = rows(features.short_series_report(charges, readings), "series", "window")
    assert got == [("charge", "a", 0, 1, 2, 1), ("charge", "a", 0, 2, 2, 0)]


def test_no_python_and_no_nested_loops_in_plans(spark, clean_stage):
    for df in (
        features.feature_tables(clean_stage, TRAIN_REF, n_samples=[4, 6]),
        features.feature_tables(clean_stage, PREDICT_REF, "predict", [6]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan
