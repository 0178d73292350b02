import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.columns import assemble_date, occupant_key, whole_mean_months
from ebbline.operators import clean

from .conftest import frame, rows

OCC = "location_id bigint, cis_occupant_id int, move_in_date ts, move_out_date ts"
CHARGE = "charge_id bigint, location_id bigint, billing_period_end ts"
VOLUME = "occupant_id string, location_id bigint, meter_id bigint, charge_id bigint, meter_read_at ts, volume_kgals double"


def test_dedupe_drops_open_rows_of_repeated_occupants(spark):
    df = frame(spark, [
        (1, 1, None, None),                      # alone and open: stays
        (1, 2, "2000-01-01", None), (1, 2, "2000-01-01", "2001-01-01"),
        (2, 1, "2000-01-01", None), (2, 1, "2001-01-01", None),  # all open: all go
        (None, 1, None, None), (3, None, None, None),
    ], OCC)
    got = [(r[0], r[1], r[3] is None) for r in rows(clean.dedupe_occupants(df), "location_id", "cis_occupant_id")]
    assert got == [(1, 1, True), (1, 2, False)]


def test_occupant_key_keeps_four_digits(spark):
    df = spark.createDataFrame([(7, 5), (7, 1234), (7, None)], "l bigint, o int")
    got = [r[0] for r in df.select(occupant_key(F.col("l"), F.col("o"))).collect()]
    assert got == ["7-005", "7-1234", None]


def labelled(spark, occ, charges, **options):
    occupants = clean.with_occupant_key(clean.fill_occupancy_dates(frame(spark, occ, OCC)))
    out = clean.label_records(frame(spark, charges, CHARGE), occupants, "billing_period_end", **options)
    return {r["charge_id"]: r["occupant_id"] for r in out.collect()}


@pytest.mark.parametrize("options", [{}, {"array_limit": 0, "hot_rows": 1}])
def test_label_both_ends_overlap_gap_and_unknown(spark, options):
    occ = [
        (1, 1, "2000-01-01", "2000-06-30"), (1, 2, "2000-06-01", "2000-12-31"),
        (1, 3, "2001-02-01", "2001-02-10 12:00:00"),
    ]
    charges = [
        (1, 1, "2000-01-01"), (2, 1, "2000-06-15"), (3, 1, "2000-12-31"), (4, 1, "2001-01-15"),
        (5, 1, None), (6, 9, "2000-01-01"), (7, 9, None), (8, 1, "2001-02-10 12:00:00"),
        (9, 1, "2001-02-10 12:00:01"), (10, 1, "1999-12-31"),
    ]
    assert labelled(spark, occ, charges, **options) == {
        1: "1-001", 2: "1-002", 3: "1-002", 4: None, 5: None, 6: "9-000", 7: None, 8: "1-003",
        9: None, 10: None,
    }


@pytest.mark.parametrize("hot_rows", [4, 10**6])
def test_crowded_location_equals_brute_force(spark, hot_rows):
    rnd = random.Random(3)

    def day(i):
        return f"2000-{1 + i // 28:02d}-{1 + i % 28:02d}"

    occ = []
    for c in range(60):
        a, b = sorted(rnd.sample(range(200), 2)) if rnd.random() < 0.9 else (50, 50)
        occ.append((rnd.choice([1, 1, 1, 2]), c, day(a), day(b)))
    charges = [(i, rnd.choice([1, 2, 3]), day(rnd.randrange(220))) for i in range(400)]
    got = labelled(spark, occ, charges, array_limit=10, hot_rows=hot_rows)
    for cid, loc, ts in charges:
        covering = [(o[2], o[1], o[3]) for o in occ if o[0] == loc and o[2] <= ts <= o[3]]
        want = f"{loc}-{max(covering)[1]:03d}" if covering else ("3-000" if loc == 3 else None)
        assert got[cid] == want


def aligned(spark, data, mode="pad", **options):
    df = frame(spark, data, "occupant_id string, ts ts, charge_id bigint, v double")
    out = clean.align_monthly(df, "ts", ["v"], mode, **options)
    return [(str(r["ts"])[:10], r["charge_id"], r["v"]) for r in out.orderBy("occupant_id", "ts").collect()]


def test_align_pad_carries_ids_and_clamps_the_day(spark):
    data = [("a", "2000-01-31 10:00:00", 1, 5.0), ("a", "2000-04-10", 2, None)]
    assert aligned(spark, data) == [
        ("2000-01-31", 1, 5.0), ("2000-02-29", 1, None), ("2000-03-31", 1, None), ("2000-04-10", 2, None),
    ]


def test_align_single_record_moves_to_the_first(spark):
    assert aligned(spark, [("a", "2000-03-17", 1, 5.0)]) == [("2000-03-01", 1, 5.0)]


def test_align_first_record_of_a_month_stands_for_it(spark):
    data = [("a", "2000-01-20", 2, 7.0), ("a", "2000-01-05", 1, 5.0), ("a", "2000-02-05", 3, 1.0)]
    assert aligned(spark, data) == [("2000-01-05", 1, 5.0), ("2000-02-05", 3, 1.0)]


def test_align_sum_and_mean(spark):
    data = [("a", "2000-01-05", 1, 5.0), ("a", "2000-01-20", 2, 7.0), ("a", "2000-03-09", 3, None)]
    assert [r[2] for r in aligned(spark, data, "sum")] == [5.0, None, 0.0]
    assert [r[0] for r in aligned(spark, data, "sum")] == ["2000-01-05", "2000-02-01", "2000-03-09"]
    assert [r[2] for r in aligned(spark, data, "sum", dedupe=False)] == [12.0, None, 0.0]
    assert [r[2] for r in aligned(spark, data, "mean", dedupe=False)] == [6.0, None, None]


def test_assemble_date_clamps(spark):
    df = spark.createDataFrame([(2000, 2, 31), (2001, 2, 31), (2001, 4, -3)], "y int, m int, d int")
    got = [str(r[0])[:10] for r in df.select(assemble_date(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == ["2000-02-29", "2001-02-28", "2001-04-01"]


def readings(spark, values, occ="1-001"):
    data = [(occ, 1, 10, i, f"2000-{1 + i // 28:02d}-{1 + i % 28:02d}", v) for i, v in enumerate(values)]
    return frame(spark, data, VOLUME)


@pytest.mark.parametrize("n, gone", [(26, False), (27, True)])
def test_outlier_needs_27_readings(spark, n, gone):
    out = clean.null_outliers(readings(spark, [0.0] * (n - 1) + [1e6]))
    assert (out.filter("volume_kgals is null").count() == 1) is gone


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_interpolation_leading_inner_trailing(spark, hot_rows):
    values = [None, 2.0, None, None, 8.0, None, None]
    out = rows(clean.interpolate_readings(readings(spark, values), hot_rows=hot_rows), "charge_id")
    assert [r[-1] for r in out] == [None, 2.0, 4.0, 6.0, 8.0, 8.0, 8.0]


@pytest.mark.parametrize("hot_rows", [1, 2, 10**6])
def test_undated_readings_of_hot_customers(spark, hot_rows):
    data = [("1-001", 1, 10, 0, None, 2.0)] + [("1-001", 1, 10, i, f"2000-01-{i:02d}", v) for i, v in ((1, None), (2, 100.0))]
    df = frame(spark, data, VOLUME)
    out = rows(clean.interpolate_readings(df, hot_rows=hot_rows), "charge_id")
    assert [r[-1] for r in out] == [2.0, 51.0, 100.0]  # the undated one comes first
    many = [("1-001", 1, 10, i, "2000-01-01", 0.0) for i in range(40)] + [("1-001", 1, 10, 99, None, 1e6)]
    out = clean.null_outliers(frame(spark, many, VOLUME), hot_rows=hot_rows)
    assert [r["charge_id"] for r in out.filter("volume_kgals IS NULL").collect()] == [99]


def test_csv_with_a_bad_cell_stops(spark, tmp_path):
    from ebbline.sources.tables import open_table

    (tmp_path / "c.csv").write_text("a,b\n1,2000-01-01\nx,2000-13-45\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        open_table(spark, str(tmp_path / "c.csv"), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DateType())]), "csv").collect()


def test_interpolation_stays_inside_a_customer_and_keeps_leftovers(spark):
    df = readings(spark, [1.0, None], "1-001").unionByName(readings(spark, [None, 9.0], "2-001")).unionByName(
        readings(spark, [None, 3.0, None], None)
    )
    out = rows(clean.interpolate_readings(df), "occupant_id", "charge_id")
    assert [(r[0], r[-1]) for r in out] == [
        (None, None), (None, 3.0), (None, None), ("1-001", 1.0), ("1-001", 1.0), ("2-001", None), ("2-001", 9.0),
    ]


def test_nan_becomes_null(spark):
    from ebbline.functions.columns import null_for_nan

    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert [r[0] for r in null_for_nan(df).collect()] == [None, 1.0, None]


def test_months_round_half_to_even(spark):
    half = 30.436875 / 2
    for days, want in ((half * 0.999, 0), (half * 1.001, 1), (30.436875 * 6.49, 6), (30.436875 * 6.51, 7)):
        got = spark.range(1).select(whole_mean_months(
            F.lit("2000-01-01").cast("timestamp_ntz"),
            F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(days * 86400)),
        )).first()[0]
        assert got == want


def test_whole_cleaning_is_the_same_with_hot_customers(spark, sf, clean_stage):
    from ebbline.catalog import stages

    t = dict(stages.raw(spark, sf))
    gazetteer = t.pop("geocode")
    hot = clean.clean_tables(t, gazetteer, hot_rows=5, array_limit=1)
    for name, key in (("volume", "charge_id"), ("charge", "charge_id")):
        want = clean_stage[name]
        assert rows(hot[name].select(*want.columns), key) == rows(want, key)


def test_aligned_cleaning_has_every_month_and_location(spark, sf):
    from ebbline.catalog import stages

    t = dict(stages.raw(spark, sf))
    gazetteer = t.pop("geocode")
    charge = clean.clean_tables(t, gazetteer, align=True)["charge"].filter("occupant_id is not null")
    assert charge.filter("location_id is null").count() == 0
    months = charge.groupBy("occupant_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.months_between(F.trunc(F.max("billing_period_end").cast("date"), "MM"),
                          F.trunc(F.min("billing_period_end").cast("date"), "MM")) + 1).alias("m"),
    )
    assert months.filter("n <> m").count() == 0
