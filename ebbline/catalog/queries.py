"""The catalogue: one query per operator, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.catalog import stages
from ebbline.catalog.fixtures import PREDICT_REF, TRAIN_REF
from ebbline.catalog.oracle import FEATURE_SELECT, LOGIT, THRESHOLD, r6, with_ctes
from ebbline.functions.columns import assemble_date
from ebbline.operators import clean, features, metrics, modeling, risk, segments, series
from ebbline.schemas import (
    CHARGE, CHARGE_DATA, CHARGE_STATS, CUTOFFS, IMPUTED_STATS, LOCATION, METER, OCCUPANT, TABLES,
    VOLUME, VOLUME_DATA, VOLUME_STATS,
)
from ebbline.sources import tables as src
from ebbline.sources import warehouse

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


CATALOGUE: dict[str, Entry] = {}
SCANS: dict[str, str] = {}  # the checking SQL of the scans and source joins, without their table expressions
WIN = 'win AS "window"'


def entry(name: str, sql: str | None = None, lens: tuple[int, ...] = (6,)):
    """Register a query under its name, with its checking SQL."""
    def register(run: Query) -> Query:
        CATALOGUE[name] = Entry(run, None if sql is None else with_ctes(sql, lens))
        if name.startswith("scan_") or name.endswith("_source_join"):
            SCANS[name] = sql
        return run

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits; adding 0 turns -0 into 0."""
    return df.select(*[
        (F.round(f.name, 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def _cols(schema: T.StructType) -> str:
    return ", ".join(schema.names)


def _raw_six(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    tables = stages.raw(spark, sf)
    return {name: tables[name] for name in TABLES}


# -- sources and sinks ---------------------------------------------------------------------

@entry("scan_meter", f"SELECT {_cols(METER)} FROM meter WHERE data_set_id = 1")
def _(spark, sf):
    return src.scan_meter(stages.raw(spark, sf)["meter"], 1)


@entry("scan_location", f"SELECT {_cols(LOCATION)} FROM location WHERE data_set_id = 1")
def _(spark, sf):
    return src.scan_location(stages.raw(spark, sf)["location"], 1)


@entry("scan_occupant", f"SELECT {_cols(OCCUPANT)} FROM occupant WHERE data_set_id = 1")
def _(spark, sf):
    return src.scan_occupant(stages.raw(spark, sf)["occupant"], 1)


@entry("volume_source_join", """
    SELECT l.location_id, m.meter_id, v.charge_id, v.meter_read_at, v.volume_kgals, v.volume_unit,
           v.unbilled
    FROM location l JOIN meter m ON l.location_id = m.location_id
    JOIN volume v ON m.meter_id = v.meter_id WHERE l.data_set_id = 1""")
def _(spark, sf):
    t = stages.raw(spark, sf)
    return src.volume_source(t["location"], t["meter"], t["volume"], 1)


@entry("charge_source_join", f"""
    SELECT {_cols(CHARGE).replace('location_id', 'l.location_id')}
    FROM location l JOIN charge c ON l.location_id = c.location_id WHERE l.data_set_id = 1""")
def _(spark, sf):
    t = stages.raw(spark, sf)
    return src.charge_source(t["location"], t["charge"], 1)


@entry("cutoffs_source_join", f"""
    SELECT {_cols(CUTOFFS).replace('location_id', 'l.location_id')}
    FROM cutoffs c JOIN location l ON l.location_id = c.location_id WHERE l.data_set_id = 1""")
def _(spark, sf):
    t = stages.raw(spark, sf)
    return src.cutoffs_source(t["location"], t["cutoffs"], 1)


def _digest_sql(name: str, schema: T.StructType, source: str, extra: str = "") -> str:
    """The manifest's rows for a table, by its declared schema."""
    def text(f: T.StructField) -> str:
        if isinstance(f.dataType, T.DoubleType):
            value = f"CAST(CAST(round({f.name} * 1000000) AS BIGINT) AS VARCHAR)"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = f"strftime({f.name}, '%Y-%m-%d %H:%M:%S')"
        else:
            value = f"CAST({f.name} AS VARCHAR)"
        return f"coalesce({value}, '<null>')"

    texts = {f.name: text(f) for f in schema.fields}
    whole = " || '|' || ".join(texts.values())
    rows = " UNION ALL ".join(f"""
        SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, {f'count(*) - count({c})' if c else '0'} AS n_null,
               CAST(coalesce(sum(('0x' || substr(md5({t}), 1, 8))::BIGINT), 0) AS BIGINT) AS digest_a,
               CAST(coalesce(sum(('0x' || substr(md5({t}), 9, 8))::BIGINT), 0) AS BIGINT) AS digest_b FROM ({source})"""
        for c, t in {**texts, "": whole}.items())
    return f"SELECT {extra}* FROM ({rows})"


def _declared_six(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {name: df.select(*TABLES[name].names) for name, df in _raw_six(spark, sf).items()}


def _six_sql(extra: str = "") -> str:
    return " UNION ALL ".join(_digest_sql(name, schema, f"SELECT * FROM {name}", extra) for name, schema in TABLES.items())


@entry("save_tables", _six_sql())
def _(spark, sf):
    """All six tables written as Parquet; the manifest's digests of every column."""
    folder = warehouse.new_folder(spark, "tables")
    src.save_tables(_declared_six(spark, sf), folder)
    return spark.read.parquet(f"{folder}/{src.MANIFEST}")


_FORMATS = ("parquet", "orc", "csv")


@entry("read_tables", " UNION ALL ".join(_six_sql(f"'{fmt}' AS fmt, ") for fmt in _FORMATS))
def _(spark, sf):
    """Six tables, three formats, every column: written, read with the manifest's check, and digested again."""
    folder, out = warehouse.new_folder(spark, "given"), None
    # Derived once, so that all formats get the same rows.
    tables = {name: warehouse.store(df, folder, name) for name, df in _declared_six(spark, sf).items()}
    for fmt in _FORMATS:
        folder = warehouse.new_folder(spark, fmt)
        src.save_tables(tables, folder, fmt=fmt)
        read = src.read_tables(spark, folder, fmt=fmt, verify=True)
        part = src.digests_of(read).select(F.lit(fmt).alias("fmt"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@entry("fetch_tables", " UNION ALL ".join(
    _digest_sql(name, TABLES[name], SCANS[query]) for name, query in (
        ("meter", "scan_meter"), ("location", "scan_location"), ("occupant", "scan_occupant"),
        ("volume", "volume_source_join"), ("charge", "charge_source_join"), ("cutoffs", "cutoffs_source_join"))))
def _(spark, sf):
    """The fetch step: the six working tables of a data set, every column."""
    return src.digests_of(src.fetch_tables(dict(stages.raw(spark, sf)), 1))


@entry("write_feature_table", """
    SELECT 'train' AS mode, '2000-06-30' AS ref_date, n_samples, count(*) AS n_rows,
           round(sum(mean_vol), 4) AS sum_vol FROM feat_t GROUP BY n_samples""", (4, 6))
def _(spark, sf):
    folder = warehouse.new_folder(spark, "warehouse")
    table = features.feature_tables(stages.cleaned(spark, sf), TRAIN_REF, n_samples=[4, 6])
    warehouse.write_feature_table(table, folder, "train", TRAIN_REF)
    return spark.read.parquet(folder).groupBy(
        "mode", F.col("ref_date").cast("string").alias("ref_date"), "n_samples"
    ).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("mean_vol"), 4).alias("sum_vol"))


@entry("read_feature_table", f"SELECT n_samples, {FEATURE_SELECT} FROM feat_t")
def _(spark, sf):
    folder = warehouse.new_folder(spark, "warehouse")
    table = stages.training_features(spark, sf)
    for n in (4, 6):
        warehouse.write_feature_table(table.withColumn("n_samples", F.lit(n)), folder, "train", TRAIN_REF)
    return rounded(warehouse.read_feature_table(spark, folder, "train", TRAIN_REF, 6))


# -- cleaning ------------------------------------------------------------------------------

@entry("occupant_dedupe", "SELECT * FROM occ_d")
def _(spark, sf):
    return clean.dedupe_occupants(stages.raw(spark, sf)["occupant"])


@entry("occupant_default_dates", """
    SELECT location_id, cis_occupant_id, coalesce(move_in_date, TIMESTAMP '1800-01-01') AS move_in_date,
           coalesce(move_out_date, TIMESTAMP '2099-12-31') AS move_out_date, data_set_id FROM occupant""")
def _(spark, sf):
    return clean.fill_occupancy_dates(stages.raw(spark, sf)["occupant"])


@entry("date_consistency", """
    SELECT 'move_in_date' AS field, location_id AS row_id, move_in_date AS ts FROM occupant
    UNION ALL SELECT 'move_out_date', location_id, move_out_date FROM occupant
    UNION ALL SELECT 'billing_period_end', charge_id, billing_period_end FROM charge
    UNION ALL SELECT 'meter_read_at', charge_id, meter_read_at FROM volume
    UNION ALL SELECT 'cutoff_at', id, cutoff_at FROM cutoffs""")
def _(spark, sf):
    """The five date columns as text, parsed."""
    t = stages.raw(spark, sf)
    out = None
    for table, column, row_id in [
        ("occupant", "move_in_date", "location_id"), ("occupant", "move_out_date", "location_id"),
        ("charge", "billing_period_end", "charge_id"), ("volume", "meter_read_at", "charge_id"),
        ("cutoffs", "cutoff_at", "id"),
    ]:
        text = t[table].withColumn(column, F.col(column).cast("string"))
        part = clean.parse_dates(text, column).select(
            F.lit(column).alias("field"), F.col(row_id).alias("row_id"), F.col(column).alias("ts")
        )
        out = part if out is None else out.unionByName(part)
    return out


@entry("occupant_key", """
    SELECT 'cutoffs' AS table_name, location_id, cis_occupant_id, occupant_id FROM cutoffs_k
    UNION ALL SELECT 'occupant', location_id, cis_occupant_id, occupant_id FROM occ_c""")
def _(spark, sf):
    t = stages.raw(spark, sf)
    columns = ["table_name", "location_id", "cis_occupant_id", "occupant_id"]
    return (
        clean.with_occupant_key(t["cutoffs"]).withColumn("table_name", F.lit("cutoffs")).select(*columns)
        .unionByName(
            clean.with_occupant_key(clean.dedupe_occupants(t["occupant"]))
            .withColumn("table_name", F.lit("occupant")).select(*columns)
        )
    )


def _occupants(t):
    return clean.with_occupant_key(clean.fill_occupancy_dates(clean.dedupe_occupants(t["occupant"])))


@entry("label_charges", "SELECT charge_id, location_id, billing_period_end, occupant_id FROM charge_l")
def _(spark, sf):
    t = stages.raw(spark, sf)
    return clean.label_records(t["charge"], _occupants(t), "billing_period_end").select(
        "charge_id", "location_id", "billing_period_end", "occupant_id"
    )


@entry("label_volumes", "SELECT charge_id, location_id, meter_read_at, occupant_id FROM volume_l")
def _(spark, sf):
    t = stages.raw(spark, sf)
    return clean.label_records(t["volume"], _occupants(t), "meter_read_at").select(
        "charge_id", "location_id", "meter_read_at", "occupant_id"
    )


@entry("label_unknown_location", """
    SELECT charge_id, occupant_id FROM volume_l
    WHERE location_id NOT IN (SELECT location_id FROM occ_c)""")
def _(spark, sf):
    t = stages.raw(spark, sf)
    occupants = _occupants(t)
    unknown = t["volume"].join(occupants, "location_id", "left_anti")
    return clean.label_records(unknown, occupants, "meter_read_at").select("charge_id", "occupant_id")


@entry("geocode_lookup", f"SELECT location_id, meter_address, {r6('latitude', 'longitude')} FROM location_c")
def _(spark, sf):
    t = stages.raw(spark, sf)
    return rounded(clean.geocode(t["location"], t["geocode"]).select(
        "location_id", "meter_address", "latitude", "longitude"
    ))


_GEO_NORMAL = "trim(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'))"


@entry("geocode_best", f"""
    WITH asked AS (SELECT location_id, substr(address, 1, greatest(0, length(address) - 5)) AS k FROM (
        SELECT location_id, CASE location_id % 4 WHEN 1 THEN lower(meter_address) WHEN 2 THEN replace(meter_address, 'l', '') ELSE meter_address END AS address
        FROM location)),
    g AS (SELECT *, {_GEO_NORMAL.format(c='address_key')} AS norm FROM (SELECT *, row_number() OVER (PARTITION BY address_key ORDER BY latitude, longitude) AS i FROM geocode) WHERE i = 1),
    met AS (
        SELECT a.location_id, g.*, CASE WHEN a.k = g.address_key THEN 0 WHEN a.norm = g.norm THEN 1 ELSE 2 END AS step
        FROM (SELECT *, {_GEO_NORMAL.format(c='k')} AS norm FROM asked) a JOIN g ON a.k = g.address_key OR (a.norm <> '' AND levenshtein(a.norm, g.norm) <= 1))
    SELECT a.location_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, coalesce(step, -1) AS step
    FROM asked a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY step, address_key) AS best FROM met) m
        ON m.location_id = a.location_id AND m.best = 1""")
def _(spark, sf):
    """Addresses in another case or with letters missing, and the best entry for each."""
    t = stages.raw(spark, sf)
    spoiled = F.when(F.col("location_id") % 4 == 1, F.lower("meter_address")).when(
        F.col("location_id") % 4 == 2, F.replace("meter_address", F.lit("l"), F.lit(""))).otherwise(F.col("meter_address"))
    found = clean.geocode_best(t["location"].withColumn("meter_address", spoiled), t["geocode"])
    return rounded(found.select("location_id", "latitude", "longitude", F.coalesce("geocode_step", F.lit(-1)).alias("step")))


def _aligned_sql(table: str, row_id: str, ts: str, data: list[str], carried: list[str], mode: str) -> str:
    gap = "s.m <> r.m"
    numbers = {"location_id", "meter_id", "charge_id", "base_charge", "vol_charge", "total_charge",
               "late_charge", "tampering_charge", "volume_kgals"}
    used_data = [c for c in data if mode == "pad" or c in numbers]
    used_carried = [c for c in carried if mode == "pad" or c in numbers]
    day = {"pad": "day(r.d)", "sum": f"CASE WHEN {gap} THEN 1 ELSE day(r.d) END"}
    day["mean"] = day["sum"]
    own = {"pad": "r.{c}", "mean": "r.{c}", "sum": "coalesce(r.{c}, 0)"}[mode]
    columns = [f"CASE WHEN {gap} THEN NULL ELSE {own.format(c=c)} END AS {c}" for c in used_data]
    columns += [
        f"r.{c}" if mode == "pad" else f"CASE WHEN {gap} THEN 0 ELSE r.{c} END AS {c}" for c in used_carried
    ]
    return f"""
        SELECT occupant_id, dt AS {ts}, {', '.join(used_data + used_carried)},
               year(dt) AS year, month(dt) AS month, day(dt) AS day
        FROM (
            SELECT r.occupant_id, {', '.join(columns)},
                   CAST(make_date(year(s.m), month(s.m),
                        CASE WHEN r.cnt = 1 THEN 1
                             ELSE least({day[mode]}, day(last_day(s.m))) END) AS TIMESTAMP) AS dt
            FROM (SELECT occupant_id, CAST(unnest(generate_series(CAST(min({ts}) AS DATE) - (day(min({ts})) - 1)::INTEGER,
                         CAST(max({ts}) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS m
                  FROM {table} WHERE occupant_id IS NOT NULL GROUP BY occupant_id) s
            JOIN (SELECT *, {ts} AS d, count(*) OVER (PARTITION BY occupant_id) AS cnt,
                         lead(m) OVER (PARTITION BY occupant_id ORDER BY m) AS next_m
                  FROM (SELECT *, CAST(date_trunc('month', {ts}) AS DATE) AS m,
                               row_number() OVER (PARTITION BY occupant_id, date_trunc('month', {ts})
                                                  ORDER BY {ts}, {row_id}) AS k
                        FROM {table} WHERE occupant_id IS NOT NULL) WHERE k = 1) r
              ON r.occupant_id = s.occupant_id AND s.m >= r.m AND (r.next_m IS NULL OR s.m < r.next_m))"""


_CHARGE_CARRIED = ["charge_id", "cis_bill_id"]
_VOLUME_CARRIED = ["location_id", "meter_id", "charge_id", "volume_unit"]
_VOLUME_TS, _CHARGE_TS = "meter_read_at", "billing_period_end"


def _labelled(spark, sf, name):
    t = stages.raw(spark, sf)
    ts = _CHARGE_TS if name == "charge" else _VOLUME_TS
    return clean.label_records(t[name], _occupants(t), ts)


@entry("align_monthly_pad", _aligned_sql(
    "volume_l", "charge_id", _VOLUME_TS, VOLUME_DATA, _VOLUME_CARRIED, "pad"))
def _(spark, sf):
    return clean.align_monthly(_labelled(spark, sf, "volume"), _VOLUME_TS, VOLUME_DATA, "pad")


@entry("align_monthly_sum", _aligned_sql(
    "volume_l", "charge_id", _VOLUME_TS, VOLUME_DATA, _VOLUME_CARRIED, "sum"))
def _(spark, sf):
    return clean.align_monthly(_labelled(spark, sf, "volume"), _VOLUME_TS, VOLUME_DATA, "sum")


@entry("align_monthly_mean", _aligned_sql(
    "charge_l", "charge_id", _CHARGE_TS, CHARGE_DATA, _CHARGE_CARRIED, "mean"))
def _(spark, sf):
    return clean.align_monthly(_labelled(spark, sf, "charge"), _CHARGE_TS, CHARGE_DATA, "mean")


@entry("assemble_date", """
    SELECT charge_id, CAST(make_date(year(meter_read_at), month(meter_read_at),
               greatest(1, least(day(meter_read_at) * 2 - 12, day(last_day(meter_read_at)))))
           AS TIMESTAMP) AS assembled FROM volume""")
def _(spark, sf):
    """Day numbers doubled and shifted, so that some fall outside the month on both sides."""
    ts = F.col("meter_read_at")
    return stages.raw(spark, sf)["volume"].select("charge_id", assemble_date(
        F.year(ts), F.month(ts), F.dayofmonth(ts) * 2 - 12
    ).alias("assembled"))


_PAD_CHARGE = _aligned_sql("charge_l", "charge_id", _CHARGE_TS, CHARGE_DATA, _CHARGE_CARRIED, "pad")
_PAD_VOLUME = _aligned_sql("volume_l", "charge_id", _VOLUME_TS, VOLUME_DATA, _VOLUME_CARRIED, "pad")


@entry("wrap_align", f"""
    SELECT 'charge' AS table_name, occupant_id, billing_period_end AS ts, charge_id,
           total_charge AS value FROM ({_PAD_CHARGE})
    UNION ALL SELECT 'volume', occupant_id, meter_read_at, charge_id, volume_kgals FROM ({_PAD_VOLUME})""")
def _(spark, sf):
    charge, volume = clean.align_tables(_labelled(spark, sf, "charge"), _labelled(spark, sf, "volume"))

    def long(df, name, ts, value):
        return df.select(F.lit(name).alias("table_name"), "occupant_id", F.col(ts).alias("ts"),
                         "charge_id", F.col(value).alias("value"))

    return long(charge, "charge", _CHARGE_TS, "total_charge").unionByName(
        long(volume, "volume", _VOLUME_TS, "volume_kgals")
    )


@entry("null_invalid", """
    SELECT charge_id, location_id, meter_id, CASE WHEN volume_kgals >= 0 THEN volume_kgals END AS volume_kgals
    FROM volume""")
def _(spark, sf):
    return clean.null_invalid(stages.raw(spark, sf)["volume"]).select(
        "charge_id", "location_id", "meter_id", "volume_kgals"
    )


@entry("null_outliers", "SELECT charge_id, occupant_id, round(volume_kgals, 6) AS volume_kgals FROM volume_o")
def _(spark, sf):
    return rounded(clean.null_outliers(clean.null_invalid(_labelled(spark, sf, "volume"))).select(
        "charge_id", "occupant_id", "volume_kgals"
    ))


@entry("interpolate_linear", """
    SELECT charge_id, occupant_id, location_id, meter_id, round(volume_kgals, 6) AS volume_kgals
    FROM volume_i""")
def _(spark, sf):
    folder = warehouse.new_folder(spark, "outliers")
    holes = warehouse.store(
        clean.null_outliers(clean.null_invalid(_labelled(spark, sf, "volume"))), folder, "volume"
    )
    return rounded(clean.interpolate_readings(holes).select(
        "charge_id", "occupant_id", "location_id", "meter_id", "volume_kgals"
    ))


@entry("fill_zero", """
    SELECT 'charge' AS table_name, charge_id, coalesce(total_charge, 0) AS amount,
           coalesce(late_charge, 0) AS late_charge FROM charge
    UNION ALL SELECT 'volume', charge_id, coalesce(volume_kgals, 0), NULL FROM volume""")
def _(spark, sf):
    t = stages.raw(spark, sf)
    charge = clean.zero_missing(t["charge"], "total_charge", "late_charge").select(
        F.lit("charge").alias("table_name"), "charge_id", F.col("total_charge").alias("amount"), "late_charge"
    )
    volume = clean.zero_missing(t["volume"], "volume_kgals").select(
        F.lit("volume").alias("table_name"), "charge_id", F.col("volume_kgals").alias("amount"),
        F.lit(None).cast("double").alias("late_charge"),
    )
    return charge.unionByName(volume)


@entry("late_flag", """
    SELECT charge_id, CASE WHEN coalesce(late_charge, 0) > 0 THEN 1 ELSE 0 END AS late FROM charge""")
def _(spark, sf):
    return clean.with_late_flag(stages.raw(spark, sf)["charge"]).select("charge_id", "late")


@entry("clean_tables", """
    SELECT 'volume' AS table_name, charge_id AS row_id, occupant_id, meter_read_at AS ts,
           round(volume_kgals, 6) AS value, NULL AS late FROM volume_c
    UNION ALL SELECT 'charge', charge_id, occupant_id, billing_period_end, round(total_charge, 6), late
              FROM charge_c
    UNION ALL SELECT 'cutoffs', id, occupant_id, cutoff_at, NULL, NULL FROM cutoffs_k
    UNION ALL SELECT 'occupant', location_id, occupant_id, move_in_date, NULL, NULL FROM occ_c
    UNION ALL SELECT 'location', location_id, meter_address, NULL, round(latitude, 6), NULL FROM location_c
    UNION ALL SELECT 'meter', meter_id, cust_type, NULL, meter_size, NULL FROM meter""")
def _(spark, sf):
    t = stages.write_clean(spark, sf)
    no_ts, no_value, no_late = (F.lit(None).cast(k) for k in ("timestamp_ntz", "double", "int"))
    shape = {
        "volume": ("charge_id", "occupant_id", F.col("meter_read_at"), F.col("volume_kgals"), no_late),
        "charge": ("charge_id", "occupant_id", F.col("billing_period_end"), F.col("total_charge"), F.col("late")),
        "cutoffs": ("id", "occupant_id", F.col("cutoff_at"), no_value, no_late),
        "occupant": ("location_id", "occupant_id", F.col("move_in_date"), no_value, no_late),
        "location": ("location_id", "meter_address", no_ts, F.col("latitude"), no_late),
        "meter": ("meter_id", "cust_type", no_ts, F.col("meter_size"), no_late),
    }
    out = None
    for name, (row_id, text, ts, value, late) in shape.items():
        part = t[name].select(
            F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"),
            F.col(text).alias("occupant_id"), ts.alias("ts"), value.alias("value"), late.alias("late"),
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out)


# -- customers and series ------------------------------------------------------------------

@entry("eligible_occupants", f"""
    SELECT 'train' AS mode, occupant_id, move_in_date, move_out_date FROM occ_first
    WHERE move_in_date <= TIMESTAMP '{TRAIN_REF}'
    UNION ALL SELECT 'predict', occupant_id, move_in_date, move_out_date FROM occ_first
    WHERE move_out_date >= TIMESTAMP '{PREDICT_REF}'""")
def _(spark, sf):
    occupant = stages.cleaned(spark, sf)["occupant"]

    def part(ref, mode):
        return features.eligible_occupants(occupant, ref, mode).select(
            F.lit(mode).alias("mode"), "occupant_id", "move_in_date", "move_out_date"
        )

    return part(TRAIN_REF, "train").unionByName(part(PREDICT_REF, "predict"))


@entry("ever_cutoff_flag", "SELECT occupant_id, cutoff FROM custs")
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    occupants = t["occupant"].select("occupant_id").distinct()
    return features.ever_cutoff(occupants, t["cutoffs"])


_META = ["latitude", "longitude", "meter_address", "municipality", "cust_type", "cust_type_code", "meter_size"]


@entry("customer_metadata", f"""
    SELECT occupant_id, location_id, {r6('latitude', 'longitude', 'meter_size')}, meter_address,
           municipality, cust_type, cust_type_code FROM custs""")
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    occupants = t["occupant"].select("occupant_id", "location_id").distinct()
    return rounded(features.customer_metadata(occupants, t["location"], t["meter"]).select(
        "occupant_id", "location_id", *_META
    ))


@entry("clip_history", f"""
    SELECT charge_id, occupant_id, meter_read_at FROM volume_c
    WHERE occupant_id IS NOT NULL AND meter_read_at <= TIMESTAMP '{TRAIN_REF}'""")
def _(spark, sf):
    return series.clip_history(stages.cleaned(spark, sf)["volume"], _VOLUME_TS, TRAIN_REF).select(
        "charge_id", "occupant_id", "meter_read_at"
    )


@entry("usable_series", """
    SELECT c.occupant_id, c.nrec AS n_charge, v.nrec AS n_volume
    FROM c_prof c JOIN v_prof v USING (occupant_id)""")
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    return series.usable_series(t["charge"], t["volume"], TRAIN_REF)


@entry("log_volume", "SELECT charge_id, round(vol_log, 6) + 0e0 AS vol_log FROM volume_g")
def _(spark, sf):
    return rounded(series.with_log_volume(stages.cleaned(spark, sf)["volume"]).select("charge_id", "vol_log"))


@entry("zscore_series", """
    SELECT charge_id, occupant_id, round(za, 6) + 0e0 AS volume_kgals_anom,
           round(zl, 6) + 0e0 AS vol_log_anom FROM v_z""")
def _(spark, sf):
    return rounded(series.anomalies(stages.cleaned(spark, sf)["volume"], TRAIN_REF).select(
        "charge_id", "occupant_id", "volume_kgals_anom", "vol_log_anom"
    ))


@entry("zscore_seasonal", """
    SELECT 'global' AS seasonal, charge_id, round(zm, 6) + 0e0 AS volume_kgals_manom,
           round(zml, 6) + 0e0 AS vol_log_manom FROM v_z
    UNION ALL
    SELECT 'by_month', charge_id,
           round(CASE WHEN nrec > 24 AND sd > 0 THEN (volume_kgals - mu) / sd ELSE 0 END, 6) + 0e0,
           round(CASE WHEN nrec > 24 AND lsd > 0 THEN (vol_log - lmu) / lsd ELSE 0 END, 6) + 0e0
    FROM phased JOIN phase_spread USING (occupant_id, phase)""")
def _(spark, sf):
    volume = stages.cleaned(spark, sf)["volume"]

    def part(kind):
        return series.anomalies(volume, TRAIN_REF, kind).select(
            F.lit(kind).alias("seasonal"), "charge_id", "volume_kgals_manom", "vol_log_manom"
        )

    return rounded(part("global").unionByName(part("by_month")))


# -- segments and windows ------------------------------------------------------------------

@entry("segment_by_cutoffs", """
    SELECT charge_id, occupant_id, segment, label, n_cut_prior FROM c_rec WHERE label = 2""")
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    bounds = series.profile(t["charge"], _CHARGE_TS, TRAIN_REF)
    found = segments.cutoff_segments(bounds, segments.ranked_cutoffs(t["cutoffs"], TRAIN_REF))
    sliced = segments.sliced_series(
        t["charge"].select("occupant_id", "charge_id", _CHARGE_TS), _CHARGE_TS, bounds, segments.HOT_ROWS
    )
    return segments.records_in_segments(sliced, found, _CHARGE_TS, TRAIN_REF).select(
        "charge_id", "occupant_id", "segment", "label", "n_cut_prior"
    )


@entry("tail_segment", " UNION ALL ".join(f"""
    SELECT '{name}' AS series, {keep} AS keep_tail, occupant_id, segment, lo, hi, label, n_cut_prior
    FROM {s}_tailall {'' if keep else 'WHERE label = 1'}"""
    for s, name in (("c", "charge"), ("v", "volume")) for keep in (0, 1)))
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    ranked = segments.ranked_cutoffs(t["cutoffs"], TRAIN_REF)
    out = None
    for name, ts in (("charge", _CHARGE_TS), ("volume", _VOLUME_TS)):
        bounds = series.profile(t[name], ts, TRAIN_REF)
        for keep in (False, True):
            part = segments.tail_segments(bounds, ranked, keep).select(
                F.lit(name).alias("series"), F.lit(int(keep)).alias("keep_tail"), "*"
            )
            out = part if out is None else out.unionByName(part)
    return out


def _all_segments(t, keep_tail=False):
    ranked = segments.ranked_cutoffs(t["cutoffs"], TRAIN_REF)
    return tuple(
        segments.all_segments(series.profile(t[n], ts, TRAIN_REF), t["cutoffs"], ranked, keep_tail)
        for n, ts in (("charge", _CHARGE_TS), ("volume", _VOLUME_TS))
    )


@entry("pair_segments", """
    SELECT c.occupant_id, c.segment, c.lo AS c_lo, c.hi AS c_hi, v.lo AS v_lo, v.hi AS v_hi, c.label,
           c.n_cut_prior FROM c_seg c JOIN v_seg v USING (occupant_id, segment)""")
def _(spark, sf):
    return segments.pair_segments(*_all_segments(stages.cleaned(spark, sf)))


@entry("single_segment", """
    SELECT occupant_id, 0 AS segment, t0 AS lo, t1 AS hi, 0 AS label, 0 AS n_cut_prior FROM v_prof
    WHERE occupant_id NOT IN (SELECT occupant_id FROM cutoffs_k)""")
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    return segments.single_segments(series.profile(t["volume"], _VOLUME_TS, TRAIN_REF), t["cutoffs"])


def _spans(ts, prefix):
    return [F.min(ts).alias(f"{prefix}_from"), F.max(ts).alias(f"{prefix}_to")]


@entry("backward_windows", f"""
    SELECT occupant_id, segment, {WIN}, n AS n_samples, c_from, c_to, v_from, v_to FROM win_t""", (4, 6))
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    c = features.charge_windows(t["charge"], t["cutoffs"], TRAIN_REF, [4, 6])
    v = features.volume_windows(t["volume"], t["cutoffs"], TRAIN_REF, [4, 6])
    return features.full_windows(c, _spans(_CHARGE_TS, "c")).join(
        features.full_windows(v, _spans(_VOLUME_TS, "v")), features.WINDOW_KEY
    )


@entry("window_labels", f"SELECT occupant_id, segment, {WIN}, label FROM win_t")
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    c = features.charge_windows(t["charge"], t["cutoffs"], TRAIN_REF, [6])
    v = features.volume_windows(t["volume"], t["cutoffs"], TRAIN_REF, [6])
    windows = features.full_windows(c, [F.first("label").alias("_label")])
    return windows.join(features.full_windows(v, [F.count(F.lit(1)).alias("_v")]), features.WINDOW_KEY).select(
        "occupant_id", "segment", "window",
        segments.window_label(F.col("_label"), F.col("window")).alias("label"),
    )


@entry("latest_window", """
    SELECT occupant_id, charge_id, n AS n_samples FROM vp_num""", (6, 12))
def _(spark, sf):
    volume = stages.cleaned(spark, sf)["volume"]
    return features.latest_records(volume, _VOLUME_TS, "charge_id", PREDICT_REF, [6, 12]).select(
        "occupant_id", "charge_id", "n_samples"
    )


@entry("future_cutoff_label", "SELECT occupant_id, label FROM ahead")
def _(spark, sf):
    return segments.future_labels(stages.cleaned(spark, sf)["cutoffs"], PREDICT_REF, 6)


@entry("prior_cutoffs", """
    SELECT occupant_id, n_prior AS "nCutPrior", CASE WHEN n_prior > 0 THEN 1 ELSE 0 END AS cut_prior
    FROM priors""")
def _(spark, sf):
    return segments.prior_cutoffs(stages.cleaned(spark, sf)["cutoffs"], PREDICT_REF).withColumn(
        "cut_prior", (F.col("nCutPrior") > 0).cast("int")
    )


def _volume_stats(spark, sf, aggregates):
    t = stages.cleaned(spark, sf)
    windows = features.volume_windows(t["volume"], t["cutoffs"], TRAIN_REF, [6])
    return rounded(features.full_windows(windows, aggregates).drop("n_samples"))


@entry("charge_window_stats", f"SELECT occupant_id, segment, {WIN}, {r6(*CHARGE_STATS)} FROM c_stat")
def _(spark, sf):
    t = stages.cleaned(spark, sf)
    windows = features.charge_windows(t["charge"], t["cutoffs"], TRAIN_REF, [6])
    return rounded(features.full_windows(windows, features.charge_aggregates()).drop("n_samples"))


@entry("volume_window_stats", f"SELECT occupant_id, segment, {WIN}, {r6('mean_vol', 'f_zero_vol')} FROM v_stat")
def _(spark, sf):
    return _volume_stats(spark, sf, features.usage_aggregates()[:2])


@entry("volume_window_skew", f"SELECT occupant_id, segment, {WIN}, {r6('skew_vol')} FROM v_stat")
def _(spark, sf):
    return _volume_stats(spark, sf, features.usage_aggregates()[2:])


_ANOM = [s for s in VOLUME_STATS if "_anom" in s]
_MANOM = [s for s in VOLUME_STATS if "_manom" in s]


@entry("anomaly_window_stats", f"SELECT occupant_id, segment, {WIN}, {r6(*_ANOM)} FROM v_stat")
def _(spark, sf):
    return _volume_stats(spark, sf, features.anomaly_aggregates("anom"))


@entry("seasonal_anomaly_window_stats", f"SELECT occupant_id, segment, {WIN}, {r6(*_MANOM)} FROM v_stat")
def _(spark, sf):
    return _volume_stats(spark, sf, features.anomaly_aggregates("manom"))


@entry("window_coverage_report", f"""
    SELECT occupant_id, segment, {WIN}, 6 AS n_samples, count(*) AS n_records, count(za) AS n_anom,
           count(*) AS n_manom
    FROM holed_num GROUP BY occupant_id, segment, win HAVING count(*) = 6 AND count(za) < 6""")
def _(spark, sf):
    """Windows over readings whose gaps are not filled yet."""
    folder = warehouse.new_folder(spark, "unfilled")
    holes = warehouse.store(
        clean.null_outliers(clean.null_invalid(_labelled(spark, sf, "volume"))), folder, "volume"
    )
    windows = features.volume_windows(holes, stages.cleaned(spark, sf)["cutoffs"], TRAIN_REF, [6])
    return features.coverage_report(windows)


@entry("short_series_report", """
    WITH there AS (
        SELECT 'charge' AS series, occupant_id, segment, n AS n_samples, win, count(*) AS n_records FROM c_num GROUP BY ALL
        UNION ALL SELECT 'volume', occupant_id, segment, n, win, count(*) FROM v_num GROUP BY ALL),
    reach AS (SELECT occupant_id, segment, n_samples, max(win) AS last FROM there WHERE n_records = n_samples GROUP BY ALL),
    expected AS (SELECT occupant_id, segment, n_samples, unnest(range(0, last + 1)) AS win FROM reach)
    SELECT series, occupant_id, segment, win AS "window", n_samples, coalesce(n_records, 0) AS n_records
    FROM expected CROSS JOIN (VALUES ('charge'), ('volume')) v(series) LEFT JOIN there USING (series, occupant_id, segment, n_samples, win)
    WHERE coalesce(n_records, 0) < n_samples""", (6, 12))
def _(spark, sf):
    """Windows that one series has and the other is too short for."""
    t = stages.cleaned(spark, sf)
    return features.short_series_report(
        features.charge_windows(t["charge"], t["cutoffs"], TRAIN_REF, [6, 12]), features.volume_windows(t["volume"], t["cutoffs"], TRAIN_REF, [6, 12]))


# -- feature tables ------------------------------------------------------------------------

@entry("binary_label", 'SELECT occupant_id, segment, "window", label, cutoff_strict FROM feat_t')
def _(spark, sf):
    return features.feature_table(stages.cleaned(spark, sf), TRAIN_REF).select(
        "occupant_id", "segment", "window", "label", "cutoff_strict"
    )


@entry("feature_table", f"SELECT {FEATURE_SELECT} FROM feat_t")
def _(spark, sf):
    return rounded(features.feature_table(stages.cleaned(spark, sf), TRAIN_REF))


def _holed(spark, sf):
    """Training features with values taken out by arithmetic, so that there is something to fill."""
    table = stages.training_features(spark, sf)
    holes = {
        c: F.when((F.col("location_id") * 7 + F.col("segment") * 5 + F.col("window") * 3 + i) % 37 != 0, F.col(c))
        for i, c in enumerate(IMPUTED_STATS, 1) if i % 4 == 1
    }
    return table.withColumns(holes)


@entry("impute_cutoff_stats", f"SELECT {FEATURE_SELECT} FROM holed_imp")
def _(spark, sf):
    return rounded(features.impute_cutoff_stats(_holed(spark, sf)))


@entry("drop_incomplete_occupants", f"""
    SELECT {FEATURE_SELECT} FROM holed h WHERE NOT EXISTS (
        SELECT 1 FROM holed b WHERE b.occupant_id = h.occupant_id AND b.cutoff_strict = 0
        AND ({' OR '.join(f'b.{c} IS NULL' for c in IMPUTED_STATS)}))""")
def _(spark, sf):
    return rounded(features.drop_incomplete_occupants(_holed(spark, sf)))


@entry("predict_fill_zero", f"SELECT {FEATURE_SELECT} FROM feat_pz", (36,))
def _(spark, sf):
    table = features.feature_table(stages.cleaned(spark, sf), PREDICT_REF, "predict", 36)
    return rounded(features.zero_missing_stats(table))


@entry("label_choice", f"""
    SELECT 'strict' AS choice, occupant_id, segment, "window", cutoff_strict AS label,
           {r6('f_late', 'skew_vol')} FROM holed_fin
    UNION ALL SELECT 'ever', occupant_id, segment, "window", cutoff, {r6('f_late', 'skew_vol')}
              FROM holed_loose_fin""")
def _(spark, sf):
    """Completion under both labels; they impute and drop different customers."""
    table = _holed(spark, sf)

    def part(name, strict):
        return features.complete_features(table, strict=strict).select(
            F.lit(name).alias("choice"), "occupant_id", "segment", "window",
            F.col(features.choose_label(strict)).alias("label"), "f_late", "skew_vol",
        )

    return rounded(part("strict", True).unionByName(part("ever", False)))


@entry("feature_sweep", f"SELECT n_samples, {FEATURE_SELECT} FROM feat_t_fin", stages.SWEEP)
def _(spark, sf):
    return rounded(features.feature_sweep(stages.cleaned(spark, sf), TRAIN_REF, n_samples=stages.SWEEP))


# -- model data and scores -----------------------------------------------------------------

@entry("select_features", """
    SELECT occupant_id, segment, "window", round(f_late, 6) AS f_late, round(f_zero_vol, 6) AS f_zero_vol,
           round(f_manom3_vol, 6) AS f_manom3_vol, cust_type_code, municipality, meter_size, cut_prior,
           cutoff_strict FROM feat_t""")
def _(spark, sf):
    names = modeling.feature_names("manom", with_meta=True, with_cut_prior=True)
    return rounded(modeling.select_features(stages.training_features(spark, sf), names))


@entry("stratified_split", 'SELECT occupant_id, segment, "window", stratum, subset FROM split')
def _(spark, sf):
    return modeling.stratified_split(stages.training_features(spark, sf)).select(
        "occupant_id", "segment", "window", "stratum", "subset"
    )


@entry("class_weights", """
    SELECT cutoff_strict, round(0.5::DOUBLE * sum(count(*)) OVER () / count(*), 6) AS weights
    FROM split WHERE subset = 'train' GROUP BY cutoff_strict""")
def _(spark, sf):
    split = modeling.stratified_split(stages.training_features(spark, sf))
    return rounded(modeling.class_weights(split.filter("subset = 'train'")))


@entry("stratified_folds", """
    SELECT occupant_id, segment, "window", cutoff_strict,
           CAST((row_number() OVER (PARTITION BY cutoff_strict ORDER BY digest) - 1) % 5 AS INTEGER) AS fold
    FROM split WHERE subset = 'train'""")
def _(spark, sf):
    split = modeling.stratified_split(stages.training_features(spark, sf))
    return modeling.with_folds(split.filter("subset = 'train'")).select(
        "occupant_id", "segment", "window", "cutoff_strict", "fold"
    )


def _scored_current(spark, sf):
    means, _ = modeling.missing_values(stages.training_features(spark, sf), [c for c in LOGIT if c != "intercept"])
    return modeling.score_linear(stages.current_features(spark, sf), LOGIT, means)


def _scored_training(spark, sf):
    return modeling.score_linear(stages.training_features(spark, sf), LOGIT)


@entry("score_batch", """
    SELECT 'train' AS mode, occupant_id, segment, "window", round(p_cutoff, 6) AS p_cutoff FROM scored_t WHERE n_samples = 6
    UNION ALL SELECT 'predict', occupant_id, segment, "window", round(p_cutoff, 6) FROM scored_p""", stages.BOTH)
def _(spark, sf):
    """Training windows, and today's customers with windows of 36, of whom many lack inputs."""
    def part(mode, scored):
        return scored.select(F.lit(mode).alias("mode"), "occupant_id", "segment", "window", "p_cutoff")

    current = _scored_current(spark, sf)
    return rounded(part("train", _scored_training(spark, sf)).unionByName(part("predict", current)))


@entry("metric_auc", """
    SELECT round((sum(mid) FILTER (WHERE cutoff_strict = 1) - pos * (pos + 1) / 2) / (pos * neg), 6) AS auc
    FROM (SELECT cutoff_strict, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS mid,
                 count(*) FILTER (WHERE cutoff_strict = 1) OVER () AS pos,
                 count(*) FILTER (WHERE cutoff_strict = 0) OVER () AS neg
          FROM (SELECT cutoff_strict, round(p_cutoff, 9) AS p FROM scored_t))
    GROUP BY pos, neg""")
def _(spark, sf):
    """Scores rounded so that ties are ties in every engine."""
    scored = _scored_training(spark, sf).withColumn("p_cutoff", F.round("p_cutoff", 9))
    return rounded(metrics.roc_auc(scored, "cutoff_strict", "p_cutoff"))


@entry("metric_logloss", """
    SELECT round(avg(-(cutoff_strict * ln(p) + (1 - cutoff_strict) * ln(1 - p))), 6) AS logloss
    FROM (SELECT cutoff_strict, greatest(1e-15, least(1 - 1e-15, p_cutoff)) AS p FROM scored_t)""")
def _(spark, sf):
    y, p = F.col("cutoff_strict").cast("double"), F.col("p_cutoff")
    return rounded(_scored_training(spark, sf).agg(metrics.log_loss(y, p).alias("logloss")))


@entry("metric_r2", """
    SELECT round(1 - avg(power(cutoff_strict - p_cutoff, 2)) / var_pop(cutoff_strict), 6) AS r2 FROM scored_t""")
def _(spark, sf):
    y, p = F.col("cutoff_strict").cast("double"), F.col("p_cutoff")
    return rounded(_scored_training(spark, sf).agg(metrics.r_squared(y, p).alias("r2")))


_GRID = [("a", "late_only", {"intercept": -1.5, "f_late": 3.0}), ("b", "both", LOGIT)]


def _logit_sql(w: dict[str, float]) -> str:
    terms = " + ".join(f"{v}::DOUBLE" if c == "intercept" else f"{v}::DOUBLE * {c}" for c, v in w.items())
    return f"round(1 / (1 + exp(-({terms}))), 9)"


_AUC_UNION = " UNION ALL ".join(
    f"SELECT n_samples, '{kind}' AS model_type, {i} AS j, cutoff_strict, {_logit_sql(w)} AS p FROM feat_t"
    for i, (_, kind, w) in enumerate(_GRID)
)


@entry("best_model", f"""
    SELECT n_samples, model_type, round(auc, 6) AS auc_xval,
           row_number() OVER (ORDER BY round(auc, 9) DESC, n_samples, j) = 1 AS is_best
    FROM (SELECT n_samples, model_type, j,
                 (sum(mid) FILTER (WHERE cutoff_strict = 1) - pos * (pos + 1) / 2) / (pos * neg) AS auc
          FROM (SELECT *, rank() OVER (PARTITION BY n_samples, j ORDER BY p)
                          + (count(*) OVER (PARTITION BY n_samples, j, p) - 1) / 2 AS mid,
                       count(*) FILTER (WHERE cutoff_strict = 1) OVER (PARTITION BY n_samples, j) AS pos,
                       count(*) FILTER (WHERE cutoff_strict = 0) OVER (PARTITION BY n_samples, j) AS neg
                FROM ({_AUC_UNION}))
          GROUP BY n_samples, model_type, j, pos, neg)""", stages.SWEEP)
def _(spark, sf):
    """The choice over (window length x model) with given coefficients in place of fitted ones."""
    table = stages.sweep_features(spark, sf)
    scored = None
    for j, (_, kind, weights) in enumerate(_GRID):
        part = modeling.score_linear(table, weights).select(
            F.concat_ws("|", F.col("n_samples").cast("string"), F.lit(kind), F.lit(str(j))).alias("g"),
            "cutoff_strict", F.round("p_cutoff", 9).alias("p_cutoff"),
        )
        scored = part if scored is None else scored.unionByName(part)
    parts = F.split("g", "\\|")
    runs = metrics.roc_auc(scored, "cutoff_strict", "p_cutoff", group="g").select(
        F.lit("all").alias("options"), parts[0].cast("int").alias("n_samples"), parts[1].alias("model_type"),
        (parts[0].cast("int") * 10 + parts[2].cast("int")).alias("grid_order"),
        F.round("auc", 9).alias("auc_xval"),
    )
    return rounded(modeling.best_run(runs).select("n_samples", "model_type", "auc_xval", "is_best"))


@entry("write_predictions", """
    SELECT occupant_id, segment, "window", round(p_cutoff, 6) AS p_cutoff
    FROM scored_t JOIN split USING (occupant_id, segment, "window") WHERE split.subset = 'test'""")
def _(spark, sf):
    folder = warehouse.new_folder(spark, "predictions")
    scored = modeling.score_linear(
        modeling.stratified_split(stages.training_features(spark, sf)), LOGIT
    )
    for subset in ("train", "test"):
        warehouse.write_predictions(scored.filter(F.col("subset") == subset), folder, "given_logit", subset)
    return rounded(warehouse.read_predictions(spark, folder, "given_logit", "test"))


# Fitted models: the default options, over all rows.
_OPTIONS = modeling.ModelOptions()
_RICH = modeling.feature_names("anom", with_meta=True, with_cut_prior=True)
_TYPES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(_OPTIONS.model_types))
_LENGTHS = ", ".join(f"({i}, {n})" for i, n in enumerate(_OPTIONS.n_samples))
_GRID_ROWS = f"(VALUES {_LENGTHS}) a(i, n_samples), (VALUES {_TYPES}) b(j, model_type)"


def _prepared(spark, sf, options=_OPTIONS):
    return stages._once(spark, ("prepared", options.digest(), sf), lambda: modeling.prepare_training(
        stages.training_features(spark, sf), options, warehouse.new_folder(spark, "training"), "n06"
    ))


def _train_rows(spark, sf):
    return _prepared(spark, sf).filter("subset = 'train'")


def _trained(spark, sf, model_type):
    """One model of each kind per session and data folder: (model, scores, metrics)."""
    return stages._once(spark, ("trained", model_type, sf), lambda: modeling.train_and_test(_prepared(spark, sf), model_type, _OPTIONS))


def _runs(spark, sf):
    """One recorded sweep per session and data folder: (root folder, runs)."""
    def build():
        root = warehouse.new_folder(spark, "runs")
        sweep = stages.sweep_features(spark, sf)
        return root, modeling.train_sweep(spark, sweep, root, _OPTIONS, TRAIN_REF)

    return stages._once(spark, ("runs", sf), build)


_SMOTE_NUMBERS = ["f_late", "f_zero_vol", "f_anom3_vol"]
_SMOTE_OTHERS = [c for c in _RICH if c not in _SMOTE_NUMBERS]
_SMOTE_KEYS = "a.occupant_id, a.segment, a.\"window\""


@entry("smote_oversample", f"""
    WITH t AS (SELECT occupant_id, segment, "window", digest, cutoff_strict, {r6(*_SMOTE_NUMBERS)}, {', '.join(_SMOTE_OTHERS)} FROM split WHERE subset = 'train'),
    c AS (SELECT min(n) AS low, max(n) AS high, min((n, cutoff_strict)) AS least FROM (SELECT cutoff_strict, count(*) AS n FROM t GROUP BY cutoff_strict)),
    m AS (SELECT t.*, high - low AS missing, low, row_number() OVER (ORDER BY digest) AS number FROM t, c WHERE cutoff_strict = least[2]),
    near AS (SELECT * FROM (SELECT a.digest, b.digest AS other, row_number() OVER (PARTITION BY a.digest ORDER BY
                 {' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in _SMOTE_NUMBERS)}, b.digest) AS k
             FROM m a JOIN m b ON a.digest <> b.digest) WHERE k <= 5),
    found AS (SELECT digest, max(k) AS n FROM near GROUP BY digest),
    made AS (SELECT m.*, unnest(range(1, missing // low + CASE WHEN number <= missing % low THEN 1 ELSE 0 END + 1)) AS copy FROM m),
    dice AS (SELECT *, md5(digest || '|' || copy) AS h FROM made),
    picked AS (SELECT d.*, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS u, q.other
               FROM dice d LEFT JOIN found f USING (digest) LEFT JOIN near q ON q.digest = d.digest AND q.k = ('0x' || substr(h, 1, 8))::BIGINT % f.n + 1)
    SELECT 'made-' || a.copy || '-' || a.occupant_id AS occupant_id, a.segment, a."window", a.cutoff_strict, 1 AS synthetic,
           {', '.join(f'round(a.{c} + (coalesce(b.{c}, a.{c}) - a.{c}) * u, 6) AS {c}' for c in _SMOTE_NUMBERS)},
           {', '.join(f'CASE WHEN b.digest IS NULL THEN a.{c} ELSE b.{c} END AS {c}' for c in _SMOTE_OTHERS)}
    FROM picked a LEFT JOIN m b ON b.digest = a.other
    UNION ALL SELECT {_SMOTE_KEYS}, a.cutoff_strict, 0, {', '.join(_SMOTE_NUMBERS)}, {', '.join(_SMOTE_OTHERS)} FROM t a""")
def _(spark, sf):
    split = modeling.stratified_split(stages.training_features(spark, sf)).filter("subset = 'train'")
    return rounded(modeling.smote_oversample(rounded(split), _RICH))


_INDEX_SQL = " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS index,
           count(*) OVER () AS levels FROM feat_t WHERE {c} IS NOT NULL GROUP BY {c}""" for c in modeling.CATEGORICAL)


@entry("encode_categoricals", f"""
    WITH levels AS ({_INDEX_SQL}),
    shift AS (SELECT feature, sum(n) OVER (ORDER BY place) - n AS before FROM (
        SELECT feature, max(levels) + 1 AS n, min(CASE feature {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(modeling.CATEGORICAL))} END) AS place
        FROM levels GROUP BY feature))
    SELECT occupant_id, segment, "window", CAST({len(_RICH) - len(modeling.CATEGORICAL)} + before + index AS BIGINT) AS slot, 1.0::DOUBLE AS value
    FROM feat_t, LATERAL (VALUES {', '.join(f"('{c}', CAST({c} AS VARCHAR))" for c in modeling.CATEGORICAL)}) v(feature, level)
    JOIN levels USING (feature, level) JOIN shift USING (feature)
    UNION ALL SELECT occupant_id, segment, "window", slot, round(value, 6)
    FROM feat_t, LATERAL (VALUES {', '.join(f'({i}, {c})' for i, c in enumerate(_SMOTE_NUMBERS))}) v(slot, value) WHERE value <> 0""")
def _(spark, sf):
    """The slots of the vectors that are not 0: numbers first, then a slot a level, the commonest first."""
    table = stages.training_features(spark, sf)
    vector = modeling.vector_to_array("features")
    rows = modeling.encode(table, _RICH, one_hot=True).transform(table).select(*modeling.KEY, F.posexplode(vector).alias("slot", "value"))
    return rounded(rows.filter("value <> 0").withColumn("slot", F.col("slot").cast("long")))


def _names_sql(select: str, names: list[str]) -> str:
    return f"SELECT name, {select} FROM (VALUES {', '.join(f'({n!r})' for n in names)}) v(name)"


@entry("train_logistic_regularized", _names_sql("0.0::DOUBLE AS gap", [*_OPTIONS.features, "Intercept"]))
def _(spark, sf):
    """How far each coefficient of the penalty that won is from its first-order condition."""
    trained, _, _ = _trained(spark, sf, "logistic_regression")
    return rounded(modeling.optimality(trained.model, _train_rows(spark, sf)))


_PLAIN = modeling.ModelOptions(regularization=False)


@entry("train_logistic_plain", _names_sql("0.0::DOUBLE AS gap, true AS has_error, true AS has_p", [*_PLAIN.features, "Intercept"]))
def _(spark, sf):
    """First-order conditions without a penalty: the weighted residuals of each feature sum to 0."""
    train = _train_rows(spark, sf)
    model = modeling.train_logistic(train, _PLAIN).model
    known = modeling.coefficients(model, train).select("name", (F.col("std_error") > 0).alias("has_error"), F.col("p_value").between(0, 1).alias("has_p"))
    return rounded(modeling.optimality(model, train).join(known, "name"))


@entry("train_random_forest", 'SELECT occupant_id, segment, "window", subset, true AS is_probability FROM split')
def _(spark, sf):
    trained, _, _ = _trained(spark, sf, "random_forest")
    return modeling.score(trained.model, _prepared(spark, sf)).select(
        *modeling.KEY, "subset", F.col("p_cutoff").between(0, 1).alias("is_probability"))


@entry("depth_grid", f"""
    SELECT occupant_id, segment, "window", true AS is_probability, true AS in_grid FROM split WHERE subset = 'train'""")
def _(spark, sf):
    """Held-out scores of the depth that won, one of each training row."""
    trained, _, _ = _trained(spark, sf, "random_forest")
    depth = trained.model.stages[-1].getMaxDepth()
    return trained.cv.select(*modeling.KEY, F.col("p_cutoff").between(0, 1).alias("is_probability"), F.lit(depth in _OPTIONS.max_depths).alias("in_grid"))


@entry("train_and_test_model", f"""
    SELECT model_type, scored, n, true AS plausible FROM (VALUES {', '.join(f"('{m}')" for m in _OPTIONS.model_types)}) m(model_type),
        (SELECT subset AS scored, count(*) AS n FROM split GROUP BY subset
         UNION ALL SELECT 'xval', count(*) FROM split WHERE subset = 'train')""")
def _(spark, sf):
    out = None
    for kind in _OPTIONS.model_types:
        trained, scored, _ = _trained(spark, sf, kind)
        both = None
        for subset, df in (*scored.items(), ("xval", trained.cv)) if "xval" not in scored else scored.items():
            part = df.select(F.lit(subset).alias("scored"), modeling.LABEL, "p_cutoff")
            both = part if both is None else both.unionByName(part)
        rows = metrics.score_metrics(both, modeling.LABEL, "p_cutoff", group="scored").select(
            F.lit(kind).alias("model_type"), "scored", "n", (F.col("auc").between(0, 1) & (F.col("logloss") > 0) & (F.col("r2") <= 1)).alias("plausible"))
        out = rows if out is None else out.unionByName(rows)
    return out


_STATS = [f"{m}_{s}" for s in ("train", "xval", "test") for m in ("auc", "logloss")]


@entry("train_sweep", f"""
    SELECT n_samples, model_type, CAST(i * 2 + j AS INTEGER) AS grid_order, CAST({_OPTIONS.seed} + i AS INTEGER) AS seed, true AS measured,
           CAST(1 AS BIGINT) AS winners, true AS wins_fairly FROM {_GRID_ROWS}""")
def _(spark, sf):
    """Every setting has its row, the seed grows, and the highest held-out AUC wins."""
    runs = _runs(spark, sf)[1]
    ends = runs.agg(F.sum(F.col("is_best").cast("long")).alias("winners"), (F.max("auc_xval") == F.max(F.when(F.col("is_best"), F.col("auc_xval")))).alias("wins_fairly"))
    measured = F.lit(True)
    for c in _STATS:
        measured = measured & F.col(c).isNotNull()
    return runs.crossJoin(F.broadcast(ends)).select("n_samples", "model_type", "grid_order", "seed", measured.alias("measured"), "winners", "wins_fairly")


@entry("write_model_stats", f"SELECT n_samples, model_type, true AS same FROM {_GRID_ROWS}")
def _(spark, sf):
    """The recorded test metrics against those of the recorded predictions."""
    root, runs = _runs(spark, sf)
    folders, sweep = modeling.RunFolders(root), stages.sweep_features(spark, sf)
    scores = spark.read.parquet(folders.predictions).filter("subset = 'test'").join(runs.select("run_id", "n_samples"), "run_id")
    labelled = scores.join(sweep.select("n_samples", *modeling.KEY, modeling.LABEL), ["n_samples", *modeling.KEY])
    again = metrics.score_metrics(labelled, modeling.LABEL, "p_cutoff", group="run_id").select("run_id", "auc", "logloss")
    stats = spark.read.parquet(folders.stats).join(again, "run_id")
    same = (F.abs(F.col("auc") - F.col("auc_test")) < 1e-9) & (F.abs(F.col("logloss") - F.col("logloss_test")) < 1e-9)
    return stats.select("n_samples", "model_type", same.alias("same"))


@entry("write_model_coefs", f"""
    SELECT n_samples, model_type, name, CASE j WHEN 0 THEN 'coefficient' ELSE 'importance' END AS kind FROM {_GRID_ROWS},
        (VALUES {', '.join(f"('{c}')" for c in [*_OPTIONS.features, 'Intercept'])}) v(name) WHERE j = 0 OR name <> 'Intercept'""")
def _(spark, sf):
    root, runs = _runs(spark, sf)
    return spark.read.parquet(modeling.RunFolders(root).coefs).join(runs.select("run_id", "n_samples", "model_type"), "run_id").select(
        "n_samples", "model_type", "name", "kind")


@entry("model_coefs", _names_sql("1.0::DOUBLE AS total", _OPTIONS.features))
def _(spark, sf):
    """A forest's importances, which sum to 1."""
    trained, _, _ = _trained(spark, sf, "random_forest")
    found = modeling.coefficients(trained.model, _prepared(spark, sf))
    total = found.agg(F.sum("value").alias("total"))
    return rounded(found.select("name").crossJoin(F.broadcast(total)))


@entry("best_run_registry", """
    SELECT subset, CAST(0 AS BIGINT) AS too_many, CAST(0 AS BIGINT) AS too_few, true AS same FROM (VALUES ('train'), ('test')) v(subset)""")
def _(spark, sf):
    """The best run's predictions: a score for each row of its window length's subset, and its recorded AUC."""
    root, runs = _runs(spark, sf)
    best = runs.filter("is_best").select("n_samples", "auc_train", "auc_test")
    rows = modeling.stratified_split(stages.sweep_features(spark, sf).join(best.select("n_samples"), "n_samples").drop("n_samples"))
    scores = warehouse.best_of(spark.read.parquet(modeling.RunFolders(root).predictions), runs).select(*modeling.KEY, "subset", "p_cutoff")
    joined = rows.select(*modeling.KEY, "subset", modeling.LABEL, F.lit(1).alias("row")).join(scores, [*modeling.KEY, "subset"], "full")
    counts = joined.groupBy("subset").agg(F.count_if(F.col("row").isNull()).alias("too_many"), F.count_if(F.col("p_cutoff").isNull()).alias("too_few"))
    auc = metrics.score_metrics(joined, modeling.LABEL, "p_cutoff", group="subset").select("subset", "auc").crossJoin(F.broadcast(best))
    known = F.when(F.col("subset") == "train", F.col("auc_train")).otherwise(F.col("auc_test"))
    return counts.join(auc.select("subset", (F.abs(F.col("auc") - known) < 1e-9).alias("same")), "subset")


@entry("save_load_model", """
    SELECT model_type, occupant_id, segment, "window", 0.0::DOUBLE AS difference
    FROM split, (VALUES ('logistic_regression'), ('random_forest')) v(model_type)""")
def _(spark, sf):
    """Scores of the reloaded models for n = 6 against those recorded when they were trained."""
    root, runs = _runs(spark, sf)
    folders = modeling.RunFolders(root)
    table = stages.sweep_features(spark, sf).filter("n_samples = 6").drop("n_samples")
    out = None
    for r in runs.filter("n_samples = 6").select("run_id", "model_type").collect():
        then = spark.read.parquet(folders.predictions).filter(F.col("run_id") == r["run_id"]).select(*modeling.KEY, F.col("p_cutoff").alias("then"))
        now = modeling.score(modeling.PipelineModel.load(folders.model(r["run_id"])), table)
        part = now.join(then, modeling.KEY).select(F.lit(r["model_type"]).alias("model_type"), *modeling.KEY, (F.col("p_cutoff") - F.col("then")).alias("difference"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@entry("predict_current", 'SELECT occupant_id, 0.0::DOUBLE AS difference, true AS is_probability FROM feat_p')
def _(spark, sf):
    """Each of today's customers has a score, that of the best model on the features returned."""
    root, runs = _runs(spark, sf)
    found = modeling.predict_current(
        spark, stages.cleaned(spark, sf), root, _OPTIONS, TRAIN_REF, PREDICT_REF,
        feature_folder=f"{root}/features",
    )
    best = runs.filter("is_best").select("run_id").first()["run_id"]
    model = modeling.PipelineModel.load(modeling.RunFolders(root).model(best))
    again = modeling.score(model, found.drop("p_cutoff")).select("occupant_id", F.col("p_cutoff").alias("again"))
    return rounded(found.join(again, "occupant_id").select(
        "occupant_id", (F.col("p_cutoff") - F.col("again")).alias("difference"), F.col("p_cutoff").between(0, 1).alias("is_probability")))


# -- risk questions ------------------------------------------------------------------------

def _predictions(spark, sf):
    return _scored_current(spark, sf).select("occupant_id", "p_cutoff")


def _risk(spark, sf):
    return risk.dashboard_table(stages.current_features(spark, sf), _predictions(spark, sf))


@entry("risk_table", f"SELECT {FEATURE_SELECT}, round(p_cutoff, 6) AS p_cutoff FROM scored_p", stages.BOTH)
def _(spark, sf):
    return rounded(risk.risk_table(stages.current_features(spark, sf), _predictions(spark, sf)))


@entry("risk_percentages", f"SELECT occupant_id, {r6(*risk.PERCENT_COLUMNS)} FROM risk_all", stages.BOTH)
def _(spark, sf):
    table = risk.risk_table(stages.current_features(spark, sf), _predictions(spark, sf))
    return rounded(risk.as_percentages(table).select("occupant_id", *risk.PERCENT_COLUMNS))


@entry("dedupe_location", "SELECT location_id, occupant_id FROM risk_one", stages.BOTH)
def _(spark, sf):
    table = risk.risk_table(stages.current_features(spark, sf), _predictions(spark, sf))
    return risk.one_per_location(table).select("location_id", "occupant_id")


@entry("anonymize_addresses", "SELECT location_id, meter_address FROM risk", stages.BOTH)
def _(spark, sf):
    return _risk(spark, sf).select("location_id", "meter_address")


@entry("threshold_filter", "SELECT occupant_id, round(p_cutoff, 6) AS p_cutoff FROM above", stages.BOTH)
def _(spark, sf):
    return rounded(risk.at_risk(_risk(spark, sf), THRESHOLD).select("occupant_id", "p_cutoff"))


@entry("predicted_cutoffs", "SELECT count(*) AS predicted_cutoffs FROM above", stages.BOTH)
def _(spark, sf):
    return risk.predicted_cutoffs(_risk(spark, sf), THRESHOLD)


def _expected_sql(select: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, coalesce(sum("{c}" * p_cutoff / 100), 0) * {f} AS total,
                   count(*) AS n FROM above""" for c, f in risk.TOTAL_FACTORS.items()
    )
    return f"SELECT feature, {select} FROM ({parts})"


@entry("expected_total", _expected_sql("round(total, 6) AS total"), stages.BOTH)
def _(spark, sf):
    return rounded(risk.expected_values(_risk(spark, sf), THRESHOLD).select("feature", "total"))


@entry("expected_mean", _expected_sql("round(total / nullif(n, 0), 6) AS mean"), stages.BOTH)
def _(spark, sf):
    return rounded(risk.expected_values(_risk(spark, sf), THRESHOLD).select("feature", "mean"))


@entry("map_points", """
    SELECT 'risk' AS map, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
           round(p_cutoff, 6) AS value, meter_address FROM above
    UNION ALL SELECT 'history', round(latitude, 6), round(longitude, 6), round(mean_charge_tot, 6),
              meter_address FROM above""", stages.BOTH)
def _(spark, sf):
    table = _risk(spark, sf)

    def part(name, value):
        return risk.map_points(table, value, THRESHOLD).select(F.lit(name).alias("map"), "*")

    return rounded(part("risk", "p_cutoff").unionByName(part("history", "mean_charge_tot")))


_CATEGORIES = ["cust_type", "municipality", "meter_size"]


@entry("category_share", " UNION ALL ".join(f"""
    SELECT '{c}' AS category, CAST({c} AS VARCHAR) AS value, count(*) AS customers,
           CASE WHEN {c} IS NULL THEN 0 ELSE round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) END AS share
    FROM (SELECT * REPLACE (CASE WHEN location_id % 5 > 0 THEN cust_type END AS cust_type) FROM above) GROUP BY {c}"""
    for c in _CATEGORIES), stages.BOTH)
def _(spark, sf):
    """All categories in one scan; some customers lose their type, so that there are some without one."""
    table = _risk(spark, sf).withColumn("cust_type", F.when(F.col("location_id") % 5 > 0, F.col("cust_type")))
    return rounded(risk.category_shares(table, _CATEGORIES, THRESHOLD))


@entry("map_cells", """
    WITH p AS (SELECT p_cutoff, (latitude + 90) / 180 AS y, (longitude + 180) / 360 AS x FROM risk),
    k AS (SELECT p_cutoff, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN array_to_string(list_transform(range(1, 17), lambda n:
              CAST((floor(y * power(2, n)) % 2) * 2 + floor(x * power(2, n)) % 2 AS INTEGER)), '') END AS path FROM p),
    n AS (SELECT path[:level] AS cell, level, count(*) AS customers, sum(p_cutoff) AS total
          FROM k, range(0, 17) r(level) WHERE path IS NOT NULL GROUP BY ALL)
    SELECT n.cell, n.level, n.customers, round(n.total / n.customers, 6) AS value
    FROM n LEFT JOIN n up ON n.level = up.level + 1 AND n.cell[:n.level - 1] = up.cell
    WHERE (n.customers <= 3 OR n.level = 16) AND coalesce(up.customers > 3, n.level = 0)
    UNION ALL SELECT NULL, NULL, count(*), round(avg(p_cutoff), 6) FROM k WHERE path IS NULL HAVING count(*) > 0""", stages.BOTH)
def _(spark, sf):
    """Cells of at most three customers; every customer is in one."""
    return rounded(risk.map_cells(_risk(spark, sf), "p_cutoff", threshold=None, limit=3).select("cell", "level", "customers", "value"))


@entry("customer_table", f"""
    SELECT meter_address, "nCutPrior", municipality, cust_type, meter_size,
           {', '.join(f'round({c}, 4) AS {c}' for c in ('p_cutoff', 'mean_charge_tot', 'mean_charge_late', 'mean_vol', 'f_late'))}
    FROM above ORDER BY above.p_cutoff DESC, location_id LIMIT 1000""", stages.BOTH)
def _(spark, sf):
    return risk.customer_table(_risk(spark, sf), THRESHOLD, limit=1000, digits=4, long_names=False)


def queries() -> dict[str, Query]:
    return {name: e.run for name, e in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in CATALOGUE.items() if e.sql is not None}
