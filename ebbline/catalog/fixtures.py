"""The six domain tables derived from the order tables, in SQL both engines understand.

A supplier stands for a service location: it has line items in nearly every month, so
their monthly totals make realistic meter and billing series.  Gaps, invalid readings,
outliers, open and duplicate occupancies and missing keys come from arithmetic on ids.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# {TS} is the name of the timestamp type without zone.
FIXTURES: dict[str, str] = {
    "monthly": """
        SELECT location_id, mi, max(l_shipdate) AS d, sum(l_quantity) AS q,
               round(sum(l_extendedprice * (1 - l_discount)) / 1000, 2) AS p,
               max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08
                        THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS late
        FROM (SELECT l_suppkey + 1 AS location_id,
                     CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS mi,
                     l_shipdate, l_quantity, l_extendedprice, l_discount, l_returnflag
              FROM lineitem) AS li
        GROUP BY location_id, mi""",
    "volume": """
        SELECT location_id, location_id * 10 AS meter_id, location_id * 1000 + mi AS charge_id,
               d AS meter_read_at,
               CASE WHEN (location_id * 3 + mi) % 53 = 0 THEN CAST(NULL AS DOUBLE)
                    WHEN (location_id * 7 + mi) % 41 = 0 THEN CAST(-1 AS DOUBLE)
                    WHEN (location_id + mi) % 13 = 0 THEN CAST(0 AS DOUBLE)
                    WHEN location_id % 10 = 1 AND mi = 30 THEN q * 200
                    ELSE q END AS volume_kgals,
               'kgal' AS volume_unit, 'N' AS unbilled
        FROM monthly WHERE (location_id + mi * 5) % 19 <> 0""",
    "charge": """
        SELECT location_id * 1000 + mi AS charge_id,
               'B-' || CAST(location_id * 1000 + mi AS STRING) AS cis_bill_id,
               location_id, d AS billing_period_end,
               CAST(8 AS DOUBLE) AS base_charge, p AS vol_charge,
               CASE WHEN (location_id + mi) % 37 = 0 THEN CAST(NULL AS DOUBLE) ELSE p END
                   AS total_charge,
               CASE WHEN (location_id * 5 + mi) % 29 = 0 THEN CAST(NULL AS DOUBLE) ELSE late END
                   AS late_charge,
               CAST(0 AS DOUBLE) AS tampering_charge
        FROM monthly WHERE (location_id * 3 + mi) % 23 <> 0""",
    "cutoffs": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey + 1 AS location_id,
               CASE WHEN (l_suppkey + 1) % 4 = 0
                         AND l_shipdate > CAST('1998-06-30 00:00:00' AS {TS})
                    THEN 2 ELSE 1 END AS cis_occupant_id,
               l_shipdate AS cutoff_at
        FROM lineitem
        WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_discount >= 0.07
              AND (l_suppkey + 1) % 2 = 0""",
    "occupant": """
        SELECT s_suppkey + 1 AS location_id, 1 AS cis_occupant_id,
               CAST(NULL AS {TS}) AS move_in_date,
               CASE WHEN (s_suppkey + 1) % 4 = 0 THEN CAST('1998-06-30 00:00:00' AS {TS}) END
                   AS move_out_date,
               CASE WHEN (s_suppkey + 1) % 50 = 3 THEN 2 ELSE 1 END AS data_set_id
        FROM supplier WHERE (s_suppkey + 1) % 10 <> 9
        UNION ALL
        SELECT s_suppkey + 1, 2, CAST('1998-07-01 00:00:00' AS {TS}), CAST(NULL AS {TS}),
               CASE WHEN (s_suppkey + 1) % 50 = 3 THEN 2 ELSE 1 END
        FROM supplier WHERE (s_suppkey + 1) % 4 = 0
        UNION ALL
        SELECT s_suppkey + 1, 2, CAST('1998-07-01 00:00:00' AS {TS}),
               CAST('2001-12-31 00:00:00' AS {TS}),
               CASE WHEN (s_suppkey + 1) % 50 = 3 THEN 2 ELSE 1 END
        FROM supplier WHERE (s_suppkey + 1) % 8 = 0""",
    "location": """
        SELECT s_suppkey + 1 AS location_id,
               s_name || ', ' || n_name || ' ' || CAST(10000 + s_suppkey % 90000 AS STRING)
                   AS meter_address,
               s_nationkey AS municipality,
               'S' || CAST(s_suppkey % 7 AS STRING) AS subdivision,
               'R' || CAST(s_suppkey % 11 AS STRING) AS route,
               CAST(s_suppkey % 5 AS INT) AS aggregate_cust_type_code,
               CASE WHEN (s_suppkey + 1) % 50 = 3 THEN 2 ELSE 1 END AS data_set_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE (s_suppkey + 1) % 25 <> 7""",
    "meter": """
        SELECT (s_suppkey + 1) * 10 AS meter_id,
               'C-' || CAST(s_suppkey + 1 AS STRING) AS cis_cust_id,
               'L-' || CAST(s_suppkey + 1 AS STRING) AS cis_location_id,
               s_suppkey + 1 AS location_id,
               r_name AS cust_type, r_regionkey AS cust_type_code, 'water' AS meter_type,
               CAST(0.625 + (s_suppkey % 4) * 0.125 AS DOUBLE) AS meter_size,
               'in' AS meter_size_units, CAST(0.25 AS DOUBLE) AS meter_size_lowflow,
               1 AS num_units,
               CASE WHEN (s_suppkey + 1) % 50 = 3 THEN 2 ELSE 1 END AS data_set_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey
        WHERE (s_suppkey + 1) % 25 <> 0""",
    "geocode": """
        SELECT s_name || ', ' || n_name || ' ' AS address_key,
               CAST(33 + (s_suppkey % 100) / CAST(100 AS DOUBLE) AS DOUBLE) AS latitude,
               CAST(-84 - (s_suppkey % 90) / CAST(100 AS DOUBLE) AS DOUBLE) AS longitude
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE (s_suppkey + 1) % 25 <> 7""",
}

TRAIN_REF = "2000-06-30"
PREDICT_REF = "2000-12-31"


_LONG, _INT, _DOUBLE, _STR = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
# The columns used, so that no file is opened to infer a schema.
SOURCES: dict[str, dict[str, T.DataType]] = {
    "lineitem": {
        "l_orderkey": _LONG, "l_suppkey": _LONG, "l_linenumber": _INT, "l_quantity": _DOUBLE,
        "l_extendedprice": _DOUBLE, "l_discount": _DOUBLE, "l_returnflag": _STR,
        "l_shipdate": T.TimestampNTZType(),
    },
    "supplier": {"s_suppkey": _LONG, "s_name": _STR, "s_nationkey": _INT},
    "nation": {"n_nationkey": _INT, "n_name": _STR, "n_regionkey": _INT},
    "region": {"r_regionkey": _INT, "r_name": _STR},
}


class FixtureTables(Mapping):
    """Fixture tables by name, each planned when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _source(self, name: str) -> DataFrame:
        schema = T.StructType([T.StructField(c, k) for c, k in SOURCES[name].items()])
        return self.spark.read.schema(schema).parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        sql = FIXTURES[name].format(TS="TIMESTAMP_NTZ")
        sql = sql.replace("FROM monthly", f"FROM ({FIXTURES['monthly']}) AS monthly")
        used = {s for s in SOURCES if re.search(rf"\b(FROM|JOIN) {s}\b", sql)}
        for source in used:
            sql = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {{{source}}} AS {source}", sql)
        return self.spark.sql(sql, **{s: self._source(s) for s in used})

    def __iter__(self):
        return (name for name in FIXTURES if name != "monthly")

    def __len__(self) -> int:
        return len(FIXTURES) - 1


def fixture_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """All fixture tables, lazily derived from the Parquet files."""
    return FixtureTables(spark, sf_dir)
