"""Saved tables and their manifest."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.operators import clean
from ebbline.sources import tables as src
from ebbline.sources.warehouse import new_folder

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("size", T.DoubleType()),
    T.StructField("at", T.TimestampNTZType()), T.StructField("n", T.IntegerType()),
])
ROWS = [
    (1, "a", 1.5, dt.datetime(2000, 1, 2, 3, 4, 5), 1), (2, None, None, None, None), (3, "x, \"y\"", -0.0, dt.datetime(1999, 12, 31), 0),
    (3, "x, \"y\"", 0.1 + 0.2, dt.datetime(1999, 12, 31), 0),
]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv"])
def test_a_manifest_finds_what_was_changed(spark, fmt):
    folder = new_folder(spark, "tables")
    given = {"one": spark.createDataFrame(ROWS, SCHEMA), "two": spark.createDataFrame([], SCHEMA)}
    src.save_tables(given, folder, fmt)
    schemas = {"one": SCHEMA, "two": SCHEMA}
    read = src.read_tables(spark, folder, schemas, fmt, verify=True)
    assert read["one"].count() == 4 and read["two"].count() == 0
    manifest = spark.read.parquet(f"{folder}/{src.MANIFEST}")
    assert src.differing_columns({"one": given["one"].repartition(3, "id")}, manifest) == []
    moved = given["one"].withColumn("size", F.when(F.col("id") == 1, 1.25).otherwise(F.col("size")))
    assert src.differing_columns({"one": moved}, manifest) == ["one.*", "one.size"]
    swapped = given["one"].withColumn("name", F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 2, F.lit("a")).otherwise(F.col("name")))
    assert src.differing_columns({"one": swapped}, manifest) == ["one.*"]  # the same values in other rows
    assert src.differing_columns({"two": given["one"]}, manifest)
    src.save_tables({"one": moved}, f"{folder}-b", fmt)
    manifest.write.mode("overwrite").parquet(f"{folder}-b/{src.MANIFEST}")
    with pytest.raises(ValueError, match="one.size"):
        src.read_tables(spark, f"{folder}-b", {"one": SCHEMA}, fmt, verify=True)


def test_the_best_entry_is_found_for_spoiled_addresses(spark):
    gazetteer = spark.createDataFrame([("12 Main St", 1.0, 1.0), ("12 Main St", 0.5, 9.0), ("13 Main St", 2.0, 2.0), ("7 Oak Rd", 3.0, 3.0), ("", 4.0, 4.0)],
                                      "address_key string, latitude double, longitude double")
    asked = ["12 Main St12345", "12 MAIN, st.12345", "12 Man St12345", "1 Main St12345", "7 Oak Road12345", "12345", None, "7  oak rd!12345"]
    location = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "location_id int, meter_address string")
    got = {r["location_id"]: (r["latitude"], r["geocode_step"]) for r in clean.geocode_best(location, gazetteer).collect()}
    assert got == {0: (0.5, 0), 1: (0.5, 1), 2: (0.5, 2), 3: (0.5, 2), 4: (None, None), 5: (4.0, 0), 6: (None, None), 7: (3.0, 1)}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv"])
def test_a_manifest_is_of_the_rows_that_were_written(spark, fmt):
    """Rows that come out otherwise when they are computed again, as sums of doubles in another order do."""
    folder, drawn = new_folder(spark, "tables"), F.udf(lambda: int.from_bytes(os.urandom(6)) / 2**48, "double").asNondeterministic()
    given = spark.range(50, numPartitions=4).select("id", F.lit("x").alias("name"), drawn().alias("size"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(1).alias("n"))
    src.save_tables({"one": given}, folder, fmt)
    read = src.read_tables(spark, folder, {"one": SCHEMA}, fmt, verify=True)["one"]
    assert read.count() == 50
    manifest = spark.read.parquet(f"{folder}/{src.MANIFEST}").filter("column_name = 'at'").first()
    assert (manifest["n_rows"], manifest["n_null"]) == (50, 50)
