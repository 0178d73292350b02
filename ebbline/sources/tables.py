"""Opening, projecting, joining and saving the six input tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.columns import canonical_text, md5_number, null_for_nan
from ebbline.schemas import CHARGE, CUTOFFS, LOCATION, METER, OCCUPANT, TABLES
from ebbline.sources.warehouse import new_folder, store


def open_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A stored table with an explicit schema (no inference) and NULL for NaN.

    A CSV cell that does not parse stops the read instead of becoming NULL.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return null_for_nan(reader.format(fmt).load(path))


def open_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower: str | int | None = None,
    upper: str | int | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A database table.  Projections and the data-set filter are pushed to the database.

    With a partition column the table is read in ``partitions`` parallel stripes.
    """
    reader = (
        spark.read.format("jdbc")
        .option("url", url).option("dbtable", table)
        .option("fetchsize", fetch_size)
        .option("preferTimestampNTZ", True)
        .options(**(properties or {}))
    )
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower).option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return null_for_nan(reader.load())


def _project(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def _in_data_set(df: DataFrame, data_set_id: int) -> DataFrame:
    return df.filter(F.col("data_set_id") == data_set_id)


def scan_meter(meter: DataFrame, data_set_id: int) -> DataFrame:
    return _project(_in_data_set(meter, data_set_id), METER)


def scan_location(location: DataFrame, data_set_id: int) -> DataFrame:
    return _project(_in_data_set(location, data_set_id), LOCATION)


def scan_occupant(occupant: DataFrame, data_set_id: int) -> DataFrame:
    return _project(_in_data_set(occupant, data_set_id), OCCUPANT)


def _locations(location: DataFrame, data_set_id: int) -> DataFrame:
    return _in_data_set(location, data_set_id).select("location_id")


def volume_source(
    location: DataFrame, meter: DataFrame, volume: DataFrame, data_set_id: int
) -> DataFrame:
    """Readings of the meters at the data set's locations."""
    readings = volume.select(
        "meter_id", "charge_id", "meter_read_at", "volume_kgals", "volume_unit", "unbilled"
    )
    meters = _locations(location, data_set_id).join(
        meter.select("location_id", "meter_id"), "location_id"
    )
    return readings.join(meters, "meter_id").select(
        "location_id", "meter_id", "charge_id", "meter_read_at", "volume_kgals",
        "volume_unit", "unbilled",
    )


def charge_source(location: DataFrame, charge: DataFrame, data_set_id: int) -> DataFrame:
    """Charges at the data set's locations."""
    return _project(charge.join(_locations(location, data_set_id), "location_id"), CHARGE)


def cutoffs_source(location: DataFrame, cutoffs: DataFrame, data_set_id: int) -> DataFrame:
    """Cutoffs at the data set's locations."""
    return _project(cutoffs.join(_locations(location, data_set_id), "location_id"), CUTOFFS)


def fetch_tables(raw: dict[str, DataFrame], data_set_id: int) -> dict[str, DataFrame]:
    """The six working tables of one data set."""
    location = raw["location"]
    return {
        "meter": scan_meter(raw["meter"], data_set_id),
        "location": scan_location(location, data_set_id),
        "occupant": scan_occupant(raw["occupant"], data_set_id),
        "volume": volume_source(location, raw["meter"], raw["volume"], data_set_id),
        "charge": charge_source(location, raw["charge"], data_set_id),
        "cutoffs": cutoffs_source(location, raw["cutoffs"], data_set_id),
    }


MANIFEST = "manifest"
MANIFEST_SCHEMA = "table_name string, column_name string, n_rows bigint, n_null bigint, digest_a bigint, digest_b bigint"


def content_digests(df: DataFrame, name: str) -> DataFrame:
    """A row per column: rows, NULLs and two sums of hashed values, equal for equal contents in any order.

    One aggregation over the table; a row of the whole table (column_name '') tells whether values
    stand in the same rows.
    """
    texts = {c: canonical_text(df, c) for c in df.columns}
    texts[""] = f"concat_ws('|', {', '.join(texts.values())})" if texts else "''"
    cells = []
    for k, (c, text) in enumerate(texts.items()):
        nulls = F.count_if(F.col(f"`{c}`").isNull()) if c else F.lit(0).cast("bigint")
        cells.append(F.struct(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_null"),
            F.coalesce(F.sum(md5_number(text)), F.lit(0)).cast("bigint").alias("digest_a"),
            F.coalesce(F.sum(md5_number(text, 1)), F.lit(0)).cast("bigint").alias("digest_b"),
        ).alias(f"c{k}"))
    return df.agg(*cells).select(F.inline(F.array(*[f"c{k}" for k in range(len(cells))])))


def digests_of(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [content_digests(df, name) for name, df in tables.items()])


def save_tables(tables: dict[str, DataFrame], outdir: str, fmt: str = "parquet") -> None:
    """One folder per table; ``fmt`` is parquet, orc or csv (with a header).

    A manifest with the digests of every column is written when all tables are.  Rows are stored once and both
    come from there: computed again, rows can differ (sums of doubles follow the order of arrival).
    """
    folder, kept = None, {}
    for name, df in tables.items():
        folder = folder or new_folder(df.sparkSession, "saved")
        kept[name] = store(df, folder, name)
        writer = kept[name].write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{outdir}/{name}")
    digests_of(kept).coalesce(1).write.mode("overwrite").parquet(f"{outdir}/{MANIFEST}")


def differing_columns(stored: dict[str, DataFrame], manifest: DataFrame) -> list[str]:
    """``table.column`` wherever the stored contents are not those of the manifest."""
    key, values = ["table_name", "column_name"], ["n_rows", "n_null", "digest_a", "digest_b"]
    found = digests_of(stored).select(*key, F.struct(*values).alias("found"))
    wanted = manifest.filter(F.col("table_name").isin(list(stored))).select(*key, F.struct(*values).alias("wanted"))
    differ = found.join(wanted, key, "full").filter(~F.col("found").eqNullSafe(F.col("wanted")))
    return sorted(f"{r['table_name']}.{r['column_name'] or '*'}" for r in differ.select(*key).collect())  # a row per column at most


def read_tables(
    spark: SparkSession,
    indir: str,
    schemas: dict[str, T.StructType] | None = None,
    fmt: str = "parquet",
    names: Sequence[str] | None = None,
    verify: bool = False,
) -> dict[str, DataFrame]:
    """Saved tables; with ``verify`` their contents are held against the manifest (one scan) and a difference raises."""
    schemas = schemas or TABLES
    tables = {
        name: open_table(spark, f"{indir}/{name}", schemas[name], fmt)
        for name in (names or schemas)
    }
    if verify:
        differ = differing_columns(tables, spark.read.schema(MANIFEST_SCHEMA).parquet(f"{indir}/{MANIFEST}"))
        if differ:
            raise ValueError(f"stored contents differ from the manifest: {', '.join(differ)}")
    return tables
