"""Feature, prediction and model-run tables on shared storage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE_PARTITIONS = ["mode", "ref_date", "n_samples"]


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for cut-off lineage, ``spark.checkpoint.dir``.

    Where it is unset a session without executors of its own (``local[...]``) gets a temporary
    folder that goes with the process; on a cluster it must be set, since a folder of one machine is
    out of reach for the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="ebbline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a stage and reopen it: short lineage, and any executor can be lost afterwards."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_feature_table(features: DataFrame, folder: str, mode: str, ref_date: str) -> None:
    """Replace the partitions (mode, ref_date, n_samples) the rows belong to, and no others.

    A rebalance by length keeps the number of files down; it splits a large partition over
    several tasks, where a plain repartition would not.
    """
    rows = features.withColumns({"mode": F.lit(mode), "ref_date": F.lit(ref_date)})
    (
        rows.hint("rebalance", "n_samples")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*FEATURE_PARTITIONS)
        .parquet(folder)
    )


def read_feature_table(
    spark: SparkSession, folder: str, mode: str, ref_date: str, n_samples: int
) -> DataFrame:
    """One feature table; only its partition is read."""
    rows = spark.read.parquet(folder).filter(
        (F.col("mode") == mode)
        & (F.col("ref_date").cast("string") == ref_date)
        & (F.col("n_samples") == n_samples)
    )
    return rows.drop("mode", "ref_date")


def write_predictions(scored: DataFrame, folder: str, run_id: str, subset: str) -> None:
    """Probabilities keyed by (customer, segment, window), one partition per run and subset."""
    (
        scored.select("occupant_id", "segment", "window", "p_cutoff")
        .withColumns({"run_id": F.lit(run_id), "subset": F.lit(subset)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "subset")
        .parquet(folder)
    )


def read_predictions(spark: SparkSession, folder: str, run_id: str, subset: str) -> DataFrame:
    return (
        spark.read.parquet(folder)
        .filter((F.col("run_id") == run_id) & (F.col("subset") == subset))
        .drop("run_id", "subset")
    )


def write_by_run(rows: DataFrame, folder: str) -> None:
    """Statistics or coefficients of one or more runs; a run written again replaces itself."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(folder)
    )


def read_if_there(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows where nothing was written yet."""
    try:
        return spark.read.parquet(folder).select(*schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


SWEEPS = T.StructType([T.StructField("sweep_id", T.StringType()), T.StructField("options", T.StringType()), T.StructField("number", T.LongType())])


def commit_sweep(spark: SparkSession, folder: str, sweep_id: str, options: str) -> None:
    """Make a complete sweep the last one of its options."""
    number = (read_if_there(spark, folder, SWEEPS).agg(F.max("number")).first()[0] or 0) + 1
    row = spark.createDataFrame([(sweep_id, options, number)], SWEEPS)
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sweep_id").parquet(folder)


def is_committed(spark: SparkSession, folder: str, sweep_id: str) -> bool:
    return not read_if_there(spark, folder, SWEEPS).filter(F.col("sweep_id") == sweep_id).isEmpty()


def last_sweep(spark: SparkSession, folder: str, options: str) -> str | None:
    rows = read_if_there(spark, folder, SWEEPS).filter(F.col("options") == options)
    return rows.agg(F.max_by("sweep_id", "number")).first()[0]


def best_of(table: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of a per-run table that belong to the best run of each option set."""
    return table.join(runs.filter("is_best").select("run_id"), "run_id", "left_semi")
