"""Helpers shared by the text operators: byte-bounded Arrow work, reading tables, the held-out fold."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.sources.warehouse import new_folder, store

#: Bytes of text that a task hands to one call of an operator's helper.
GROUP_BYTES = 4 << 20

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

__all__ = ["batch_rows", "GROUP_BYTES", "byte_groups", "fresh", "held_out", "map_texts", "new_folder", "ship_package", "store", "table"]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, which a cluster need not have installed; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="ebbline-code-")  # the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    if spark.conf.get(BATCH) == "10000":  # Spark's default; texts can be long
        spark.conf.set(BATCH, "1000")
    _shipped.add(context.applicationId)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of the table is called so in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows of the test fold: crc32 of the id as text leaves no remainder by five (a null id is in it)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def byte_groups(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` bytes of text; a longer text has a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame, keep: Sequence[str], text: str, fields: str,
    make: Callable[[], Callable[[list[str | None]], Sequence]], group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """The kept columns and those that ``make()(texts)`` returns, one value per text, in order.

    ``make`` runs once in a task.  A kept column with the name of a result gives way to the result.
    A kept text travels once.
    """
    ship_package(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    keep = [c for c in keep if c not in new.names]
    given = text in keep and isinstance(df.schema[text].dataType, T.StringType)
    (name,) = fresh(df, "text")
    source = df.select(*keep) if given else df.select(*keep, F.col(text).cast("string").alias(name))
    schema = T.StructType([*source.schema.fields[: len(keep)], *new.fields])
    kinds, at = [pa_type(f.dataType) for f in new.fields], keep.index(text) if given else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in byte_groups(batch, at, group_bytes):
                columns = work(part.column(at).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *arrays], names=schema.names)

    return source.mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
