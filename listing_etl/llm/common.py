"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from listing_etl.session import configure, scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session defaults, and the package on the Python path of the executors."""
    configure(spark)
    ship_package(spark)


def staged(df: DataFrame, name: str, rows_per_file: int = 0, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and
    survives the loss of any executor. ``rows_per_file``: at most so many (0: any number), for
    rows of megabytes, of which a reader holds a file's first thousands at once. ``codec``: zstd
    takes less room for whole texts."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``max_bytes`` (one row at least):
    the memory of a task follows the longest row, not the number of rows in a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * max_bytes / max(1, b.get_total_buffer_size())))
        at = 0
        while at < b.num_rows:
            part = b.slice(at, step)
            # a slice of uneven rows may still be large: halve it until it fits or is one row
            while part.num_rows > 1 and part.nbytes > 4 * max_bytes:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def append_columns(df: DataFrame, fields: str) -> T.StructType:
    """Schema of ``df`` with more columns behind its own (for mapInArrow)."""
    extra = T.StructType.fromDDL(fields)
    return T.StructType(list(df.schema.fields) + list(extra.fields))
