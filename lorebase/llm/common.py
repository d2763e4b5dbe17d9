"""What the training-data operators share: columns kept apart, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.workers import shared_dir

#: White space of the word contracts: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Holds a caller's whole row, so that its columns never clash with an operator's own.
ROW = "_lorebase_row"


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/lorebase/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it does when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(df: DataFrame, what: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back.

    This cuts lineage, so a lost executor costs no more than the tasks it ran, and gives the optimizer the
    size of what was written.
    """
    spark = df.sparkSession
    path, schema = new_path(spark, what), df.schema
    release(spark)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``table`` wrote, once all that was made of it has been written in turn."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text that a worker takes in hand at once.
SLICE = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices with about ``most`` bytes of a text column, one row at least.

    Spark cuts batches by rows; a slice bounds what a worker makes of long texts.
    """
    for batch in batches:
        text = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist() if batch.num_rows else []
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task that gives its memory back when it ends, since Spark keeps its workers for later tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a C library without it keeps what it has
            if trim:
                trim(0)

    return task


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words between white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
