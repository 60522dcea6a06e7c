"""Tables, intermediate results and batch helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files of a written table are of no more use once it is written.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session
    names none and runs on one machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost
    executor costs a read of it.  The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, bucket: str) -> DataFrame:
    """Partition by a bucket number below ``partitions``, which is the partition."""
    return df.repartitionById(partitions(df.sparkSession), F.col(bucket))


#: Rows of long texts in an Arrow batch; Spark's own number suits short rows.
BATCH_ROWS, USUAL_ROWS = "1000", "10000"


def small_batches(spark: SparkSession) -> None:
    """Whole texts cross to Python in batches of fewer rows from now on, unless
    the session has a number of its own: batches lie outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, USUAL_ROWS) == USUAL_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def regroup(batches, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``limit`` bytes of a string column."""
    held, size = [], 0
    for batch in batches:
        for i, j, data, _ in slices(batch.column(column), limit):
            held.append(batch.slice(i, j - i))
            size += len(data)
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column with about ``limit`` bytes of text at
    most: first row, end row, bytes, and offsets into them.  A null is empty.
    One longer text is a run of its own, whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    buffers = column.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(buffers[1], wide)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
