"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark reads only Unicode and Latin charsets unless this is on; GBK files need it.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    folder = os.environ.get("TIDEMARK_CHECKPOINTS") or tempfile.mkdtemp(prefix="spark-")
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
               .config("spark.checkpoint.dir", folder)
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; one without it
    is refused unless it is local, where a folder is made and kept."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, so
    that iterative jobs keep short plans, later joins know its size and prune
    its columns, and a lost executor costs a re-read, not a replay of every
    earlier round.  The files are removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


# Rows of one task of :func:`spread_rows`; its operators hold about a hundred bytes of each, several of them at a time.
TASK_ROWS = 200_000


def spread_rows(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """Partition by ``keys`` into tasks of about ``TASK_ROWS`` of the ``n_rows`` rows.

    The number of tasks grows with the input and the memory of one does not,
    where the adaptive coalescing makes a fixed number of larger tasks.  Later
    windows and aggregations on the keys need no further shuffle."""
    return df.repartition(max(-(-n_rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` into a fixed number of tasks.

    Rows handed to numeric helpers are few bytes but long work, so the adaptive
    size-based coalescing would pile them into one task; an explicit count is
    left alone.  A following aggregation on the keys needs no further shuffle."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
