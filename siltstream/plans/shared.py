"""Where jobs keep intermediate tables, and how they cut lineage and size broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON) up to which :func:`small` asks for a broadcast; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 24_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary one is made only where the cluster names none and is this machine alone (tests, a laptop); elsewhere that is an error.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-silt-"))
        told = sc.getCheckpointDir()
    return told.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/silt-{name}-{uuid.uuid4().hex[:12]}"


def put(df: DataFrame, path: str, codec: str = "zstd", by: str | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` to ``path``, in a folder for each value of the column ``by``, and read it back.

    tidy: the shuffle files that writing took are removed once the table is whole, not when Spark next collects garbage.
    """
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    if tidy:
        spark.conf.set(name, "true")
    try:
        df.write.option("compression", codec).parquet(path, partitionBy=by)
    finally:
        if tidy:
            spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` to a folder of its own in the shared one and read it back (``put``).

    Lost executors then cost no recomputation of what went before, and values that
    depend on the order of rows (generated ids) stay as they were written.
    """
    return put(df, scratch(df.sparkSession, name), codec, by)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if an aggregation finds at most so many rows and bytes, else as it is.

    Without the hint Spark joins by a shuffle, splitting hot keys (adaptive skew join).
    """
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
