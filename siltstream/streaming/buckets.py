"""Tables that streams keep up to date, in folders of buckets: a batch rewrites the buckets of its rows and no other file."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.plans.shared import drop


class Part(NamedTuple):
    """The new content of some buckets: all rows that they shall hold, the column that tells a row's bucket, the buckets."""

    rows: DataFrame
    key: str
    buckets: Iterable[int]


class Buckets:
    """Parquet tables, each partitioned by a hash of its key column into ``count`` buckets.

    New content is first written beside the tables and only then put in place of the old buckets (dynamic partition
    overwrite), for all tables of a batch. A writer that starts and finds such content whole puts it in place again, so that a
    failure between the two loses nothing. One writer at a time; readers see all tables of one batch between batches.
    """

    def __init__(self, spark: SparkSession, path: str, count: int = 64):
        self.spark, self.path, self.count = spark, path.rstrip("/"), count
        self.waiting = f"{self.path}/_waiting"
        if self._there(f"{self.waiting}/_whole"):
            self._place()
        elif self._there(self.waiting):
            drop(spark, self.waiting)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets of rows: at most ``count`` numbers."""
        return sorted(r[0] for r in rows.select(self.of(key)).distinct().collect())

    def read(self, name: str, like: DataFrame | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or only some of its buckets; where there is none yet, an empty one with the columns of ``like``."""
        path = f"{self.path}/{name}"
        if not self._there(path):
            if like is None:
                raise FileNotFoundError(path)
            return like.limit(0)
        d = self.spark.read.parquet(path).where("_row")
        if buckets is not None:
            d = d.where(F.col("_bucket").isin(list(buckets)))  # other buckets are not read
        return d.drop("_bucket", "_row")

    def write(self, parts: dict[str, Part]) -> dict[str, DataFrame]:
        """Write new content of buckets beside the tables; as written, to go on with."""
        out = {}
        for name, (rows, key, buckets) in parts.items():
            own = rows.withColumns({"_bucket": self.of(key), "_row": F.lit(True)})
            # a row that is none for each bucket: a bucket that has no rows any more is replaced too
            empty = self.spark.createDataFrame([(b, False) for b in buckets], "_bucket int, _row boolean")
            path = f"{self.waiting}/{name}"
            own.unionByName(empty, allowMissingColumns=True).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
            out[name] = self.spark.read.parquet(path).where("_row").drop("_bucket", "_row")
        return out

    def commit(self) -> None:
        """Put what was written in place of the old buckets."""
        p, fs = self._path(f"{self.waiting}/_whole")
        fs.create(p, True).close()
        self._place()

    def _place(self) -> None:
        p, fs = self._path(self.waiting)
        for name in [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]:
            new = self.spark.read.parquet(f"{self.waiting}/{name}").repartition("_bucket")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/{name}")
        drop(self.spark, self.waiting)


def only(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is among ``ids`` (id), or with left_anti is not."""
    return rows.join(ids.select(F.col("id").alias("_id")), F.col(key) == F.col("_id"), how)


def united(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
