"""Streaming jobs: sessions kept up to date, alerts, hourly activity (ST1 to ST8)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators import sessions as S
from siltstream.plans.shared import drop
from siltstream.sources.log import split_rejects, stream_events, typed_events

TABLES = ["sessions", *S.CAPS]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


class Store:
    """Versioned Parquet tables: every batch writes new ones and then a file that names the version and the batch, so a repeated batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self) -> list[tuple[int, str]]:
        """(version, batch) of all that was written as a whole."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName().split("-", 2) for s in fs.listStatus(root)]
        return [(int(n[1]), n[2] if len(n) > 2 else n[1]) for n in names if n[0] == "_done"]

    def version(self) -> int:
        """The newest version that was written as a whole."""
        return max([v for v, _ in self._done()], default=-1)

    def read(self) -> dict[str, DataFrame]:
        v = self.version()
        return {} if v < 0 else {t: self.spark.read.parquet(f"{self.path}/v{v}/{t}") for t in TABLES}

    def write(self, tables: dict[str, DataFrame], batch: str) -> None:
        before = self.version()
        version = before + 1
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        jvm = self.spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_done-{version}-{batch}")
        done.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(done, True).close()
        for old in range(max(0, before - 1), before):
            drop(self.spark, f"{self.path}/v{old}")

    def merge(self, batch: dict[str, DataFrame], name: str | int) -> None:
        """Add a batch's tables, unless a batch of this name was added; pieces of a session may come in any order and arbitrarily late.

        One writer at a time. Numbers of batches begin anew with every checkpoint, so their names must say of which query they are.
        """
        if str(name) in {b for _, b in self._done()}:
            return None
        old = self.read()
        if not old:
            return self.write(batch, str(name))
        out = {"sessions": S.merge_sessions(old["sessions"], batch["sessions"])}
        out |= {n: S.merge_children(old[n], batch[n], n) for n in S.CAPS}
        return self.write(out, str(name))


def ingest_stream(spark: SparkSession, path: str, store: Store, checkpoint: str, after: Callable[[DataFrame], None] | None = None):
    """A query that keeps ``store`` up to date with the logs below ``path``; ``after`` gets each batch's touched session ids."""

    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]  # a checkpoint's batches are one sequence

    def batch(lines: DataFrame, number: int) -> None:
        lines = lines.withColumn("ord", F.struct(F.col("ord.file_path"), F.col("ord.file_block_start"), F.monotonically_increasing_id().alias("n")))
        events, rejects = split_rejects(typed_events(lines))
        events.persist()
        rejects.write.mode("overwrite").parquet(f"{store.path}/rejects/batch={query}-{number}")
        store.merge(S.store_events(events), f"{query}-{number}")
        if after is not None:
            after(events.select("session").distinct())
        events.unpersist()

    return stream_events(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events once each, with state that the watermark bounds: for input that is delivered at least once (ST2)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "ts", "eventid", "input", "url", "shasum"])


def burst_counts(events: DataFrame, seconds: int = 120, slide: int = 10, least: int = 3, delay: str = "10 minutes") -> DataFrame:
    """Failed logins of a source in sliding windows (ST5)."""
    failed = events.where("eventid = 'cowrie.login.failed'").withWatermark("ts", delay)
    n = failed.groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), "src_ip").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "src_ip", "n")


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Connections per hour, live (ST6)."""
    first = events.where("eventid = 'cowrie.session.connect'").withWatermark("ts", delay)
    return first.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("sessions")).select(F.col("window.start").alias("hour"), "sessions")


def regroup_due(store: Store, built: int) -> bool:
    """Whether new data has come since campaigns were built from version ``built`` (ST8)."""
    return store.version() > built
