"""The log's tables in folders by day: windows read only their days, retention drops whole days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators.retention import PER_SESSION
from siltstream.plans.shared import drop, stage

DAY = "_day"


def write_by_day(tables: dict[str, DataFrame], path: str) -> None:
    """Write sessions by the day of their later time and all that hangs on them into the same day; sessions without a time into none.

    A child row without a session has no day either.
    """
    day = F.to_date(F.greatest("end_time", "start_time"))
    sessions = stage(tables["sessions"].withColumn(DAY, day), "dated")
    days = sessions.select(F.col("id").alias("_id"), DAY)
    for name, t in tables.items():
        if name != "sessions" and name not in PER_SESSION:
            continue
        rows = sessions if name == "sessions" else t.join(days, t["session_id"] == F.col("_id"), "left").drop("_id")
        rows.repartition(DAY).write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/{name}")


def read_days(spark: SparkSession, path: str, name: str, since: dt.datetime | None = None) -> DataFrame:
    """One of the tables. With ``since``: sessions that began then or later, or rows of sessions whose day allows it; other days' files aren't read."""
    t = spark.read.parquet(f"{path}/{name}")
    if since is None:
        return t.drop(DAY)
    t = t.where(F.col(DAY) >= F.lit(since.date()))
    return (t.where(F.col("start_time") >= F.lit(since)) if name == "sessions" else t).drop(DAY)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def prune_days(spark: SparkSession, path: str, cut: dt.datetime) -> dict[str, list[str]]:
    """Take old sessions and their rows away: whole days before the cut are dropped unread, and the days that hold other old sessions rewritten.

    Old is what :func:`siltstream.operators.retention.old_sessions` calls old: ended, or else begun, before ``cut``. The other days are
    that of the cut, and days of sessions that end before they begin. The folders dropped and the days rewritten.
    """
    sessions = spark.read.parquet(f"{path}/sessions")
    old = sessions.where((F.col(DAY) >= F.lit(cut.date())) & (F.coalesce("end_time", "start_time") < F.lit(cut))).select(F.col("id").alias("_id"), DAY)
    old = stage(old, "old")
    days = [r[0] for r in old.select(DAY).distinct().collect()]  # the cut's day, seldom more
    done = {"dropped": [], "rewritten": sorted(map(str, days))}
    for name in [n for n in _names(spark, path) if n == "sessions" or n in PER_SESSION]:
        if days:
            own = spark.read.parquet(f"{path}/{name}").where(F.col(DAY).isin(days))
            left = own.join(old.select("_id"), own["id" if name == "sessions" else "session_id"] == F.col("_id"), "left_anti")
            left = stage(left, "left")
            left.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{path}/{name}")
            kept = {r[0] for r in left.select(DAY).distinct().collect()}
            for day in set(days) - kept:
                drop(spark, f"{path}/{name}/{DAY}={day}")
        for folder in _names(spark, f"{path}/{name}"):
            value = folder.removeprefix(f"{DAY}=")
            if folder.startswith(f"{DAY}=") and value < str(cut.date()):  # what has no day sorts after all days
                drop(spark, f"{path}/{name}/{folder}")
                done["dropped"].append(f"{name}/{folder}")
    return done
