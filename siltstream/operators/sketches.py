"""Distinct counts of any window, exact from the days' values or estimated from sketches of its days (A3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: a relative standard error of 1.04 / sqrt(2 ** 14), or 0.8 %; up to some thousand values are counted exactly.
REGISTERS = 14


def daily_sketches(tables: dict[str, DataFrame], registers: int = REGISTERS) -> DataFrame:
    """(day, sessions, sources, files): of the real sessions that began on each day their number and sketches of addresses and hashes.

    A day is some kilobytes whatever its sessions; days that are written stay as they are when new ones come. Sessions without a start
    have a null day.
    """
    s = tables["sessions"].where(~F.col("internal")).select("id", F.to_date("start_time").alias("day"), "src_ip")
    own = s.groupBy("day").agg(F.count(F.lit(1)).alias("sessions"), F.hll_sketch_agg("src_ip", F.lit(registers)).alias("sources"))
    both = tables["downloads"].select("session_id", "sha256").unionByName(tables["uploads"].select("session_id", "sha256"))
    files = both.join(s.select("id", "day"), F.col("session_id") == F.col("id")).groupBy("day").agg(F.hll_sketch_agg("sha256", F.lit(registers)).alias("files"))
    files = files.withColumnRenamed("day", "_day")
    return own.join(files, F.col("day").eqNullSafe(F.col("_day")), "left").drop("_day")


def window_totals(sketches: DataFrame, last: dt.date, days: list[int]) -> DataFrame:
    """(days, sessions, sources, files): of the windows of so many days up to ``last``, from the days' sketches alone."""
    spans = F.explode(F.array(*[F.lit(d) for d in days])).alias("days")
    own = sketches.select("*", spans).where((F.col("day") > F.date_sub(F.lit(last), F.col("days"))) & (F.col("day") <= F.lit(last)))
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c)
    return own.groupBy("days").agg(F.sum("sessions").alias("sessions"), estimate("sources"), estimate("files"))


def daily_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(day, kind, value, sessions): each address (``source``) and hash (``file``) of a day's real sessions once, and their number in a row of kind ``session``."""
    s = tables["sessions"].where(~F.col("internal")).select("id", F.to_date("start_time").alias("day"), "src_ip")
    both = tables["downloads"].select("session_id", "sha256").unionByName(tables["uploads"].select("session_id", "sha256"))
    files = both.join(s.select("id", "day"), F.col("session_id") == F.col("id"))
    values = s.select("day", F.lit("source").alias("kind"), F.col("src_ip").alias("value")).unionByName(files.select("day", F.lit("file").alias("kind"), F.col("sha256").alias("value")))
    values = values.where("value is not null").distinct().withColumn("sessions", F.lit(0).cast("long"))
    number = s.groupBy("day").agg(F.count(F.lit(1)).alias("sessions")).select("day", F.lit("session").alias("kind"), F.lit(None).cast("string").alias("value"), "sessions")
    return number.unionByName(values)


def exact_window_totals(values: DataFrame, last: dt.date, days: list[int]) -> DataFrame:
    """(days, sessions, sources, files): as ``window_totals``, exact, from the days' values.

    All windows end at ``last``, so a value is in those that reach its latest day: it is counted by that day alone, and no set is held.
    """
    spans = F.explode(F.array(*[F.lit(d) for d in days])).alias("days")
    seen = values.where(F.col("day") <= F.lit(last))
    latest = seen.where("kind <> 'session'").groupBy("kind", "value").agg(F.max("day").alias("day")).groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"))
    number = seen.where("kind = 'session'").select("day", "kind", F.col("sessions").alias("n"))
    own = latest.unionByName(number).select("*", spans).where(F.col("day") > F.date_sub(F.lit(last), F.col("days")))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}s")
    return own.groupBy("days").agg(of("session"), of("source"), of("file"))
