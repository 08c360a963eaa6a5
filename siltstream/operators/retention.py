"""Retention: old sessions with all that hangs on them, then rows that no session refers to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_SESSION = ["logins", "commands", "downloads", "uploads", "tunnels", "fetches", "matches"]


def old_sessions(sessions: DataFrame, now: Column, days: int) -> DataFrame:
    """Sessions that ended, or else began, before the cut; those with neither time are never old."""
    return sessions.where(F.coalesce("end_time", "start_time") < now - F.make_dt_interval(F.lit(days)))


def prune(tables: dict[str, DataFrame], now: Column, days: int) -> dict[str, DataFrame]:
    """All tables without old sessions' rows and without orphans."""
    gone = old_sessions(tables["sessions"], now, days).select(F.col("id").alias("_id"))
    out = {n: t.join(gone, t["id" if n == "sessions" else "session_id"] == F.col("_id"), "left_anti") for n, t in tables.items() if n == "sessions" or n in PER_SESSION}
    ips = out["sessions"].where("src_ip is not null").select(F.col("src_ip").alias("_k")).distinct()
    hashes = out["downloads"].select("sha256").union(out["uploads"].select("sha256")).where("sha256 is not null").select(F.lower("sha256").alias("_k")).distinct()
    for name, key, live in (("ip_geo", "ip", ips), ("ip_intel", "ip", ips), ("file_intel", "sha256", hashes)):
        if name in tables:
            t = tables[name]
            out[name] = t.join(live, F.lower(t[key]) == F.col("_k"), "left_semi")
    return out


def prune_counts(tables: dict[str, DataFrame], now: Column, days: int) -> DataFrame:
    """(name, rows, gone): what :func:`prune` would take from each table, nothing changed."""
    kept = prune(tables, now, days)
    ones = [d.select(F.lit(name).alias("name"), F.lit(1).alias("had"), F.lit(n).alias("kept")) for name in kept for d, n in ((tables[name], 0), (kept[name], 1))]
    # an empty table counts too
    zero = tables["sessions"].sparkSession.createDataFrame([(name,) for name in kept], "name string").select("name", F.lit(0).alias("had"), F.lit(0).alias("kept"))
    counted = reduce(DataFrame.unionByName, ones, zero).groupBy("name")
    return counted.agg(F.sum(F.when(F.col("kept") == 0, F.col("had"))).alias("rows"), F.sum("kept").alias("_kept")).select("name", "rows", (F.col("rows") - F.col("_kept")).alias("gone"))
