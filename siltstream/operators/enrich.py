"""Look-up queues, provider reports, flags, reclassification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.functions.net import is_internal, is_public, longest_prefix
from siltstream.operators.campaigns import EMPTY_SHA256

# Days after which look-ups are stale, and daily budgets.
IP_DAYS, FOUND_DAYS, MISSING_DAYS = 7, 30, 2
IP_BUDGET, FILE_BUDGET = 900, 450


def reclassify(sessions: DataFrame, networks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sessions, counts): the internal flag worked out anew for each distinct address."""
    ips = sessions.select(F.col("src_ip").alias("_ip")).where("_ip is not null").distinct().withColumn("_internal", is_internal(F.col("_ip"), networks))
    s = sessions.join(ips, F.col("src_ip") == F.col("_ip"), "left").withColumn("_now", F.coalesce("_internal", F.lit(False)))
    counts = s.agg(F.count_if(F.col("_now") != F.col("internal")).alias("changed"), F.count_if("_now").alias("internal"), F.count(F.lit(1)).alias("total"))
    return s.withColumn("internal", F.col("_now")).drop("_ip", "_internal", "_now"), counts


def _left(intel: DataFrame, provider: str, now: Column, budget: int) -> int:
    used = intel.where((F.col("provider") == provider) & (F.col("fetched_at") >= F.date_trunc("day", now))).count()
    return max(0, budget - used)


def address_queue(sessions: DataFrame, intel: DataFrame, now: Column, provider: str = "abuseipdb", budget: int = IP_BUDGET) -> DataFrame:
    """(ip, place): public addresses to look up next: never looked up by newest session, then stale ones, longest ago first."""
    newest = sessions.where("src_ip is not null and not internal").groupBy("src_ip").agg(F.max("start_time").alias("newest")).where(is_public(F.col("src_ip")))
    known = intel.where(F.col("provider") == provider).select(F.col("ip").alias("_ip"), "fetched_at")
    q = newest.join(known, F.col("src_ip") == F.col("_ip"), "left").where(F.col("fetched_at").isNull() | (now - F.make_dt_interval(F.lit(IP_DAYS)) > F.col("fetched_at")))
    top = q.orderBy(F.isnull("fetched_at").desc(), F.when(F.col("fetched_at").isNull(), F.col("newest")).desc_nulls_last(), "fetched_at", "src_ip").limit(_left(intel, provider, now, budget))
    place = F.row_number().over(W.Window.orderBy(F.isnull("fetched_at").desc(), F.when(F.col("fetched_at").isNull(), F.col("newest")).desc_nulls_last(), "fetched_at", "src_ip"))
    return top.select(F.col("src_ip").alias("ip"), place.alias("place"))  # at most the budget


def file_queue(tables: dict[str, DataFrame], intel: DataFrame, now: Column, budget: int = FILE_BUDGET) -> DataFrame:
    """(sha256, place): hashes to look up next, newest first, never-seen before stale."""
    s = tables["sessions"].where(~F.col("internal")).select("id", "start_time")
    both = tables["downloads"].select("session_id", "sha256").unionAll(tables["uploads"].select("session_id", "sha256"))
    newest = both.where(F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("sha256") != EMPTY_SHA256)).join(s, F.col("session_id") == F.col("id")).groupBy("sha256").agg(F.max("start_time").alias("newest"))
    known = intel.where("provider = 'virustotal'").select(F.col("sha256").alias("_h"), "fetched_at", "found")
    age = F.when(F.col("found"), FOUND_DAYS).otherwise(MISSING_DAYS)
    q = newest.join(known, F.col("sha256") == F.col("_h"), "left").where(F.col("_h").isNull() | (now - F.make_dt_interval(age) > F.col("fetched_at")))
    order = [F.isnull("_h").desc(), F.desc_nulls_last("newest"), F.col("sha256")]
    top = q.orderBy(*order).limit(_left(intel, "virustotal", now, budget))
    return top.select("sha256", F.row_number().over(W.Window.orderBy(*order)).alias("place"))


def exit_flags(ips: DataFrame, exits: DataFrame, existing: DataFrame) -> DataFrame:
    """(ip, flagged) of addresses whose membership in the exit list isn't what is stored."""
    e = exits.select(F.col("ip").alias("_e")).distinct()
    have = existing.where("provider = 'tor'").select(F.col("ip").alias("_h"), F.col("flagged").alias("_was"))
    now = ips.select("ip").distinct().join(e, F.col("ip") == F.col("_e"), "left").select("ip", F.col("_e").isNotNull().alias("flagged"))
    return now.join(have, F.col("ip") == F.col("_h"), "left").where(~F.col("flagged").eqNullSafe(F.col("_was"))).select("ip", "flagged")


def geo_pending(sessions: DataFrame, geo: DataFrame) -> DataFrame:
    """Public addresses without a geo row, and those of which the region was never asked for."""
    ips = sessions.where("src_ip is not null").select(F.col("src_ip").alias("ip")).distinct().where(is_public(F.col("ip")))
    missing = ips.join(geo.select(F.col("ip").alias("_g")), F.col("ip") == F.col("_g"), "left_anti")
    return missing.unionByName(geo.where("region is null").select("ip")).distinct()


def geo_lookup(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """Place and network of public addresses; the most specific network wins."""
    columns = [c for c in networks.columns if c not in ("version", "lo", "hi", "prefix", "network")]
    return longest_prefix(ips.where(is_public(F.col("ip"))), "ip", networks, columns)


def flatten_file_report(reports: DataFrame) -> DataFrame:
    """(sha256, found, malicious, suspicious, engines, label) from a provider's JSON."""
    v = F.try_parse_json("payload")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    at = "$.data.attributes"
    stats = F.from_json(get(f"{at}.last_analysis_stats", "string"), "map<string,int>")
    d = reports.withColumn("v", v).withColumn("stats", stats)
    label = F.coalesce(get(f"{at}.popular_threat_classification.suggested_threat_label", "string"), get(f"{at}.meaningful_name", "string"))
    engines = F.aggregate(F.map_values("stats"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return d.select("sha256", F.col("stats").isNotNull().alias("found"), F.element_at("stats", "malicious").alias("malicious"), F.element_at("stats", "suspicious").alias("suspicious"), engines.alias("engines"), F.substring(label, 1, 255).alias("label"))


def flatten_abuse(reports: DataFrame) -> DataFrame:
    return reports.select("ip", F.try_variant_get(F.try_parse_json("payload"), "$.data.abuseConfidenceScore", "int").alias("score"))


def upsert_intel(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row for each key and provider, the one fetched last."""
    both = existing.unionByName(new, allowMissingColumns=True)
    w = W.Window.partitionBy(key, "provider").orderBy(F.desc_nulls_last("fetched_at"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
