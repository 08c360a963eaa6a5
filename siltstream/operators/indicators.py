"""Indicators of compromise: addresses, files and URLs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstream.functions.net import in_networks, ip_key, is_internal, is_public, network_table, normalise_ip
from siltstream.functions.text import printable
from siltstream.functions.urls import is_common_host, url_host, valid_url
from siltstream.operators.campaigns import EMPTY_SHA256
from siltstream.plans.shared import small

# Activity levels with their confidences, and limits.
LEVELS = ["contact", "guessing", "access", "hands-on", "action"]
CONFIDENCE = {"contact": 25, "guessing": 45, "access": 55, "hands-on": 70, "action": 85}
GUESSING, ABUSE, MORE, MOST, TECHNIQUES = 10, 50, 10, 95, 20
KINDS = ["ip", "file", "url"]
COLUMNS = [
    "type", "value", "first_seen", "last_seen", "sessions", "level", "confidence", "country", "asn", "as_org", "abuse_score",
    "tor", "vt_malicious", "vt_engines", "techniques", "detail", "attempted",
]
TYPES = {"first_seen": "timestamp_ntz", "last_seen": "timestamp_ntz", "sessions": "bigint", "confidence": "int", "asn": "int", "abuse_score": "int", "tor": "boolean", "vt_malicious": "int", "vt_engines": "int", "techniques": "array<string>", "attempted": "boolean"}


@dataclass(frozen=True)
class Filters:
    """What to list; checked when made."""

    days: int = 30
    min_level: str = "guessing"
    kinds: tuple[str, ...] = tuple(KINDS)
    min_confidence: int = 0
    min_sources: int = 3
    exclude: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.days < 1:
            raise ValueError("days must be at least 1")
        if self.min_level not in LEVELS:
            raise ValueError(f"unknown level {self.min_level}")
        if bad := [k for k in self.kinds if k not in KINDS]:
            raise ValueError(f"unknown type {bad[0]}")
        if not 0 <= self.min_confidence <= 100 or self.min_sources < 1:
            raise ValueError("min_confidence is 0 to 100, min_sources at least 1")


def _shaped(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS])


def _window(sessions: DataFrame, now: Column, days: int) -> DataFrame:
    return sessions.where(~F.col("internal") & (F.col("start_time") >= now - F.make_dt_interval(F.lit(days))))


def _addresses(df: DataFrame, column: str) -> DataFrame:
    """(raw, ip): normalised spellings of distinct addresses."""
    return df.select(F.col(column).alias("raw")).where("raw is not null").distinct().withColumn("ip", normalise_ip(F.col("raw"))).where("ip is not null")


def address_indicators(flags: DataFrame, fetches: DataFrame, matches: DataFrame, geo: DataFrame, intel: DataFrame, now: Column, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """(indicators, rejected): one row per normalised address seen in the window (A15); rejected counts by reason (P10)."""
    spark = flags.sparkSession
    names = _addresses(flags, "src_ip")
    s = _window(flags, now, filters.days).join(names, F.col("src_ip") == F.col("raw"))
    fetched = fetches.select(F.col("session_id").alias("_f")).distinct()
    s = s.join(fetched, F.col("id") == F.col("_f"), "left")
    acted = (F.col("n_downloads") + F.col("n_uploads") + F.col("n_tunnels") > 0) | F.col("_f").isNotNull()
    per = s.groupBy("ip").agg(
        F.max("start_time").alias("last_seen"), F.count(F.lit(1)).alias("sessions"), F.max(F.col("accepted") > 0).alias("access"), F.sum("failed").alias("failed"),
        F.max((F.col("accepted") > 0) & (F.col("n_commands") > 0)).alias("hands"), F.max((F.col("accepted") > 0) & acted).alias("act"),
    )
    per = per.withColumn("public", is_public(F.col("ip")))
    listed = per.where("public")
    if filters.exclude:
        kept = in_networks(listed, "ip", network_table(spark, list(filters.exclude)), "left_anti")
    else:
        kept = listed
    level = F.when(F.col("act"), 4).when(F.col("hands"), 3).when(F.col("access"), 2).when(F.col("failed") >= GUESSING, 1).otherwise(0)
    levelled = kept.withColumn("n", level)
    kept = levelled.where(F.col("n") >= LEVELS.index(filters.min_level))
    # first ever: over all time, internal or not
    first = flags.where("start_time is not null").join(names, F.col("src_ip") == F.col("raw")).groupBy(F.col("ip").alias("_a")).agg(F.min("start_time").alias("first_seen"))
    g = geo.join(_addresses(geo, "ip").withColumnRenamed("ip", "_b"), F.col("ip") == F.col("raw")).groupBy("_b").agg(F.first("country_code", True).alias("country"), F.first("asn", True).alias("asn"), F.first("as_org", True).alias("as_org"))
    i = intel.join(_addresses(intel, "ip").withColumnRenamed("ip", "_c"), F.col("ip") == F.col("raw")).groupBy("_c").agg(F.max(F.when(F.col("provider") == "abuseipdb", F.col("score"))).alias("abuse_score"), F.bool_or(F.when(F.col("provider") == "tor", F.col("flagged"))).alias("tor"))
    used = matches.join(s.select("id", F.col("ip").alias("_d")), F.col("session_id") == F.col("id")).groupBy("_d").agg(F.slice(F.array_sort(F.collect_set("technique")), 1, TECHNIQUES).alias("techniques"))
    out = kept.join(first, kept.ip == F.col("_a"), "left").join(g, kept.ip == F.col("_b"), "left").join(i, kept.ip == F.col("_c"), "left").join(used, kept.ip == F.col("_d"), "left")
    base = F.element_at(F.array(*[F.lit(CONFIDENCE[x]) for x in LEVELS]), F.col("n") + 1)
    sure = F.least(base + F.when(F.col("abuse_score") >= ABUSE, MORE).otherwise(0), F.lit(MOST))
    kind = F.when(F.col("ip").contains(":"), "ipv6").otherwise("ipv4")
    out = out.withColumns({"type": kind, "value": F.col("ip"), "level": F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("n") + 1), "confidence": sure, "techniques": F.coalesce("techniques", F.array().cast("array<string>"))})
    junk = _window(flags, now, filters.days).where("src_ip is not null").select("src_ip").distinct().where(normalise_ip(F.col("src_ip")).isNull())
    low = levelled.where(F.col("n") < LEVELS.index(filters.min_level))
    counts = [d.select(F.lit(reason).alias("reason")) for reason, d in (("invalid", junk), ("non_public", per.where(~F.col("public"))), ("below_level", low))]
    if filters.exclude:
        counts.append(in_networks(listed, "ip", network_table(spark, list(filters.exclude))).select(F.lit("excluded").alias("reason")))
    return _shaped(out), reduce(DataFrame.unionByName, counts)


def file_indicators(tables: dict[str, DataFrame], verdicts: DataFrame, now: Column, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """(indicators, rejected): one row per hash of files moved in the window (A16). A session that both downloads and uploads counts twice."""
    recent = _window(tables["sessions"], now, filters.days).select("id", "start_time")
    moved = [tables[t].select("session_id", "sha256", F.col(c).alias("sample"), F.lit(verb).alias("verb")) for t, c, verb in (("downloads", "url", "downloaded"), ("uploads", "filename", "uploaded"))]
    both = moved[0].unionByName(moved[1]).where("sha256 is not null")
    seen = both.join(recent, F.col("session_id") == F.col("id")).groupBy("sha256", "verb").agg(F.max("start_time").alias("last"), F.countDistinct("session_id").alias("n"), F.min("sample").alias("sample"))
    seen = seen.withColumn("value", F.lower("sha256")).withColumn("valid", F.col("value").rlike("^[0-9a-f]{64}$"))
    note = F.when(F.coalesce("sample", F.lit("")) != "", F.concat_ws(" ", "verb", printable(F.col("sample"), 100))).otherwise(F.col("verb"))
    good = seen.where(F.col("valid") & (F.col("value") != EMPTY_SHA256)).groupBy("value").agg(F.max("last").alias("last_seen"), F.sum("n").alias("sessions"), F.concat_ws("; ", F.slice(F.array_sort(F.collect_set(note)), 1, 3)).alias("detail"))
    ever = both.join(tables["sessions"].where("start_time is not null").select("id", "start_time"), F.col("session_id") == F.col("id")).groupBy(F.lower("sha256").alias("_e")).agg(F.min("start_time").alias("first_seen"))
    v = verdicts.where("provider = 'virustotal' and found").select(F.lower("sha256").alias("_v"), F.col("malicious").alias("vt_malicious"), F.col("engines").alias("vt_engines"), F.lit(True).alias("found"))
    out = good.join(ever, F.col("value") == F.col("_e"), "left").join(v, F.col("value") == F.col("_v"), "left")
    bad = F.coalesce("vt_malicious", F.lit(0))
    sure = F.when(F.col("found").isNull(), 60).when(bad >= 5, 90).when(bad >= 1, 75).otherwise(30)
    return _shaped(out.withColumns({"type": F.lit("sha256"), "confidence": sure})), seen.where(~F.col("valid")).select(F.lit("invalid").alias("reason"))


def url_indicators(tables: dict[str, DataFrame], fetches: DataFrame, now: Column, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """(indicators, rejected): addresses downloaded from, and those only typed by enough sources."""
    spark = fetches.sparkSession
    d, f = tables["downloads"].where("url is not null").select("url", "session_id"), fetches.select("url", "session_id")
    seen = d.union(f).distinct()
    s = _window(tables["sessions"], now, filters.days)
    per = seen.join(s.select("id", "start_time", "src_ip"), F.col("session_id") == F.col("id")).groupBy("url").agg(F.max("start_time").alias("last_seen"), F.countDistinct("id").alias("sessions"), F.countDistinct("src_ip").alias("sources"))
    timed = tables["sessions"].where("start_time is not null").select("id", "start_time")
    ever = seen.join(timed, F.col("session_id") == F.col("id")).groupBy(F.col("url").alias("_u")).agg(F.min("start_time").alias("first_seen"))
    got = d.join(timed, F.col("session_id") == F.col("id"), "left_semi").select(F.col("url").alias("_g")).distinct()
    per = per.withColumn("host", url_host(F.col("url"))).withColumn("address", normalise_ip(F.col("host")))
    per = per.join(ever, F.col("url") == F.col("_u"), "left").join(got, F.col("url") == F.col("_g"), "left").withColumn("attempted", F.col("_g").isNull())
    own = is_internal(F.col("address"))
    if filters.exclude:
        inside = in_networks(per.where("address is not null").select("address").distinct(), "address", network_table(spark, list(filters.exclude))).select(F.col("address").alias("_x"))
        per = per.join(small(inside), F.col("address") == F.col("_x"), "left")
        own = own | F.col("_x").isNotNull()
    reason = F.when(~valid_url(F.col("url")), "invalid").when(is_common_host(F.col("host")), "common").when(own, "excluded").when(F.col("attempted") & (F.col("sources") < filters.min_sources), "unverified")
    per = per.withColumn("reason", reason)
    said = F.when(F.col("attempted"), "typed in commands; never seen delivering a file").otherwise("")
    good = per.where("reason is null").withColumns({"type": F.lit("url"), "value": F.col("url"), "confidence": F.when(F.col("attempted"), 40).otherwise(60), "detail": said})
    return _shaped(good), per.where("reason is not null").select("reason")


def collect_indicators(tables: dict[str, DataFrame], flags: DataFrame, fetches: DataFrame, matches: DataFrame, geo: DataFrame, intel: DataFrame, verdicts: DataFrame, now: Column, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """All indicators by falling confidence, kind and number or value, and the counts of what was rejected."""
    parts = []
    if "ip" in filters.kinds:
        parts.append(address_indicators(flags, fetches, matches, geo, intel, now, filters))
    if "file" in filters.kinds:
        parts.append(file_indicators(tables, verdicts, now, filters))
    if "url" in filters.kinds:
        parts.append(url_indicators(tables, fetches, now, filters))
    found = reduce(DataFrame.unionByName, [p[0] for p in parts]).where(F.col("confidence") >= filters.min_confidence)
    rejected = reduce(DataFrame.unionByName, [p[1] for p in parts]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return ordered(found), rejected


def ordered(indicators: DataFrame) -> DataFrame:
    kind = F.array_position(F.array(*[F.lit(k) for k in ("ipv4", "ipv6", "sha256", "url")]), F.col("type"))
    return indicators.orderBy(F.desc("confidence"), kind, ip_key(F.col("value")).getField("key").asc_nulls_last(), "value")


def kind_counts(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
