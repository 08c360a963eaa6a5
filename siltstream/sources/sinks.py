"""Indicator lists as CSV, STIX, blocklist and firewall sets; publishing."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.functions.net import ip_key
from siltstream.functions.text import NAMESPACE, csv_cell, stable_id, stix_pattern, technique_url
from siltstream.operators.totals import running_total

CHUNK, LEAST_SECONDS = 500, 60
CSV = ["type", "value", "first_seen", "last_seen", "sessions", "level", "confidence", "country", "asn", "as_org", "abuse_score", "tor", "vt_malicious", "vt_engines", "techniques", "detail"]


def _stamp(ts: str, millis: bool = False) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if millis else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def csv_rows(indicators: DataFrame) -> DataFrame:
    """The columns of CSV as text: no cell is a formula or has control characters."""
    plain = {"first_seen": _stamp("first_seen"), "last_seen": _stamp("last_seen"), "techniques": F.concat_ws(" ", "techniques"), "tor": F.when(F.col("tor"), "yes").when(~F.col("tor"), "no").otherwise("")}
    return indicators.select(*[plain.get(c, csv_cell(F.col(c).cast("string"))).alias(c) for c in CSV])


def stix_objects(indicators: DataFrame, now: Column, days: int, author: str = "Siltstream sensor") -> DataFrame:
    """(value): an identity, then a STIX 2.1 indicator for each row, with ids that stay the same from export to export."""
    identity = f"identity--{uuid.uuid5(NAMESPACE, author)}"
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pattern = stix_pattern(F.col("type"), F.col("value"))
    reference = lambda t: F.struct(F.lit("mitre-attack").alias("source_name"), t.alias("external_id"), technique_url(t).alias("url"))
    where = F.concat(F.col("sessions").cast("string"), F.when(F.col("sessions") == 1, " session").otherwise(" sessions"))
    one = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), stable_id(pattern)).alias("id"), F.lit(identity).alias("created_by_ref"),
        stamp("first_seen").alias("created"), stamp("last_seen").alias("modified"), F.concat_ws(" ", "type", "value").alias("name"),
        F.concat_ws("; ", where, "level", F.when(F.col("detail") != "", F.col("detail"))).alias("description"), F.array(F.lit("malicious-activity")).alias("indicator_types"),
        pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), stamp("first_seen").alias("valid_from"),
        stamp(F.greatest(F.col("last_seen") + F.make_dt_interval(F.lit(days)), F.col("first_seen") + F.expr("interval 1 second"))).alias("valid_until"),
        F.col("confidence"), F.when(F.size("techniques") > 0, F.transform("techniques", reference)).alias("external_references"),
    )
    who = F.to_json(F.struct(F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), F.lit(identity).alias("id"), stamp(now).alias("created"), stamp(now).alias("modified"), F.lit(author).alias("name"), F.lit("organization").alias("identity_class")))
    return indicators.sparkSession.range(1).select(who.alias("value")).unionByName(indicators.select(F.to_json(one).alias("value")))


def addresses(indicators: DataFrame) -> DataFrame:
    """Address indicators with their sort key, IPv4 first, by number."""
    return indicators.where(F.col("type").isin("ipv4", "ipv6")).withColumn("_k", ip_key(F.col("value"))).orderBy("_k.version", "_k.key")


def blocklist(indicators: DataFrame) -> DataFrame:
    return addresses(indicators).select("value")


def _document(body: DataFrame, order: list[str], head: list[str], tail: list[str]) -> DataFrame:
    """(value): the lines of a text, in order: head, body (value and order columns), tail.

    Lines are sorted in ranges, one range a part of the file, so that no task has the whole body; parts one after the other are the text.
    """
    spark = body.sparkSession
    fixed = [(0, n, x) for n, x in enumerate(head)] + [(2, n, x) for n, x in enumerate(tail)]
    ends = spark.createDataFrame(fixed, "_section int, _n int, value string")
    lines = body.select(F.lit(1).alias("_section"), "value", *order).unionByName(ends, allowMissingColumns=True)
    return lines.orderBy("_section", "_n", *order).select("value")


def _notes(now: str, days: int, min_level: str, what: str) -> list[str]:
    return [f"# Siltstream {what}", f"# generated {now}", f"# addresses seen in the last {days} days, minimum activity: {min_level}"]


def blocklist_document(indicators: DataFrame, now: str, days: int, min_level: str) -> DataFrame:
    """(value): the blocklist with its comments; an address leaves it once it has been quiet for the window."""
    body = addresses(indicators).select("value", F.col("_k.version").alias("version"), F.col("_k.key").alias("key"))
    head = [*_notes(now, days, min_level, "blocklist"), "# make it anew regularly: an address leaves the list once it has been quiet for the window"]
    return _document(body, ["version", "key"], head, [])


def _elements(indicators: DataFrame, now: Column, days: int, table: str) -> DataFrame:
    """(value, v, chunk): statements of at most CHUNK elements, in the order of addresses, which are numbered in ranges."""
    left = F.unix_seconds((F.col("last_seen") + F.make_dt_interval(F.lit(days))).cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))
    element = F.concat_ws(" ", "value", F.lit("timeout"), F.concat(F.greatest(left, F.lit(LEAST_SECONDS)).cast("string"), F.lit("s")))
    d = indicators.where(F.col("type").isin("ipv4", "ipv6")).select(element.alias("element"), ip_key(F.col("value")).alias("_k"), F.lit(1).alias("one"))
    d = running_total(d.select("element", F.col("_k.version").alias("v"), F.col("_k.key").alias("key"), "one"), "one", ["v", "key"], "n")
    # IPv6 follows IPv4: its numbers begin after them
    fours = F.broadcast(d.agg(F.count_if(F.col("v") == 4).alias("fours")))
    d = d.crossJoin(fours).withColumn("n", F.col("n") - F.when(F.col("v") == 6, F.col("fours")).otherwise(0))
    body = d.groupBy("v", F.floor((F.col("n") - 1) / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "element"))), lambda x: x.element), ", ").alias("elements"))
    name = F.concat(F.lit(f"inet {table} blocklist_v"), F.col("v").cast("string"))
    return body.select(F.concat(F.lit("add element "), name, F.lit(" { "), F.col("elements"), F.lit(" }")).alias("value"), F.col("v").cast("int").alias("v"), "chunk")


def _sets(table: str) -> list[str]:
    out = [f"add table inet {table}"]
    for v, kind in ((4, "ipv4_addr"), (6, "ipv6_addr")):
        out += [f"add set inet {table} blocklist_v{v} {{ type {kind}; flags timeout; }}", f"flush set inet {table} blocklist_v{v}"]
    return out


def nftables(indicators: DataFrame, now: Column, days: int, table: str = "siltstream") -> DataFrame:
    """(value): statements that fill timed sets, at most CHUNK elements each; an element stays until its window ends, a minute at least."""
    return _document(_elements(indicators, now, days, table), ["v", "chunk"], _sets(table), [])


def nftables_document(indicators: DataFrame, now: str, days: int, min_level: str, table: str = "siltstream") -> DataFrame:
    """(value): the same with comments (S9). ``now`` is a time as text, such as 2026-10-05T07:11:23Z."""
    use = ["# This makes the sets only. Block with a rule of your own, e.g.:", f"#   nft add rule inet filter input ip saddr @blocklist_v4 drop  (table {table})"]
    body = _elements(indicators, F.to_timestamp(F.lit(now)), days, table)
    return _document(body, ["v", "chunk"], [*_notes(now, days, min_level, "blocklist for nftables"), *use, *_sets(table)], [])


def stix_bundle(indicators: DataFrame, now: str, days: int, author: str = "Siltstream sensor") -> DataFrame:
    """(value): the lines of one JSON document: a bundle of the identity and of all indicators, in order of their ids.

    The identity comes first, so every other object's line can begin with the comma that separates it.
    """
    at = F.to_timestamp(F.lit(now))
    identity = f"identity--{uuid.uuid5(NAMESPACE, author)}"
    bundle = f"bundle--{uuid.uuid5(NAMESPACE, f'{author} {now}')}"
    objects = stix_objects(indicators, at, days, author).select("value", F.get_json_object("value", "$.id").alias("id"))
    body = objects.select(F.when(F.col("id") == identity, F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))).alias("value"), (F.col("id") != identity).alias("later"), "id")
    return _document(body, ["later", "id"], [f'{{"type":"bundle","id":"{bundle}","objects":['], ["]}"])


_READY = ".ready"


def _names(fs, root) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []


def publish(df: DataFrame, path: str, form: str = "text", keep: int = 3) -> str:
    """Write a snapshot below ``path``, then an empty file that says it is whole: readers never see half of one, and at no time none.

    A snapshot is never changed or moved, and nothing is overwritten; the newest that is whole is current, and the ``keep`` newest stay
    for readers who have begun. Parts are written side by side. Returns the snapshot's folder.
    """
    spark = df.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    root = Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    name = f"snapshot-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.option("header", "true").option("quoteMode", "minimal").format(form).save(f"{path}/{name}")
    fs.create(Path(f"{path}/{name}{_READY}"), True).close()
    whole = [n.removesuffix(_READY) for n in _names(fs, root) if n.endswith(_READY)]
    for old in whole[:-keep]:
        fs.delete(Path(f"{path}/{old}{_READY}"), True)
        fs.delete(Path(f"{path}/{old}"), True)
    return f"{path}/{name}"


def published(spark: SparkSession, path: str) -> str:
    """The folder of the snapshot that is current."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [n for n in _names(root.getFileSystem(spark._jsc.hadoopConfiguration()), root) if n.endswith(_READY)]
    if not names:
        raise FileNotFoundError(path)
    return f"{path}/{names[-1].removesuffix(_READY)}"
