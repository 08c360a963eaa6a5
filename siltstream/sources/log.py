"""Reading logs, alert feeds and lists, in batch and as streams (S1, S2, S4, S5, ST1, ST7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.functions.net import canonical_ip
from siltstream.functions.text import clean_text, duration_ms, parse_ts, port

# The longest line, and how much of each text is kept.
MAX_LINE = 2_000_000
TEXTS = {"session": 64, "eventid": 64, "username": 256, "password": 256, "input": 20_000, "url": 2048, "shasum": 64, "filename": 1024, "destfile": 1024, "dst_ip": 255, "orig_ip": 255, "version": 256, "hassh": 32}
FIRST_ALERT = 100500


def typed_events(lines: DataFrame) -> DataFrame:
    """Events from lines (value, ord): fields of the wrong type are null; no field of one line can spoil another."""
    d = lines.withColumn("v", F.try_parse_json(F.trim("value")))
    get = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    texts = [clean_text(get(n), k).alias(n) for n, k in TEXTS.items()]
    address = canonical_ip(clean_text(get("src_ip"), 64)).alias("src_ip")
    ts = parse_ts(clean_text(get("timestamp"), 64)).alias("ts")
    return d.select("ord", "value", F.schema_of_variant("v").alias("_shape"), ts, address, *texts, port(get("dst_port")).alias("dst_port"), port(get("orig_port")).alias("orig_port"), duration_ms(get("duration_ms")).alias("duration_ms"))


def split_rejects(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): blank lines vanish; lines that are no object, too long, or without a session are rejects with a reason."""
    ok = F.col("_shape").startswith("OBJECT")
    reason = F.when(F.length("value") > MAX_LINE, "too long").when(~F.coalesce(ok, F.lit(False)), "no object").when(F.coalesce("session", F.lit("")) == "", "no session")
    d = typed.where(F.trim("value") != "").withColumn("reason", reason)
    return d.where("reason is null").drop("value", "_shape", "reason"), d.where("reason is not null").select("ord", "value", "reason")


def _with_order(lines: DataFrame) -> DataFrame:
    """ord: file, then place in it. Splits of a file are numbered by where they begin."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return lines.select("value", place.alias("ord"))


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of JSON-lines files."""
    return split_rejects(typed_events(_with_order(spark.read.text(path))))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The same lines as a stream; its checkpoint remembers which files were read."""
    lines = spark.readStream.format("text").load(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.lit(0).cast("long").alias("_"))
    return lines.select("value", place.alias("ord"))


def read_alerts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(ts, rule, level, description, techniques, src_ip, input): alerts of a feed from FIRST_ALERT on, last lines first."""
    d = _with_order(spark.read.text(path)).withColumn("v", F.try_parse_json("value"))
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    rule = get("$.rule.id").try_cast("int")
    out = d.where(rule >= FIRST_ALERT).select("ord", get("$.timestamp").alias("ts"), rule.alias("rule"), get("$.rule.level", "int").alias("level"), get("$.rule.description").alias("description"), get("$.rule.mitre.id", "array<string>").alias("techniques"), get("$.data.src_ip").alias("src_ip"), get("$.data.input").alias("input"))
    out = out.orderBy(F.desc("ord"))
    return (out if limit is None else out.limit(limit)).drop("ord")


def read_exit_list(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """(ip): addresses of a text list; blank lines, comments and what is no address go; raises ValueError below ``least``."""
    ips = spark.read.text(path).where(~F.trim("value").startswith("#")).select(canonical_ip(F.col("value")).alias("ip")).where("ip is not null").distinct()
    if ips.limit(least).count() < least:
        raise ValueError(f"fewer than {least} addresses")
    return ips
