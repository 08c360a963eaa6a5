"""Published files and whole documents."""

import datetime as dt
import ipaddress
import json
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstream.operators.indicators import COLUMNS, TYPES
from siltstream.sources import sinks

NOW = "2026-10-05T07:11:23Z"


@pytest.fixture(scope="module")
def indicators(spark):
    """1,300 IPv4 and 3 IPv6 addresses, files and URLs, in no order."""
    r = random.Random(4)
    seen = dt.datetime(2026, 10, 1)
    rows = [("ipv4", str(ipaddress.ip_address(r.randrange(2**24, 2**31)))) for _ in range(1300)]
    rows += [("ipv6", x) for x in ("2606:4700:4700::1111", "2001:db9::2", "2606:4700::1")]
    rows += [("sha256", f"{i:064x}") for i in range(20)] + [("url", f"http://evil.example/it's{i}") for i in range(20)]
    rows = sorted(set(rows), key=lambda _: r.random())
    df = spark.createDataFrame([(*x, seen - dt.timedelta(days=i % 40)) for i, x in enumerate(rows)], "type string, value string, last_seen timestamp_ntz")
    fixed = {"first_seen": F.expr("timestamp_ntz'2026-08-01 00:00:00'"), "sessions": F.lit(2), "level": F.lit("access"), "confidence": F.lit(55), "techniques": F.array(F.lit("T1110.001")), "detail": F.lit("")}
    shaped = df.select(*[(F.col(c) if c in df.columns else fixed.get(c, F.lit(None))).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS])
    return shaped.repartition(6), rows


def text_of(spark, df, path):
    """The published parts, one after the other."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts also for small lists
    try:
        folder = sinks.publish(df, f"file://{path}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert folder == sinks.published(spark, f"file://{path}")
    parts = sorted(Path(folder.removeprefix("file://")).glob("part-*"))
    return "".join(p.read_text() for p in parts), len([p for p in parts if p.stat().st_size])


def by_number(rows, kind):
    return sorted((x for t, x in rows if t == kind), key=lambda x: int(ipaddress.ip_address(x)))


def test_blocklist(spark, indicators, tmp_path):
    df, rows = indicators
    text, parts = text_of(spark, sinks.blocklist_document(df, NOW, 30, "guessing"), tmp_path / "list")
    lines = text.splitlines()
    head = [x for x in lines if x.startswith("#")]
    assert lines[:4] == head and f"# generated {NOW}" in head and "last 30 days" in head[2]
    assert lines[4:] == by_number(rows, "ipv4") + by_number(rows, "ipv6") and parts > 1


def test_nftables(spark, indicators, tmp_path):
    df, rows = indicators
    text, _ = text_of(spark, sinks.nftables_document(df, NOW, 30, "access"), tmp_path / "nft")
    lines = [x for x in text.splitlines() if not x.startswith("#")]
    assert lines[0] == "add table inet siltstream" and sum(x.startswith("flush set") for x in lines) == 2
    chunks = [x.split("{ ")[1].removesuffix(" }").split(", ") for x in lines if x.startswith("add element")]
    assert [len(c) for c in chunks] == [500, 500, len(by_number(rows, "ipv4")) - 1000, 3]
    assert [x.split()[0] for c in chunks for x in c] == by_number(rows, "ipv4") + by_number(rows, "ipv6")
    left = {x.split()[0]: int(x.split()[2].removesuffix("s")) for c in chunks for x in c}
    now = dt.datetime(2026, 10, 5, 7, 11, 23)
    for r in df.where("type in ('ipv4', 'ipv6')").collect():
        assert left[r.value] == max(60, int((r.last_seen + dt.timedelta(days=30) - now).total_seconds()))
    empty, _ = text_of(spark, sinks.nftables_document(df.limit(0), NOW, 30, "access"), tmp_path / "none")
    assert "add element" not in empty and "add table" in empty


def test_stix_bundle(spark, indicators, tmp_path):
    df, rows = indicators
    text, parts = text_of(spark, sinks.stix_bundle(df, NOW, 30), tmp_path / "stix")
    bundle = json.loads(text)
    assert parts > 1 and bundle["type"] == "bundle" and bundle["id"].startswith("bundle--")
    who, *objects = bundle["objects"]
    assert who["type"] == "identity" and {o["created_by_ref"] for o in objects} == {who["id"]}
    assert len(objects) == len(rows) == len({o["id"] for o in objects})
    again, _ = text_of(spark, sinks.stix_bundle(df.repartition(3), NOW, 30), tmp_path / "again")
    assert again == text
    none, _ = text_of(spark, sinks.stix_bundle(df.limit(0), NOW, 30), tmp_path / "no")
    assert [o["type"] for o in json.loads(none)["objects"]] == ["identity"]


def test_readers_never_fail(spark, tmp_path):
    """A reader that takes the newest whole snapshot while lists are published finds a whole list every time."""
    path = f"file://{tmp_path}/list"
    make = lambda n: spark.range(200).select(F.concat(F.lit(f"{n} "), F.col("id").cast("string")).alias("value")).repartition(4)
    sinks.publish(make(0), path)
    seen, stop, failed = set(), threading.Event(), []

    def read():
        while not stop.is_set():
            try:
                folder = max((tmp_path / "list").glob("*.ready")).with_suffix("")
                lines = [x for p in folder.glob("part-*") for x in p.read_text().splitlines()]
                seen.add(lines[0].split()[0])
                assert len(lines) == 200 and len({x.split()[0] for x in lines}) == 1
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 6):
        sinks.publish(make(n), path)
    stop.set()
    reader.join()
    assert not failed, failed[0]
    assert len(seen) > 1
    left = [p.name for p in (tmp_path / "list").iterdir() if p.is_dir()]
    assert len(left) == 3 and sinks.published(spark, path).split("/")[-1] == max(left)
