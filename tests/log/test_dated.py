"""Tables by day, and counts from sketches of days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstream.operators import dated, retention
from siltstream.operators.sketches import daily_sketches, daily_values, exact_window_totals, window_totals

START = dt.datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """Sessions over 12 days: across midnight, without an end, without any time, ended before they began; children, some without a session."""
    r = random.Random(9)
    sessions, downloads = [], []
    for i in range(400):
        begin = START + dt.timedelta(minutes=r.randrange(12 * 1440))
        end = r.choice([begin + dt.timedelta(minutes=r.randrange(600)), None, begin - dt.timedelta(days=3) if i % 40 == 0 else begin])
        begin, end = (None, None) if i % 50 == 7 else (begin, end)
        sessions.append((f"s{i}", f"1.1.{r.randrange(4)}.{r.randrange(40)}" if i % 9 else None, begin, end, i % 11 == 0))
        downloads += [(f"s{i}", i, f"{r.randrange(60):064x}") for _ in range(i % 3)]
    downloads.append(("nobody", 1, "f" * 64))
    s = spark.createDataFrame(sessions, "id string, src_ip string, start_time timestamp_ntz, end_time timestamp_ntz, internal boolean")
    d = spark.createDataFrame(downloads, "session_id string, ord int, sha256 string")
    return {"sessions": s, "downloads": d, "uploads": d.where("ord % 5 = 0")}


def same(a, b):
    names = sorted(a.columns)
    return sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))


def test_windows_read_their_days_only(spark, tables, tmp_path):
    path = f"file://{tmp_path}/log"
    dated.write_by_day(tables, path)
    assert all(same(dated.read_days(spark, path, n), t) for n, t in tables.items())
    since = START + dt.timedelta(days=8, hours=5)
    some = dated.read_days(spark, path, "sessions", since)
    assert same(some, tables["sessions"].where(F.col("start_time") >= F.lit(since)))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan and f">= {since.date()}" in plan  # other days' files aren't opened


@pytest.mark.parametrize("hours", [5 * 24, 5 * 24 + 13])
def test_retention_drops_days(spark, tables, tmp_path, hours):
    path = f"file://{tmp_path}/log"
    dated.write_by_day(tables, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").glob("*/_day=*/*.parquet")}
    cut = START + dt.timedelta(hours=hours)
    done = dated.prune_days(spark, path, cut)
    expected = retention.prune(tables, F.lit(cut + dt.timedelta(days=1)), 1)
    assert all(same(dated.read_days(spark, path, n), expected[n]) for n in tables)
    assert done["dropped"] and all(f.split("=")[1] < str(cut.date()) for f in done["dropped"])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").glob("*/_day=*/*.parquet")}
    changed = {p.parent.name.split("=")[1] for p in after if before.get(p) != after[p]}
    assert changed <= set(done["rewritten"])
    # the cut's day, and days that hold a session which ended before it began
    backwards = {str(r[0]) for r in tables["sessions"].where("end_time < start_time").select(F.to_date("start_time")).collect()}
    assert set(done["rewritten"]) <= {str(cut.date())} | backwards
    again = dated.prune_days(spark, path, cut)
    assert again == {"dropped": [], "rewritten": []}


def test_window_totals(spark, tables):
    """Small counts are exact; large ones within three standard errors."""
    last = (START + dt.timedelta(days=9)).date()
    got = {r.days: (r.sessions, r.sources, r.files) for r in window_totals(daily_sketches(tables), last, [1, 3, 7]).collect()}
    for days in (1, 3, 7):
        low = last - dt.timedelta(days=days - 1)
        s = tables["sessions"].where((F.to_date("start_time") >= F.lit(low)) & (F.to_date("start_time") <= F.lit(last)) & ~F.col("internal"))
        both = tables["downloads"].unionByName(tables["uploads"]).join(s, F.col("session_id") == F.col("id"), "left_semi")
        assert got[days] == (s.count(), s.select("src_ip").where("src_ip is not null").distinct().count(), both.select("sha256").distinct().count())
    many = spark.range(200_000).select(F.concat(F.lit("s"), "id").alias("id"), F.lit(False).alias("internal"), F.expr("timestamp_ntz'2026-03-01 00:00:00' + make_dt_interval(id % 9)").alias("start_time"), (F.col("id") % 120_000).cast("string").alias("src_ip"))
    none = spark.createDataFrame([], "session_id string, sha256 string")
    r = window_totals(daily_sketches({"sessions": many, "downloads": none, "uploads": none}), dt.date(2026, 3, 9), [9]).first()
    assert r.sessions == 200_000 and abs(r.sources - 120_000) < 3 * 0.0082 * 120_000 and r.files == 0


def test_exact_window_totals(spark):
    """Exact where sketches only estimate; nulls, days outside of the windows and internal sessions don't count, a window of one value has its zeros."""
    many = spark.range(60_000).select(F.concat(F.lit("s"), "id").alias("id"), (F.col("id") % 10 == 9).alias("internal"), F.expr("timestamp_ntz'2026-03-01 00:00:00' + make_dt_interval(id % 9)").alias("start_time"), F.when(F.col("id") % 7 > 0, (F.col("id") % 40_000).cast("string")).alias("src_ip"))
    files = many.where("start_time < timestamp_ntz'2026-03-09 00:00:00'").select(F.col("id").alias("session_id"), F.expr("cast(substring(id, 2) % 25000 as string)").alias("sha256"))
    tables = {"sessions": many, "downloads": files, "uploads": files.limit(0)}
    rows = [(i, i % 9, i % 40_000 if i % 7 else None, i % 25_000 if i % 9 < 8 else None) for i in range(60_000) if i % 10 != 9]
    got = {r.days: tuple(r) for r in exact_window_totals(daily_values(tables), dt.date(2026, 3, 9), [1, 3, 30]).collect()}
    for days in (1, 3, 30):
        own = [r for r in rows if r[1] > 8 - days]
        assert got[days] == (days, len(own), len({r[2] for r in own} - {None}), len({r[3] for r in own} - {None}))
