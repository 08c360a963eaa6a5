"""Small functions that no registered query shows."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siltstream.functions import text
from siltstream.operators import enrich, reports
from siltstream.operators import rules as R
from siltstream.operators.sessions import pending_slice
from siltstream.plans.shared import shared_dir


def test_rule_problems(spark):
    """Every fault of a rule is reported, a pattern that does not compile among them."""
    good = R.RULES[0]
    rows = [good, ("open", good[1], "low", "segment", "("), ("open-class", good[1], "low", "command", "[a"), ("blank", good[1], "low", "segment", " "), ("odd", "T0000", "sure", "line", "x"), ("twice", good[1], "low", "segment", "x"), ("twice", good[1], "low", "segment", "y"), ("none", good[1], "low", "segment", None)]
    found = {}
    for r in R.rule_problems(R.rule_table(spark, rows), R.catalog(spark)).collect():
        found.setdefault(r.rule, set()).add(r.problem)
    assert found == {
        "open": {"the pattern does not compile"}, "open-class": {"the pattern does not compile"}, "blank": {"a field is missing"}, "none": {"a field is missing"},
        "odd": {"unknown technique", "unknown confidence", "unknown scope"}, "twice": {"the id is repeated"},
    }


def test_map_project(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-180.0, 90.0), (180.0, -90.0), (12.5, 41.9)], "lon double, lat double")
    got = [(r.p.x, r.p.y) for r in df.select(text.map_project(F.col("lon"), F.col("lat")).alias("p")).collect()]
    assert got == [(480.0, 240.0), (0.0, 0.0), (960.0, 480.0), (513.3, 128.3)]


def test_age_text(spark):
    now = dt.datetime(2026, 10, 5, 12)
    ages = {None: "never", -5: "just now", 0: "0s ago", 59: "59s ago", 60: "1m ago", 3599: "59m ago", 3600: "1h ago", 86_399: "23h ago", 86_400: "1d ago", 400 * 86_400: "400d ago"}
    df = spark.createDataFrame([(i, None if s is None else now - dt.timedelta(seconds=s)) for i, s in enumerate(ages)], "i int, ts timestamp_ntz")
    assert [r.a for r in df.orderBy("i").select(text.age_text(F.col("ts"), F.lit(now)).alias("a")).collect()] == list(ages.values())


def test_resolve_id(spark):
    df = spark.createDataFrame([("abcdef12",), ("abcdef34",), ("abcdef",), ("ffffff99",)], "id string")
    assert reports.resolve_id(df, "abcdef") == "abcdef"  # an id that others go on from is itself
    assert reports.resolve_id(df, "ffffff") == "ffffff99" and reports.resolve_id(df, "fffff") is None
    assert reports.resolve_id(df, "abcdef12") == "abcdef12" and reports.resolve_id(df, "nothing") is None
    with pytest.raises(ValueError):
        reports.resolve_id(df.where("id <> 'abcdef'"), "abcdef")


def test_upsert_intel(spark):
    schema = "ip string, provider string, fetched_at timestamp_ntz, score int"
    day = lambda d: dt.datetime(2026, 10, d)
    old = spark.createDataFrame([("1.1.1.1", "a", day(1), 10), ("1.1.1.1", "b", day(3), 20), ("2.2.2.2", "a", None, 30)], schema)
    new = spark.createDataFrame([("1.1.1.1", "a", day(2), 11), ("1.1.1.1", "b", day(2), 21), ("2.2.2.2", "a", day(1), 31), ("3.3.3.3", "a", day(1), 40)], schema)
    got = sorted((r.ip, r.provider, r.score) for r in enrich.upsert_intel(old, new, "ip").collect())
    assert got == [("1.1.1.1", "a", 11), ("1.1.1.1", "b", 20), ("2.2.2.2", "a", 31), ("3.3.3.3", "a", 40)]


def test_flatten_abuse(spark):
    df = spark.createDataFrame([("a", '{"data": {"abuseConfidenceScore": 87}}'), ("b", "{"), ("c", '{"data": {}}')], "ip string, payload string")
    assert {r.ip: r.score for r in enrich.flatten_abuse(df).collect()} == {"a": 87, "b": None, "c": None}


def test_pending_slice(spark):
    """The oldest first, null times before all, and whether there are more."""
    pending = spark.createDataFrame([("c", 3), ("a", 1), ("b", 1), ("z", None)], "id string, start_time int")
    for limit, ids, more in [(2, ["z", "a"], True), (4, ["z", "a", "b", "c"], False), (9, ["z", "a", "b", "c"], False)]:
        rows, has_more = pending_slice(pending, limit)
        assert [r.id for r in rows.collect()] == ids and has_more is more


def test_shared_folder():
    """A cluster that names no shared folder is an error, not a folder of one machine."""
    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context))


def test_stored_rows_are_filtered_by_event(spark, monkeypatch):
    """The tables written in one pass are those of ``store_events``, downloads without an address left out; no filter holds the kind's formula."""
    from siltstream.operators import sessions as S
    from siltstream.plans.binding import bound_events

    e = bound_events(spark, "/root/testdata/sf0.001").withColumn("url", F.when(F.col("ord") % 3 == 0, "").when(F.col("ord") % 3 == 1, F.col("url")))
    plans, stage = [], S.stage
    monkeypatch.setattr(S, "stage", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, *a, **k))
    want = S.store_events(e)
    for names in (None, ["downloads", "uploads"]):
        got = S.stage_events(e, names)
        assert list(got) == ["sessions", *(names or S.CAPS)] and got["downloads"].count() > 0
        for n, d in got.items():
            cells = [F.col(c).cast("string") for c in want[n].columns]
            assert sorted(map(str, d.select(*cells).collect())) == sorted(map(str, want[n].select(*cells).collect()))
    filters = [line for plan in plans for line in plan.split("\n") if " Filter " in line]
    assert filters and not any("coalesce(CASE" in line for line in filters)
