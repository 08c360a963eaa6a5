"""Features of sessions with more rows than the stored tables keep, and of values beyond former limits."""

import datetime as dt

import pytest

from siltstream.operators import campaigns as C
from siltstream.operators import sessions as S
from siltstream.plans.binding import PASSWORDS, USERS, bound_events
from siltstream.plans.queries import QUERIES

START = dt.datetime(2024, 1, 5)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """One session: what is new comes after 900 equal logins, or 300 equal tunnels, and after those in time too."""
    path = f"file://{tmp_path_factory.mktemp('events')}"
    made = [("error", 0)] * 900 + [("purchase", 80)] * 300 + [("error", k) for k in range(1, 5)] + [("purchase", k) for k in range(81, 100)]
    rows = [(i, START + dt.timedelta(seconds=i), 1, kind, 0.0, f'{{"k": {k}}}') for i, (kind, k) in enumerate(made)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return path


def test_weak_features_beyond_caps(spark, sf_dir):
    got = sorted(map(tuple, QUERIES["weak_features"](spark, sf_dir).select("session_id", "key", "weight").collect()))
    logins = {(f"login:{u}:{p}", 1.5) for u, p in zip(USERS, PASSWORDS, strict=True)}
    tunnels = {(f"tunnel:198.51.100.{k % 6}:{20 + k % 9}", 4.0) for k in range(80, 100)}
    assert got == sorted(("u1-20240105", *x) for x in logins | tunnels)


def test_stage_events_not_capped(spark, sf_dir, monkeypatch):
    """The tables are those that caps beyond all rows give."""
    events = bound_events(spark, sf_dir)
    got = S.stage_events(events, ["logins", "tunnels"], capped=False)
    monkeypatch.setattr(S, "CAPS", dict.fromkeys(S.CAPS, 10**6))
    want = S.store_events(events)
    assert set(got) == {"sessions", "logins", "tunnels"} and got["logins"].count() == 904 and got["tunnels"].count() == 319
    for name, d in got.items():
        assert d.dtypes == want[name].dtypes and sorted(map(str, d.collect())) == sorted(map(str, want[name].collect()))
    urls = [("", 0), ("http://h.bad/x", 1), (None, 2), ("http://h.bad/x", 3)]
    down = events.limit(0).unionByName(spark.createDataFrame([(i, START, "cowrie.session.file_download", "a", u) for u, i in urls], "ord long, ts timestamp_ntz, eventid string, session string, url string"), allowMissingColumns=True)
    assert [r.ord for r in S.stage_events(down, ["downloads"], capped=False)["downloads"].collect()] == [1]  # without an address: none


def test_features_of_many_and_long_values(spark):
    """All pairs of logins and all tunnels, not the first of them, and values that differ only at their ends."""
    long = "x" * 300
    sessions = [(s, False, f"{long}{s}", f"{long}{s}") for s in ("a", "b")] + [("in", True, "h", "v")]
    logins = [("a", i, START + dt.timedelta(seconds=i), "root", "same") for i in range(250)] + [("a", 250 + i, START + dt.timedelta(seconds=300 + i), "root", str(i)) for i in range(60)]
    logins += [("b", 400 + i, None, long, x) for i, x in enumerate(("1", "2", "2", None))] + [("b", 410, None, None, None), ("in", 411, None, "u", "p")]
    tunnels = [("a", i, f"{long}{i}", 22) for i in range(250)] + [("in", 300, "t", 1)]
    tables = {
        "sessions": spark.createDataFrame(sessions, "id string, internal boolean, hassh string, client_version string"),
        "logins": spark.createDataFrame(logins, "session_id string, ord long, ts timestamp_ntz, username string, password string"),
        "tunnels": spark.createDataFrame(tunnels, "session_id string, ord long, dst_ip string, dst_port int"),
        "commands": spark.createDataFrame([], "session_id string, ord long, ts timestamp_ntz, command string"),
        **{n: spark.createDataFrame([], "session_id string, url string, sha256 string") for n in ("downloads", "uploads")},
    }
    want = {(s, f"{kind}:{long}{s}", w) for s in ("a", "b") for kind, w in (("hassh", 2.0), ("client", 1.0))} | {("a", f"tunnel:{long}{i}:22", 4.0) for i in range(250)}
    want |= {("a", f"login:root:{p}", 1.5) for p in ("same", *range(60))} | {("b", f"login:{x}", 1.5) for x in (f"{long}:1", f"{long}:2", f"{long}:", ":")}
    found = [tuple(r) for r in C.session_features(tables, None, ["tunnel", "hassh", "client", "login"]).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert C.session_features(tables, None, ["credlist"]).select("session_id").collect() == [("a",)]  # of the first eight, as before
