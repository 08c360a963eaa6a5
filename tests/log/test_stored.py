"""Tables of the log that are written in one pass, and features of the kinds that a query needs."""

import datetime as dt
import random

import pytest

from siltstream.operators import campaigns as C
from siltstream.operators import sessions as S
from siltstream.plans.queries import Log

KINDS = ["cowrie.login.failed", "cowrie.login.success", "cowrie.command.input", "cowrie.session.file_download", "cowrie.session.file_upload", "cowrie.direct-tcpip.request", "cowrie.session.closed", "cowrie.client.kex", None]
FORM = "ord long, ts timestamp_ntz, eventid string, session string, src_ip string, username string, password string, input string, url string, shasum string, filename string, destfile string, dst_ip string, dst_port int, orig_ip string, orig_port int, version string, hassh string, duration_ms long"


@pytest.fixture(scope="module")
def events(spark):
    """Repeats, nulls everywhere, sessions without a name, one session beyond its caps."""
    r, rows = random.Random(4), []
    some = lambda *xs: r.choice([*xs, None])
    for i in range(3000):
        ts = some(*[dt.datetime(2026, 3, 1, 0, 0, s) for s in range(9)])
        session = "big" if i % 2 else some("a", "b", "c", "")
        kind = r.choice(KINDS[3:5] if i % 4 == 1 else KINDS)
        rows.append((i, ts, kind, session, some("4.4.4.4", "10.0.0.1") if session == "c" else "5.5.5.5", some("root", "x"), some("1", ""), some("id", "ls", ""), some("http://h.bad/x", "", f"http://h.bad/{i}"), some("0" * 64, "a" * 64), some("f", "", f"f{i}"), some("/tmp/x"), some("9.9.9.9", ""), some(22, 0), some("127.0.0.1"), some(1), some("v"), some("h"), some(5)))
    return spark.createDataFrame(rows, FORM)


def rows(d):
    return sorted(map(str, d.collect()))


@pytest.mark.parametrize("names", [None, ["downloads", "uploads"], ["commands"], ["tunnels", "logins"]])
def test_stage_events(events, names):
    """What is written in one pass is what each table's own pass makes, caps and repeats included."""
    plain, stored = S.store_events(events), S.stage_events(events, names)
    assert set(stored) == {"sessions", *(names or S.CAPS)}
    for name, d in stored.items():
        assert d.dtypes == plain[name].dtypes and rows(d) == rows(plain[name])
    assert stored["sessions"].count() == 4


def test_stage_events_empty(events):
    assert all(d.count() == 0 for d in S.stage_events(events.limit(0)).values())


def test_features_of_some_kinds(spark):
    """Asking for kinds gives the same rows as leaving the others out, without the commands' fetches; urls can't do without."""
    log = Log(spark, "/root/testdata/sf0.001")
    every = C.session_features(log.tables, log.fetches)
    for kinds in (["file"], ["tunnel", "hassh", "client", "login"], ["command", "cmdseq", "credlist"]):
        own = every.where(" or ".join(f"key like '{k}:%'" for k in kinds))
        assert rows(C.session_features(log.tables, None, kinds)) == rows(own)
    assert rows(C.session_features(log.tables, log.fetches, ["url", "host"])) == rows(every.where("key like 'url:%' or key like 'host:%'"))
    with pytest.raises(ValueError):
        C.session_features(log.tables, None, ["file", "url"])


def test_stored_log_writes_only_what_is_asked(spark):
    """One folder of child rows for all tables asked for; the others stay as they are."""
    log = Log(spark, "/root/testdata/sf0.001")
    before = dict(log.tables)
    log.store("downloads", "uploads")
    assert log.tables["logins"] is before["logins"]
    assert {f.rsplit("/", 2)[0] for t in ("downloads", "uploads") for f in log.tables[t].inputFiles()}.__len__() == 1
