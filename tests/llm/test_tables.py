"""Operators 1, 8 and 9, and the pipeline."""

import hashlib
import math
import random
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siltstream.llm.decontaminate import keep_clean
from siltstream.llm.mixing import SOFT, entropy_rates, mix, mixed, targets
from siltstream.llm.rows import repeated, with_row
from siltstream.llm.sharding import plan_shards, reshard, rewrite_shards, shard_documents
from siltstream.plans.shared import shared_dir
from siltstream.llm.simhash import keep_first
from siltstream.llm.warc import archive_round_trip, build_index, open_index, surt, write_warc

from . import brute
from .conftest import got, want

PAGES = "page_id bigint, url string, html string"


def test_warc(spark):
    big, other = "<p>é" * 60, "<b>" * 50
    rows = [(5, "http://a.example/", big), (3, "http://www.b.example:8080/x?y=1#f", big), (9, None, big), (1, "http://c.example/", "short"), (2, "http://c.example/", "short"), (4, "nonsense", None), (6, "http://a.example/", other), (None, "http://a.example/", other), (7, "http://[::1]/", ""), (3, "http://www.b.example:8080/x?y=1#f", big), (8, "http://a.example/\n", other + "x")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES + ", kind string, digest string")
    def payload(h):
        return (h or "").encode()
    expected, first = [], {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        d = hashlib.sha256(payload(h)).hexdigest()
        again = len(payload(h)) >= 100 and d in first
        expected.append((p, len(payload(h)), d, "revisit" if again else "response", first[d] if again else None))
        first.setdefault(d, p)
    assert got(archive_round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want(expected)
    assert archive_round_trip(df.limit(0)).count() == 0


def test_index_look_ups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siltstream.llm.warc.BLOCK_LINES", 7)
    rows = [(i, f"http://h{i % 9}.example/p{i % 50}", f"<p>{i}") for i in range(300)]
    df = spark.createDataFrame(rows, PAGES)
    folder = f"file://{tmp_path}"
    captures = write_warc(df, f"{folder}/warc")
    index = open_index(build_index(captures, f"{folder}/cdx"), f"{folder}/cdx")
    assert len(index.rows) > 40
    for url in {r[1] for r in rows}:
        assert sorted(x[1] for x in index.find(surt(url), any_page=True)) == [r[0] for r in rows if r[1] == url]
    assert list(index.find("nothing")) == [] and list(index.find("zzz", any_page=True)) == []
    assert surt("https://User@WWW.Example.com:443/A?b#c") == "com,example,www)/A?b"


def test_shards(docs, odd, empty, texts):
    for df, rows in ((docs, [(d, t) for d, t, _, _ in texts[0]]), odd):
        out = shard_documents(df).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d is None, d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
        for s in {r.shard for r in out}:
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
        assert all(0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None for r in out)
    assert shard_documents(empty).count() == 0
    assert got(reshard(docs), "doc_id", "shard", "slot") == got(shard_documents(docs), "doc_id", "shard", "slot") and reshard(empty).count() == 0


def test_shards_even(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 200).cast("int")).alias("text"))
    sizes = [r.b for r in shard_documents(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 200
    assert got(shard_documents(df), "doc_id", "shard", "slot") == got(shard_documents(df.repartition(7)), "doc_id", "shard", "slot")


def test_one_row_repeated(spark):
    """A third of the rows alike: runs of them are cut, and no row is lost."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "seven words").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"), F.lit("s").alias("source"))
    out = shard_documents(df)
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert out.count() == 3000 and max(sizes) - min(sizes) < 60
    assert mix(df).count() == 3000


def test_rewrite(docs, odd, spark, tmp_path):
    """Touched shards are written whole and in order; old and new files hold every row once, with its own columns."""
    for i, df in enumerate((docs, odd[0])):
        path = f"file://{tmp_path}/shards{i}"
        touched, plan = rewrite_shards(df, path)
        back = spark.read.parquet(path)
        assert set(touched) >= {r.shard for r in back.select("shard").collect()}  # a shard may get no row where rows are few
        names = ["doc_id", "size", "text_crc32", "shard", "slot"]
        assert got(back, *names) == got(plan.where(F.col("shard").isin(touched)), *names)
        rows = back.select("row.*")
        assert rows.columns == df.columns and (len(touched) < 16 or got(rows, *df.columns) == got(df, *df.columns))


def test_moved_bytes(spark):
    """From an uneven layout the plan moves the fewest bytes, documents the bytes that it planned, and balanced shards stay."""
    rows = [(i, "x" * 9, [0, 0, 0, 0, 0, 0, 1, 1, 2, 3, 3, 3][i % 12]) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, home int")
    plan, flow = plan_shards(df, 4, 4, old="home")
    supply = [10 * sum(h == s for _, _, h in rows) for s in range(4)]
    fewest = sum(max(0, x - 3000) for x in supply)
    assert sum(flow[i][j] for i in range(4) for j in range(4) if i != j) == fewest
    out = plan.collect()
    assert sum(r.size for r in out if r.shard != r.old_shard) == fewest
    assert {s: sum(r.size for r in out if r.shard == s) for s in range(4)} == dict.fromkeys(range(4), 3000)
    # shard 3 has what it should have
    assert all(r.shard == 3 for r in out if r.old_shard == 3)
    assert rewrite_shards(df, f"{shared_dir(spark)}/moved", 4, old="home")[0] == [0, 1, 2]


def test_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 5000, None: 20}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    out = {r.source: r.target for r in targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2), strict=True))
    total, fixed = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in fixed)
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in fixed) for s in sizes if s not in fixed}
        over = {s for s, x in share.items() if x > 2 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s in sizes:
        assert out[s] == pytest.approx(2 * sizes[s] if s in fixed else share[s])


def test_two_margins(spark):
    """Sources are met, rates stay within bounds, and the solution is that of the penalised problem."""
    tokens = {("a", "x"): 100, ("a", "y"): 300, ("b", "x"): 200, ("b", "y"): 50, (None, "y"): 40, ("z", "x"): 10, ("w", "x"): 7}
    cells = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "source string, lang string, tokens bigint")
    aim = {"a": 500.0, "b": 100.0, None: 20.0, "z": 20.0, "w": 0.0}
    soft = {"x": 350.0, "y": 290.0}
    out = entropy_rates(cells, spark.createDataFrame(list(aim.items()), "source string, target double"), spark.createDataFrame(list(soft.items()), "lang string, target double")).collect()
    rate = {(r.source, r.lang): r.rate for r in out}
    for s, t in aim.items():
        assert sum(n * rate[k] for k, n in tokens.items() if k[0] == s) == pytest.approx(t, rel=1e-8)
    assert rate["z", "x"] == 2 and rate["w", "x"] == 0 and all(0 <= r <= 2 for r in rate.values())
    tilt = lambda k: math.log(rate[k] / (2 - rate[k]))
    # stationary: the two languages' multipliers differ by the same amount in every source, and pay for the deviation
    assert tilt(("a", "x")) - tilt(("a", "y")) == pytest.approx(tilt(("b", "x")) - tilt(("b", "y")), abs=1e-4)
    got_ = {m: sum(n * rate[k] for k, n in tokens.items() if k[1] == m) for m in soft}
    b = {m: (soft[m] - got_[m]) / (SOFT * sum(n for k, n in tokens.items() if k[1] == m)) for m in soft}
    assert b["x"] - b["y"] == pytest.approx(tilt(("a", "x")) - tilt(("a", "y")), abs=1e-4)
    with pytest.raises(ArithmeticError):
        entropy_rates(cells, spark.createDataFrame([("a", 300.0), ("b", 200.0)], "source string, target double"), steps=1, exact=1e-30)


def test_mix_meets_targets(spark):
    """Every source's taken words come as near as its smallest document allows; languages come near their shares."""
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 30) if i % 50 else 700)), ["en", "de", "fr"][(i * i) % 3], f"s{i % 7 if i % 2 else 0}") for i in range(3000)]
    out = mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)).collect()
    source, lang = {d: s for d, _, _, s in rows}, {d: x for d, _, x, _ in rows}
    for s in set(source.values()):
        own = [x for x in out if source[x.doc_id] == s]
        assert sum(x.size for x in own) == own[0].source_size
        assert abs(sum(x.taken for x in own) - own[0].target) <= 15
    assert all(x.taken in (0, x.size, 2 * x.size) for x in out)
    total, taken = sum(x.size for x in out), sum(x.taken for x in out)
    for m in ("en", "de", "fr"):
        have, got_ = (sum(getattr(x, c) for x in out if lang[x.doc_id] == m) for c in ("size", "taken"))
        assert got_ / taken == pytest.approx(have / total, abs=0.03)


def test_repeated(spark):
    df = spark.createDataFrame([("a", 3), ("b", 25), ("c", 0), ("d", 10)], "x string, n bigint")
    assert got(repeated(df, "n", "i", most=10), "x", "i") == sorted((x, i) for x, n in (("a", 3), ("b", 25), ("d", 10)) for i in range(n))


def test_mix(docs, odd, empty, texts):
    for df, rows in ((docs, [(d, t) for d, t, _, _ in texts[0]]), odd):
        out = mix(df)
        assert got(out, "doc_id", "size") == want([(d, len(brute.spaced(t))) for d, t in rows])
        assert all(0 <= r.taken <= 2 * r.size for r in out.collect())
        again = mix(df.repartition(3))
        names = ["doc_id", "size", "source_size", "taken"]
        assert got(out, *names) == got(again, *names)
        # the stage repeats texts with words as often as the operator says of rows that have numbers for doc_ids
        numbered = with_row(df, "text", "source", "lang").withColumnRenamed("uid", "doc_id")
        assert sum(bool(brute.spaced(r.text)) for r in mixed(df).collect()) == sum(r.taken // r.size for r in mix(numbered).collect() if r.size)
    assert mix(empty).count() == 0


def test_stages_odd(odd, empty, items):
    """Clashing columns, nulls and repeats come through the stages."""
    assert keep_first(odd[0]).columns == odd[0].columns and keep_clean(odd[0], items).columns == odd[0].columns
    assert mixed(odd[0]).columns == odd[0].columns and keep_clean(odd[0], items).count() <= odd[0].count()
    assert [f(empty).count() for f in (mixed, keep_first)] == [0, 0]


def test_stages_by_row(spark, items, texts, tmp_path):
    """Verdicts concern rows: a bad text takes no other of its doc_id, or of none, with it, and of copies one stays."""
    text = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(8)]
    leak = texts[1][1][1]
    rows = [(None, text[0]), (None, text[0]), (None, "too short"), (None, f"{text[1]} {leak}"), (None, text[2]), (None, text[3])]
    rows += [(7, text[2]), (7, "short too"), (8, text[4]), (8, f"{text[5]} {leak}"), (9, text[6]), (9, text[6]), (10, text[7])]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    own = lambda d: got(d, "doc_id", "text")
    assert own(corpus_pipeline.quality(spark, df, str(tmp_path))) == want([r for r in rows if "short" not in r[1]])
    once = {r: None for r in rows if r != (None, text[2])}
    assert own(corpus_pipeline.near_duplicates(spark, df, str(tmp_path))) == want(once)
    assert own(corpus_pipeline.decontamination(spark, df, str(tmp_path))) == want([r for r in rows if leak not in r[1]])


def test_pipeline(spark, docs, items, texts, tmp_path):
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _, _ in texts[0]], "doc_id bigint, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", items), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(d, t) for d, t, _, _ in texts[0]]
    good = {r[0] for r in brute.quality(rows) if not r[6]}
    rows = [r for r in rows if r[0] in good]
    first = {c for _, _, c in brute.components([(d, brute.fingerprint(t)) for d, t in rows])}
    rows = [r for r in rows if r[0] in first]
    clean = {r[0] for r in brute.decontaminate(rows, texts[1]) if not r[5]}
    at = docs
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert set(out.columns) - set(docs.columns) == ({"size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"} if i == 4 else set())
        out.write.parquet(f"{tmp_path}/out{i}")
        at = spark.read.parquet(f"{tmp_path}/out{i}")
        kept.append(sorted(r.doc_id for r in at.select("doc_id").collect()))
    assert set(kept[0]) == good and kept[1] == sorted(first) and kept[2] == sorted(clean)
    assert set(kept[3]) <= clean and kept[3] == kept[4]
    assert got(at.select(*docs.columns), *docs.columns) == got(spark.read.parquet(f"{tmp_path}/out3"), *docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "sharding"


def test_sharding_loses_nothing(spark):
    """Rows of no old shard are an error with their number; columns that clash with ours are kept."""
    df = spark.createDataFrame([(i, f"text {i}", o, f"mine {i}", 7) for i, o in enumerate((0, None, 99, 3, -1))], "doc_id long, text string, old int, shard string, size int")
    with pytest.raises(ValueError, match="3 rows"):
        plan_shards(df, 4, 4, old="old")
    assert plan_shards(df.where("doc_id in (0, 3)"), 4, 4, old="old")[0].count() == 2
    out = reshard(df, columns=True)
    assert {(r.doc_id, r.shard, r["size"], r.old) for r in out.collect()} == {(i, f"mine {i}", 7, o) for i, o in enumerate((0, None, 99, 3, -1))}
    plain = {r.doc_id: (r.shard, r.slot) for r in shard_documents(df).collect()}
    assert {r.doc_id: (r.new_shard, r.slot) for r in out.collect()} == plain
