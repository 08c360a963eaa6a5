"""Campaigns: sessions linked by shared weighted evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.functions.text import digest16, normalise_command
from siltstream.functions.urls import clean_url, is_shared_hosting, url_host
from siltstream.operators.graph import connected_components
from siltstream.operators.totals import running_total
from siltstream.plans.shared import small, stage

# Weights, limits and the empty file's hash.
LINK, WEAK_GROUP, EVIDENCE = 5.0, 25, 12
COMMANDS, COMMAND_CHARS, LIST_LENGTH = 60, 400, 8
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
TRIVIAL = ["", "exit", "logout", "quit", "clear", "history -c"]
LENGTHS = {"file": 64, "url": 280, "host": 120, "command": 280}


def _ordered(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of each session in time, with their number."""
    w = W.Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), "ord")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def _feature(rows: DataFrame, kind: str, value: Column, weight: Column | float) -> DataFrame:
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    cut = F.substring(value, 1, LENGTHS[kind]) if kind in LENGTHS else value
    return rows.select("session_id", F.concat(F.lit(f"{kind}:"), cut).alias("key"), w.alias("weight")).where("key is not null and weight is not null")


def session_features(tables: dict[str, DataFrame], fetches: DataFrame | None, kinds: list[str] | None = None) -> DataFrame:
    """(session_id, key, weight) of real sessions; a key is ``kind:value`` and appears once for a session.

    Of tunnels, versions, key exchanges and logins all values that the tables have count, and whole.
    kinds: only these are worked out (all, if not told); fetches may be None where neither ``url`` nor ``host`` is among them.
    """
    s = tables["sessions"].where(~F.col("internal")).select(F.col("id").alias("session_id"), "hassh", "client_version")
    ids = s.select(F.col("session_id").alias("_id"))
    own = lambda t: t.join(ids, F.col("session_id") == F.col("_id"), "left_semi")
    files = own(tables["downloads"].select("session_id", "sha256").unionByName(tables["uploads"].select("session_id", "sha256"))).withColumn("sha256", F.lower("sha256")).where(F.col("sha256") != EMPTY_SHA256)
    seen = tables["downloads"].select("session_id", "url")
    urls = own(seen if fetches is None else seen.unionByName(fetches.select("session_id", "url"))).distinct().withColumn("clean", clean_url(F.col("url"))).where("clean is not null")
    netloc = F.regexp_extract("clean", r"^[a-z]+://([^/]*)", 1)
    tunnels = own(tables["tunnels"]).withColumn("to", F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")))
    typed = _ordered(own(tables["commands"]), COMMANDS).withColumn("c", normalise_command(F.substring("command", 1, COMMAND_CHARS))).where(~F.col("c").isin(TRIVIAL))
    script = typed.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("cs"))  # at most COMMANDS
    script = script.select("session_id", F.transform("cs", lambda x: x.c).alias("cs")).withColumn("chars", F.aggregate("cs", F.lit(0), lambda a, x: a + F.length(x)))
    steps = F.size("cs")
    script_weight = F.when((steps >= 4) | (F.col("chars") >= 80), 5.0).when((steps >= 2) & (F.col("chars") >= 30), 3.0)
    tried = own(tables["logins"]).withColumn("u", F.coalesce("username", F.lit(""))).withColumn("p", F.coalesce("password", F.lit("")))
    lists = _ordered(tried, LIST_LENGTH).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "u", "p"))).alias("l")).where(F.size("l") >= LIST_LENGTH)
    parts = {
        "file": _feature(files, "file", F.col("sha256"), 5), "url": _feature(urls, "url", F.col("clean"), 5),
        "host": _feature(urls.where(~is_shared_hosting(url_host(F.col("clean")))), "host", netloc, 3), "tunnel": _feature(tunnels, "tunnel", F.col("to"), 4),
        "hassh": _feature(s.where("hassh <> ''"), "hassh", F.col("hassh"), 2), "client": _feature(s.where("client_version <> ''"), "client", F.col("client_version"), 1),
        "command": _feature(typed, "command", F.col("c"), F.when(F.length("c") >= 80, 5.0).when(F.length("c") >= 25, 3.0)),
        "cmdseq": _feature(script, "cmdseq", digest16(F.array_join("cs", "\n")), script_weight),
        "credlist": _feature(lists, "credlist", digest16(F.to_json(F.transform("l", lambda x: F.struct(x.u.alias("u"), x.p.alias("p"))))), 4),
        "login": _feature(tried, "login", F.concat_ws(":", "u", "p"), 1.5),
    }
    wanted = list(parts if kinds is None else kinds)
    if fetches is None and {"url", "host"} & set(wanted):
        raise ValueError("urls need the fetches")
    # used several times on: kept as a table, not worked out again
    return stage(reduce(DataFrame.unionByName, [parts[k] for k in wanted]).dropDuplicates(["session_id", "key"]), "features")


def key_sizes(features: DataFrame) -> DataFrame:
    """(key, size, w) of the keys that sessions share, once written."""
    return stage(features.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("weight").alias("w")).where("size > 1"), "sizes")


def _weak_pairs(features: DataFrame, sizes: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """a, b: pairs of sessions of which the shared weak keys, of at most WEAK_GROUP sessions each, sum to LINK."""
    weak = sizes.where((F.col("w") < LINK) & (F.col("size") <= WEAK_GROUP))
    if max_pairs is not None:
        weak = running_total(weak.withColumn("_pairs", F.expr("size * (size - 1) / 2").cast("long")), "_pairs", ["size", "key"], "upto").where(F.col("upto") <= max_pairs)
    own = features.join(weak.select("key"), "key", "left_semi").select("key", "session_id", "weight")
    other = own.select("key", F.col("session_id").alias("b"))
    scored = own.join(other, "key").where("session_id < b").groupBy(F.col("session_id").alias("a"), "b").agg(F.sum("weight").alias("score"))
    return scored.where(F.col("score") >= LINK).select("a", "b")


def link_edges(features: DataFrame, order: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """(a, b): links of sessions.

    A strong key links all its sessions to the first in time, however many. Weak keys of at most
    WEAK_GROUP sessions score the pairs that share them; larger ones are counted but never paired.
    max_pairs: take weak keys from the rarest on while their pairs fit (W6).
    """
    sizes = key_sizes(features)
    labelled = features.join(order, features.session_id == order.id).select("session_id", "key", "label")
    strong = labelled.join(sizes.where(F.col("w") >= LINK).select("key"), "key", "left_semi")
    first = strong.groupBy("key").agg(F.min_by("session_id", "label").alias("b"))
    star = strong.join(first, "key").where("session_id <> b").select(F.col("session_id").alias("a"), "b").distinct()
    return star.unionByName(_weak_pairs(features, sizes, max_pairs))


def linked_sessions(features: DataFrame) -> DataFrame:
    """(node, root): sessions of components of two or more by the links of ``link_edges``; root tells components apart.

    Strong keys are united first: two are linked if a session has both, so that the graph has a node for each key, not for each
    session, and no key gathers its sessions. Pairs by weak keys then unite what that has left apart.
    """
    sizes = key_sizes(features)
    strong = features.join(small(sizes.where(F.col("w") >= LINK).select("key")), "key", "left_semi")
    keys = strong.groupBy("session_id").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    several = strong.join(keys.where("least <> most").select("session_id", "least"), "session_id").where("key <> least")
    united = connected_components(several.select(F.col("key").alias("a"), F.col("least").alias("b")).distinct())
    named = small(united.select(F.col("node").alias("least"), "root"))
    found = keys.join(named, "least", "left").select(F.col("session_id").alias("node"), F.concat(F.lit("k"), F.coalesce("root", "least")).alias("root"))
    pairs = stage(_weak_pairs(features, sizes), "pairs")
    if pairs.isEmpty():
        return found
    found = stage(found, "strong")
    own = lambda d, side: d.join(found.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", F.concat(F.lit("s"), side)))
    ends = stage(own(own(pairs, "a"), "b"), "ends")
    joined = connected_components(ends.select("root_a", "root_b"), "root_a", "root_b").select(F.col("node").alias("_root"), F.col("root").alias("_new"))
    loose = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("root_a").alias("root")), F.struct(F.col("b").alias("node"), F.col("root_b").alias("root")))).alias("e")).select("e.*").where("root like 's%'").distinct()
    return found.unionByName(loose).join(small(joined), F.col("root") == F.col("_root"), "left").select("node", F.coalesce("_new", "root").alias("root"))


def start_order(sessions: DataFrame) -> DataFrame:
    """(id, label) of real sessions: labels compare by start, those without one last."""
    return sessions.where(~F.col("internal")).select("id", F.struct(F.isnull("start_time").alias("late"), "start_time", "id").alias("label"))


def named_members(found: DataFrame, order: DataFrame) -> DataFrame:
    """(session_id, campaign) for groups (node, root): the earliest session names the campaign."""
    first = found.join(order, F.col("node") == F.col("id")).groupBy("root").agg(F.min_by("node", "label").alias("first"))
    return stage(found.join(small(first), "root").select(F.col("node").alias("session_id"), F.concat(F.lit("c"), F.substring(digest16(F.col("first")), 1, 10)).alias("campaign")), "campaigns")


def campaign_members(features: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, campaign): sessions of components of two or more; the earliest session names the campaign.

    features are those of real sessions, as ``session_features`` gives them.
    """
    return named_members(stage(linked_sessions(features), "groups"), start_order(sessions))


def campaign_rollup(members: DataFrame, sessions: DataFrame) -> DataFrame:
    """First and last seen, sessions and addresses of each campaign."""
    joined = members.join(sessions, F.col("session_id") == F.col("id"))
    return joined.groupBy("campaign").agg(F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"), F.count(F.lit(1)).alias("sessions"), F.countDistinct("src_ip").alias("ips"))


def campaign_evidence(members: DataFrame, features: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """(campaign, rank, kind, value, sessions): what members share, strongest first."""
    everywhere = features.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("weight").alias("w"))
    shared = members.join(features, "session_id").groupBy("campaign", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    shared = shared.join(everywhere, "key").where((F.col("w") >= LINK) | (F.col("size") <= WEAK_GROUP))
    score = F.round(F.col("w") * F.log2(1 + F.col("n")), 9)
    rank = F.row_number().over(W.Window.partitionBy("campaign").orderBy(score.desc(), "key"))
    top = shared.withColumn("rank", rank).where(F.col("rank") <= limit)
    return top.select("campaign", "rank", F.substring_index("key", ":", 1).alias("kind"), F.expr("substring(key, locate(':', key) + 1)").alias("value"), F.col("n").alias("sessions"))


def campaign_list(rollup: DataFrame, evidence: DataFrame, min_ips: int = 1, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Campaigns with their first evidence, biggest first (L3)."""
    best = evidence.where("rank = 1").select(F.col("campaign").alias("_c"), F.concat_ws(":", "kind", "value").alias("evidence"))
    out = rollup.where(F.col("ips") >= min_ips).join(best, F.col("campaign") == F.col("_c"), "left").drop("_c")
    out = out.orderBy(F.desc("sessions"), F.desc_nulls_last("last_seen"), "campaign").offset(offset)
    return out if limit is None else out.limit(limit)


def _top_values(rows: DataFrame, value: str, limit: int, count: Column) -> DataFrame:
    n = rows.where(F.col(value).isNotNull()).groupBy("campaign", value).agg(count.alias("n"))
    rank = F.row_number().over(W.Window.partitionBy("campaign").orderBy(F.desc("n"), value))
    return n.withColumn("rank", rank).where(F.col("rank") <= limit).select("campaign", "rank", F.col(value).alias("value"), "n")


def campaign_detail(members: DataFrame, tables: dict[str, DataFrame], matches: DataFrame) -> DataFrame:
    """(campaign, what, rank, value, n) for all campaigns: addresses (50), commands (15), hassh (10), techniques."""
    s = members.join(tables["sessions"], F.col("session_id") == F.col("id"))
    c = members.join(tables["commands"], "session_id")
    t = members.join(matches, "session_id")
    parts = [("ip", _top_values(s, "src_ip", 50, F.count(F.lit(1)))), ("hassh", _top_values(s, "hassh", 10, F.count(F.lit(1)))), ("command", _top_values(c, "command", 15, F.count(F.lit(1)))), ("technique", _top_values(t, "technique", 1000, F.countDistinct("session_id")))]
    return reduce(DataFrame.unionByName, [d.select("campaign", F.lit(n).alias("what"), "rank", "value", "n") for n, d in parts])


def coverage(members: DataFrame, sessions: DataFrame) -> DataFrame:
    total = sessions.where(~F.col("internal")).agg(F.count(F.lit(1)).alias("total"))
    return members.agg(F.countDistinct("campaign").alias("campaigns"), F.count(F.lit(1)).alias("sessions")).crossJoin(F.broadcast(total))
