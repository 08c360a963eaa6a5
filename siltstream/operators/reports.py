"""Totals, funnel, top lists, hourly activity, technique counts, session pages (A3 to A11, L*, P*, J*, S11)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.operators import rules as R
from siltstream.plans.shared import stage

# The rules that mean a visitor looks for a honeypot.
PROBE_RULES = ["discovery-virtualization", "discovery-ssh-version"]
PAGE, MIN_PREFIX = 25, 6


def real(sessions: DataFrame, with_internal: bool = False) -> DataFrame:
    """Sessions that are not internal."""
    return sessions if with_internal else sessions.where(~F.col("internal"))


def hidden(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count_if("internal").alias("hidden"), F.count(F.lit(1)).alias("total"))


def since(sessions: DataFrame, start: Column) -> DataFrame:
    """Sessions that began at ``start`` or later; those without a start didn't."""
    return sessions.where(F.col("start_time") >= start)


def starting_with(sessions: DataFrame, prefix: str) -> DataFrame:
    """Sessions of which the address or id begins with ``prefix``, taken as it stands."""
    return sessions.where(F.col("src_ip").startswith(F.lit(prefix)) | F.col("id").startswith(F.lit(prefix)))


def with_technique(sessions: DataFrame, matches: DataFrame, technique: str) -> DataFrame:
    own = matches.where(F.col("technique") == technique).select("session_id").distinct()
    return sessions.join(own, sessions.id == own.session_id, "left_semi")


def from_country(sessions: DataFrame, geo: DataFrame, country: str) -> DataFrame:
    """Sessions from a country, or (unknown) from no located address (P5)."""
    located = geo.where("country_code is not null")
    if country.lower() == "unknown":
        return sessions.join(located.select(F.col("ip").alias("_ip")), F.col("src_ip") == F.col("_ip"), "left_anti")
    own = located.where(F.col("country_code") == country.upper()).select(F.col("ip").alias("_ip"))
    return sessions.join(own, F.col("src_ip") == F.col("_ip"), "left_semi")


def resolve_id(sessions: DataFrame, text: str) -> str | None:
    """The id that ``text`` is, or the only one it begins; raises ValueError where it begins several."""
    found = [r[0] for r in sessions.where(F.col("id").startswith(F.lit(text)) & ((F.col("id") == text) | F.lit(len(text) >= MIN_PREFIX))).select("id").orderBy(F.length("id"), "id").limit(2).collect()]
    if found and (found[0] == text or len(found) == 1):
        return found[0]
    if found:
        raise ValueError(f"{text} begins more than one id")
    return None


def session_flags(tables: dict[str, DataFrame], matches: DataFrame) -> DataFrame:
    """One row per session with what it did (J3, J5): accepted, commanded, moved files, tunnelled, acted, and counts.

    Children are brought to a row per session before they are joined, so nothing multiplies.
    """
    logins = tables["logins"].groupBy("session_id").agg(F.count(F.lit(1)).alias("logins"), F.count_if("success").alias("accepted"), F.count_if(~F.col("success")).alias("failed"))
    out = tables["sessions"].join(logins, F.col("id") == logins.session_id, "left").drop("session_id")
    for name in ("commands", "downloads", "uploads", "tunnels"):
        c = tables[name].groupBy(F.col("session_id").alias("_s")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(c, F.col("id") == F.col("_s"), "left").drop("_s")
    action = F.exists(F.split("tactics", ","), lambda t: t.isin(R.ACTION_TACTICS))
    acted = matches.where(F.col("ord").isNotNull() & action).select(F.col("session_id").alias("_s"), F.lit(True).alias("_acted")).distinct()
    out = out.join(acted, F.col("id") == F.col("_s"), "left").drop("_s")
    zero = ["logins", "accepted", "failed", "n_commands", "n_downloads", "n_uploads", "n_tunnels"]
    out = out.fillna(0, zero)
    moved = (F.col("n_downloads") + F.col("n_uploads") + F.col("n_tunnels")) > 0
    return out.withColumn("acted", moved | F.coalesce("_acted", F.lit(False))).drop("_acted")


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """sessions, sources, accepted_logins, commands, files, last_event of real sessions (A3)."""
    s = real(tables["sessions"])
    one = s.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("src_ip").alias("sources"), F.max("start_time").alias("last_event"))
    ids = s.select("id")
    own = lambda t: tables[t].join(ids, F.col("session_id") == ids.id, "left_semi")
    files = own("downloads").select("sha256").unionByName(own("uploads").select("sha256")).agg(F.countDistinct("sha256").alias("files"))
    for other in (own("logins").agg(F.count_if("success").alias("accepted_logins")), own("commands").agg(F.count(F.lit(1)).alias("commands")), files):
        one = one.crossJoin(F.broadcast(other))  # one row each
    return one.select("sessions", "sources", "accepted_logins", "commands", "files", "last_event")


def pulse(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.max("start_time").alias("last_event"))


def depth(flags: DataFrame) -> DataFrame:
    """How far real sessions got: contact, access, hands_on and action, in one pass (A5)."""
    access = F.col("accepted") > 0
    return real(flags).agg(
        F.count(F.lit(1)).alias("contact"), F.count_if(access).alias("access"),
        F.count_if(access & (F.col("n_commands") > 0)).alias("hands_on"), F.count_if(access & F.col("acted")).alias("action"),
    )


def _per_ip(sessions: DataFrame) -> DataFrame:
    return real(sessions).where("src_ip is not null").groupBy("src_ip").agg(F.count(F.lit(1)).alias("sessions"), F.max("start_time").alias("last_seen"))


def map_points(sessions: DataFrame, geo: DataFrame, intel: DataFrame, limit: int = 500) -> DataFrame:
    """The busiest located addresses with place, network and abuse score."""
    abuse = intel.where("provider = 'abuseipdb'").select(F.col("ip").alias("_ip"), F.col("score").alias("abuse"))
    g = geo.where("latitude is not null and longitude is not null")
    p = _per_ip(sessions).join(g, F.col("src_ip") == g.ip).join(abuse, F.col("src_ip") == F.col("_ip"), "left")
    return p.select("src_ip", "country_code", "city", "latitude", "longitude", "asn", "as_org", "abuse", "sessions", "last_seen").orderBy(F.desc("sessions"), "src_ip").limit(limit)


def _top(sessions: DataFrame, geo: DataFrame, where: str | None, keys: list[Column], limit: int, how: str) -> DataFrame:
    p = _per_ip(sessions) if how == "inner" else real(sessions).groupBy("src_ip").agg(F.count(F.lit(1)).alias("sessions"))
    g = geo if where is None else geo.where(where)
    joined = p.join(g, F.col("src_ip") == g.ip, how)
    t = joined.groupBy(*keys).agg(F.sum("sessions").alias("sessions"), F.count("src_ip").alias("sources"))
    names = [c for c in t.columns if c not in ("sessions", "sources")]
    return t.orderBy(F.desc("sessions"), *[F.col(n).asc_nulls_first() for n in names]).limit(limit)


def top_places(sessions: DataFrame, geo: DataFrame, limit: int = 8) -> DataFrame:
    return _top(sessions, geo, "city is not null", ["city", "region", "country_code"], limit, "inner")


def top_networks(sessions: DataFrame, geo: DataFrame, limit: int = 6) -> DataFrame:
    return _top(sessions, geo, "as_org is not null", ["asn", "as_org"], limit, "inner")


def top_countries(sessions: DataFrame, geo: DataFrame, limit: int = 8) -> DataFrame:
    return _top(sessions, geo, None, [F.coalesce("country_code", F.lit("unknown")).alias("country")], limit, "left")


def hourly_activity(sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(hour, sessions) of the last hours, the running one included, zeros too, oldest first."""
    spark = sessions.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_trunc("hour", now) - F.make_interval(hours=F.lit(hours - 1)), F.date_trunc("hour", now), F.expr("interval 1 hour"))).alias("hour")).select(F.col("hour").cast("timestamp_ntz"))
    counted = real(sessions).groupBy(F.date_trunc("hour", "start_time").cast("timestamp_ntz").alias("_hour")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, F.col("hour") == F.col("_hour"), "left").select("hour", F.coalesce("n", F.lit(0)).alias("sessions")).orderBy("hour")


def technique_counts(sessions: DataFrame, matches: DataFrame, techniques: DataFrame, limit: int | None = None) -> DataFrame:
    """(technique, name, tactics, sessions, hits) over real sessions."""
    ids = real(sessions).select("id")
    own = matches.join(ids, F.col("session_id") == ids.id, "left_semi")
    t = own.groupBy("technique", "session_id").agg(F.count(F.lit(1)).alias("n")).groupBy("technique").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("hits"))
    t = t.join(F.broadcast(techniques.select("technique", "name", "tactics")), "technique", "left").orderBy(F.desc("sessions"), "technique")
    t = t.select("technique", "name", "tactics", "sessions", "hits")
    return t if limit is None else t.limit(limit)


def attack_matrix(counts: DataFrame) -> DataFrame:
    """(place, tactic, technique, sessions, hits): techniques under each of their tactics in reading order (A10)."""
    order = F.array(*[F.lit(t) for t in R.TACTIC_ORDER])
    split = F.filter(F.split(F.coalesce("tactics", F.lit("")), ","), lambda x: x != "")
    rows = counts.select(F.explode(F.when(F.size(split) > 0, split).otherwise(F.array(F.lit("other")))).alias("tactic"), "technique", "sessions", "hits")
    place = F.array_position(order, F.col("tactic"))
    return rows.select(F.when(place == 0, 99).otherwise(place).cast("int").alias("place"), "tactic", "technique", "sessions", "hits").orderBy("place", "tactic", F.desc("sessions"), "technique")


def probing_sessions(sessions: DataFrame, matches: DataFrame) -> DataFrame:
    ids = real(sessions).select("id")
    return matches.where(F.col("rule").isin(PROBE_RULES)).join(ids, F.col("session_id") == ids.id, "left_semi").agg(F.countDistinct("session_id").alias("probing_sessions"))


def probes(sessions: DataFrame, matches: DataFrame, limit: int = 20) -> DataFrame:
    s = real(sessions).select("id", "src_ip", "start_time")
    found = matches.where(F.col("rule").isin(PROBE_RULES)).join(s, F.col("session_id") == s.id)
    return found.select("session_id", "src_ip", "start_time", "rule", "evidence", "ord").orderBy(F.desc_nulls_last("start_time"), "session_id", "ord", "rule").limit(limit)


@dataclass
class Page:
    rows: DataFrame
    total: int
    page: int
    pages: int


def session_page(flags: DataFrame, matches: DataFrame, geo: DataFrame, intel: DataFrame, page: int = 1, size: int = PAGE, prefix: str = "", technique: str = "", country: str = "") -> Page:
    """A page of real sessions, newest first (L1). Only its sessions are looked up in the other tables."""
    s = real(flags)
    s = starting_with(s, prefix) if prefix else s
    s = with_technique(s, matches, technique) if technique else s
    s = from_country(s, geo, country) if country else s
    # flags are dear, and both the count and the page need them
    s = stage(s.select("id", "src_ip", "start_time", "logins", F.col("n_commands").alias("commands")), "page")
    total = s.count()
    pages = max(1, -(-total // size))
    page = min(max(page, 1), pages)
    own = s.orderBy(F.desc_nulls_last("start_time"), "id").offset((page - 1) * size).limit(size)
    own = F.broadcast(own)  # at most a page
    place = geo.select(F.col("ip").alias("_g"), F.col("country_code").alias("country"))
    seen = intel.groupBy(F.col("ip").alias("_i")).pivot("provider", ["abuseipdb", "tor"]).agg(F.first("score").alias("score"), F.first("flagged").alias("flagged"))
    seen = seen.select("_i", F.col("abuseipdb_score").alias("abuse"), F.col("tor_flagged").alias("tor"))
    used = matches.join(own.select("id"), F.col("session_id") == F.col("id"), "left_semi").groupBy(F.col("session_id").alias("_t")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("technique"))).alias("techniques"))
    rows = own.join(place, F.col("src_ip") == F.col("_g"), "left").join(seen, F.col("src_ip") == F.col("_i"), "left").join(used, F.col("id") == F.col("_t"), "left")
    rows = rows.select("id", "src_ip", "start_time", "logins", "commands", "country", "abuse", "tor", F.coalesce("techniques", F.lit("")).alias("techniques"))
    return Page(rows.orderBy(F.desc_nulls_last("start_time"), "id"), total, page, pages)


# Rows that a session's detail shows of each kind.
SHOWN = {"logins": 100, "commands": 500, "downloads": 100, "uploads": 100, "tunnels": 100, "fetches": 100}


def detail_totals(tables: dict[str, DataFrame], fetches: DataFrame) -> DataFrame:
    """(session_id, kind, total, shown): how many rows of a kind a session has, and how many of them its detail shows (L6). Kinds without rows are left out."""
    ones = [d.select("session_id", F.lit(n).alias("kind")) for n, d in {**{n: tables[n] for n in SHOWN if n != "fetches"}, "fetches": fetches}.items()]
    n = reduce(DataFrame.unionByName, ones).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("total"))
    most = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    return n.withColumn("shown", F.least("total", F.element_at(most, F.col("kind")).cast("long")))


def session_detail(tables: dict[str, DataFrame], fetches: DataFrame, matches: DataFrame, verdicts: DataFrame, session: str) -> dict[str, DataFrame]:
    """What is stored of one session: bounded child tables in order of time, files with verdicts, commands with what matched in them.

    ``session`` is the session's own row, ``totals`` counts all rows of each kind, ``matches`` are those of the session as a whole. Each table is
    filtered by the id before anything else, so only one session is sorted and joined.
    """
    own = {n: d.where(F.col("session_id") == session) for n, d in {**tables, "fetches": fetches, "matches": matches}.items() if n != "sessions"}
    out = {"session": tables["sessions"].where(F.col("id") == session), "totals": detail_totals(own, own["fetches"]).drop("session_id").orderBy("kind")}
    place = lambda n: ["ts", "url"] if n == "fetches" else ["ts", "ord"]
    out |= {n: own[n].orderBy(*place(n)).limit(k) for n, k in SHOWN.items()}
    said = F.struct("technique", "rule", "confidence", "evidence", "tactics")
    found = own["matches"].where("ord is not null").groupBy(F.col("ord").alias("_o")).agg(F.array_sort(F.collect_list(said)).alias("matches"))
    out["commands"] = out["commands"].join(found, F.col("ord") == F.col("_o"), "left").drop("_o").orderBy(*place("commands"))
    out["matches"] = own["matches"].where("ord is null").select(said.alias("m")).select("m.*").orderBy("technique", "rule")
    v = verdicts.where("provider = 'virustotal'").select(F.col("sha256").alias("_h"), F.col("found").alias("known"), "malicious", "engines", "label")
    for n in ("downloads", "uploads"):
        out[n] = out[n].join(v, F.lower("sha256") == F.col("_h"), "left").drop("_h").orderBy(*place(n))
    return out


def newest_sessions(tables: dict[str, DataFrame], geo: DataFrame, intel: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` newest sessions, internal ones too, with numbers of logins and commands, country and reputation (L2).

    They are found first; logins and commands are then read by their ids and counted before the join, so nothing multiplies.
    """
    newest = F.broadcast(tables["sessions"].orderBy(F.desc_nulls_last("start_time"), "id").limit(limit).select("id", "src_ip", "start_time"))  # at most limit rows
    n = lambda t: tables[t].join(newest.select("id"), F.col("session_id") == F.col("id"), "left_semi").groupBy(F.col("session_id").alias(f"_{t}")).agg(F.count(F.lit(1)).alias(t))
    out = newest
    for t in ("logins", "commands"):
        out = out.join(n(t), F.col("id") == F.col(f"_{t}"), "left")
    ips = newest.select(F.col("src_ip").alias("_ip")).distinct()
    place = geo.join(ips, F.col("ip") == F.col("_ip"), "left_semi").groupBy(F.col("ip").alias("_g")).agg(F.first("country_code", True).alias("country"))
    known = intel.join(ips, F.col("ip") == F.col("_ip"), "left_semi").groupBy(F.col("ip").alias("_i")).agg(F.max(F.when(F.col("provider") == "abuseipdb", F.col("score"))).alias("abuse"), F.bool_or(F.when(F.col("provider") == "tor", F.col("flagged"))).alias("tor"))
    out = out.join(place, F.col("src_ip") == F.col("_g"), "left").join(known, F.col("src_ip") == F.col("_i"), "left")
    zero = [F.coalesce(t, F.lit(0)).alias(t) for t in ("logins", "commands")]
    return out.select("id", "src_ip", "start_time", *zero, "country", "abuse", "tor").orderBy(F.desc_nulls_last("start_time"), "id")


def metrics(tables: dict[str, DataFrame], campaigns: DataFrame) -> DataFrame:
    """(name, value) lines of a snapshot."""
    t = totals(tables).crossJoin(F.broadcast(campaigns.agg(F.count(F.lit(1)).alias("campaigns"))))
    t = t.withColumn("last_session", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', last_event)"))
    names = {"sessions": "sessions", "source_ips": "sources", "accepted_logins": "accepted_logins", "commands": "commands", "files": "files", "campaigns": "campaigns", "last_session_epoch": "last_session"}
    return t.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for n, c in names.items()])).alias("m")).select("m.*")


def longest_runs(logins: DataFrame, k: int = 10) -> DataFrame:
    """The k busiest accounts with tries and successes."""
    return logins.groupBy("username").agg(F.count(F.lit(1)).alias("tries"), F.count_if("success").alias("accepted")).orderBy(F.desc("tries"), "username").limit(k)


def session_order(sessions: DataFrame) -> DataFrame:
    """(id, label): labels that compare as sessions do in time, without a global window."""
    return sessions.select("id", F.struct(F.isnull("start_time").alias("late"), "start_time", "id").alias("label"))


def newest_per_source(sessions: DataFrame, k: int = 3) -> DataFrame:
    w = W.Window.partitionBy("src_ip").orderBy(F.desc_nulls_last("start_time"), "id")
    return real(sessions).where("src_ip is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src_ip", "rank", "id", "start_time")
