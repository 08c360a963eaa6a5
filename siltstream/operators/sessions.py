"""Events to bounded session tables, and merging them with stored ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.functions.net import is_internal
from siltstream.plans.shared import stage

# How many rows of each kind a session keeps.
CAPS = {"logins": 500, "commands": 2000, "downloads": 200, "uploads": 200, "tunnels": 200}
#: Of each child table the columns that, with session and time, make a row.
KEYS = {
    "logins": ["username", "password", "success"],
    "commands": ["command"],
    "downloads": ["url", "sha256"],
    "uploads": ["filename", "sha256"],
    "tunnels": ["dst_ip", "dst_port", "orig_ip", "orig_port"],
}

#: The events that rows of each child table come from.
EVENTS = {
    "logins": ["cowrie.login.failed", "cowrie.login.success"], "commands": ["cowrie.command.input"], "downloads": ["cowrie.session.file_download"],
    "uploads": ["cowrie.session.file_upload"], "tunnels": ["cowrie.direct-tcpip.request"],
}

#: The columns of each child table beside session, place and time.
ROW = {
    "logins": ["username", "password", "success"], "commands": ["command"], "downloads": ["url", "sha256"],
    "uploads": ["filename", "destination", "sha256"], "tunnels": ["dst_ip", "dst_port", "orig_ip", "orig_port"],
}


def _kind(name: str) -> tuple[Column, list[Column]]:
    e = F.col("eventid")
    c = F.col
    return {
        "logins": (e.isin("cowrie.login.failed", "cowrie.login.success"), [c("username"), c("password"), (e == "cowrie.login.success").alias("success")]),
        "commands": (e == "cowrie.command.input", [c("input").alias("command")]),
        "downloads": ((e == "cowrie.session.file_download") & (c("url") != ""), [c("url"), c("shasum").alias("sha256")]),
        "uploads": (e == "cowrie.session.file_upload", [F.coalesce("filename", F.lit("")).alias("filename"), c("destfile").alias("destination"), c("shasum").alias("sha256")]),
        "tunnels": (e == "cowrie.direct-tcpip.request", [F.coalesce("dst_ip", F.lit("")).alias("dst_ip"), F.coalesce("dst_port", F.lit(0)).alias("dst_port"), F.coalesce("orig_ip", F.lit("")).alias("orig_ip"), F.coalesce("orig_port", F.lit(0)).alias("orig_port")]),
    }[name]


def event_rows(events: DataFrame) -> DataFrame:
    """Events with the ``kind`` of child row that they make, null for none, and the columns of all kinds of child rows (``ROW``)."""
    kinds = {n: _kind(n) for n in CAPS}
    own = F.coalesce(*[F.when(where, n) for n, (where, _) in kinds.items()])
    named = {n: dict(zip(ROW[n], columns, strict=True)) for n, (_, columns) in kinds.items()}
    values = {c: F.coalesce(*[F.when(own == n, x[c]) for n, x in named.items() if c in x]) for c in dict.fromkeys(c for x in named.values() for c in x)}
    return events.select("*", own.alias("kind"), *[v.alias(f"row_{c}") for c, v in values.items()])


def summarise_sessions(events: DataFrame) -> DataFrame:
    """One row per session: the first address and time that are there; the last version, key and end in order of arrival, null or not."""
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.col("ord")))
    last = lambda x, kind: F.max_by(x, F.when(F.col("eventid") == kind, F.col("ord")))
    s = events.where(F.col("session") != "").groupBy(F.col("session").alias("id")).agg(
        first("src_ip").alias("src_ip"), first("ts").alias("start_time"), last("ts", "cowrie.session.closed").alias("end_time"),
        last("duration_ms", "cowrie.session.closed").alias("duration_ms"), last("version", "cowrie.client.version").alias("client_version"),
        last("hassh", "cowrie.client.kex").alias("hassh"),
    )
    return s.withColumn("internal", is_internal(F.col("src_ip")))


def child_rows(events: DataFrame, name: str) -> DataFrame:
    """The child table ``name``: at most its cap of rows for a session, in order of arrival, each natural key once."""
    where, columns = _kind(name)
    by_arrival = W.Window.partitionBy("session").orderBy("ord")
    rows = events.where(where & (F.col("session") != "")).withColumn("_n", F.row_number().over(by_arrival)).where(F.col("_n") <= CAPS[name])
    rows = rows.select(F.col("session").alias("session_id"), "ord", "ts", *columns)
    if name == "commands":
        rows = rows.where("command is not null")
    keys = ["session_id", "ts", *KEYS[name]]
    first = W.Window.partitionBy(*keys).orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def store_events(events: DataFrame) -> dict[str, DataFrame]:
    """All tables of the log. Feeding the same events again changes nothing."""
    return {"sessions": summarise_sessions(events), **{n: child_rows(events, n) for n in CAPS}}


def stage_events(events: DataFrame, names: list[str] | None = None, capped: bool = True) -> dict[str, DataFrame]:
    """``store_events``, written: sessions and the child tables ``names`` (all, if not told).

    All child rows are dealt by session together, numbered and freed of repeats in one pass, and written in a folder for each kind.
    Not capped, sessions keep all their rows; these are then dealt by natural key, so that no task gathers a session.
    """
    names = list(CAPS if names is None else names)
    own = [f"row_{c}" for c in dict.fromkeys(c for n in names for c in ROW[n])]
    keys = [f"row_{c}" for c in dict.fromkeys(c for n in names for c in KEYS[n])]
    # by event, not by kind: a filter on the kind's formula makes, with that of the columns, a method too large for the JVM to compile
    wanted = events.where(F.col("eventid").isin([e for n in names for e in EVENTS[n]]) & (F.col("session") != ""))
    rows = event_rows(wanted).select("session", "kind", "ord", "ts", *own)
    first = W.Window.partitionBy("session", "kind", "ts", *keys).orderBy("ord")  # columns of other kinds are null
    if capped:
        by_arrival = W.Window.partitionBy("session", "kind").orderBy("ord")
        caps = F.create_map(*[F.lit(x) for n in names for x in (n, CAPS[n])])
        # those of no kind (downloads without an address) have no cap and go here; coalesce, or Spark would put a filter on the kind before
        rows = rows.repartition("session").withColumn("_n", F.row_number().over(by_arrival)).where(F.col("_n") <= F.coalesce(caps[F.col("kind")], F.lit(0)))
    if "commands" in names:
        rows = rows.where("kind <> 'commands' or row_command is not null")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = stage(rows, "children", by="kind")  # not capped, those of no kind are among them; no table below reads them
    out = {n: rows.where(F.col("kind") == n).select(F.col("session").alias("session_id"), "ord", "ts", *[F.col(f"row_{c}").alias(c) for c in ROW[n]]) for n in names}
    return {"sessions": stage(summarise_sessions(events), "sessions"), **out}


def merge_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored sessions with later pieces: earliest start, latest end, else the new value where there is one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("_new"))).alias(x)
    s = both.groupBy("id").agg(*[latest(x) for x in ("src_ip", "duration_ms", "client_version", "hassh")], F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    return s.select("id", "src_ip", "start_time", "end_time", "duration_ms", "client_version", "hassh", is_internal(F.col("src_ip")).alias("internal"))


def merge_children(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The union of both by natural key; null times compare equal."""
    return old.unionByName(new).dropDuplicates(["session_id", "ts", *KEYS[name]])


def merge_capped(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Stored rows with later ones: each natural key once, the stored row first; new ones follow in order of arrival while the session's cap has room."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = W.Window.partitionBy("session_id", "ts", *KEYS[name]).orderBy("_new", "ord")
    own = W.Window.partitionBy("session_id").orderBy("_new", "ord")
    once = both.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= CAPS[name]).drop("_n", "_new")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(session_id, n_logins, …): child rows of each session, to notice changes."""
    ones = [t.select("session_id", F.lit(n).alias("kind")) for n, t in tables.items() if n in CAPS]
    counted = reduce(DataFrame.unionByName, ones).groupBy("session_id")
    return counted.agg(*[F.count_if(F.col("kind") == n).alias(f"n_{n}") for n in CAPS])


def pending_slice(pending: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(the ``limit`` oldest pending sessions, whether there are more): what one run maps.

    One row more than the slice is asked for, so whether there are more costs no count; both come from one sorted read.
    """
    oldest = stage(pending.orderBy(F.col("start_time").asc_nulls_first(), "id").limit(limit + 1), "pending")
    more = oldest.count() > limit
    return oldest.orderBy(F.col("start_time").asc_nulls_first(), "id").limit(limit), more


def pending_sessions(sessions: DataFrame, counts: DataFrame, state: DataFrame, version: str, limit: int | None = None) -> DataFrame:
    """Sessions that are new or have changed since ``state`` (session_id, version, n_*), oldest first."""
    names = [f"n_{n}" for n in CAPS]
    now = sessions.join(counts, sessions.id == counts.session_id, "left").select("id", "start_time", *[F.coalesce(counts[n], F.lit(0)).alias(n) for n in names])
    kept = state.select(F.col("session_id").alias("_id"), F.col("version").alias("_version"), *[F.col(n).alias(f"_{n}") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], F.col("_version").eqNullSafe(F.lit(version)))
    out = now.join(kept, F.col("id") == F.col("_id"), "left").where(~same).select("id", "start_time", *names)
    return out if limit is None else out.orderBy(F.col("start_time").asc_nulls_first(), "id").limit(limit)
