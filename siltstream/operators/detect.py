"""Technique matches of commands and sessions, fetch attempts, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.functions.shell import command_fetches
from siltstream.functions.text import bound_command
from siltstream.operators import rules as R
from siltstream.operators.literals import read_commands
from siltstream.plans.shared import stage

# Accounts that systems come with.
DEFAULT_USERS = [
    "root", "admin", "administrator", "user", "pi", "ubuntu", "test", "guest", "oracle",
    "postgres", "ftpuser", "support", "ec2-user", "debian", "vagrant", "git",
]
GUESSES, MANY_GUESSES, EVIDENCE = 3, 10, 300
MATCH = ["session_id", "ord", "rule", "technique", "confidence", "evidence"]


def _pattern(text: str) -> str:
    return "(?Ud)" + text


def _quoted(text: str) -> str:
    """As a string in SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _read_distinct(commands: DataFrame, rules) -> DataFrame:
    """(command, bounded, segments, tried) of each distinct command."""
    d = commands.select("command").where("command is not null").distinct().withColumn("bounded", bound_command(F.col("command")))
    return d.withColumn("read", read_commands(F.col("bounded"), rules)).select("command", "bounded", "read.*")


def map_distinct_commands(commands: DataFrame, rules=None) -> DataFrame:
    """(command, matches): each distinct command with the rules that it matches, each rule once, its first matching segment as evidence.

    Only those patterns run of which the command holds a literal that they need.
    """
    rules = R.RULES if rules is None else rules

    # SQL text: a tree of this many columns takes longer to build from Python than the matching itself
    def hit(number: int, rule: tuple[str, str, str, str, str]) -> str:
        name, technique, confidence, scope, pattern = rule
        of = "array(bounded)" if scope == "command" else "segments"
        matches = f"x -> x rlike {_quoted(_pattern(pattern))}"
        found = f"named_struct('rule', {_quoted(name)}, 'technique', {_quoted(technique)}, 'confidence', {_quoted(confidence)}, 'evidence', substring(filter({of}, {matches})[0], 1, {EVIDENCE}))"
        return f"CASE WHEN array_contains(tried, {number}) AND exists({of}, {matches}) THEN {found} END"

    every = f"cast(array({', '.join(hit(i, r) for i, r in enumerate(rules))}) as array<struct<rule: string, technique: string, confidence: string, evidence: string>>)"
    return _read_distinct(commands, rules).select("command", F.expr(f"array_compact({every})").alias("matches"))


def patterns_tried(commands: DataFrame, rules=None) -> DataFrame:
    """(tried, commands): how many distinct commands met how many patterns."""
    rules = R.RULES if rules is None else rules
    return _read_distinct(commands, rules).groupBy(F.size("tried").alias("tried")).agg(F.count(F.lit(1)).alias("commands"))


def map_commands(commands: DataFrame, rules=None) -> DataFrame:
    """A row for each command and rule that it matches."""
    found = map_distinct_commands(commands, rules)
    return commands.select("session_id", "ord", "command").join(found, "command").select("session_id", "ord", F.explode("matches").alias("m")).select("session_id", "ord", "m.*")


def _match(session: str, rule: Column | str, technique: Column | str, confidence: Column | str, evidence: Column) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.col(session).alias("session_id"), F.lit(None).cast("long").alias("ord"), lit(rule).alias("rule"), lit(technique).alias("technique"), lit(confidence).alias("confidence"), F.substring(evidence, 1, EVIDENCE).alias("evidence")]


def map_logins(logins: DataFrame) -> DataFrame:
    """Guessing from three failures on, and the first accepted login, by whether its account is a default one."""
    s = logins.groupBy("session_id").agg(F.count_if(~F.col("success")).alias("failed"), F.count_if("success").alias("accepted"), F.min_by("username", F.when(F.col("success"), F.col("ord"))).alias("user"))
    guessing = s.where(F.col("failed") >= GUESSES).select(*_match("session_id", "login-guessing", "T1110.001", F.when(F.col("failed") >= MANY_GUESSES, "high").otherwise("medium"), F.concat(F.col("failed").cast("string"), F.lit(" failed attempts"))))
    default = F.lower(F.coalesce("user", F.lit(""))).isin(DEFAULT_USERS)
    # the name as JSON text: the same groups as any other quoting
    shown = F.substring(F.to_json(F.array(F.coalesce("user", F.lit("")))), 2, 1000)
    accepted = s.where("accepted > 0").select(*_match("session_id", F.when(default, "login-default-account").otherwise("login-valid-account"), F.when(default, "T1078.001").otherwise("T1078"), "medium", F.concat(F.lit("login accepted for "), F.regexp_replace(shown, r"\]$", ""))))
    return guessing.unionByName(accepted)


def map_transfers(downloads: DataFrame, uploads: DataFrame) -> DataFrame:
    """One match for each file moved in."""
    said = lambda verb, x: F.concat(F.lit(verb + " "), F.when(F.coalesce(x, F.lit("")) == "", "?").otherwise(x))
    d = downloads.select(*_match("session_id", "transfer-download", "T1105", "high", said("downloaded", F.col("url"))))
    return d.unionByName(uploads.select(*_match("session_id", "transfer-upload", "T1105", "high", said("uploaded", F.col("filename")))))


def map_tunnels(tunnels: DataFrame) -> DataFrame:
    """One match for a session's forwarding requests, with their number and the three smallest targets."""
    s = tunnels.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")))).alias("to"))
    said = F.concat(F.col("n").cast("string"), F.lit(" forwarding request(s) to "), F.size("to").cast("string"), F.lit(" destination(s), e.g. "), F.concat_ws(", ", F.slice("to", 1, 3)))
    return s.select(*_match("session_id", "tunnel-request", "T1090", "high", said))


def map_sessions(tables: dict[str, DataFrame], techniques: DataFrame, rules=None) -> DataFrame:
    """All matches with their tactics (D2); ``ord`` is null for session-level ones."""
    parts = [map_commands(tables["commands"], rules), map_logins(tables["logins"]), map_transfers(tables["downloads"], tables["uploads"]), map_tunnels(tables["tunnels"])]
    both = reduce(DataFrame.unionByName, parts)
    return both.join(F.broadcast(techniques.select("technique", "tactics")), "technique", "left").select(*MATCH, F.coalesce("tactics", F.lit("")).alias("tactics"))


def session_fetches(commands: DataFrame) -> DataFrame:
    """(session_id, url, tool, ts): addresses that commands were written to fetch, from the earliest command of each (D3)."""
    tools = r"(?i)\b(wget|curl|tftp|ftpget|fetch|lwp-download|aria2c|axel|git)\b"
    own = commands.where(F.col("command").rlike(tools))
    found = own.select("command").distinct().select("command", F.explode(command_fetches(F.col("command"))).alias("f"))
    each = own.join(found, "command").select("session_id", "f.url", "f.tool", "ts", "ord")
    return each.groupBy("session_id", "url").agg(F.min_by(F.struct("tool", "ts"), F.struct(F.isnull("ts"), "ts", "ord")).alias("x")).select("session_id", "url", "x.tool", "x.ts")


# Alert ids and severities of events.
BASE_ALERTS = [
    (100501, 3, "cowrie.session.connect"), (100510, 5, "cowrie.login.failed"), (100513, 8, "cowrie.login.success"),
    (100520, 5, "cowrie.command.input"), (100530, 10, "cowrie.session.file_download"), (100531, 10, "cowrie.session.file_upload"),
    (100540, 9, "cowrie.direct-tcpip.request"),
]
ANY_ALERT, DEFAULT_ACCOUNT = (100500, 0), (100514, 10)
LEVELS, DISCOVERY_LEVEL, FIRST_COMMAND_RULE = {"low": 4, "medium": 7, "high": 10}, 6, 100600


def classify_alerts(events: DataFrame, techniques: DataFrame, rules=None) -> DataFrame:
    """(ord, session, src_ip, ts, alert, level): of every event the most severe rule that it matches, of equals the first."""
    rules = R.RULES if rules is None else rules
    # text with a zero-padded number: the largest level, then the smallest id
    tactics = {t: x for t, _, x in R.CATALOG}
    level = {r[0]: min(LEVELS[r[2]], DISCOVERY_LEVEL) if tactics.get(r[1]) == "discovery" else LEVELS[r[2]] for r in rules}
    best = F.struct(F.lit(ANY_ALERT[1]).alias("level"), F.lit(-ANY_ALERT[0]).alias("no"))
    options = [best]
    for no, lv, kind in BASE_ALERTS:
        options.append(F.when(F.col("eventid") == kind, F.struct(F.lit(lv).alias("level"), F.lit(-no).alias("no"))))
    default = (F.col("eventid") == "cowrie.login.success") & F.lower("username").isin(DEFAULT_USERS)
    options.append(F.when(default, F.struct(F.lit(DEFAULT_ACCOUNT[1]).alias("level"), F.lit(-DEFAULT_ACCOUNT[0]).alias("no"))))
    numbers = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r[0], i)])
    levels = F.create_map(*[F.lit(x) for r in rules for x in (r[0], level[r[0]])])
    found = map_distinct_commands(events.select(F.col("input").alias("command")), rules)
    of = F.array_max(F.transform("matches", lambda m: F.struct(levels[m.rule].alias("level"), (-(numbers[m.rule] + FIRST_COMMAND_RULE)).alias("no"))))
    found = found.select(F.col("command").alias("input"), of.alias("_best"))
    joined = events.where(F.col("eventid").startswith("cowrie.")).join(found, "input", "left")
    options.append(F.when(F.col("eventid") == "cowrie.command.input", F.col("_best")))
    top = F.array_max(F.array_compact(F.array(*options)))
    return joined.withColumn("_top", top).select("ord", "session", "src_ip", "ts", (-F.col("_top.no")).alias("alert"), F.col("_top.level").alias("level"))


# How many events of one source in how many seconds raise an alert.
FREQUENCIES = [("failed_3_in_120", "login.failed", 3, 120), ("failed_10_in_300", "login.failed", 10, 300), ("discovery_4_in_60", "discovery", 4, 60)]
#: Seconds of a source's events that one task counts through, or the span if that is longer.
DAY = 86_400


def frequency_alerts(events: DataFrame, discovery_commands: DataFrame, frequencies=FREQUENCIES) -> DataFrame:
    """(src_ip, ts, ord, alert, n): events that complete a burst of their source within a trailing span.

    discovery_commands (input): commands that count for the third rule. A second's count is the running
    count at its end less the one before its span begins. Running counts begin anew with each of a source's
    time buckets, which also hold the span before them, so that no source is one task. Events without an
    address or a time raise no alert.
    """
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    found = events.where("eventid = 'cowrie.command.input'").join(discovery_commands.select("input").distinct(), "input", "left_semi")
    kinds = [("login.failed", events.where("eventid = 'cowrie.login.failed'")), ("discovery", found)]
    both = reduce(DataFrame.unionByName, [d.select("src_ip", "ts", "ord", F.lit(what).alias("what")) for what, d in kinds])
    both = stage(both.where("src_ip is not null and ts is not null").withColumn("s", seconds), "bursts")  # read twice
    rules = F.array(*[F.struct(F.lit(name).alias("alert"), F.lit(what).alias("of"), F.lit(least).alias("least"), F.lit(int(span)).cast("long").alias("span")) for name, what, least, span in frequencies])
    each = both.groupBy("what", "src_ip", "s").agg(F.count(F.lit(1)).alias("c")).select("*", F.explode(F.filter(rules, lambda r: r.of == F.col("what"))).alias("r")).select("*", "r.*")
    width = F.greatest(F.lit(DAY), F.col("span"))
    bucket = lambda t: F.floor(t / width)
    mark = lambda b, t, own, c: F.struct(b.alias("bucket"), t.alias("t"), F.lit(own).alias("own"), c.alias("add"))
    s, here, after = F.col("s"), bucket(F.col("s")), bucket(F.col("s") + F.col("span"))
    marks = F.array(
        mark(here, s - F.col("span"), -1, F.lit(0).cast("long")), mark(here, s, 1, F.col("c")), F.when(after > here, mark(after, s, 0, F.col("c")))
    )
    # what begins a span comes before that second's events, which belong to the span
    upto = W.Window.partitionBy("what", "alert", "src_ip", "bucket").orderBy("t", F.col("own") >= 0).rowsBetween(W.Window.unboundedPreceding, 0)
    run = each.select("what", "alert", "least", "span", "src_ip", "s", F.explode(F.array_compact(marks)).alias("m")).select("*", "m.*").withColumn("run", F.sum("add").over(upto)).where("own <> 0")
    n = run.groupBy("what", "alert", "src_ip", "bucket", "s").agg(F.sum(F.col("run") * F.col("own")).alias("n"), F.first("least").alias("least")).where(F.col("n") >= F.col("least"))
    return both.join(n.select("what", "alert", "src_ip", "s", "n"), ["what", "src_ip", "s"]).select("src_ip", "ts", "ord", "alert", "n")
