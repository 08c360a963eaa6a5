"""URLs and hosts (N8 to N11), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstream.functions.net import IPV4, canonical_ip, is_public, normalise_ip

# Look-up services, popular sites, resolvers and package mirrors.
COMMON_HOSTS = [
    "ifconfig.me", "ifconfig.co", "ipinfo.io", "icanhazip.com", "ipecho.net", "ipify.org",
    "api.ipify.org", "checkip.amazonaws.com", "ident.me", "myip.com", "ip.sb", "ipapi.co",
    "ip-api.com", "wtfismyip.com", "whatismyip.com", "httpbin.org", "ipv4.icanhazip.com",
    "speedtest.net", "fast.com", "connectivitycheck.gstatic.com", "captive.apple.com",
    "google.com", "googleapis.com", "gstatic.com", "bing.com", "yahoo.com", "baidu.com",
    "qq.com", "microsoft.com", "windowsupdate.com", "apple.com", "amazon.com", "facebook.com",
    "twitter.com", "youtube.com", "wikipedia.org", "cloudflare.com", "one.one.one.one",
    "example.com", "example.org", "example.net", "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1",
    "9.9.9.9", "208.67.222.222", "208.67.220.220",
    "ubuntu.com", "debian.org", "kernel.org", "python.org", "pypi.org", "npmjs.org",
    "npmjs.com", "apache.org", "gnu.org", "centos.org", "fedoraproject.org", "alpinelinux.org",
    "rubygems.org", "crates.io", "golang.org", "docker.com", "docker.io",
]
# Places where anyone can publish a file.
SHARED_HOSTING = [
    "github.com", "githubusercontent.com", "gitlab.com", "bitbucket.org", "pastebin.com",
    "paste.ee", "hastebin.com", "transfer.sh", "file.io", "anonfiles.com", "dropbox.com",
    "dropboxusercontent.com", "discordapp.com", "discord.com", "mediafire.com", "mega.nz",
    "sourceforge.net", "archive.org", "ghostbin.com", "termbin.com", "0x0.st", "catbox.moe",
    "telegram.org", "t.me", "docs.google.com", "drive.google.com", "onedrive.live.com",
    "amazonaws.com", "storage.googleapis.com", "blob.core.windows.net", "workers.dev",
    "pages.dev", "netlify.app", "vercel.app", "herokuapp.com", "glitch.me", "repl.co",
    "ngrok.io", "ngrok-free.app", "trycloudflare.com",
]
# Names that resolve to whatever address they contain.
WILDCARD_DNS = ["nip.io", "sslip.io", "xip.io", "lvh.me", "localtest.me", "traefik.me"]
# Suffixes of names that no one else can reach.
LOCAL_SUFFIXES = [".localhost", ".local", ".internal", ".localdomain"]

_URL = r"^(?i)(https?|ftp|tftp)://(?:[^/?#@]*@)?(\[[0-9a-fA-F:.]+\]|[^/?#:@\[\]]+)(?::([0-9]*))?([^?#]*)"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, n)


def url_host(url: Column) -> Column:
    """The host in lower case, without brackets; '' if there is none."""
    return F.lower(F.translate(_part(url, 2), "[]", ""))


def _port_ok(url: Column) -> Column:
    p = _part(url, 3)
    return (p == "") | p.try_cast("int").between(0, 65535)


def suffixes(host: Column) -> Column:
    """All dot-suffixes of a host: of a.b.c those are a.b.c, b.c and c."""
    parts = F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _listed(host: Column, names: list[str]) -> Column:
    return F.coalesce(F.exists(suffixes(host), lambda s: s.isin(names)), F.lit(False))


def is_common_host(host: Column) -> Column:
    return _listed(host, COMMON_HOSTS)


def is_shared_hosting(host: Column) -> Column:
    return _listed(host, SHARED_HOSTING)


def usable_host(host: Column) -> Column:
    """A canonical address, or a DNS name of two labels or more with a real top-level domain that isn't wildcard DNS."""
    h = F.lower(F.regexp_replace(host, r"\.+$", ""))
    # Fixed value: the form of labels and of a top-level domain.
    labels = h.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+([a-z]{2,24}|xn--[a-z0-9-]{2,59})$")
    wild = F.exists(suffixes(h), lambda s: s.isin(WILDCARD_DNS))
    return F.coalesce((F.length(host) > 0) & (F.length(host) <= 253) & (canonical_ip(h).isNotNull() | labels & ~wild), F.lit(False))


def clean_url(url: Column) -> Column:
    """Scheme, host, port and path; null without a host, with a bad port or for a common host."""
    host = url_host(url)
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    whole = F.concat(F.lower(_part(url, 1)), F.lit("://"), shown, F.when(_part(url, 3) != "", F.concat(F.lit(":"), _part(url, 3).try_cast("int").cast("string"))).otherwise(""), _part(url, 4))
    return F.when((host != "") & _port_ok(url) & ~is_common_host(host), F.substring(whole, 1, 280))


def valid_url(url: Column) -> Column:
    """A plain absolute URL with a public host."""
    host = url_host(url)
    plain = (F.length(url) <= 2048) & url.rlike(r"^[\x21-\x7E]+$") & url.rlike(_URL) & ~url.rlike(r"^[^/]*//[^/?#]*@")
    local = (host == "localhost") | F.exists(F.array(*[F.lit(x) for x in LOCAL_SUFFIXES]), lambda x: F.endswith(host, x))
    address = normalise_ip(host)
    return F.coalesce(plain & (host != "") & _port_ok(url) & usable_host(host) & ~local & (address.isNull() | is_public(host)), F.lit(False))


__all__ = ["IPV4", "clean_url", "is_common_host", "is_shared_hosting", "suffixes", "url_host", "usable_host", "valid_url"]
