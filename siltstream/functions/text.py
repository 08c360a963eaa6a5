"""Scalar functions on text, times and log values (F1 to F17), as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of indicator ids, and what spreadsheets take for the start of a formula.
NAMESPACE = uuid.UUID("5d0a8d5c-7f4e-4f4a-9d73-1c9a6b0d2e11")
FORMULA = ["=", "+", "-", "@", "\t", "\r"]
HALF = 1024
MAX_DURATION = 10**12


def clean_text(v: Column, limit: int) -> Column:
    """Text of a VARIANT that is text, else null; NUL made visible, cut to ``limit`` characters (F1)."""
    return F.when(F.schema_of_variant(v) == "STRING", F.substring(F.translate(F.try_variant_get(v, "$", "string"), "\0", "\ufffd"), 1, limit))


def port(v: Column) -> Column:
    """0 to 65535 from a whole number or its text, else null (F2)."""
    kind = F.schema_of_variant(v)
    n = F.when(kind.isin("BIGINT", "STRING"), F.trim(F.try_variant_get(v, "$", "string")).try_cast("int"))
    return F.when(n.between(0, 65535), n)


def duration_ms(v: Column) -> Column:
    """Whole milliseconds from a number of 0 to 10^12, else null."""
    kind = F.schema_of_variant(v)
    n = F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))
    return F.when(~F.isnan(n) & n.between(0, MAX_DURATION), n.cast("long"))


def parse_ts(text: Column) -> Column:
    """ISO-8601 as a time in UTC (session time zone UTC); without an offset it is UTC; else null."""
    return F.try_to_timestamp(text)


def normalise_command(command: Column) -> Column:
    """The shape of a command: addresses, hex, random names and numbers replaced, in this order."""
    # What is replaced, in which order.
    steps = [
        (r"(?U)\b(?:https?|ftp|tftp)://\S+", "<url>"),
        (r"(?U)\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
        (r"(?U)\b[0-9a-f]{8,}\b", "<hex>"),
        (r"(?U)\b(?=[a-z0-9]*[0-9])(?=[a-z0-9]*[a-z])[a-z0-9]{10,}\b", "<rand>"),
        (r"(?U)\d+", "<n>"),
        (r"(?U)\s+", " "),
    ]
    out = F.lower(F.regexp_replace(command, r"(?U)^\s+|\s+$", ""))
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return out


def bound_command(command: Column) -> Column:
    """Head and tail of a command that is longer than both."""
    return F.when(F.length(command) > 2 * HALF, F.concat(F.substring(command, 1, HALF), F.lit(" "), F.right(command, F.lit(HALF)))).otherwise(command)


def printable(text: Column, limit: int | None = None) -> Column:
    r"""Control, format and other invisible characters as \xNN or \uNNNN, cut with …."""
    text = F.coalesce(text, F.lit(""))
    point = F.ascii  # the code point, whatever it is
    code = lambda c: F.lower(F.hex(point(c)))
    shown = lambda c: F.when(point(c) < 256, F.concat(F.lit("\\x"), F.lpad(code(c), 2, "0"))).otherwise(F.concat(F.lit("\\u"), F.when(F.length(code(c)) < 4, F.lpad(code(c), 4, "0")).otherwise(code(c))))
    hidden = r"[\p{C}\x{2028}\x{2029}]"
    out = F.when(text.rlike(hidden), F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(hidden), shown(c)).otherwise(c)), "")).otherwise(text)
    return out if limit is None else F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit - 1), F.lit("…"))).otherwise(out)


def csv_cell(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; null is empty."""
    shown = printable(text, 300)
    return F.when(F.substring(shown, 1, 1).isin(FORMULA), F.concat(F.lit("'"), shown)).otherwise(shown)


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def stable_id(text: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(text, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stix_pattern(kind: Column, value: Column) -> Column:
    """The pattern of an indicator: quotes and backslashes are escaped."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    path = F.when(kind.isin("ipv4", "ipv6"), F.concat(kind, F.lit("-addr:value"))).when(kind == "sha256", F.lit("file:hashes.'SHA-256'")).otherwise(F.lit("url:value"))
    return F.concat(F.lit("["), path, F.lit(" = "), quoted, F.lit("]"))


def technique_url(technique: Column) -> Column:
    return F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(technique, F.lit("."), F.lit("/")), F.lit("/"))


def map_project(lon: Column, lat: Column) -> Column:
    """Place on an equirectangular map of 960 by 480."""
    return F.struct(F.bround((lon + 180) / 360 * 960, 1).alias("x"), F.bround((90 - lat) / 180 * 480, 1).alias("y"))


def age_text(ts: Column, now: Column) -> Column:
    """How long ago: never, just now, or whole days (d), hours (h), minutes (m) or seconds (s) (F16)."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    whole = lambda size, unit: F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(ts.isNull(), "never").when(s < 0, "just now").when(s >= 86400, whole(86400, "d")).when(s >= 3600, whole(3600, "h")).when(s >= 60, whole(60, "m")).otherwise(whole(1, "s"))


def split_tactics(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda x: x != "")
