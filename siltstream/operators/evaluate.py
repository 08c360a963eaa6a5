"""Multi-label scores of the mapper against labelled commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.operators.detect import map_distinct_commands


def scored_cases(cases: DataFrame, rules=None) -> DataFrame:
    """cases (command, expect) with got, tp, fp and fn as arrays."""
    found = map_distinct_commands(cases, rules).select(F.col("command").alias("_c"), F.array_distinct(F.transform("matches", lambda m: m.technique)).alias("got"))
    d = cases.join(found, F.col("command") == F.col("_c"), "left").drop("_c").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    return d.withColumns({"tp": F.array_intersect("got", "expect"), "fp": F.array_except("got", "expect"), "fn": F.array_except("expect", "got")})


def evaluate(scored: DataFrame) -> DataFrame:
    """precision, recall, f1 and exact share over all cases."""
    t = scored.agg(F.sum(F.size("tp")).alias("tp"), F.sum(F.size("fp")).alias("fp"), F.sum(F.size("fn")).alias("fn"), F.avg(((F.size("fp") + F.size("fn")) == 0).cast("int")).alias("exact"), F.count(F.lit(1)).alias("cases"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select("cases", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "exact")


def per_technique(scored: DataFrame) -> DataFrame:
    """(technique, tp, fp, fn)."""
    named = lambda c: F.transform(c, lambda t: F.struct(t.alias("technique"), F.lit(c).alias("what")))
    rows = scored.select(F.explode(F.concat(named("tp"), named("fp"), named("fn"))).alias("x")).select("x.*")
    return rows.groupBy("technique").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("tp", "fp", "fn")])
