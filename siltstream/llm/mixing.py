"""Mixing sources to target weights by entropy balancing (operator 9); built-in functions only.

Documents fall into cells, one for each source and language. Of all rates between 0 and ``MOST`` that meet each
source's token target, those of least relative entropy (weighted by tokens) to a rate of 1 are wanted,
where languages that leave their share of all tokens cost quadratically. The dual of this is
convex, with a multiplier for each source and each language; the rate of a cell is MOST / (1 + exp(-sum
of its two)), an exponential tilt. Newton steps on the dual find the multipliers from aggregates over
the cells. Rates are then rounded into copies: everyone gets the whole part, and along a fixed hashed
order documents get one more while their cell's, then their source's quota isn't used up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.llm.rows import repeated, with_row
from siltstream.llm.words import spaced_words
from siltstream.plans.shared import BROADCAST_BYTES, BROADCAST_ROWS, stage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents that one block of the rounding's running sums holds on average.
BLOCK_ROWS = 20_000
#: Steps of the iteration, how many of them are one plan, and how near to its target a source has to come.
STEPS, SWEEPS, EXACT = 60, 3, 1e-9
#: Weight of a language's deviation: a multiplier of 1 is worth so large a part of its tokens.
SOFT = 0.25


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row for each source, of which there are few.

    Shares of all tokens go by weight; what exceeds ``most`` times a source's size is shared by the
    others. In the order of cap to weight, a source is capped exactly if its cap is at most its
    weight's share of what the capped ones before it leave.
    """
    everything = W.Window.orderBy(F.lit(1)).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    rank = F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size"))
    before = W.Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), none)
    s = s.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), none)))
    s = s.withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


class Room:
    """Whether tables of a row for each cell, or for some number of parts of each, may be broadcast: by the measured size of the cells."""

    def __init__(self, cells: DataFrame):
        self.rows, self.bytes = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 200), F.lit(0))).first()

    def hint(self, d: DataFrame, parts: int = 1) -> DataFrame:
        return F.broadcast(d) if self.rows * parts <= BROADCAST_ROWS and self.bytes * parts <= BROADCAST_BYTES else d


def entropy_rates(cells: DataFrame, hard: DataFrame, soft: DataFrame | None = None, most: float = MOST, softness: float = SOFT, steps: int = STEPS, exact: float = EXACT) -> DataFrame:
    """``cells`` (source, lang, tokens; a row each) with ``rate``.

    hard: (source, target), met exactly; a source with target 0 has rate 0, one with ``most`` times its tokens
    or more the rate ``most``. soft: (lang, target), come near to. A step takes one Newton step on
    the languages' multipliers, then one on the sources' (each Hessian is diagonal; steps are held to
    two units). ``SWEEPS`` steps are one plan over the cells, which is then written. Ends when a step finds
    sources at their targets to ``exact`` and languages' multipliers at rest. Where that doesn't
    happen in ``steps``, the residual is raised as an error.
    """
    own = lambda c: W.Window.partitionBy(c)
    room = Room(cells)
    c = cells.join(room.hint(hard.select(F.col("source").alias("_s"), F.col("target").cast("double").alias("_aim"))), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    size = F.sum("tokens").over(own("source"))
    c = c.withColumn("_fixed", F.when(F.coalesce("_aim", F.lit(0.0)) <= 0, F.lit(0.0)).when(F.col("_aim") >= most * size * (1 - 1e-12), F.lit(float(most))))
    if soft is None:
        c = c.withColumn("_soft", F.lit(None).cast("double"))
    else:
        c = c.join(room.hint(soft.select(F.col("lang").alias("_l"), F.col("target").cast("double").alias("_soft"))), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    start = F.col("_aim") / size
    c = c.withColumn("_a", F.when(F.col("_fixed").isNull(), F.log(start / (most - start)))).withColumn("_b", F.lit(0.0))
    c = c.withColumn("_free", F.col("_fixed").isNull() & (F.col("tokens") > 0))
    rate = F.coalesce("_fixed", most / (1 + F.exp(-(F.col("_a") + F.col("_b")))))
    curve = F.when(F.col("_free"), F.col("tokens") * rate * (1 - rate / most)).otherwise(0.0)
    held = lambda x: F.greatest(F.lit(-2.0), F.least(F.lit(2.0), x))
    worst = moved = 0.0
    for at in range(steps):
        total = F.sum("tokens").over(own("lang"))
        gradient = F.sum(F.col("tokens") * rate).over(own("lang")) - F.col("_soft") + softness * total * F.col("_b")
        move = held(-gradient / (F.sum(curve).over(own("lang")) + softness * total))
        c = c.withColumn("_move", F.when(total > 0, F.coalesce(move, F.lit(0.0))).otherwise(0.0)).withColumn("_b", F.col("_b") + F.col("_move"))
        off = F.sum(F.col("tokens") * rate).over(own("source")) - F.col("_aim")
        c = c.withColumn("_off", F.when(F.col("_fixed").isNull(), F.abs(off) / F.col("_aim")))
        c = c.withColumn("_a", F.when(F.col("_fixed").isNull(), F.col("_a") + held(-off / F.greatest(F.sum(curve).over(own("source")), F.lit(1e-300)))))
        if (at + 1) % SWEEPS and at + 1 < steps:
            continue
        c = stage(c, "cells")
        worst, moved = c.agg(F.coalesce(F.max("_off"), F.lit(0.0)), F.coalesce(F.max(F.abs("_move")), F.lit(0.0))).first()
        # measured before the sources' last step, after which a deviation is about its square
        if worst <= exact**0.5 and moved <= 3e-5:
            return c.withColumn("rate", rate).select(*cells.columns, "rate")
    raise ArithmeticError(f"no rates after {steps} steps: a source is off by {worst:.3g} of its target, a language's multiplier still moves by {moved:.3g}")


def _fill(g: DataFrame, quota: DataFrame, by: list[str], room: Room, blocks: int) -> DataFrame:
    """``g`` with ``extra`` raised along the hashed order as far as the quota (of each ``by``, less what is used) allows.

    Running sums over blocks of the order, then within a block, so that no source is one task.
    """
    same = lambda left, right: reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])
    names = [f"_q{i}" for i in range(len(by))]
    used = g.groupBy(*by).agg(F.sum(F.col("extra") * F.col("size")).alias("used")).select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], "used")
    asked = quota.select(*[F.col(b).alias(f"_w{i}") for i, b in enumerate(by)], "quota")
    gap = used.join(asked, same(names, [f"_w{i}" for i in range(len(by))])).select(*names, F.greatest(F.col("quota") - F.col("used"), F.lit(0.0)).alias("_gap"))
    g = g.join(room.hint(gap), same(by, names), "left").drop(*names)
    open_ = F.when((F.col("size") > 0) & (F.col("size") <= F.col("_gap")), F.col("m") - F.col("extra")).otherwise(F.lit(0))
    g = g.withColumn("_open", open_)
    blocksums = g.groupBy(*by, "_block").agg(F.sum(F.col("_open") * F.col("size")).alias("_sum"))
    up = W.Window.partitionBy(*by).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = blocksums.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_before"))
    g = g.join(room.hint(offsets, blocks), same(by, names) & (F.col("_block") == F.col("_b"))).drop(*names, "_b")
    inside = W.Window.partitionBy(*by, "_block").orderBy("_h", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(F.col("_open") * F.col("size")).over(inside), F.lit(0))
    fit = F.floor((F.col("_gap") - start + 1e-6 * F.col("size")) / F.greatest("size", F.lit(1)))
    return stage(g.withColumn("extra", F.col("extra") + F.greatest(F.lit(0).cast("long"), F.least(F.col("_open"), fit))).drop("_gap", "_open", "_before"), "rounded")


def _round(groups: DataFrame, cells: DataFrame, sources: DataFrame, room: Room) -> DataFrame:
    """``groups`` (…, source, lang, size, m, base) with ``extra``: how many of its m rows get one more copy.

    First the order's longest run that each cell's quota allows, then what each source's leaves open,
    and last comes the document that ends nearest to the source's quota, if any does. Nobody gets
    more than ``MOST`` copies.
    """
    blocks = max(16, groups.count() // BLOCK_ROWS)
    g = groups.withColumn("_h", F.xxhash64("doc_id", "size", "source", "lang")).withColumn("_block", F.pmod("_h", F.lit(blocks)))
    full = F.col("base") >= MOST  # such cells have no quota
    g = g.withColumn("extra", F.lit(0).cast("long")).withColumn("_all", F.col("m")).withColumn("m", F.when(full, F.lit(0).cast("long")).otherwise(F.col("m")))
    g = _fill(g, cells, ["source", "lang"], room, blocks)
    for _ in range(2):
        g = _fill(g, sources, ["source"], room, blocks)
    # one more, where that ends nearer to the quota than stopping short of it
    used = g.groupBy("source").agg(F.sum(F.col("extra") * F.col("size")).alias("used"))
    asked = sources.select(F.col("source").alias("_source"), "quota")
    gap = used.join(asked, F.col("source").eqNullSafe(F.col("_source"))).select("_source", (F.col("quota") - F.col("used")).alias("_gap"))
    left = g.where("extra < m and size > 0").join(room.hint(gap), F.col("source").eqNullSafe(F.col("_source"))).where(F.col("size") < 2 * F.col("_gap"))
    nearest = left.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("_gap") - F.col("size")), "_h", "doc_id", "size", "lang")).alias("_x"))
    nearest = nearest.select("_source", F.col("_x.doc_id").alias("_d"), F.col("_x.size").alias("_n"), F.col("_x.lang").alias("_l"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_n")) & (F.col("lang") == F.col("_l"))
    g = g.join(room.hint(nearest), same, "left")
    return g.withColumn("extra", F.col("extra") + F.col("_n").isNotNull().cast("long")).withColumn("m", F.col("_all")).drop("_h", "_block", "_source", "_d", "_n", "_l", "_all")


def mix_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, source, lang, size, m, source_size, target, base, extra): groups of m rows alike in the first four.

    Each row of a group gets ``base`` copies, and ``extra`` of them one more.
    """
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    d = docs.select(docs[key].alias("doc_id"), docs["source"].alias("source"), lang.alias("lang"), F.size(spaced_words(docs["text"])).cast("long").alias("size"))
    groups = stage(d.groupBy("doc_id", "source", "lang", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    cells = stage(groups.groupBy("source", "lang").agg(F.sum(F.col("size") * F.col("m")).alias("tokens")), "tokens")
    aims = stage(targets(cells.groupBy("source").agg(F.sum("tokens").alias("source_size"))), "targets")
    # each language keeps its share of all tokens
    share = aims.agg((F.sum("target") / F.sum("source_size")).alias("_share"))
    langs = cells.groupBy("lang").agg(F.sum("tokens").alias("_t")).join(F.broadcast(share)).select("lang", (F.col("_t") * F.col("_share")).alias("target"))
    rates = entropy_rates(cells, aims.select("source", "target"), langs)
    rate = F.coalesce(F.least(F.round("rate", 9), F.lit(MOST)), F.lit(0.0))
    plan = rates.select(F.col("source").alias("_s"), "lang", "tokens", F.floor(rate).alias("base"), rate.alias("rate")).join(aims, F.col("_s").eqNullSafe(aims.source)).drop("_s")
    plan = stage(plan, "rates")
    quota = plan.select("source", "lang", ((F.col("rate") - F.col("base")) * F.col("tokens")).alias("quota"))
    whole = plan.groupBy("source").agg((F.coalesce(F.first("target"), F.lit(0.0)) - F.sum(F.col("base") * F.col("tokens"))).alias("quota"))
    wide = plan.select(F.col("source").alias("_p"), F.col("lang").alias("_l"), "source_size", "target", "base")
    room = Room(cells)
    return _round(groups.join(room.hint(wide), F.col("source").eqNullSafe(F.col("_p")) & (F.col("lang") == F.col("_l"))).drop("_p", "_l"), quota, whole, room)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.

    A null text has size 0 and is taken 0 words of; sources compare by code point, null is one
    and the last; a null language is ''. Rows alike in doc_id, source, language and size are
    interchangeable: as many rows as should get the further copy. Nothing but these columns decides, so
    reruns agree. With no words at all every target is 0.
    """
    g = mix_counts(docs)
    copies = F.explode(F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("extra").alias("k")), F.struct(F.col("base").alias("copies"), (F.col("m") - F.col("extra")).alias("k")))).alias("x")
    g = g.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies).where("x.k > 0")
    g = g.select("doc_id", "size", "source_size", "target", (F.col("x.copies") * F.col("size")).alias("taken"), F.col("x.k").alias("k"))
    return repeated(g, "k", "_i").select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; texts without words as often as their cell's whole rate.

    Every row has a number of its own here, so rows of one doc_id, or none, are no group.
    """
    rows = with_row(docs, "text", "source", *[c for c in docs.columns if c == "lang"])
    g = mix_counts(rows, "uid").select(F.col("doc_id").alias("_d"), (F.col("base") + F.col("extra")).alias("_copies")).where("_copies > 0")
    return repeated(rows.join(g, rows["uid"] == F.col("_d")).select("_row", "_copies"), "_copies", "_i").select("_row.*")
