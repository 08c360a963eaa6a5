"""Quality rules with risk-controlled thresholds (operator 4); built-in functions only.

A base rule rejects short texts and texts that repeat themselves. Further rules compare a measure
of the text with a cutoff for its stratum (the language). Candidate cutoffs are upper quantiles of the
measure over documents without labels. A third of the labelled documents puts the candidates of a
stratum into an order: those that reject fewest good documents first. Along that path, on which rules
join one after the other, the other labelled documents (the holdout) are asked by an exact binomial
test whether all rules together reject at most ``risk`` of the good documents that pass the base
rule. A stratum's path ends before the first test that doesn't show it. A fixed sequence needs no
correction within itself; over the strata the level is divided by their number (Bonferroni). So
with probability 1 - ``level`` there is no stratum of which the rules reject more than ``risk``.
Good is what is labelled good and not toxic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.llm.words import SPACE, spaced_words
from siltstream.plans.shared import small, stage

#: The rules: measures of which large values are bad.
RULES = ["symbols_per_word", "dup_line_share", "repeat_share", "word_length", "word_shortness"]
#: Shares of a stratum's documents without labels that a candidate cutoff leaves above it.
SHARES = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1]
RISK, LEVEL = 0.01, 0.05
#: Of so many labelled documents one orders the candidates, the others test them.
SPLIT = 3
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*[docs[k].alias(k) for k in keep], docs["text"].alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    d = d.select(
        *keep,
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(spaced_words(text), lambda w: F.xxhash64(w)).alias("words"),
    )
    d = d.select(
        *keep, "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # a window's hash; get() is null beyond the end, where slice() has already stopped
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
            lambda h, i: F.xxhash64(h, *[F.get("words", i + k) for k in range(1, WINDOW)]),
        ).alias("grams"),
    )
    # places are sorted by hash only where an array of distinct hashes is shorter
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    place = F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("places", F.when(repeats, place)).drop("grams")
    again = F.filter("places", lambda p, k: (p.h == F.get("places", k - 1).h) | (p.h == F.get("places", k + 1).h))
    d = d.withColumn("again", F.sort_array(F.transform(again, lambda p: p.i))).drop("places")
    steps = F.transform("again", lambda i, k: F.least(F.coalesce(F.get("again", k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).drop("again")


def scored() -> dict[str, Column]:
    """The measures that have cutoffs, to three significant digits (downwards), from the columns of :func:`measures`."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    exact = {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "word_shortness": -F.col("word_chars") / words,
    }
    unit = lambda x: F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 2)
    return {r: F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x / unit(x)) * unit(x)) for r, x in exact.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed in logarithms. 1 where k >= n p, as then it is no small one."""
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    first = (n * math.log1p(-p)).cast("double")
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s.term + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        return F.struct(term.alias("term"), add(s.total, term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda s: F.exp(s.total))
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def _by_rule(measured: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, stratum, rule, score): a row for each document and rule."""
    x = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("score")) for r, c in scored().items()])).alias("x")
    return measured.select(*keep, "stratum", x).select(*keep, "stratum", "x.rule", "x.score")


def candidates(unlabelled: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff): the least scores that leave no more than each of ``SHARES`` above them."""
    n = _by_rule(unlabelled).groupBy("stratum", "rule", "score").count()
    upwards = W.Window.partitionBy("stratum", "rule").orderBy("score")
    n = n.withColumn("below", F.sum("count").over(upwards)).withColumn("all", F.sum("count").over(W.Window.partitionBy("stratum", "rule")))
    fits = F.explode(F.filter(F.array(*[F.lit(x) for x in SHARES]), lambda q: F.col("all") - F.col("below") <= q * F.col("all"))).alias("share")
    return n.select("stratum", "rule", "score", fits).groupBy("stratum", "rule", "share").agg(F.min("score").alias("cutoff")).select("stratum", "rule", "cutoff").distinct()


def _verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, good, orders): each labelled document once, and whether it helps to order candidates or to test them."""
    toxic = F.coalesce(labels["toxic"], F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    known = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull())
    known = known.groupBy(labels["doc_id"].alias("doc_id")).agg(F.min((labels["quality"] == 1).cast("int")).alias("q"), F.max(toxic).alias("t"))
    half = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(SPLIT)) == 0
    return known.select(F.col("doc_id").alias("_id"), F.when(F.col("q") == 0, False).when(F.col("t") == 0, True).alias("good"), half.alias("orders"))


def certificates(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, step, rule, cutoff, n, k, p, certified): every step of each stratum's path.

    Step s adds its rule's cutoff to those before it. n: good documents of the holdout; k: those that
    the cutoffs up to the step reject; p: the chance of so few if ``risk`` were exceeded. A
    stratum without labelled documents has no path; one with too few good ones
    (under log(level / strata) / log(1 - risk)) has no certified step.
    """
    passing = measured.where(~base_failed())
    joined = stage(passing.join(_verdicts(labels), F.col("doc_id") == F.col("_id"), "left").drop("_id", "doc_id"), "labelled")
    known = joined.where("orders is not null and good is not null")
    asked = small(stage(candidates(joined.where("orders is null")), "candidates"))
    over = lambda d, *keep: _by_rule(d, *keep).join(asked, ["stratum", "rule"]).where("score > cutoff")
    count = lambda good: F.sum((F.col("good") == F.lit(good)).cast("long"))
    hit = over(known.where("orders"), "good").groupBy("stratum", "rule", "cutoff").agg(count(True).alias("lost"), count(False).alias("found"))
    ranked = asked.join(hit, ["stratum", "rule", "cutoff"], "left").select("stratum", "rule", "cutoff", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("found", F.lit(0)).alias("found"))
    path = W.Window.partitionBy("stratum").orderBy("lost", F.desc("found"), "rule", F.desc("cutoff"))
    ranked = stage(ranked.withColumn("step", F.row_number().over(path)).select("stratum", "step", "rule", "cutoff"), "path")
    # the holdout's good documents by the first step that rejects them
    test = known.where("good and not orders")
    limits = ranked.groupBy("stratum").agg(F.collect_list(F.struct("step", "rule", "cutoff")).alias("steps"))
    values = F.create_map(*[x for r, c in scored().items() for x in (F.lit(r), c)])
    rejecting = F.array_min(F.transform(F.filter("steps", lambda s: F.element_at(F.col("values"), s.rule) > s.cutoff), lambda s: s.step))
    first = test.select("stratum", values.alias("values")).join(small(limits), "stratum", "left").select("stratum", rejecting.alias("step"))
    n = first.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    k = first.where("step is not null").groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("hits"))
    steps = ranked.join(n, "stratum").join(k, ["stratum", "step"], "left")
    up = W.Window.partitionBy("stratum").orderBy("step")
    steps = steps.withColumn("k", F.sum(F.coalesce("hits", F.lit(0))).over(up)).drop("hits")
    strata = ranked.agg(F.countDistinct("stratum").alias("strata"))
    steps = steps.join(F.broadcast(strata)).withColumn("p", at_most(F.col("k"), F.col("n"), risk))
    steps = steps.withColumn("certified", F.min((F.col("p") <= level / F.col("strata")).cast("int")).over(up) == 1)
    return steps.select("stratum", "step", "rule", "cutoff", "n", "k", "p", "certified")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified cutoffs; a rule without one doesn't appear.

    Labels without a doc_id or quality don't count; a document labelled more than once is good
    only if all its labels say so, and toxic if one does.
    """
    return certificates(measured, labels, risk, level).where("certified").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, *keep: str, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The kept columns and the columns of :func:`quality_rules`, a row for each row of ``docs``."""
    names = [n for n in dict.fromkeys(("doc_id", *keep)) if n != "text"]
    stratum = F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    measured = stage(measures(docs.select(*[docs[n].alias(n) for n in names], docs["text"].alias("text"), stratum.alias("stratum")), *names, "stratum"), "measures")
    found = cutoffs(measured, labels, risk, level)
    wide = stage(found.groupBy("stratum").pivot("rule", RULES).agg(F.first("cutoff")), "cutoffs")
    score = scored()
    limit = {r: F.col(f"_cut_{r}") for r in RULES}
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    d = measured.join(small(wide), measured.stratum == F.col("_stratum"), "left")
    over = F.array_compact(F.array(*[F.when(score[r] > limit[r], F.lit(r)) for r in RULES]))
    d = d.withColumn("base_failed", base_failed()).withColumn("rejected_by", over)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return d.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    One row per row of ``docs``; repeated rows and null doc_ids come out as they are. A null or empty
    text has no words and fails the base rule. A null language is the stratum ''. Where labels are
    missing or too few to show anything, the method rejects nothing beyond the base rule.
    Windows of five words are told apart by 64-bit hashes within one text.
    """
    return judge(docs, labels)
