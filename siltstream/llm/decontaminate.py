"""Benchmark decontamination by a distributed positional inverted index (operator 2).

Built-in functions only. Postings (text, place) of the rarest terms of each benchmark window are
stored as a table. A window's candidates come from its rarest term's list; lists of the next rarest
terms, moved by their offsets, are intersected with it one after the other, and what is left is
compared word by word. Only counts of benchmark terms and postings of their rare ones are shuffled;
of texts the words around candidates travel, where these are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.llm.rows import with_key, with_row, with_uid, without
from siltstream.llm.words import letter_words
from siltstream.plans.shared import small, stage

LENGTH = 13
#: Posting lists that are intersected before words are compared.
LISTS = 3


def phrases(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(item, words): windows of ``length`` words; an item of fewer, but not none, is one."""
    w = items.select(items["item_id"].cast("string").alias("item"), letter_words(items["text"]).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))).alias("i")
    return w.select("item", "w", starts).select("item", F.slice("w", F.col("i"), F.lit(length)).alias("words")).distinct()


def _tokens(texts: DataFrame) -> DataFrame:
    return texts.select("uid", F.posexplode(letter_words(F.col("text"))).alias("pos", "term"))


def index_terms(texts: DataFrame, queries: DataFrame, lists: int = LISTS) -> tuple[DataFrame, DataFrame]:
    """(rare, postings) for queries (qid, words).

    rare: (qid, rank, term, offset), the rarest terms of each query that can occur at all, rank 1
    first. postings: (term, uid, pos) of those terms, stored in the shared folder.
    """
    vocabulary = stage(queries.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = _tokens(texts).select("term").join(small(vocabulary), "term", "left_semi").groupBy("term").count()
    counts = stage(counts, "term-counts")
    terms = queries.select("qid", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term")).join(counts, "term")
    whole = W.Window.partitionBy("qid")
    ranked = terms.withColumn("have", F.count(F.lit(1)).over(whole)).where("have = n")
    ranked = ranked.withColumn("rank", F.row_number().over(whole.orderBy("count", "term", "offset"))).where(F.col("rank") <= lists)
    rare = stage(ranked.select("qid", "rank", "term", "offset"), "rare-terms")
    wanted = stage(rare.select("term").distinct(), "wanted")
    return rare, stage(_tokens(texts).join(small(wanted), "term"), "postings")


def phrase_candidates(rare: DataFrame, postings: DataFrame, slop: int = 0) -> DataFrame:
    """(uid, qid, start): starts that the offset-adjusted lists of a query's rare terms share.

    With ``slop``, a term may stand up to that many places from where the phrase would have it.
    """
    first = rare.where("rank = 1").drop("rank")
    place = F.col("pos") - F.col("offset")
    starts = F.explode(F.sequence(place - slop, place + slop)) if slop else place
    found = postings.join(small(first), "term").select("uid", "qid", starts.alias("start")).where(F.col("start") >= -slop)
    found = found.distinct()
    for rank in range(2, LISTS + 1):
        term = small(rare.where(F.col("rank") == rank).select("qid", F.col("term").alias("t"), F.col("offset").alias("o")))
        asked = found.join(term, "qid", "left")
        asked = asked.select("uid", "qid", "start", "t", F.explode(F.sequence(F.col("start") + F.coalesce("o", F.lit(0)) - slop, F.col("start") + F.coalesce("o", F.lit(0)) + slop)).alias("p"))
        have = postings.select(F.col("uid").alias("u"), F.col("pos").alias("p2"), F.col("term").alias("t2"))
        hit = asked.where("t is not null").join(have, (F.col("uid") == F.col("u")) & (F.col("p") == F.col("p2")) & (F.col("t") == F.col("t2"))).select("uid", "qid", "start")
        found = hit.unionByName(asked.where("t is null").select("uid", "qid", "start"))
        if slop:
            found = found.distinct()
    return found


def _covered(hits: str) -> Column:
    """Words in the union of the spans (start, n) of the array column ``hits``."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))

    def step(s: Column, h: Column) -> Column:
        end = h.start + h.n
        return F.struct((s.sum + F.greatest(end - F.greatest(s.end, h.start), F.lit(0))).alias("sum"), F.greatest(s.end, end).alias("end"))

    return F.aggregate(F.array_sort(hits), start, step, lambda s: s.sum).cast("long")


def verified(texts: DataFrame, candidates: DataFrame, queries: DataFrame, slop: int = 0) -> DataFrame:
    """(uid, qid, start, n): the candidates (uid, qid, start) at which all the query's words stand, compared as words.

    With ``slop``, each word may stand up to that many places from where the phrase would have it. Only texts with
    candidates are read for this, and only the words around a candidate travel.
    """
    asked = candidates.join(small(queries.select("qid", F.size("words").alias("n"))), "qid")
    asked = small(stage(asked.groupBy("uid").agg(F.collect_set(F.struct("start", "n", "qid")).alias("asked")), "to-compare"))
    d = texts.join(asked, "uid").select("uid", letter_words(F.col("text")).alias("w"), "asked")
    # the words from slop before the start; those before the text's first are left out
    early = lambda a: F.greatest(F.lit(slop) - a.start, F.lit(0))
    piece = lambda a: F.slice("w", F.greatest(a.start - slop, F.lit(0)) + 1, F.greatest(a.n + 2 * slop - early(a), F.lit(0)))
    around = F.explode(F.transform("asked", lambda a: F.struct(a.qid.alias("qid"), a.start.alias("start"), a.n.alias("n"), early(a).alias("early"), piece(a).alias("have")))).alias("x")
    d = d.select("uid", around).select("uid", "x.*").join(small(queries.select("qid", "words")), "qid")
    if not slop:
        return d.where(F.col("have") == F.col("words")).select("uid", "qid", "start", "n")
    # word i of the phrase may be at i - slop to i + slop of its place: at i to i + 2 slop of the piece
    low = lambda i: F.greatest(i - F.col("early"), F.lit(0))
    reach = lambda i: F.slice("have", low(i) + 1, F.greatest(i + 2 * slop - F.col("early") + 1 - low(i), F.lit(0)))
    all_near = F.forall(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_contains(reach(i), F.get("words", i)))
    return d.where(all_near).select("uid", "qid", "start", "n")


def matches(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(uid, n_hit, qids): exact occurrences of the queries' phrases, for the texts that have any."""
    rare, postings = index_terms(texts, queries)
    candidates = stage(phrase_candidates(rare, postings), "candidates")
    found = verified(texts, candidates, queries)
    d = found.groupBy("uid").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("qid").alias("qids"))
    return d.select("uid", _covered("spans").alias("n_hit"), "qids")


def near_matches(docs: DataFrame, items: DataFrame, slop: int = 2, length: int = LENGTH) -> DataFrame:
    """(doc_id, item): proximity matches, where every word of a window of the item stands within ``slop`` of its place.

    The lists of the window's rarest terms, widened by the slop, give the candidates; all words are then looked for.
    A null text or item has no words and matches nothing, an item without an id isn't reported, and an empty table
    on either side gives an empty result. Rows that repeat or share a doc_id are reported once.
    """
    texts, same = with_uid(docs)
    windows = phrases(items, length)
    queries = stage(windows.select("words").distinct().withColumn("qid", F.xxhash64("words")), "queries")
    rare, postings = index_terms(texts, queries)
    candidates = stage(phrase_candidates(rare, postings, slop).select("uid", "qid", "start").distinct(), "candidates")
    found = verified(texts.select("uid", "text"), candidates, queries, slop).select("uid", "qid").distinct()
    named = windows.where("item is not null").join(queries, "words").select("qid", "item")
    return with_key(found.join(small(named), "qid"), texts, same).select("doc_id", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    A null or empty text has no words and is clean; an item without words matches nothing. Items
    with a null item_id hit words but are not listed. Repeated rows and null doc_ids keep a row each.
    An empty benchmark leaves every document clean.
    """
    texts, same = with_uid(docs)
    windows = stage(phrases(items), "windows")
    queries = stage(windows.select("words").distinct().withColumn("qid", F.xxhash64("words")), "queries")
    found = stage(matches(texts.select("uid", "text"), queries), "matches")
    named = windows.where("item is not null").join(queries, "words").select("qid", "item")
    listed = found.select("uid", F.explode("qids").alias("qid")).join(small(named), "qid")
    listed = listed.groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = small(stage(found.drop("qids").join(listed, "uid", "left"), "hits"))
    # each run of letters, digits and what lies beyond ASCII is a word
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    d = texts.select("uid", words.cast("long").alias("n_words")).join(hits, "uid", "left")
    d = with_key(d.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))), texts, same)
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; each has a verdict of its own, whatever its doc_id."""
    rows = with_row(docs, "text")
    bad = decontaminate(rows.select(F.col("uid").alias("doc_id"), "text"), items).where("contaminated")
    return without(rows, bad.select(F.col("doc_id").alias("uid")))
