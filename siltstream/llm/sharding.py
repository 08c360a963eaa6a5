"""Resharding by minimum-cost flow (operator 8).

Old shards have the sizes they have, new shards equal capacities. A minimum-cost flow from old to
new, where a byte that stays costs nothing and a byte that moves costs one, says how many bytes go
where. Within an old shard documents stand in a fixed order, large ones first; its flows cut that
order into runs, the first of which stays, so that small documents move and runs end close to the
flow's sizes. Then only the shards that give or take rows are written anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from siltstream.llm.rows import identifies, with_row
from siltstream.plans.shared import scratch, small, stage

SHARDS = 16
#: Groups of equal rows that one block of the running sums holds on average.
BLOCK_ROWS = 20_000
#: Bytes of text that one task writes.
PIECE_BYTES = 128_000_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows from each supply to each capacity, all supplies used, at the least total cost.

    Successive shortest paths; the graph has as many nodes as there are shards, old and new.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    have, room = list(supply), list(capacity)
    while any(have):
        # Bellman-Ford from the supplies that are left; node n + j is capacity j
        far = [0 if have[i] else None for i in range(n)] + [None] * m
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] is not None and (far[n + j] is None or far[i] + cost[i][j] < far[n + j]):
                        far[n + j], back[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] is not None and (far[i] is None or far[n + j] - cost[i][j] < far[i]):
                        far[i], back[i], changed = far[n + j] - cost[i][j], n + j, True
        ends = [j for j in range(m) if room[j] and far[n + j] is not None]
        if not ends:
            raise ValueError("the capacities are too small")
        end = min(ends, key=lambda j: (far[n + j], j))
        path, node = [], n + end
        while back[node] is not None:
            path.append((back[node], node))
            node = back[node]
        most = min([have[node], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        have[node] -= most
        room[end] -= most
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


#: The old shard of rows whose column names none.
UNKNOWN = -1


def _running(d: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over what stands before a row within ``by``, in blocks (column _block) and then within them."""
    sums = d.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    up = W.Window.partitionBy(*by).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_before"))
    same = (F.col("_block") == F.col("_b")) if not by else None
    for i, c in enumerate(by):
        same = (F.col(c) == F.col(f"_k{i}")) & (F.col("_block") == F.col("_b")) if same is None else same & (F.col(c) == F.col(f"_k{i}"))
    inside = W.Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    out = d.join(small(sums), same).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_b", "_before", *[f"_k{i}" for i in range(len(by))])


def _numbered(docs: DataFrame, *names: str) -> DataFrame:
    """As :func:`with_row`, but rows of files are told apart by where they stand, so they needn't be sorted and written first."""
    if not identifies(docs, "doc_id"):
        try:
            uid = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("uid")
            return docs.select(uid, *[docs[n].alias(n) for n in names], F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
        except AnalysisException:  # no rows of files
            pass
    return with_row(docs, *names)


def _described(docs: DataFrame, old: str | None, old_shards: int, keep_row: bool) -> DataFrame:
    """(uid, doc_id, size, text_crc32, old_shard and, if it is asked for, the row)."""
    rows = _numbered(docs, "doc_id", "text", *([old] if old else []))
    text = F.coalesce(F.col("text"), F.lit(""))
    home = F.col(old).cast("int") if old else F.pmod(F.xxhash64("doc_id"), F.lit(old_shards))
    home = F.when(home.between(0, old_shards - 1), home).otherwise(UNKNOWN)
    own = rows.select("uid", "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), home.cast("int").alias("old_shard"), *(["_row"] if keep_row else []))
    return own


def _ordered(rows: DataFrame, n: int, old_shards: int) -> DataFrame:
    """``rows`` with _h and _block: powers of two of the size, largest first, dealt further by a hash. Within a block rows stand by size (largest first), _h and uid."""
    parts = max(1, n // (BLOCK_ROWS * old_shards))
    octave = 63 - F.floor(F.log2(F.col("size").cast("double")))
    d = rows.withColumn("_h", F.xxhash64("doc_id", "text_crc32", "size"))
    return d.withColumn("_block", octave * parts + F.pmod("_h", F.lit(parts)))


def _plan(rows: DataFrame, shards: int, old_shards: int) -> tuple[DataFrame, list[list[int]]]:
    """(uid, doc_id, size, text_crc32, old_shard, shard, slot) and the flow, for what :func:`_described` says."""
    rows = stage(rows.select("uid", "doc_id", "size", "text_crc32", "old_shard"), "sizes")
    held = {r[0]: (int(r[1]), int(r[2])) for r in rows.groupBy("old_shard").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    supply = [held.get(i, (0, 0))[0] for i in range(old_shards)]
    if UNKNOWN in held:
        raise ValueError(f"{held[UNKNOWN][1]} rows have no old shard from 0 to {old_shards - 1}")
    n, total = sum(k for _, k in held.values()), sum(supply)
    flow = min_cost_flow(supply, equal_capacities(total, shards), [[int(i != j) for j in range(shards)] for i in range(old_shards)])
    order = [F.desc("size"), "_h", "uid"]
    g = _ordered(rows, n, old_shards)
    g = _running(g, ["old_shard"], order, "size", "_start")
    cuts = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if row[j]:
                cuts.append((i, j, at, at + row[j]))
                at += row[j]
    runs = rows.sparkSession.createDataFrame(cuts, "_o int, shard int, _from long, _to long")
    # a row goes where its middle lies
    middle = F.col("_start") + F.col("size") / 2
    g = g.join(F.broadcast(runs), (F.col("old_shard") == F.col("_o")) & (F.col("_from") <= middle) & (middle < F.col("_to")))
    g = stage(g.drop("_o", "_from", "_to", "_start").withColumn("_one", F.lit(1)), "cut")
    g = _running(g.withColumn("_block", F.col("_block") * old_shards + F.col("old_shard")), ["shard"], order, "_one", "slot")
    return stage(g.select("uid", "doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "_h", "_block"), "plan"), flow


def plan_shards(docs: DataFrame, shards: int = SHARDS, old_shards: int = SHARDS, old: str | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(doc_id, size, text_crc32, old_shard, shard, slot for every row, bytes from each old to each new shard).

    ``old`` names the column with the shard (0 to old_shards - 1) that a row is in; without it that is the hash of the doc_id.
    Raises a ValueError with the number of rows of which that column is null or no such shard: none is left out.
    """
    plan, flow = _plan(_described(docs, old, old_shards, False), shards, old_shards)
    return plan.drop("uid", "_h", "_block"), flow


_OUT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"]


def _as_contract(d: DataFrame) -> DataFrame:
    return d.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard: one row per row of ``docs``, nothing moved yet.

    The law is ``bytes``: shards' sizes differ by little more than a small document. Null texts have
    size 1 and checksum 0; null doc_ids share an old shard, from which the flow moves what is too much.
    Equal rows are interchangeable and may part. An empty table gives an empty result. Doc_ids, sizes
    and checksums alone decide, so reruns agree but for equal rows.
    """
    return _as_contract(plan_shards(docs, shards)[0]).select(*_OUT)


def rewrite_shards(docs: DataFrame, path: str, shards: int = SHARDS, old_shards: int = SHARDS, old: str | None = None) -> tuple[list[int], DataFrame]:
    """Write the shards that give or take rows below ``path``; (their numbers, the plan for all rows).

    Files are partitioned by shard, their blocks ordered by slot, and have the columns uid, doc_id, size, text_crc32,
    old_shard, slot and ``row``, which holds the columns of ``docs``, so none of them can clash.
    Shards that the flow leaves alone are not written: their old files hold.
    """
    rows = _described(docs, old, old_shards, True)
    plan, flow = _plan(rows, shards, old_shards)
    touched = sorted({s for i, r in enumerate(flow) for j, n in enumerate(r) if n and i != j for s in (i, j) if s < shards} | {j for j in range(shards) if j >= old_shards})
    # texts move once: a row's shard follows from where the runs of its old shard begin, its slot from where its block's slots do
    key = F.struct((-F.col("size")).alias("s"), F.col("_h").alias("h"), F.col("uid").alias("u"))
    at = F.struct((F.col("_block") / F.lit(old_shards)).cast("long").alias("b"), key.alias("k"))
    first = plan.groupBy("old_shard", "shard").agg(F.min(at).alias("at"))
    first = first.groupBy(F.col("old_shard").alias("_o")).agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("_runs"))
    slots = plan.groupBy(F.col("shard").alias("_s"), F.col("_block").alias("_b")).agg(F.min("slot").alias("_from"))
    d = _ordered(rows, plan.count(), old_shards).join(F.broadcast(first), F.col("old_shard") == F.col("_o"))  # a row for each old shard
    here = F.struct(F.col("_block").alias("b"), key.alias("k"))
    d = d.withColumn("shard", F.element_at(F.filter("_runs", lambda r: r["at"] <= here), -1)["shard"]).drop("_runs", "_o").where(F.col("shard").isin(touched))
    d = d.withColumn("_block", F.col("_block") * old_shards + F.col("old_shard"))
    d = d.join(small(slots), (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b"))).drop("_s", "_b")
    # pieces of a shard, so that it is several tasks and files, each of bounded bytes
    most = max([sum(r[j] for r in flow) for j in range(shards)])
    per = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(touched)), -(-most // PIECE_BYTES))
    d = d.withColumn("_piece", F.pmod(F.hash("_block"), F.lit(per))).repartition(per * max(1, len(touched)), "shard", "_piece")
    inside = W.Window.partitionBy("shard", "_piece", "_block").orderBy(F.desc("size"), "_h", "uid")
    d = d.withColumn("slot", (F.col("_from") + F.row_number().over(inside) - 1).cast("long"))
    d.select("uid", "doc_id", "size", "text_crc32", "old_shard", "slot", F.col("_row").alias("row"), "shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return touched, plan.drop("_h", "_block")


def reshard(docs: DataFrame, shards: int = SHARDS, columns: bool = False) -> DataFrame:
    """The rows of :func:`shard_documents`, after the move: from the files of rewritten shards, and of the others from the plan.

    The files lie below the shared folder. With ``columns``, rows have the columns of ``docs`` too, under
    their names; columns of ours that ``docs`` has a name of (doc_id apart, which is the same) are called new_shard, new_size and so on.
    """
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    touched, plan = rewrite_shards(docs, path, shards)
    stay = plan.where(~F.col("shard").isin(touched))
    if not touched or plan.isEmpty():
        files = stay
        if columns:
            files = files.join(_numbered(docs).withColumnRenamed("_row", "row"), "uid")
    else:
        kind = T.StructType([*plan.drop("shard").schema.fields, T.StructField("row", docs.schema)])
        files = spark.read.schema(T.StructType([*kind.fields, T.StructField("shard", T.IntegerType())])).parquet(path)
        if columns:
            rest = stay.join(_numbered(docs).withColumnRenamed("_row", "row"), "uid")
            files = files.unionByName(rest)
        else:
            files = files.select(*plan.columns).unionByName(stay)
    out = _as_contract(files)
    if not columns:
        return out.select(*_OUT)
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name = f"new_{name}"
        return name

    ours = [F.col(c).alias(c if c == "doc_id" else free(c)) for c in _OUT]
    return out.select(*ours, *[F.col("row")[c].alias(c) for c in docs.columns if c != "doc_id"])
