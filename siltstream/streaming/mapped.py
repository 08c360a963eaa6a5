"""Sessions, matches and fetch attempts kept up to date batch by batch: only touched sessions are mapped (ST2, ST3, ST4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.operators import detect as D
from siltstream.operators import sessions as S
from siltstream.sources.log import split_rejects, stream_events, typed_events
from siltstream.streaming.buckets import Buckets, Part, only

COUNTS = [f"n_{n}" for n in S.CAPS]


class MappedLog:
    """The log's tables and what is derived from single sessions, bucketed by session.

    Rows of a session may come in any number of batches, in any order and arbitrarily late. Tables are united by
    natural key, so a batch that is repeated after a failure changes nothing. Sessions whose numbers of rows have changed, or which were mapped by
    rules of another version, are mapped again; of all others matches stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, techniques: DataFrame, rules=None, version: str = "1", buckets: int = 64):
        self.store = Buckets(spark, path, buckets)
        self.techniques, self.rules, self.version = techniques, rules, version

    def add(self, batch: dict[str, DataFrame]) -> int:
        """Merge a batch's tables; the number of sessions that were mapped."""
        touched = self.store.touched(batch["sessions"], "id")
        if not touched:
            return 0
        old = {n: self.store.read(n, t, touched) for n, t in batch.items()}
        merged = {"sessions": S.merge_sessions(old["sessions"], batch["sessions"])}
        merged |= {n: S.merge_capped(old[n], batch[n], n) for n in S.CAPS}
        written = self.store.write({n: Part(t, "id" if n == "sessions" else "session_id", touched) for n, t in merged.items()})
        return self._map(written, touched)

    def remap(self, at_once: int = 16) -> int:
        """Map what was mapped by rules of another version, some buckets at a time."""
        done = 0
        for at in range(0, self.store.count, at_once):
            some = list(range(at, min(at + at_once, self.store.count)))
            tables = {n: self.store.read(n, buckets=some) for n in ("sessions", *S.CAPS)}
            done += self._map(tables, some)
        return done

    def _map(self, tables: dict[str, DataFrame], touched: list[int]) -> int:
        spark = self.store.spark
        none = spark.createDataFrame([], f"session_id string, version string, {', '.join(f'{c} long' for c in COUNTS)}")
        state = self.store.read("mapped", none, touched)
        due = S.pending_sessions(tables["sessions"], S.row_counts(tables), state, self.version)
        new_state = due.select(F.col("id").alias("session_id"), F.lit(self.version).alias("version"), *COUNTS)
        kept = state.join(new_state.select("session_id"), "session_id", "left_anti")
        mapped = self.store.write({"mapped": Part(new_state.withColumn("_new", F.lit(True)).unionByName(kept.withColumn("_new", F.lit(False))), "session_id", touched)})["mapped"]
        ids = mapped.where("_new").select(F.col("session_id").alias("id"))
        n = ids.count()
        own = {t: only(d, "id" if t == "sessions" else "session_id", ids) for t, d in tables.items()}
        parts = {"matches": D.map_sessions(own, self.techniques, self.rules), "fetches": D.session_fetches(own["commands"])}
        parts = {t: d.unionByName(only(self.store.read(t, d, touched), "session_id", ids, "left_anti")) for t, d in parts.items()}
        self.store.write({t: Part(d, "session_id", touched) for t, d in parts.items()})
        self.store.commit()
        return n

    def read(self, name: str) -> DataFrame:
        """One of the tables of the log, or matches, fetches, mapped."""
        return self.store.read(name)


def arrival(number: int) -> Column:
    """Places of a batch's lines: batch, part of the input, line; one number, as the tables' ``ord`` is."""
    line = F.monotonically_increasing_id()
    return F.lit(number << 44) + F.shiftleft(F.shiftright(line, 33), 24) + line.bitwiseAND((1 << 33) - 1)


def map_stream(spark: SparkSession, path: str, log: MappedLog, checkpoint: str):
    """A query that keeps ``log`` up to date with the JSON lines below ``path``; rejected lines go beside the tables."""

    def batch(lines: DataFrame, number: int) -> None:
        events, rejects = split_rejects(typed_events(lines.withColumn("ord", arrival(number))))
        rejects.write.mode("overwrite").parquet(f"{log.store.path}/_rejects/batch={number}")
        log.add(S.store_events(events))

    return stream_events(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
