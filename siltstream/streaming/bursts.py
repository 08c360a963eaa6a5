"""Exact bursts of a source's events, live: state per source with timers (ST5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstream.operators.detect import FREQUENCIES

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "src_ip string, s long, alert string, n long, events long"


class Bursts(StatefulProcessor):
    """Of one source and kind of event: counts of its last seconds.

    A second is judged by a timer once the watermark has passed it, when all events of it and of those before have
    come, however they were split into batches. Seconds that no later span can reach are dropped, so the state of a source holds
    at most the longest span and the watermark's delay in seconds, whatever its rate, and nothing once it is idle.
    """

    def __init__(self, frequencies=FREQUENCIES):
        self.rules = [tuple(r) for r in frequencies]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "s long", "n long")
        self.upto = handle.getValueState("upto", "s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for part in rows:
            for s, n in part["s"].value_counts().items():
                new[int(s)] = new.get(int(s), 0) + int(n)
        span = max(r[3] for r in self.rules if r[1] == key[0])
        for s, n in new.items():
            old = self.counts.getValue((s,)) if self.counts.containsKey((s,)) else None
            self.counts.updateValue((s,), (n + (old[0] if old else 0),))
            if old is None:
                self.handle.registerTimer((s + 1) * 1000)  # judged
                self.handle.registerTimer((s + span + 1) * 1000)  # reached by no later span
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1  # the last second that is complete
        done = self.upto.get()[0] if self.upto.exists() else None
        held = {k[0]: v[0] for k, v in self.counts.iterator()}
        out = []
        for s in sorted(s for s in held if s <= now and (done is None or s > done)):
            for alert, what, least, span in self.rules:
                n = sum(c for t, c in held.items() if s - span <= t <= s)
                if what == key[0] and n >= least:
                    out.append((key[1], s, alert, n, held[s]))
        reach = max(r[3] for r in self.rules if r[1] == key[0])
        gone = [s for s in held if s < now - reach + 1]
        for s in gone:
            self.counts.removeKey((s,))
        if len(gone) == len(held):
            self.upto.clear()
        else:
            self.upto.update((max(now, done or now),))
        if out:
            yield pd.DataFrame(out, columns=["src_ip", "s", "alert", "n", "events"])

    def close(self) -> None:
        pass


def exact_bursts(events: DataFrame, discovery_commands: DataFrame, delay: str = "10 minutes", frequencies=FREQUENCIES) -> DataFrame:
    """(src_ip, s, alert, n, events): seconds of a source that complete a burst, with the events of that second; a stream.

    The same as :func:`siltstream.operators.detect.frequency_alerts` on all events that come within ``delay`` of the latest one,
    however they are split into batches; a second appears when the watermark has passed it. The session needs
    RocksDB as its state store (``STATE_STORE``). discovery_commands (input) is a table. Events without an address or a
    time raise no alert.
    """
    commands = F.broadcast(discovery_commands.select("input").distinct()) if not discovery_commands.isStreaming else discovery_commands
    timed = events.where("src_ip is not null and ts is not null").withWatermark("ts", delay)
    found = timed.where("eventid = 'cowrie.command.input'").join(commands, "input", "left_semi")
    kinds = [("login.failed", timed.where("eventid = 'cowrie.login.failed'")), ("discovery", found)]
    both = reduce(DataFrame.unionByName, [d.select(F.lit(what).alias("what"), "src_ip", "ts", F.unix_seconds("ts").alias("s")) for what, d in kinds])
    return both.groupBy("what", "src_ip").transformWithStateInPandas(Bursts(frequencies), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
