"""Sessions held in state until they are over, then spilled whole: few writes, whatever the rate of batches (ST3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstream.functions.net import is_internal
from siltstream.operators import sessions as S
from siltstream.streaming.mapped import MappedLog

#: What a session's own row says, in the order in which it is held.
SUMMARY = {"src_ip": "string", "start_us": "long", "end_us": "long", "duration_ms": "long", "client_version": "string", "hassh": "string"}
#: The columns of all kinds of child rows.
FIELDS = {
    "username": "string", "password": "string", "success": "boolean", "command": "string", "url": "string", "sha256": "string", "filename": "string",
    "destination": "string", "dst_ip": "string", "dst_port": "int", "orig_ip": "string", "orig_port": "int",
}
#: One row of a spilled session: kind "sessions" once, then its child rows; n is the place in order of arrival.
SPILLED = ["kind string", "id string", "n long", "us long", *[f"s_{c} {t}" for c, t in SUMMARY.items()], *[f"row_{c} {t}" for c, t in FIELDS.items()]]


def _plain(x, whole: bool = False):
    """A value as state takes it: missing is None, and numbers, which travel as texts so that nulls beside them don't make them floats, are numbers again."""
    if x is None or x is pd.NA or x != x:
        return None
    return int(x) if whole else bool(x) if isinstance(x, np.bool_) else x


class LiveSessions(StatefulProcessor):
    """Of one session: its own row so far, how many rows of each kind came, and those within the kinds' caps.

    A batch appends its rows to a list and reads none of the older ones, so the work of a batch grows with its rows only.
    State ends ``linger`` seconds of event time after a session was closed, or ``idle`` seconds after its last event; what comes
    later begins a new piece. A session therefore holds at most the caps' rows, and nothing once it was spilled.
    """

    def __init__(self, linger: int, idle: int, order: int):
        self.linger, self.idle, self.order = linger, idle, [f"o{i}" for i in range(order)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = ", ".join(f"{c} {t}" for c, t in SUMMARY.items())
        counts = ", ".join(f"n_{n} long" for n in S.CAPS)
        self.own = handle.getValueState("own", f"{own}, {counts}, arrived long, latest long, closed boolean, due long")
        self.rows = handle.getListState("rows", ", ".join(["kind string", "n long", "us long", *[f"{c} {t}" for c, t in FIELDS.items()]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.own.get() if self.own.exists() else None
        own = dict(zip(SUMMARY, held)) if held else dict.fromkeys(SUMMARY)
        at = len(SUMMARY)
        counts = dict(zip(S.CAPS, held[at : at + len(S.CAPS)] if held else [0] * len(S.CAPS)))
        arrived, latest, closed, due = held[at + len(S.CAPS) :] if held else (0, None, False, None)
        new = []
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        for e in batch.astype(object).to_dict("records"):
            us, what = _plain(e["us"], True), e["eventid"]
            own["src_ip"] = own["src_ip"] if own["src_ip"] is not None else _plain(e["src_ip"])
            own["start_us"] = own["start_us"] if own["start_us"] is not None else us
            if what == "cowrie.session.closed":
                own["end_us"], own["duration_ms"], closed = us, _plain(e["duration_ms"], True), True
            elif what == "cowrie.client.version":
                own["client_version"] = _plain(e["version"])
            elif what == "cowrie.client.kex":
                own["hassh"] = _plain(e["hassh"])
            kind = _plain(e["kind"])
            if kind is not None:
                counts[kind] += 1
                values = tuple(_plain(e[f"row_{c}"], sort == "int") for c, sort in FIELDS.items())
                if counts[kind] <= S.CAPS[kind] and (kind != "commands" or _plain(e["row_command"]) is not None):
                    new.append((kind, arrived, us, *values))
            arrived += 1
            latest = us if latest is None else latest if us is None else max(latest, us)
        if new:
            self.rows.appendList(new)
        # events without a time count from where the watermark is
        seen = max(latest or 0, timerValues.getCurrentWatermarkInMs() * 1000)
        then = seen // 1000 + (self.linger if closed else self.idle) * 1000
        if due is not None and due != then:
            self.handle.deleteTimer(due)
        if due != then:
            self.handle.registerTimer(then)
        self.own.update((*own.values(), *counts.values(), arrived, latest, closed, then))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPILLED]
        held = self.own.get()
        own = held[: len(SUMMARY)]
        out = [("sessions", key[0], 0, None, *own, *[None] * len(FIELDS))]
        seen = set()
        for row in sorted(map(tuple, self.rows.get() if self.rows.exists() else ()), key=lambda r: r[1]):
            values = dict(zip(FIELDS, row[3:]))
            natural = (row[0], row[2], *[values[c] for c in S.KEYS[row[0]]])
            if natural not in seen:
                seen.add(natural)
                out.append((row[0], key[0], row[1], row[2], *[None] * len(SUMMARY), *row[3:]))
        self.rows.clear()
        self.own.clear()
        yield pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)

    def close(self) -> None:
        pass


def live_sessions(events: DataFrame, linger: int = 60, idle: int = 3600, delay: str = "10 minutes", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Sessions as rows (``SPILLED``) once they are over; a stream.

    Over means: ``linger`` seconds after the end of a session, or ``idle`` seconds after its last event, as the watermark tells, which follows
    the latest event by ``delay``. Events of one batch arrive in the order of the columns ``order``, batches one after the other. No event is too late:
    it begins another piece of its session, which :func:`pieces` and the tables' merging unite with the earlier one. A time far in the
    future moves the watermark there; sessions are then spilled in more pieces and come out the same. Needs RocksDB as state store.
    """
    rows = S.event_rows(events.where("session != ''").withWatermark("ts", delay))
    # the time goes on as a number: with the watermark's column late events would be dropped
    us = F.unix_micros("ts")
    arrival = [(us if c == "ts" else F.col(c)).alias(f"o{i}") for i, c in enumerate(order)]
    values = [F.col(f"row_{c}").cast("string" if t == "int" else t).alias(f"row_{c}") for c, t in FIELDS.items()]
    keep = rows.select("session", "eventid", "src_ip", F.col("duration_ms").cast("string").alias("duration_ms"), "version", "hassh", "kind", us.cast("string").alias("us"), *arrival, *values)
    return keep.groupBy("session").transformWithStateInPandas(LiveSessions(linger, idle, len(order)), outputStructType=", ".join(SPILLED), outputMode="Append", timeMode="EventTime")


def pieces(spilled: DataFrame, number: int = 0) -> dict[str, DataFrame]:
    """Tables, as of :func:`siltstream.operators.sessions.store_events`, of spilled rows; ``number`` orders batches.

    A session that was spilled twice within these rows has one row again."""
    ts = F.timestamp_micros("us")
    one = spilled.where("kind = 'sessions'").select("id", F.col("s_src_ip").alias("src_ip"), F.timestamp_micros("s_start_us").alias("start_time"), F.timestamp_micros("s_end_us").alias("end_time"), *[F.col(f"s_{c}").alias(c) for c in ("duration_ms", "client_version", "hassh")])
    out = {"sessions": one.withColumn("internal", is_internal(F.col("src_ip")))}
    for n in S.CAPS:
        w = W.Window.partitionBy("session_id", "ts", *S.KEYS[n]).orderBy("ord")
        rows = spilled.where(F.col("kind") == n).select(F.col("id").alias("session_id"), (F.lit(number << 44) + F.col("n")).alias("ord"), ts.alias("ts"), *[F.col(f"row_{c}").alias(c) for c in S.ROW[n]])
        out[n] = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out


def spill_stream(spark: SparkSession, events: DataFrame, log: MappedLog, checkpoint: str, **options):
    """A query that adds sessions to ``log`` when they are over; a batch that is repeated changes nothing."""

    def batch(spilled: DataFrame, number: int) -> None:
        spilled.persist()  # six tables read it
        try:
            log.add(pieces(spilled, number))
        finally:
            spilled.unpersist()

    return live_sessions(events, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
