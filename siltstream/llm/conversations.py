"""Repairing the structure of conversations: bidirectional Dijkstra over the edit lattice.

A lattice node is (rows consumed, state of the role pattern ``(s?(ua)+)?``); edges keep, rerole or delete a row, or insert
a turn. A forward and a reverse heap meet; all crossings of the least cost are finished, and of their audits the
least is taken. An audit fixes its path: between two nodes none of the cheapest audits begins another, so least parts make a
least whole, and a conversation too long for one search is cut into segments. Each is searched from every state to every state;
a fold over those small tables picks the states at the cuts. Rows lie in ranges of (conversation, turn), so a
conversation of any size is spread over tasks; those that lie whole in a task and are short are done there.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siltstream.plans.shared import stage

#: Costs of edits; what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Rows of a segment, and bytes of text after which one ends early.
SEGMENT, SEGMENT_BYTES = 512, 4_000_000
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a system turn, after a user's, after an assistant's. What a new turn leads to, and is.
START, S, U, A = range(4)
NEXT = (U, U, A, U)
NEW = {U: "user", A: "assistant"}
#: Turns to insert after the last row, so that the pattern is complete.
TAIL = (0, 2, 1, 0)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}

Row = tuple[str, int]  # a role's initial and a fault
Node = tuple[int, int]


def edges(rows: list[Row], node: Node) -> list[tuple[int, str, Node]]:
    """(cost, edit, where it leads) of the edits at a node; nothing is inserted after the last row."""
    i, q = node
    if i == len(rows):
        return []
    initial, fault = rows[i]
    out = [(INSERT, "I", (i, NEXT[q])), (DELETE, "D", (i + 1, q))]
    if fault in (FINE, TRUNCATED):
        more = CUT_OFF if fault == TRUNCATED else 0
        out.append((REROLE + more, "R", (i + 1, NEXT[q])))
        if (q, initial) in STEP:
            out.append((KEEP + more, "K", (i + 1, STEP[q, initial])))
    return out


def back_edges(rows: list[Row], node: Node) -> list[tuple[int, str, Node]]:
    """(cost, edit, where it comes from) of the edits that lead to a node."""
    i, q = node
    out = [(INSERT, "I", (i, p)) for p in range(4) if NEXT[p] == q and i < len(rows)]
    for p in range(4) if i else ():
        out += [(c, e, (i - 1, p)) for c, e, to in edges(rows, (i - 1, p)) if to == node]
    return out


class Search:
    """One direction: labels (cost, audit) of nodes, settled in order of cost, then along the rows.

    Only keeping costs nothing and it consumes a row; so nodes of one cost are settled in the order of rows, and a
    settled label has the least cost and the least audit of it.
    """

    def __init__(self, rows: list[Row], first: dict[Node, int], forward: bool) -> None:
        self.rows, self.forward = rows, forward
        self.label = {n: (c, "") for n, c in first.items()}
        self.heap = [(c, self._along(n), n) for n, c in first.items()]
        heapq.heapify(self.heap)
        self.done: set[Node] = set()

    def _along(self, node: Node) -> int:
        return node[0] if self.forward else -node[0]

    def top(self) -> float:
        while self.heap and (self.heap[0][2] in self.done or self.heap[0][0] > self.label[self.heap[0][2]][0]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, other: Search) -> float:
        """Settle the next node; the least cost of a path over its edges to nodes that the other direction has labelled."""
        cost, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        said, best = self.label[node][1], float("inf")
        for c, edit, to in edges(self.rows, node) if self.forward else back_edges(self.rows, node):
            new = (cost + c, said + edit if self.forward else edit + said)
            old = self.label.get(to)
            if old is None or new < old:
                self.label[to] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(self.heap, (new[0], self._along(to), to))
            if to in other.label:
                best = min(best, new[0] + other.label[to][0])
        return best


def cheapest(rows: list[Row], start: int, ends: dict[int, int]) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits from a state to one of ``ends`` (state: cost of ending there); ties: the least audit.

    What ends cost is counted, but has no part in the audit. None where no edits lead there.
    """
    goals = {(len(rows), q): c for q, c in ends.items()}
    if not rows:
        return (ends[start], "") if start in ends else None
    ahead, back = Search(rows, {(0, start): 0}, True), Search(rows, goals, False)
    best = float("inf")
    while True:
        f, b = ahead.top(), back.top()
        if f + b > best or f + b == float("inf"):
            break
        best = min(best, ahead.settle(back) if f <= b else back.settle(ahead))
    found = []
    usable = back.done | goals.keys()
    for node in ahead.done:
        cost, said = ahead.label[node]
        for c, edit, to in edges(rows, node):
            if to in usable and cost + c + back.label[to][0] == best:
                found.append(said + edit + back.label[to][1])
    return (int(best), min(found)) if found else None


def applied(rows: list[tuple[Any, str, str]], audit: str, state: int = START) -> list[tuple[str, Any, str | None, str | None]]:
    """(edit, turn, role, text) of each edit; a deleted row keeps its turn and has no role."""
    out, left = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append((edit, None, NEW[state], ""))
            continue
        turn, role, text = next(left)
        if edit == "D":
            out.append((edit, turn, None, None))
            continue
        state = NEXT[state] if edit == "R" else STEP[state, role[:1]]
        out.append((edit, turn, NEW[state] if edit == "R" else role, text))
    return out


def fault(text: str, seen: bool) -> int:
    """A row's first fault."""
    last = text.rstrip(WHITE)[-1:]
    return BLANK if not last else DUPLICATE if seen else FINE if last in ENDS else TRUNCATED


class Facts(NamedTuple):
    """Counts over consecutive rows of a conversation, and what is needed to join them to the next ones."""

    turns: int
    low: int | None
    first_turn: int | None
    last_turn: int | None
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str

    @classmethod
    def of(cls, rows: list[tuple[Any, str, str]], faults: list[int]) -> Facts:
        turns = [t for t, _, _ in rows if t is not None]
        initial = [r[:1] for _, r, _ in rows]
        bad = sum(x + y not in LEGAL for x, y in zip(initial, initial[1:], strict=False))
        low, high = (turns[0], turns[-1]) if turns else (None, None)
        counts = (faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED))
        return cls(len(set(turns)), low, low, high, *counts, bad, initial[0], initial[-1])

    def then(self, more: Facts) -> Facts:
        again = self.last_turn is not None and self.last_turn == more.first_turn
        return Facts(
            self.turns + more.turns - again, more.low if self.low is None else self.low, more.first_turn if self.low is None else self.first_turn,
            self.last_turn if more.last_turn is None else more.last_turn, self.blank + more.blank, self.duplicate + more.duplicate,
            self.truncated + more.truncated, self.illegal + more.illegal + (self.last + more.first not in LEGAL), self.first, more.last,
        )

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else self.last_turn - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` chooses; nulls are one space."""
    c = conversations
    kind = F.pmod(F.crc32(F.concat_ws(":", *[F.coalesce(c[n].cast("string"), F.lit(" ")) for n in ("conv_id", "turn")])), F.lit(20))
    role, text = (F.coalesce(c[n], F.lit(" ")) for n in ("role", "text"))
    rows = c.select(c["conv_id"].alias("conv_id"), c["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.withColumn("_n", times).select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


_EDIT = "edit: string, turn: bigint, role: string, text: string"
_RESULT = f"gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, edits array<struct<{_EDIT}>>"
_ROWS = "rows array<struct<turn: bigint, role: string, text: string>>"


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow_schema(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema, prefers_large_types=False)


def _in_lists(rows: Iterator[tuple], limit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= limit:
            yield _arrow(held, schema)
            held = []
    if held:
        yield _arrow(held, schema)


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of batches, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield from zip(*[part.column(n).to_pylist() for n in names], strict=True)


def _whole(conv: Any, rows: list[tuple], edits: bool) -> tuple:
    """The result of a conversation that lies whole in this task."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = cheapest([(r[:1], f) for (_, r, _), f in zip(rows, faults, strict=True)], START, {q: INSERT * n for q, n in enumerate(TAIL)})
    audit += "I" * TAIL[_end(rows, audit)]
    done = applied(rows, audit)
    sha = hashlib.sha256(b"\n".join(line(r, t) for _, _, r, t in done if r is not None)).hexdigest()
    return (conv, None, *Facts.of(rows, faults).counts(), cost, audit, sha, [dict(zip(("edit", "turn", "role", "text"), d, strict=True)) for d in done] if edits else None, None)


def _end(rows: list[tuple], audit: str, state: int = START) -> int:
    """The state after an audit."""
    left = iter(rows)
    for edit in audit:
        role = next(left)[1] if edit != "I" else ""
        state = state if edit == "D" else STEP[state, role[:1]] if edit == "K" else NEXT[state]
    return state


def _first_pass(segment: int, edits: bool, schema: pa.Schema):
    """Results of short conversations that lie whole in this task; segments of all others."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 32
        conv, rows, size, whole, any_ = None, [], 0, False, False
        for key, turn, role, text in _columns(batches, "conv_id", "turn", "role", "text"):
            if not any_ or key != conv:
                if rows and whole:
                    yield _whole(conv, rows, edits)
                elif rows:
                    yield _part(conv, number, rows)
                    number += 1
                conv, rows, size, whole, any_ = key, [], 0, any_, True  # what precedes the first may lie elsewhere
            elif len(rows) >= segment or size >= SEGMENT_BYTES:
                yield _part(conv, number, rows)
                number, rows, size, whole = number + 1, [], 0, False
            rows.append((turn, role, text))
            size += len(text)
        if rows:  # what follows the last may lie elsewhere
            yield _part(conv, number, rows)

    def _part(conv: Any, number: int, rows: list[tuple]) -> tuple:
        return (conv, number, *[None] * 9, [dict(zip(("turn", "role", "text"), r, strict=True)) for r in rows])

    return lambda batches: _in_lists(runs(batches), 200, schema)


def _plain(rows: list[dict]) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"]) for r in rows]


def _faults(rows: list[tuple], again: list[int] | None) -> list[int]:
    repeated = set(again or [])
    return [fault(t, k in repeated) for k, (_, _, t) in enumerate(rows)]


def _tables(schema: pa.Schema):
    """Of each segment: its facts, and from each state to each the cheapest cost and the order of its audits."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, number, rows, again in _columns(batches, "conv_id", "segment", "rows", "again"):
            rows = _plain(rows)
            faults = _faults(rows, again)
            short = [(r[:1], f) for (_, r, _), f in zip(rows, faults, strict=True)]
            cost, order = [], []
            for p in range(4):
                found = [cheapest(short, p, {q: 0}) for q in range(4)]
                by = sorted((f[1], q) for q, f in enumerate(found) if f)
                place = {q: k for k, (_, q) in enumerate(by)}
                cost += [f[0] if f else -1 for f in found]
                order += [place.get(q, -1) for q in range(4)]
            yield (conv, number, list(Facts.of(rows, faults)[:8]), list(Facts.of(rows, faults)[8:]), cost, order)

    return lambda batches: _in_lists(one(batches), 500, schema)


def _fold(schema: pa.Schema):
    """The states at the cuts of each conversation, from its segments' tables in order; its last segment has the totals."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, any_ = None, False
        for key, number, numbers, initials, cost, order in _columns(batches, "conv_id", "segment", "facts", "initials", "cost", "place"):
            facts = Facts(*numbers, *initials)
            if not any_ or key != conv:
                if any_:
                    yield from chosen()
                conv, any_, total = key, True, None
                least, rank, came, segments = {START: 0}, {START: 0}, [], []
            total = total.then(facts) if total else facts
            into = {}
            for q in range(4):
                ways = [(least[p] + cost[4 * p + q], rank[p], p) for p in least if cost[4 * p + q] >= 0]
                if ways:
                    into[q] = min(ways)
            by = sorted(into, key=lambda q: (into[q][1], order[4 * into[q][2] + q]))
            least, rank = {q: w[0] for q, w in into.items()}, {q: k for k, q in enumerate(by)}
            came.append(bytes(into[q][2] if q in into else 9 for q in range(4)))
            segments.append(number)

            def chosen(conv=key) -> Iterator[tuple]:
                best, _, q = min((c + INSERT * TAIL[q], rank[q], q) for q, c in least.items())
                for k in range(len(segments) - 1, -1, -1):
                    p, last = came[k][q], k == len(segments) - 1
                    yield (segments[k], p, q, *((TAIL[q], best, *total.counts()) if last else (0, *[None] * 6)))
                    q = p

        if any_:
            yield from chosen()

    return lambda batches: _in_lists(one(batches), 2000, schema)


def _edited(schema: pa.Schema):
    """Each segment's part of the audit and of the repaired conversation."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        names = ("conv_id", "segment", "rows", "again", "from_state", "to_state", "tail")
        for conv, number, rows, again, p, q, tail in _columns(batches, *names):
            rows = _plain(rows)
            short = [(r[:1], f) for (_, r, _), f in zip(rows, _faults(rows, again), strict=True)]
            audit = cheapest(short, p, {q: 0})[1] + "I" * tail
            yield conv, number, audit, [dict(zip(("edit", "turn", "role", "text"), d, strict=True)) for d in applied(rows, audit, p)]

    return lambda batches: _in_lists(one(batches), 50, schema)


def _digest(schema: pa.Schema):
    """Audit and hash of each conversation, its segments coming in order."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, any_, said, sha, lines = None, False, [], None, 0
        for key, audit, edits in _columns(batches, "conv_id", "audit", "edits"):
            if not any_ or key != conv:
                if any_:
                    yield conv, "".join(said), sha.hexdigest()
                conv, any_, said, sha, lines = key, True, [], hashlib.sha256(), 0
            said.append(audit)
            for e in edits:
                if e["role"] is not None:
                    sha.update((b"\n" if lines else b"") + line(e["role"], e["text"]))
                    lines += 1
        if any_:
            yield conv, "".join(said), sha.hexdigest()

    return lambda batches: _in_lists(one(batches), 500, schema)


def _mapped(df: DataFrame, make, schema: str, *more: Any) -> DataFrame:
    from pyspark.sql.types import StructType

    return df.mapInArrow(make(*more, _arrow_schema(StructType.fromDDL(schema))), schema)


def repairs(rows: DataFrame, edits: bool = False, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(results, parts) for rows (conv_id, turn, role, text) without nulls but in conv_id and turn.

    results has one row a conversation: the contract's columns, and with ``edits`` its edits where it was done in one task; parts has the edits
    of the other conversations by segment (conv_id, segment, audit, edits). Turns that tie are taken by role, then
    by the text's XXH64, then by text.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(parts, *order, F.rand(7)).sortWithinPartitions(*order, "text")
    passed = stage(_mapped(ranged, _first_pass, f"conv_id {kind}, segment bigint, {_RESULT}, {_ROWS}", segment, edits), "turns")
    names = ["conv_id", *[c.split()[0] for c in _RESULT.split(", ")[:8]]]
    whole = passed.where("segment is null").select(*names, "edits")

    cut = passed.where("segment is not null").select("conv_id", "segment", "rows")
    turn = cut.select("conv_id", "segment", F.posexplode("rows").alias("k", "r")).select("conv_id", "segment", "k", F.col("r.role").alias("role"), F.sha2("r.text", 256).alias("same"))
    by = W.Window.partitionBy("conv_id", "role", "same").orderBy("segment", "k")
    again = turn.withColumn("n", F.row_number().over(by)).where("n > 1").groupBy("segment").agg(F.collect_list("k").alias("again"))
    cut = stage(cut.join(again, "segment", "left"), "segments")

    tables = _mapped(cut, _tables, f"conv_id {kind}, segment bigint, facts array<bigint>, initials array<string>, cost array<bigint>, place array<int>")
    together = tables.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment")
    numbers = ["cost", *names[1:6]]
    states = stage(_mapped(together, _fold, f"segment bigint, from_state int, to_state int, tail int, {', '.join(f'{n} bigint' for n in numbers)}"), "states")
    edited = stage(_mapped(cut.join(states.select("segment", "from_state", "to_state", "tail"), "segment"), _edited, f"conv_id {kind}, segment bigint, audit string, edits array<struct<{_EDIT}>>"), "edits")
    # the hash of a whole conversation runs along its segments: they stream through one task, which holds none of them
    streamed = edited.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment")
    hashed = _mapped(streamed, _digest, f"conv_id {kind}, audit string, repaired_sha256 string")
    totals = cut.select("segment", "conv_id").join(states.where("cost is not null"), "segment").drop("segment")
    long = hashed.join(totals.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*names)
    return whole.unionByName(long, allowMissingColumns=True), edited


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, edit, turn, role, text, place): the edits that repair each conversation, in order of ``place``; rows with a role are the repaired ones.

    Nulls in role and text count as one space; rows are taken by turn, null first. Conversations may have any size. Rows that
    repeat are duplicates and deleted; an empty table gives an empty result; other columns play no part.
    """
    c = conversations
    rows = c.select(c["conv_id"].alias("conv_id"), c["turn"].cast("long").alias("turn"), *[F.coalesce(c[n], F.lit(" ")).alias(n) for n in ("role", "text")])
    whole, parts = repairs(rows, edits=True)
    short = whole.where("edits is not null").select("conv_id", F.lit(0).cast("long").alias("segment"), F.posexplode("edits").alias("k", "e"))
    long = parts.select("conv_id", "segment", F.posexplode("edits").alias("k", "e"))
    place = F.struct("segment", "k").alias("place")
    return short.unionByName(long).select("conv_id", "e.*", place)


def repair_damaged(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conv_id, null among them.

    Rows are damaged first. Nulls in role and text are one space; turns that tie are taken by role, then by text's hash;
    conversations of which no row is left have zeros, an empty audit and the hash of nothing.
    """
    found, _ = repairs(damaged(conversations), segment=segment)
    c = conversations
    ids = c.select(c["conv_id"].alias("conv_id"), F.concat_ws(":", *[F.coalesce(c[n].cast("string"), F.lit(" ")) for n in ("conv_id", "turn")]).alias("_k"))
    gone = ids.groupBy("conv_id").agg(F.max(F.pmod(F.crc32("_k"), F.lit(20))).alias("_most")).where("_most = 0")
    zeros = [F.lit(0).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = gone.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return found.drop("edits").unionByName(none)
