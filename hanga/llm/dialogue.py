"""Conversation structure repair by Knuth's lightest derivation.

A conversation is its rows by turn (nulls first; rows of one turn by role, then
text). Each row's first fault counts: blank (no character other than
``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (the
last such character is not ``[.!?]``). A script of edits turns it into
``(system? (user assistant)+)?``, judged by the roles' initials: Keep a row (0),
Rerole it to user or assistant (1), Delete it (2; required for blank and
duplicate rows), Insert an empty user or assistant row anywhere (5); a truncated
row that is not deleted adds 5. The cheapest script is taken; of several, the
one whose audit (the initials of its edits in order) is least in ASCII.

Method. ``Rest(i, q)`` is the item "the rows from i on can be finished, where
the grammar stands at q". The axioms are the ends the grammar accepts. An edit
deduces ``Rest(i, p)`` from ``Rest(i, q)`` or ``Rest(i + 1, q)`` with its cost,
and puts its initial before the audit. The agenda pops items by (cost, rows
consumed, first initial): an edit of no cost consumes a row and one that
consumes none has a cost, so every deduction is superior and the first pop of an
item is final. Different edits of equal cost differ in their initial, so the
initial alone decides ties. The search ends when the goal ``Rest(0, start)`` is
popped.

Scale. Conversations are grouped by one shuffle. One with more rows or bytes
than ``BIG`` never comes into one task: its rows are range-partitioned by turn
and cut into segments, a lightest derivation per segment gives the cheapest way
from each state to each state, and per conversation only those 4 x 4 tables are
joined (a segment's script never ends in an insert, so that two scripts of one
segment never are equal or one the beginning of the other, and their rank among
each other decides ties across segments). Duplicates are found within a segment,
and across segments by the first segment of every (role, text). Only the SHA-256
of a conversation is sequential by nature: it reads the sorted rows as a stream.

Defined results: a null role or text reads as one space; a role without a first
character has the initial space, which no row can keep; null ids are one
conversation; rows with ``present`` false are known to be lost and only name
their conversation; one without rows left has zeros, an empty audit and the hash
of the empty string. Repeated rows are duplicates. Empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, slices, small_side

BIG_ROWS, BIG_BYTES = 10_000, 32 * 1024 * 1024      # per conversation held by one task
SEGMENT_ROWS, SEGMENT_BYTES = 4_096, 8 * 1024 * 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)           # what was read last
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
# state -> (initial, state before) of the moves that lead to it
_INTO = {START: (), SYSTEM: (("s", START),),
         USER: (("u", START), ("u", SYSTEM), ("u", ASSISTANT)), ASSISTANT: (("a", USER),)}
_ROLE = {USER: "user", ASSISTANT: "assistant"}

Row = tuple[str, str]                               # role, text


def fault(text: str) -> str | None:
    body = text.rstrip(BLANKS)
    return "blank" if not body else None if body[-1] in ".!?" else "truncated"


def faults(rows: list[Row]) -> list[str | None]:
    seen: set[Row] = set()
    out = []
    for row in rows:
        own = fault(row[1])
        out.append(own if own == "blank" else "duplicate" if row in seen else own)
        seen.add(row)
    return out


def initial(role: str) -> str:
    return role[:1] or " "


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False))


def lightest(initials: list[str], found: list[str | None], ends: tuple[int, ...], goal: int | None = START,
             insert_at_end: bool = True) -> dict[int, tuple[int, str, list[int]]]:
    """Cheapest scripts over the rows from each start state (or from ``goal``
    alone) to one of ``ends``: {state: (cost, audit, state after each edit)}."""
    n = len(initials)
    agenda = [(0, 0, "", n, q, -1) for q in ends]
    final: dict[tuple[int, int], tuple[int, str, int]] = {}
    while agenda:
        cost, used, letter, i, q, after = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = (cost, letter, after)
        if i == 0 and q == goal:
            break
        moves = _INTO[q]
        if i < n or insert_at_end:
            for symbol, p in moves:
                if symbol != "s":
                    heapq.heappush(agenda, (cost + INSERT, used, "I", i, p, q))
        if i:
            row, why = initials[i - 1], found[i - 1]
            heapq.heappush(agenda, (cost + DELETE, used + 1, "D", i - 1, q, q))
            if why not in ("blank", "duplicate"):
                more = cost + (TRUNCATED if why == "truncated" else 0)
                for symbol, p in moves:
                    if symbol == row:
                        heapq.heappush(agenda, (more + KEEP, used + 1, "K", i - 1, p, q))
                    if symbol != "s":
                        heapq.heappush(agenda, (more + REROLE, used + 1, "R", i - 1, p, q))
    out = {}
    for start in STATES if goal is None else (goal,):
        if (0, start) in final:
            i, q, audit, states = 0, start, [], []
            while final[i, q][1]:
                _, letter, after = final[i, q]
                audit.append(letter)
                states.append(after)
                i, q = i + (letter != "I"), after
            out[start] = (final[0, start][0], "".join(audit), states)
    return out


def apply_edits(rows: list[Row], audit: str, states: list[int]) -> list[Row]:
    out, left = [], iter(rows)
    for letter, state in zip(audit, states, strict=True):
        role, text = (None, "") if letter == "I" else next(left)
        if letter != "D":
            out.append((role if letter == "K" else _ROLE[state], text))
    return out


def _digest_line(row: Row, first: bool) -> bytes:
    return (("" if first else "\n") + f"{row[0]}:{row[1]}").encode("utf-8", "surrogatepass")


SUMMARY = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
_COUNTED = ("blank", "duplicate", "truncated")


def _turn_order(turn: int | None) -> tuple[bool, int]:
    return turn is not None, turn or 0


def repair_one(turns: list[int | None], rows: list[Row]) -> tuple[tuple, list[Row]]:
    """(summary, repaired rows) of one conversation, its rows in any order."""
    at = sorted(range(len(rows)), key=lambda i: (_turn_order(turns[i]), rows[i]))
    rows = [rows[i] for i in at]
    known = {t for t in turns if t is not None}
    found, initials = faults(rows), [initial(r) for r, _ in rows]
    cost, audit, states = lightest(initials, found, ENDS)[START]
    repaired = apply_edits(rows, audit, states)
    sha = hashlib.sha256()
    for i, row in enumerate(repaired):
        sha.update(_digest_line(row, not i))
    return (max(known) - min(known) + 1 - len(known) if known else 0, *[found.count(w) for w in _COUNTED],
            illegal_pairs(initials), cost, audit, sha.hexdigest()), repaired


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                       *[F.when(there, F.coalesce(F.col(c), F.lit(" "))).alias(name)
                         for c, name in ((role, "role"), (text, "text"))], there.alias("present"))


def _big(rows: DataFrame, big_rows: int, big_bytes: int) -> DataFrame:
    """(big): ids of the conversations that no task may hold whole; each has
    more than ``big_rows`` rows or ``big_bytes`` bytes, which bounds their number."""
    return (rows.groupBy(F.col("conv").alias("big"))
            .agg(F.count("*").alias("n"),
                 F.coalesce(F.sum(F.octet_length("text") + F.octet_length("role")), F.lit(0)).alias("b"))
            .where((F.col("n") > big_rows) | (F.col("b") > big_bytes)).select("big", F.lit(True).alias("found")))


def _small(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        keep = t.filter(t.column("present"))
        summary, repaired = repair_one(keep.column("turn").to_pylist(), list(
            zip(keep.column("role").to_pylist(), keep.column("text").to_pylist(), strict=True)))
        listed = pa.array([[{"role": r, "text": x} for r, x in repaired]],
                          pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
        return pa.Table.from_arrays([t.column("conv").slice(0, 1), *[pa.array([v]) for v in summary], listed],
                                    names=["conv", *[c.split()[0] for c in SUMMARY.split(", ")], "repaired"])

    return rows.groupBy("conv").applyInArrow(
        run, f"conv {kind}, {SUMMARY}, repaired array<struct<role:string,text:string>>")


# --- conversations too large for one task ---------------------------------------

def _segments(rows: DataFrame, segment_rows: int, segment_bytes: int) -> DataFrame:
    """The rows in order, with their segment (numbers ascend over the whole
    table), place, own fault, and whether the row repeats one of its segment."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, place, size = TaskContext.get().partitionId() << 32, -1, 0, 0
        now: object = batches       # no conversation equals it
        seen: set[bytes] = set()
        for b in slices(batches):
            out = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if number < 0 or conv != now or place >= segment_rows or size >= segment_bytes:
                    number, place, size, now = number + 1, 0, 0, conv
                    seen.clear()
                h = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
                out.append((base + number, place, h, h in seen, fault(text)))
                seen.add(h)
                place, size = place + 1, size + len(role) + len(text)
            more = [pa.array(c, t) for c, t in zip(
                zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *more], names=["conv", "turn", "role", "text", "seg", "place", "h", "again", "own"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ("conv", "turn", "role", "text")     # ascending puts nulls first
    dealt = rows.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, f"conv {kind}, turn long, role string, text string, seg long, "
                                 "place int, h binary, again boolean, own string")


def _flagged(t: pa.Table, later: pa.Table) -> tuple[list[str], list[str | None], list[Row]]:
    """Rows of one segment in order: initials, faults, rows. ``later`` has the
    hashes that an earlier segment of the conversation holds."""
    t = t.sort_by("place")
    known = set(later.column("h").to_pylist())
    rows = list(zip(t.column("role").to_pylist(), t.column("text").to_pylist(), strict=True))
    found = [own if own == "blank" else "duplicate" if again or h in known else own
             for own, again, h in zip(*(t.column(c).to_pylist() for c in ("own", "again", "h")), strict=True)]
    return [initial(r) for r, _ in rows], found, rows


def _ways(kind: str):
    """Per segment: the cheapest cost from each state to each (null: none), the
    rank of its audit among those from the same state, counts and end initials."""
    def run(rows: pa.Table, later: pa.Table) -> pa.Table:
        initials, found, _ = _flagged(rows, later)
        ways = {q: lightest(initials, found, (q,), None, False) for q in STATES}
        costs, ranks = [], []
        for p in STATES:
            order = sorted(q for q in STATES if p in ways[q])
            order.sort(key=lambda q: ways[q][p][1])
            costs += [ways[q][p][0] if p in ways[q] else None for q in STATES]
            ranks += [order.index(q) if q in order else None for q in STATES]
        return pa.Table.from_arrays(
            [rows.column("conv").slice(0, 1), rows.column("seg").slice(0, 1), pa.array([costs], pa.list_(pa.int64())),
             pa.array([ranks], pa.list_(pa.int32())), *[pa.array([found.count(w)]) for w in _COUNTED],
             pa.array([illegal_pairs(initials)]), pa.array([initials[0]]), pa.array([initials[-1]])],
            names=["conv", "seg", "costs", "ranks", *_COUNTED, "illegal", "first", "last"])
    schema = (f"conv {kind}, seg long, costs array<long>, ranks array<int>, blank long, duplicate long, "
              "truncated long, illegal long, first string, last string")
    return run, schema


def _route(kind: str):
    """Per conversation: joins its segments' tables from the last to the first,
    and gives each segment its start and end state."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg")
        n = t.num_rows
        costs, ranks = t.column("costs").to_pylist(), t.column("ranks").to_pylist()
        # the end of the conversation as scripts of their own: inserts only
        rest = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}
        tails = {q: audit for q, (_, audit) in rest.items()}
        total = {q: cost for q, (cost, _) in rest.items()}
        chosen = []
        for c, r in zip(reversed(costs), reversed(ranks), strict=True):
            best = {p: min(((c[4 * p + q] + total[q], r[4 * p + q], q) for q in STATES
                            if c[4 * p + q] is not None), default=None) for p in STATES}
            chosen.append({p: b[2] for p, b in best.items() if b})
            total = {p: b[0] for p, b in best.items() if b}
        chosen.reverse()
        starts, ends, state = [], [], START
        for way in chosen:
            starts.append(state)
            state = way[state]
            ends.append(state)
        last = [None, *t.column("last").to_pylist()[:-1]]
        illegal = [i + (b is not None and b + a not in LEGAL_PAIRS) for i, a, b in zip(
            t.column("illegal").to_pylist(), t.column("first").to_pylist(), last, strict=True)]
        return pa.Table.from_arrays(
            [t.column("conv"), t.column("seg"), *[t.column(c) for c in _COUNTED], pa.array(illegal),
             pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
             pa.array([total[START]] + [0] * (n - 1)), pa.array([""] * (n - 1) + [tails[state]])],
            names=["conv", "seg", *_COUNTED, "illegal", "begin", "end", "cost", "tail"])
    schema = (f"conv {kind}, seg long, blank long, duplicate long, truncated long, illegal long, "
              "begin int, end int, cost long, tail string")
    return run, schema


def _edited(kind: str):
    """Per segment: its audit (with the inserts after the last segment) and
    repaired rows, from the states that the route gives it."""
    def run(rows: pa.Table, route: pa.Table) -> pa.Table:
        initials, found, listed = _flagged(rows, route)
        r = route.slice(0, 1).to_pylist()[0]
        _, audit, states = lightest(initials, found, (r["end"],), r["begin"], False)[r["begin"]]
        state = r["end"]
        for _ in r["tail"]:
            state = ASSISTANT if state == USER else USER
            states.append(state)
        out = apply_edits(listed, audit + r["tail"], states)
        # the audit travels on the first row; a segment without rows left has one
        roles, texts = [x for x, _ in out] or [None], [x for _, x in out] or [None]
        n = len(roles)
        conv = rows.column("conv").combine_chunks()
        conv = (conv.chunk(0) if isinstance(conv, pa.ChunkedArray) else conv).take(pa.array([0] * n))
        return pa.Table.from_arrays(
            [conv, pa.array([r["seg"]] * n), pa.array(range(n), pa.int32()), pa.array(roles, pa.string()),
             pa.array(texts, pa.string()), pa.array([audit + r["tail"]] + [None] * (n - 1), pa.string())],
            names=["conv", "seg", "place", "role", "text", "audit"])
    return run, f"conv {kind}, seg long, place int, role string, text string, audit string"


def _digest(edited: DataFrame, kind: str) -> DataFrame:
    """(conv, sha): rows come in order, a batch at a time; only the running
    hash of one conversation is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, sha, first = object(), None, None, True

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array([sha.hexdigest()])], names=["conv", "sha"])
        for b in slices(batches):
            for i, (conv, role, text) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                if sha is None or conv != now:
                    if sha is not None:
                        yield closed()
                    now, key, sha, first = conv, b.column(0).slice(i, 1), hashlib.sha256(), True
                if role is not None:
                    sha.update(_digest_line((role, text), first))
                    first = False
        if sha is not None:
            yield closed()

    ordered = edited.repartition("conv").sortWithinPartitions("conv", "seg", "place")
    return ordered.select("conv", "role", "text").mapInArrow(run, f"conv {kind}, sha string")


def _large(rows: DataFrame, big: DataFrame, segment_rows: int, segment_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(summaries, repaired rows) of the conversations ``big``, in segments."""
    kind = rows.schema["conv"].dataType.simpleString()
    cut = shared_table(_segments(rows.where("present"), segment_rows, segment_bytes), "segments")
    fresh = cut.where(~F.col("again")).select("conv", "h", "seg")      # one per segment and (role, text)
    first = fresh.groupBy(F.col("conv").alias("c"), F.col("h").alias("x")).agg(F.min("seg").alias("seg0"))
    later = fresh.join(first, fresh["conv"].eqNullSafe(F.col("c")) & (fresh["h"] == F.col("x"))).where(
        "seg > seg0").select("conv", "seg", "h")
    later = shared_table(later, "later")
    run, schema = _ways(kind)
    ways = cut.groupBy("conv", "seg").cogroup(later.groupBy("conv", "seg")).applyInArrow(run, schema)
    run, schema = _route(kind)
    route = shared_table(ways.groupBy("conv").applyInArrow(run, schema), "route")
    # the hashes of a segment travel with its route; a segment without any has one row
    known = route.select("conv", "seg", "begin", "end", "tail", F.lit(None).cast("binary").alias("h")).unionByName(
        later.join(route.select("seg", "begin", "end", "tail"), "seg")
        .select("conv", "seg", "begin", "end", "tail", "h"))
    run, schema = _edited(kind)
    edited = shared_table(
        cut.groupBy("conv", "seg").cogroup(known.groupBy("conv", "seg")).applyInArrow(run, schema), "edited")
    turns = cut.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    sums = route.groupBy(F.col("conv").alias("c1")).agg(*[F.sum(c).alias(c) for c in (*_COUNTED, "illegal", "cost")])
    audits = (edited.where("audit is not null").groupBy(F.col("conv").alias("c2"))
              .agg(F.array_sort(F.collect_list(F.struct("seg", "audit"))).alias("a"))
              .select("c2", F.concat_ws("", F.col("a.audit")).alias("audit")))
    digest = _digest(edited, kind).select(F.col("conv").alias("c3"), F.col("sha").alias("repaired_sha256"))
    out = big.select(F.col("big").alias("conv"))     # one without rows left has no segment
    for part in (turns.withColumnRenamed("conv", "c0"), sums, audits, digest):
        out = out.join(part, F.col("conv").eqNullSafe(F.col(part.columns[0])), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    return (out.select("conv", *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in names]),
            edited.where("role is not null").select("conv", "seg", "place", "role", "text"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: Column | None = None, big_rows: int = BIG_ROWS, big_bytes: int = BIG_BYTES,
           segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES
           ) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired rows).

    Conversations: the id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. Repaired rows: the id, seg and place (their order),
    role, text."""
    kept = _prepared(rows, conv, turn, role, text, present)
    big = shared_table(_big(kept, big_rows, big_bytes), "big")
    n_big = big.count()
    if n_big:
        joined = kept.join(small_side(big, n_big, 32), kept["conv"].eqNullSafe(F.col("big")), "left").drop("big")
        small, large = joined.where("found is null").drop("found"), joined.where("found").drop("found")
    else:
        small, large = kept, None
    done = _small(small)
    summaries, repaired = done.drop("repaired"), done.select(
        "conv", F.lit(0).cast("long").alias("seg"), F.posexplode("repaired").alias("place", "r")).select(
        "conv", "seg", "place", "r.role", "r.text")
    if large is not None:
        more, edited = _large(large, big, segment_rows, segment_bytes)
        summaries, repaired = summaries.unionByName(more), repaired.unionByName(edited)
    return summaries.withColumnRenamed("conv", conv), repaired.withColumnRenamed("conv", conv)
