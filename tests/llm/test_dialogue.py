import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from hanga.llm import dialogue as X
from hanga.llm.queries import damaged

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, seg int, h int, big string, conv int, present string"
LEGAL = re.compile(r"(s?(ua)+)?")


def scripts(rows, found, limit):
    """All edit scripts up to a cost, by brute force over every row's edit and
    up to two inserts at every place: (cost, audit, repaired rows)."""
    def row_edits(row, why):
        yield 2, "D", None
        if why not in ("blank", "duplicate"):
            more = 5 if why == "truncated" else 0
            yield more, "K", row
            for role in ("user", "assistant"):
                yield more + 1, "R", (role, row[1])
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for picks in product(*[list(row_edits(r, w)) for r, w in zip(rows, found, strict=True)]):
        base = sum(p[0] for p in picks)
        if base > limit:
            continue
        for added in product(gaps, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, added))
            if cost > limit:
                continue
            audit, out = "", []
            for i in range(len(rows) + 1):
                audit += "I" * len(added[i])
                out += [(role, "") for role in added[i]]
                if i < len(rows):
                    audit += picks[i][1]
                    out += [picks[i][2]] if picks[i][2] else []
            if LEGAL.fullmatch("".join((r[:1] or " ") for r, _ in out)):
                yield cost, audit, out


def slow_faults(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        body = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        out.append("blank" if not body else "duplicate" if (role, text) in rows[:i]
                   else "truncated" if body[-1] not in ".!?" else None)
    return out


def slow(turns, rows):
    at = sorted(range(len(rows)), key=lambda i: (turns[i] is not None, turns[i] or 0, *rows[i]))
    rows = [rows[i] for i in at]
    found = slow_faults(rows)
    cost, audit, out = min(scripts(rows, found, 2 * len(rows)), key=lambda x: x[:2])   # deleting all costs 2 each
    known = [t for t in turns if t is not None]
    initials = [(r[:1] or " ") for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, found.count("blank"),
            found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest()), out


ROLES = ["system", "user", "assistant", "tool", "", "User"]
TEXTS = ["Yes.", "No", " ", "", "Why?\n", "Done!", "é…", "Yes."]


def conversation(rnd, n):
    return ([rnd.choice([None, *range(6)]) for _ in range(n)],
            [(rnd.choice(ROLES[:3] * 3 + ROLES), rnd.choice(TEXTS)) for _ in range(n)])


def test_lightest_scripts_against_brute_force():
    rnd = random.Random(1)
    for n in [0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4] * 4:
        turns, rows = conversation(rnd, n)
        assert X.repair_one(turns, rows) == slow(turns, rows), (turns, rows)


def test_known_repairs():
    u, a, s = ("user", "Hi."), ("assistant", "Ok."), ("system", "Be kind.")
    for rows, cost, audit in [([], 0, ""), ([u, a], 0, "KK"), ([s], 2, "D"), ([u], 2, "D"), ([s, u, a], 0, "KKK"),
                              ([u, a, s], 2, "KKD"), ([u, s, a], 2, "KDK"), ([u, ("user", "x.")], 1, "KR"),
                              ([("user", "x"), a], 4, "DD"), ([("user", "x"), a, u, ("assistant", "b.")], 4, "DDKK")]:
        got = X.repair_one(list(range(len(rows))), rows)
        assert got[0][5:7] == (cost, audit), rows
        assert LEGAL.fullmatch("".join(r[0] for r, _ in got[1]))


def table(spark, convs):
    rows = [(c, t, r, x, 1, 2, "b", 3, "p") for c, (turns, rows) in convs for t, (r, x) in zip(turns, rows, strict=True)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def collected(got):
    summary, repaired = got
    have = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in summary.collect()}
    rows = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["seg"], r["place"])):
        rows.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return have, rows


@pytest.mark.parametrize("big,segment", [(10_000, 4096), (3, 1), (2, 3), (0, 7)])
def test_tables_whole_and_in_segments(spark, big, segment):
    """Conversations cut into segments repair as those held whole."""
    rnd = random.Random(4)
    convs = [(i if i else None, conversation(rnd, rnd.choice([1, 2, 3, 4, 6, 9, 25]))) for i in range(40)]
    have, rows = collected(X.repair(table(spark, convs), big_rows=big, segment_rows=segment))
    want = {c: X.repair_one(*x) for c, x in convs}
    assert have == {c: w[0] for c, w in want.items()}
    assert rows == {c: w[1] for c, w in want.items() if w[1]}


def test_one_large_conversation(spark):
    rnd = random.Random(6)
    turns = list(range(3000))
    rows = [(rnd.choice(ROLES[:3]), rnd.choice([f"Line {i}.", f"line {i % 50}", "Same."])) for i in range(3000)]
    small = (list(range(5)), rows[:5])
    have, out = collected(X.repair(table(spark, [(1, (turns, rows)), (2, small)]), big_rows=1000, segment_rows=64))
    for c, x in ((1, (turns, rows)), (2, small)):
        want = X.repair_one(*x)
        assert have[c] == want[0] and out[c] == want[1]


def test_long_texts_count_as_big(spark):
    x = [0, 1], [("user", "word " * 20_000 + "."), ("assistant", "ok.")]
    have, _ = collected(X.repair(table(spark, [(1, x), (2, ([0], [("user", "a.")]))]), big_bytes=1000,
                                 segment_bytes=500))
    assert have == {1: X.repair_one(*x)[0], 2: X.repair_one([0], [("user", "a.")])[0]}


@pytest.mark.parametrize("big", [10_000, 1])
def test_lost_rows_nulls_and_empty_tables(spark, big):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, 2, None, "x."), (2, 5, "user", "gone"),
            (2, 6, "user", "gone"), (None, None, None, None), (None, 2, "user", "a."), (None, 4, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    have, _ = collected(X.repair(df, present=(F.col("conv_id") != 2) | F.col("conv_id").isNull(), big_rows=big))
    empty = hashlib.sha256(b"").hexdigest()
    assert have[2] == (0, 0, 0, 0, 0, 0, "", empty)
    assert have[1] == X.repair_one([0, 1, 2], [("user", "Hi."), ("assistant", " "), (" ", "x.")])[0]
    assert have[None] == X.repair_one([None, 2, 4], [(" ", " "), ("user", "a."), ("assistant", "b.")])[0]
    assert have[None][0] == 1 and len(have) == 3
    assert collected(X.repair(df.limit(0), big_rows=big)) == ({}, {})


def test_damage(spark):
    import zlib
    rows = [(c, t, r, "Well. Yes! No? end.") for c in range(60) for t in range(3) for r in ("assistant",)]
    rows += [(None, 1, None, None), (7, None, "system", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    have = [tuple(" " if v is None else v for v in r) for r in damaged(df).collect()]
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        c, t, r, x = (" " if v is None else v for v in (c, t, r, x))
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x, k != 0)] * (2 if k == 3 else 1)
    assert sorted(have, key=str) == sorted(want, key=str)
