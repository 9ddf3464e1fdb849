"""Conversation repair: alignment against a plain search, whole tables against a plain version, odd rows, long conversations."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from graphloom.llm import queries, turns


def plain(classes):
    """Least (cost, audit) over all ways through the grammar's states, row by row."""
    never, now = (1 << 60, ""), {0: (0, "")}

    def inserted(ways):
        for _ in range(3):
            more = dict(ways)
            for s, (cost, audit) in ways.items():
                t = 3 if s == 2 else 2
                more[t] = min(more.get(t, never), (cost + 3, audit + "I"))
            ways = more
        return ways

    for c in classes:
        then = {}
        for s, (cost, audit) in inserted(now).items():
            own, wanted, t = 3 * c.isupper(), "a" if s == 2 else "u", 3 if s == 2 else 2
            steps = [(s, 4, "D")]
            if c != "x":
                steps += [(t, own + 3, "R")] + [(t, own, "K")] * (c.lower() == wanted) + [(1, own, "K")] * (c.lower() == "s" and s == 0)
            for to, price, op in steps:
                then[to] = min(then.get(to, never), (cost + price, audit + op))
        now = then
    return min(v for s, v in inserted(now).items() if s in (0, 3))


def searched(classes):
    """The same by going through every audit."""
    best = [(1 << 60, "")]

    def go(i, s, cost, audit, k):
        if cost > best[0][0]:
            return
        if i == len(classes) and s in (0, 3):
            best[0] = min(best[0], (cost, audit))
        t, wanted = (3, "a") if s == 2 else (2, "u")
        if k < 2:
            go(i, t, cost + 3, audit + "I", k + 1)
        if i < len(classes):
            c = classes[i]
            go(i + 1, s, cost + 4, audit + "D", k)
            own = 3 * c.isupper()
            if c != "x":
                if c.lower() == "s" and s == 0:
                    go(i + 1, 1, cost + own, audit + "K", 0)
                go(i + 1, t, cost + own + 3 * (c.lower() != wanted), audit + ("K" if c.lower() == wanted else "R"), 0)

    go(0, 0, 0, "", 0)
    return best[0]


def folded(classes, segment):
    fold = turns.Fold()
    for i in range(0, len(classes), segment):
        part = turns.Part(classes[i : i + segment])
        part.roles = part.texts = ["t"] * sum(c != "x" for c in part.classes)
        fold.add(part)
    return fold.result()[5:7]


def test_every_short_row_of_classes():
    for n in range(4):
        for classes in map("".join, itertools.product("suaoxSUAO", repeat=n)):
            want = searched(classes)
            assert plain(classes) == want
            assert all(folded(classes, k) == want for k in (1, 2, 32)), classes


@pytest.mark.parametrize("letters", ["ua", "uaUA", "suaoxSUAO", "oO", "xs", "uuua", "sss", "uauauauax"])
def test_long_rows_of_classes_in_segments(letters):
    rnd = random.Random(letters)
    for n in (5, 31, 33, 64, 130):
        classes = "".join(rnd.choice(letters) for _ in range(n))
        assert all(folded(classes, k) == plain(classes) for k in (1, 7, 32)), classes


SPACE = " \t\n\x0b\x0c\r"


def repaired(rows):
    """The result for the rows of one conversation, each (turn, role, text), copies apart."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, classes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        classes += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = plain(classes)
    out, i, state = [], 0, ""
    for op in audit:
        role = "assistant" if state == "u" else "user"
        if op == "I":
            out.append(f"{role}:")
            state = role[0]
            continue
        if op != "D":
            name = rows[i][1] if op == "K" else role
            out.append(f"{name}:{rows[i][2]}")
            state = name[0]
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    known = {r[0] for r in rows if r[0] is not None}
    return (max(known) - min(known) + 1 - len(known) if known else 0, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check(spark, rows, **options):
    """rows: (conv, turn, role, text); against the plain version."""
    got = {r[0]: tuple(r)[1:] for r in turns.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **options).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {k: repaired(v) for k, v in by.items()}


def made(rnd, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Ärger", "s", "unknown"]
    texts = ["Hi.", "What?", "no end", "", " \n", None, "ok!\n ", "é.", "…", "x" * 300 + "."]
    return [(conv, rnd.choice([None, k, k, k, k // 2, k + 3]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {k}.") for k in range(n)]


def test_rows_of_all_kinds(spark):
    rnd = random.Random(3)
    rows = [r for conv in [None, *range(60)] for r in made(rnd, conv, rnd.randint(1, 12))]
    rows += rows[:40]  # repeated rows
    check(spark, rows)
    check(spark, rows, segment=3)


def test_one_conversation_holds_most_rows(spark):
    """It lies in many partitions and segments, and so do its neighbours' ends."""
    rnd = random.Random(4)
    rows = [r for conv in range(20) for r in made(rnd, conv, 6)] + made(rnd, 7, 900) + [(9, 1, "user", "Again.")] * 500 + [(11, None, "user", f"{k}.") for k in range(200)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows, segment=5)
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_conversations_without_rows_extra_columns_and_an_empty_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 5, "user", "a.", 0, "x"), (1, 6, "user", "b.", 0, "y"), (None, 1, "user", "c.", 0, "z"), (2, 1, "user", "d.", 1, "z")], "conv_id long, turn long, role string, text string, copies int, part string")
    got = {r[0]: tuple(r)[1:] for r in turns.repair_conversations(rows, copies=F.col("copies")).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: none, None: none, 2: repaired([(1, "user", "d.")])}
    assert got[2][5:7] == (3, "KI")
    assert turns.repair_conversations(rows.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op13_turns(spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = db.execute(queries.ORACLES["op13_turns"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
