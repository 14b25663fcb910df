"""The repair of conversations against a search over all edits, and in stretches against whole ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from walkspark.llm import conversations, oracles

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def _cheapest(rows):
    """Dijkstra over (row, state) with (cost, labels) as weights; rows: (initial, fault)."""
    import heapq

    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, labels, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, labels
        if (i, q, labels) in done:
            continue
        done.add((i, q, labels))
        wanted = "a" if q == 2 else "u"
        to = 3 if q == 2 else 2
        if labels.count("I") < len(rows) + 3:
            heapq.heappush(heap, (cost + 3, labels + "I", i, to))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, labels + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more + 3, labels + "R", i + 1, to))
                if initial == wanted:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, to))
                if initial == "s" and q == 0:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, 1))


def _plain(table):
    out, talks = [], defaultdict(list)
    for c, t, role, text in table:
        talks[c].append((t, role if role is not None else " ", text if text is not None else " "))
    for c, rows in talks.items():
        made = []
        for t, role, text in rows:
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            made += [(t, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in made:
            said = text.strip(BLANK)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in made]
        cost, audit = _cheapest(list(zip(initials, faults)))
        turns = {t for t, _, _ in made if t is not None}
        state, lines, at = 0, [], iter(made)
        for x in audit:
            role, text = next(at)[1:] if x != "I" else ("", "")
            if x == "D":
                continue
            role = role if x == "K" else ("assistant" if state == 2 else "user")
            state = 1 if role[0] == "s" else 2 if role[0] == "u" else 3
            lines.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def _table():
    rng = random.Random(41)
    texts = ["Hello there.", "And so on", "Why?", "", " \n", None, "Yes!", "No.\x0b", "é ü.", "a" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "s", "User"]
    rows = []
    for c in range(150):
        n = rng.randrange(1, 9)
        for t in range(n):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(roles[:4] if c % 2 else roles), f"{rng.choice(texts[:3])} {rng.randrange(99)}." if rng.random() < 0.7 else rng.choice(texts)))
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(30)]
    rows += [(901, None, rng.choice(roles), rng.choice(texts)) for _ in range(8)] + [(None, t, rng.choice(roles), f"t{t}.") for t in (None, 3, 3, -2)]
    rows += rows[:6] + [(902, 5, "user", "Same text.")] * 9  # repeated rows
    return rows


@pytest.mark.parametrize("most", [4096, 3, 1])
def test_repair_equals_a_search(spark, most):
    rows = _table()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "key", "h", "n", "fault", "audit", "cost")})
    got = conversations.repair(df, most=most)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == _plain(rows)


def test_sql_says_the_same(spark):
    rows = _table()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert Counter(con.execute(oracles.conversations()).fetchall()) == _plain(rows)


def test_one_long_conversation_is_spread(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Text {t}{'.' if t % 5 else ''}") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r["conv_id"]: r for r in conversations.repair(df, characters=2000).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    whole = {r["conv_id"]: r for r in conversations.repair(df).collect()}
    assert got == whole and len(got) == 2 and got[1]["audit"].replace("I", "").__len__() > 2500


def test_repair_of_nothing(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = conversations.repair(spark.createDataFrame([(7, gone, "user", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_tables_compose_as_rows_do():
    rng = random.Random(43)
    for _ in range(200):
        rows = [(rng.choice("uasx"), rng.choice(["", "", "blank", "truncated", "duplicate"])) for _ in range(rng.randrange(0, 12))]
        cut = sorted(rng.randrange(len(rows) + 1) for _ in range(2))
        pieces = [rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]]
        assert conversations.joined([conversations.through(p) for p in pieces])[:2] == conversations.whole(rows) == _cheapest(rows)
