"""Conversation repair against an exhaustive search over edits, its SQL, and itself in ranges."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from veridex.llm import conversations, queries_turns

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def search(rows):
    """The cheapest edits of (turn, role, text) rows in order, by trying all in the order of cost, then initials."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    heap, n = [(0, "", 0, ())], len(rows)
    while True:
        cost, audit, at, out = heapq.heappop(heap)
        if at == n and re.fullmatch("(s?(ua)+)?", "".join(turn[0][:1] or "-" for turn in out)):
            break
        if len(out) < n + 3:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", at, (*out, (role, ""))))
        if at < n:
            _, role, text = rows[at]
            more = 3 if faults[at] == "t" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out))
            if faults[at] in ("", "t"):
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, (*out, (new, text))))
    first = [role[:1] or "-" for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    held = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(held) - min(held) + 1 - len(held) if held else 0
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute(rows):
    by_id = {row[0]: [] for row in rows}
    for conv, *rest in damage(rows):
        by_id[conv].append(tuple(rest))
    return sorted(((conv, *search(in_order(own))) for conv, own in by_id.items()), key=str)


def some(rng, n, ids):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["a.", "b", "c! ", " ", "d.\n", "é?", None, ""]
    return [(rng.choice(ids), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_edits_are_the_cheapest_and_least(spark):
    rng = random.Random(5)
    for _ in range(1500):
        rows = in_order([(t, r or " ", x or " ") for _, t, r, x in some(rng, rng.randrange(5), [1])])
        assert conversations.repair_one(*([row[i] for row in rows] for i in range(3))) == search(rows), rows


@pytest.mark.parametrize("block", [4096, 2])
def test_whole_tables_equal_the_search(spark, block):
    rng = random.Random(6)
    rows = some(rng, 90, [*range(30), None]) + [(500, 3, "user", "same.")] * 3
    gone = next(i for i in range(1000, 2000) if not damage([(i, 0, "user", "a.")]))
    rows += [(gone, 0, "user", "a.")]
    frame = spark.createDataFrame([(*row, "x") for row in rows], SCHEMA).repartition(5)
    got = conversations.repair_conversations(frame, block=block)
    assert got.columns == COLUMNS
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == brute(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found


def test_a_long_conversation_in_ranges_equals_itself_in_one_row(spark):
    rng = random.Random(7)
    rows = [(i % 2, rng.choice([None, *range(200)]), rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b", " "]) + str(rng.randrange(90))) for i in range(1200)]
    rows += [(0, 77, "user", "again and again.")] * 300
    frame = spark.createDataFrame([(*row, "x") for row in rows], SCHEMA).repartition(4)
    one, many = (sorted(map(tuple, conversations.repair_conversations(frame, block=n).collect())) for n in (4096, 10))
    assert one == many and len(one) == 2


def test_an_empty_table(spark):
    got = conversations.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert got.columns == COLUMNS and got.count() == 0


def test_op12_equals_its_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = some(rng, 300, [*range(80), None])
    spark.createDataFrame([(*row, "x") for row in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(queries_turns.ORACLES["op12_conversation_repair"])
    order = [[c[0] for c in found.description].index(c) for c in COLUMNS]
    want = sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=str)
    got = queries_turns.op12_conversation_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == COLUMNS
