"""The prefix trie against a plain trie, its queue and its positions."""

import hashlib
import math
import random
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repurchase.llm import positions, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def tie(role, text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return md5(md5(role) + md5(text))


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    members = {}
    ends = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - int(math.fmod(c, 20)) if abs(c) < 2**53 else c - c % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, who in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(who) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return {(min(w), len(p), min(members[p[:-1]]) if p else None, len(w), kids[p], leaves[p], saved[p], sha(p)) for p, w in members.items()}


def conversations(seed, ids):
    r = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(r.choice([1, 2, 3, 4, 5, 9])):
            rows.append((c, r.choice([t, t, None]) if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d e f"])))
    return rows


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("turn", "turn")
    return [tuple(r) for r in trie.prefix_trie(df, **how).collect()]


@pytest.mark.parametrize("how", [{}, {"ids": 2, "limit": 2}, {"ids": 5}])
def test_equals_plain_trie(spark, how):
    """With shards of two ids and levels, most parents are in other shards."""
    r = random.Random(1)
    ids = [*range(0, 70), *(r.randrange(10**12) for _ in range(15)), 2**62, -1, -25]
    rows = conversations(2, ids)
    rows += [(7, 0, "user", "a b"), (7, 0, "user", "a b"), (None, 0, "user", "x"), (None, None, None, None)]
    made = got(spark, rows, **how)
    assert len(made) == len(set(made)) and set(made) == plain_trie(rows)


def test_a_long_conversation_and_a_hot_group_of_copies(spark):
    rows = [(0, t, "user", f"w {t % 3}") for t in range(150)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(3)]
    assert set(got(spark, rows, ids=16, limit=8)) == plain_trie(rows)


def test_turnless_conversations_and_empty_table(spark):
    ids = [c for c in range(21, 40) if crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, 0, "user", "gone") for c in ids]  # conversation 20 is absent
    assert set(got(spark, rows)) == plain_trie(rows) and len(plain_trie(rows)) == 1
    assert got(spark, []) == []


def test_extra_columns(spark):
    rows = conversations(3, range(25))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'x' as `{c}`" for c in ("pos", "depth", "x", "digest", "c", "inside", "_pos")))
    assert {tuple(r) for r in trie.prefix_trie(df).collect()} == plain_trie(rows)


def test_end_lists_are_hashed_in_chunks(spark):
    rows = spark.range(1000).selectExpr("id % 2 + 1 as depth", "5L as x", "6L as y", "id * 3 as conv_id", "true as ends")
    none = spark.createDataFrame([], "conv_id long, total long")
    for r in trie.end_digests(rows, none, size=7).collect():
        ids = [i * 3 for i in range(1000) if i % 2 + 1 == r["depth"]]
        assert r["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.none()), max_size=300), st.integers(2, 9))
def test_queue_pops_in_order_and_spills(steps, limit):
    """None pops, a number is pushed; never more than ``limit`` own items in memory."""
    queue, plain = trie.SpillingQueue(limit), []
    queue.READ = 3
    for step in steps:
        if step is not None:
            queue.push((step, 0))
            plain.append((step, 0))
        elif plain:
            plain.sort()
            assert queue.peek() == plain[0] and queue.pop() == plain.pop(0)
        assert sum(run < 0 for _, run in queue.heap) <= limit + len(queue.runs)
    plain.sort()
    assert [queue.pop() for _ in plain] == plain and queue.peek() is None
    if len([s for s in steps if s is not None]) == len(steps) > 2 * limit:
        assert queue.spills
    queue.close()


def test_positions_of_a_key_that_spans_tasks(spark):
    rows = spark.range(0, 4000, 1, 7).selectExpr("if(id % 3 = 0, 1L, id % 50) as k", "id as o", "xxhash64(id) as h")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = positions.number_rows(rows, "k", ("o",), ("h",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) == 4000
    run = {}
    for r in sorted(made, key=lambda r: (r["k"], r["o"])):
        pos, x = run.get(r["k"], (0, 0))
        run[r["k"]] = (pos + 1, x ^ r["h"])
        assert (r["_pos"], r["_run_h"]) == (pos, x ^ r["h"])
