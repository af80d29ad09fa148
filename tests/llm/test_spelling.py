"""Spelling variants against a plain comparison of all words."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from repurchase.llm import spelling

from .data import EDGES, table


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows):
    vocab = plain_vocabulary(rows)
    out = {}
    for w, n in vocab.items():
        close = [v for v in vocab if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(close, key=lambda v: (-vocab[v], v)) if close else None
        out[w] = [n, len(close), best if best and vocab[best] >= 10 * n else None]
    for row in out.values():
        row.append(vocab[row[2]] if row[2] else None)
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def corpus():
    r = random.Random(5)
    stems = ["".join(r.choice("aelnrsté") for _ in range(r.randint(7, 9))) for _ in range(25)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(60):
            w = r.choice(stems[: 1 + int(25 * r.random() ** 2)])
            if r.random() < 0.25:
                i = r.randrange(len(w))
                w = w[:i] + r.choice(["", "a", "ÿ", "z" + w[i], w[i] * 2]) + w[i + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((d if d % 9 else None, " ".join(words)))
    return [*rows, (3, None), (4, ""), (5, "÷×aaaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaa"), (5, "÷×aaaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaa")]


def rows_of(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("filter_bits", [spelling.FILTER_BITS, 1 << 12])
def test_equals_plain_comparison(spark, filter_bits):
    """Also where the filters need many rounds and lengths are cut."""
    rows = corpus()
    df = table(spark, rows, extra=True)
    got = rows_of(spelling.group_variants(df, filter_bits=filter_bits))
    want = plain_groups(rows)
    assert any(r[2] for r in want.values()) and got == want


def test_forms_lead_to_a_last_root(spark):
    rows = [(1, " ".join(["abcdefgh"] * 400 + ["abcdefgx"] * 30 + ["abcdefyx"] * 2)) for _ in range(1)]
    got = rows_of(spelling.group_variants(table(spark, rows), typo=1 << 40))
    assert got["abcdefyx"][2:] == ("abcdefgx", 30, "abcdefgh") and got["abcdefgx"][2] == "abcdefgh"


def test_edge_rows_and_empty_table(spark):
    assert spelling.group_variants(table(spark, [])).collect() == []
    assert rows_of(spelling.group_variants(table(spark, EDGES, extra=True))) == plain_groups(EDGES)


def test_very_long_words(spark):
    long = "ab" * 600
    rows = [(1, f"{long} {long} {long}c {long}c b{long[1:]} b{long[1:]}")]
    assert rows_of(spelling.group_variants(table(spark, rows), typo=1 << 40))[long][1] == 2


def test_rounds_hold_every_cut_once():
    rounds = spelling.plan_rounds({7: 1000, 8: 3, 64: 90}, filter_bits=4096)
    cuts = sorted((s, cut) for r in rounds for s, (cut, _, _) in r.items())
    assert cuts == sorted([(7, i) for i in range(4)] + [(8, 0), (64, 0)])
    assert all(sum(64 * b for _, _, b in r.values()) <= 4096 for r in rounds)


def test_edit_hashes_are_the_hashes_of_the_edited_words():
    words = ["letters", "lettres", "lletter"]
    m = spelling.letters_of(words)
    full = {7: (0, 1, 1), 6: (0, 1, 1)}
    held = {k: np.full(1, ~np.uint64(0)) for k in full}
    alphabet = np.arange(90, dtype=np.uint8)
    seen = Counter()
    for row, place, letter in spelling._positives(m, full, held, alphabet):
        seen.update(zip(row.tolist(), place.tolist(), letter.tolist(), strict=True))
    assert max(seen.values()) == 1
    assert {(0, 2, -1), (0, 3, -1)} & set(seen) == {(0, 3, -1)}
