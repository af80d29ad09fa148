import collections
import math
import random
import zlib

import numpy as np
import pytest

from repurchase.llm import lm

from .data import prose, table


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def rows():
    r = random.Random(2)
    out = [(i, " ".join(r.choice("a b A c é d, e f g".split()) for _ in range(r.randrange(40)))) for i in range(80)]
    return [*out, (None, None), (None, "a b"), (3, "a b"), (3, "a b"), (500, prose(800, 5))]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(lm, "SHARD_KEYS", 16)


def test_counts_base_and_mixture_match_plain_counting(spark, small, monkeypatch):
    learned = {}
    real = lm.learn_weights

    def keep(cells, count, v):
        learned["w"], learned["n"] = real(cells, count, v), count.sum()
        return learned["w"]

    monkeypatch.setattr(lm, "learn_weights", keep)
    data = rows()
    got = sorted((tuple(r) for r in lm.score_documents(table(spark, data)).collect()), key=str)
    word, pair = collections.Counter(), collections.Counter()
    for d, t in data:
        if not held(d):
            tok = tokens(t)
            word.update(tok)
            pair.update(zip([b"", *tok[:-1]], tok, strict=True))
    n, v = sum(word.values()), len(word)
    assert learned["n"] == n
    want = []
    for d, t in data:
        tok = tokens(t)
        base = sum(math.log10((word[x] + 1) / (n + v + 1)) for x in tok)
        score = 0.0
        for a, b in zip([b"", *tok[:-1]], tok, strict=True):
            w = learned["w"][int(np.frexp(float(word[a]))[1])]
            score += math.log10(w[0] * pair[a, b] / max(1, word[a]) + w[1] * word[b] / n + w[2] / (v + 1))
        want.append((d, held(d), len(tok), sum(word[x] > 0 for x in tok), n, base, score))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_mixture_predicts_better_than_base_on_held_out(spark):
    phrases = [prose(6, 900 + i, 300) for i in range(40)]
    data = [(i, " ".join(random.Random(i).choices(phrases, k=30))) for i in range(120)]
    held_rows = lm.score_documents(table(spark, data)).where("held_out").collect()
    assert held_rows and sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)


def test_weights_find_a_known_mixture():
    r = np.random.default_rng(1)
    cells = (3 * (lm._TOP + 2) + lm._grid(np.array([0.5, 0.0, 0.5, 0.0]))) * (lm._TOP + 2) + lm._grid(np.array([0.01, 0.01, 1e-4, 1e-4]))
    w = lm.learn_weights(cells, r.multinomial(100_000, [0.6, 0.3, 0.05, 0.05]).astype(float), 1000)
    assert w[3].sum() == pytest.approx(1) and w[3, 0] > 0.5 and (w > 0).all()


def test_packing_round_trip():
    for a in (np.array([0, 5, 2**64 - 1, 2**40], np.uint64), np.arange(7, dtype=np.uint32)):
        assert (lm.unpack(lm.pack(a), a.dtype) == a).all()
