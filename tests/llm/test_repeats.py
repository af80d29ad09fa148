import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repurchase.llm import fmindex, repeats, suffix

from .data import prose, table


def covered(data, window):
    count = collections.Counter(x[i : i + window] for x in data for i in range(len(x) - window + 1))
    out = []
    for x in data:
        edge = np.zeros(len(x) + 1, int)
        for i in range(len(x) - window + 1):
            if count[x[i : i + window]] > 1:
                edge[i] += 1
                edge[i + window] -= 1
        out.append(np.cumsum(edge)[: len(x)] > 0)
    return out


def rows():
    r = random.Random(2)
    parts = ["abc " * 120, "x" * 700, prose(80, 5), "é" * 150 + "q" * 120, "é b " * 40 + "q " * 60, "\t\n one two\x0b three "]
    out = [(i, " ".join(r.choice(parts)[r.randrange(200) :][: r.randrange(900)] for _ in range(r.randrange(5)))) for i in range(50)]
    return [*out, (100, None), (100, None), (101, ""), (None, parts[2]), (None, parts[2]), (7, parts[0]), (2**60, parts[2] + "end")]


@pytest.mark.parametrize("hot", [2, 2000])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    data = rows()
    raw = [(t or "").encode() for _, t in data]
    want = []
    for (d, _), x, gone in zip(data, raw, covered(raw, 200), strict=True):
        spans = np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1)
        want.append((d, len(x), gone.sum(), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in suffix.remove_repeats(table(spark, data)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("hot", [2, 2000])
def test_words(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    data = rows()
    raw = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in data]
    want = []
    for (d, _), x, gone in zip(data, raw, covered(raw, 35), strict=True):
        kept = " ".join(w for w, g in zip(x, gone, strict=True) if not g)
        want.append((d, len(x), gone.sum(), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in fmindex.remove_repeats(table(spark, data)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("module", [suffix, fmindex])
def test_every_window_comes_from_the_index(spark, module):
    units = suffix.BYTES if module is suffix else fmindex.WORDS
    _, hits = repeats.repeated(table(spark, rows()), units, lambda pieces, weights, window: np.zeros(len(weights), bool))
    assert hits.count() == 0


@pytest.mark.parametrize("stretch", [1, 40, 1 << 16])
def test_stretches_of_copied_texts(spark, monkeypatch, stretch):
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    text = prose(900, 3)
    data = [(1, text), (2, text), (3, text[50:3000]), (4, "other " + text[3100:] + " end"), (5, prose(300, 4))]
    gone = covered([t.encode() for _, t in data], 200)
    got = {r["doc_id"]: r["n_removed"] for r in suffix.remove_repeats(table(spark, data)).collect()}
    assert got == {d: int(g.sum()) for (d, _), g in zip(data, gone, strict=True)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=4, max_size=12), st.integers(1, 2)), min_size=1, max_size=8))
def test_windows_weigh_as_their_pieces(pieces):
    count = collections.Counter()
    for p, c in pieces:
        for i in range(len(p) - 3):
            count[p[i : i + 4]] += c
    want = [count[p[i : i + 4]] > 1 for p, _ in pieces for i in range(len(p) - 3)]
    weights = np.repeat([c for _, c in pieces], [len(p) - 3 for p, _ in pieces])
    assert suffix.repeated_windows([p.encode() for p, _ in pieces], weights, 4).tolist() == want
    assert fmindex.repeated_windows([" ".join(p).encode() for p, _ in pieces], weights, 4).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array_and_common_prefixes(body):
    t = np.array([*body, 0])
    sa = suffix.suffix_array(t, 258)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    phi, plcp = suffix.common_prefixes(t, sa)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        n = 0
        while t[a + n] == t[b + n]:
            n += 1
        assert phi[b] == a and plcp[b] == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_tree_ranks(symbols):
    s = np.array(symbols)
    tree = fmindex.WaveletTree(s)
    for c in set(symbols):
        place = np.arange(len(s) + 1)
        assert tree.rank(np.full(len(place), c), place).tolist() == [symbols[:i].count(c) for i in place]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_matching_statistics(body):
    t = np.array([*body, 0])
    index, end = fmindex.FMIndex(t), np.arange(5, len(t)) if len(t) > 5 else np.array([], int)
    got, _ = index.matching(t, end, 5)
    for e, n in zip(end, got, strict=True):
        want = 0
        while want < 5 and sum(t[i : i + want + 1].tolist() == t[e - want - 1 : e].tolist() for i in range(len(t) - want)) >= 2:
            want += 1
        assert n == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=90))
def test_equal_windows_share_anchor_and_offset(units):
    first, n, gram = repeats.anchors(np.array(units, np.uint64), 12, 5)
    seen = {}
    assert first.tolist() == [0, *np.cumsum(n)[:-1].tolist()] and n.sum() == len(units) - 11
    for f, k, g in zip(first, n, gram, strict=True):
        for w in range(f, f + k):
            assert seen.setdefault(tuple(units[w : w + 12]), g) == g
