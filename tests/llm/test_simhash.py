import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from repurchase.llm import components, simhash

from .data import prose, table


def plain(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(codes):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(codes))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 2**32))
def test_index_finds_every_link(centres, seed):
    r = np.random.default_rng(seed)
    codes = np.array([c ^ sum(1 << int(b) for b in set(r.integers(0, 64, r.integers(0, 4)))) for c in centres for _ in range(4)], np.uint64)
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    pairs = {(int(i), int(j)) for a, b in simhash.search(codes, np.zeros(len(codes), int)) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 3}
    assert pairs == want


def near_rows():
    r = np.random.default_rng(4)
    rows = []
    for g in range(12):
        w = prose(400, g).split()
        for k in range(6):
            v = list(w)
            for at in r.integers(0, len(v), k):
                v[at] = f"changed{at}"
            rows.append((len(rows) * 7 % 72, " ".join(v)))
    return [*rows, (500, None), (501, ""), (502, "A b"), (503, "a B")]


def test_fingerprints_and_components(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, rows)).collect()}
    codes = [plain(t) for _, t in rows]
    root = groups(codes)
    assert len(set(root)) < len(rows)
    for i, (d, _) in enumerate(rows):
        assert got[d]["fingerprint"] == f"{codes[i]:016x}"
        assert got[d]["component_id"] == min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])
    kept = [r["doc_id"] for r in simhash.keep_one(table(spark, rows)).collect()]
    assert sorted(kept) == sorted({r["component_id"] for r in got.values()})


def test_oversized_segments_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SEGMENT", 4)
    test_fingerprints_and_components(spark)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(30)}
