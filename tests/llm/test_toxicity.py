import math
import re

import numpy as np
import pytest

from repurchase.llm import toxicity

from .data import prose, table

BAD = ["idiot", "scumbag", "losers", "trashy"]


def rows(n=400):
    out, labels = [], []
    for i in range(n):
        w = prose(60, i).split()
        toxic = i % 8 == 0
        if toxic:
            for k in range(3 + i % 5):
                w[k * 7] = BAD[(i + k) % 4]
        out.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return out, labels


def test_held_out_accuracy(spark):
    data, labels = rows()
    known = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, data[:300]), known)
    got = {r["doc_id"]: r for r in toxicity.grade_documents(table(spark, data), model).collect()}
    held = [(got[d]["rejected"], bool(y)) for d, y in labels[300:]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r["p_toxic"] <= 1 and 0 <= r["severity"] <= 2 for r in got.values())
    kept = {r["doc_id"] for r in toxicity.keep_clean(table(spark, data), model).collect()}
    assert kept == {d for d, r in got.items() if not r["rejected"]}


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 2))
    latent = x @ np.array([2.0, -1.0]) + r.logistic(size=2000)
    grade = (latent > 0.5).astype(int) + (latent > 2.5)
    row, col = np.repeat(np.arange(2000), 2), np.tile([0, 1], 2000)
    w, cut = toxicity.fit_ordinal(row, col, x.ravel(), grade, 2, 2, l2=0.0)
    assert abs(w[0] - 2) < 0.3 and abs(w[1] + 1) < 0.3 and abs(cut[0] - 0.5) < 0.3 and abs(cut[1] - 2.5) < 0.4


def test_one_class_gives_an_empty_model(spark):
    data, _ = rows(20)
    model = toxicity.fit(table(spark, data), spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert model.terms == {} and toxicity.keep_clean(table(spark, data), model).count() == 20


def test_sample_counts_documents_not_labels(spark):
    data, labels = rows(40)
    known = spark.createDataFrame([*labels, *((d, 0) for d in range(1000, 1400)), (3, 0)], "doc_id long, toxic int")
    docs = table(spark, [*data, *[(3, data[3][1])] * 30, *((5, f"other text {i}") for i in range(30))])
    got = toxicity.labelled_sample(docs, known, 40).collect()
    assert len(got) == 40 and sum(r["toxic"] for r in got) == sum(y for _, y in labels)
    assert sum(r["text"] == data[3][1] for r in got) == 1
    assert len(toxicity.labelled_sample(docs, known, 10).collect()) == 10


def plain_terms(text):
    out = {}
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for t in [w, *(w[:k] + "*" for k in range(3, 8) if len(w) > k)]:
            out[t] = out.get(t, 0) + 1
    return out


def test_terms_fit_and_scores_against_plain_versions(spark):
    data, labels = rows(200)
    docs, known = table(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, known)
    chosen = dict(toxicity.choose_terms(sample))
    counts, toxic = [plain_terms(t) for _, t in data], [y for _, y in labels]
    n1, n0, want = sum(toxic), len(toxic) - sum(toxic), {}
    for t in {t for c in counts for t in c}:
        a = sum(1 for c, y in zip(counts, toxic, strict=True) if t in c and y) + 0.5
        b = sum(1 for c, y in zip(counts, toxic, strict=True) if t in c and not y) + 0.5
        odds = math.log(a / (n1 + 1 - a)) - math.log(b / (n0 + 1 - b))
        if a + b - 1 >= 3 and odds / math.sqrt(1 / a + 1 / b) >= 3:
            want[t] = odds
    assert chosen == pytest.approx(want) and len(want) >= 4
    model = toxicity.fit(docs, known)
    assert set(model.terms) == set(want)
    lines = [sum(model.terms[t] * math.log1p(n) for t, n in c.items() if t in model.terms) for c in counts]
    above = [[1 / (1 + math.exp(cut - s)) for cut in model.thresholds] for s in lines]
    got = {r["doc_id"]: r for r in toxicity.grade_documents(docs, model).collect()}
    for (d, _), p in zip(data, above, strict=True):
        assert got[d]["p_toxic"] == pytest.approx(p[0]) and got[d]["severity"] == pytest.approx(sum(p))
        assert got[d]["grade"] == int(np.argmax([1 - p[0], p[0] - p[1], p[1]]))


def test_fit_is_a_minimum_of_the_plain_loss():
    r = np.random.default_rng(3)
    x = np.abs(r.normal(size=(300, 3)))
    grade = np.clip((x @ [1.5, -1.0, 0.5] + r.logistic(size=300)).round().astype(int), 0, 2)
    row, col = np.repeat(np.arange(300), 3), np.tile([0, 1, 2], 300)
    w, cut = toxicity.fit_ordinal(row, col, x.ravel(), grade, 3, 2, l2=0.01, steps=3000)

    def loss(p):
        total = 0.005 * sum(v * v for v in p[:3])
        for features, g in zip(x, grade, strict=True):
            s = sum(f * v for f, v in zip(features, p[:3], strict=True))
            below = [0.0, *(1 / (1 + math.exp(s - c)) for c in p[3:]), 1.0]
            total -= math.log(below[g + 1] - below[g]) / len(grade)
        return total

    best = np.concatenate([w, cut])
    for i in range(5):
        for step in (-0.05, 0.05):
            moved = best.copy()
            moved[i] += step
            assert loss(moved) > loss(best)


def test_graded_labels(spark):
    data, labels = rows(160)
    graded = [(d, y, 2 * y if d % 16 == 0 else y) for d, y in labels]
    known = spark.createDataFrame(graded, "doc_id long, toxic int, grade int")
    got = {r["text"]: (r["toxic"], r["grade"]) for r in toxicity.labelled_sample(table(spark, data), known).collect()}
    assert all(got[t] == (y, g) for (_, t), (_, y, g) in zip(data, graded, strict=True))
    assert toxicity.fit(table(spark, data), known).terms
