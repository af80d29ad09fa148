"""Toxicity by cumulative-link ordinal regression.

Grades: 0 for documents labelled clean; labelled toxic ones get 1 or 2, 2 for
those that use marker terms (terms far more frequent in toxic than in clean
labelled documents) more often than the median toxic document does. The model
is P(grade <= j) = sigmoid(theta_j - w.x), with one weight vector for both
thresholds and x = log(1 + count) of the chosen terms: words, and beginnings
of words (``PREFIXES`` letters, marked by a star). It yields P(grade >= 1)
and the expected severity sum_j P(grade >= j), from 0 to 2.

It is fitted on the ``FIT_ROWS`` labelled documents of smallest id hash, which
also bounds what the driver receives, with every term that ``MIN_DOCS`` of them
hold and whose log-odds lie ``MIN_Z`` standard errors above 0. The marker terms
are features too, so the model learns grade 2 from what defines it; give
``labels`` a column ``grade`` (0, 1, 2) to learn from graded labels instead. A labelled id counts once, by its row of least text hash
and toxic if one of its labels says so; labels without documents do not count. Every document is scored on its whole text.

Null or empty texts score like any text without known terms. Without labels,
or with labels of one class only, there are no terms and severity is 0.
Repeated rows and ids are scored row by row; labels of null are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

FIT_ROWS = 8000
MIN_DOCS = 4
PREFIXES = range(3, 8)
MIN_Z = 3.0
REJECT_AT = 0.3
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (20.0, 21.0)


def first_letters(terms: Iterable[str]) -> frozenset[str]:
    """Beginnings that a word must have to hold one of the terms."""
    return frozenset(t.rstrip("*")[: PREFIXES[0]] for t in terms)


def term_counts(text: str | None, among: dict[str, float] | None = None, starts: frozenset[str] | None = None) -> Counter:
    """Terms of one text, of all or of those in ``among``."""
    if not text:
        return Counter()
    found = _WORD.findall(text.lower())
    if starts is not None:
        found = [w for w in found if w[: PREFIXES[0]] in starts]
    terms = Counter(found)
    for w, n in list(terms.items()):
        for k in PREFIXES:
            if len(w) > k:
                terms[w[:k] + "*"] += n
    return terms if among is None else Counter({t: n for t, n in terms.items() if t in among})


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic, grade (null unless ``labels`` has one) of the sample: one
    row for each of the ``rows`` ids. Ids are chosen before any text is moved,
    and their ``rows`` rows are broadcast."""
    given = F.least(F.greatest(F.col("grade").cast("int"), F.lit(0)), F.lit(2)) if "grade" in labels.columns else F.lit(None).cast("int")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"), F.max(given).alias("_grade"))
    known = known.withColumn("_toxic", F.coalesce((F.col("_grade") > 0).cast("int"), "_toxic"))
    docs = docs.select("doc_id", "text")
    held = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("other"))).alias("_least"))
    chosen = held.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    same = (F.xxhash64("text") == F.col("_least.hash")) & (F.xxhash64(F.lit(1), "text") == F.col("_least.other"))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(same)
    # Rows left of one id have the same text.
    return found.dropDuplicates(["doc_id"]).select("text", F.col("_toxic").alias("toxic"), F.col("_grade").alias("grade"))


def _sample_terms(sample: DataFrame) -> DataFrame:
    def split(batches):
        at = 0
        for b in batches:
            counts = [term_counts(t) for t in b["text"]]
            n = [len(c) for c in counts]
            row = np.repeat(np.arange(at, at + len(b)), n)
            at += len(b)
            yield pd.DataFrame(
                {
                    "row": row,
                    "toxic": np.repeat(b["toxic"].to_numpy(), n),
                    "term": np.array([t for c in counts for t in c], object),
                    "n": np.array([k for c in counts for k in c.values()], np.int64),
                }
            )

    return sample.mapInPandas(split, "row long, toxic int, term string, n long")


def choose_terms(sample: DataFrame) -> list[tuple[str, float]]:
    """Terms with their smoothed log-odds of toxic against clean documents."""
    n = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(n["t"] or 0), int(n["n"]) - int(n["t"] or 0)
    if not toxic or not clean:
        return []
    per = _sample_terms(sample).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (F.lit(toxic + 1.0) - a)) - F.log(b / (F.lit(clean + 1.0) - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    per = per.where(F.col("a") + F.col("b") >= MIN_DOCS).select("term", odds.alias("odds"), z.alias("z"))
    rows = per.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").collect()
    return [(r["term"], r["odds"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    sample = stash(labelled_sample(docs, labels, rows), "toxicity-sample")
    chosen = choose_terms(sample)
    if not chosen:
        return Model()
    index = {t: i for i, (t, _) in enumerate(chosen)}
    index_starts = first_letters(index)

    def features(batches):
        for b in batches:
            counts = [{index[t]: n for t, n in term_counts(x, index, index_starts).items()} for x in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "grade": b["grade"], "i": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    got = sample.mapInPandas(features, "toxic int, grade int, i array<int>, n array<long>").toPandas()
    toxic = got["toxic"].to_numpy()
    row = np.repeat(np.arange(len(got)), [len(x) for x in got["i"]])
    col = np.concatenate([*got["i"], np.empty(0, int)]).astype(int)
    x = np.log1p(np.concatenate([*got["n"], np.empty(0)]).astype(float))
    marks = np.array([o > np.log(20) for _, o in chosen])
    dose = np.bincount(row, x * marks[col], minlength=len(got))
    middle = np.median(dose[toxic == 1])
    grade = np.where(toxic == 1, np.where(dose > middle, 2, 1), 0)
    given = got["grade"].to_numpy(float, na_value=np.nan)
    grade = np.where(np.isnan(given), grade, given).astype(int)
    w, thresholds = fit_ordinal(row, col, x, grade, len(chosen), 2)
    return Model({t: float(w[i]) for t, i in index.items()}, tuple(map(float, thresholds)))


def fit_ordinal(row, col, x, grade, width: int, top: int, l2: float = 1e-4, steps: int = 800, rate: float = 0.05):
    """Weights and ``top`` increasing thresholds of the cumulative-link model,
    by Adam on the mean negative log-likelihood of sparse rows."""
    n = len(grade)
    params = np.zeros(width + top)
    params[width] = 1.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w = params[:width]
        gaps = np.exp(params[width + 1 :])
        theta = params[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[col] * x, minlength=n)
        cut = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -30, 30)))
        cdf = np.hstack([np.zeros((n, 1)), cut, np.ones((n, 1))])
        p = np.maximum(cdf[np.arange(n), grade + 1] - cdf[np.arange(n), grade], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), cut * (1 - cut), np.zeros((n, 1))])
        up, down = slope[np.arange(n), grade + 1] / p, slope[np.arange(n), grade] / p
        g_theta = np.zeros(top)
        for j in range(top):
            g_theta[j] = -(up[grade == j].sum() - down[grade == j + 1].sum()) / n
        g = np.concatenate(
            [
                np.bincount(col, x * ((up - down) / n)[row], minlength=width) + l2 * w,
                [g_theta.sum()],
                [g_theta[j:].sum() * gaps[j - 1] for j in range(1, top)],
            ]
        )
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])


def linear_score(text: Column, model: Model) -> Column:
    """w.x of each whole text."""
    terms, starts = model.terms, first_letters(model.terms)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t and terms:
                out[i] = sum(terms[w] * np.log1p(n) for w, n in term_counts(t, terms, starts).items())
        return pd.Series(out)

    return score(text)


def at_least(score: Column, model: Model, grade: int) -> Column:
    """P(grade >= ``grade``)."""
    return 1 / (1 + F.exp(F.lit(model.thresholds[grade - 1]) - score))


def grade_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic, severity, grade (the most probable), rejected."""
    rows = docs.select("doc_id", linear_score(F.col("text"), model).alias("_s"))
    above = [at_least(F.col("_s"), model, j + 1) for j in range(len(model.thresholds))]
    rows = rows.select("doc_id", above[0].alias("p_toxic"), above[1].alias("p_severe"))
    mild = F.col("p_toxic") - F.col("p_severe")
    clean = 1 - F.col("p_toxic")
    grade = F.when((clean >= mild) & (clean >= F.col("p_severe")), 0).when(mild >= F.col("p_severe"), 1).otherwise(2)
    return rows.select("doc_id", "p_toxic", (F.col("p_toxic") + F.col("p_severe")).alias("severity"), grade.alias("grade"), (F.col("p_toxic") >= REJECT_AT).alias("rejected"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that are not rejected, columns unchanged."""
    return docs.where(at_least(linear_score(F.col("text"), model), model, 1) < REJECT_AT)
