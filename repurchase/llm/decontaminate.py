"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are lower-cased and runs of white space become one space. A document is
contaminated by an item if any ``SEGMENT`` characters of the item in a row, at
any offset (all of a shorter item), are within ``budget`` edits of some stretch
of the document: e = min(rate * m, (m - q) / q), rounded down, for a window of
m characters. By the q-gram lemma such a stretch shares at least
m - q + 1 - q * e q-grams with the window, their offsets in the item lie within
m - q, and their diagonals (place in the document less place in the item)
differ by e at most. Shared q-grams are therefore counted per item in bands of
2 (e + 1) diagonals that overlap by half, over any m characters of the item.
Runs of grams that reach the bound are extended both ways by alignment, as far
as 0, 1, ... e edits go on each of the e diagonals on either side (furthest
reaching ends); a run holds if some split of e edits reaches m characters.

Items are indexed as parts of ``PART`` characters, which overlap so that each
window lies in one of them. Parts are dealt into blocks of about ``BLOCK``;
each block meets every whole document once. Items below ``LEAST`` characters
are too short to tell and match nothing, like null and empty ones; null and
empty documents hold nothing. Repeated items and documents are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

Q = 8
SEGMENT = 43
RATE = 0.1
LEAST = 24
PART = 1024
BLOCK = 2000
CHUNK = 1 << 18  # characters of documents searched at once
PAIRS = 1 << 20  # shared grams expanded at once
OVERLAP = 2 * SEGMENT
_BASE = 0x9E3779B97F4A7C15
_BITS = 21


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each place. Grams of 1, 2, 4, ... characters come
    by doubling; those for the binary digits of q are joined."""
    part, size = c.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while done < q:
        if len(c) < q:
            return np.empty(0, np.uint64)
        if q & size:
            n = len(part) - done
            shift = np.uint64(pow(_BASE, size, 1 << 64))
            whole = part if whole is None else whole[:n] * shift + part[done:]
            done += size
        shift = np.uint64(pow(_BASE, size, 1 << 64))
        part, size = part[:-size] * shift + part[size:] if len(part) > size else part[:0], size * 2
    return whole


def cut(text: str, size: int = SEGMENT) -> list[str]:
    """Parts of ``size`` characters such that every ``SEGMENT`` characters in
    a row lie in one of them."""
    if len(text) < LEAST:
        return []
    step = size - SEGMENT + 1
    return [text[s : s + size] for s in range(0, max(1, len(text) - SEGMENT + 1), step)]


def budget(m: int) -> int:
    m = min(m, SEGMENT)
    return max(0, min(int(RATE * m), (m - Q) // Q))


@dataclass
class Index:
    """Sorted gram hashes of a block's parts, with (part, offset); the parts'
    characters in a row; and window, edits and least shared grams of each."""

    items: list
    texts: list[str]
    hashes: np.ndarray
    first: np.ndarray
    segment: np.ndarray
    offset: np.ndarray
    table: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    window: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    told: np.ndarray  # telling grams that begin before each place of ``codes``


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(_BASE)) >> np.uint64(64 - _BITS)


def telling(grams: np.ndarray, q: int = Q) -> np.ndarray:
    """Offsets of the grams that do not recur within ``q`` places."""
    again = np.zeros(len(grams), bool)
    for p in range(1, min(q, len(grams) - 1) + 1):
        same = grams[p:] == grams[:-p]
        again[p:] |= same
        again[:-p] |= same
    return np.flatnonzero(~again)


def build_index(items: list, texts: list[str]) -> Index:
    each = [codes(t) for t in texts]
    grams = [gram_hashes(c) for c in each]
    kept = [telling(g) for g in grams]
    every = np.concatenate([*(g[k] for g, k in zip(grams, kept, strict=True)), np.empty(0, np.uint64)])
    segment = np.repeat(np.arange(len(texts)), [len(k) for k in kept])
    offset = np.concatenate([*kept, np.empty(0, int)])
    begin = np.r_[0, np.cumsum([len(c) for c in each])].astype(int)
    told = np.zeros(begin[-1] + 1, int)
    told[begin[segment] + offset + 1] = 1
    order = np.argsort(every, kind="stable")
    hashes, first = np.unique(every[order], return_index=True)
    table = np.zeros(1 << _BITS, bool)
    table[_slot(hashes)] = True
    length = np.array([len(c) for c in each], int)
    window = np.minimum(length, SEGMENT)
    edits = np.array([budget(m) for m in length], int)
    return Index(
        items,
        texts,
        hashes,
        np.r_[first, len(every)],
        segment[order],
        offset[order],
        table,
        np.concatenate([*each, np.empty(0, np.uint32)]),
        np.r_[0, np.cumsum(length)],
        window,
        edits,
        window - Q + 1 - Q * edits,
        np.cumsum(told),
    )


def crowded(index: Index, s: np.ndarray, offset: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Whether each shared gram is one of ``least`` in a band of diagonals and
    a window of its part (a superset of those in windows that hold)."""
    half = int(index.edits.max()) + 1
    cell = (diagonal - diagonal.min()) // half + 1
    bands = int(cell.max()) + 2
    key = np.r_[s * bands + cell, s * bands + cell - 1]
    which = np.tile(np.arange(len(s)), 2)
    order = np.lexsort((offset[which], key))
    key, which = key[order], which[order]
    at = offset[which]
    last = np.arange(len(key)) + index.least[s[which]] - 1
    end = np.minimum(last, len(key) - 1)
    full = (last < len(key)) & (key[end] == key) & (at[end] - at <= index.window[s[which]] - Q)
    within = np.cumsum(full - np.bincount(end[full] + 1, minlength=len(key) + 1)[:-1]) > 0
    near = np.zeros(len(s), bool)
    near[which[within]] = True
    return near


def reach(item: np.ndarray, i: np.ndarray, left: np.ndarray, text: np.ndarray, j: np.ndarray, room: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the item, and of the text with them, that align from
    places i and j in direction ``step`` with at most 0, 1, ... ``most`` edits
    (one row each), the furthest; up to ``left``, ``room`` and ``SEGMENT``."""
    low = -(1 << 30)
    d = np.arange(-most - 1, most + 2)
    f = np.full((len(i), len(d)), low)
    f[:, most + 1] = 0
    stop = np.minimum(left, SEGMENT)
    far, took = np.empty((2, most + 1, len(i)), int)
    for k in range(most + 1):
        if k:
            other, put, out = f + 1, np.full_like(f, low), np.full_like(f, low)
            put[:, 1:] = f[:, :-1]
            out[:, :-1] = other[:, 1:]
            other[(other > stop[:, None]) | (other + d > room[:, None])] = low
            put[put + d > room[:, None]] = low
            out[out > stop[:, None]] = low
            f = np.maximum(np.maximum(f, other), np.maximum(put, out))
        row, col = np.nonzero(f >= 0)
        x = f[row, col]
        live = np.arange(len(row))
        while len(live):
            r, at = row[live], x[live]
            beside = at + d[col[live]]
            inside = (at < stop[r]) & (beside < room[r])
            live, r, at, beside = live[inside], r[inside], at[inside], beside[inside]
            live = live[item[i[r] + step * at] == text[j[r] + step * beside]]
            x[live] += 1
        f[row, col] = x
        best = f.argmax(axis=1)
        far[k] = f[np.arange(len(i)), best]
        took[k] = far[k] + d[best]
    return far, took


def find_all(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, part, edits, start, end, part's start, part's end) of each run of
    shared grams that extends to a window within its budget, with the least
    edits that do; places are in the normalised text and in the part."""
    norms = [normalise(t) for t in texts]
    starts = np.r_[0, np.cumsum([len(x) + 1 for x in norms])]
    c = codes("\n".join([*norms, ""]))  # no gram of a part holds a line end
    h = gram_hashes(c)
    place = np.flatnonzero(index.table[_slot(h)])
    near = np.minimum(np.searchsorted(index.hashes, h[place]), len(index.hashes) - 1)
    same = index.hashes[near] == h[place] if len(index.hashes) else np.zeros(len(place), bool)
    place, near = place[same], near[same]
    hits: set[tuple] = set()
    for some in portions(place, index.first[near + 1] - index.first[near]):
        hits.update(_extended(index, starts, c, place[some], near[some]))
    return sorted(hits)


def portions(place: np.ndarray, n: np.ndarray) -> Iterator[slice]:
    """Consecutive places (rising) with about ``PAIRS`` pairs together, n at
    each; portions overlap by ``OVERLAP`` characters and are twice as long at
    least, so that whatever lies within that many characters is in one."""
    upto, lo = np.cumsum(n), 0
    while lo < len(place):
        full = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS))
        hi = min(len(place), max(full, int(np.searchsorted(place, place[lo] + 2 * OVERLAP))))
        yield slice(lo, hi)
        if hi == len(place):
            return
        lo = int(np.searchsorted(place, place[hi - 1] - OVERLAP, "right"))


def _extended(index: Index, starts: np.ndarray, c: np.ndarray, place: np.ndarray, near: np.ndarray) -> list[tuple]:
    """The hits of one portion of shared grams."""
    n = index.first[near + 1] - index.first[near]
    at = np.repeat(index.first[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    s, o, p = index.segment[at], index.offset[at], np.repeat(place, n)
    near = crowded(index, s, o, p - o)
    s, o, p = s[near], o[near], p[near]
    if not len(s):
        return []
    order = np.lexsort((p, p - o, s))
    s, o, p = s[order], o[order], p[order]
    begin = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1) | (p[1:] != p[:-1] + 1)])
    run = np.diff(np.r_[begin, len(s)]) + Q - 1
    s, o, p = s[begin], o[begin], p[begin]
    doc = np.searchsorted(starts, p, "right") - 1
    most, i = int(index.edits.max()), index.start[s] + o
    back, back_text = reach(index.codes, i - 1, o, c, p - 1, p - starts[doc], -1, most)
    on, on_text = reach(index.codes, i + run, index.start[s + 1] - i - run, c, p + run, starts[doc + 1] - 1 - p - run, 1, most)
    hits = []
    done = np.zeros(len(s), bool)
    for e in range(most + 1):
        sums = np.stack([back[k] + on[e - k] for k in range(e + 1)])
        best = sums.argmax(axis=0)
        every = np.arange(len(s))
        a, b = i - back[best, every], i + run + on[e - best, every]
        telling = index.told[np.maximum(a, b - Q + 1)] - index.told[a]
        holds = ~done & (e <= index.edits[s]) & (b - a >= index.window[s]) & (4 * telling >= 3 * (index.window[s] - Q + 1))
        done |= holds
        for r in np.flatnonzero(holds).tolist():
            k = best[r]
            first = p[r] - starts[doc[r]]
            hits.append((doc[r], s[r], e, first - back_text[k, r], first + run[r] + on_text[e - k, r], o[r] - back[k, r], o[r] + run[r] + on[e - k, r]))
    return [tuple(map(int, hit)) for hit in hits]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about ``CHUNK`` characters, with the first's number."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def find(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(part, edits, start, end) of each part found in one text, its region of
    least edits; places are in the normalised text."""
    found: dict[int, tuple[int, int, int]] = {}
    for _, s, *hit in find_all([text], index):
        found[s] = min(found.get(s, (len(index.codes), 0, 0)), tuple(hit[:3]))
    return [(s, *hit) for s, hit in sorted(found.items())]


def count_segments(stretches: list[tuple[int, int]]) -> int:
    """Half-overlapping segments that fit in the union of stretches."""
    n, start, stop = 0, None, -1
    for a, b in [*sorted(stretches), (1 << 60, 1 << 60)]:
        if a > stop:
            n += 0 if start is None else 1 + max(0, stop - start - SEGMENT) // (SEGMENT // 2)
            start = a
        stop = max(stop, b)
    return n


def hit_rows(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text, part, n_segments, least edits, start, end) over all stretches."""
    found: dict[tuple[int, int], list[tuple]] = {}
    for first, some in chunks(texts):
        for t, s, *hit in find_all(some, index):
            found.setdefault((first + t, s), []).append(hit)
    return [(t, s, count_segments([(h[3], h[4]) for h in hits]), min(h[0] for h in hits), min(h[1] for h in hits), max(h[2] for h in hits)) for (t, s), hits in found.items()]


def segments(benchmark: DataFrame) -> DataFrame:
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(i, s) for i, t in zip(b["item_id"], b["text"], strict=True) for s in cut(normalise(t), PART)]
            yield pd.DataFrame(parts, columns=["item_id", "segment"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInPandas(split, "item_id string, segment string")


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's index, one block of bounded size after another."""
    parts = stash(segments(benchmark), "benchmark-segments")
    n = max(1, -(-parts.count() // BLOCK))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("segment"), F.lit(n)))
    for k in range(n):
        rows = parts.where(F.col("block") == k).select("item_id", "segment").distinct().orderBy("segment", "item_id").collect()
        if rows:
            yield build_index([r["item_id"] for r in rows], [r["segment"] for r in rows])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_segments (that fit in the stretches found), edits (of
    the best stretch), first_char and end_char (in the normalised text, over all
    stretches found); one row for each row of ``docs`` and item id."""
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    id_kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "mark", "item_id", "part", "n_segments", "edits", "first_char", "end_char"]
    out = "doc_id string, mark long, item_id string, part long, n_segments long, edits long, first_char long, end_char long"

    def of(block: int, index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast((index.items, index.texts))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = build_index(*shared.value)
            for b in batches:
                hits = [(b["doc_id"].iloc[t], b["mark"].iloc[t], known.items[s], (block << 32) + s, *hit) for t, s, *hit in hit_rows(b["text"].tolist(), known)]
                yield pd.DataFrame(hits, columns=names)

        return rows.mapInPandas(scan, out)

    parts = [of(k, index) for k, index in enumerate(blocks(benchmark))]
    found = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], out))
    # Rows that share id and text give the same hits: as many as there are rows.
    alike = [F.min("edits").alias("edits"), F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char")]
    found = found.groupBy("doc_id", "mark", "item_id", "part").agg(F.count(F.lit(1)).alias("copies"), F.max("n_segments").alias("n_segments"), *alike)
    found = found.groupBy("doc_id", "mark", "item_id").agg(F.max("copies").alias("copies"), F.sum("n_segments").alias("n_segments"), *alike)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("mark", "copies", "copy")
    return found.withColumns({"doc_id": F.col("doc_id").cast(id_kind), "item_id": F.col("item_id").cast(kind)})


def holds(text: Column, index: Index, spark) -> Column:
    """Whether a whole text holds a passage of one block."""
    shared = spark.sparkContext.broadcast((index.items, index.texts))

    @F.pandas_udf("boolean")
    def any_found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = build_index(*shared.value)
        for texts in batches:
            held = np.zeros(len(texts), bool)
            for first, some in chunks(texts.tolist()):
                held[[first + hit[0] for hit in find_all(some, known)]] = True
            yield pd.Series(held)

    return any_found(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark passage, columns unchanged."""
    for index in blocks(benchmark):
        docs = docs.where(~holds(F.col("text"), index, docs.sparkSession))
    return docs
