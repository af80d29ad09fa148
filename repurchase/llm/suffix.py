"""Suffix-array de-duplication: every byte covered by a 200-byte string that
also starts elsewhere is removed.

Texts meet in shards (see ``repeats``). A shard's pieces are joined by a
separator; its suffix array comes from induced sorting: suffixes are classed
as larger or smaller than their successor, the leftmost-smaller substrings
(from one such place to the next) are sorted by inducing and named; where names
repeat, suffixes of the sequence of names are ranked by ever longer starts; the
sorted leftmost-smaller suffixes then induce all others in two linear scans. A
scan handles a whole bucket at once.
Common prefixes are computed in text order from each suffix's predecessor:
one whose preceding byte agrees with its predecessor's is one shorter than the
prefix before it, so only the others are compared. Suffixes that share 200
bytes with their neighbours form an interval; a window repeats if the copies of
the pieces in its interval are two or more.

Null, empty and short texts lose nothing; repeated rows are copies like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Units, covered, window_places, with_runs

WINDOW = 200
GRAM = 64
_SEPARATOR, _FIRST = 1, 2
_PACKED = 1 << 21  # ranks below it fit three to a word

BYTES = Units(
    split=lambda data: np.frombuffer(data, np.uint8),
    values=lambda b: (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93),
    cut=lambda b, low, high: b[low:high].tobytes(),
    window=WINDOW,
    gram=GRAM,
)


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor. The last character
    is unique and least; equal characters take their successor's class."""
    n = len(t)
    step = np.r_[np.sign(t[1:].astype(np.int64) - t[:-1]), 1]
    decided = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return step[following] > 0


def _deal(parts: list[list[np.ndarray]], places: np.ndarray, t: np.ndarray) -> None:
    """Append places to the buckets of their characters, order kept."""
    if not len(places):
        return
    c = t[places]
    order = np.argsort(c, kind="stable")
    places, c = places[order], c[order]
    cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(c)], strict=True):
        parts[c[a]].append(places[a:b])


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, induced from the order of the leftmost-smaller ones."""
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    lms: list[list[np.ndarray]] = [[] for _ in range(size)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    none = np.empty(0, np.int64)
    _deal(lms, seeds, t)
    for c in range(size):
        front = np.concatenate([*larger[c], none])
        done = []
        while len(front):
            done.append(front)
            p = front[front > 0] - 1
            p = p[~small[p]]
            same = t[p] == c
            _deal(larger, p[~same], t)
            front = p[same]
        larger[c] = [np.concatenate([*done, none])]
        p = np.concatenate([*lms[c], none])
        p = p[p > 0] - 1
        _deal(larger, p[~small[p]], t)
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        front = np.concatenate([*smaller[c], none])
        while len(front):
            out.append(front)
            p = front[front > 0] - 1
            p = p[small[p]]
            same = t[p] == c
            _deal(smaller, p[~same], t)
            front = p[same]
        back = larger[c][0][::-1]
        if c == t[-1]:
            back = seeds[seeds == len(t) - 1]  # the last character: no other suffix has it
        out.append(back)
        p = back[back > 0] - 1
        _deal(smaller, p[small[p]], t)
    return np.concatenate(out)[::-1]


def _names(t: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Rank of the leftmost-smaller substring at each start, by its order."""
    length = np.diff(np.r_[starts, len(t) - 1]) + 1
    at = np.empty(len(t), np.int64)
    at[starts] = np.arange(len(starts))
    n = length[at[ordered]]
    a, b = ordered[:-1], ordered[1:]
    same = n[:-1] == n[1:]
    pair = np.flatnonzero(same)
    size = n[:-1][pair]
    owner = np.repeat(np.arange(len(pair)), size)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = t[a[pair][owner] + step] != t[b[pair][owner] + step]
    same[pair[np.unique(owner[differ])]] = False
    names = np.empty(len(starts), np.int64)
    names[at[ordered]] = np.r_[0, np.cumsum(~same)]
    return names


def _sort_names(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix of a sequence of names, the last one unique and
    least. Ranks by the first k names become ranks by 3k (its own and those of
    the suffixes k and 2k on), and only suffixes that still share a rank are
    compared again."""
    n = len(s)
    # Rank of the first suffix of each group of equals, counted from 1; past
    # the end lies 0.
    rank = np.zeros(n + 1, np.uint64)
    counts = np.bincount(s)
    rank[:-1] = (np.cumsum(counts) - counts + 1)[s]
    live = np.flatnonzero(counts[s] > 1)
    bits, step = np.uint64(_PACKED.bit_length() - 1), 1
    while len(live):
        near, far = rank[np.minimum(live + step, n)], rank[np.minimum(live + 2 * step, n)]
        own = rank[live]
        if n < _PACKED:
            key = own << bits << bits | near << bits | far
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]]
        else:
            order = np.lexsort([far, near, own])
            new = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (own, near, far)], axis=0)]
        own = own[order]
        place = np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], place, 0))
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(live)])
        live = live[order]
        rank[live] = own + np.repeat(first - group[first], size).astype(np.uint64)
        live = live[np.repeat(size > 1, size)]
        step *= 3
    return rank[:-1].astype(np.int64) - 1


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``t``, whose last character is unique and least."""
    if len(t) < 3:
        return np.argsort(t, kind="stable") if len(t) < 2 else np.array([1, 0])
    small = _smaller(t)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rank = _induce(t, small, starts, size)
    is_start = np.zeros(len(t), bool)
    is_start[starts] = True
    ordered = rank[is_start[rank]]
    names = _names(t, starts, ordered)
    top = int(names.max()) + 1
    if top < len(starts):
        ordered = np.empty(len(starts), np.int64)
        ordered[_sort_names(names)] = starts
    return _induce(t, small, ordered, size)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp) in text order: each suffix's predecessor in the suffix
    array (-1 for the first) and the length of their common prefix."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    before = np.where((place > 0) & (phi > 0), t[place - 1] == t[np.maximum(phi - 1, 0)], False)
    start = np.flatnonzero(~before & (phi >= 0))
    padded = np.concatenate([t, np.zeros(8, t.dtype)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(7):
        word |= padded[k : k + n] << np.uint64(9 * k)
    length = np.zeros(n, np.int64)
    a, b, live = start.copy(), phi[start].copy(), start.copy()
    while len(live):
        inside = np.maximum(a, b) < n
        diff = np.where(inside, word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)], np.uint64(1))
        same = diff == 0
        low = diff & (~diff + np.uint64(1))
        zeros = np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 9
        length[live] += np.where(same, 7, zeros)
        a, b, live = a[same] + 7, b[same] + 7, live[same]
    first = np.maximum.accumulate(np.where(before, -1, place))
    return phi, np.where(before, length[first] - (place - first), length)


def repeated_windows(pieces: list[bytes], weights: np.ndarray, window: int) -> np.ndarray:
    """Whether the suffix-array interval of each window, of all pieces in
    turn, weighs two or more."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.zeros(int(size.sum()) + len(pieces) + 1, np.int64)
    text[:-1] = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    text[:-1] += _FIRST
    text[np.cumsum(size + 1) - 1] = _SEPARATOR
    place = window_places(size, window)
    weight = np.zeros(len(text), np.int64)
    weight[place] = weights
    sa = suffix_array(text, 256 + _FIRST)
    _, plcp = common_prefixes(text, sa)
    # An interval: suffixes that share a window's length with their neighbours.
    first = np.flatnonzero(plcp[sa] < window)
    twice = np.empty(len(text), bool)
    twice[sa] = np.repeat(np.add.reduceat(weight[sa], first) >= 2, np.diff(np.r_[first, len(text)]))
    return twice[place]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; every row of ``docs``."""
    hit, hits = with_runs(docs, BYTES, repeated_windows)
    kind = dict(docs.dtypes)["doc_id"]

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, low, high in zip(b["doc_id"], b["text"], b["low"], b["high"], strict=True):
                data = np.frombuffer(t.encode(), np.uint8)
                gone = covered(low, high, len(data), WINDOW)
                spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
                rows.append((d, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    stripped = hit.mapInPandas(strip, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("kept_sha256"))
    rest = whole.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m")), "left_anti")
    rest = rest.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return stripped.unionByName(rest).withColumn("doc_id", F.col("doc_id").cast(kind))
