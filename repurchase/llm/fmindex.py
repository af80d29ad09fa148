"""Substring de-duplication with an FM-index: every word covered by a window
of 35 words that also starts elsewhere is removed.

Texts meet in shards (see ``repeats``). A shard's pieces are numbered word by
word and joined by a separator; the index is the Burrows-Wheeler transform of
that text in a wavelet tree (one bit plane for each binary digit of a word's
number, with ranks sampled every 64 places). The pieces are then streamed
through it: a backward search from the end of each window adds one word after
another on the left, for all windows at once, until the places left, weighed by
the copies of their pieces, are fewer than two. The number of words added is the matching statistic, up to the window's
length; a window repeats if it reaches that.

Null, empty and short texts lose nothing; repeated rows are copies like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, words
from .repeats import Units, covered, sliding_min, window_places, with_runs

WINDOW = 35
GRAM = 12
_SEPARATOR, _FIRST = 1, 2

WORDS = Units(
    split=lambda data: data.split(),
    values=lambda w: np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)),
    cut=lambda w, low, high: b" ".join(w[low:high]),
    window=WINDOW,
    gram=GRAM,
)


class WaveletTree:
    """Ranks of symbols in a sequence: bit planes from the highest binary
    digit down, each stably parted by its bit for the next."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.digits = max(1, int(symbols.max()).bit_length())
        self.planes, self.samples, self.zeros = [], [], []
        for d in range(self.digits - 1, -1, -1):
            bit = (symbols >> d) & 1 == 1
            packed = np.packbits(np.r_[bit, np.zeros(-self.n % 64 + 64, bool)], bitorder="little").view(np.uint64)
            self.planes.append(packed)
            self.samples.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros(len(place), np.int64)
        for k, (packed, sample, zeros) in enumerate(zip(self.planes, self.samples, self.zeros, strict=True)):
            one = (symbol >> (self.digits - 1 - k)) & 1 == 1

            def ones(at: np.ndarray, packed=packed, sample=sample) -> np.ndarray:
                within = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
                return sample[at >> 6] + np.bitwise_count(packed[at >> 6] & within)

            low_ones, place_ones = ones(low), ones(place)
            low = np.where(one, zeros + low_ones, low - low_ones)
            place = np.where(one, zeros + place_ones, place - place_ones)
        return place - low


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of word numbers by doubling the sorted length."""
    rank, step = t.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(t), np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(len(t), np.int64)
        new[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        if new.max() == len(t) - 1 or step * 2 >= len(t):
            return order
        rank, step = new, step * 2


class FMIndex:
    def __init__(self, t: np.ndarray):
        """Index of ``t``, whose last symbol is unique and least."""
        self.order = suffix_order(t)
        self.tree = WaveletTree(t[self.order - 1])
        self.before = np.r_[0, np.cumsum(np.bincount(t))]

    def matching(self, t: np.ndarray, end: np.ndarray, most: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each end, the length (``most`` at most) of the longest stretch
        of the indexed text ``t`` before it that the index holds twice, places
        counted by ``weight`` (1); and the last interval, as (low, high).

        An interval of one place is the searched stretch itself, and stays so
        further left: its length is read from the weights there."""
        weight = np.ones(len(t), np.int64) if weight is None else weight
        total = np.r_[0, np.cumsum(weight[self.order])]
        rank = np.empty(len(t), np.int64)
        rank[self.order] = np.arange(len(t))
        place = np.arange(len(t))
        # Heavy places in a row that end before each place.
        heavy = np.r_[0, place - np.maximum.accumulate(np.where(weight < 2, place, -1))]
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.tree.n, np.int64)
        length, live = np.zeros(len(end), np.int64), np.arange(len(end))
        for k in range(most):
            symbol = t[end[live] - 1 - k]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            live = live[total[high[live]] - total[low[live]] >= 2]
            length[live] = k + 1
            one = high[live] - low[live] == 1
            own, live = live[one], live[~one]
            length[own] = np.minimum(k + 1 + heavy[end[own] - 1 - k], most)
            low[own] = rank[end[own] - length[own]]
            high[own] = low[own] + 1
            if not len(live):
                break
        return length, np.stack([low, high])


def repeated_windows(pieces: list[bytes], weights: np.ndarray, window: int) -> np.ndarray:
    """Whether the index interval of each window, of all pieces in turn,
    weighs two or more."""
    split = [p.split() for p in pieces]
    number: dict[bytes, int] = {}
    for p in split:
        for w in p:
            number.setdefault(w, len(number) + _FIRST)
    t = np.array([x for p in split for x in (*(number[w] for w in p), _SEPARATOR)] + [0], np.int64)
    place = window_places(np.fromiter(map(len, split), np.int64, len(split)), window)
    own = np.zeros(len(t), np.int64)
    own[place] = weights
    # On the way to a window's start, a word weighs what the heaviest window
    # around it does, and no less than itself.
    around = np.maximum(-sliding_min(-np.r_[np.zeros(window - 1, np.int64), own], window), 1)
    index = FMIndex(t)
    length, (low, high) = index.matching(t, place + window, window, around)
    total = np.r_[0, np.cumsum(own[index.order])]
    return (length >= window) & (total[high] - total[low] >= 2)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; every row of ``docs``."""
    hit, hits = with_runs(docs, WORDS, repeated_windows)
    kind = dict(docs.dtypes)["doc_id"]

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, low, high in zip(b["doc_id"], b["text"], b["low"], b["high"], strict=True):
                w = t.encode().split()
                gone = covered(low, high, len(w), WINDOW)
                kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                rows.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    stripped = hit.mapInPandas(strip, "doc_id string, n_words long, n_removed long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    # Counted and hashed before the join, so that only short rows travel.
    plain = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.sha2(F.array_join(w, " "), 256).alias("sha")))
    whole = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("mark"), plain.alias("plain"))
    rest = whole.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m")), "left_anti")
    rest = rest.select("doc_id", F.col("plain.n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("plain.sha").alias("kept_sha256"))
    return stripped.unionByName(rest).withColumn("doc_id", F.col("doc_id").cast(kind))
