"""Repeated windows across whole corpora, shared by the two substring
de-duplicators.

A text is a run of units (bytes or words); a window is ``window`` consecutive
units. Each window belongs to an anchor: the least hashed gram of ``gram``
units in it, the leftmost of equals. Equal windows have equal anchors at the
same offset, so windows need to meet only those of their anchor's gram. The
windows of one anchor in one text form a piece: a stretch of the text.

1. Grams that anchor one piece only cannot repeat and are left.
2. Equal pieces are counted, so that each enters an index once, with its
   number of copies as the weight of its windows.
3. All different pieces of one gram go to one shard, where an index (the
   caller's ``solve``) tells which windows weigh two or more together. Pieces
   that are the only ones of their gram meet no others; neighbours of one text
   enter as one stretch, which holds each window once.
4. A gram with more than ``HOT`` different pieces (the ends of a passage in
   very many texts) is split by whole windows, whose weights are summed by
   hash without an index; so no shard grows with it.
5. The runs of repeated windows return to their texts.

Rows are told apart by id and text hash; repeated rows count as places of
their own. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

HOT = 2000
#: Windows of a stretch of neighbouring pieces.
STRETCH = 1 << 16
#: Pieces' units that one index holds.
SHARD_UNITS = 1 << 20
_ODD = 0x9E3779B97F4A7C15
#: How a piece meets others of its gram: there are none, in a shard, by window.
_ALONE, _MIXED, _HOT = 0, 1, 2
#: (pieces, weight of each of their windows, window) -> whether each window's
#: occurrences in all pieces weigh two or more.
Solve = Callable[[list[bytes], np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Units:
    """How a text falls into units: ``values`` (a number for each unit),
    ``cut`` (bytes of a run of units) and ``count`` of a run's bytes."""

    split: Callable[[bytes], object]
    values: Callable[[object], np.ndarray]
    cut: Callable[[object, int, int], bytes]
    window: int
    gram: int


def rolling(values: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q units from each place, by doubling."""
    part, size, whole, done = values.astype(np.uint64) + np.uint64(1), 1, None, 0
    if len(part) < q:
        return np.empty(0, np.uint64)
    while done < q:
        shift = np.uint64(pow(_ODD, size, 1 << 64))
        if q & size:
            whole = part if whole is None else whole[: len(part) - done] * shift + part[done:]
            done += size
        part, size = part[:-size] * shift + part[size:] if len(part) > size else part[:0], size * 2
    whole = whole ^ (whole >> np.uint64(31))
    whole = whole * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each ``w`` consecutive ones."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    grid = np.concatenate([x, pad]).reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchors(values: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and gram hash of each piece."""
    if len(values) < window:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64)
    h = rolling(values, gram)
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | place, window - gram + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, len(at)]), h[at[first]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (as text, so that pandas keeps nulls and large ids), the text
    and the hash that tells rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _piece_rows(units: Units):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for d, m, t in zip(b["doc_id"], b["mark"], b["text"], strict=True):
                u = units.split(t.encode())
                first, n, gram = anchors(units.values(u), units.window, units.gram)
                body = np.fromiter((xxhash.xxh3_64_intdigest(units.cut(u, s, s + k + units.window - 1)) for s, k in zip(first.tolist(), n.tolist(), strict=True)), np.uint64, len(first))
                parts.append((d, m, first, n, gram, body))
            size = [len(p[2]) for p in parts]
            join = lambda i, kind: np.concatenate([*(p[i] for p in parts), np.empty(0, kind)])
            yield pd.DataFrame(
                {
                    "doc_id": np.repeat(b["doc_id"].to_numpy(), size),
                    "mark": np.repeat(b["mark"].to_numpy(), size),
                    "first": join(2, np.int64).astype(np.int32),
                    "n": join(3, np.int64).astype(np.int32),
                    "gram": _signed(join(4, np.uint64)),
                    "body": _signed(join(5, np.uint64)),
                }
            )

    return run


def _fetch(units: Units):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, first, n, gram, body, copies, how in zip(*(b[c] for c in ("text", "first", "n", "gram", "body", "copies", "how")), strict=True):
                u = units.split(t.encode())
                # Neighbouring pieces without others of their gram are one stretch.
                joined = (how[1:] == _ALONE) & (how[:-1] == _ALONE) & (first[1:] == first[:-1] + n[:-1])
                head = np.r_[True, ~joined]
                part = (first - first[np.maximum.accumulate(np.where(head, np.arange(len(first)), 0))]) // STRETCH
                at = np.flatnonzero(head | np.r_[True, part[1:] != part[:-1]])
                for x, y in zip(at.tolist(), [*at[1:].tolist(), len(first)], strict=True):
                    piece = units.cut(u, int(first[x]), int(first[y - 1] + n[y - 1]) + units.window - 1)
                    rows.append((gram[x], body[x], how[x], gram[x:y], body[x:y], n[x:y], copies[x:y], piece))
            yield pd.DataFrame(rows, columns=["gram", "body", "how", "grams", "bodies", "sizes", "copies", "piece"])

    return run


def _shard(units: Units, solve: Solve):
    """Rows come sorted by gram; whole grams are indexed together."""

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        gram, body, size, copies = (np.concatenate(rows[c].to_list()) for c in ("grams", "bodies", "sizes", "copies"))
        flags = solve(rows["piece"].to_list(), np.repeat(copies, size), units.window)
        end = np.cumsum(size)
        kind = np.repeat(np.arange(len(size)), size)
        edge = np.zeros(len(flags) + 1, bool)
        edge[0] = edge[end] = True
        low = np.flatnonzero(flags & (edge[:-1] | np.r_[True, ~flags[:-1]]))
        high = np.flatnonzero(flags & (edge[1:] | np.r_[~flags[1:], True])) + 1
        k = kind[low]
        start = (end - size)[k]
        return pd.DataFrame({"gram": gram[k], "body": body[k], "low": (low - start).astype(np.int32), "high": (high - start).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            if size > SHARD_UNITS and b["gram"].iloc[0] != held[-1]["gram"].iloc[-1]:
                yield out(pd.concat(held, ignore_index=True))
                held, size = [], 0
            held.append(b)
            size += int(b["piece"].map(len).sum())
            if size > SHARD_UNITS:
                gram = b["gram"].to_numpy()
                cut = int(np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])[-1])
                if cut:
                    held[-1] = b.iloc[:cut]
                    yield out(pd.concat(held, ignore_index=True))
                    held, size = [b.iloc[cut:]], int(b["piece"].iloc[cut:].map(len).sum())
        if held:
            yield out(pd.concat(held, ignore_index=True))

    return run


def _single_windows(units: Units):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, body, n, copies, piece in zip(b["gram"], b["body"], b["n"], b["copies"], b["piece"], strict=True):
                u = units.split(piece)
                rows += [(g, body, k, copies, *divmod(xxhash.xxh3_128_intdigest(units.cut(u, k, k + units.window)), 1 << 64)) for k in range(n)]
            out = pd.DataFrame(rows, columns=["gram", "body", "low", "copies", "h1", "h2"])
            out["h1"], out["h2"] = (_signed(np.array(out[c].tolist(), np.uint64)) for c in ("h1", "h2"))
            yield out

    return run


def repeated(docs: DataFrame, units: Units, solve: Solve) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): the stored rows of ``keyed`` that share a gram with
    another piece, and (doc_id, mark, runs) with the runs of repeated windows
    (first window, end) of each."""
    rows = keyed(docs)
    every = rows.mapInPandas(_piece_rows(units), "doc_id string, mark long, first int, n int, gram long, body long")
    every = stash(every, "all-pieces")
    # Stored before the join, so that Spark may split a frequent gram's rows.
    grams = stash(every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "grams")
    pieces = stash(every.join(grams, "gram"), "pieces")
    place = F.struct("doc_id", "mark", "first")
    kinds = pieces.groupBy("gram", "body").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at"), F.first("n").alias("n"))
    kinds = stash(kinds, "piece-kinds")
    many = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    many = stash(many.select("gram", F.when(F.col("kinds") > HOT, _HOT).otherwise(_MIXED).alias("how")), "mixed-grams")
    kinds = kinds.join(many, "gram", "left").withColumn("how", F.coalesce("how", F.lit(_ALONE)))
    fields = ("first", "n", "gram", "body", "copies", "how")
    wanted = kinds.select("*", "at.doc_id", "at.mark", "at.first").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("wanted"))
    shared = pieces.select("doc_id", "mark").distinct().join(wanted.withColumnsRenamed({"doc_id": "_id", "mark": "_m"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m")), "left")
    shared = shared.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"), "wanted")
    texts = rows.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m"))).drop("_id", "_m")
    texts = stash(texts, "shared-texts")
    # Repeated rows of one id and text hold the same pieces: one of them serves.
    source = texts.where(F.col("wanted").isNotNull()).select("text", *(F.col(f"wanted.{x}").alias(x) for x in fields))
    held = "gram long, body long, how int, grams array<long>, bodies array<long>, sizes array<int>, copies array<long>, piece binary"
    bodies = stash(source.mapInPandas(_fetch(units), held).dropDuplicates(["gram", "body"]), "piece-bodies")
    shard = bodies.where(F.col("how") != _HOT).drop("how").repartition("gram").sortWithinPartitions("gram", "body")
    found = shard.mapInPandas(_shard(units, solve), "gram long, body long, low int, high int")
    single = bodies.where(F.col("how") == _HOT).select("gram", "body", F.col("sizes")[0].alias("n"), F.col("copies")[0].alias("copies"), "piece")
    single = stash(single.mapInPandas(_single_windows(units), "gram long, body long, low int, copies long, h1 long, h2 long"), "hot-windows")
    twice = single.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).where("c > 1")
    single = single.join(twice, ["h1", "h2"]).select("gram", "body", "low", (F.col("low") + 1).alias("high"))
    runs = stash(found.unionByName(single), "repeated-windows")
    hits = pieces.join(runs, ["gram", "body"]).select("doc_id", "mark", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    hits = hits.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("runs"))
    return texts, hits


def covered(low: np.ndarray, high: np.ndarray, n_units: int, window: int) -> np.ndarray:
    """Flags of the units that repeated windows cover."""
    edge = np.bincount(low, minlength=n_units + 1) - np.bincount(high - 1 + window, minlength=n_units + 1)
    return np.cumsum(edge[:-1]) > 0


def with_runs(docs: DataFrame, units: Units, solve: Solve) -> tuple[DataFrame, DataFrame]:
    """(hit, hits): rows doc_id, text, low, high (arrays: the runs) of all
    texts with repeats; and their ids and hashes as _id, _m."""
    texts, hits = repeated(docs, units, solve)
    hits = stash(hits, "runs").withColumnsRenamed({"doc_id": "_id", "mark": "_m"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m"))
    hit = texts.select("doc_id", "mark", "text").join(hits, same)
    return hit.select("doc_id", "text", F.col("runs.low").alias("low"), F.col("runs.high").alias("high")), hits


def window_places(size: np.ndarray, window: int) -> np.ndarray:
    """Places of all windows of pieces of these sizes, each followed by one
    separator."""
    n = size - window + 1
    start = np.cumsum(size + 1) - size - 1
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
