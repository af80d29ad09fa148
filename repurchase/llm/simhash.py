"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprint: majority bits of the XXH64 of a text's word shingles. Documents
link at ``MAX_BITS`` or fewer differing bits; a group is a connected component.

Two fingerprints at 3 bits agree on at least one of four 16-bit blocks. Each
distinct fingerprint is dealt four times, turned so that block r leads, to the
segment (r, leading block). A segment is sorted by Gray rank (neighbours in
that order differ in few bits) and indexed bottom up: a node keeps the mask of
bits on which all below it agree, and their values; the segment's root carries
the leading block. A search walks down, adds up differences under each node's
mask and drops the whole node beyond 3. Segments of more than ``SEGMENT`` rows
are cut into parts, and each pair of parts is one segment of its own, so none
is dropped or grows. A task returns a spanning forest of the links it finds.

Null and empty texts and texts of white space have fingerprint zero and link
like others. Repeated rows keep a row each; a null id counts as no id for the
component's name (null if the component has no other).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stash
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENT = 16_384
FAN = 8  # children of an index node
PAIRS = 1 << 21  # search pairs held at once
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        grams = zip(*(part[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
        h = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    """Fingerprints as signed 64-bit integers."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of(text)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in reflected Gray order."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def build_index(codes: np.ndarray, segment: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the leaves up: (mask, value, first child, end child) of
    each node. Rows are sorted by segment, then Gray rank; nodes never cross
    segments, and the last level has one node for each segment."""
    mask, value, seg = np.full(len(codes), ~np.uint64(0)), codes, segment
    levels = [(mask, value, np.arange(len(codes)), np.arange(len(codes)) + 1)]
    while True:
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        if len(first) == len(seg):
            return levels
        within = np.arange(len(seg)) - np.repeat(first, np.diff(np.r_[first, len(seg)]))
        start = np.flatnonzero(within % FAN == 0)
        ones, zeros = np.bitwise_and.reduceat(value | ~mask, start), np.bitwise_or.reduceat(value & mask, start)
        mask = np.bitwise_and.reduceat(mask, start) & ~(ones ^ zeros)
        value, seg = zeros & mask, seg[start]
        levels.append((mask, value, start, np.r_[start[1:], len(within)]))


def _expand(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = end - first
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]


def search(codes: np.ndarray, segment: np.ndarray, bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows of one segment within ``bits`` bits."""
    levels = build_index(codes, segment)
    last = [np.arange(len(codes))]  # of each node, its last row
    for _, _, _, end in levels[1:]:
        last.append(last[-1][end - 1])
    root = np.cumsum(np.r_[0, segment[1:] != segment[:-1]])
    stack = [(len(levels) - 1, np.arange(len(codes)), root)]
    while stack:
        at, query, node = stack.pop()
        if len(query) > PAIRS // FAN:
            half = len(query) // 2
            stack += [(at, query[half:], node[half:]), (at, query[:half], node[:half])]
            continue
        mask, value, first, end = levels[at]
        near = np.bitwise_count((codes[query] ^ value[node]) & mask[node]) <= bits
        near &= last[at][node] > query
        query, node = query[near], node[near]
        if at == 0:
            if len(query):
                yield query, node
        elif len(query):
            owner, child = _expand(first[node], end[node])
            stack.append((at - 1, query[owner], child))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def spanning(codes: np.ndarray, segment: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """For each row, the root row of its component by the links found."""
    parent = np.arange(len(codes))
    for i, j in search(codes, segment, bits):
        while len(i):
            i, j = _roots(parent, i), _roots(parent, j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
            parent = parent[parent]
    return _roots(parent, np.arange(len(codes)))


def _links(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Batches come sorted by segment and Gray rank."""

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["turned"].to_numpy().view(np.uint64)
        seg = rows["segment"].to_numpy()
        root = spanning(codes, np.cumsum(np.r_[0, seg[1:] != seg[:-1]]), bits)
        fp = rows["fp"].to_numpy()
        far = root != np.arange(len(root))
        return pd.DataFrame({"a": fp[far], "b": fp[root[far]]})

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        # The last segment of a batch may go on in the next one.
        seg = b["segment"].to_numpy()
        cut = int(np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])[-1])
        if held and held[-1]["segment"].iloc[-1] != seg[0]:
            yield out(pd.concat(held, ignore_index=True))
            held = []
        if cut:
            yield out(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield out(pd.concat(held, ignore_index=True))


def _turned(fp: Column, r: Column) -> Column:
    s = r * 16
    return F.when(r == 0, fp).otherwise(F.call_function("shiftleft", fp, s).bitwiseOR(F.call_function("shiftrightunsigned", fp, 64 - s)))


def _gray(code: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints ``fp``."""
    if bits > 3:
        raise ValueError("four blocks serve up to 3 bits")
    dealt = fps.select("fp", F.explode(F.array(*map(F.lit, range(4)))).alias("r"))
    dealt = dealt.withColumn("turned", _turned(F.col("fp"), F.col("r")))
    dealt = stash(dealt.withColumn("lead", F.shiftrightunsigned("turned", 48) * 4 + F.col("r")), "turned")
    # Parts of each oversized segment; few rows, and none where sizes are even.
    hot = dealt.groupBy("lead").count().where(F.col("count") > SEGMENT)
    hot = stash(hot.select("lead", F.ceil(F.col("count") / (SEGMENT // 2)).cast("int").alias("parts")), "hot-leads")
    dealt = dealt.join(hot, "lead", "left")
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda i: i != part))
    rows = dealt.withColumn("other", F.explode(other))
    segment = F.when(F.col("parts").isNull(), F.col("lead")).otherwise(F.xxhash64("lead", F.least(part, F.col("other")), F.greatest(part, F.col("other"))))
    rows = rows.select("fp", "turned", segment.alias("segment"))
    rows = rows.repartition("segment").sortWithinPartitions("segment", _gray(F.col("turned")))
    return rows.mapInPandas(lambda batches: _links(batches, bits), "a long, b long")


def group_rows(rows: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) from stored rows (doc_id, fp)."""
    fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(links(fps.select("fp"), bits))
    named = stash(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return stash(named.join(stash(names, "names"), "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id; one row for each of ``docs``."""
    rows = stash(docs.select("doc_id", fingerprints(F.col("text"), size).alias("fp")), "simhash")
    groups = group_rows(rows, bits)
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` with one row of each group: that of least id, and of
    least text hash among repeated ids. Columns are unchanged."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", mark.alias("_mark"), fingerprints(F.col("text"), size).alias("fp"))
    rows = stash(rows, "simhash")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_mark")).alias("pick")
    best = rows.join(group_rows(rows, bits), "fp").groupBy("root").agg(pick)
    own, ident, least = (free_name(docs, x) for x in ("_mark", "_id", "_least"))
    best = best.select(F.col("pick.doc_id").alias(ident), F.col("pick._mark").alias(least))
    marked = docs.withColumn(own, mark)
    kept = marked.join(best, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(least)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)
