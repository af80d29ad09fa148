"""Prefix trie of conversations, settled by time-forward processing.

Turns are told apart by hashes: a prefix is the XOR of 64-bit hashes of (place,
role, text), twice over with other seeds, which running XORs give for every
prefix without gathering a conversation (``positions``). Rows with one prefix
are one node; its name is (depth, smallest member).

Totals of a subtree travel upwards in reverse level order. Nodes are dealt to
shards of ``SHARD_IDS`` neighbouring conversation ids by ``SHARD_IDS`` levels,
sorted by falling depth (Spark sorts outside memory), and read once: each node
takes the messages addressed to it from a priority queue, adds its own share and
sends the sum to its parent. The queue holds ``QUEUE`` messages and writes sorted
runs to a file of its own beyond that. Totals for parents in other shards are
added up for each shard and parent. These shard roots form a smaller tree, which
pointer doubling settles in as many rounds as its depth has binary digits; its
totals are then handed to the parents and the shards are read once more.

Turns are ordered by turn (null first), ties by a hash of role and text; a
null role or text is empty. Rows without conv_id belong to no conversation and
are left out. Repeated rows are turns of their own. The remainder of a negative
id is negative, as in SQL. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, words
from .positions import number_rows

BLOCK = 20
HEADS = 4
SHARD_IDS = 1024
QUEUE = 1 << 16
CHUNK_IDS = 4096


def turn_rows(convs: DataFrame) -> DataFrame:
    """conv_id, pos, digest (of role and text) and n_words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.md5(role), F.md5(text))).alias("digest"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("seq"),
    )
    placed = number_rows(stash(rows, "trie-turns"), "conv_id", ("turn", "digest", "seq"), drop=("turn", "seq"), name="trie-places")
    return placed.select("conv_id", F.col("_pos").alias("pos"), "digest", "n_words")


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) rebuilt: the first h turns of conversation
    c - c % block, then c's own after its first h; h = crc32(c) % heads.
    Conversations come as (conv_id, total); turns as turns, with ``total``."""
    sizes = stash(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    convs = sizes.select(
        "conv_id",
        "n",
        (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % block).alias("base"),
    )
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = convs.withColumn("taken", taken).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stash(convs, "trie-convs")
    # At most heads - 1 rows a conversation, for at most block conversations.
    opening = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base")
    opening = convs.join(opening, "base").where("pos < h").select("conv_id", "pos", "digest", "n_words", "total")
    own = turns.join(convs, "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_words", "total")
    return convs.select("conv_id", "total"), opening.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Each rebuilt turn with its depth, prefix (x, y) and parent prefix."""
    hashed = turns.withColumns({"a": F.xxhash64("pos", "digest"), "b": F.xxhash64(F.lit("b"), "digest", "pos")})
    hashed = stash(hashed.drop("digest"), "trie-rebuilt")
    rows = number_rows(hashed, "conv_id", ("pos",), ("a", "b"), name="trie-prefixes")
    return rows.select(
        "conv_id",
        "n_words",
        (F.col("pos") + 1).alias("depth"),
        F.col("_run_a").alias("x"),
        F.col("_run_b").alias("y"),
        F.col("_run_a").bitwiseXOR(F.col("a")).alias("up_x"),
        F.col("_run_b").bitwiseXOR(F.col("b")).alias("up_y"),
        (F.col("pos") + 1 == F.col("total")).alias("ends"),
    )


def node_rows(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, conv_id, x, y, parent_conv_id, n_convs, n_words, n_children."""
    per = rows.groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("n_words").alias("n_words"),
        F.max("up_x").alias("up_x"),
        F.max("up_y").alias("up_y"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("n_words"), zero.alias("up_x"), zero.alias("up_y"))
    nodes = stash(per.unionByName(root), "trie-nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    named = stash(nodes.join(up, ["depth", "up_x", "up_y"], "left").drop("up_x", "up_y"), "trie-named")
    kids = named.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return stash(named.join(kids, ["depth", "conv_id"], "left").fillna(0, ["n_children"]), "trie-family")


class SpillingQueue:
    """Priority queue of tuples that holds ``limit`` of them in memory.

    Beyond that the later half is written as a sorted run to a file that only
    this task sees and that goes with it (like Spark's own spills); the heads of
    the runs stand in the heap. A task that is run again starts anew.
    """

    READ = 256

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.spills = max(2, limit), [], 0
        self.runs: list[Iterator[tuple]] = []
        self._file = None

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, (item, -1))
        if len(self.heap) > self.limit + len(self.runs):
            self._spill()

    def _spill(self) -> None:
        # Heads of runs stay; the greater half of the other items leaves.
        own = sorted(item for item, run in self.heap if run < 0)
        cut = len(own) // 2
        if self._file is None:
            self._file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self._file.seek(0, os.SEEK_END)
        places = []
        for at in range(cut, len(own), self.READ):
            places.append(self._file.tell())
            pickle.dump(own[at : at + self.READ], self._file)
        self.heap = [(item, -1) for item in own[:cut]] + [h for h in self.heap if h[1] >= 0]
        self.runs.append(self._read(places))
        self.spills += 1
        heapq.heapify(self.heap)
        self._refill(len(self.runs) - 1)

    def _read(self, places: list[int]) -> Iterator[tuple]:
        for place in places:
            self._file.seek(place)
            yield from pickle.load(self._file)

    def _refill(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heap, (item, run))

    def peek(self) -> tuple | None:
        return self.heap[0][0] if self.heap else None

    def pop(self) -> tuple:
        item, run = heapq.heappop(self.heap)
        if run >= 0:
            self._refill(run)
        return item

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def with_shards(nodes: DataFrame, ids: int = SHARD_IDS) -> DataFrame:
    """Adds the node's shard (c, d) and whether its parent is in it too."""
    own = {"c": F.expr(f"conv_id div {ids} - if(conv_id % {ids} < 0, 1, 0)"), "d": F.expr(f"depth div {ids}")}
    up = F.expr(f"parent_conv_id div {ids} - if(parent_conv_id % {ids} < 0, 1, 0)")
    nodes = nodes.withColumns(own)
    inside = (F.col("depth") > 0) & (up == F.col("c")) & (F.expr(f"(depth - 1) div {ids}") == F.col("d"))
    return nodes.withColumn("inside", inside)


def _forward(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """One pass over nodes sorted by (c, d, falling depth, conv_id)."""
    shard, queue = None, SpillingQueue(limit)
    for b in batches:
        leaves, saved = b["n_leaves"].to_numpy(copy=True), b["saved_tokens"].to_numpy(copy=True)
        columns = (b[x].to_numpy() for x in ("c", "d", "depth", "conv_id", "parent", "inside"))
        for i, (c, d, depth, conv, parent, inside) in enumerate(zip(*columns, strict=True)):
            if (c, d) != shard:
                queue.close()
                shard, queue = (c, d), SpillingQueue(limit)
            here = (-int(depth), int(conv))
            while queue.heap and queue.peek()[:2] == here:
                _, _, more_leaves, more_saved = queue.pop()
                leaves[i] += more_leaves
                saved[i] += more_saved
            if inside:
                queue.push((1 - int(depth), int(parent), int(leaves[i]), int(saved[i])))
        yield b.assign(n_leaves=leaves, saved_tokens=saved)
    queue.close()


def _top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes sorted by (c, d, depth, conv_id): each learns the outside parent
    (top_depth, top_conv) of its shard's tree; the trie's root has (-1, 0). Only
    the level above is held: at most one node for each id of a shard."""
    shard = level = None
    above: dict[int, tuple[int, int]] = {}
    here: dict[int, tuple[int, int]] = {}
    for b in batches:
        out = []
        columns = (b[x].to_numpy() for x in ("c", "d", "depth", "conv_id", "parent", "inside"))
        for c, d, depth, conv, parent, inside in zip(*columns, strict=True):
            if (c, d) != shard:
                shard, level, above, here = (c, d), depth, {}, {}
            elif depth != level:
                above, here, level = here, {}, depth
            here[conv] = above[parent] if inside else (int(depth) - 1, int(parent))
            out.append(here[conv])
        yield b[["c", "d", "depth", "conv_id"]].assign(top_depth=[t[0] for t in out], top_conv=[t[1] for t in out])


def _by_shard(nodes: DataFrame, run: Callable, schema: str, falling: bool) -> DataFrame:
    depth = F.desc("depth") if falling else F.asc("depth")
    rows = nodes.withColumn("parent", F.coalesce("parent_conv_id", F.lit(0).cast("long")))
    rows = rows.select("c", "d", "depth", "conv_id", "parent", "inside", "n_leaves", "saved_tokens")
    return rows.repartition("c", "d").sortWithinPartitions("c", "d", depth, "conv_id").mapInPandas(run, schema)


_NODE = "c long, d long, depth long, conv_id long, parent long, inside boolean, n_leaves long, saved_tokens long"


def _across(roots: DataFrame, tops: DataFrame) -> DataFrame:
    """Whole totals of shard roots, by (up_depth, up_conv), the parent they go to.

    ``roots``: shard (c, d), parent (up_depth, up_conv) and the shard's own
    totals. A root hangs below the root of its parent's shard. Doubling: the sum
    over descendants nearer than 2**k steps, and the ancestor at 2**k steps."""
    ident = F.struct("c", "d", "up_depth", "up_conv")
    met = roots.join(tops.select(F.col("c").alias("pc"), F.col("d").alias("pd"), F.col("depth").alias("up_depth"), F.col("conv_id").alias("up_conv"), "top_depth", "top_conv"), ["up_depth", "up_conv"])
    over = F.when(F.col("top_depth") >= 0, F.struct(F.col("pc").alias("c"), F.col("pd").alias("d"), F.col("top_depth").alias("up_depth"), F.col("top_conv").alias("up_conv")))
    state = stash(met.select(ident.alias("id"), over.alias("up"), "n_leaves", "saved_tokens"), "trie-roots")
    while not state.where("up is not null").isEmpty():
        sent = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        grown = state.join(sent, "id", "left").join(jump, "up", "left")
        plus = lambda x, more: (F.col(x) + F.coalesce(more, F.lit(0).cast("long"))).alias(x)
        state = stash(grown.select("id", F.col("next").alias("up"), plus("n_leaves", "more_leaves"), plus("saved_tokens", "more_saved")), "trie-roots")
    return state.groupBy(F.col("id.up_depth").alias("depth"), F.col("id.up_conv").alias("conv_id")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))


def settle(nodes: DataFrame, ids: int = SHARD_IDS, limit: int = QUEUE) -> DataFrame:
    """(depth, conv_id, n_leaves, saved_tokens) over whole subtrees, from
    stored nodes (depth, conv_id, parent_conv_id, n_leaves, saved_tokens)."""
    forward = lambda batches: _forward(batches, limit)
    dealt = with_shards(nodes, ids)
    first = stash(_by_shard(dealt, forward, _NODE, True), "trie-shards")
    tops = stash(_by_shard(dealt, _top, "c long, d long, depth long, conv_id long, top_depth long, top_conv long", False), "trie-tops")
    roots = first.where("depth > 0 and not inside").groupBy("c", "d", (F.col("depth") - 1).alias("up_depth"), F.col("parent").alias("up_conv"))
    roots = stash(roots.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "trie-shard-roots")
    more = _across(roots, tops)
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0).cast("long"))
    fed = dealt.join(more, ["depth", "conv_id"], "left").withColumns({"n_leaves": plus("n_leaves", "more_leaves"), "saved_tokens": plus("saved_tokens", "more_saved")})
    return _by_shard(fed, forward, _NODE, True).select("depth", "conv_id", "n_leaves", "saved_tokens")


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Runs of up to ``size`` ids of one node, in order, as text."""
    for b in batches:
        keys = b[["depth", "x", "y"]].to_numpy()
        ids = b["conv_id"].tolist()
        starts = [*np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(ids)] if len(ids) else []
        out, lo = [], 0
        for hi in starts:
            for at in range(lo, hi, size):
                out.append((*keys[at], ids[at], ",".join(map(str, ids[at : min(at + size, hi)]))))
            lo = hi
        yield pd.DataFrame(out, columns=["depth", "x", "y", "first", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks, joined by commas; rows come sorted."""
    key, state = None, None
    for b in batches:
        out = []
        for depth, x, y, ids in zip(b["depth"], b["x"], b["y"], b["ids"], strict=True):
            if (depth, x, y) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "x", "y", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "x", "y", "ends_sha256"])


def end_digests(rows: DataFrame, convs: DataFrame, size: int = CHUNK_IDS) -> DataFrame:
    """(depth, x, y, ends_sha256) of nodes at which conversations end. Ids are
    cut into ordered chunks in range partitions first, so that the one task that
    must hash a frequent node's list reads chunks, one at a time."""
    zero = F.lit(0).cast("long")
    ends = rows.where("ends").select("depth", "x", "y", "conv_id")
    none = convs.where("total = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id")
    ends = stash(ends.unionByName(none), "trie-ends")
    keys = ("depth", "x", "y")
    dealt = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    chunks = dealt.mapInPandas(lambda batches: _chunks(batches, size), "depth long, x long, y long, first long, ids string")
    chunks = chunks.repartition(*keys).sortWithinPartitions(*keys, "first")
    return chunks.mapInPandas(_digests, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(convs: DataFrame, block: int = BLOCK, heads: int = HEADS, ids: int = SHARD_IDS, limit: int = QUEUE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    people, turns = rebuilt(turn_rows(convs), block, heads)
    rows = prefixes(turns)
    nodes = node_rows(rows, people)
    own = nodes.select("depth", "conv_id", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"))
    totals = settle(own, ids, limit)
    ends = end_digests(rows, people)
    out = nodes.join(totals, ["depth", "conv_id"]).join(ends, ["depth", "x", "y"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
