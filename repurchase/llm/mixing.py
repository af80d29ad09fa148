"""Mixing sources to target weights by temperature.

A source with token share p gets weight p**a / sum(p**a). The exponent a is
bisected in [0, 1] to the flattest mix that repeats no source more than
``repeat_limit`` times as often as the least repeated one, or to the mix whose
entropy (in nats) is ``entropy``. The budget gives the least repeated source exactly one
pass, so every document is read at least once; a source then needs
``passes = (w / p) / min(w / p)`` passes over its documents.

Each source is cut into hashed blocks of about ``block_docs`` documents. Every
pass over a block is a new permutation of it, and the last, partial pass stops
where the block's token budget is spent (a document counts if half of it still
fits). ``slot`` (0 to 1) says where in the source's budget a copy is read:
reading all copies by slot keeps the weights at every point.

A null source is a source of its own. Documents without tokens are kept once
and have no weight; a source without tokens too. Rows that repeat a document
are scheduled each. A block is chosen by id, text hash and, among rows alike in
both, their number, so rows of one null or repeated id spread over all blocks of
their source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, words

REPEAT_LIMIT = 4.0
BLOCK_DOCS = 500
ROUNDS = 8
CUTS = 32  # exponents tried in one pass over the sources: five halvings
PORTION = 4096  # equal rows written by one row of their portions


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and a hash that tells repeated ids apart."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("n_tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("_tie"))


def numbered(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``_copy``, 0, 1, ... among equal rows. Equal rows are
    counted with map-side combine; counts beyond ``PORTION`` are dealt to all
    tasks in portions before they are written out again."""
    counts = tokens.groupBy("doc_id", "source", "n_tokens", "_tie").agg(F.count(F.lit(1)).alias("_n"))
    few = counts.where(F.col("_n") <= PORTION).withColumn("_first", F.lit(0).cast("long"))
    many = counts.where(F.col("_n") > PORTION).withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(PORTION).cast("long"))))
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = few.unionByName(many.repartition(tasks, "_tie", "_first"))
    last = F.least(F.col("_first") + PORTION, F.col("_n")) - 1
    return rows.withColumn("_copy", F.explode(F.sequence("_first", last))).drop("_n", "_first")


def _exponent(sources: DataFrame, repeat_limit: float | None, entropy: float | None) -> float:
    """Bisection. Both the largest repetition and the entropy fall as the
    exponent grows; each round reads one row of sums for 31 exponents."""
    low, high = 0.0, 1.0
    shares = sources.where("p > 0")
    widest = 1.0 if entropy is not None else shares.agg(F.max(F.col("p_max") / F.col("p"))).first()[0] or 1.0
    for _ in range(ROUNDS):
        tries = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        if entropy is None:
            fits = [widest ** (1 - a) <= repeat_limit for a in tries]
        else:
            cells = []
            for a in tries:
                q = F.pow("p", F.lit(a))
                cells += [F.sum(q), F.sum(q * F.log(q))]
            row = shares.agg(*cells).first()
            values = [0.0 if row[2 * i] is None else math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] for i in range(len(tries))]
            fits = [v <= entropy for v in values]
        at = next((i for i, ok in enumerate(fits) if ok), CUTS)
        if at == 0:
            return tries[0]
        low, high = tries[at - 1], tries[at]
    return high


def source_weights(tokens: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, entropy: float | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """source, n_docs, n_tokens, p, weight, passes, n_blocks."""
    counts = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    counts = stash(counts, "mix-sources")
    total = counts.agg(F.sum("n_tokens").alias("all"), F.max("n_tokens").alias("most")).first()
    everything, most = float(total["all"] or 0) or 1.0, float(total["most"] or 0)
    shares = counts.withColumns({"p": F.col("n_tokens") / F.lit(everything), "p_max": F.lit(most / everything)})
    a = _exponent(shares, repeat_limit, entropy)
    norm = shares.where("p > 0").agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / F.lit(norm)).otherwise(0.0)
    passes = F.when(F.col("p") > 0, F.round(F.pow(F.col("p_max") / F.col("p"), F.lit(1 - a)), 6)).otherwise(1.0)
    blocks = F.ceil(F.col("n_docs") / F.lit(block_docs)).cast("long")
    return shares.select("source", "n_docs", "n_tokens", "p", weight.alias("weight"), passes.alias("passes"), blocks.alias("n_blocks"))


def schedule(docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, entropy: float | None = None, block_docs: int = BLOCK_DOCS, seed: int = 42) -> DataFrame:
    """One row per copy of a document to read: doc_id, source, n_tokens,
    epoch, block, weight (of its source), slot."""
    tokens = stash(numbered(token_rows(docs)), "mix-tokens")
    weights = source_weights(tokens, repeat_limit, entropy, block_docs)
    plan = weights.select(F.col("source").alias("_source"), "weight", "passes", "n_blocks")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_tie", "_copy")
    rows = tokens.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("block", F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.col("n_blocks")))
    needed = F.when(F.col("n_tokens") > 0, F.ceil("passes")).otherwise(1).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), needed - 1)))
    rows = rows.withColumn("_at", F.md5(F.concat_ws(":", F.col("epoch"), key)))
    part = Window.partitionBy("source", "block", "epoch")
    order = part.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_sum": F.sum("n_tokens").over(part), "_end": F.sum("n_tokens").over(order)})
    before = F.col("_end") - F.col("n_tokens")
    fits = before + F.col("n_tokens") / 2 <= (F.col("passes") - F.col("epoch")) * F.col("_sum")
    rows = rows.where((F.col("epoch") < F.floor("passes")) | (F.col("epoch") == 0) | fits)
    slot = (F.col("epoch") + F.coalesce(before / F.when(F.col("_sum") > 0, F.col("_sum")), F.lit(0.0))) / F.col("passes")
    return rows.select("doc_id", "source", "n_tokens", "epoch", "block", F.round("weight", 9).alias("weight"), F.round(slot, 9).alias("slot"))
