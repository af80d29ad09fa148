"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's word
shingles, ascending. Sketches of parts merge into the sketch of the whole
(``merge``), and two sketches estimate resemblance, containment and the
number of distinct shingles. Everything here is a Spark expression.

Null or empty texts, and texts of white space, have an empty sketch; a text
shorter than a shingle has one hash, of all its words. Two empty sketches
resemble each other fully, an empty and a filled one not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.plans.ranges import bucket_of, range_bounds

from .common import free_name, let, words

K = 128
SHINGLE = 5
#: Documents a range bucket of ``with_next`` should hold on average.
BUCKET_DOCS = 1000
MOST_RANGES = 4096  # beyond some four million documents, ranges grow
_SPAN = float(2**64)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(
            F.size(h) >= size,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, size))),
        )
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return bottom(shingle_hashes(text, size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    reach = (F.element_at(s, -1).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(float(k - 1)) / F.greatest(reach, F.lit(1 / _SPAN)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both texts."""
    return let(
        merge(a, b, k),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)),
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too (0 to 1)."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def digest(s: Column) -> Column:
    """Text form of a sketch: base64 of its hashes, eight bytes each."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\r\n", "")


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per group, merged over all its rows. A hot group is first
    reduced within ``salts`` parts; each keeps at most ``k`` hashes."""
    hashes = df.select(*keys, F.explode(sketch_col).alias("_h")).distinct().withColumn("_salt", F.pmod("_h", F.lit(salts)))
    for part in (["_salt"], []):
        order = Window.partitionBy(*keys, *part).orderBy("_h")
        hashes = hashes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    return hashes.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def with_next(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``next_<c>`` for each carried column: the value of the document
    that follows by descending id (null ids last; after the last, the first).

    Rows are dealt into ranges between quantiles of (id, text hash) taken from
    the rows and sorted there, so no task sorts the whole table, whatever the
    ids' type and spread and however many rows share one or have none; the last
    row of each range then takes its values from the first one of the range that
    follows. Repeated ids follow each other by text hash; only rows that share
    both stay together.
    """
    bucket_col, tie, up, down, nxt = (free_name(docs, c) for c in ("_bucket", "_tie", "_up", "_down", "_next"))
    keyed = docs.withColumn(tie, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    known, none = keyed.where(F.col(id_col).isNotNull()), keyed.where(F.col(id_col).isNull())
    n = docs.count()
    parts = max(1, min(MOST_RANGES, n // BUCKET_DOCS))
    # Ids come in falling order, so the rows without one are the lowest ranges.
    low, high = range_bounds(none, [tie], parts), range_bounds(known, [id_col, tie], parts)
    bucket = F.when(F.col(id_col).isNull(), bucket_of(keyed, [tie], low)).otherwise(bucket_of(keyed, [id_col, tie], high) + len(low) + 1)
    rows = keyed.withColumn(bucket_col, bucket)
    order = Window.partitionBy(bucket_col).orderBy(F.col(id_col).desc_nulls_last(), F.desc(tie))
    # The markers are lags and leads, so both readers of the sorted ranges
    # share one shuffle.
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry} | {up: F.lag(F.lit(1)).over(order), down: F.lead(F.lit(1)).over(order)})
    names = [*docs.columns, *(f"next_{c}" for c in carry)]
    ranges = keyed.select(bucket.alias(bucket_col)).distinct()
    after = Window.orderBy(F.desc(bucket_col))  # one short row per range
    ranges = ranges.withColumn(nxt, F.coalesce(F.lead(bucket_col).over(after), F.max(bucket_col).over(Window.partitionBy())))
    heads = rows.where(F.col(up).isNull()).select(F.col(bucket_col).alias(nxt), *(F.col(c).alias(f"_head_{c}") for c in carry))
    tails = rows.where(F.col(down).isNull()).drop(*(f"next_{c}" for c in carry)).join(ranges, bucket_col).join(heads, nxt)
    tails = tails.withColumnsRenamed({f"_head_{c}": f"next_{c}" for c in carry})
    return rows.where(F.col(down).isNotNull()).select(*names).unionByName(tails.select(*names))


def edited_text(text: Column, following: Column) -> Column:
    """The last half of ``text`` replaced by as much of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike the
    fingerprint is to the edited text's and to the next document's."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text")))
    rows = with_next(base, ["text", "sketch"])
    edited = edited_text(F.col("text"), F.col("next_text"))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        digest(F.col("sketch")).alias("fingerprint"),
        digest(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_share"),
    )
