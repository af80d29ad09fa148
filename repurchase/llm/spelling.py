"""Spelling variants by Bloom-guided neighbourhoods.

Words are runs of letters (a-z after lower-casing A-Z, and U+00C0 to U+00FF).
Two words are near if one inserted, deleted or replaced letter turns one into
the other. Every word's edits are generated in numpy and probed against Bloom
filters of the vocabulary; only edits that a filter holds are written out as
strings and joined to the vocabulary, which removes the filters' errors.

* Filters are sharded by word length: an edit asks the shard of its own length
  only. They are blocked: all bits of a word lie in one 64-bit block, so a probe
  reads one place. Words hash by tabulation (XOR of a random number for each
  place and letter), so an edit's hash is the word's with one or two numbers
  changed, whatever its length.
* Nearness is symmetric: deletions find the insertions of the other word, and
  replacements by a later letter find those by an earlier one.
* A broadcast holds at most ``FILTER_BITS`` bits. A larger vocabulary is taken in
  rounds: lengths are dealt to rounds, and a length too large for one round is
  cut by hash. Each edit belongs to one cut, so rounds lose and repeat nothing.

Null texts hold no words; a null id counts as the text ``null``. Repeated rows
count each. Words longer than ``LONGEST`` share a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
TYPO = 31
FILTER_BITS = 1 << 27  # 16 MiB a broadcast
BITS_A_WORD = 16
PROBES = 1 << 20  # edits held at once
LONGEST = 64

LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) of all whole texts. Where ``typo`` divides the CRC-32 h of
    ``<doc_id>:<word>``, the letter at h modulo length is left out first."""
    runs = F.filter(F.split(_lower(F.coalesce("text", F.lit(""))), "[^a-zÀ-ÿ]+"), lambda w: F.length(w) >= least_length)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a random-looking word for each number."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _number(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The random number of a letter (0 to 89) at a place."""
    return _mixed(place.astype(np.uint64) * np.uint64(128) + letter.astype(np.uint64))


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letter numbers."""
    codes = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.int64)
    return np.where(codes < 128, codes - ord("a"), codes - 0xC0 + 26).astype(np.uint8)


def word_hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_number(np.arange(letters.shape[1])[None, :], letters), axis=1)


def block_and_mask(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A word's block, and its five bits there."""
    at = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    one, mask = np.uint64(1), np.zeros_like(h)
    for j in range(5):
        mask |= one << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return at, mask


def cut_of(h: np.ndarray, cuts: int) -> np.ndarray:
    return (_mixed(h) >> np.uint64(40)) % np.uint64(cuts)


def shard_of(length: int) -> int:
    return min(length, LONGEST)


def plan_rounds(sizes: dict[int, int], filter_bits: int = FILTER_BITS, bits: int = BITS_A_WORD) -> list[dict[int, tuple[int, int, int]]]:
    """Rounds of {shard: (cut, cuts, blocks)} that hold each cut of each
    shard once, with at most ``filter_bits`` bits a round."""
    rounds: list[dict[int, tuple[int, int, int]]] = []
    room: list[int] = []
    for shard, n in sorted(sizes.items()):
        cuts = max(1, -(-n * bits // filter_bits))
        blocks = max(1, min(-(-n * bits // (64 * cuts)), filter_bits // 64))
        for cut in range(cuts):
            free = next((i for i, left in enumerate(room) if left >= blocks and shard not in rounds[i]), None)
            if free is None:
                rounds.append({})
                room.append(filter_bits // 64)
                free = len(rounds) - 1
            rounds[free][shard] = (cut, cuts, blocks)
            room[free] -= blocks
    return rounds


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, PROBES // int(length))
        for at in range(0, len(rows), step):
            yield int(length), rows[at : at + step]


def filters(words: DataFrame, plan: dict[int, tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """The round's filters; the driver receives one row per block in use, at
    most ``filter_bits`` / 64."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, rows in _by_length(b["word"]):
                shard = shard_of(length)
                if shard not in plan:
                    continue
                cut, cuts, blocks = plan[shard]
                h = word_hashes(letters_of(b["word"].iloc[rows].tolist()))
                h = h[cut_of(h, cuts) == cut]
                at, mask = block_and_mask(h, blocks)
                yield pd.DataFrame({"shard": shard, "at": at.astype(np.int64), "mask": mask.view(np.int64)})

    found = words.select("word").mapInPandas(bits, "shard int, at long, mask long")
    found = found.groupBy("shard", "at").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = {}
    for shard, (_, _, blocks) in plan.items():
        own = found[found["shard"] == shard]
        out[shard] = np.zeros(blocks, np.uint64)
        out[shard][own["at"].to_numpy()] = own["mask"].to_numpy().view(np.uint64)
    return out


def _positives(letters: np.ndarray, plan: dict[int, tuple[int, int, int]], held: dict[int, np.ndarray], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter) of the edits that a filter holds; letter -1 for a
    deletion. Of a run of one letter, only the last is deleted."""
    n, length = letters.shape
    number = _number(np.arange(length)[None, :], letters)
    whole = np.bitwise_xor.reduce(number, axis=1)

    def probe(h: np.ndarray, shard: int) -> np.ndarray:
        cut, cuts, blocks = plan[shard]
        at, mask = block_and_mask(h, blocks)
        hit = (held[shard][at] & mask) == mask
        return hit & (cut_of(h, cuts) == cut) if cuts > 1 else hit

    if shard_of(length) in plan:
        for i in range(length):
            row, pick = np.nonzero(alphabet[None, :] > letters[:, i, None])
            new = _number(np.full(len(alphabet), i), alphabet)
            hit = probe((whole ^ number[:, i])[row] ^ new[pick], shard_of(length))
            if hit.any():
                row = row[hit]
                yield row, np.full(len(row), i), alphabet[pick[hit]].astype(np.int64)
    if length > 1 and shard_of(length - 1) in plan:
        moved = _number(np.arange(length)[None, :] - (np.arange(length)[None, :] > 0), letters)
        before = np.bitwise_xor.accumulate(number, axis=1) ^ number
        after = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1] ^ moved
        last = np.ones((n, length), bool)
        last[:, :-1] = letters[:, :-1] != letters[:, 1:]
        row, place = np.nonzero(last)
        hit = probe((before ^ after)[row, place], shard_of(length - 1))
        yield row[hit], place[hit], np.full(int(hit.sum()), -1)


def edits(words: DataFrame, plan: dict[int, tuple[int, int, int]], alphabet: np.ndarray) -> DataFrame:
    """(edit, word, n): the round's edits that its filters hold."""
    held = words.sparkSession.sparkContext.broadcast(filters(words, plan))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, rows in _by_length(b["word"]):
                step = max(1, PROBES // len(alphabet)) if len(alphabet) else len(rows)
                for at in range(0, len(rows), step):
                    part = b.iloc[rows[at : at + step]]
                    texts, counts = part["word"].tolist(), part["n"].to_numpy()
                    for row, place, letter in _positives(letters_of(texts), plan, held.value, alphabet):
                        made = [texts[r][:i] + (LETTERS[x] if x >= 0 else "") + texts[r][i + 1 :] for r, i, x in zip(row, place, letter, strict=True)]
                        yield pd.DataFrame({"edit": np.array(made, object), "word": np.array(texts, object)[row], "n": counts[row]}, dtype=object)

    return words.select("word", "n").mapInPandas(find, "edit string, word string, n long")


def near_pairs(words: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, n, near, near_n): each pair of near words, both ways. ``words``
    is a stored table of distinct (word, n)."""
    sizes = {r["shard"]: r["count"] for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("shard")).count().collect()}
    used = {r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect()}
    alphabet = np.array([i for i, x in enumerate(LETTERS) if x in used], np.uint8)
    found = [stash(edits(words, plan, alphabet), "spelling-edits") for plan in plan_rounds(sizes, filter_bits)]
    if not found:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    asked = reduce(DataFrame.unionByName, found).withColumnsRenamed({"word": "a", "n": "a_n"})
    real = asked.join(words.withColumnsRenamed({"word": "edit", "n": "b_n"}), "edit")
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a[0]}_n").alias("n"), F.col(b).alias("near"), F.col(f"{b[0]}_n").alias("near_n"))
    real = real.withColumnRenamed("edit", "b")
    return real.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from stored (word, form), each word once: pointers are
    doubled until none moves. Counts rise along forms, so there is no ring."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stash(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def group_variants(docs: DataFrame, ratio: int = RATIO, filter_bits: int = FILTER_BITS, **words) -> DataFrame:
    """word, n, n_near, form (the near word of largest count, ties by code
    points, if it has ``ratio`` times the word's), form_n, root (the end of
    the forms)."""
    vocab = stash(vocabulary(docs, **words), "spelling-words")
    pairs = near_pairs(vocab, filter_bits)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    most = -F.col("best.less")
    holds = most >= F.col("n") * ratio
    near = stash(near.select("word", "n_near", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, most).alias("form_n")), "spelling-near")
    ends = roots(near.where("form is not null").select("word", "form"))
    out = vocab.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
