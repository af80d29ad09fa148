"""Language-model scoring by deleted interpolation.

Tokens are the words of the text, A-Z lower-cased, and one end. The model mixes
three estimates of a token w after v (the end stands before the first word):

    p(w | v) = l1 c(v w) / c(v) + l2 c(w) / N + l3 / (V + 1)

with counts over all tokens of the training documents. The weights depend on
the bucket (power of two) of the context's frequency c(v) and come from
expectation-maximisation on left-out counts: every training token is predicted
from the counts without it. The predictions are summed into a grid of an eighth
of an octave for both estimates, so the driver gets a bounded histogram.

Documents are read once into stored blocks of about a million tokens. A block
asks the shard of each different word and word pair once, with its own counts;
the shard adds up all blocks' counts and answers each block in the order asked.
So what travels follows the corpus, pre-aggregated, and a frequent word costs a
shard one entry for each block.

Null and empty texts are one end. Documents of null id are training documents.
Repeated rows are scored each, and count each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

BLOCK_TOKENS = 1 << 20
SHARD_KEYS = 1 << 20
HELD_OUT = 2  # of crc32(doc_id) mod FOLDS
FOLDS = 7
END = xxhash.xxh3_64_intdigest(b"")
EM_ROUNDS = 60
_STEPS = 8  # grid steps in an octave
_TOP = 60 * _STEPS


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte planes apart."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


_BLOCK = "block string, ids array<string>, held array<boolean>, sizes array<long>, vocabulary binary, tokens binary"


def _to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, held, sizes, hashes, n = [], [], [], [], 0

    def out() -> pd.DataFrame:
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        row = (uuid.uuid4().hex, ids, held, sizes, _pack_sorted(vocabulary), pack(tokens.astype(np.uint32)))
        return pd.DataFrame([row], columns=["block", "ids", "held", "sizes", "vocabulary", "tokens"])

    for b in batches:
        for d, h, t in zip(b["doc_id"], b["held_out"], b["text"], strict=True):
            w = t.encode().lower().split()
            hashes.append(np.fromiter((*map(xxhash.xxh3_64_intdigest, w), END), np.uint64, len(w) + 1))
            ids.append(d)
            held.append(bool(h))
            sizes.append(len(w) + 1)
            n += len(w) + 1
            if n >= BLOCK_TOKENS:
                yield out()
                ids, held, sizes, hashes, n = [], [], [], [], 0
    if ids:
        yield out()


class Block:
    """The tokens of a stored block, and its different words and pairs."""

    def __init__(self, row):
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = _unpack_sorted(row["vocabulary"])
        self.token = unpack(row["tokens"], np.uint32).astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        end = int(np.searchsorted(self.words, np.uint64(END)))
        self.context = np.r_[end, self.token[:-1]]
        self.context[first] = end
        pair = self.words[self.context] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.token]
        pair = (pair ^ (pair >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.pairs, self.pair = np.unique(pair ^ (pair >> np.uint64(29)), return_inverse=True)
        self.train = np.repeat(~np.array(row["held"], bool), self.sizes)


def _ask(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                block, rows = Block(row), []
                for kind, keys, at in (("word", block.words, block.token), ("pair", block.pairs, block.pair)):
                    count = np.bincount(at, block.train, len(keys)).astype(np.uint64)
                    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                        rows.append((kind, int(shard[x]), row["block"], _pack_sorted(keys[x:y]), pack(count[x:y])))
                yield pd.DataFrame(rows, columns=["kind", "shard", "block", "keys", "counts"])

    return run


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    asked = asked.sort_values("block")
    keys = [_unpack_sorted(k) for k in asked["keys"]]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpack(c, np.uint64) for c in asked["counts"]]).astype(np.float64), len(known)).astype(np.uint64)
    parts = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
    out = asked[["kind", "shard", "block"]].assign(counts=[pack(p) for p in parts], n=0, v=0)
    out.iloc[0, out.columns.get_indexer(["n", "v"])] = [int(total.sum()), int(np.count_nonzero(total))]
    return out


_COUNTED = "ids array<string>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, pair binary, context binary, word binary"


def _count(n: int, v: int):
    """Blocks with their answers, to the counts of each token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                block = Block(row)
                got = {"word": [], "pair": []}
                for a in sorted(row["answers"], key=lambda a: a["shard"]):
                    got[a["kind"]].append(unpack(a["counts"], np.uint64))
                words, pairs = np.concatenate(got["word"]), np.concatenate(got["pair"])
                c = words[block.token]
                base = np.log10((c + np.uint64(1)) / (n + v + 1))
                first = np.cumsum(block.sizes) - block.sizes
                yield pd.DataFrame(
                    [
                        (
                            row["ids"],
                            row["held"],
                            row["sizes"],
                            np.add.reduceat((c > 0).astype(np.int64), first),
                            np.add.reduceat(base, first),
                            pack(pairs[block.pair]),
                            pack(words[block.context]),
                            pack(c),
                        )
                    ],
                    columns=["ids", "held", "sizes", "known", "base", "pair", "context", "word"],
                )

    return run


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def _grid(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        step = np.where(f > 0, np.rint(-np.log2(f) * _STEPS), 0)
    return np.where(f > 0, 1 + np.clip(step, 0, _TOP), 0).astype(np.int64)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** (-(step - 1) / _STEPS), 0.0)


def _left_out(n: int):
    """Histogram of left-out predictions: bucket and both estimates' steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                train = np.repeat(~np.array(row["held"], bool), row["sizes"])
                pair, context, word = (unpack(row[k], np.uint64)[train].astype(np.float64) - 1 for k in ("pair", "context", "word"))
                f1 = pair / np.maximum(context, 1)
                cell = (_bucket(context) * (_TOP + 2) + _grid(f1)) * (_TOP + 2) + _grid(word / max(1, n - 1))
                cells, count = np.unique(cell, return_counts=True)
                yield pd.DataFrame({"cell": cells, "n": count})

    return run


def learn_weights(cells: np.ndarray, count: np.ndarray, v: int) -> np.ndarray:
    """Mixture weights for each bucket, by expectation-maximisation; one
    pseudo-token for each estimate keeps all weights above zero."""
    bucket, f1, f2 = cells // (_TOP + 2) ** 2, _value(cells // (_TOP + 2) % (_TOP + 2)), _value(cells % (_TOP + 2))
    f = np.stack([f1, f2, np.full(len(cells), 1 / (v + 1))], axis=1)
    weights = np.full((64, 3), 1 / 3)
    for _ in range(EM_ROUNDS):
        part = weights[bucket] * f
        part *= (count / part.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, part[:, j], 64) for j in range(3)], axis=1) + 1
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def _score(weights: np.ndarray, n: int, v: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                pair, context, word = (unpack(row[k], np.uint64).astype(np.float64) for k in ("pair", "context", "word"))
                w = weights[_bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, n) + w[:, 2] / (v + 1)
                size = np.array(row["sizes"], np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": row["ids"],
                        "held_out": row["held"],
                        "n_tokens": size,
                        "n_known": row["known"],
                        "train_tokens": n,
                        "base_score": row["base"],
                        "score": np.add.reduceat(np.log10(p), np.cumsum(size) - size),
                    }
                )

    return run


def score_documents(docs: DataFrame, held_out: int = HELD_OUT, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score (log10 probability under the mixture)."""
    kind = dict(docs.dtypes)["doc_id"]
    name = F.col("doc_id").cast("string")
    held = F.coalesce(F.pmod(F.crc32(name.cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    rows = docs.select(name.alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = stash(rows.mapInPandas(_to_blocks, _BLOCK), "lm-blocks")
    tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, int(tokens // SHARD_KEYS).bit_length())
    asked = blocks.mapInPandas(_ask(bits), "kind string, shard long, block string, keys binary, counts binary")
    answers = asked.groupBy("kind", "shard").applyInPandas(_answer, "kind string, shard long, block string, counts binary, n long, v long")
    answers = stash(answers, "lm-answers")
    sums = answers.where("kind = 'word'").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    per = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "counts")).alias("answers"))
    counted = stash(blocks.join(per, "block").mapInPandas(_count(n, v), _COUNTED), "lm-counted")
    cells = counted.mapInPandas(_left_out(n), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), v)
    out = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted.mapInPandas(_score(weights, n, v), out).withColumn("doc_id", F.col("doc_id").cast(kind))
