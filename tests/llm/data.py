"""Small tables shared by the tests of the training-data operators."""

import random

EDGES = [
    (None, None),
    (None, "no id here"),
    (900, None),
    (901, ""),
    (902, " \t\n "),
    (903, "one"),
    (904, "twin text of six words here"),
    (904, "twin text of six words here"),
    (904, "other text under the same id"),
    (905, "twin text of six words here"),
    (2**60, "a very large id"),
]


def vocabulary(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["an", "or", "thé", "ü", "st", "ing", "e"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def prose(words: int, seed: int, size: int = 400) -> str:
    r, v = random.Random(seed), vocabulary(size, 1)
    return " ".join(r.choice(v) for _ in range(words))


def table(spark, rows, extra: bool = False):
    """documents with all columns; ``extra`` adds names operators use."""
    out = [(d, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "labels", "_mark", "_id", "fp", "gram", "block", "epoch", "n_tokens", "found", "kind", "segment", "_hash"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df
