import collections
import hashlib
import random
import re

from repurchase.llm import pii

from .data import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(c) for c in reversed(digits)]
    return (sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if valid:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def check(spark, rows):
    got = {r["doc_id"]: r for r in pii.report(table(spark, rows)).collect()}
    for d, t in rows:
        want, r = base_spans(t), got[d]
        kinds = collections.Counter(s.split(":")[0] for s in want)
        assert [r[f"n_{k}"] for k in PATTERNS] == [kinds[k] for k in PATTERNS], t
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(r["spans"].split(",")) | {""}
    return got


def test_base_spans_match_plain_search(spark):
    r = random.Random(1)
    parts = ["12", "0", ".", "@", "a.b", "-", " ", "+", "(555)", "é", "😀", "4111111111111111", "192.168.0.1", "x@y.com", "_", "9.9.9.9.9", "%", "300.1.1.1"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "1 " * 3000), (1003, "a" * 50_000), (1004, "x@y.com " * 700), (1005, "1." * 2000), (1006, "9" * 20_000), (1007, "+1" + "(" * 20_000)]
    check(spark, rows)


def test_added_spans_and_redaction(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, f"word word {i} token = \"{secret[i:] + secret[:i]}\" and mail me{i}@mail.example.com end") for i in range(30)]
    got = check(spark, rows)
    assert all("secret:" in r["spans"] for r in got.values())
    clean = pii.redact(table(spark, rows)).collect()
    assert all(r["text"].count("[SECRET]") == 1 and "[EMAIL] end" in r["text"] and r["n_chars"] == len(r["text"]) for r in clean)


def test_running_sums_cross_blocks(spark):
    from pyspark.sql import functions as F

    steps = list(range(1000))
    got = spark.createDataFrame([(steps,), ([],)], "s array<int>").select(pii.running_before(F.col("s"))).collect()
    assert got[0][0] == [sum(steps[:i]) for i in range(1000)] and got[1][0] == []
