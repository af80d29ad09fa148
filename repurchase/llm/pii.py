"""Personal data by weak supervision, as Spark expressions.

Candidate spans come from wide patterns. Five labelers vote on each (``p``
for personal, ``n`` against, ``-`` abstaining): a strict pattern, a gazetteer
(domain endings, number prefixes, reserved ranges, key prefixes), the words
before it, its shape, and its boundaries. Expectation-maximisation over the
counts of vote patterns estimates, for each kind, the share of personal
candidates and how reliable each labeler is; the patterns are few (3^5 for each
kind), so each round reads a handful of sums. Its soft labels train the span
classifier: naive Bayes over votes, length, digits, separators and the
characters around the span.

Base spans (valid email, ip, card and phone matches) always stay; the
classifier adds candidates it finds personal: ``secret`` (keys and tokens),
``id`` (digit groups that are no card) and base kinds that failed their check.
Places count code points, end exclusive.

Null and empty texts have no spans. Repeated rows are reported each. Without
candidates the model is empty and adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stash

KINDS = ("email", "ip", "card", "phone", "secret", "id")
LABELERS = 5
ROUNDS = 10
ADD_AT = 0.5
_RUN = 128

# The patterns of the base spans. Possessive where the greedy
# form gives the same matches, so that no text makes them backtrack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]{0,40}+[0-9])(?=[0-9_/+-]{0,40}+[A-Za-z])[A-Za-z0-9_/+-]{20,}+"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

# Gazetteers and context cues.
DOMAIN_ENDS = r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|us|mx|ar)$"
RESERVED_IP = r"^(0|127|255)\."
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
PHONE_PREFIX = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SECRET_PREFIX = r"^(sk-|sk_|pk_|ghp_|AKIA|eyJ|xox)"
CUES = {
    "email": r"(e-?mail|mailto|contact|kontakt|correo|courriel)[^a-z]*$",
    "ip": r"(ip|address|adresse|host|server|login)[^a-z]*$",
    "card": r"(card|visa|mastercard|karte|tarjeta|carte)[^a-z]*$",
    "phone": r"(phone|tel|call|mobile|fax|telefon|appel)[^a-z]*$",
    "secret": r"(token|key|secret|password|passwd|bearer|api)[^a-z]*$",
    "id": r"(ssn|passport|account|iban|konto|cuenta|compte|customer)[^a-z]*$",
}
AGAINST = r"(version|section|page|isbn|issn|figure|chapter|volume)[^a-z]*$"


def running_before(steps: Column) -> Column:
    """Sum of the elements before each one, in blocks so that the work does
    not grow with the square of the array."""

    def block(blk: Column, before: Column) -> Column:
        return F.transform(blk, lambda x, i: before + F.aggregate(F.slice(blk, F.lit(1), i), F.lit(0), lambda a, y: a + y))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, y: a + y))
        return let(
            sums,
            lambda s: F.flatten(
                F.transform(blocks, lambda b, k: let(F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda a, y: a + y), lambda before: block(b, before)))
            ),
        )

    cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / _RUN).cast("int"))
    return let(F.transform(cuts, lambda k: F.slice(steps, k * _RUN + 1, _RUN)), joined)


_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def locate(text: Column, pattern: str, gate: Column) -> Column:
    """Matches of a pattern: start, end, value, and the text around them."""

    def spans(s: Column) -> Column:
        pieces, found = s["pieces"], s["found"]
        steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))

        def at(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.char_length(F.get(pieces, i))
                return F.struct(
                    start.alias("start"),
                    (start + F.char_length(m)).alias("end"),
                    m.alias("value"),
                    F.right(F.get(pieces, i), F.lit(24)).alias("before"),
                    F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"),
                )

            return F.transform(found, one)

        return let(steps, lambda x: let(running_before(x), at))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    return F.when(gate, let(both, spans)).otherwise(F.array().cast(_SPAN))


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "p").when(no, "n").otherwise("-")


def _never() -> Column:
    return F.lit(False)


def _votes(kind: str, value: Column, before: Column, after: Column, base: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "email":
        strict = _vote(value.rlike(r"\.[A-Za-z]{2,}$"), ~value.rlike(r"\.[A-Za-z]{2,}$"))
        gazetteer = _vote(value.rlike(DOMAIN_ENDS), ~value.rlike(DOMAIN_ENDS))
        shape = _vote(value.rlike("^[A-Za-z0-9]"), F.char_length(value) > 254)
    elif kind == "ip":
        strict = _vote(base, ~base)
        gazetteer = _vote(~value.rlike(RESERVED_IP), value.rlike(RESERVED_IP))
        shape = _vote(~value.rlike(r"(^|\.)0[0-9]"), value.rlike(r"(^|\.)0[0-9]"))
    elif kind == "card":
        strict = _vote(base, ~base)
        gazetteer = _vote(_digits(value).rlike(CARD_PREFIX), ~_digits(value).rlike(CARD_PREFIX))
        shape = _vote((n >= 13) & (n <= 19), n < 13)
    elif kind == "phone":
        strict = _vote(base, ~base)
        gazetteer = _vote(value.rlike(PHONE_PREFIX), ~value.rlike(PHONE_PREFIX))
        shape = _vote(n >= 10, n < 9)
    elif kind == "secret":
        strict = _vote(value.rlike("^([0-9a-f]{32,}|[0-9A-F]{32,})$"), _never())
        gazetteer = _vote(value.rlike(SECRET_PREFIX), _never())
        few = F.size(F.array_distinct(F.split(F.lower(value), ""))) < 9
        shape = _vote(~few & (F.length(_digits(value)) >= 4), few | (F.length(_digits(value)) < 4))
    else:
        strict = _vote(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), value.rlike("[ -]") & ~value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
        gazetteer = _vote(_never(), value.rlike("^(19|20)[0-9]{2}[ -]"))
        shape = _vote((n >= 9) & (n <= 12), value.rlike("^(0+|1+|9+)$"))
    low = F.lower(before)
    context = _vote(low.rlike(CUES[kind]), low.rlike(AGAINST))
    inside = before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    return F.concat(strict, gazetteer, context, shape, _vote(~inside, inside))


def _features(value: Column, before: Column, after: Column, votes: Column) -> Column:
    n = F.char_length(value)
    kind_of = lambda c: F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike("[A-Za-z0-9]"), "word").otherwise("mark")
    return F.array(
        *(F.concat(F.lit(f"vote{i}:"), F.substring(votes, i + 1, 1)) for i in range(LABELERS)),
        F.concat(F.lit("length:"), F.floor(F.log2(n.cast("double"))).cast("string")),
        F.concat(F.lit("digits:"), F.floor(F.length(_digits(value)) / n * 4).cast("string")),
        F.concat(F.lit("marks:"), F.least(F.lit(4), F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))).cast("string")),
        F.concat(F.lit("before:"), kind_of(F.right(before, F.lit(1)))),
        F.concat(F.lit("after:"), kind_of(after)),
    )


def candidates(text: Column) -> Column:
    """Array of candidates: order (of the kind), kind, start, end, base,
    votes, features; sorted by start, then kind."""
    digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")), "secret": digit}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": SECRET}

    def judged(kind: str, found: Column, base) -> Column:
        def one(s: Column) -> Column:
            is_base = base(s["value"])
            return let(
                _votes(kind, s["value"], s["before"], s["after"], is_base),
                lambda v: F.struct(
                    s["start"].alias("start"),
                    F.lit(KINDS.index(kind)).alias("order"),
                    F.lit(kind).alias("kind"),
                    s["end"].alias("end"),
                    is_base.alias("base"),
                    v.alias("votes"),
                    _features(s["value"], s["before"], s["after"], v).alias("features"),
                ),
            )

        return F.transform(found, one)

    def card(v: Column) -> Column:
        d = _digits(v)
        return F.length(d).between(12, 19) & luhn(d)

    always = lambda v: F.lit(True)
    never = lambda v: F.lit(False)
    valid = {"email": always, "ip": lambda v: v.rlike(VALID_IP), "phone": lambda v: F.length(_digits(v)).between(9, 15), "secret": never}
    parts = [judged(k, locate(text, patterns[k], gates[k]), valid[k]) for k in ("email", "ip", "phone", "secret")]
    numbers = locate(text, CARD, digit)
    parts.append(let(numbers, lambda found: judged("card", F.filter(found, lambda s: card(s["value"])), always)))
    long_enough = lambda s: F.length(_digits(s["value"])).between(8, 40) & ~card(s["value"])
    parts.append(let(numbers, lambda found: judged("id", F.filter(found, long_enough), never)))
    return F.array_sort(F.concat(*parts))


@dataclass
class Model:
    """Log-odds of kinds and of their features."""

    prior: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)


def _lookup(table: dict[str, float], key: Column) -> Column:
    if not table:
        return F.lit(0.0)
    cells = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*cells), key), F.lit(0.0))


def _vote_score(kind: Column, votes: Column, prior: dict, weight: dict) -> Column:
    score = _lookup(prior, kind)
    for i in range(LABELERS):
        score = score + _lookup(weight, F.concat(kind, F.lit(f":{i}:"), F.substring(votes, i + 1, 1)))
    return score


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, float]]:
    """EM over (kind, votes, n): log-odds of each kind's prior and of each
    labeler's votes. Starts from the majority; a labeler is presumed right
    four times in five, as ten more votes, which keeps the classes apart."""
    prior = dict.fromkeys(KINDS, 0.0)
    weight = {f"{k}:{i}:{v}": s for k in KINDS for i in range(LABELERS) for v, s in (("p", math.log(4)), ("n", -math.log(4)))}
    for _ in range(rounds):
        rows = patterns.withColumn("q", _sigmoid(_vote_score(F.col("kind"), F.col("votes"), prior, weight)))
        q = F.col("q")
        cells = [F.sum(F.col("n") * q).alias("yes"), F.sum(F.col("n") * (1 - q)).alias("no")]
        for i in range(LABELERS):
            for v in "pn":
                cast = (F.substring("votes", i + 1, 1) == v).cast("double") * F.col("n")
                cells += [F.sum(cast * q).alias(f"yes{i}{v}"), F.sum(cast * (1 - q)).alias(f"no{i}{v}")]
        sums = rows.groupBy("kind").agg(*cells).collect()
        if not sums:
            break
        for r in sums:
            k = r["kind"]
            prior[k] = math.log((r["yes"] + 1) / (r["no"] + 1))
            for i in range(LABELERS):
                right = (r[f"yes{i}p"] + 8) / (r[f"yes{i}p"] + r[f"yes{i}n"] + 10)
                wrong = (r[f"no{i}p"] + 2) / (r[f"no{i}p"] + r[f"no{i}n"] + 10)
                weight[f"{k}:{i}:p"] = math.log(right / wrong)
                weight[f"{k}:{i}:n"] = math.log((1 - right) / (1 - wrong))
    return prior, weight


def train(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """Model from a stored column ``found`` of candidates."""
    flat = rows.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    patterns = stash(flat.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")), "pii-votes")
    prior, weight = reliabilities(patterns, rounds)
    soft = flat.withColumn("q", _sigmoid(_vote_score(F.col("kind"), F.col("votes"), prior, weight)))
    sums = [F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")]
    per = soft.select("kind", "q", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(*sums).collect()
    total = {r["kind"]: (r["yes"], r["no"]) for r in soft.groupBy("kind").agg(*sums).collect()}
    model = Model({k: math.log((y + 1) / (n + 1)) for k, (y, n) in total.items()})
    for r in per:
        y, n = total[r["kind"]]
        model.weight[f"{r['kind']}:{r['feature']}"] = math.log((r["yes"] + 1) / (y + 2)) - math.log((r["no"] + 1) / (n + 2))
    return model


def accepted(found: Column, model: Model, at: float = ADD_AT) -> Column:
    """Candidates that are base spans or that the classifier finds personal."""
    if not model.prior:
        return F.filter(found, lambda c: c["base"])

    def personal(c: Column) -> Column:
        score = F.aggregate(c["features"], _lookup(model.prior, c["kind"]), lambda a, f: a + _lookup(model.weight, F.concat(c["kind"], F.lit(":"), f)))
        return c["base"] | (_sigmoid(score) >= at)

    return F.filter(found, personal)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def _candidate_rows(docs: DataFrame) -> DataFrame:
    return stash(docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("found")), "pii-candidates")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, n_added."""
    rows = _candidate_rows(docs)
    model = train(rows)
    rows = rows.withColumns({"base": F.filter("found", lambda c: c["base"]), "kept": accepted(F.col("found"), model)})
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *(count(k) for k in KINDS[:4]),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("kept")).alias("spans"),
        (F.size("kept") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping
    spans by the first one's); ``n_chars`` follows, other columns stay."""
    text = F.coalesce("text", F.lit(""))
    model = train(_candidate_rows(docs))
    span = "array<struct<kind:string,start:int,end:int>>"

    def merge(done: Column, c: Column) -> Column:
        here = F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        last = F.element_at(done, -1)
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], c["end"]).alias("end"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (c["start"] < F.try_element_at(done, F.lit(-1))["end"]), grown).otherwise(F.concat(done, F.array(here)))

    def rewritten(spans: Column) -> Column:
        parts = F.transform(
            spans,
            lambda s, i: F.concat(
                let(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), lambda end: F.substring(text, end + 1, s["start"] - end)),
                F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
            ),
        )
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.char_length(text)))

    merged = F.aggregate(accepted(candidates(text), model), F.array().cast(span), merge)
    clean = let(merged, lambda spans: F.when(F.size(spans) == 0, F.col("text")).otherwise(rewritten(spans)))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
