"""The pipeline against plain versions of its stages."""

import corpus_pipeline
from repurchase.llm import decontaminate, mixing, pii, queries, simhash, toxicity
from repurchase.llm.common import read_table

from .test_simhash import groups, plain

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read_table(spark, SF, "documents")
    names = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, read_table(spark, SF, "labels"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "simhash", "decontamination", "pii", "mixing"]

    rejected = {r["doc_id"] for r in toxicity.grade_documents(docs, model).where("rejected").collect()}
    clean = steps["toxicity"](spark, docs, SF)
    assert clean.columns == names and {r["doc_id"] for r in clean.collect()} == set(rows) - rejected

    single = steps["simhash"](spark, docs, SF)
    ids = sorted(rows)
    root = groups([plain(rows[d]) for d in ids])
    assert single.columns == names and {r["doc_id"] for r in single.collect()} == {ids[r] for r in root}

    passages = [decontaminate.normalise(r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    held = {d for d, t in rows.items() if any(p in decontaminate.normalise(t) for p in passages)}
    fair = steps["decontamination"](spark, docs, SF)
    assert fair.columns == names and held and {r["doc_id"] for r in fair.collect()} == set(rows) - held

    masked = steps["pii"](spark, docs, SF)
    spans = pii.report(masked).agg({"n_email": "sum", "n_ip": "sum", "n_phone": "sum", "n_card": "sum"}).first()
    assert masked.columns == names and masked.count() == len(rows) and not any(spans)

    copies = steps["mixing"](spark, docs, SF)
    assert {r["doc_id"] for r in copies.collect()} == set(rows)


def test_run_chains_the_stages(spark):
    docs = read_table(spark, SF, "documents")
    model = toxicity.fit(docs, read_table(spark, SF, "labels"))
    kept = simhash.keep_one(toxicity.keep_clean(docs, model))
    kept = decontaminate.keep_clean(kept, read_table(spark, SF, "benchmark"))
    want = mixing.schedule(pii.redact(kept)).select("doc_id", "epoch", "slot").collect()
    got = corpus_pipeline.run(spark, SF).select("doc_id", "epoch", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_every_dealt_operator_is_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 14))
