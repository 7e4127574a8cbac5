import corpus_pipeline as P
from regolith.llm.common import stored
from tests.llm.test_neardup import brute as groups
from tests.llm.test_quality import brute as rules


def test_stages_take_effect(spark, sf, sample):
    docs, kept = sample, {}
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == sample.columns
    texts = {r.doc_id: r.text for r in sample.collect()}
    first = {r.doc_id for r in kept["quality"].collect()}
    failed = {k for k, t in texts.items() if (x := rules(t))[0] < 20 or 100 * x[4] > 30 * x[0]}
    assert not first & failed and len(first) >= 0.97 * (len(texts) - len(failed))
    second = {r.doc_id for r in kept["language"].collect()}
    assert second <= first and len(second) >= 0.99 * len(first)
    want = {k for k, (_, c) in groups({k: texts[k] for k in second}, 80).items() if k == c}
    assert {r.doc_id for r in kept["neardup"].collect()} == want
    assert {r.doc_id for r in kept["packing"].collect()} == want


def test_odd_and_empty_documents(spark, documents, nothing):
    for docs in (documents, nothing):
        at = docs
        for name, stage in P.STAGES:
            at = stored(stage(spark, at, ""), name)
            assert name == "packing" or at.columns == docs.columns
            assert {r.doc_id for r in at.collect()} <= {r.doc_id for r in docs.collect()}
