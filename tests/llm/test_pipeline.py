"""The pipeline against its stages in brute force, and on odd tables."""

import corpus_pipeline
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_simhash import brute as components
from tests.llm.test_tokens import check_packing
from tests.llm.util import odd_documents, table
from tianguis.llm.quality import quality

SF = "/root/testdata/sf0.001"


def masked(text):
    out = list(text)
    for a, _, b, _ in secret_spans(text):
        out[a:b] = "*" * (b - a)
    return "".join(out)


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    good = {r.doc_id for r in quality(table(spark, "documents"), table(spark, "labels")).where("predicted = 1").collect()}
    kept = [(d, t) for d, t in docs.items() if d in good]
    kept = [(d, docs[d]) for d, _, c in components(kept) if d == c]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    leaked = {d for d, *_ in contained(kept, items)}
    want = [(d, masked(t)) for d, t in kept if d not in leaked]
    assert 0 < len(want) < len(kept) < len(good) < len(docs)
    check_packing(corpus_pipeline.run(spark, SF).collect(), want)


def test_stages_keep_the_columns_and_take_odd_tables(spark):
    docs = table(spark, "documents")
    odd = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, odd, SF).columns == odd.columns
        assert 0 < stage(spark, odd, SF).count() <= 10
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), SF).count() == 0


def test_stages_are_the_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"
    ]
