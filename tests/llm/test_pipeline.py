"""The pipeline's stages against plain Python on the smallest documents."""

import corpus_pipeline
from tests.llm.test_models import brute_components
from tidepool.llm import bpe, quality, secret_scan
from tidepool.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_their_order(spark):
    docs = table(spark, SF, "documents")
    trees = quality.fit(docs, table(spark, SF, "labels"))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    good = [r for r in rows if trees.score(quality.np.array([quality.statistics(r.text or "")]))[0] >= 0.5]
    out = corpus_pipeline.keep_good(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in good}

    kept = corpus_pipeline.keep_one_of_each_group(spark, out, SF)
    groups = brute_components([r.text for r in good], 5, 4, 5)
    single = [good[i] for i, _, least in groups if i == least]
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in single}

    clean = corpus_pipeline.without_secrets(spark, kept, SF)
    want = {r.doc_id: r.text if r.text is None else secret_scan.redact_text(r.text, secret_scan.scan_text(r.text)[1]) for r in single}
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()} == want

    tokens = {k: len(bpe.encoder().encode([t or ""])[0]) + 1 for k, t in want.items()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == tokens and sum(r.length for r in pieces) == sum(tokens.values())


def test_stages_of_an_empty_table_and_of_repeated_rows(spark):
    docs = table(spark, SF, "documents")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    some = docs.where("doc_id < 3")
    assert corpus_pipeline.keep_one_of_each_group(spark, some.unionByName(some), SF).count() == 3
