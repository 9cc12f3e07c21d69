"""The pipeline's stages on a small corpus, each against what it must keep."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    from graphloom.llm import jaccard, langid
    from graphloom.llm.common import staged, table

    docs = table(spark, SF, "documents")
    first = ids = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
            out = staged(out, f"test-{name}")
        rows = out.collect()
        assert {r.doc_id for r in rows} <= set(ids)
        if name == "language_id":
            assert len(rows) > 0.95 * len(first) and all(langid.normalise(r.text) for r in rows)
        if name == "line_dedup":
            assert all(set(r.text.split("\n")) <= set(ids[r.doc_id].split("\n")) and r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            assert all(r.doc_id == r.component_id for r in jaccard.similar_groups(out).collect())
        if name == "bpe":
            assert all(r.round_trip and len(r.token_ids) == 4 * r.n_tokens for r in rows)
        else:
            ids = {r.doc_id: r.text for r in rows}
        docs = out


def test_near_duplicates_keeps_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:59])), (3, "a text of its own"), (None, "another text of its own"), (None, " ".join(words)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t in texts if i != 2)
