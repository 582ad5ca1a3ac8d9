"""The stages of the pipeline against what their operators say of the same rows."""

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from colonnade.llm import bpe, ngram_join, quality_rules, queries  # noqa: E402
from colonnade.llm.frames import staged  # noqa: E402


def test_stages(spark, medium):
    docs = queries.table(spark, medium, "documents")
    columns = docs.dtypes
    ids, texts = {}, {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, medium), "test-stage")
        if name != "bpe":
            assert docs.dtypes == columns
            texts[name] = docs.select("doc_id", "text", "n_chars").collect()
            ids[name] = sorted(r["doc_id"] for r in texts[name])
        if name == "quality_rules":
            rules = quality_rules.fit(before, queries.table(spark, medium, "labels"))
            assert ids[name] == sorted(r["id"] for r in quality_rules.judge(before, rules).where("kept").collect())
        if name == "line_dedup":
            assert ids[name] == ids["quality_rules"] and all(len(r["text"]) == r["n_chars"] for r in texts[name])
        if name == "ngram_join":
            groups = ngram_join.similar_groups(before).collect()
            assert ids[name] == sorted(r["id"] for r in groups if r["id"] == r["component"])
        if name == "mixing":
            assert max(np.unique(ids[name], return_counts=True)[1]) == 2 and set(ids[name]) <= set(ids["ngram_join"])
    own = bpe.vocabulary(queries.vocabulary_path())
    text = {r["doc_id"]: r["text"] for r in texts["mixing"]}
    rows = docs.collect()
    assert sorted(r["doc_id"] for r in rows) == ids["mixing"]
    for r in rows[:200]:
        assert bytes(r["ids"]) == next(own.encode_many([text[r["doc_id"]]]))[0] and r["n_tokens"] * 4 == len(r["ids"])
    assert pipeline.run(spark, medium).count() == len(rows)
