"""The pipeline: each stage's decisions on its own input."""

from __future__ import annotations

import corpus_pipeline
from skein.llm import decontam, near_dup, pii, quality
from skein.llm.common import save, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = save(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = seen["quality_classifier"]
    labels = table(spark, SF, "labels")
    scored = quality.score(quality.describe(before), quality.fit(quality.describe(before), quality.teachers(labels)))
    assert ids(after) == ids(scored.where("score >= 0.5"))
    before, after = seen["minhash_near_dedup"]
    assert ids(after) == ids(near_dup.near_duplicates(before, 5).where("kept"))
    before, after = seen["benchmark_decontamination"]
    assert ids(after) == ids(before) - ids(decontam.search(before, table(spark, SF, "benchmark")))
    before, after = seen["pii_redaction"]
    assert ids(after) == ids(before) and pii.find(after).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    before, after = seen["source_mixing"]
    assert ids(after) <= ids(before) and after.count() > 0
