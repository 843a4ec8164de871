"""The pipeline's stages on the smallest tables: each decision takes effect, nothing else is lost."""

import os

import pytest

import corpus_pipeline
from tracelake.llm import language_id, line_dedup, near_dedup, quality_classifier
from tracelake.llm.queries import fold
from tracelake.llm.tables import stored, table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, DATA), "test-stage")
        before, after = {r.doc_id: r.text for r in docs.collect()}, out.collect()
        if k < 4:
            assert out.columns == names and len(after) == len({r.doc_id for r in after})
            kept = {r.doc_id: r.text for r in after}
        if name == "language_id":
            judged = language_id.predict(docs, language_id.fit(docs.where(fold(5) > 0))).collect()
            assert kept.keys() == {r.doc_id for r in judged if not r.rejected}
        elif name == "quality_classifier":
            judged = quality_classifier.classify(docs, table(spark, DATA, "labels").where(fold(5) > 0)).collect()
            assert kept.keys() == {r.doc_id for r in judged if r.predicted}
        elif name == "line_dedup":
            gone = {r.doc_id: {*r.removed} for r in line_dedup.removed_lines(docs).collect()}
            assert kept == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in before.items()}
        elif name == "minhash_near_dedup":
            sets = {d: near_dedup.shingles(t, 5) for d, t in before.items()}
            ids = sorted(before)
            group = {d: d for d in ids}
            for a in ids:
                for b in ids:
                    if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        old, new = max(group[a], group[b]), min(group[a], group[b])
                        group = {d: new if g == old else g for d, g in group.items()}
            assert kept.keys() == {d for d in ids if group[d] == d}
        else:
            assert {r.doc_id for r in after} == before.keys()
        docs = out
