"""Every stage on rows that are odd: nulls, empty and long texts, repeated rows, extra columns of clashing names, no rows; tables that are left behind."""

import os

import pytest

import corpus_pipeline
from tracelake.llm.tables import shared_dir, stored, table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def odd(spark):
    """The smallest documents, and odd rows among them, with columns that the stages use inside."""
    docs = table(spark, DATA, "documents").selectExpr("*", "'b' AS body", "'k' AS key", "7 AS score", "'x' AS component")
    long = " ".join(docs.where("lang = 'en'").orderBy("doc_id").first().text.split()[:200]) or "word"
    rows = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n\t", None, "s", 3), (None, long, "en", "s", 9), (9004, (long + "\n") * 40, "en", None, 9), (9005, long, "en", "s", 9), (9005, long, "en", "s", 9), (9006, "1234 5678", None, "s", 9), (None, None, None, None, None)]
    more = spark.createDataFrame([(*r, "b", "k", 7, "x") for r in rows], docs.schema)
    return stored(docs.unionByName(more), "odd-documents")


@needs_data
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[s[0] for s in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_none(spark, odd, name, stage):
    found = stage(spark, odd, DATA)
    rows = found.collect()
    none = stage(spark, odd.limit(0), DATA)
    assert none.count() == 0
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd.select("doc_id").collect()}
        assert sum(r.length for r in rows if r.doc_id == 9001) == 1
        assert none.columns == found.columns
        return
    assert found.columns == odd.columns == none.columns
    assert {(r.body, r.key, r.score, r.component) for r in rows} == {("b", "k", 7, "x")}
    mine = [r for r in rows if r.doc_id is None or r.doc_id > 9000]
    kept = {r.doc_id for r in mine}
    if name == "language_id":
        # nothing that has no letter stays, whatever its id; repeated rows stay repeated
        assert not kept & {9001, 9002, 9003, 9006} and sum(r.doc_id == 9005 for r in mine) == 2
        assert sum(r.doc_id is None for r in mine) == 1
    elif name == "quality_classifier":
        assert sum(r.doc_id == 9005 for r in mine) in (0, 2)
    elif name == "line_dedup":
        assert len(rows) == odd.count() and [r.text for r in mine if r.doc_id == 9001] == [None]
        assert [r.text for r in mine if r.doc_id == 9002] == [""]
        texts = {r.doc_id: r.text for r in mine}
        assert len(texts[9004].split("\n")) <= 2 and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    else:
        # empty texts and rows without an id stay; 9004 and 9005 have one set of shingles but for a seam
        assert {9001, 9002, 9003} <= kept and sum(r.doc_id is None for r in mine) == 2


@needs_data
def test_a_run_leaves_its_result_alone(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = {*os.listdir(folder)}
    found = corpus_pipeline.run(spark, DATA)
    assert found.count() > 0
    assert [n.rpartition("-")[0] for n in {*os.listdir(folder)} - before] == ["stage-best_fit_packing"]


@needs_data
def test_a_run_over_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, DATA, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
