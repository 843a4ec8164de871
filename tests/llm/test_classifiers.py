"""Language, quality and toxicity: held-out accuracy and odd inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import language_id, quality_classifier, toxicity
from tracelake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def auc(rows):
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


@here
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op10_language_id"](spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.99 * len(found)
    assert sum(r.rejected for r in found) <= 0.01 * len(found)


@here
@pytest.mark.parametrize("name, label, least", [("op8_quality_classifier", "quality", 0.95), ("op9_toxicity", "toxic", 0.75)])
def test_held_out_labels(spark, name, label, least):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = QUERIES[name](spark, DATA)
    assert found.count() == 1000
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert auc([(r.score, r[label]) for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_and_unlearned_models(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "12 34 !!", "en"), (4, "x" * 200_000, None), (4, "hello there", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit(df)
    found = language_id.predict(df, model).collect()
    assert len(found) == 5 and {r.lang_pred for r in found} == {"und"} and all(r.rejected and r.score == 0 for r in found)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(df, labels).collect()} == {0.5}
    assert {r.score < 1e-100 for r in toxicity.score(df, toxicity.fit(df, labels)).collect()} == {True}
    empty = df.limit(0)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_small_training_set(spark):
    rows = [(i, f"the quick brown fox {i} jumps over the lazy dog and runs away", "en") for i in range(20)] + [(100 + i, f"le renard brun {i} saute par dessus le chien paresseux et court", "fr") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    test = spark.createDataFrame([(1, "the dog runs over the fox"), (2, "le chien court par dessus le renard"), (3, "ΑΒΓΔ ΕΖΗΘ")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predict(test, model).collect()}
    assert found[1].lang_pred == "en" and found[2].lang_pred == "fr" and found[3].rejected and not found[1].rejected
    labels = spark.createDataFrame([(i, int(i < 100), int(i >= 100)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in quality_classifier.classify(df, labels).collect()}
    assert min(scores[i] for i in range(20)) > max(scores[100 + i] for i in range(20))
    model = toxicity.fit(df, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert min(scores[100 + i] for i in range(20)) > max(scores[i] for i in range(20))


@here
def test_a_held_out_language_of_the_same_script_is_rejected(spark):
    """One odd text among the learned ones does not open the door; clean texts stay, short ones too."""
    from tracelake.llm.queries import fold

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").withColumn("text", F.substring("text", 1, 1500))
    odd = spark.createDataFrame([(-1, "zqxj wvkq xzzq jjqw", "en"), (-2, "qqxz kjwv", "fr")], docs.schema)
    model = language_id.fit(docs.where((F.col("lang") != "de") & (fold(5) > 0)).unionByName(odd))
    test = docs.where((F.col("lang") == "de") | (fold(5) == 0)).withColumn("size", F.length("text"))
    # of a whole text and of its first 60 characters, by ids
    short = test.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.left(F.col("text"), F.lit(60))})
    rows = test.unionByName(short)
    judged = language_id.predict(rows, model).join(rows.select("doc_id", "lang", "size"), "doc_id").collect()
    for least, most in ((0, 1_000_000), (1_000_000, 2_000_000)):
        own = [r.rejected for r in judged if r.lang != "de" and least <= r.doc_id < most]
        foreign = [r.rejected for r in judged if r.lang == "de" and r.size >= 60 and least <= r.doc_id < most]
        assert len(own) > 100 and len(foreign) > 100
        assert sum(own) <= 0.03 * len(own)
        assert sum(foreign) >= 0.8 * len(foreign)


def test_the_toxicity_sample_is_bounded_in_characters(spark):
    """Of either class the first rows by hash whose texts have so many characters together; a smaller bound than the first text leaves none."""
    rows = [(i, "x" * (i % 5 + 1) if i != 7 else None, i % 2, i * 37 % 11) for i in range(40)]
    picked = spark.createDataFrame(rows, "id long, body string, label int, at long")
    for most in (0, 10, 33, 10**6):
        found = {r.id for r in toxicity._within(picked, most).collect()}
        want = set()
        for c in (0, 1):
            total = 0
            for i, body, _, _ in sorted((r for r in rows if r[2] == c), key=lambda r: (r[3], r[0])):
                total += len(body or "")
                if total > most:
                    break
                want.add(i)
        assert found == want
    docs = spark.createDataFrame([(i, f"plain words of document {i}" if i % 2 else f"vile words of document {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)], "doc_id long, toxic int")
    small, whole = (toxicity.fit(docs, labels, max_characters=n) for n in (300, 1 << 20))
    assert len(small.codes) < len(whole.codes)
    assert toxicity.score(docs, toxicity.fit(docs, labels, max_characters=1)).count() == 60
    assert toxicity.score(docs, toxicity.fit(docs, labels, max_characters=1)).count() == 60


def test_equal_cosines_go_to_the_first_language(spark):
    """Two languages learned from the same texts: every text is as near to both."""
    texts = [f"the same words of text number {i} stand here twice" for i in range(30)]
    df = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts) for lang in ("bb", "aa")], "doc_id long, text string, lang string")
    found = language_id.predict(df, language_id.fit(df)).collect()
    assert len(found) == 60 and {r.lang_pred for r in found if not r.rejected} == {"aa"}


def test_every_row_of_a_language_shapes_its_centroids(spark):
    """Of 2300 texts a few are unlike the others, wherever they are: they are a cluster of their own, which sampled centroids lack."""
    rows = [(i, "one two three four five", "en") for i in range(2300)]
    for odd in (0, 777, 2299):
        changed = [(i, "zyx wvu zyx wvu", lang) if i == odd else (i, text, lang) for i, text, lang in rows]
        df = spark.createDataFrame(changed, "doc_id long, text string, lang string")
        model = language_id.fit(df)
        found = language_id.predict(df.where("doc_id IN (0, 777, 2299)"), model).collect()
        assert all(r.score > 0.9999 for r in found)


def test_ngrams_of_many_texts_at_once():
    """The same as one text after another: odd cases, no n-grams across texts, none for texts without a letter."""
    from tracelake.llm import language_id as module

    texts = ["", "...", "ΑΣ", "Σ", "İ a", " ab", "ab ", "x", "a퟿b", "1a2  b", "日本 x", "the the the", "ΑΣ."]
    found, start, dims, counts = module._sparse(texts)
    want = [(i, *map(np.ndarray.tolist, module._counted(grams))) for i, x in enumerate(texts) if (grams := module._grams(x)) is not None]
    parts = [x.tolist() for some in (dims, counts) for x in np.split(some, start[1:])]
    assert [*zip(found.tolist(), parts[: len(found)], parts[len(found) :])] == want
    assert [len(x) for x in module._sparse(["", "."])] == [0, 0, 0, 0]
