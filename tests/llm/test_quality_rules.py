"""Figures and verdicts against plain Python."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tracelake.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    found = q.base_figures(df).collect()
    assert {r.key: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in found} == {i: brute(t) for i, t in enumerate(texts)}


def test_figures(spark):
    check(spark, [None, "", " \n\t", "a b c", "# $ x | <y>", "a\na\nb\n\n  \na", "one two three four five six seven eight " * 4, "a " * 30, "p q r s t u v w x y z p q r s t u v w", "é ü 𝒳\x0b\x0cz", "ab " * 20_000])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "\n", " ", "*", "é"]), max_size=60).map("".join), max_size=12))
def test_figures_of_any_text(spark, texts):
    check(spark, texts)


def test_verdicts_do_not_depend_on_the_order(spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [good, good.upper(), " | ".join(good.split()), good + " ***" * 30, "short", None, good]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one = {r.doc_id: r.kept for r in q.apply_rules(df).collect()}
    two = {r.doc_id: r.kept for r in q.apply_rules(df, q.default_rules()[::-1], sample_rows=1).collect()}
    assert one == two and one[0] and one[6] and not any(one[i] for i in range(1, 6))
    assert q.apply_rules(df.limit(0)).count() == 0


def test_rules_are_put_by_rejection_per_cost(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, good) for i in range(50)], "doc_id long, text string")
    never, always = q.Rule("never", F.lit(False)), q.Rule("always", F.col("n_words") > 0)
    assert [r.name for r in q.order_rules(docs, [never, always])] == ["always", "never"]


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(None, good, "k", 1), (None, None, "k", 1), (1, good, "k", 1), (1, good, "k", 1)], "doc_id long, text string, key string, n_words int")
    found = sorted((str(r.doc_id), r.n_words, r.kept) for r in q.apply_rules(df).collect())
    assert found == [("1", 40, True), ("1", 40, True), ("None", 0, False), ("None", 40, True)]
