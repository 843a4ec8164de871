"""The three learned operators against plain loops over small corpora."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from tracelake.llm import language_id, quality_classifier, toxicity


def invented(rng, n):
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    bad = ["grumbolt", "snarfing", "blortish"]
    texts = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(3, 60))]
        if i % 3 == 0:
            own += [rng.choice(bad) + rng.choice(["", "s", "ed"]) for _ in range(3)]
        rng.shuffle(own)
        texts.append((" ".join(own), int(i % 3 == 0)))
    return texts


def plain_model(texts):
    """Ratios by expression, and by context with a blank, from dictionaries alone."""
    n = [Counter(), Counter()]
    for text, label in texts:
        for word in text.split():
            n[label].update(toxicity.expressions(word))
    both = n[0] + n[1]
    levels = {toxicity.ORDER: both}
    for size in range(toxicity.ORDER - 1, 0, -1):
        levels[size] = Counter()
        for gram, m in levels[size + 1].items():
            levels[size][gram[-size:]] += m if len(gram) <= size else 1

    def of(counts, gram, below, by):
        here = {x: m for x, m in counts.items() if x[:-1] == gram[:-1] and m}
        total = sum(here.values())
        if not total:
            return below, 1.0
        cut = lambda m: by[min(m, 3) - 1] if m else 0
        weight = sum(map(cut, here.values())) / total
        m = counts[gram]
        return (m - cut(m)) / total + weight * below, weight

    flat = [toxicity.DISCOUNT] * 3

    def low(gram, size):
        return of(levels[size], gram[-size:], low(gram, size - 1), flat)[0] if size else toxicity.LETTER

    by = [toxicity.discounts(Counter(c.values())) for c in n]
    out = {}
    for gram in both:
        shared = of(both, gram, low(gram, toxicity.ORDER - 1), flat)[0]
        (p0, w0), (p1, w1) = (of(n[c], gram, shared, by[c]) for c in (0, 1))
        out[gram] = math.log(p1 / p0)
        out[gram[:-1] + " "] = math.log(w1 / w0)
    return n, out


def test_kneser_ney_ratios(spark):
    texts = invented(random.Random(3), 50)
    n, want = plain_model(texts)
    rows = [(g, n[0][g], n[1][g]) for g in n[0] | n[1]]
    found = {r.gram: r.ratio for r in toxicity.log_ratios(spark.createDataFrame(rows, "gram string, n0 long, n1 long")).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[g] - want[g]) < 1e-9 for g in want)


def test_discounts():
    """Estimated, but at least RARE and at most the count."""
    assert toxicity.discounts({1: 100}) == [1.0, 1.5, 1.5]
    d = toxicity.discounts({1: 1000, 2: 300, 3: 60, 4: 10})
    y = 1000 / 1600
    assert np.allclose(d, [1.0, 2 - 3 * y * 60 / 300, 3 - 4 * y * 10 / 60]) and all(x <= k for k, x in enumerate(d, 1))


def test_chances_of_a_context_add_up_to_one():
    """With the backoff's own chances adding up to one, so do the discounted ones."""
    counts, by = {"a": 1, "b": 2, "c": 7}, [0.7, 1.1, 1.4]
    cut = {x: by[min(m, 3) - 1] for x, m in counts.items()}
    below = {"a": 0.2, "b": 0.1, "c": 0.1, "d": 0.6}
    total = sum(counts.values())
    assert abs(sum((counts.get(x, 0) - cut.get(x, 0) + sum(cut.values()) * below[x]) / total for x in below) - 1) < 1e-12


def test_toxicity_scores(spark):
    """The model that fit learns gives the plain model's features; unseen expressions count by their backoff weights."""
    texts = invented(random.Random(5), 60)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] * 2, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    _, want = plain_model(texts)
    assert len(model.codes) == len(want)

    def ratio(word):
        some = toxicity.expressions(word)
        return sum(want.get(x, 0.0) for x in some), sum(want.get(x[:-1] + " ", 0.0) for x in some if x not in want)

    words = sorted({w for t, _ in texts for w in t.split()}) + ["grumboltest", "zzz", "snarf", "éa"]
    found = model.learned(words)
    assert all(np.allclose(found[w], ratio(w), atol=1e-3) for w in words) and found["grumboltest"][0] > 1 and found["grumboltest"][1] != 0
    x = model.features([t for t, _ in texts] + [None, ""], {})
    for row, (text, _) in zip(x, texts):
        own = [ratio(w) for w in text.split()]
        excess, n = sum(max(v - toxicity.STRONG, 0) for v, _ in own), len(own)
        assert np.allclose(row, [1, 20 * sum(v for v, _ in own) / n, 20 * sum(v for _, v in own) / n, 20 * excess / n, excess / n**0.5], atol=1e-2)
    assert x[-1].tolist() == x[-2].tolist() == [1, 0, 0, 0, 0]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i, (_, y) in enumerate(texts) if y) > max(scores[i] for i, (_, y) in enumerate(texts) if not y)


def test_codes_are_those_of_spark(spark):
    texts = ["", "^t", "a longer text than thirty-two bytes of ASCII", "äöü ß", "^grumb "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()
    assert all(r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(r.t.encode(), 42) == toxicity._code(r.t) for r in rows)


def test_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(1, "bad word"), (1, "another text"), (2, "good word"), (None, "bad word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.codes) > 0 and toxicity.score(docs, model).count() == 4
    docs = docs.withColumnRenamed("doc_id", "doc_id")
    found = quality_classifier.classify(docs, labels.withColumnRenamed("toxic", "quality"))
    assert found.count() == 4 and all(0 <= r.score <= 1 for r in found.collect())


def test_quadratic_discriminant(spark):
    """Scores against densities by inverse and determinant of the plainly computed covariances."""
    rng = random.Random(8)
    texts = [(" ".join(rng.choice(["one", "TWO!", "three.", "4", "fünf", "six\n"]) for _ in range(rng.randrange(1, 40))), i % 2) for i in range(50)]
    texts = [(t if y else t.upper().replace("\n", " ## "), y) for t, y in texts]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    x = np.array([quality_classifier.statistics(t) for t, _ in texts])
    y = np.array([y for _, y in texts])
    inside = sum(((x[y == c] - x[y == c].mean(0)) ** 2).sum(0) for c in (0, 1)) / len(x)
    odds = []
    for c in (0, 1):
        own = x[y == c]
        cov = 0.9 * np.cov(own.T, bias=True) + 0.1 * np.diag(inside + 1e-4)
        far = np.concatenate([x, [quality_classifier.statistics(None)]]) - own.mean(0)
        odds.append(np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(cov), far))
    want = 1 / (1 + np.exp(-np.clip((odds[1] - odds[0]) / 4, -700, 700)))
    assert np.allclose([found[i] for i in range(50)] + [found[99]], want, atol=1e-6)


def test_nearest_centroids(spark):
    """Document frequencies, cosines and predictions against dictionaries of n-grams."""
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 30)))
    texts = [(make("abcdefg"), "xx") for _ in range(25)] + [(make("fghijklm"), "yy") for _ in range(25)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    df = Counter()
    for t, _ in texts:
        df.update({*language_id._grams(t).tolist()})
    idf = {g: math.log((1 + len(texts)) / (1 + m)) + 1 for g, m in df.items()}
    assert all(abs(model.idf[g] - v) < 1e-9 for g, v in idf.items())
    centroids = [(lang, dict(enumerate(w.tolist()))) for lang, w in zip(model.languages, model.weights)]
    assert sorted({*model.languages}) == ["xx", "yy"] and all(abs(sum(v * v for v in c.values()) - 1) < 1e-4 for _, c in centroids)
    tried = [t for t, _ in texts] + [make("abcdefghijklm") for _ in range(10)]
    found = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(tried):
        weights = {g: math.log1p(m) * idf.get(g, math.log(1 + len(texts)) + 1) for g, m in Counter(language_id._grams(t).tolist()).items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        best = defaultdict(float)
        for lang, c in centroids:
            best[lang] = max(best[lang], sum(v * c[g] for g, v in weights.items()) / norm)
        want = max(best, key=best.get)
        assert abs(found[i].score - best[want]) < 1e-4
        assert found[i].lang_pred == want or abs(best["xx"] - best["yy"]) < 1e-4
