"""Components, near duplicates and repeated lines against brute force."""

import random

import numpy as np
import pyarrow as pa

from tracelake.llm import line_dedup, near_dedup
from tracelake.llm.components import connected


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(300, 340)] + [(350, k) for k in range(351, 400)]
    want = roots(400, links)
    df = spark.createDataFrame(links + [(7, 7)] + links[:9], "a long, b long")
    found = {r.node: r.component for r in connected(df).collect()}
    named = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: want[x] for x in named}
    assert connected(df.limit(0)).count() == 0


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def corpus(rng):
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rng.randrange(5)):
            c = list(b)
            for _ in range(rng.randrange(6)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    return texts + [None, "", "  ", "one", "ONE", "one", "common a", "common b"]


def test_near_duplicates(spark):
    texts = corpus(random.Random(5))
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n double")
    for size in (2, 5):
        sets = [near_dedup.shingles(t, size) for t in texts]
        want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])])
        found = {r.doc_id: r for r in near_dedup.near_duplicates(df, shingle_words=size).collect()}
        assert {i: found[i].component_id for i in found} == dict(enumerate(want))
        assert all(found[i].n_shingles == len(sets[i]) and found[i].kept == (want[i] == i) for i in found)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert found == [(0, None, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"word{k}" for k in range(150)]
    rows = []
    for i in range(400):
        c = list(base)
        c[rng.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(c)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_lines(spark):
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n)).strip() or "x"
    shared = [line(n) for n in (25, 60, 200)]
    docs = []
    for i in range(40):
        lines = [line(rng.choice([5, 30, 90])) for _ in range(4)]
        if i % 3 == 0:
            own = list(rng.choice(shared))
            if i % 2:
                own[rng.randrange(len(own))] = "Z"
            lines.insert(rng.randrange(4), "".join(own))
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "short\nshort\n\n"), (103, shared[2] + "\n" + shared[2]), (None, shared[2])]
    everything = [(d, k, x.strip(line_dedup.BLANKS)) for d, t in docs if d is not None for k, x in enumerate((t or "").split("\n"))]
    kept = [e for e in everything if e[2]]
    group = roots(len(kept), [(i, j) for i in range(len(kept)) for j in range(i) if line_dedup.alike(kept[i][2], kept[j][2], 80)])
    first = {}
    for e, g in zip(kept, group):
        first[g] = min(first.get(g, e[:2]), e[:2])
    want = {}
    for e, g in zip(kept, group):
        if e[:2] != first[g]:
            want.setdefault(e[0], []).append(e[1])
    df = spark.createDataFrame([(*d, "s", "t") for d in docs], "doc_id long, text string, removed string, __removed string")
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(df).collect()} == want
    out = {r.doc_id: (r.text, r.removed, r["__removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert len(out) == len(docs) and all(v[1:] == ("s", "t") for v in out.values())
    for d, t in docs:
        gone = set(want.get(d, []))
        assert out[d][0] == (t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_rows_with_equal_ids(spark):
    """Each text of an id is a document of its own; rows equal in id and text are one; names may clash with anything."""
    rows = [(3, "line A of some length"), (5, "line A of some length"), (5, "line B, another one altogether"), (7, "own\nline B, another one altogether"), (7, "own\nline B, another one altogether"), (8, None)]
    df = spark.createDataFrame([(*r, k, "d") for k, r in enumerate(rows)], "doc_id long, text string, mark int, doc string")
    out = {r.mark: r for r in line_dedup.dedup_lines(df).collect()}
    assert [out[k].text for k in range(6)] == ["line A of some length", "", "line B, another one altogether", "own", "own", None]
    assert all(r.doc == "d" for r in out.values()) and line_dedup.dedup_lines(df).columns == df.columns


def test_very_long_lines(spark):
    """Lines longer than what is taken at a time, copies and near copies, among short ones."""
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=line_dedup.CHARACTERS + 100))
    near = long[:4000] + "#" + long[4001:]
    rows = [(1, f"short\n{long}"), (2, f"{near}\nshort"), (3, long[::-1]), (4, "x" * 5000), (5, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(df).collect()} == {2: [0, 1], 5: [0]}


def test_similar_pairs():
    rng = random.Random(6)
    xs = ["".join(rng.choice("abcde ") for _ in range(rng.choice([1, 2, 5, 30, 60, 120, 300]))) for _ in range(300)]
    ys = ["".join(rng.choice("abcde#") if rng.random() < rng.choice([0.01, 0.03, 0.3]) else c for c in x) for x in xs]
    found = line_dedup.similar_pairs(xs, ys, 80)
    assert found.tolist() == [line_dedup.alike(x, y, 80) for x, y in zip(xs, ys)] and 50 < found.sum() < 290


def test_long_lines_at_the_similarity_meet():
    """The bands of long lines of about the least length: pairs at 0.8 to 0.85 share a key, but for a few in a thousand."""
    rng = random.Random(9)
    met = tried = 0
    while tried < 1500:
        size = rng.choice([85, 100, 150, 300])
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size))
        y = list(x)
        for _ in range(max(1, round(size * 0.022))):
            y[rng.randrange(size)] = "#"
        y = "".join(y)
        a, b = line_dedup.shingles(x, 5), line_dedup.shingles(y, 5)
        if 80 * len(a | b) <= 100 * len(a & b) <= 85 * len(a | b):
            keys = line_dedup.band_keys(*line_dedup.line_sets([x, y], 5), 1)
            met, tried = met + bool((keys[0] == keys[1]).any()), tried + 1
    assert met >= tried * 0.995


def test_common_keys_are_dealt_out_by_id(spark):
    """Many near copies of a line over many partitions: every one is found."""
    rows = [(k, f"this line is a template of a notice with the number {k:05d} in it, and nothing else of interest") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert {r.doc_id for r in line_dedup.removed_lines(df).collect()} == set(range(1, 3000))


def test_families_of_almost_similar_texts(spark, monkeypatch):
    """Copies whose mutual similarity lies about the threshold: all links count, by blocks too."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 40)
    rng = random.Random(8)
    base = [f"word{k}" for k in range(120)]
    texts = []
    for i in range(150):
        c = base[: 120 - rng.randrange(30)]
        for _ in range(4):
            c[rng.randrange(len(c))] = f"own{rng.randrange(900)}"
        texts.append(" ".join(c))
    sets = [near_dedup.shingles(t, 2) for t in texts]
    want = roots(150, [(i, j) for i in range(150) for j in range(i) if similar(sets[i], sets[j])])
    assert 1 < len(set(want)) < 150
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in sorted(near_dedup.near_duplicates(df, shingle_words=2).collect())] == want


def test_short_lines_take_part_in_the_query_and_the_stage(spark, tmp_path):
    import corpus_pipeline
    from tracelake.llm.queries import QUERIES

    rows = [(1, "Share\nfirst text of its own\n\nok"), (2, "Share \nanother one altogether, not alike\n\nok"), (3, "x\n\nShare"), (4, "x\ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.removed_lines for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {1: [], 2: [0, 3], 3: [2], 4: [0]}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "another one altogether, not alike\n", 3: "x\n", 4: "y"}


def test_one_character_variants_of_30_50_and_70_characters(spark):
    """An edit in the middle of a line, and shingle sets about the border of short and long lines, against all pairs."""
    rng = random.Random(12)
    rows, want = [], {}
    for size in (30, 50, 70, 85, 98, 105, 130):
        for _ in range(20):
            base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size - 2))
            base = f"<{base}>"
            middle = size // 2
            rows += [(len(rows), base), (len(rows) + 1, base[:middle] + "#" + base[middle + 1 :])]
            want[rows[-1][0]] = size
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.removed for r in line_dedup.removed_lines(df, least_chars=1).collect()}
    assert found.keys() <= want.keys()
    for size in sorted({*want.values()}):
        assert sum(want[d] == size for d in found) >= 19, size
    ruler = spark.createDataFrame([(1, "=" * 30), (2, "=" * 300), (3, "ab")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.removed_lines(ruler, least_chars=1).collect()} == {2}


def test_line_sets():
    lines = ["a", "abcabcabc", "xy", "the the the", "=" * 40]
    for size in (3, 5):
        assert line_dedup.line_sets(lines, size)[1].tolist() == [len(line_dedup.shingles(x, size)) for x in lines]


def test_pairs_of_a_unit_are_tried_once_each(monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 30)
    for size in (2, 5, 8, 9, 23):
        starts = np.array([0, 100, 200])
        tried = [(int(i), int(j)) for first, one, two in near_dedup._tried(starts, size) for i, j in zip((first + one).ravel(), (first + two).ravel())]
        assert sorted(tried) == sorted((int(s) + a, int(s) + b) for s in starts for a in range(size) for b in range(a + 1, size))


def test_a_long_list_makes_few_copies_of_its_members(spark, monkeypatch):
    """50,000 members of one list in as many components: at most four rows for each."""
    n = 50_000
    left = spark.range(n).selectExpr("id", "id AS node", "id AS component", "100L AS n", *[f"xxhash64(id, {k}) AS {s}" for k, s in enumerate(near_dedup.SKETCH)], f"array(named_struct('key', 1L, 'members', {n}L, 'bulk', named_struct('members', 1L, 'component', 0L))) AS lists")
    seen = []

    def units(rows, merge, percent, columns, kinds):
        seen.append(rows)
        return rows

    monkeypatch.setattr(near_dedup, "_units", units)
    near_dedup._across(left, 80)
    assert n < seen[0].count() <= 4 * n
    # every two members meet in a unit
    some = seen[0].where("id < 40").select("id", "sides", "x", "y", "bulky").collect()
    met = {(a.id, b.id) for a in some for b in some if a.id < b.id and (a.sides, a.x, a.y) == (b.sides, b.x, b.y) and (a.sides == 1 or a.bulky != b.bulky)}
    assert met == {(a, b) for a in range(40) for b in range(a + 1, 40)}


def test_very_long_texts(spark):
    """A text of a megabyte, its near copy, and one that shares half of it."""
    words = [f"w{k * 7919 % 100_003}" for k in range(150_000)]
    near, half = [*words], [*words[:75_000], *(f"v{k}" for k in range(75_000))]
    near[1000:1010] = ["other"] * 10
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, half, near))], "doc_id long, text string")
    assert [r.component_id for r in sorted(near_dedup.near_duplicates(df).collect())] == [0, 1, 0]


def test_postings_are_dealt_out_in_blocks_of_keys():
    """Few rows for many postings; a key's first lines meet, a common key's other lines are spread over all blocks."""
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 60_000)
    keys[:5000], keys[5000:8000] = keys[0], keys[8000:11_000]
    ids = np.arange(60_000) << 3
    halves = [line_dedup._pieces(keys[at], ids[at], 48) for at in (slice(0, 30_000), slice(30_000, None))]
    rows = pa.Table.from_batches(halves).sort_by("block")
    assert rows.num_rows < 60_000 / 100 and max(map(len, rows["keys"].to_pylist())) <= 8 * line_dedup.PIECE
    sent = [(b, k, i) for b, ks, js in zip(*(rows[c].to_pylist() for c in rows.column_names)) for k, i in zip(np.frombuffer(ks, np.int64), np.frombuffer(js, np.int64))]
    assert sorted((k, i & ~6) for _, k, i in sent) == sorted(zip(keys, ids))
    size = np.bincount([b for b, _, _ in sent], minlength=48)
    assert len(size) == 48 and size.min() > 1000 and size.max() < 1500
    hot = [b for b, k, i in sent if k == keys[0] and i & 4]
    assert len(set(hot)) == 48 and len(hot) == 4999
    # a key that each half has once, and one of one half alone
    keys[59_999] = keys[20_000]
    rows = pa.Table.from_batches([line_dedup._pieces(keys[at], ids[at], 48) for at in (slice(0, 30_000), slice(30_000, None))]).sort_by("block")
    found = [r for b in line_dedup._opened(rows) for r in b.to_pylist()]
    _, which, often = np.unique(keys, return_inverse=True, return_counts=True)
    several = often[which] > 1
    several[[20_000, 59_999]] = False
    assert sorted((r["key"], r["id"]) for r in found if r["key"] is not None) == sorted(zip(keys[several], ids[several]))
    assert [{r["id"], r["other"]} for r in found if r["key"] is None] == [{ids[20_000], ids[59_999]}]


def test_parities_drop_no_similar_sets():
    """No pair at 0.8 or more is dropped; most at 0.6 to 0.7, which agreements of 128 coordinates let pass, are."""
    rng = np.random.default_rng(5)
    near = {True: [0, 0], False: [0, 0]}
    for _ in range(400):
        size, share = int(rng.integers(40, 600)), rng.choice([0.62, 0.7, 0.8, 0.82, 0.9])
        inside = int(np.ceil(2 * size * share / (1 + share)))
        both = rng.integers(0, 1 << 44, 2 * size - inside).astype(np.uint64)
        x, y = np.sort(both[:size]), np.sort(both[size - inside :])
        words = near_dedup.parity_words(np.concatenate((x, y)), np.array([0, size])).view(np.uint64)
        differ = int(np.bitwise_count(words[0] ^ words[1]).sum())
        assert differ <= 2 * (size - inside)
        kind = near[100 * inside >= 80 * (2 * size - inside)]
        kind[0] += 1
        kind[1] += bool(near_dedup._within(differ, size, size, 80))
    assert near[True][0] == near[True][1] > 200 and near[False][1] < 0.1 * near[False][0]


def test_keys_of_long_lines_without_their_sets():
    """Keys made from ranges alone are those of the sets, for long lines, repetitive ones and ones about the borders."""
    rng = random.Random(7)
    lines = ["".join(rng.choices(letters, k=size)) for letters in ("abcdefghijklmnop ", "ab") for size in (1, 60, 90, 130, 249, 252, 300, 2000)] + ["=" * 900]
    want = {(tier, int(k)): keys.tolist() for tier, own, _, codes, sizes in line_dedup._tiers(lines) for k, keys in zip(own, line_dedup.band_keys(codes, sizes, tier))}
    found = [((tier, int(k)), own.tolist()) for tier, at, keys in line_dedup._keyed(lines) for k, own in zip(at, keys)]
    assert dict(found) == want and len(found) == len(want)
