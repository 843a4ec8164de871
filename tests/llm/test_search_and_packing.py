"""Nearest neighbours and packing: exact results, odd inputs."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import ann, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=12).astype(np.float32).tolist() for _ in range(700)]
    vectors[100:300] = [vectors[5]] * 200  # a large group of equal vectors
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1020, [0.0] * 12, 0), (1040, [1.0, None] + [0.0] * 10, 0), (1060, [float("nan")] * 12, 0), (1080, [], 0), (1100, [1.0, 2.0], 0), (1101, [1.0, 3.0], 0), (None, vectors[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 7, query_rows=16, block_rows=64, group_blocks=2).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array(vectors, np.float64)
    for q in range(0, 700, 20):
        exact = np.array([sum(a * b for a, b in zip(x[q], y)) for y in x])
        order = sorted((-s, i) for i, s in enumerate(exact) if i != q)[:7]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert found[1100] == [(1, 1101, 7.0)]
    assert set(found) == {*range(0, 700, 20), 1100}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 64)) * rng.lognormal(size=(50, 1))
    block = ann.Block(64, np.arange(50).astype("<i8").tobytes(), x.astype("<f8").tobytes())
    product = block.whole @ block.whole.T * block.scale * block.scale.T
    slack = block.missed[:, None] * block.length + block.near_length[:, None] * block.missed
    assert (np.abs(product - x @ x.T) <= slack + 1e-9).all()


def check_packing(spark, rows, room, shard=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    found = packing.pack(df, PATH, room=room).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for d, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), room)):
            part = ids[at : at + room]
            want.append((d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(want, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences), -(-sum(w[3] for w in want) // room)


def test_packing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, "word " * int(rng.integers(0, 120)), "x") for i in range(300)] + [(5, None, "x"), (None, "a b", "x"), (900, "long " * 1000, "x"), (901, "even " * 63, "x")]
    sequences, least = check_packing(spark, rows, 64)
    assert sequences <= least * 1.1
    monkeypatch.setattr(packing, "SHARD", 60)
    many, _ = check_packing(spark, rows, 64)
    assert many <= sequences * 1.05 + 2
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, PATH).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 50, 200).tolist()
    a = packing._fit([], [*range(200)], size, 64)
    b = packing._fit(packing._fit([], [*range(0, 200, 2)], size, 64), [*range(1, 200, 2)], size, 64)
    for child in (packing._cross(a, b, size, 64, rng), packing._mutate(a, size, 64, rng), packing.evolve(size, 64, [a, b], 1)):
        assert sorted(i for x in child for i in x) == [*range(200)]
        assert all(sum(size[i] for i in x) <= 64 for x in child)


def test_evolution_beats_best_fit_decreasing():
    """Full bins of 4096 cut into parts, so that the optimum is known: the genetic part closes half the gap at least."""
    rng = np.random.default_rng(4)
    for parts, low in ((3, 700), (4, 600), (5, 500)):
        size = []
        while len(size) < 400 * parts:
            ends = np.concatenate(([0], np.sort(rng.integers(1, 4096, parts - 1)), [4096]))
            if np.diff(ends).min() >= low:
                size += np.diff(ends).tolist()
        plain = len(packing._fit([], [*range(len(size))], size, 4096))
        best = packing.evolve(size, 4096, [], 1)
        assert sorted(i for b in best for i in b) == [*range(len(size))] and all(sum(size[i] for i in b) <= 4096 for b in best)
        assert plain > 410 and len(best) - 400 <= (plain - 400) / 2 + 0.5, (parts, plain, len(best))


def test_relief_empties_a_bin_by_exchanges():
    size = np.array([50, 40, 60, 30, 9])
    found = packing.relieve([[0, 1], [2, 3], [4]], size, 100, np.random.default_rng(0))
    assert sorted(map(sorted, found)) in ([[0, 1, 4], [2, 3]], [[0, 1], [2, 3, 4]])
    tight = packing.relieve([[0, 1], [2, 3], [4]], np.array([50, 45, 60, 35, 10]), 100, np.random.default_rng(0))
    assert sum(map(len, tight)) == 5


def test_repeated_ids_and_lots(spark):
    """Repeated rows are candidates each, a repeated query has one list; queries in several lots meet all groups."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 6))
    ids = [i % 250 for i in range(300)]
    df = spark.createDataFrame(list(zip(ids, map(list, vectors.tolist()))), "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 5 == 0, 4, query_rows=8, block_rows=16, group_blocks=3, lot_blocks=2).collect()
    first = {}
    for q in range(0, 250, 5):
        own = [(r.rank, r.vec_id, r.score) for r in found if r.query_id == q]
        asked = [v for i, v in zip(ids, vectors) if i == q]
        lists = []
        for v in asked:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in zip(ids, vectors) if i != q)[:4]
            lists.append([(k + 1, i, -s) for k, (s, i) in enumerate(scored)])
        assert len(own) == 4 and any([(k, i) for k, i, _ in sorted(own)] == [(k, i) for k, i, _ in want] for want in lists)
        first[q] = own
    assert len(first) == 50


def test_candidates_are_dealt_once(spark, monkeypatch):
    """Rows into the search: every block of candidates once a lot, every block of queries once a group."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 4)))], "vec_id long, embedding array<double>").repartition(4)
    dealt, union = [], type(df).unionByName
    monkeypatch.setattr(type(df), "unionByName", lambda a, b, *c: dealt.append((a.count(), b.count())) or union(a, b, *c))
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 3, query_rows=10, block_rows=50, group_blocks=5)
    # about 40 blocks of candidates in 8 or 9 groups, and 10 to 13 of queries
    ((candidates, queries),) = dealt
    assert 40 <= candidates <= 44 and 80 <= queries <= 13 * 9
    assert found.count() == 300
