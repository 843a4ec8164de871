"""Trees of whole tables: blocks by count, proofs and refutations, roots that do not depend on partitions."""

import hashlib

from pyspark.sql import functions as F

from tracelake.operators import merkle
from tracelake.operators.custody import table_digest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def loop(hashes, block, least=1):
    level, depth = [*hashes], 0
    while len(level) > 1 or depth < least:
        level, depth = [sha("".join(level[i : i + block])) for i in range(0, len(level), block)], depth + 1
    return level[0]


def captures(spark, n, each):
    """Packets of many captures whose numbers all start from 0."""
    return spark.range(n * each).select(F.concat(F.lit("c"), F.lpad((F.col("id") / each).cast("int").cast("string"), 5, "0")).alias("path"), (F.col("id") % each).alias("seq"), (F.col("id") * 7).alias("v"))


def test_captures_with_equal_numbers_fill_blocks_evenly(spark):
    found = merkle.tree(captures(spark, 1000, 12), ["path", "seq"], block=256)
    assert found.n == 12_000 and [x.count() for x in found.levels] == [12_000, 47]
    per_block = found.rows.groupBy(F.floor(F.col("number") / 256)).count().collect()
    assert max(r["count"] for r in per_block) == 256 and len(per_block) == 47
    assert [r.number for r in found.rows.orderBy("number").collect()] == [*range(12_000)]


def test_root_is_that_of_a_loop(spark):
    rows = captures(spark, 9, 13)
    hashes = [r.h for r in rows.orderBy("path", "seq").select(merkle.row_hash("path", "seq", "v").alias("h")).collect()]
    for block in (2, 3, 16, 200):
        found = merkle.tree(rows, ["path", "seq"], block=block)
        assert found.root == loop(hashes, block) and found.n == len(hashes)
    assert merkle.tree(rows.repartition(7).orderBy(F.rand(3)), ["path", "seq"], block=3).root == loop(hashes, 3)
    assert table_digest(rows) == (sha(loop(hashes, 4096, 2)), len(hashes))


def test_membership_is_proven_and_refuted(spark):
    rows = captures(spark, 30, 10)
    found = merkle.tree(rows, ["path", "seq"], block=4)
    assert len(found.levels) == 5
    for v in (0, 7 * 123, 7 * 299):
        h = rows.where(F.col("v") == v).select(merkle.row_hash("path", "seq", "v").alias("h")).first().h
        steps = found.proof(h)
        assert len(steps) == 5 and merkle.proves(h, steps, found.root)
        assert not merkle.proves(sha("other"), steps, found.root) and not merkle.proves(h, steps, sha("other"))
        forged = [merkle.Step(steps[0].at, (sha("x"), *steps[0].hashes[1:])), *steps[1:]]
        assert not merkle.proves(forged[0].hashes[forged[0].at], forged, found.root)
    assert found.proof(sha("no such row")) is None
    changed = merkle.tree(rows.withColumn("v", F.when(F.col("v") == 7 * 123, 1).otherwise(F.col("v"))), ["path", "seq"], block=4)
    assert changed.root != found.root and changed.proof(h) is not None


def test_edges(spark):
    none = captures(spark, 0, 1)
    assert merkle.tree(none, ["path", "seq"]).root == sha("") and merkle.tree(none, ["path"]).n == 0
    one = spark.createDataFrame([(None, 1)], "path string, seq long")
    assert merkle.tree(one, ["path", "seq"]).root == sha(one.select(merkle.row_hash("path", "seq").alias("h")).first().h)
    twice = one.unionByName(one)
    assert merkle.tree(twice, ["seq"]).n == 2 and merkle.tree(twice, ["seq"]).root != merkle.tree(one, ["seq"]).root
