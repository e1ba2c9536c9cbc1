"""The accumulator against a recursive tree over lists, and against forgers."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import accumulator as acc
from vigilframe.operators import ledger


def sha(*parts):
    return sha256("|".join(map(str, parts)).encode()).hexdigest()


def tree(hashes):
    """Hash of a list: split at the largest power of two below its length."""
    if len(hashes) == 1:
        return hashes[0]
    k = 1 << (len(hashes) - 1).bit_length() - 1
    return sha("node", tree(hashes[:k]), tree(hashes[k:]))


def head_rows(n, forged=()):
    return [(i, sha("head", i, i in forged), 1024) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "segment bigint, head string, rows bigint")


def leaf_list(rows):
    return [sha("leaf", i, n, h) for i, h, n in rows]


def kept(df):
    """Written once, so that the folds below do not repeat the tree."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_roots_of_every_size(spark):
    rows = head_rows(40)
    heads = frame(spark, rows)
    nodes = kept(acc.accumulate(heads, 40))
    got = {r["size"]: r for r in acc.seals(heads, nodes, spark.range(1, 41).withColumnRenamed("id", "size")).collect()}
    for n in range(1, 41):
        assert got[n].root == sha("root", n, tree(leaf_list(rows)[:n])) == acc.root_from(n, got[n].peaks)


@pytest.mark.parametrize("old, size", [(0, 2), (1, 3), (255, 257), (256, 300), (300, 700)])
def test_extending_makes_only_new_nodes(spark, old, size):
    rows = head_rows(size)
    whole = {(r.level, r.idx): r.hash for r in acc.accumulate(frame(spark, rows), size).collect()}
    before = acc.accumulate(frame(spark, rows[:old]), old) if old > 1 else None
    had = {(r.level, r.idx) for r in before.collect()} if before is not None else set()
    new = {}
    behind = frame(spark, rows[old >> acc.LEVELS << acc.LEVELS:])
    for part in acc.extend(before, behind, old, size):
        for r in part.collect():
            assert (r.level, r.idx) not in had and (r.level, r.idx) not in new
            new[r.level, r.idx] = r.hash
    assert had | set(new) == set(whole) and all(whole[k] == h for k, h in new.items())
    assert all((i + 1) << level <= size for level, i in whole)


def test_consistency_of_all_pairs(spark):
    n = 19
    heads, others = frame(spark, head_rows(n)), frame(spark, head_rows(n, {4}))
    nodes, forged = kept(acc.accumulate(heads, n)), kept(acc.accumulate(others, n))
    sizes = spark.range(1, n + 1).withColumnRenamed("id", "size")
    root = {r["size"]: r.root for r in acc.seals(heads, nodes, sizes).collect()}
    false = {r["size"]: r.root for r in acc.seals(others, forged, sizes).collect()}
    assert all((root[k] == false[k]) == (k <= 4) for k in root)
    pairs = [(a, b) for b in range(2, n + 1) for a in range(1, b)]
    proof = kept(acc.proofs(heads, nodes, spark.createDataFrame(pairs, "before bigint, size bigint")))
    assert max(r["count"] for r in proof.groupBy("before", "size").count().collect()) <= 2 * n.bit_length()
    schema = "before bigint, size bigint, root_before string, root string"
    for claims, want in (
            ([(a, b, root[a], root[b]) for a, b in pairs], lambda a, b: True),
            ([(a, b, false[a], root[b]) for a, b in pairs], lambda a, b: a <= 4),
            ([(a, b, root[a], false[b]) for a, b in pairs], lambda a, b: b <= 4)):
        got = {(r.before, r["size"]): r.consistent for r in acc.consistent(
            proof, spark.createDataFrame(claims, schema)).collect()}
        assert got == {(a, b): want(a, b) for a, b in pairs}
    short = proof.where("part <> 'R'")  # a proof with parts left out proves nothing
    got = acc.consistent(short, spark.createDataFrame([(4, 7, root[4], root[7])], schema)).first()
    assert not got.consistent


def entries(spark, n):
    return spark.range(n).select(
        F.col("id").alias("seq"), F.lit("t").alias("at"), F.lit("a").alias("actor"), F.lit("x").alias("action"),
        F.lit("p").alias("subject_pid"), F.lit("u").alias("unit_id"), F.lit("w").alias("purpose"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("detail"))


def test_only_the_root_is_trusted(spark):
    n = 6 * 1024 + 5
    sealed = ledger.seal(entries(spark, n)).persist()
    heads = kept(ledger.heads(sealed))
    nodes = kept(acc.accumulate(heads, 7))
    seal = acc.seals(heads, nodes, spark.createDataFrame([(7,)], "size bigint")).first()

    def found(log, stored=nodes, size=7, peaks=seal.peaks, root=seal.root):
        return sorted((r.segment, r.reason) for r in ledger.audit(log, stored, size, peaks, root).collect())

    assert found(sealed) == []
    assert found(sealed.where("segment <> 2")) == [(2, "segment missing")]
    assert found(sealed.where("segment < 6")) == [(6, "segment missing")]  # the last, open one
    anew = ledger.seal(entries(spark, n).withColumn("actor", F.lit("b"))).persist()
    for k in (1, 6):
        swapped = sealed.where(F.col("segment") != k).unionByName(anew.where(F.col("segment") == k))
        assert found(swapped) == [(k, "segment does not match its sealed head")]
    # the forger also stores the tree of the forged log: its peaks do not lead to the trusted root
    other_heads = kept(ledger.heads(anew))
    other_nodes = kept(acc.accumulate(other_heads, 7))
    other = acc.seals(other_heads, other_nodes, spark.createDataFrame([(7,)], "size bigint")).first()
    wrong = "stored seal does not lead to the trusted root"
    assert found(anew, other_nodes, peaks=other.peaks) == [(0, wrong)]
    assert found(sealed, size=6) == [(0, wrong)] and found(sealed, peaks=seal.peaks[:2]) == [(0, wrong)]
    # or swaps single nodes, or loses them
    hole = "a stored node above this segment does not hold"
    mixed = nodes.where("not (level = 1 and idx = 1)").unionByName(other_nodes.where("level = 1 and idx = 1"))
    assert (2, hole) in found(sealed, mixed)
    assert found(sealed, nodes.where("not (level = 1 and idx = 0)")) == [
        (0, hole), (0, "segment was never sealed"), (1, "segment was never sealed")]
    # segments behind the seal are not its business
    more = ledger.seal(entries(spark, 9 * 1024)).persist()
    assert [r for r in found(more) if r[0] > 6] == []
