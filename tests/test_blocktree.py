"""Block trees against the levels of the whole tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilwork.operators import attest, blocktree


def plain(hashes):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = hashes
    while len(level) > 1:
        level = [sha(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17, 70])
def test_roots_and_proofs_for_every_size(spark, tmp_path, n):
    hashes = [hashlib.sha256(str(i % 11).encode()).hexdigest() for i in range(n)]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, h string")
    tree = blocktree.built(rows, "id", "h", f"{tmp_path}/tree", k=2)
    assert (tree.root(), tree.leaves) == (plain(hashes), n)
    assert tree.levels() == len(attest.merkle_levels(attest.numbered(rows, "id", "h")))
    again = blocktree.opened(spark, f"{tmp_path}/tree")
    assert (again.k, again.leaves, again.height) == (2, n, tree.height)
    proofs = again.proofs().select("leaf", "hash", attest.proven_root(F.col("hash"), F.col("proof")).alias("root"), "proof").collect()
    assert sorted((r["leaf"], r["hash"]) for r in proofs) == list(enumerate(hashes))
    assert {r["root"] for r in proofs} == {tree.root()}
    if n == 17:
        old = {r["leaf"]: r["proof"] for r in attest.merkle_proofs(attest.numbered(rows, "id", "h")).collect()}
        assert {r["leaf"]: r["proof"] for r in proofs} == old
        some = again.proofs([0, 7, 16, 99])
        assert {r["leaf"]: r["proof"] for r in some.collect()} == {i: old[i] for i in (0, 7, 16)}
        assert {r["leaf"] for r in again.proofs(spark.createDataFrame([(3,), (16,)], "idx long")).collect()} == {3, 16}
        assert "PushedFilters: [In(block" in some._jdf.queryExecution().executedPlan().toString()


def test_nothing_and_nulls(spark, tmp_path):
    tree = blocktree.built(spark.createDataFrame([], "id long, h string"), "id", "h", f"{tmp_path}/none")
    assert (tree.root(), tree.leaves, tree.levels(), tree.proofs().count()) == (None, 0, 0, 0)
    with pytest.raises(Exception, match="no hash"):
        blocktree.built(spark.createDataFrame([(1, None)], "id long, h string"), "id", "h", f"{tmp_path}/null").root()


def test_levels_of_a_block_are_made_once_for_all_its_leaves(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i)) for i in range(70)], "id long, h string")
    plan = blocktree.built(rows, "id", "h", f"{tmp_path}/tree", k=3).proofs()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    held = [i for i, line in enumerate(plan) if "aggregate(" in line]
    assert held  # per leaf, it would stand in a projection above the Generate
    assert all("Generate" in plan[i] for i in held)
