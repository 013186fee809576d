"""Counts and nearest neighbours of clustered points against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aleatory.operators import quadtree, spatial


def clustered(rng):
    """A spread, two tight blobs, a line, and points that coincide."""
    return np.concatenate([rng.random((80, 2)), [0.3, 0.3] + rng.normal(size=(60, 2)) * 1e-3, [0.9, 0.2] + rng.normal(size=(30, 2)) * 1e-2, np.stack([np.linspace(0, 1, 30), np.full(30, 0.5)], 1), np.repeat([[0.7, 0.7]], 20, 0)])


def frame(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


@pytest.mark.parametrize("cap", [40, 256])
def test_counts_and_nearest_are_those_of_all_pairs(spark, cap):
    xy = clustered(np.random.default_rng(1))
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    df = frame(spark, xy)
    radii = [2e-3, 0.6]
    got = {r["radius"]: r["pairs"] for r in quadtree.pair_counts(df, radii, cap).collect()}
    assert got == {r: int((d2 <= r * r).sum()) - len(xy) for r in radii}
    counts = {r["id"]: r["neighbours"] for r in quadtree.neighbour_counts(df, 0.05, cap).collect()}
    assert counts == {i: int(c) - 1 for i, c in enumerate((d2 <= 0.05 * 0.05).sum(1))}
    np.fill_diagonal(d2, np.inf)
    near = {r["id"]: r["d"] for r in quadtree.nearest(df, cap).collect()}
    assert near == pytest.approx(dict(enumerate(np.sqrt(d2.min(1)))))


def test_few_points(spark):
    for xy in ([(1.0, 1.0)], [(0.0, 0.0), (3.0, 4.0)], [(2.0, 2.0)] * 3):
        df = frame(spark, xy)
        n = len(xy)
        same = xy == [(2.0, 2.0)] * 3
        assert {r["radius"]: r["pairs"] for r in quadtree.pair_counts(df, [1.0, 5.0], 1).collect()} == {1.0: 6 if same else 0, 5.0: n * (n - 1)}
        assert sorted(r["d"] for r in quadtree.nearest(df, 1).collect()) == ([] if n == 1 else [0.0] * 3 if same else [5.0, 5.0])
    assert quadtree.nearest(frame(spark, [(0.0, 0.0)]).limit(0)).count() == 0


def test_a_small_blob_of_many_points_is_counted_without_its_pairs(spark):
    """50000 points in a blob: 2.5 * 10^9 pairs, of which the boxes settle all but few."""
    n = 50_000
    u = lambda seed: F.rand(seed) + F.rand(seed + 10) + F.rand(seed + 20)
    blob = spark.range(n).select("id", (u(1) * 1e-4).alias("x"), (u(2) * 1e-4).alias("y")).unionByName(spark.createDataFrame([(n, 1.0, 1.0)], "id long, x double, y double")).cache()
    assert quadtree.pair_counts(blob, [0.1]).first()["pairs"] == n * (n - 1)
    tree = quadtree.Tree(blob)
    assert tree.nodes.where("leaf").agg(F.max("n")).first()[0] <= quadtree.CAP and tree.placed.count() == n + 1
    d = quadtree.nearest(blob)
    assert d.count() == n + 1 and d.where(f"id < {n}").agg(F.max("d")).first()[0] < 1e-4
    blob.unpersist()


def test_clustered_points_stand_out(spark):
    xy = np.concatenate([np.random.default_rng(2).random((300, 2)), [0.5, 0.5] + np.random.default_rng(3).normal(size=(50, 2)) * 0.003])
    df = frame(spark, xy)
    kinds = {r["kind"]: r for r in spatial.attractors(df, 1.0, 350).collect()}
    assert kinds["attractor"]["id"] >= 300 and kinds["attractor"]["p"] < 1e-6
    assert spatial.clark_evans(df, 1.0, 350).first()["ratio"] < 1


@pytest.mark.parametrize("block", [20, 1 << 17])
def test_pairs_of_fields_are_those_of_all_points(spark, block):
    rng = np.random.default_rng(block)
    fields = {"a": rng.random((300, 2)), "b": np.append(rng.random((50, 2)) * 1e-3 + 0.5, [[0.0, 0.0], [1.0, 1.0]], 0), "c": np.array([[0.25, 0.5]] * 3), "d": np.array([[0.1, 0.1]]), "e": np.round(rng.random((200, 2)), 1)}
    radii = [0.0005, 0.1, 0.3, 2.0]
    rows = [(f, i, float(x), float(y)) for f, p in fields.items() for i, (x, y) in enumerate(p)]
    got = {(r.f, r.radius): r.c for r in spatial._pairs_by(spark.createDataFrame(rows, "f string, id long, x double, y double"), "f", radii, block).collect()}
    for f, p in fields.items():
        dx, dy = (np.subtract.outer(p[:, i], p[:, i]) for i in (0, 1))
        for r in radii:
            assert got[f, r] == (dx * dx + dy * dy <= r * r).sum() - len(p), (f, r)
