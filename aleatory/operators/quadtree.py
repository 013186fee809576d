"""Points in an adaptive quadtree: cells are split until they hold few points, however closely points lie.

Whether two nodes' points lie within a distance is mostly settled by the boxes
around them: wholly within, they count without a pair being made; wholly
beyond, they are dropped. What is left goes on to the nodes' children, and
only points of two leaves whose boxes leave it open are compared, in tasks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut

#: Points of a leaf, and the deepest level (points in one cell of the root's side over 2**DEEPEST share a leaf, in parts).
CAP, DEEPEST = 256, 24

_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(v: Column) -> Column:
    """The bits of a number at every second place."""
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _name(code: Column, level: Column) -> Column:
    return F.shiftleft(code, 5).bitwiseOR(level.cast("bigint"))


class Tree:
    """``nodes(node, level, n, x1, x2, y1, y2, leaf)``, ``kids(of, node)`` (a leaf is its own) and ``placed(leaf, id, x, y)``."""

    def __init__(self, points: DataFrame, cap: int = CAP, deepest: int = DEEPEST) -> None:
        ends = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        x0, x1, y0, y1 = (float(e or 0) for e in ends)
        side = max(x1 - x0, y1 - y0) or 1.0
        cells = 1 << deepest
        place = lambda c, low: F.least(F.floor((F.col(c) - low) / side * cells), F.lit(cells - 1)).cast("bigint")
        code = _spread(place("x", x0)).bitwiseOR(F.shiftleft(_spread(place("y", y0)), 1))
        rest = cut(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), code.alias("code")))
        self.spark, self.cap, nodes, placed = points.sparkSession, cap, [], []
        level, before, self.levels = 0, 0, []
        while True:
            own = rest.withColumn("c", F.shiftright("code", 2 * (deepest - level)))
            stats = own.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("code").bitwiseXOR(F.max("code")).alias("differ"))
            parent = _name(F.shiftright("c", 2 * (level - before)), F.lit(before))
            leaf = (F.col("n") <= cap) | (F.col("differ") == 0)
            # Levels at which no cell would part are left out.
            parts = F.lit(deepest) - F.floor((F.length(F.bin("differ")) - 1) / 2)
            stats = cut(stats.select("c", _name(F.col("c"), F.lit(level)).alias("node"), parent.alias("of"), F.lit(level).alias("level"), "n", "x1", "x2", "y1", "y2", leaf.alias("leaf"), parts.alias("parts")))
            self.levels.append(level)
            nodes.append(stats.drop("parts"))
            placed.append(own.join(stats.where("leaf").select("c", F.col("node").alias("leaf"), "n"), "c").select("leaf", "n", "id", "x", "y"))
            split = stats.where("not leaf")
            following = split.agg(F.min("parts")).first()[0]
            if following is None:
                break
            rest = cut(own.join(split.select("c"), "c", "left_semi").drop("c"))
            level, before = int(following), level
        whole = lambda frames: frames[0] if len(frames) == 1 else whole([a.unionByName(b) for a, b in zip(frames[::2], frames[1::2], strict=False)] + frames[len(frames) // 2 * 2 :])
        self.nodes, self.placed = cut(whole(nodes).drop("c")), cut(whole(placed))
        self.kids = cut(self.nodes.where("level > 0").select("of", "node").unionByName(self.nodes.where("leaf").select(F.col("node").alias("of"), "node")))

    def above(self, nodes: DataFrame, keep: list[str]) -> DataFrame:
        """``(keep, above)``: each of ``nodes(node, level)`` with itself and all nodes over it."""
        up = F.explode(F.filter(F.array(*map(F.lit, self.levels)), lambda v: v <= F.col("level"))).alias("up")
        name = _name(F.expr("shiftright(shiftright(node, 5), cast(2 * (level - up) as int))"), F.col("up"))
        return nodes.select("*", up).select(*keep, name.alias("above"))

    def leaves(self) -> DataFrame:
        """``(leaf, ids, xs, ys)``: each leaf's points as arrays of at most some ``cap``; only leaves of coincident points have several rows."""
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / self.cap))
        rows = self.placed.groupBy("leaf", part.alias("part")).agg(F.collect_list(F.struct("id", "x", "y")).alias("p"))
        return rows.select("leaf", F.col("p.id").alias("ids"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))

    def boxes(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with the least and greatest squared distance between points of theirs, as their boxes allow."""
        side = lambda s: self.nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "x1", "x2", "y1", "y2", "leaf")])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        gap = lambda c: F.greatest(F.col(f"{c}1_a") - F.col(f"{c}2_b"), F.col(f"{c}1_b") - F.col(f"{c}2_a"), F.lit(0.0))
        span = lambda c: F.greatest(F.col(f"{c}2_a") - F.col(f"{c}1_b"), F.col(f"{c}2_b") - F.col(f"{c}1_a"))
        return both.withColumn("near", gap("x") * gap("x") + gap("y") * gap("y")).withColumn("far", span("x") * span("x") + span("y") * span("y"))

    def below(self, pairs: DataFrame, keep: list[str]) -> DataFrame:
        """Pairs of the nodes' children; a leaf stays itself."""
        a, b = (self.kids.select(F.col("of").alias(s), F.col("node").alias(f"kid_{s}")) for s in "ab")
        return pairs.select(*keep, "a", "b").join(a, "a").join(b, "b").select(*keep, F.col("kid_a").alias("a"), F.col("kid_b").alias("b"))

    def compared(self, pairs: DataFrame, keep: list[str], schema: str, work) -> DataFrame:
        """``work(row of keep, distances squared, ids of a, ids of b)`` for the points of each pair of leaves."""
        rows = self.leaves()
        side = lambda s: rows.select(F.col("leaf").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "xs", "ys")])
        both = pairs.select(*keep, "a", "b").join(side("a"), "a").join(side("b"), "b")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for r in pdf.itertuples(index=False):
                    dx, dy = np.subtract.outer(r.xs_a, r.xs_b), np.subtract.outer(r.ys_a, r.ys_b)
                    out.append(work(r, dx * dx + dy * dy, np.asarray(r.ids_a), np.asarray(r.ids_b)))
                if out:
                    yield pd.concat(out)

        return both.mapInPandas(run, schema)


def _descend(tree: Tree, radii: list[float]) -> tuple[DataFrame, DataFrame]:
    """``(radius, a, n_a, n_b)`` of nodes wholly within a radius of each other, and ``(radius, a, b)`` of leaves to be compared."""
    root = tree.nodes.where("level = 0").select(F.col("node").alias("a"), F.col("node").alias("b"))
    pairs = root.select(F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius"), "a", "b")
    within, open_ = [], []
    while True:
        boxed = cut(tree.boxes(pairs).where(F.col("near") <= F.col("radius") * F.col("radius")))
        inside = F.col("far") <= F.col("radius") * F.col("radius")
        within.append(boxed.where(inside).select("radius", "a", "n_a", "n_b"))
        both = F.col("leaf_a") & F.col("leaf_b")
        open_.append(boxed.where(~inside & both).select("radius", "a", "b"))
        pairs = boxed.where(~inside & ~both)
        if pairs.isEmpty():
            break
        pairs = tree.below(pairs, ["radius"])
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(within), union(open_)


def _counted(tree: Tree, open_: DataFrame, id_type: str) -> DataFrame:
    def work(r, d2: np.ndarray, ids: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"radius": r.radius, "id": ids, "c": (d2 <= r.radius * r.radius).sum(axis=1)})

    return tree.compared(open_, ["radius"], f"radius double, id {id_type}, c bigint", work)


def pair_counts(points: DataFrame, radii: list[float], cap: int = CAP) -> DataFrame:
    """``(radius, pairs)``: ordered pairs of different points of ``(id, x, y)`` within each radius; ids are unique."""
    tree = Tree(points, cap)
    within, open_ = _descend(tree, radii)
    near = _counted(tree, open_, dict(points.dtypes)["id"]).select("radius", F.col("c").alias("pairs"))
    every = within.select("radius", (F.col("n_a") * F.col("n_b")).alias("pairs")).unionByName(near).groupBy("radius").agg(F.sum("pairs").alias("pairs"))
    n = tree.nodes.where("level = 0").select(F.col("n"))
    return every.crossJoin(F.broadcast(n)).select("radius", (F.col("pairs") - F.col("n")).alias("pairs"))  # one row: each point is near itself


def neighbour_counts(points: DataFrame, radius: float, cap: int = CAP) -> DataFrame:
    """``(id, neighbours)``: how many other points lie within the radius of each; ids are unique."""
    tree = Tree(points, cap)
    within, open_ = _descend(tree, [radius])
    sums = within.groupBy("a").agg(F.sum("n_b").alias("c"))
    over = tree.above(tree.nodes.where("leaf").select("node", "level"), ["node"])
    per_leaf = over.select(F.col("node").alias("leaf"), F.col("above").alias("a")).join(sums, "a").groupBy("leaf").agg(F.sum("c").alias("c"))
    base = tree.placed.join(per_leaf, "leaf", "left").select("id", F.coalesce("c", F.lit(0)).alias("c"))
    near = _counted(tree, open_, dict(points.dtypes)["id"]).select("id", "c")
    return base.unionByName(near).groupBy("id").agg((F.sum("c") - 1).alias("neighbours"))


def nearest(points: DataFrame, cap: int = CAP) -> DataFrame:
    """``(id, d)``: the distance to the nearest other point of ``(id, x, y)``; ids are unique. A single point has none.

    A leaf of several points bounds its points' distances by those in the leaf,
    a leaf of one by the box of the least node around it that holds two; nodes
    beyond such a bound are not looked at.
    """
    tree, kind = Tree(points, cap), dict(points.dtypes)["id"]

    def work(r, d2: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        d2[a[:, None] == b[None]] = np.inf
        return pd.DataFrame({"a": r.a, "id": a, "d2": d2.min(axis=1)})

    schema = f"a bigint, id {kind}, d2 double"
    selves = tree.nodes.where("leaf").select(F.col("node").alias("a"), F.col("node").alias("b"))
    own = cut(tree.compared(selves, [], schema, work).groupBy("a", "id").agg(F.min("d2").alias("d2")))
    # Bounds from below: of a leaf by its points; of a node by its box, if it holds two; a lone leaf takes that of the node above.
    box = (F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    leaf = own.groupBy("a").agg(F.max("d2").alias("own")).withColumnRenamed("a", "node")
    boxes = tree.nodes.where("n > 1").select(F.col("node").alias("above"), box.alias("box"))
    bound = tree.above(tree.nodes.where("leaf").select("node", "level"), ["node", "level"]).join(boxes, "above").groupBy("node", "level").agg(F.min("box").alias("box"))
    bound = cut(bound.join(leaf, "node").select("node", "level", F.least("box", "own").alias("bound")))
    bounds = cut(tree.above(bound, ["bound"]).groupBy("above").agg(F.max("bound").alias("bound")).withColumnRenamed("above", "a"))
    pairs, open_ = tree.nodes.where("level = 0").select(F.col("node").alias("a"), F.col("node").alias("b")), []
    while True:
        boxed = cut(tree.boxes(pairs).join(bounds, "a").where(F.col("near") <= F.col("bound")))
        both = F.col("leaf_a") & F.col("leaf_b")
        open_.append(boxed.where(both & (F.col("a") != F.col("b"))).select("a", "b"))
        pairs = boxed.where(~both)
        if pairs.isEmpty():
            break
        pairs = tree.below(pairs, [])
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    found = own.unionByName(tree.compared(union(open_), [], schema, work))
    return found.groupBy("id").agg(F.min("d2").alias("d2")).where(F.col("d2") < float("inf")).select("id", F.sqrt("d2").alias("d"))
