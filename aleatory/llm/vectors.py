"""Embedding near-duplicates by sorted projection passes.

In a pass every vector gets a code of concatenated random hashes (the sides of
random hyperplanes that it lies on), and the vectors are ordered by label and
code. Each is compared with a bounded window of its neighbours in that order;
links of all passes are joined by connected components. Near vectors agree in
most hashes, so they stand near each other in some pass.

Vectors that are equal in every component collapse to one class first, so
copies fill no window. A window's links go on as a spanning forest, never as
all pairs. What a window's bound may leave out is made up for exactly: links
are counted among all classes of a component. In a large component almost all
pairs are settled by the angles to its centre (the triangle inequality); only
pairs that these leave open are compared, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small
from .components import components
from .mixing import _running

#: Neighbours that a vector is compared with on either side, and rows of one segment of an order.
WINDOW, SEGMENT = 128, 4096
#: Hashes in a code.
BITS = 62
#: Share of the links at the least similarity that the passes are to find by themselves.
RECALL = 0.99
#: Components up to this size are compared whole; sides of a block hold so many classes.
BLOCK = 512
#: Angles to a centre are rounded to the threshold's angle over STEPS; ZONE steps make a zone.
STEPS, ZONE = 256, 16


def passes_needed(n: int, similarity: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the least similarity among n vectors has met with probability ``recall``.

    Two vectors at an angle t agree in a random hyperplane with probability
    1 - t / pi. Those that agree with a vector in log2(n / window) leading
    hashes fill about one window, so a pair that does so meets.
    """
    depth = math.log2(max(n / window, 1))
    meet = (1 - math.acos(similarity) / math.pi) ** depth
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length in double precision, padded with zeros, and their sizes. Scaled by the largest component first, so that squares stay finite."""
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(off)
    out = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    out[np.arange(out.shape[1]) < size[:, None]] = flat[off[0] : off[-1]]
    out /= np.abs(out).max(axis=1, keepdims=True)
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out, size


def _codes(batches: Iterator[pa.RecordBatch], passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """``(group, rid, codes)``: a code for each pass, of BITS hyperplanes drawn by the seed and the vectors' length."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        x, size = unit_rows(batch.column("v"))
        out = np.zeros((len(x), passes), np.int64)
        for d in np.unique(size):
            if d not in planes:
                planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((passes, d, BITS))
            these = np.flatnonzero(size == d)
            for p in range(passes):
                out[these, p] = ((x[these, :d] @ planes[d][p]) > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        where = pa.array(np.arange(len(x) + 1) * passes, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("rid"), pa.ListArray.from_arrays(where, pa.array(out.ravel()))], names=["group", "rid", "codes"])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each row that isn't the least of its component, and that least row."""
    low = np.arange(n)
    while len(a):
        x, y = np.minimum(low[a], low[b]), np.maximum(low[a], low[b])
        if (x == y).all():
            break
        np.minimum.at(low, y, x)
        while (low[low] != low).any():
            low = low[low]
    rows = np.flatnonzero(low != np.arange(n))
    return low[rows], rows


def neighbours(x: np.ndarray, group: np.ndarray, window: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between ordered rows of equal group that are at most ``window`` places apart."""
    left, right = [], []
    for i in range(0, len(x), window):
        rows, wide = slice(i, i + window), slice(i, i + 2 * window)
        at, to = np.nonzero((x[rows] @ x[wide].T >= similarity) & (group[rows, None] == group[None, wide]))
        near = (to > at) & (to - at <= window)
        left.append(at[near] + i)
        right.append(to[near] + i)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of sorted batches with equal keys; a group may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.append(0, np.flatnonzero(new))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            yield tuple(c[a] for c in cols), batch.slice(a, b - a)


def _window_links(batches: Iterator[pa.RecordBatch], window: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (segment, i): the forest of each segment's links. A segment holds the first ``window`` rows of the next one too."""
    held: list[pa.RecordBatch] = []

    def links() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        x, _ = unit_rows(whole.column("v").chunk(0))
        rid = whole.column("rid").to_numpy()
        a, b = forest(*neighbours(x, whole.column("group").to_numpy(), window, similarity), len(x))
        return pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(rid[b])], names=["a", "b"])

    last = None
    for key, part in _groups(batches, ("segment",)):
        if key != last and held:
            yield links()
            held = []
        last = key
        held.append(part)
    if held:
        yield links()


def _centre_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each batch's unit vectors of a component."""
    for batch in batches:
        x, _ = unit_rows(batch.column("v"))
        comp, at = np.unique(batch.column("comp").to_numpy(), return_inverse=True)
        total = np.zeros((len(comp), x.shape[1]))
        np.add.at(total, at, x)
        where = pa.array(np.arange(len(comp) + 1) * x.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(comp), pa.ListArray.from_arrays(where, pa.array(total.ravel()))], names=["comp", "total"])


def _angles(batches: Iterator[pa.RecordBatch], alpha: float) -> Iterator[pa.RecordBatch]:
    """Each class's angle to its component's centre in whole steps, rounded down."""
    for batch in batches:
        x, _ = unit_rows(batch.column("v"))
        c, _ = unit_rows(batch.column("centre"))
        angle = np.arccos(np.clip((x * c).sum(axis=1), -1, 1))
        step = np.floor(angle / (alpha / STEPS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("comp"), batch.column("weight"), pa.array(step)], names=["rid", "comp", "weight", "step"])


#: Steps of two angles that are surely links (at most SURE together) and surely none (at least APART apart); rounding costs a step each, error in the angles one more.
SURE, APART = STEPS - 3, STEPS + 2


def _block_counts(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, role): classes of role 1 count their links among those of role 0 before them."""
    last, held, side = None, [], None
    for (block, role), part in _groups(batches, ("block", "role")):
        if block != last:
            last, held, side = block, [], None
        if role == 0:
            held.append(part)
            continue
        if not held:
            continue
        if side is None:
            whole = pa.Table.from_batches(held).combine_chunks()
            side = unit_rows(whole.column("v").chunk(0))[0], *(whole.column(c).to_numpy() for c in ("rid", "weight", "step"))
        x, (y, rid, weight, step) = unit_rows(part.column("v"))[0], side
        own, at = part.column("rid").to_numpy(), part.column("step").to_numpy()
        open_ = (at[:, None] + step[None] > SURE) & (np.abs(at[:, None] - step[None]) < APART) | (at[:, None] < 0)
        link = open_ & (own[:, None] != rid[None]) & (x @ y.T >= similarity)
        yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(link @ weight)], names=["rid", "links"])


def _number(width: Column, by: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.greatest(width, F.lit(1)))


def _count_links(classes: DataFrame, member: DataFrame, similarity: float) -> DataFrame:
    """``(rid, links)``: how many vectors of other classes of its component each class is linked with, exactly."""
    sizes = member.groupBy("comp").agg(F.count("*").alias("m"))
    placed = cut(classes.select("rid", "v", "weight").join(small(cut(member.join(sizes, "comp"))), "rid"))
    one = placed.where(F.col("m") <= BLOCK).select(F.xxhash64("comp").alias("block"), "rid", "v", "weight", F.lit(-1).cast("long").alias("step"))
    sides = one.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("role"))
    large = placed.where(F.col("m") > BLOCK)
    sure = None
    if not large.isEmpty():
        alpha = math.acos(similarity)
        sums = large.select("comp", "v").mapInArrow(_centre_sums, "comp long, total array<double>")
        total = sums.select("comp", F.posexplode("total")).groupBy("comp", "pos").agg(F.sum("col").alias("x"))
        centre = total.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))
        # A sum of 0 is no direction; any will do then, as angles to it only sort out pairs.
        centre = cut(centre.select("comp", F.when(F.exists("centre", lambda x: x != 0), F.col("centre")).otherwise(F.transform("centre", lambda x: F.lit(1.0))).alias("centre")))
        angled = cut(large.join(small(centre, items="centre"), "comp").select("rid", "comp", "weight", "v", "centre").mapInArrow(lambda it: _angles(it, alpha), "rid long, comp long, weight long, step long"))
        steps = cut(angled.groupBy("comp", "step").agg(F.sum("weight").alias("w"), F.count("*").alias("c")))
        # Sure links of a step: all vectors of steps up to SURE less it; a component has at most STEPS * pi / alpha steps.
        other = steps.select("comp", F.col("step").alias("to"), F.col("w").alias("w_to"))
        by_step = steps.join(other, "comp").where(F.col("step") + F.col("to") <= SURE).groupBy("comp", "step").agg(F.sum("w_to").alias("near"))
        own = F.when(2 * F.col("step") <= SURE, F.col("weight")).otherwise(0)
        sure = angled.join(small(cut(by_step)), ["comp", "step"]).select("rid", (F.col("near") - own).alias("links"))
        # Zones whose pairs may be open meet in blocks of bounded sides.
        zones = steps.withColumn("zone", F.floor(F.col("step") / ZONE).cast("int")).groupBy("comp", "zone").agg(F.min("step").alias("least"), F.max("step").alias("most"), F.ceil(F.sum("c") / BLOCK).cast("int").alias("chunks"))
        a, b = (zones.select("comp", *[F.col(c).alias(f"{c}_{s}") for c in ("zone", "least", "most", "chunks")]) for s in "ab")
        apart = F.greatest(F.col("least_a") - F.col("most_b"), F.col("least_b") - F.col("most_a"))
        met = cut(a.join(b, "comp").where((F.col("most_a") + F.col("most_b") > SURE) & (apart < APART)))
        held = angled.withColumn("zone", F.floor(F.col("step") / ZONE).cast("int"))
        there = lambda s: F.transform(F.sequence(F.lit(0), F.col(f"chunks_{s}") - 1), lambda i: i)
        mine = lambda s: _number(F.col(f"chunks_{s}"), F.col("rid")).cast("int")
        block = lambda za, ca, zb, cb: F.xxhash64(F.lit("zones"), "comp", za, ca, zb, cb).alias("block")
        keep = held.join(small(met.withColumnRenamed("zone_a", "zone")), ["comp", "zone"]).select("comp", "rid", "weight", "step", "zone", "zone_b", mine("a").alias("c"), F.explode(there("b")).alias("d"))
        keep = keep.select("rid", "weight", "step", block("zone", "c", "zone_b", "d"), F.lit(0).alias("role"))
        ask = held.join(small(met.withColumnRenamed("zone_b", "zone")), ["comp", "zone"]).select("comp", "rid", "weight", "step", "zone", "zone_a", mine("b").alias("d"), F.explode(there("a")).alias("c"))
        ask = ask.select("rid", "weight", "step", block("zone_a", "c", "zone", "d"), F.lit(1).alias("role"))
        wanted = keep.unionByName(ask)
        sent = wanted.join(placed.select("rid", "v"), "rid")
        sides = sides.select("block", "rid", "v", "weight", "step", "role").unionByName(sent.select("block", "rid", "v", "weight", "step", "role"))
    dealt = sides.repartition("block").sortWithinPartitions("block", "role")
    counts = dealt.mapInArrow(lambda it: _block_counts(it, similarity), "rid long, links long")
    counts = counts if sure is None else counts.unionByName(sure)
    return counts.groupBy("rid").agg(F.sum("links").alias("links"))


def _fine(v: Column) -> Column:
    """Every component a finite number, and one of them not 0."""
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)


def near_vectors(vectors: DataFrame, similarity: float = 0.93, window: int = WINDOW, recall: float = RECALL, passes: int | None = None, seed: int = 11) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector; needs ``vec_id``, ``embedding`` (an array of numbers) and ``label``.

    Vectors of equal label and length are linked if their cosine in double
    precision is at least ``similarity``. ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest vec_id reachable by
    links, ``kept`` says that it is the vector's own. No link is below the
    threshold. The number of passes follows from ``recall`` and the rows of the
    largest label (``passes_needed``), unless given; links of a component are
    then counted whole, so a link is missed only if no chain of found links
    joins its ends. With up to ``window`` vectors of each label the result is
    exact.

    Null, empty and zero vectors, vectors with a null or non-finite component
    and those of null label link with nothing. Repeated rows are vectors of
    their own, linked with each other. A null vec_id never names a component
    that has another id. Other columns are not read. An empty table gives no
    rows. ``similarity`` lies between 0 and 1, both excluded.
    """
    held = vectors.schema["embedding"].dataType
    kind = held.simpleString() if held.simpleString() in ("array<float>", "array<double>") else "array<double>"
    v = F.col("embedding").cast(kind)
    base = vectors.select(F.col("vec_id").cast("long").alias("vid"), F.col("label").cast("string").alias("label"), v.alias("v"))
    base = base.select("vid", "label", "v", F.coalesce(_fine(F.col("v")) & F.col("label").isNotNull(), F.lit(False)).alias("fine"))
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(kind[6:-1]))  # -0.0 is 0.0
    base = base.select("vid", "label", "v", "fine", F.xxhash64("label", plain).alias("h1"), F.xxhash64(F.lit("again"), plain, "label").alias("h2"))
    rows = cut(base.select("vid", "fine", "h1", "h2"))
    classes = base.where("fine").groupBy("h1", "h2").agg(F.min("vid").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"), F.xxhash64(F.first("label"), F.size(F.first("v"))).alias("group"))
    classes = cut(classes.withColumn("rid", F.monotonically_increasing_id()))

    most = classes.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    passes = passes_needed(most, similarity, window, recall) if passes is None else passes
    coded = classes.select("group", "rid", "v").mapInArrow(lambda it: _codes(it, passes, seed), "group long, rid long, codes array<long>")
    each = coded.select("group", "rid", F.posexplode("codes").alias("pass", "code"))
    order = _running(each, [F.col("pass"), F.col("group"), F.col("code"), F.col("rid")], {})
    long = max(SEGMENT, window)  # so that a window reaches no further than the next segment
    segment = F.floor(F.col("i") / long)
    to = F.when((F.col("i") % long < window) & (segment > 0), F.array(segment, segment - 1)).otherwise(F.array(segment))
    seen = order.select("rid", F.explode(to).alias("segment"), "i", "pass")
    places = seen.groupBy("rid").agg(F.collect_list(F.struct("segment", "i", "pass")).alias("at"))  # two of each pass at most
    placed = classes.select("rid", "group", "v").join(places, "rid").select("rid", F.explode("at").alias("at"), "group", "v")
    placed = placed.select("rid", "at.segment", "at.i", F.xxhash64("group", "at.pass").alias("group"), "v")
    links = cut(placed.repartition("segment").sortWithinPartitions("segment", "i").mapInArrow(lambda it: _window_links(it, window, similarity), "a long, b long"))

    member = cut(components(links, "a", "b").select(F.col("node").alias("rid"), F.col("component").alias("comp")))
    counted = _count_links(classes, member, similarity)
    known = classes.select("rid", "h1", "h2", "id", "weight").join(member, "rid", "left").join(counted, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    lowest = known.groupBy("comp").agg(F.min("id").alias("component_id"))
    label = cut(known.join(lowest, "comp").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    out = rows.join(small(label), ["h1", "h2"], "left").select("vid", F.when(F.col("fine"), F.col("n_links")).otherwise(0).alias("n_links"), F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vid")).alias("component_id"))
    return out.select(F.col("vid").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vid").eqNullSafe(F.col("component_id")).alias("kept"))


#: DuckDB's equivalent with the default threshold.
SQL = """
with recursive given as (
  select vec_id, label, embedding::double[] as v, embedding is not null and label is not null and coalesce(len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0, false) as fine from embeddings),
ok as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from given where fine),
links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach as (select vec_id as a, vec_id as b from given union select r.a, l.b from reach r join links l on r.b = l.a)
select g.vec_id, (select count(*) from links l where l.a = g.vec_id) as n_links, min(r.b) as component_id, g.vec_id = min(r.b) as kept
from given g join reach r on r.a = g.vec_id group by g.vec_id
"""
