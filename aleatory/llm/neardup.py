"""Near-duplicate documents: many universal hash minima, banding, verification on full shingle sets, components.

How the work stays linear: documents with equal shingle sets collapse to one
class first. Classes of a small LSH bucket are compared pair by pair. In a
large bucket every class is compared with one pivot, the class that most large
buckets share. What no pivot explains (classes outside the main component of
a family of overlapping large buckets) is then compared with its whole family
in bounded blocks, so large buckets lose no link either. All links are
confirmed on full sets read from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, small
from ._text import mix, shingle_sets, text_slices
from .components import components

#: Buckets up to this size are compared pair by pair.
SMALL = 32
#: Classes in one side of a block, and partners of a pivot in one group.
BLOCK = 512


#: A row of the input: its id and two hashes of its text.
_KEY = ("did", "h1", "h2")


def minima(hashes: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k multiply-shift minima (upper 32 bits) of each non-empty set; one row per set."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    out = np.empty((len(offsets) - 1, k), np.uint32)
    v = np.empty_like(hashes)
    for j in range(k):
        np.multiply(hashes, mul[j], out=v)
        v += add[j]
        out[:, j] = np.minimum.reduceat(v, offsets[:-1]) >> np.uint64(32)
    return out


def _features(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    codes = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        for a, b, data, bounds in text_slices(batch.column("text")):
            h, off = shingle_sets(data, bounds, n)
            size = np.diff(off)
            some = np.flatnonzero(size)
            f1, f2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            keys = [[]] * (b - a)
            if len(some):
                at = off[some]
                f1[some] = np.add.reduceat(mix(h), at)
                f2[some] = np.bitwise_xor.reduceat(mix(h * np.uint64(0xD6E8FEB86659FD93)), at)
                m = minima(h, np.append(at, len(h)), bands * rows, seed).astype(np.uint64)
                key = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + m[:, r::rows] + codes)
                flat = pa.array(key.view(np.int64).ravel())
            where = np.zeros(b - a + 1, np.int32)
            where[1:] = np.cumsum(size > 0) * bands
            lists = pa.ListArray.from_arrays(pa.array(where), flat if len(some) else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(a, b - a) for c in _KEY], pa.array(size.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists],
                names=[*_KEY, "n", "f1", "f2", "bands"],
            )


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, b, data, bounds in text_slices(batch.column("text")):
        h, off = shingle_sets(data, bounds, n)
        for r in range(b - a):
            yield a + r, h[off[r] : off[r + 1]]


def _similar(inter: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (x + y - inter)


def _verify_pivots(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (target, part), the target itself first: compare each row with its target."""
    group, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        target, part, rid = (batch.column(c).to_numpy() for c in ("target", "part", "rid"))
        us, vs = [], []
        for r, s in _sets(batch, n):
            if rid[r] == target[r]:
                group, own = (target[r], part[r]), s
                continue
            assert group == (target[r], part[r])
            inter = np.intersect1d(own, s, assume_unique=True).size
            if _similar(inter, len(own), len(s), percent):
                us.append(target[r])
                vs.append(rid[r])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["a", "b"])


class _Block:
    """Inverted index over the sets of one side of a block."""

    def __init__(self, rids: list[int], comps: list[int], sets: list[np.ndarray]) -> None:
        self.rid, self.comp = np.array(rids, np.int64), np.array(comps, np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.terms, first = np.unique(flat[order], return_index=True)
        self.owner, self.ptr = owner[order], np.append(first, len(flat))

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, s), len(self.terms) - 1)
        at = at[self.terms[at] == s]
        lo, count = self.ptr[at], self.ptr[at + 1] - self.ptr[at]
        flat = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        return np.bincount(self.owner[flat], minlength=len(self.rid))


def _verify_blocks(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (family, oc, mc, role): first the classes to explain (role 0), then the members they may link to."""
    group, rids, comps, sets, block, seen = None, [], [], [], None, set()
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("family", "oc", "mc", "role", "rid", "comp")}
        us, vs = [], []
        for r, s in _sets(batch, n):
            g = (cols["family"][r], cols["oc"][r], cols["mc"][r])
            if g != group:
                group, rids, comps, sets, block, seen = g, [], [], [], None, set()
            rid, comp = cols["rid"][r], cols["comp"][r]
            if cols["role"][r] == 0:
                rids.append(rid)
                comps.append(comp)
                sets.append(s)
                continue
            if not rids:
                continue
            block = block or _Block(rids, comps, sets)
            hit = np.flatnonzero(_similar(block.overlaps(s), block.size, len(s), percent) & (block.comp != comp))
            for i in hit:
                if (key := (int(block.comp[i]), comp)) not in seen:  # one link between two components is enough
                    seen.add(key)
                    us.append(int(block.rid[i]))
                    vs.append(rid)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["a", "b"])


def _key(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("did"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("again")).alias("h2")]


def _classes(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``(did, h1, h2, n, component, component_id)``, one row per input row; without shingles ``component`` is null."""
    base = docs.select(*_key(docs), F.col("text").cast("string").alias("text"))
    feats = cut(base.mapInArrow(lambda it: _features(it, shingle, bands, rows, seed), "did long, h1 long, h2 long, n long, f1 long, f2 long, bands array<long>"))
    reps = cut(
        feats.where("n > 0")
        .groupBy("f1", "f2", "n")
        .agg(F.min(F.struct("h1", "h2")).alias("at"), F.min("did").alias("id"), F.first("bands").alias("bands"))
        .select("f1", "f2", "n", "at.h1", "at.h2", "id", "bands", F.monotonically_increasing_id().alias("rid"))
    )
    each = reps.select("rid", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = cut(each.join(shared, "key"))

    tiny, large = members.where(F.col("m") <= SMALL), members.where(F.col("m") > SMALL)
    other = tiny.select("key", F.col("rid").alias("b"))
    pairs = tiny.select("key", F.col("rid").alias("a")).join(other, "key").where("a < b").select("a", "b")
    central = large.groupBy("rid").agg(F.sum("m").alias("central"))
    pivots = cut(large.join(central, "rid").groupBy("key").agg(F.max_by("rid", F.struct("central", -F.col("rid"))).alias("pivot")))
    spokes = cut(large.join(pivots, "key").where("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct())
    ordered = spokes.select("a", "b")
    pairs = cut(pairs.unionByName(ordered).distinct())

    def texts(wanted: DataFrame) -> DataFrame:
        """The text of each class asked for (rid and columns of its own); texts that nobody asks for aren't shuffled where the list of those asked for is small."""
        asked = cut(wanted.join(reps.select("rid", "h1", "h2"), "rid"))
        held = base.select("h1", "h2", "text").join(small(asked.select("h1", "h2")), ["h1", "h2"], "left_semi")
        return asked.join(held.dropDuplicates(["h1", "h2"]), ["h1", "h2"])  # copies are met before the shuffle

    # Each pair's second class travels to its first; a pivot's many partners are parted.
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sent = pairs.join(parts, "a").select(F.col("b").alias("rid"), F.struct(F.col("a").alias("target"), F.pmod(F.hash("b"), "parts").alias("part")).alias("to"))
    selves = parts.select(F.col("a").alias("rid"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.col("a").alias("target"), i.alias("part")))).alias("to"))
    wanted = sent.unionByName(selves).groupBy("rid").agg(F.collect_list("to").alias("to"))
    rows_ = texts(wanted).select("rid", "text", F.explode("to").alias("to")).select("to.target", "to.part", "rid", "text")
    sorted_ = rows_.repartition(F.col("target"), F.col("part")).sortWithinPartitions("target", "part", F.col("rid") != F.col("target"))
    links = cut(sorted_.mapInArrow(lambda it: _verify_pivots(it, shingle, percent), "a long, b long"))
    found = components(links, "a", "b")

    if not spokes.isEmpty():
        family = components(spokes, "a", "b").select(F.col("node").alias("rid"), F.col("component").alias("family"))
        placed = cut(family.join(found.select(F.col("node").alias("rid"), F.col("component").alias("comp")), "rid", "left").withColumn("comp", F.coalesce("comp", "rid")))
        counted = placed.groupBy("family", "comp").agg(F.count("*").alias("c"))
        main = counted.groupBy("family").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.sum("c").alias("size"), F.count("*").alias("comps"), F.max("c").alias("most"))
        main = cut(main.where("comps > 1").select("family", "main", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("ocs"), F.ceil(F.col("size") / BLOCK).cast("int").alias("mcs")))
        if not main.isEmpty():
            inside = placed.join(main, "family")
            chunk = lambda n: F.pmod(F.hash("rid"), n)
            block = lambda oc, mc, role: F.struct(F.col("family"), oc.cast("int").alias("oc"), mc.cast("int").alias("mc"), F.lit(role).alias("role"), F.col("comp"))
            to_o = inside.where("comp <> main").select("rid", F.transform(F.sequence(F.lit(0), F.col("mcs") - 1), lambda i: block(chunk("ocs"), i, 0)).alias("to"))
            to_m = inside.select("rid", F.transform(F.sequence(F.lit(0), F.col("ocs") - 1), lambda i: block(i, chunk("mcs"), 1)).alias("to"))
            wanted = to_o.unionByName(to_m).groupBy("rid").agg(F.flatten(F.collect_list("to")).alias("to"))
            sides = texts(wanted).select("rid", "text", F.explode("to").alias("to")).select("to.*", "rid", "text")
            sides = sides.repartition("family", "oc", "mc").sortWithinPartitions("family", "oc", "mc", "role")
            more = cut(sides.mapInArrow(lambda it: _verify_blocks(it, shingle, percent), "a long, b long"))
            if not more.isEmpty():
                found = components(links.unionByName(more), "a", "b")

    label = reps.select("f1", "f2", "n", "rid", "id").join(found.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    lowest = label.groupBy("component").agg(F.min("id").alias("component_id"))
    label = cut(label.join(lowest, "component").select("f1", "f2", "n", "component", "component_id"))
    return feats.select(*_KEY, "n", "f1", "f2").join(small(label), ["f1", "f2", "n"], "left").select(*_KEY, "n", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 26, rows: int = 5, seed: int = 7) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row; needs ``doc_id`` and ``text``.

    A-Z is lower-cased; words are runs of anything but space and \\t..\\r; a
    document's set holds its distinct ``shingle``-word shingles (its whole word
    sequence, if that is shorter). Documents with a Jaccard similarity of at
    least ``percent`` / 100 are linked; ``component_id`` is the smallest doc_id
    reachable, ``kept`` says that it is the row's own. With 26 bands of 5
    minima a pair at 0.8 is missed with probability 3e-5, at 0.85 with 2e-7.

    Null or blank texts have an empty set and link with nothing. A null doc_id
    never names a component that has another id. Rows with equal doc_id are
    separate documents (each kept, if its component has that id). Other
    columns are not read. An empty table gives an empty result. Components
    that don't settle within ``components``' rounds are an error, not a loss.
    """
    out = _classes(docs, shingle, percent, bands, rows, seed)
    component = F.when(F.col("n") == 0, F.col("did")).otherwise(F.col("component_id"))
    return out.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("did").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 26, rows: int = 5, seed: int = 7) -> DataFrame:
    """The documents less all rows but one of each near-duplicate component; columns stay as they are and may have any names.

    The row of a component's smallest doc_id stays (null ids last; of equal ids
    the one of the smaller text hash; of equal rows any). It is rows that go, not ids: of
    two different texts under one id only the copy goes. Rows of null id are
    documents like others. Rows without words (null or blank texts) all stay.
    An empty table gives an empty one.
    """
    found = cut(_classes(docs, shingle, percent, bands, rows, seed))
    member = found.where("n > 0").groupBy("component", *_KEY).agg(F.count("*").alias("rows"))
    order = F.struct(F.col("did").isNull().alias("none"), *_KEY)
    best = member.groupBy("component").agg(F.min(order).alias("best"))
    judged = cut(member.join(best, "component").select(*_KEY, "rows", (order == F.col("best")).alias("kept")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(docs))

    def among(keys: DataFrame, how: str) -> DataFrame:
        keys = small(keys.select(*[F.col(c).alias(f"k_{c}") for c in _KEY]))
        return whole.join(keys, (F.col("h1") == F.col("k_h1")) & (F.col("h2") == F.col("k_h2")) & F.col("did").eqNullSafe(F.col("k_did")), how)

    again = judged.where("kept and rows > 1")
    if again.isEmpty():
        out = among(judged.where("not kept"), "left_anti")
    else:
        w = Window.partitionBy(*_KEY).orderBy(F.xxhash64("row"))
        one = among(again, "left_semi").withColumn("r", F.row_number().over(w)).where("r = 1")  # the first of each is found before the shuffle too
        out = among(judged.where("not kept or rows > 1"), "left_anti").unionByName(one.drop("r"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


__all__ = ["keep_one", "minima", "near_duplicates"]
