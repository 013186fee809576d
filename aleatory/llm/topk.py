"""Exact top-k inner-product search over an impact-ordered index.

Rows are cut into blocks. A block's index holds, per dimension, its rows
ordered by their impact (an integer component) in segments of equal quantised
impact. A query adds up segments' greatest contributions in descending order, and stops
when the bounds prove that no other row can enter its best k; the rows that
still may are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

BLOCK = 4096
QUERIES = 1024
#: Impacts are quantised to this width.
WIDTH = 4
ROUNDS = 12


class ImpactIndex:
    """Posting segments (dimension, impact // WIDTH) of one block of integer vectors, with their least and greatest impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type = np.float64) -> None:
        self.kind = kind  # of sums: float64 where they stay below 2**53, int64 where they need not
        self.ids, self.vectors, self.exact = ids, vectors, vectors.astype(kind)
        n, dims = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        impact = np.take_along_axis(vectors, order, 0).T
        new = np.ones((dims, n), bool)
        new[:, 1:] = impact[:, 1:] // WIDTH != impact[:, :-1] // WIDTH
        self.postings = order.T.ravel()
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], n * dims)
        flat = impact.ravel()
        self.low, self.high = flat[self.start].astype(kind), flat[self.end - 1].astype(kind)
        self.dim = self.start // n

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but ``own``, ties to the smaller id.

        A row's score is at most what it has gained plus, for each dimension yet
        to come, the contribution of the next segment. The exact scores of the k
        rows ahead are a bar that the k-th best reaches; rows that can't reach it
        are out. Once few are left, they are scored exactly.
        """
        n, dims = self.vectors.shape
        gain = np.maximum(query[self.dim] * self.low, query[self.dim] * self.high)
        by = np.argsort(-gain, kind="stable")
        start, size, gain = self.start[by], (self.end - self.start)[by], gain[by]
        through = np.cumsum(size)
        done, pending = np.zeros(n, self.kind), np.full(n, dims)
        left = np.flatnonzero(self.ids != own)
        at = 0
        for target in np.linspace(0, n * dims, ROUNDS + 1)[1:]:
            if len(left) <= max(k, n // 8) or at == len(by):
                break
            to = min(int(np.searchsorted(through, target)) + 1, len(by))
            count = size[at:to]
            flat = np.repeat(start[at:to] - (through[at:to] - count - (through[at] - size[at])), count) + np.arange(count.sum())
            rows = self.postings[flat]
            if self.kind is np.float64:
                done += np.bincount(rows, np.repeat(gain[at:to], count), n)
            else:
                np.add.at(done, rows, np.repeat(gain[at:to], count))
            pending -= np.bincount(rows, minlength=n)
            at = to
            ahead = left[np.argpartition(done[left], len(left) - k)[len(left) - k :]]
            bar = (self.exact[ahead] @ query).min()
            ceiling = gain[at] if at < len(by) else self.kind(0)
            left = left[done[left] + pending[left] * ceiling >= bar]
        score = self.exact[left] @ query
        best = np.lexsort((self.ids[left], -score))[:k]
        return self.ids[left[best]], score[best].astype(np.int64)


def _stack(values: list[np.ndarray]) -> np.ndarray:
    dims = max(map(len, values), default=0)
    out = np.zeros((len(values), max(dims, 1)), np.int64)
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int, kind: type = np.float64) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, queries, role): a block's vectors, then the queries that search it."""
    group, ids, vecs, index = None, [], [], None
    for batch in batches:
        block, part, role, vid = (batch.column(c).to_pylist() for c in ("block", "part", "role", "vec_id"))
        off, flat = batch.column("v").offsets.to_numpy(), batch.column("v").values.to_numpy(zero_copy_only=False)
        v = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        out: tuple[list, list, list] = ([], [], [])
        for r in range(len(block)):
            if (g := (block[r], part[r])) != group:
                group, ids, vecs, index = g, [], [], None
            if role[r] == 0:
                ids.append(vid[r])
                vecs.append(v[r])
                continue
            if not ids:
                continue
            index = index or ImpactIndex(np.array(ids, np.int64), _stack(vecs), kind)
            dims = index.vectors.shape[1]
            q = np.zeros(dims, kind)
            q[: len(v[r])] = v[r][:dims]
            who, score = index.search(q, vid[r], k)
            out[0].extend([vid[r]] * len(who))
            out[1].extend(who.tolist())
            out[2].extend(score.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of each query, a row whose vec_id is divisible by ``every``.

    Components become floor(scale * x) of x as double; the score is their
    integer inner product, ties go to the smaller vec_id, a query never finds
    its own vec_id. Vectors that are null or hold a null or non-finite component
    take no part, nor do rows without vec_id; empty vectors score 0; a shorter
    vector counts as padded with zeros. Repeated rows of one vec_id and vector
    count once; different vectors under one vec_id are rows of their own, and as
    queries share one list. Scores that 64 bits might not hold are an error;
    those over 2**53 are added up as integers, not doubles. Each query block meets each vector block in a task of its own of
    bounded size; every row is indexed.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = cut(vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).cast("array<bigint>").alias("v")).distinct())
    asked = rows.where(F.col("vec_id") % every == 0)
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("decimal(38,0)"))))).alias("c"), F.max(F.size("v")).alias("d")).first()
    bound = int(most["c"] or 0) ** 2 * int(most["d"] or 0)  # of any score
    if bound >= 1 << 63:
        raise ValueError("scores may not fit into 64 bits: scale the components down")
    kind = np.float64 if bound < 1 << 53 else np.int64
    blocks, parts = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // QUERIES))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    held = rows.select(spread(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("role"), "vec_id", "v")
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), spread(parts, 2).alias("part"), F.lit(1).alias("role"), "vec_id", "v")
    dealt = held.unionByName(asks).repartition(min(blocks * parts, 2000), "block", "part").sortWithinPartitions("block", "part", "role")
    found = dealt.mapInArrow(lambda it: _search(it, k, kind), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with ok as (
  select distinct vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from ok q join ok c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""
