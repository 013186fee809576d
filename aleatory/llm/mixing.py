"""Mixing sources to target weights.

Tokens (words) are added up per source; a source's repetition rate is its
target over its size; each document is emitted floor(rate) times plus one more
time with probability equal to the fraction. That a source's taken words come
near its target, its documents are drawn by size class: the smallest hashes of
ids get the extra copy, as many as the fraction of the class's documents gives,
rounded up or down with the probability of its rest. A class that is rounded up
is balanced by the words that others lose, so rounding adds up to few words.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, hash_unit, small

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Each row's place by ``order`` (``i``, from 0) and the sums of columns over the rows before it, sorted and added up by many tasks; one row per partition is added up by one."""
    dealt = cut(df.orderBy(*order).withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
    inside = Window.partitionBy("p").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    every = {"i": F.lit(1), **{name: F.col(c) for name, c in sums.items()}}
    parts = dealt.groupBy("p").agg(*[F.sum(c).alias(f"all_{name}") for name, c in every.items()])
    parts = parts.select("p", *[F.coalesce(F.sum(f"all_{name}").over(before), F.lit(0)).alias(f"to_{name}") for name in every])
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"in_{name}") for name, c in every.items()]).join(F.broadcast(parts), "p")  # a row per partition
    return out.select(*df.columns, *[(F.col(f"in_{name}") + F.col(f"to_{name}")).alias(name) for name in every])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``, one row per source.

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all sizes by weight; no target passes ``most`` times its
    source's size, the excess goes to the others by weight until none does. That
    is one water level: ordered by (most * size / weight), the sources up to
    some place are full and the rest get level * weight; prefix sums find it.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = _running(sizes, [F.col("source").isNull(), F.col("source")], {})
    ranked = ranked.select("source", "source_size", F.col("i").alias("place"), turn.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    filled = cut(_running(ranked, [F.col("cap") / F.col("w"), F.col("place")], {"caps": "cap", "ws": "w"}))
    total = filled.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    # The level if a source were the first that isn't full; it is, if its own level stays under it. Then this level is everyone's.
    level = (F.col("all_size") * F.lit(float(share)) - F.col("caps")) / (F.col("all_w") - F.col("ws"))
    levels = filled.crossJoin(F.broadcast(total)).withColumn("level", level)  # one row
    first = levels.where("level * w <= cap").agg(F.min(F.struct("i", "level"))["level"].alias("level"))
    out = filled.crossJoin(F.broadcast(first))  # one row
    return out.select("source", "source_size", F.least(F.col("cap"), F.coalesce("level", F.lit(float("inf"))) * F.col("w")).alias("target"))


def _class(size: str = "size") -> Column:
    """A size cut to its first two digits."""
    digits = F.col(size).cast("string")
    return F.rpad(F.substring(digits, 1, 2), F.length(digits), F.lit("0")).cast("long")


def _copies() -> Column:
    """floor(rate), and one more with probability equal to the rest, ``u`` being the draw."""
    return (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(of, source_size, target, rate)``, one row per source, from rows of (source, size)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return small(cut(source_targets(sizes, weights, share, most).select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate"))))


def balanced(rest: list[float], weight: list[float], draw: list[float]) -> list[int]:
    """0 or 1 for each number ``rest`` from 0 to 1, each 1 with that probability, so that the sum of weight * (result - rest) is at most the last weight left open.

    One number at a time is open. It and the next are moved against each other,
    their weighted sum unchanged, until one is 0 or 1: up or down, with the odds
    that leave both means as they were. The first draw settles the last one.
    """
    out = [0] * len(rest)
    at, p, s = 0, rest[0], weight[0]
    for i in range(1, len(rest)):
        q, t = rest[i], weight[i]
        up, down = min((1 - p) / t, q / s), min(p / t, (1 - q) / s)
        rise = draw[i] * (up + down) < down
        if (1 - p) * s <= q * t if rise else p * s <= (1 - q) * t:
            out[at] = int(rise)
            at, p, s = i, q - s * (1 - p) / t if rise else q + s * p / t, t
        else:
            out[i] = int(not rise)
            p = p + q * t / s if rise else p - (1 - q) * t / s
    out[at] = int(draw[0] < p)
    return out


def _rounded(classes: pd.DataFrame) -> pd.DataFrame:
    """``(of, class, k)``: how many of each class of a source get an extra copy."""
    classes = classes.sort_values("class", ascending=False)
    whole = classes["share"] // 1
    extra = balanced((classes["share"] - whole).tolist(), classes["weight"].tolist(), classes["draw"].tolist())
    return classes[["of", "class"]].assign(k=whole.astype("int64") + extra)


def _strata(sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``(of, source_size, target, rate, class, bar)``, one row per source and size class: hashes up to ``bar`` get the extra copy (null: none does). Rows of one hash in a class are one document."""
    units = sized.groupBy("source", _class().alias("class"), "u").agg(F.sum("size").alias("size"))
    placed = cut(_running(units, [F.col("source").isNull(), F.col("source"), F.col("class"), F.col("u")], {}))
    groups = placed.groupBy(F.col("source").alias("from"), "class").agg(F.min("i").alias("lo"), F.count("*").alias("n"), F.sum("size").alias("words"))
    groups = small(cut(groups.join(plan, F.col("from").eqNullSafe(F.col("of"))).drop("from")))
    share = F.col("n") * (F.col("rate") - F.floor("rate"))
    weight = F.greatest(F.col("words") / F.col("n"), F.lit(0.001))
    shares = groups.select("of", "class", share.alias("share"), weight.alias("weight"), hash_unit(F.lit("class"), "of", "class", seed=seed).alias("draw"))
    counts = small(cut(shares.groupBy("of").applyInPandas(_rounded, "of string, class bigint, k bigint")))
    last = placed.select("source", F.col("class").alias("c"), "u", "i").join(groups, F.col("source").eqNullSafe(F.col("of")) & (F.col("c") == F.col("class"))).drop("of", "class")
    last = last.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("c") == F.col("class")))
    bar = F.max(F.when(F.col("i") - F.col("lo") < F.col("k"), F.col("u"))).alias("bar")
    return small(cut(last.groupBy("of", "source_size", "target", "rate", "class").agg(bar)))


def _drawn(rows: DataFrame, sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``rows`` with their source's plan; the draw ``u`` is 0 for those that get an extra copy, 1 for the others."""
    strata = _strata(sized, plan, seed)
    joined = rows.join(strata, F.col("source").eqNullSafe(F.col("of")) & (_class() == F.col("class")))
    return joined.withColumn("u", F.when(F.col("u") <= F.col("bar"), 0.0).otherwise(1.0))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """``(doc_id, source, size, u)``: the one pass over the texts."""
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"), hash_unit("doc_id", seed=seed).alias("u")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per document (taken = copies * size); needs ``doc_id, text, source``.

    A null text has size 0; null is a source of its own. A source of size 0 has
    target 0 and its documents 0 copies. Repeated rows get the same number of
    copies, and so do rows of one doc_id, null too, in one size class of a
    source. Other columns are not read. An empty table gives no rows. Texts are
    read once.
    """
    sized = _sized(docs, seed)
    joined = _drawn(sized, sized, _plan(sized, weights, share, most), seed)
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def emit_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """One row per copy: the documents' columns as they are, and ``copy``, from 1 (an input's ``copy`` is replaced).

    Cases as for ``mix_sources``; texts of size 0 are not emitted from sources
    of size 0. Columns may have any names. The last pass counts words again: a
    document's copies hang on its id, source and size, so no text is shuffled
    to its row of the plan.
    """
    names = [c for c in docs.columns if c != "copy"]
    sized = _sized(docs, seed)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").cast("string").alias("source"), words().alias("size"), hash_unit("doc_id", seed=seed).alias("u"))
    joined = _drawn(whole, sized, _plan(sized, weights, share, most), seed)
    out = joined.select("row", _copies().alias("copies")).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(*[F.col("row")[c].alias(c) for c in names], "copy")


#: DuckDB's equivalent of ``mix_sources``, to be given the source of documents.
SQL = r"""
with recursive base as (
  select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {documents}),
sizes as (select source, sum(size)::bigint as source_size from base group by source),
ranked as (
  select *, ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as w,
         row_number() over (order by encode(source) nulls last) as i, source_size * 2.0::double as cap from sizes),
filled as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from ranked window before as (order by cap / w, i rows between unbounded preceding and 1 preceding)),
plan as (
  select source, source_size, least(cap, coalesce((select arg_min(level, (cap / w, i)) from filled where level * w <= cap), 'inf'::double) * w) as target from filled),
mixed as (
  select b.*, p.source_size, p.target, case when p.source_size > 0 then least(p.target / p.source_size, 2.0) else 0 end as rate
  from base b join plan p on b.source is not distinct from p.source),
drawn as (
  select *, ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double as u from mixed),
classed as (
  select *, rpad(left(size::varchar, 2), length(size::varchar)::int, '0')::bigint as class from drawn),
units as (
  select source, class, u, any_value(rate - floor(rate)) as f, sum(size) as size from classed group by source, class, u),
placed as (
  select source, class, u, row_number() over (partition by source, class order by u) as j from units),
shares as (
  select source, class, count(*) * any_value(f) as share, greatest(sum(size)::double / count(*), 0.001::double) as t,
         ('0x' || substr(md5('mix|class|' || coalesce(source, 'null') || '|' || class), 1, 13))::bigint / 4503599627370496.0::double as h,
         row_number() over (partition by source order by class desc) as i from units group by source, class),
walk as (
  select source, i, class as held, share - floor(share) as p, t as s, h as h0, null::bigint as done, null::boolean as extra from shares where i = 1
  union all
  select source, i, if(hit, class, held), case when hit and rise then q - s * (1 - p) / t when hit then q + s * p / t when rise then p + q * t / s else p - (1 - q) * t / s end,
         if(hit, t, s), h0, if(hit, held, class), hit = rise
  from (select *, if(rise, (1 - p) * s <= q * t, p * s <= (1 - q) * t) as hit
        from (select *, h * (least((1 - p) / t, q / s) + least(p / t, (1 - q) / s)) < least(p / t, (1 - q) / s) as rise
              from (select b.source, b.i, b.class, b.share - floor(b.share) as q, b.t, b.h, w.held, w.p, w.s, w.h0
                    from walk w join shares b on w.source is not distinct from b.source and b.i = w.i + 1)))),
extras as (
  select source, done as class, extra from walk where done is not null
  union all select source, held, h0 < p from (select *, row_number() over (partition by source order by i desc) as z from walk) where z = 1),
mix as (
  select c.*, (floor(rate) + (p.j <= floor(s.share) + e.extra::int)::int)::int as copies
  from classed c join placed p on c.source is not distinct from p.source and c.class = p.class and c.u = p.u
  join shares s on c.source is not distinct from s.source and c.class = s.class join extras e on c.source is not distinct from e.source and c.class = e.class)
"""
