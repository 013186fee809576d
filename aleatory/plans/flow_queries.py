"""Information flow over event and order symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bytes import xorshift32
from ..functions.positions import positions
from ..operators import flow
from .estimator_queries import _SERIES, series
from .registry import query, read, rounded

_PAIR = "pr as (select row_number() over (order by event_id) - 1 as t, (event_id * 7 % 5)::int as x, (floor(value)::bigint % 3)::int as y from events)"
_EMB = f"{_PAIR}, em as (select b.t, b.y as y1, a.y as y0, a.x as x0 from pr a join pr b on b.t = a.t + 1)"
_PAT = f"{_SERIES}, ld as (select series, t, x as a, lead(x) over w as b, lead(x, 2) over w as c from ser window w as (partition by series order by t)), pat as (select series, t, ((b < a)::int + (c < a)::int) * 2 + (c < b)::int as s, ((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 3 as weight from ld where c is not null)"
_SYM = "sym as (select o_orderpriority as x, o_orderstatus as y, o_custkey % 3 as z from orders)"


def _h(cols: str) -> str:
    return f"(select -sum(c / n * log2(c / n)) from (select count(*) as c, sum(count(*)) over () as n from sym group by {cols}))"


def pairs(spark, d):
    """``(t, x, y)``: two symbols of each event, in order."""
    e = read(spark, d, "events").select("event_id", (F.col("event_id") * 7 % 5).cast("int").alias("x"), (F.floor("value") % 3).cast("int").alias("y"))
    return positions(e, [], "event_id").select("t", "x", "y")


def symbols(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("y"), (F.col("o_custkey") % 3).alias("z"))


@query("quantile_bins", f"with {_SERIES} select series, t, floor((row_number() over (partition by series order by x, t) - 1) * 8 / count(*) over (partition by series))::int as s from ser")
def _(spark, d):
    return flow.quantile_bins(series(spark, d), 8)


@query("equal_width_bins", f"with {_SERIES}, e as (select series, min(x) as lo, max(x) as hi from ser group by series) select series, t, (case when hi > lo then least(floor((x - lo) * 8 / (hi - lo)), 7) else 0 end)::int as s from ser join e using (series)")
def _(spark, d):
    return flow.equal_width_bins(series(spark, d), 8)


@query("ordinal_patterns", f"with {_PAT} select series, t, s, round(weight, 4) as weight from pat")
def _(spark, d):
    return rounded(flow.ordinal_patterns(series(spark, d)), 4)


@query("permutation_entropy", f"with {_PAT}, c as (select series, s, count(*) as c, sum(count(*)) over (partition by series) as n from pat group by series, s) select series, round(-sum(c / n * log2(c / n)) / log2(6), 6) + 0.0 as h from c group by series")
def _(spark, d):
    p = flow.ordinal_patterns(series(spark, d))
    h = flow.entropies(p, [["s"]], ["series"])
    return rounded(h.select("series", (F.col("h_s") / F.log2(F.lit(6.0))).alias("h")))


@query("weighted_permutation_entropy", f"with {_PAT}, c as (select series, s, sum(weight) as c, sum(sum(weight)) over (partition by series) as n from pat group by series, s) select series, round(-sum(case when c > 0 then c / n * log2(c / n) else 0 end), 6) + 0.0 as h from c group by series")
def _(spark, d):
    c = flow.ordinal_patterns(series(spark, d)).groupBy("series", "s").agg(F.sum("weight").alias("c")).where("c > 0")
    h = c.groupBy("series").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    return rounded(h)


@query("joint_entropy", f"with {_SYM} select count(*) as n, round({_h('x, y')}, 6) as h_xy, round({_h('x')}, 6) as h_x, round({_h('y')}, 6) as h_y from sym")
def _(spark, d):
    return rounded(flow.entropies(symbols(spark, d), [["x", "y"], ["x"], ["y"]]))


@query("mutual_information", f"with {_SYM} select count(*) as n, round(greatest({_h('x')} + {_h('y')} - {_h('x, y')}, 0), 9) as mi from sym")
def _(spark, d):
    return rounded(flow.mutual_information(symbols(spark, d)), 9)


@query("conditional_mutual_information", f"with {_SYM} select count(*) as n, round(greatest({_h('x, z')} + {_h('y, z')} - {_h('x, y, z')} - {_h('z')}, 0), 9) as cmi from sym")
def _(spark, d):
    return rounded(flow.conditional_mutual_information(symbols(spark, d)), 9)


@query("miller_madow_entropy", f"with {_SYM} select round({_h('x')} + (count(distinct x) - 1) / (2 * count(*) * ln(2)), 9) as h from sym")
def _(spark, d):
    s = symbols(spark, d)
    h = flow.entropies(s, [["x"]]).crossJoin(F.broadcast(s.agg(F.count_distinct("x").alias("k"))))  # one row each
    return rounded(h.select(flow.miller_madow(F.col("h_x"), F.col("k"), F.col("n")).alias("h")), 9)


_TE = "sum(c * log2(c * dp / (sp * df))) / sum(c)"
_MARG = "jt as (select y1, y0, x0, count(*) as c from em group by all), mg as (select *, sum(c) over (partition by y0) as dp, sum(c) over (partition by y0, x0) as sp, sum(c) over (partition by y1, y0) as df from jt)"


@query("transfer_entropy", f"with {_EMB}, {_MARG} select sum(c)::bigint as n, round(greatest({_TE}, 0), 9) as te from mg")
def _(spark, d):
    return rounded(flow.transfer_entropy(pairs(spark, d)), 9)


@query("local_transfer_entropy", f"with {_EMB}, {_MARG} select t, round(log2(c * dp / (sp * df)), 6) + 0.0 as te from em join mg using (y1, y0, x0)")
def _(spark, d):
    return rounded(flow.local_transfer_entropy(pairs(spark, d)))


_DEEP = f"{_PAIR}, la as (select t, y as y1, lag(y, 1) over w as a1, lag(y, 2) over w as a2, lag(y, 3) over w as a3, lag(x, 1) over w as b1, lag(x, 2) over w as b2, lag(x, 3) over w as b3 from pr window w as (order by t))"
_KINDS = "((select count(*) from (select distinct y1, y0 from jt)) + (select count(*) from (select distinct y0, x0 from jt)) - (select count(*) from jt) - (select count(distinct y0) from jt)) / (2 * sum(c) * ln(2))"


def _deep(k: int, first: int, l: int) -> str:  # noqa: E741
    """Embedded pairs with k symbols of y and l of x from ``first`` on; whole histories only."""
    past = lambda c, i, n: " || '/' || ".join(f"{c}{j}" for j in range(i, i + n))
    return f"{_DEEP}, em as (select t, y1, {past('a', 1, k)} as y0, {past('b', first, l)} as x0 from la where t >= {max(k, first + l - 1)})"


for _k, _l, _u in ((2, 1, 1), (3, 2, 2)):

    @query(f"transfer_entropy_k{_k}_l{_l}_lag{_u}", f"with {_deep(_k, _u, _l)}, {_MARG} select sum(c)::bigint as n, round(greatest({_TE}, 0), 9) as te from mg")
    def _(spark, d, k=_k, l=_l, u=_u):  # noqa: E741
        return rounded(flow.transfer_entropy(pairs(spark, d), lag=u, k=k, l=l), 9)

    @query(f"transfer_entropy_k{_k}_l{_l}_lag{_u}_miller_madow", f"with {_deep(_k, _u, _l)}, {_MARG} select sum(c)::bigint as n, round({_TE} + {_KINDS}, 9) as te from mg")
    def _(spark, d, k=_k, l=_l, u=_u):  # noqa: E741
        return rounded(flow.transfer_entropy(pairs(spark, d), lag=u, k=k, l=l, miller_madow=True), 9)


@query("local_transfer_entropy_k2_l2_lag2", f"with {_deep(2, 2, 2)}, {_MARG} select t, round(log2(c * dp / (sp * df)), 6) + 0.0 as te from em join mg using (y1, y0, x0)")
def _(spark, d):
    return rounded(flow.local_transfer_entropy(pairs(spark, d), lag=2, k=2, l=2))


_BACK = f"{_EMB}, {_MARG}, em2 as (select b.t, b.x as y1, a.x as y0, a.y as x0 from pr a join pr b on b.t = a.t + 1), jt2 as (select y1, y0, x0, count(*) as c from em2 group by all), mg2 as (select *, sum(c) over (partition by y0) as dp, sum(c) over (partition by y0, x0) as sp, sum(c) over (partition by y1, y0) as df from jt2)"


@query("net_transfer_entropy", f"with {_BACK} select round((select greatest({_TE}, 0) from mg) - (select greatest({_TE}, 0) from mg2), 9) as net")
def _(spark, d):
    p = pairs(spark, d)
    there = flow.transfer_entropy(p).select(F.col("te").alias("a"))
    back = flow.transfer_entropy(p.select("t", F.col("y").alias("x"), F.col("x").alias("y"))).select(F.col("te").alias("b"))
    return rounded(there.crossJoin(back).select((F.col("a") - F.col("b")).alias("net")), 9)  # one row each


_SURROGATES = 199
_DRAWS = [s for _, s in zip(range(_SURROGATES), xorshift32(), strict=False)]
_TURNED = f"""with {_PAIR}, size as (select count(*) as n from pr), off as (select i, 1 + floor((d + 0.5) / 4294967296.0::double * (n - 1))::bigint as o, n from (select unnest({_DRAWS}) as d, unnest(range({_SURROGATES})) as i), size),
tu as (select i, (t - o + n) % n as t, x from pr, off), sp as (select i, t, tu.x, y from tu join pr using (t)), own as (select -1 as i, t, x, y from pr), every as (select * from sp union all select * from own),
em as (select b.i, b.y as y1, a.y as y0, a.x as x0 from every a join every b on b.i = a.i and b.t = a.t + 1),
jt as (select i, y1, y0, x0, count(*) as c from em group by all), mg as (select *, sum(c) over (partition by i, y0) as dp, sum(c) over (partition by i, y0, x0) as sp, sum(c) over (partition by i, y1, y0) as df from jt),
te as (select i, greatest({_TE}, 0) as te from mg group by i)"""


def _surrogates(spark, d):
    p = pairs(spark, d)
    n = p.count()
    s = flow.shifted_counts(p, flow.circular_offsets(n, _SURROGATES), n)
    return flow.transfer_entropy(p), flow.transfer_entropy(s, ["surrogate"])


@query("te_permutation", f"{_TURNED}, o as (select te from te where i < 0) select round(o.te, 9) as te, round((1 + count(*) filter (round(s.te, 12) >= round(o.te, 12))) / (1 + count(*)), 9) as p from te s, o where i >= 0 group by o.te")
def _(spark, d):
    own, others = _surrogates(spark, d)
    both = others.select(F.col("te").alias("s")).crossJoin(F.broadcast(own.select("te")))  # one row
    return rounded(both.groupBy("te").agg(((1 + F.count_if(F.round("s", 12) >= F.round("te", 12))) / (1 + F.count("*"))).alias("p")), 9)


@query("effective_te", f"{_TURNED} select round((select te from te where i < 0) - (select avg(te) from te where i >= 0), 9) + 0.0 as te")
def _(spark, d):
    own, others = _surrogates(spark, d)
    return rounded(own.crossJoin(others.agg(F.avg("te").alias("m"))).select((F.col("te") - F.col("m")).alias("te")), 9)  # one row each


_SHUFFLES = 9


@query(
    "shuffled_te",
    f"""with {_PAIR}, dr as (select i, x, row_number() over (partition by i order by ('0x' || substr(md5('7:' || i || ':' || t), 1, 13))::bigint, t) - 1 as t from pr, range({_SHUFFLES}) r(i)), every as (select i, t, dr.x, y from dr join pr using (t)),
    em as (select b.i, b.y as y1, a.y as y0, a.x as x0 from every a join every b on b.i = a.i and b.t = a.t + 1),
    jt as (select i, y1, y0, x0, count(*) as c from em group by all), mg as (select *, sum(c) over (partition by i, y0) as dp, sum(c) over (partition by i, y0, x0) as sp, sum(c) over (partition by i, y1, y0) as df from jt)
    select i::int as surrogate, round(greatest({_TE}, 0), 9) as te from mg group by i""",
)
def _(spark, d):
    s = flow.permuted(pairs(spark, d), _SHUFFLES, 7)
    return rounded(flow.transfer_entropy(flow.embed(s, keys=["surrogate"]), ["surrogate"]).select("surrogate", "te"), 9)


@query(
    "windowed_te",
    f"""with {_EMB}, w as (select w, y1, y0, x0 from em, lateral (select unnest(range(greatest(ceil((t - 255) / 64.0), 0)::bigint, ((t - 1) // 64 + 1)::bigint)) as w)),
    jt as (select w, y1, y0, x0, count(*) as c from w group by all), mg as (select *, sum(c) over (partition by w, y0) as dp, sum(c) over (partition by w, y0, x0) as sp, sum(c) over (partition by w, y1, y0) as df from jt)
    select w, round(greatest({_TE}, 0), 6) as te from mg group by w having sum(c) = 255""",
)
def _(spark, d):
    return rounded(flow.windowed_transfer_entropy(pairs(spark, d), 256, 64))
