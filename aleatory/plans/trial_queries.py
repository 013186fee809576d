"""Trials, calibration, z-scores and statistics over sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics as nu
from ..operators import network as net
from ..operators import trials as tr
from .registry import BYTES, TRIALS, Z, chi2_sf_sql, chunk_stream, gamma_p_sql, norm_cdf_sql, norm_ppf_sql, query, read, rounded, trials256, z256


@query("trials_from_bytes", f"with {BYTES} select source, pos // 32 as t, sum(bit_count(b))::int as sum from byt group by all having count(*) = 32")
def _(spark, d):
    return tr.trials_from_bytes(chunk_stream(spark, d), 256)


@query("trials_k200", f"with {BYTES} select source, pos // 25 as t, sum(bit_count(b))::int as sum from byt group by all having count(*) = 25")
def _(spark, d):
    return tr.trials_from_bytes(chunk_stream(spark, d), 200)


@query(
    "trials_k12",
    f"""with {BYTES}, bits as (select source, pos * 8 + i as p, (b >> (7 - i)::int) & 1 as bit from byt, range(0, 8) r(i))
    select source, p // 12 as t, sum(bit)::int as sum from bits group by all having count(*) = 12""",
)
def _(spark, d):
    return tr.trials_from_bytes(chunk_stream(spark, d), 12)


@query("calibrate", f"with {TRIALS} select source, count(*) as trials, round(avg(sum), 6) as mean, round(stddev_samp(sum), 6) as sd from tri group by source having count(*) >= 500 and stddev_samp(sum) > 0")
def _(spark, d):
    return rounded(tr.calibrate(trials256(spark, d)))


@query("z_scores", f"with {Z} select source, t, z from z")
def _(spark, d):
    return z256(spark, d)


@query("z_scores_empirical", f"with {TRIALS}, cal as (select source, avg(sum) as mean, stddev_samp(sum) as sd from tri group by source having count(*) >= 500) select source, t, round((sum - mean) / sd, 6) + 0.0 as z from tri join cal using (source)")
def _(spark, d):
    t = trials256(spark, d)
    return rounded(tr.z_scores(t, tr.calibrate(t)))


@query("stouffer", f"with {Z} select source, round(sum(z) / sqrt(count(*)), 6) as z, count(*) as n from z group by source")
def _(spark, d):
    return rounded(z256(spark, d).groupBy("source").agg(tr.stouffer(F.col("z")).alias("z"), F.count("*").alias("n")))


@query("netvar", f"with {Z} select round(sum(zs * zs), 6) as statistic, count(*) as df from st")
def netvar(spark, d):
    return rounded(net.netvar(z256(spark, d)))


@query("netvar_p", f"with {Z}, v as (select sum(zs * zs) as x, count(*) as df from st) select round(x, 6) as statistic, df, round({chi2_sf_sql('x', 'df')}, 6) as p from v")
def _(spark, d):
    s = net.netvar(z256(spark, d))
    return rounded(s.withColumn("p", nu.chi_square_p(F.col("statistic"), F.col("df"))))


@query("devvar", f"with {Z} select round(sum(z * z), 6) as statistic, count(*) as df from z")
def _(spark, d):
    return rounded(net.devvar(z256(spark, d)))


@query("pair_correlation", f"with {Z} select a.source as a, b.source as b, round(avg(a.z * b.z), 6) as r from z a join z b on a.t = b.t and a.source < b.source group by all")
def _(spark, d):
    return rounded(net.pairs(z256(spark, d)))


@query("correlation", f"with {Z} select round(sum((s * s - q) / 2) / sqrt(sum(n * (n - 1) / 2)), 6) as statistic, count(*) as steps from st")
def _(spark, d):
    return rounded(net.correlation(z256(spark, d)))


@query("network_coherence", f"with {Z} select t, round((s * s - q) / (n * (n - 1)), 9) + 0.0 as coherence from st")
def _(spark, d):
    return rounded(net.coherence(z256(spark, d)), 9)




@query(
    "clustered_netvar",
    f"""with {Z}, cz as (select t, hash_ as cluster, sum(z) / sqrt(count(*)) as cz from (select *, length(source) % 2 as hash_ from z) group by all),
    per as (select t, sum(cz * cz) as w, sum(cz) / sqrt(count(*)) as b from cz group by t)
    select round(sum(w), 6) as within, round(sum(b * b), 6) as "between", count(*) as steps from per""",
)
def _(spark, d):
    z = z256(spark, d)
    return rounded(net.clustered(z, z.select("source").distinct().withColumn("cluster", F.length("source") % 2)))


@query(
    "onsite_vs_global",
    f"""with {Z}, first as (select min(source) as s from z), x as (select t, z as x from z where source = (select s from first)),
    y as (select t, sum(z) / sqrt(count(*)) as y from z where source <> (select s from first) group by t),
    r as (select corr(x, y) as r, count(*) as n from x join y using (t))
    select round(r, 6) as r, round(atanh(greatest(least(r, 1 - 1e-15), -1 + 1e-15)) * sqrt(n - 3), 6) as statistic, n from r""",
)
def _(spark, d):
    z = z256(spark, d)
    first = F.broadcast(z.agg(F.min("source").alias("first")))  # one row
    marked = z.join(first)
    onsite = marked.where("source = first").select("t", F.col("z").alias("x"))
    rest = marked.where("source <> first").groupBy("t").agg((F.sum("z") / F.sqrt(F.count("*"))).alias("x"))
    return rounded(net.onsite_vs_global(onsite, rest))


@query("cumulative_deviation", f"with {Z} select t, round(sum(zs * zs - 1) over (order by t), 6) + 0.0 as cumdev from st")
def _(spark, d):
    return rounded(net.cumulative_deviation(net.steps(z256(spark, d))))


#: The quantile by Wilson and Hilferty's start and four Newton steps.
_STEP = f"x - ({gamma_p_sql('(t / 2.0::double)', '(x / 2)')} - 0.95::double) * 2 / exp((t / 2.0::double - 1) * ln(x / 2) - x / 2 - lgamma(t / 2.0::double))"


@query(
    "significance_envelope",
    f"""with {Z}, n0 as (select t + 1 as t, (t + 1) * (1 - 2 / (9.0::double * (t + 1)) + 1.6448536269514722::double * sqrt(2 / (9.0::double * (t + 1)))) ** 3 as x from st),
    n1 as (select t, {_STEP} as x from n0), n2 as (select t, {_STEP} as x from n1), n3 as (select t, {_STEP} as x from n2), n4 as (select t, {_STEP} as x from n3) select t, round(x - t, 5) + 0.0 as bound from n4""",
)
def _(spark, d):
    return rounded(net.envelope(net.steps(z256(spark, d)).select((F.col("t") + 1).alias("t"))), 5)


@query(
    "chi2_p",
    """with x as (select o_orderkey, (o_orderkey % 40 + 2) // 2 * 2 as df, (floor(o_totalprice)::bigint % 997) / 10.0::double as x from orders)
    select o_orderkey, df, x, round(exp(-x / 2) * list_sum(list_transform(range(0, df // 2), lambda i: (x / 2) ** i / exp(lgamma(i + 1)))), 9) as p from x""",
)
def _(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", (F.floor((F.col("o_orderkey") % 40 + 2) / 2) * 2).alias("df"), ((F.floor("o_totalprice") % 997) / 10.0).alias("x"))
    return x.withColumn("p", F.round(nu.chi2_sf_even(F.col("x"), F.col("df")), 9))


@query("event_windows", f"with {Z} select (s_suppkey)::bigint as id, round(sum(zs * zs), 6) as statistic, count(*) as df from st join supplier on t >= s_suppkey * 3 and t < s_suppkey * 3 + 50 group by id")
def _(spark, d):
    events = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3).alias("start_t"), (F.col("s_suppkey") * 3 + 50).alias("end_t"))
    return rounded(net.event_windows(z256(spark, d), events))


@query(
    "composite_z",
    f"""with {Z}, v as (select s_suppkey as id, sum(zs * zs) as x, count(*) as df from st join supplier on t >= s_suppkey * 3 and t < s_suppkey * 3 + 50 group by id),
    u as (select least(greatest({chi2_sf_sql('x', 'df')}, 1e-300), 1 - 1e-16::double) as p from v), {norm_ppf_sql('u', 'q')}, c as (select -sum(z) / sqrt(count(*)) as z, count(*) as events from q)
    select round(z, 6) as z, events, round({norm_cdf_sql('-z')}, 6) as p from c""",
)
def _(spark, d):
    events = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3).alias("start_t"), (F.col("s_suppkey") * 3 + 50).alias("end_t"))
    per = net.event_windows(z256(spark, d), events)
    z = per.select((-nu.norm_ppf(F.least(F.greatest(nu.chi_square_p(F.col("statistic"), F.col("df")), F.lit(1e-300)), F.lit(1 - 1e-16)))).alias("z"))
    return rounded(z.agg((F.sum("z") / F.sqrt(F.count("*"))).alias("z"), F.count("*").alias("events")).withColumn("p", nu.normal_p(F.col("z"), "upper")))


@query("bonferroni", "select count(*) as events, round(0.05::double / count(*), 9) as alpha from supplier")
def _(spark, d):
    return read(spark, d, "supplier").agg(F.count("*").alias("events"), F.round(F.lit(0.05) / F.count("*"), 9).alias("alpha"))
