"""Health tests, extraction, experiments, resampling and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics as nu
from ..functions.bytes import hmac_sha256
from ..functions.chunks import low_bits
from ..operators import extract as ex
from ..operators import health
from ..operators import network as net
from ..operators import protocols as pr
from .registry import BYTES, DIGEST, TRIALS, Z, chi2_sf_sql, chunk_stream, digest, norm_ppf_sql, query, read, rounded, trials256, z256

_NIB = f"{BYTES}, nib as (select source, pos, b & 1 as b from byt)"


def _low_bits(spark, d):
    return chunk_stream(spark, d).withColumn("bytes", low_bits("bytes"))


@query("rct_alarms", f"with {_NIB}, g as (select *, pos - row_number() over (partition by source, b order by pos) as g from nib), r as (select source, pos, b, row_number() over (partition by source, b, g order by pos) as r from g) select source, pos, b from r where r >= 9 and (r - 9) % 8 = 0")
def _(spark, d):
    return health.rct_alarms(_low_bits(spark, d), 9)


@query("apt_windows", f"with {_NIB}, w as (select source, pos // 64 as w, first_value(b) over (partition by source, pos // 64 order by pos) as first, b from nib) select source, w, first, count(*) filter (b = first) as count, count(*) filter (b = first) >= 42 as alarm from w group by source, w, first having count(*) = 64")
def _(spark, d):
    return health.apt_windows(_low_bits(spark, d), 64, 42)


#: The adaptive proportion test, sample after sample: place in the window, its first sample, how often that has come; 1 marks an alarm.
_HIT = "x.b = a.r and a.i > 0 and a.c + 1 >= 42"
_APT = f"bl as (select source, list(b order by pos) as l from nib group by source), sq as (select source, l, list_reduce(list_transform(l, lambda b: {{'b': b, 'i': 0, 'r': 0, 'c': 0, 's': ''}}), lambda a, x: {{'b': x.b, 'i': case when {_HIT} then 0 else (a.i + 1) % 64 end, 'r': case when a.i = 0 then x.b else a.r end, 'c': case when a.i = 0 then 1 else a.c + (x.b = a.r)::int end, 's': a.s || case when {_HIT} then '1' else '0' end}}, {{'b': 0, 'i': 0, 'r': 0, 'c': 0, 's': ''}}).s as s from bl), apt as (select source, pos, b from (select source, unnest(range(0, len(l))) as pos, unnest(l) as b, unnest(string_split(s, '')) as hit from sq) where hit = '1')"


@query("apt_alarms", f"with {_NIB}, {_APT} select source, pos from apt")
def _(spark, d):
    return health.apt_alarms(_low_bits(spark, d), 64, 42)


@query(
    "health_cutoffs",
    """with h as (select distinct (s_suppkey % 32 + 1) / 4.0::double as h from supplier),
    b as (select h, k, sum(exp(lgamma(513.0) - lgamma(k + 1.0) - lgamma(513.0 - k) - k * h * ln(2) + (512 - k) * ln(1 - 2.0::double ** -h))) over (partition by h order by k) as cdf from h, range(0, 513) r(k)),
    c as (select h, (1 + ceil(20 / h))::int as rct, (1 + min(k))::int as apt from b where cdf >= 1 - 2.0::double ** -20 group by h)
    select s_suppkey, h, rct, apt from supplier join c on (s_suppkey % 32 + 1) / 4.0::double = h""",
)
def _(spark, d):
    """Cutoffs at each supplier's claim of min-entropy."""
    claim = ((F.col("s_suppkey") % 32 + 1) / 4.0).alias("h")
    return health.with_cutoffs(read(spark, d, "supplier").select("s_suppkey", claim), 512)


@query("von_neumann", f"with {BYTES}, bits as (select source, pos * 8 + i as p, (b >> (7 - i)::int) & 1 as bit from byt, range(0, 8) r(i)), pr as (select source, p // 2 as p, max(case when p % 2 = 0 then bit end) as a, max(case when p % 2 = 1 then bit end) as b from bits group by all), kept as (select source, p, a, row_number() over (partition by source order by p) - 1 as i from pr where a <> b) select source, p // 128 * 32 as off, min(i) as i, string_agg(a::varchar, '' order by p) as bits from kept group by 1, 2")
def _(spark, d):
    return ex.von_neumann(chunk_stream(spark, d))


_BIT_PAIRS = f"{BYTES}, bits as (select source, pos * 8 + i as p, (b >> (7 - i)::int) & 1 as bit from byt, range(0, 8) r(i)), pr as (select source, p // 2 as p, max(case when p % 2 = 0 then bit end) as a, max(case when p % 2 = 1 then bit end) as b from bits group by all)"
_PERES = f"""{_BIT_PAIRS}, u as (select source, p, xor(a, b) as bit from pr), v as (select source, row_number() over (partition by source order by p) - 1 as p, a as bit from pr where a = b),
up as (select source, p // 2 as p, max(case when p % 2 = 0 then bit end) as a, max(case when p % 2 = 1 then bit end) as b from u group by all having count(*) = 2), vp as (select source, p // 2 as p, max(case when p % 2 = 0 then bit end) as a, max(case when p % 2 = 1 then bit end) as b from v group by all having count(*) = 2),
every as (select source, 0 as part, p, a from pr where a <> b union all select source, 1, p, a from up where a <> b union all select source, 2, p, a from vp where a <> b)"""


@query("peres_two_levels", f"with {_PERES}, n as (select source, a, row_number() over (partition by source order by part, p) - 1 as i from every) select source, i // 1024 * 1024 as i, string_agg(a::varchar, '' order by i) as bits from n group by 1, 2")
def _(spark, d):
    return ex.bit_blocks(ex.peres(chunk_stream(spark, d), depth=2, node=1 << 14, piece=1 << 12), 1024)


@query("peres")
def _(spark, d):
    """Of the whole stream of each source, to the last level."""
    return ex.bit_blocks(ex.peres(chunk_stream(spark, d)), 1024)


@query("condition_blocks", f"with {BYTES} select source, pos // 48 as block, sha256(unhex(string_agg(printf('%02X', b), '' order by pos))) as digest from byt group by all having count(*) = 48")
def _(spark, d):
    return ex.condition(chunk_stream(spark, d), 48)


_SEED = "243f6a8885a308d313198a2e03707344a4093822299f31d0082efa98ec4e6c89452821e6"


@query(
    "toeplitz",
    f"""with {DIGEST}, x as (select source, t, j, (('0x' || substr(h, (j // 4 + 1)::int, 1))::int >> (3 - j % 4)::int) & 1 as x from dig, range(0, 256) r(j)),
    s as (select p, (('0x' || substr('{_SEED}', (p // 4 + 1)::int, 1))::int >> (3 - p % 4)::int) & 1 as s from range(0, 271) r(p)),
    y as (select source, t, i, bit_xor(s & x)::int as bit from x, range(0, 16) o(i), s where x = 1 and p = i - j + 255 group by all)
    select source, t, string_agg(bit::varchar, '' order by i) as bits from y group by all""",
)
def _(spark, d):
    seed = "".join(f"{int(c, 16):04b}" for c in _SEED)[:271]
    return digest(spark, d).select("source", "t", ex.toeplitz(seed, 256, 16)(F.unhex("h")).alias("bits"))


_PAD = "unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02x', xor(case when i <= length(source) then ascii(substr(source, i::int, 1)) else 0 end, {}))), ''){})"


@query("hmac_condition", f"with {DIGEST}, i as (select source, t, sha256({_PAD.format(54, ' || h')}) as h from dig) select source, t, sha256({_PAD.format(92, ' || h')}) as mac from i")
def _(spark, d):
    return digest(spark, d).select("source", "t", F.lower(F.hex(hmac_sha256(F.encode("source", "UTF-8"), F.unhex("h")))).alias("mac"))


@query("accounting", "select o_orderkey, round(least(h, 0.999::double * 256), 6) as conditioned, floor(h - 2 * log2(1 / 1e-6::double))::bigint as extractable from (select o_orderkey, (o_orderkey % 8 + 1) * 32.0::double as h from orders)")
def _(spark, d):
    h = ex.claim((F.col("o_orderkey") % 8 + 1).cast("double"), F.lit(32))
    return rounded(read(spark, d, "orders").select("o_orderkey", ex.vetted_output_entropy(h, 256).alias("conditioned"), ex.toeplitz_output_bits(h, 1e-6).alias("extractable")))


@query("bayes_factor", "with c as (select l_suppkey, count(*) as n, sum((l_quantity > 25)::int)::bigint as k from lineitem group by 1) select l_suppkey, k, n, round(lgamma(k + 1.0) + lgamma(n - k + 1.0) - lgamma(n + 2.0) + n * ln(2), 6) + 0.0 as ln_bf from c")
def _(spark, d):
    c = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 25).alias("k"), F.count("*").alias("n"))
    return rounded(c.withColumn("ln_bf", pr.log_bayes_factor(F.col("k"), F.col("n"))))


@query("rolling_stouffer", f"with {Z}, r as (select t, sum(zs) over w / sqrt(32) as s, sum(zs * zs) over w as c from st window w as (order by t rows 31 preceding)) select t, round(s, 6) + 0.0 as stouffer, round(c, 6) as chi from r where t >= 31 and (t - 31) % 4 = 0")
def _(spark, d):
    return rounded(pr.rolling(net.steps(z256(spark, d)).select("t", "zs"), 32, 4))


@query(
    "rolling_netvar",
    f"""with {Z}, w as (select t, sum(zs * zs) over (order by t rows 31 preceding) as x from st), u as (select t, {chi2_sf_sql('x', '32')} as p from w where t >= 31 and (t - 31) % 4 = 0), {norm_ppf_sql('u', 'q')} select t, round(-z, 6) + 0.0 as z from q""",
)
def _(spark, d):
    r = pr.rolling(net.steps(z256(spark, d)).select("t", "zs"), 32, 4)
    return rounded(r.select("t", (-nu.norm_ppf(nu.chi2_sf(F.col("chi"), F.lit(32.0)))).alias("z")))


_EV = "ev as (select s_suppkey as id, case when s_suppkey % 2 = 0 then 'target' else 'control' end as stimulus, s_suppkey * 17 as tm from supplier)"
_EP = f"{Z}, {_EV}, ep as (select id, stimulus, case when t < tm then 'pre' else 'post' end as phase, t - tm as k, zs from st join ev on t >= tm - 4 and t < tm + 4 where tm >= 4 and tm + 4 <= (select count(*) from st))"


def _epochs(spark, d):
    s = net.steps(z256(spark, d)).select("t", "zs")
    last = F.broadcast(s.agg(F.count("*").alias("last")))  # one row
    e = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "target").otherwise("control").alias("stimulus"), (F.col("s_suppkey") * 17).alias("at"))
    return pr.epochs(s, e.crossJoin(last), 4, 4)


@query("presentiment_epochs", f"with {_EP} select id, stimulus, phase, k, round(zs, 6) + 0.0 as zs from ep")
def _(spark, d):
    return rounded(_epochs(spark, d))


@query("presentiment", f"with {_EP}, p as (select phase, sum(zs) filter (stimulus = 'target') / sqrt(count(*) filter (stimulus = 'target')) as a, sum(zs) filter (stimulus = 'control') / sqrt(count(*) filter (stimulus = 'control')) as b from ep group by phase) select phase, round(a, 6) as z_target, round(b, 6) as z_control, round((a - b) / sqrt(2), 6) as dz from p")
def _(spark, d):
    return rounded(pr.presentiment(_epochs(spark, d)))


@query("tripolar", f"with {TRIALS}, i as (select (['high', 'low', 'baseline'])[((t // 10) % 3 + 1)::int] as intention, count(*) as trials, sum(sum - 128)::double as s from tri group by 1) select intention, trials, round(s / sqrt(trials * 64), 6) as z, round(s / sqrt(trials * 64) / sqrt(trials * 256), 6) + 0.0 as effect from i")
def _(spark, d):
    return rounded(pr.tripolar(trials256(spark, d), 10, 256))


_OFFSETS = list(range(50, 1000, 50))


_OFFSET_SQL = f"""with {Z}, f as (select min(source) as m, max(t) + 1 as n from z), sl as (select t, sum(z) as s, count(*) as c from z where source <> (select m from f) group by t),
tu as (select o as "offset", (t + o) % (select n from f) as t, z from z, range(50, 1000, 50) r(o) where source = (select m from f)),
su as (select "offset", sum((s + z) * (s + z) / (c + 1)) as statistic from tu join sl using (t) group by 1)"""


@query("time_offset_surrogates", f'{_OFFSET_SQL} select "offset"::int as "offset", round(statistic, 6) as statistic from su')
def surrogates(spark, d):
    z = z256(spark, d)
    first, n = z.agg(F.min("source"), F.max("t") + 1).first()
    return rounded(pr.offset_surrogates(z, first, _OFFSETS, n))


@query("permutation_p", f"{_OFFSET_SQL}, o as (select sum(zs * zs) as own from st) select round(own, 6) as own, round((1 + count(*) filter (round(statistic, 6) >= own)) / (1 + count(*)), 6) as p from su, o group by own")
def _(spark, d):
    own = F.broadcast(net.netvar(z256(spark, d)).select(F.col("statistic").alias("own")))  # one row
    s = surrogates(spark, d).crossJoin(own)
    return rounded(s.groupBy("own").agg(pr.permutation_p(F.col("own"), F.col("statistic")).alias("p")))


@query("jsonl_roundtrip", f"with {TRIALS} select 1 as v, t, source, sum, 256 as \"bitsPerTrial\", true as ok from tri")
def _(spark, d):
    return pr.parse_records(pr.record_lines(trials256(spark, d), 256))


@query("jsonl_lines", f"""with {TRIALS} select '{{"v":1,"t":' || t || ',"source":"' || source || '","sum":' || sum || ',"bitsPerTrial":256}}' as value from tri""")
def _(spark, d):
    return pr.record_lines(trials256(spark, d), 256)
