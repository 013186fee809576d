"""Experiments, dimension tables, fields from bytes and cards of rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bytes import bit_string
from ..operators import dims, draws, experiment
from ..operators import rates as ra
from ..operators import spatial as sp
from ..sources.frames import linear_scale
from .protocol_queries import _EP, _epochs
from .registry import BITSTR, BYTES, DIGEST, TRIALS, Z, chunk_stream, chi2_sf_sql, digest, norm_cdf_sql, norm_ppf_sql, query, read, rounded, trials256


def _events(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("id"), (k * 3).alias("start_t"), (k * 3 + 50).alias("end_t"))


@query("experiment_statistics", f"with {Z} select s_suppkey as id, count(*) as steps, round(sum(zs * zs), 6) as netvar, round(sum(q), 6) as devvar, round(sum((s * s - q) / 2) / sqrt(sum(n * (n - 1) / 2)), 6) + 0.0 as correlation from st join supplier on t >= s_suppkey * 3 and t < s_suppkey * 3 + 50 group by 1")
def _(spark, d):
    per, _ = experiment.analyse(trials256(spark, d), _events(spark, d), 256)
    return rounded(per.select("id", "steps", "netvar", "devvar", "correlation"))


_PER = "per as (select s_suppkey as id, count(*) as steps, sum(zs * zs) as netvar, sum(q) as devvar, sum(n) as cells, sum((s * s - q) / 2) / sqrt(sum(n * (n - 1) / 2)) as correlation from st join supplier on t >= s_suppkey * 3 and t < s_suppkey * 3 + 50 group by id)"
_P_NETVAR = chi2_sf_sql("netvar", "steps")
_RESULT = f"select id, steps, round(netvar, 6) as netvar, round(devvar, 6) as devvar, round(correlation, 6) + 0.0 as correlation, round({_P_NETVAR}, 6) + 0.0 as p_netvar, round({chi2_sf_sql('devvar', 'cells')}, 6) + 0.0 as p_devvar, round({norm_cdf_sql('(-correlation)')}, 6) + 0.0 as p_correlation from per"


@query("experiment_events", f"with {Z}, {_PER} {_RESULT}")
def _(spark, d):
    return rounded(experiment.analyse(trials256(spark, d), _events(spark, d), 256)[0])


@query("experiment_composite", f"with {Z}, {_PER}, u as (select least(greatest({_P_NETVAR}, 1e-300), 1 - 1e-16::double) as p from per), {norm_ppf_sql('u', 'q')}, c as (select -sum(z) / sqrt(count(*)) as z, count(*) as events from q) select round(z, 6) as z, events, round({norm_cdf_sql('(-z)')}, 6) as p from c")
def _(spark, d):
    return rounded(experiment.analyse(trials256(spark, d), _events(spark, d), 256)[1])


@query(
    "experiment_burn",
    f"""with {TRIALS}, cal as (select source, avg(sum) as mean, stddev_samp(sum) as sd from tri where t < 600 group by source having count(*) >= 500), rest as (select source, t - 600 as t, sum from tri where t >= 600),
    ali as (select * from rest where t <= (select min(m) from (select max(t) as m from rest group by source))), z as (select source, t, (sum - mean) / sd as z from ali join cal using (source) where sd > 0),
    st as (select t, count(*) as n, sum(z) as s, sum(z * z) as q, sum(z) / sqrt(count(*)) as zs from z group by t), {_PER} {_RESULT}""",
)
def _(spark, d):
    return rounded(experiment.analyse(trials256(spark, d), _events(spark, d), 256, "burn", 600)[0])


@query("broadcast_rounds", f"with {BYTES}, w as (select source, pos // 16 as round, pos % 16 // 2 as k, sum(case when pos % 2 = 0 then b * 256 else b end)::bigint as v from byt group by all), f as (select source, round, arg_min(v, k) filter (v < 60885) as v from w group by all) select source, round, coalesce(v % 6765 = 6764, false) as resonance from f")
def _(spark, d):
    return experiment.broadcast_rounds(chunk_stream(spark, d))


@query("sample_field", f"with {BYTES}, p as (select source, pos // 8 as id, sum(case when pos % 8 < 4 then b * 256.0::double ** (3 - pos % 4) else 0 end) as x, sum(case when pos % 8 >= 4 then b * 256.0::double ** (3 - pos % 4) else 0 end) as y from byt group by all having count(*) = 8) select source, id, round(x / 4294967296.0::double * 100, 6) as x, round(y / 4294967296.0::double * 80, 6) as y from p")
def _(spark, d):
    return rounded(experiment.sample_field(chunk_stream(spark, d), 100.0, 80.0))


@query("sample_disk", f"with {BYTES}, p as (select source, pos // 8 as id, sum(case when pos % 8 < 4 then b * 256.0::double ** (3 - pos % 4) else 0 end) / 4294967296.0::double as u, sum(case when pos % 8 >= 4 then b * 256.0::double ** (3 - pos % 4) else 0 end) / 4294967296.0::double as v from byt group by all having count(*) = 8) select source, id, round(100 * sqrt(u) * cos(2 * pi() * v), 6) + 0.0 as x, round(100 * sqrt(u) * sin(2 * pi() * v), 6) + 0.0 as y from p")
def _(spark, d):
    return rounded(experiment.sample_disk(chunk_stream(spark, d), 100.0))


@query(
    "csr_envelope",
    f"""with {BYTES}, p as (select source, pos // 8 as id, sum(case when pos % 8 < 4 then b * 256.0::double ** (3 - pos % 4) else 0 end) / 4294967296.0::double as x, sum(case when pos % 8 >= 4 then b * 256.0::double ** (3 - pos % 4) else 0 end) / 4294967296.0::double as y from byt group by all having count(*) = 8),
    c as (select *, floor(x / 0.01) as cx, floor(y / 0.01) as cy from p), far as (select source, id, x, y, cx + i as cx, cy + j as cy from c, range(-1, 2) a(i), range(-1, 2) b(j)), n as (select source, count(*) as n from p group by source),
    r as (select unnest([0.005, 0.01]::double[]) as radius), k as (select source, radius, count(*) filter ((c.x - far.x) * (c.x - far.x) + (c.y - far.y) * (c.y - far.y) <= radius * radius) as k from c join far using (source, cx, cy), r where c.id <> far.id group by all),
    l as (select radius, sqrt(coalesce(k, 0) / (n * n)::double / pi()) - radius as l from n cross join r left join k using (source, radius)) select radius, round(min(l), 9) + 0.0 as low, round(max(l), 9) + 0.0 as high from l group by radius""",
)
def _(spark, d):
    """Range of L over simulated fields, one per event type, of the points that its digests give."""
    p = experiment.sample_field(chunk_stream(spark, d), 1.0, 1.0)
    every = sp.ripley_l_by(p, "source", 1.0, [0.005, 0.01])
    return rounded(every.groupBy("radius").agg(F.min("l").alias("low"), F.max("l").alias("high")), 9)


def _chain(count: str) -> str:
    """States of the seeded generator, one after another."""
    step = "xor(a, (a & 524287) << 13) as b from (select i + 1 as i, s as a, last from chain where i < last)"
    return f"chain as (select 0::bigint as i, {0x9E3779B9}::bigint as s, {count} as last union all select i, xor(c, (c & 134217727) << 5) as s, last from (select i, xor(b, b >> 17) as c, last from (select i, last, {step})))"


_SPOTS = "pt as (select s_suppkey as id, (s_acctbal::double + 1000) / 11000 as x, (s_suppkey * 7919 % 1009)::double / 1009 as y from supplier)"


@query(
    "csr_test",
    f"""with recursive {_SPOTS}, {_chain('(select 2 * 99 * count(*) from supplier)')}, n as (select count(*) as n from pt), f as (select (i - 1) // 2 as p, max(case when i % 2 = 1 then s end) / 4294967296.0::double as x, max(case when i % 2 = 0 then s end) / 4294967296.0::double as y from chain where i > 0 group by 1),
    g as (select p // n as run, p % n as id, x, y from f, n union all select -1 as run, id, x, y from pt), r as (select unnest([0.05, 0.1, 0.2]::double[]) as radius),
    k as (select a.run, radius, count(*) filter ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= radius * radius and a.id <> b.id) as k from g a join g b on a.run = b.run, r group by all),
    l as (select run, radius, sqrt(k / (n * n)::double / pi()) - radius as l from k, n)
    select radius, round(max(l) filter (run < 0), 9) + 0.0 as l, round(min(l) filter (run >= 0), 9) + 0.0 as low, round(max(l) filter (run >= 0), 9) + 0.0 as high, not (max(l) filter (run < 0) between min(l) filter (run >= 0) and max(l) filter (run >= 0)) as outside from l group by radius""",
)
def _(spark, d):
    """Suppliers' points against 99 fields of as many points at random, all from one seeded chain."""
    k = F.col("s_suppkey")
    p = read(spark, d, "supplier").select(k.alias("id"), ((F.col("s_acctbal").cast("double") + 1000) / 11000).alias("x"), ((k * 7919 % 1009).cast("double") / 1009).alias("y"))
    return rounded(sp.csr_test(p, p.count(), 1.0, 1.0, [0.05, 0.1, 0.2]), 9)


@query(
    "presentiment_permutation",
    f"""with {_EP}, b as (select phase, id, sum(zs) as s, count(*) as n from ep group by all), size as (select max(id) + 1 as size from ep),
    l as (select o, ((i - o) % size + size) % size as id, i * i % 3 = 1 as target from (select unnest(range(0, size)) as i, size from size), range(0, 20) r(o) where o = 0 or o < size and (size % 3 <> 0 or o % 3 <> 0)),
    d as (select phase, o, (sum(s) filter (target) / sqrt(sum(n) filter (target)) - sum(s) filter (not target) / sqrt(sum(n) filter (not target))) / sqrt(2) as dz from b join l using (id) group by all)
    select phase, round(a.dz, 6) + 0.0 as own, round((1 + count(*) filter (c.dz >= a.dz)) / (1 + count(*))::double, 6) as p from d a join d c using (phase) where a.o = 0 and c.o > 0 group by phase, a.dz""",
)
def _(spark, d):
    ep = _epochs(spark, d).select("id", "phase", "zs")
    n = ep.agg(F.max("id") + 1).first()[0] or 1
    labels = spark.range(n).select(F.col("id").alias("i"), (F.col("id") * F.col("id") % 3 == 1).alias("target"))
    offsets = [o for o in range(1, 20) if o < n and (n % 3 or o % 3)]  # rotations that give the same labels are left out
    return rounded(experiment.label_rotation_p(ep, labels, n, offsets))


@query("geomancy_figures", "select s_suppkey, (s_suppkey % 16)::int as value, length(replace(bin(s_suppkey % 16), '0', '')) as ones from supplier")
def _(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 16).cast("int").alias("value"))
    f = F.broadcast(dims.figures(spark))  # 16 rows
    return s.join(f, "value").select("s_suppkey", "value", (8 - F.col("points")).cast("bigint").alias("ones"))


_FIGURE_ROWS = ", ".join(f"({int(f.rows, 2)}, '{f.name}', {8 - f.rows.count('1')})" for f in dims.FIGURES)
_JUDGE = f"with {DIGEST}, s as (select source, t, {BITSTR} as s from dig), m as (select source, t, list_transform(range(0, 16), lambda i: substr(s, (i + 1)::int, 1)::int) as b from s), j as (select source, t, list_reduce(list_transform(range(0, 4), lambda r: (8 >> r::int) * xor(xor(xor(b[(r + 1)::int], b[(r + 5)::int]), xor(b[(r + 9)::int], b[(r + 13)::int])), xor(xor(b[(4 * r + 1)::int], b[(4 * r + 2)::int]), xor(b[(4 * r + 3)::int], b[(4 * r + 4)::int])))), lambda x, y: x + y)::int as judge from m)"


@query("geomancy_cast", f"{_JUDGE} select source, t, name, points from j join (values {_FIGURE_ROWS}) f(value, name, points) on judge = value")
def _(spark, d):
    j = digest(spark, d).select("source", "t", draws.shield(bit_string(F.col("h"), 64))["judge"].alias("value"))
    return j.join(F.broadcast(dims.figures(spark)), "value").select("source", "t", "name", "points")  # 16 rows


_WEN = "[" + ", ".join(str(draws.KING_WEN[draws.TRIGRAMS.index(f"{v:06b}"[:3])][draws.TRIGRAMS.index(f"{v:06b}"[3:])]) for v in range(64)) + "]"
_NAMED = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in dims.TRIGRAM_NAMES.items()) + "}"
#: Yang lines, bottom up, as a string: of a coin's values 0 (6, moving yin), 1-3 (7), 4-6 (8), 7 (9, moving yang).
_LINES = f"with {DIGEST}, s as (select source, t, {BITSTR} as s from dig), v as (select source, t, list_transform(range(0, 6), lambda i: ('0b' || substr(s, (i * 3 + 1)::int, 3))::int) as v from s), y as (select source, t, v, array_to_string(list_transform(v, lambda x: (x between 1 and 3 or x = 7)::int), '') as y, array_to_string(list_transform(v, lambda x: (x between 1 and 3 or x = 0)::int), '') as z from v)"


@query("iching_cast", f"{_LINES} select source, t, ({_WEN})[('0b' || y)::int + 1] as primary, case when len(list_filter(v, lambda x: x in (0, 7))) > 0 then ({_WEN})[('0b' || z)::int + 1] else 0 end as relating, len(list_filter(v, lambda x: x in (0, 7)))::int as changing from y")
def _(spark, d):
    h = digest(spark, d).select("source", "t", draws.hexagram(bit_string(F.col("h"), 64)).alias("c"))
    return h.select("source", "t", "c.primary", F.coalesce("c.relating", F.lit(0)).alias("relating"), F.size("c.changing").alias("changing"))


@query("hexagram_names", f"{_LINES} select source, t, ({_WEN})[('0b' || y)::int + 1] as number, {_NAMED}[substr(y, 1, 3)] as lower, {_NAMED}[substr(y, 4, 3)] as upper from y")
def _(spark, d):
    c = digest(spark, d).select("source", "t", draws.hexagram(bit_string(F.col("h"), 64))["primary"].alias("number"))
    return c.join(F.broadcast(dims.hexagrams(spark)), "number").select("source", "t", "number", "lower", "upper")  # 64 rows


@query("yarrow_lines", f"with {DIGEST}, l as (select source, t, i, (('0x' || substr(h, (i + 1)::int, 1))::int) as v from dig, range(0, 6) r(i)) select source, t, string_agg((case when v < 1 then 6 when v < 6 then 7 when v < 13 then 8 else 9 end)::varchar, '' order by i) as lines from l group by all")
def _(spark, d):
    lines = draws.hexagram(bit_string(F.col("h"), 64), "yarrow")["lines"]
    return digest(spark, d).select("source", "t", F.array_join(F.transform(lines, lambda x: x.cast("string")), "").alias("lines"))


_RUNE_ROWS = "select i::int as index, r.name, ['Freyr', 'Heimdall', 'Tyr'][(i // 8 + 1)::int] as aett, r.invertible from (select unnest(range(24)) as i, unnest([" + ", ".join(f"{{'name': '{r.name}', 'invertible': {str(r.invertible).lower()}}}" for r in dims.RUNES) + "]) as r)"


def _by_part(spark, d, rows, size: int):
    """A dimension's row for each part, by its key."""
    part = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % size).cast("int").alias("index"))
    return part.join(F.broadcast(rows), "index")  # a dimension's rows


@query("runes", f"select p_partkey, r.* from part join ({_RUNE_ROWS}) r on p_partkey % 24 = index")
def _(spark, d):
    return _by_part(spark, d, dims.runes(spark), 24)


@query("tarot_deck", "select p_partkey, c.* from part join (select i::int as index, case when i < 22 then 'major' else 'minor' end as arcana, case when i >= 22 then ['Wands', 'Cups', 'Swords', 'Pentacles'][((i - 22) // 14 + 1)::int] end as suit, (case when i < 22 then i else (i - 22) % 14 + 1 end)::int as number from range(0, 78) r(i)) c on p_partkey % 78 = index")
def _(spark, d):
    return _by_part(spark, d, dims.cards(spark), 78)


_PROVIDER_ROWS = ", ".join(f"({i}, '{k}', '{kind}', '{privacy}', '{access}')" for i, (k, (kind, privacy, access)) in enumerate(dims.PROVIDERS.items()))


@query("source_descriptions", f"select p_partkey, name, kind, privacy, access from part join (values {_PROVIDER_ROWS}) p(i, name, kind, privacy, access) on p_partkey % {len(dims.PROVIDERS)} = i")
def _(spark, d):
    """The provider that each part's key stands for."""
    place = {k: i for i, k in enumerate(dims.PROVIDERS)}
    rows = dims.providers(spark).withColumn("index", F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("name")])
    return _by_part(spark, d, rows, len(place)).drop("index")


_STOP = f"(({[list(c) for c in dims.VIRIDIS]})[k + {{1}}][{{0}}])"
_CHANNEL = lambda c: f"floor({_STOP.format(c, 1)} + (x - k) * ({_STOP.format(c, 2)} - {_STOP.format(c, 1)}) + 0.5)::int"


@query("viridis_lut", f"with p as (select i::int as i, i / 255.0::double * 9 as x, least(floor(i / 255.0::double * 9), 8)::int as k from range(0, 256) r(i)) select event_id, i, {_CHANNEL(1)} as r, {_CHANNEL(2)} as g, {_CHANNEL(3)} as b from p join events on i = event_id % 256")
def _(spark, d):
    """The colour of each event, by the last byte of its id."""
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 256).cast("int").alias("i"))
    return e.join(F.broadcast(dims.viridis(spark, 256)), "i")  # 256 rows


@query("card_geometry", "with r as (select p_partkey, [p_partkey % 44, p_partkey // 44 % 44, p_partkey * 7 % 44] as r from part) select p_partkey, i::int as ring, round(0.2::double + i * 0.8::double / 2, 6) as radius, round(r[(i + 1)::int] * 2 * pi() / 44, 6) as angle from r, range(0, 3) g(i)")
def _(spark, d):
    k = F.col("p_partkey")
    r = read(spark, d, "part").select("p_partkey", F.posexplode(F.array(k % 44, F.floor(k / 44) % 44, k * 7 % 44)).alias("ring", "v"))
    return rounded(r.select("p_partkey", "ring", linear_scale(F.col("ring"), F.lit(0), F.lit(2), 0.2, 1.0).alias("radius"), ra.angle(F.col("v")).alias("angle")))
