"""Draws, rates, point patterns, letters, delays, composite sources, sinks and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.bytes import bit_string
from ..functions.chunks import BUCKET, rechunk, xor_mask
from ..operators import casts
from ..operators import draws as dr
from ..operators import letters as le
from ..operators import rates as ra
from ..operators import spatial as sp
from ..operators import vdf
from ..sources import frames as fr
from ..sources import strategies as st
from ..streaming import live
from .registry import BITSTR, BYTES, DIGEST, chunk_stream, digest, gamma_p_sql, query, read, rounded

def _bits():
    return bit_string(F.col("h"), 64)


@query("uniform_int", f"with {BYTES}, f as (select source, pos, b, row_number() over (partition by source order by pos) - 1 as i from byt where b < 240) select source, i, b % 24 as v from f")
def _(spark, d):
    return dr.uniform_ints(chunk_stream(spark, d), 24)


@query("uniform_int_wide", f"with {BYTES}, w as (select source, pos // 2 as p, sum(case when pos % 2 = 0 then b * 256 else b end)::int as v from byt group by all), f as (select source, v, row_number() over (partition by source order by p) - 1 as i from w where v < 65065) select source, i, v % 1001 as v from f")
def _(spark, d):
    return dr.uniform_ints(chunk_stream(spark, d), 1001)


_LINE = "case when v = 0 then 6 when v < 4 then 7 when v < 7 then 8 else 9 end"


@query("iching_lines", f"with {DIGEST}, s as (select source, t, {BITSTR} as s from dig), l as (select source, t, i, ('0b' || substr(s, (i * 3 + 1)::int, 3))::int as v from s, range(0, 6) r(i)) select source, t, string_agg(({_LINE})::varchar, '' order by i) as lines from l group by all")
def _(spark, d):
    return digest(spark, d).select("source", "t", F.array_join(F.transform(dr.hexagram(_bits())["lines"], lambda x: x.cast("string")), "").alias("lines"))


@query("geomancy_judge", f"with {DIGEST}, s as (select source, t, {BITSTR} as s from dig), m as (select source, t, list_transform(range(0, 16), lambda i: substr(s, (i + 1)::int, 1)::int) as b from s) select source, t, list_reduce(list_transform(range(0, 4), lambda r: (8 >> r::int) * xor(xor(xor(b[(r + 1)::int], b[(r + 5)::int]), xor(b[(r + 9)::int], b[(r + 13)::int])), xor(xor(b[(4 * r + 1)::int], b[(4 * r + 2)::int]), xor(b[(4 * r + 3)::int], b[(4 * r + 4)::int])))), lambda x, y: x + y)::int as judge from m")
def _(spark, d):
    return digest(spark, d).select("source", "t", dr.shield(_bits())["judge"].alias("judge"))


def _shuffle_sql(items: int, name: str) -> str:
    """Three of the items by a partial Fisher-Yates shuffle: a byte a step, taken again if it is past the last multiple."""
    return f"""with recursive {DIGEST}, dr as (select source, t, h, 0 as i, 0 as used, range(0, {items}) as deck from dig
    union all select source, t, h, i + ok::int, used + 1, case when ok then list_transform(range(0, {items}), lambda k: deck[case when k = i then j + 1 when k = j then i + 1 else k + 1 end]) else deck end
    from (select *, v < 256 // n * n as ok, i + v % n as j from (select *, {items} - i as n, ('0x' || substr(h, 2 * used + 1, 2))::int as v from dr where i < 3)))
    select source, t, deck[1] || ',' || deck[2] || ',' || deck[3] as {name}, used from dr where i = 3"""


@query("tarot_spread", _shuffle_sql(78, "cards"))
def _(spark, d):
    x = digest(spark, d).select("source", "t", dr.draw_without_replacement(78, 3)(F.unhex("h")).alias("r"))
    return x.select("source", "t", F.array_join(F.transform("r.drawn", lambda v: v.cast("string")), ",").alias("cards"), "r.used")


@query("rune_cast", _shuffle_sql(24, "runes"))
def _(spark, d):
    x = digest(spark, d).select("source", "t", dr.draw_without_replacement(24, 3)(F.unhex("h")).alias("r"))
    return x.select("source", "t", F.array_join(F.transform("r.drawn", lambda v: v.cast("string")), ",").alias("runes"), "r.used")


def _reader_sql(items: int, name: str) -> str:
    """Three of the items by one reader over each source's whole stream: a draw keeps its turn until a byte is under the last multiple."""
    top = str([256 // (items - i) * (items - i) for i in range(3)])
    return f"""with {BYTES}, bl as (select source, list(b order by pos) as l from byt group by source),
    rd as (select source, l, list_reduce(list_transform(l, lambda b: {{'b': b, 'p': 0, 's': ''}}), lambda a, x: {{'b': x.b, 'p': case when x.b < ({top})[a.p + 1] then (a.p + 1) % 3 else a.p end, 's': a.s || case when x.b < ({top})[a.p + 1] then a.p::varchar else 'r' end}}, {{'b': 0, 'p': 0, 's': ''}}).s as s from bl),
    pl as (select source, unnest(range(0, len(l))) as pos, unnest(l) as b, unnest(string_split(s, '')) as p from rd), nr as (select source, b, p::int as p, (row_number() over (partition by source order by pos) - 1) // 3 as i from pl where p <> 'r'),
    v as (select source, i, max(case when p = 0 then b % {items} end) as a, 1 + max(case when p = 1 then b % {items - 1} end) as b, 2 + max(case when p = 2 then b % {items - 2} end) as c from nr group by all having count(*) = 3)
    select source, i, a || ',' || (case when b = a then 0 else b end) || ',' || (case when c = b then case when a = 1 then 0 else 1 end when c = a then 0 else c end) as {name} from v"""


@query("tarot_stream", _reader_sql(78, "cards"))
def _(spark, d):
    x = casts.without_replacement(chunk_stream(spark, d), 78, 3, block=1 << 14)
    return x.select("source", "i", F.array_join(F.transform("drawn", lambda v: v.cast("string")), ",").alias("cards"))


@query("rune_stream", _reader_sql(24, "runes"))
def _(spark, d):
    x = casts.without_replacement(chunk_stream(spark, d), 24, 3)
    return x.select("source", "i", F.array_join(F.transform("drawn", lambda v: v.cast("string")), ",").alias("runes"))


def _long_bytes(spark, d):
    blocks = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sha2(F.concat_ws(":", F.col("s_suppkey").cast("string"), i.cast("string")), 256))
    return read(spark, d, "supplier").select("s_suppkey", F.unhex(F.array_join(blocks, "")).alias("x"))


@query("scan_race")
def _(spark, d):
    r = _long_bytes(spark, d).select("s_suppkey", dr.energy_race(64)("x").alias("r"))
    return r.select("s_suppkey", F.array_join(F.transform("r.drawn", lambda v: v.cast("string")), ",").alias("energies"), "r.used")


@query("vitality")
def _(spark, d):
    return _long_bytes(spark, d).select("s_suppkey", dr.vitality("x").alias("r")).select("s_suppkey", F.element_at("r.drawn", 1).alias("vitality"), "r.used")


#: Each source scans the catalogue with all the full rounds that its bytes hold; FNV-1a of the name breaks ties.
_SCAN = f"""with {BYTES}, r as (select source, (max(pos) + 1) // 25 as rounds from byt group by source),
c as (select source, rounds, pos % 25 as ord, sum(b & 1)::bigint as k from byt join r using (source) where pos < rounds * 25 group by all),
s as (select source, ord, n_name as name, rounds, k, (k - rounds / 2) / sqrt(rounds / 4) as z, lgamma(k + 1.0) + lgamma(rounds - k + 1.0) - lgamma(rounds + 2.0) + rounds * ln(2) as bf,
  list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(n_name, ''), lambda x: ascii(x)::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) as tie from c join nation on ord = n_nationkey)"""


def _scan(spark, d):
    items = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("name"))
    return rounded(dr.scan_deviation(items, 25, chunk_stream(spark, d)))


@query("scan_deviation", f"{_SCAN} select source, ord, name, rounds, k, round(z, 6) + 0.0 as z, round(bf, 6) + 0.0 as ln_bf from s")
def _(spark, d):
    return _scan(spark, d).drop("rank")


@query("scan_ranking", f"{_SCAN} select source, name, (row_number() over (partition by source order by round(bf, 9) desc, tie, name))::int as rank from s")
def _(spark, d):
    return _scan(spark, d).select("source", "name", "rank")


def _rates(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", F.array((k % 44).cast("int"), (F.floor(k / 44) % 44).cast("int"), (k * 7 % 44).cast("int")).alias("r"))


_R = "r as (select p_partkey, [p_partkey % 44, p_partkey // 44 % 44, p_partkey * 7 % 44] as r from part)"


@query("rate_phases", f"with {_R} select p_partkey, array_to_string(list_transform(r, lambda v: printf('%.6f', v * 2 * pi() / 44)), ',') as phases from r")
def _(spark, d):
    return _rates(spark, d).select("p_partkey", F.array_join(F.transform(ra.phases(F.col("r")), lambda v: F.format_string("%.6f", v)), ",").alias("phases"))


@query("convert_base", f"with {_R}, c as (select p_partkey, r, list_transform(r, lambda v: (floor(v * 10 / 44.0::double + 0.5) % 10)::int) as q from r), e as (select p_partkey, q, list_transform(range(1, 4), lambda i: q[i] * 2 * pi() / 10 - r[i] * 2 * pi() / 44) as g from c) select p_partkey, array_to_string(q, ',') as digits, round(list_max(list_transform(g, lambda x: abs(atan2(sin(x), cos(x))))), 9) as error from e")
def _(spark, d):
    c = _rates(spark, d).select("p_partkey", ra.convert_base(F.col("r"), 44, 10).alias("c"))
    return rounded(c.select("p_partkey", F.array_join(F.transform("c.digits", lambda v: v.cast("string")), ",").alias("digits"), "c.error"), 9)


_TO44 = "lambda v: (floor(v * 44 / {}.0::double + 0.5) % 44)::int"


@query(
    "rate_catalog",
    f"""with e as (select p_partkey, p_size, p_partkey % 4 as k from part), d as (select *, case
      when k = 0 then list_transform(string_split((p_partkey * p_size)::varchar, ''), lambda c: c::int)
      when k = 1 then [p_size % 100, p_partkey % 100]
      when k = 2 and p_size < 44 then [5, 9, p_size] end as v from e)
    select p_partkey, array_to_string(list_transform(case k when 0 then list_transform(v, {_TO44.format(10)}) when 1 then list_transform(v, {_TO44.format(100)}) else v end, lambda x: x::varchar), '-') as rate from d""",
)
def _(spark, d):
    """A rate index of several systems, projected to base 44; entries of no system keep no rate."""
    k = F.col("p_partkey") % 4
    systems = F.struct(
        F.when(k == 0, (F.col("p_partkey") * F.col("p_size")).cast("string")).alias("combe_base10"),
        F.when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(".00-"), (F.col("p_partkey") % 100).cast("string"), F.lit(".25"))).alias("krt"),
        F.when(k == 2, F.concat(F.lit(" 05 09 "), F.col("p_size").cast("string"))).alias("combe_base44"),
        F.when(k == 3, F.lit("none")).alias("delawarr"),
    )
    entries = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("term"), systems.alias("systems"))
    return ra.catalog(entries).select("p_partkey", ra.format_rate(F.col("rate")).alias("rate"))


@query("rate_parse", f"with {_R} select p_partkey, array_to_string(r, '-') as rate, array_to_string(list_transform(r, lambda v: lpad(v::varchar, 2, '0')), '.') as padded from r")
def _(spark, d):
    t = _rates(spark, d).select("p_partkey", ra.format_rate(F.col("r"), pad=True).alias("p"))
    parsed = t.select("p_partkey", ra.parse_rate(F.col("p")).alias("r"))
    return parsed.select("p_partkey", ra.format_rate(F.col("r")).alias("rate"), ra.format_rate(F.col("r"), separator=".", pad=True).alias("padded"))


_M = "(floor([7, 40, 23][(pos % 3 + 1)::int] * 256 / 44.0::double + 0.5) % 256)::int"


@query("xor_imprint", f"with {BYTES} select source, pos // 32 * 32 as off, string_agg(printf('%02x', xor(b, {_M})), '' order by pos) as h from byt group by 1, 2")
def _(spark, d):
    return chunk_stream(spark, d).select("source", "off", F.lower(F.hex(xor_mask(ra.mask_bytes([7, 40, 23]))("bytes", "off"))).alias("h"))


@query("phase_modulate", f"with {BYTES} select source, round(sum(x), 3) as total, count(*) as n from (select source, ((2 * pi() * b / 256 + [7, 40, 23][(pos % 3 + 1)::int] * 2 * pi() / 44) % (2 * pi())) as x from byt) group by source")
def _(spark, d):
    x = ra.phase_modulate(chunk_stream(spark, d), [7, 40, 23])
    total = F.aggregate("theta", F.lit(0.0), lambda a, v: a + v)
    return rounded(x.groupBy("source").agg(F.sum(total).alias("total"), F.sum(F.size("theta")).alias("n")), 3)


@query("circular_stats", "with a as (select user_id, value * pi() / 50 as th from events), s as (select user_id, count(*) as n, sum(cos(th)) as c, sum(sin(th)) as s from a group by user_id) select user_id, n, round(sqrt(c * c + s * s) / n, 6) as resultant, round(case when atan2(s, c) < 0 then atan2(s, c) + 2 * pi() else atan2(s, c) end, 6) as mean, round(1 - sqrt(c * c + s * s) / n, 6) as variance from s")
def _(spark, d):
    e = read(spark, d, "events").withColumn("th", F.col("value") * F.lit(ra.TAU / 100))
    return rounded(e.groupBy("user_id").agg(*ra.circular(F.col("th"))))


@query("signature_to_rate", "select p_partkey, array_to_string(list_transform(range(0, 6), lambda i: (('0x' || substr(sha256(p_name), (2 * i + 1)::int, 2))::int * 44 // 256)), ',') as rate from part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(ra.signature_rate(F.col("p_name"), 6), lambda v: v.cast("string")), ",").alias("rate"))


@query("char_code_rate", "select p_partkey, round(floor(sqrt(list_sum(list_transform(string_split(p_name, ''), lambda c: ascii(c)))) * 100 + 0.5) / 100, 6) as rate from part")
def _(spark, d):
    return rounded(read(spark, d, "part").select("p_partkey", ra.char_code_rate(F.col("p_name")).alias("rate")))


def _points(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_PT = "pt as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings), pr as (select a.id, b.id as id2, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 as d2 from pt a join pt b on a.id <> b.id)"


@query("nearest_neighbours", f"with {_PT} select id, round(sqrt(min(d2)), 9) as d from pr group by id")
def _(spark, d):
    p = _points(spark, d)
    return rounded(sp.nearest(p, 1.0, p.count()), 9)


@query("clark_evans", f"with {_PT}, n as (select id, sqrt(min(d2)) as d from pr group by id), m as (select count(*) as n, avg(d) as mean from n) select n, round(mean, 9) as mean, round(1 / (2 * sqrt(n)), 9) as expected, round(mean * 2 * sqrt(n), 6) as ratio, round((mean - 1 / (2 * sqrt(n))) / (0.26136::double / sqrt(n * n)), 6) as z from m")
def _(spark, d):
    p = _points(spark, d)
    c = sp.clark_evans(p, 1.0, p.count())
    return c.select("n", F.round("mean", 9).alias("mean"), F.round("expected", 9).alias("expected"), F.round("ratio", 6).alias("ratio"), F.round("z", 6).alias("z"))


@query("ripley_l", f"with {_PT} select r::double as radius, round(sqrt(count(*) filter (d2 <= r * r) / ((select count(*) from pt) ** 2)::double / pi()) - r, 9) + 0.0 as l from pr, (select unnest([0.02, 0.05, 0.1]::double[]) as r) group by r")
def _(spark, d):
    p = _points(spark, d)
    return rounded(sp.ripley_l(p, 1.0, p.count(), [0.02, 0.05, 0.1]), 9)


@query("attractor_counts", f"with {_PT} select pt.id, round(pt.x, 6) + 0.0 as x, round(pt.y, 6) + 0.0 as y, coalesce(c, 0) as neighbours from pt left join (select id, count(*) as c from pr where d2 <= 4.0::double / (select count(*) from pt) / pi() group by id) using (id)")
def _(spark, d):
    p = _points(spark, d)
    return rounded(sp.neighbour_counts(p, (4.0 / p.count() / 3.141592653589793) ** 0.5))


_COUNTED = f"{_PT}, ct as (select pt.id, coalesce(c, 0) as neighbours from pt left join (select id, count(*) as c from pr where d2 <= 4.0::double / (select count(*) from pt) / pi() group by id) using (id))"


@query("attractors", f"with {_COUNTED}, e as ((select 'attractor' as kind, id, neighbours from ct order by neighbours desc, id limit 1) union all (select 'void', id, neighbours from ct order by neighbours, id limit 1)) select kind, id, neighbours, round(case when kind = 'void' then 1 - {gamma_p_sql('(neighbours + 1)', '4.0::double')} when neighbours >= 1 then {gamma_p_sql('greatest(neighbours, 1)', '4.0::double')} else 1 end, 6) + 0.0 as p from e")
def _(spark, d):
    p = _points(spark, d)
    return rounded(sp.attractors(p, 1.0, p.count()))


@query("haversine", "with p as (select s_suppkey, (s_suppkey * 37 % 170 - 85)::double as a, (s_suppkey * 91 % 360 - 180)::double as o from supplier) select s_suppkey, round(2 * 6371008.8::double * asin(sqrt(least(1, sin(radians(48.2 - a) / 2) ** 2 + cos(radians(a)) * cos(radians(48.2::double)) * sin(radians(16.37 - o) / 2) ** 2))), 3) as metres from p")
def _(spark, d):
    p = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 170 - 85).cast("double").alias("a"), (F.col("s_suppkey") * 91 % 360 - 180).cast("double").alias("o"))
    return rounded(p.select("s_suppkey", sp.haversine(F.col("a"), F.col("o"), F.lit(48.2), F.lit(16.37)).alias("metres")), 3)


@query("destination", "with p as (select s_suppkey, radians((s_suppkey * 37 % 170 - 85)::double) as a, radians((s_suppkey * 91 % 360 - 180)::double) as o, radians((s_suppkey % 360)::double) as t, 1000.0::double * s_suppkey / 6371008.8::double as d from supplier), y as (select *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t)) as y from p) select s_suppkey, round(degrees(y), 6) + 0.0 as lat, round(((degrees(o + atan2(sin(t) * sin(d) * cos(a), cos(d) - sin(a) * sin(y))) + 540) % 360 + 360) % 360 - 180, 6) + 0.0 as lon from y")
def _(spark, d):
    k = F.col("s_suppkey")
    p = read(spark, d, "supplier").select("s_suppkey", sp.destination((k * 37 % 170 - 85).cast("double"), (k * 91 % 360 - 180).cast("double"), (k % 360).cast("double"), k * 1000.0).alias("p"))
    return rounded(p.select("s_suppkey", "p.*"))


def _latin_sql(cipher: str) -> str:
    table = le.cipher_tables()[cipher][1]
    return "map {" + ", ".join(f"'{c}': {v}" for c, v in table.items()) + "}"


_LATIN_CIPHERS = [k for k, (s, _, _) in le.cipher_tables().items() if s == "latin"]
_LETTERS = "w as (select p_partkey as id, list_filter(string_split(lower(p_name), ''), lambda c: c between 'a' and 'z') as l from part)"
_PROFILE = f"with {_LETTERS}, v as (" + " union all ".join(f"select id, '{k}' as cipher, list_sum(list_transform(l, lambda c: {_latin_sql(k)}[c]))::bigint as value from w where len(l) > 0" for k in _LATIN_CIPHERS) + ") select id, cipher, value, (case when value = 0 then 0 else 1 + (value - 1) % 9 end)::int as root from v"


def _profile(spark, d, cipher=None):
    """Parts' names by all ciphers or one."""
    ciphers = le.cipher_rows(spark)
    return le.profile(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), ciphers.where(F.col("cipher") == cipher) if cipher else ciphers)


@query("letter_profile", _PROFILE)
def _(spark, d):
    return _profile(spark, d)


for _cipher in _LATIN_CIPHERS:
    query("letter_" + _cipher.replace("-", "_"), f"select * from ({_PROFILE}) where cipher = '{_cipher}'")(lambda spark, d, c=_cipher: _profile(spark, d, c))


#: The letters that stand for a, b, c, ... in part names written in other scripts.
_SCRIPTS = (le.HEBREW, "αβγδεζηθικλμνξοπρστυφχψω", "".join(le.ARABIC[:26]))
_TABLE = ", ".join(f"('{k}', '{c}', {v}, {str(r).lower()})" for k, (script, table, r) in le.cipher_tables().items() if script != "latin" for c, v in table.items())


@query(
    "letter_values_other_scripts",
    "with w as (" + " union all ".join(f"select p_partkey * 3 + {i} as id, translate(lower(p_name), '{'abcdefghijklmnopqrstuvwxyz'[: len(x)]}', '{x}') as text from part" for i, x in enumerate(_SCRIPTS)) + f"""), l as (select id, unnest(string_split(text, '')) as letter from w),
    v as (select id, cipher, sum(value)::bigint as v, any_value(reduced) as reduced from l join (values {_TABLE}) c(cipher, letter, value, reduced) using (letter) group by all),
    r as (select *, case when v = 0 then 0 else 1 + (abs(v) - 1) % 9 end::int as root from v) select id, cipher, (case when reduced then root else v end)::bigint as value, root from r""",
)
def _(spark, d):
    part = read(spark, d, "part")
    words = [part.select((F.col("p_partkey") * 3 + i).alias("id"), F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz"[: len(x)], x).alias("text")) for i, x in enumerate(_SCRIPTS)]
    dealt = words[0].unionByName(words[1]).unionByName(words[2]).repartition(4 * spark.sparkContext.defaultParallelism, "id")
    sums = le.letter_sums(dealt, le.cipher_rows(spark).where("script <> 'latin'"))
    return le.rooted(sums.groupBy("id", "cipher").agg(F.sum("sum").alias("sum"), F.first("reduced").alias("reduced")))


_NATION = "n as (select n_nationkey as id, n_name as word, list_sum(list_transform(list_filter(string_split(lower(n_name), ''), lambda c: c between 'a' and 'z'), lambda c: ascii(c) - 96))::bigint as value from nation)"


@query("lexicon_match", f"with {_NATION}, p as (select p_partkey as id, list_sum(list_transform(list_filter(string_split(lower(p_name), ''), lambda c: c between 'a' and 'z'), lambda c: ascii(c) - 96))::bigint as value from part) select p.id, word, n.value - p.value as delta from p join n on abs(n.value - p.value) <= 3")
def _(spark, d):
    c = le.cipher_rows(spark).where("cipher = 'en-ordinal'")
    words = le.profile(read(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("text")), c).select(F.col("id").alias("word"), "value")
    return le.lexicon_matches(_profile(spark, d, "en-ordinal").select("id", "value"), words, 3)


@query(
    "number_properties",
    """select p_partkey as n, list_sum(list_transform(string_split(p_partkey::varchar, ''), lambda c: c::int))::int as digit_sum, (1 + (p_partkey - 1) % 9)::int as root,
    p_partkey >= 2 and len(list_filter(range(2, floor(sqrt(p_partkey))::bigint + 1), lambda k: p_partkey % k = 0)) = 0 as prime, (floor((sqrt(8 * p_partkey + 1) - 1) / 2) * (floor((sqrt(8 * p_partkey + 1) - 1) / 2) + 1) / 2) = p_partkey as triangular,
    floor(sqrt(p_partkey) + 0.5) ** 2 = p_partkey as square, p_partkey > 1 and list_sum(list_filter(range(1, p_partkey), lambda k: p_partkey % k = 0)) = p_partkey as perfect from part where p_partkey > 0""",
)
def _(spark, d):
    p = read(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("n"), le.number_properties(F.col("p_partkey")).alias("p"))
    return p.select("n", "p.digit_sum", "p.root", "p.prime", "p.triangular", "p.square", "p.perfect")


@query("notariqon", "select p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: w <> ''), lambda w: w[1]), '') as first, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: w <> ''), lambda w: w[-1]), '') as last from part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", le.notariqon(F.col("p_name")).alias("first"), le.notariqon(F.col("p_name"), "last").alias("last"))


_HEB = "translate(lower(p_name), 'abcdefghijklmnopqrstuv', 'אבגדהוזחטיכלמנסעפצקרשת')"


@query("temurah", f"select p_partkey, translate({_HEB}, 'אבגדהוזחטיכלמנסעפצקרשת', reverse('אבגדהוזחטיכלמנסעפצקרשת')) as atbash from part")
def _(spark, d):
    word = F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuv", le.HEBREW)
    return read(spark, d, "part").select("p_partkey", le.temurah(word).alias("atbash"))


def _sealed(spark, d):
    """Suppliers' names with their delays and proofs, dealt over all cores: a proof is much work for a short row, so the scan's few splits don't do."""
    s = read(spark, d, "supplier").select("s_suppkey", F.encode(F.col("s_name"), "UTF-8").alias("x"), (F.col("s_suppkey") % 50 + 1).alias("t"))
    dealt = s.repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return dealt.withColumn("p", vdf.seal(vdf.RSA_2048)("x", "t"))


@query("vdf_seal")
def _(spark, d):
    return _sealed(spark, d).select("s_suppkey", F.lower(F.hex("p")).alias("proof"))


@query("vdf_verify", "select s_suppkey, true as ok, false as forged from supplier")
def _(spark, d):
    return _sealed(spark, d).select("s_suppkey", vdf.verify(vdf.RSA_2048)("x", "p").alias("ok"), vdf.verify(vdf.RSA_2048)(F.concat("x", F.lit(b"!")), "p").alias("forged"))


_RESP = "resp as (select s_suppkey // 4 as request_id, s_suppkey % 4 as ord, 'p' || (s_suppkey % 4) as name, case when s_suppkey % 3 = 0 then 'qrng' else 'trng' end as kind, case when s_suppkey % 5 = 0 then 'public' else 'private' end as privacy, s_suppkey % 7 <> 0 as ok, s_suppkey * 31 % 97 as latency_ms, sha256(s_suppkey::varchar) as h from supplier)"


def _responses(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(
        F.floor(k / 4).alias("request_id"), (k % 4).alias("ord"), F.concat(F.lit("p"), (k % 4).cast("string")).alias("name"), F.when(k % 3 == 0, "qrng").otherwise("trng").alias("kind"),
        F.when(k % 5 == 0, "public").otherwise("private").alias("privacy"), (k % 7 != 0).alias("ok"), (k * 31 % 97).alias("latency_ms"), F.sha2(k.cast("string"), 256).alias("h"),
    )


@query("strategy_fallback", f"with {_RESP} select request_id, arg_min(name, ord) as name, arg_min(h, ord) as h from resp where ok group by request_id")
def _(spark, d):
    return st.fallback(_responses(spark, d))


@query("strategy_race", f"with {_RESP}, r as (select *, row_number() over (partition by request_id order by latency_ms, ord) as r from resp where ok) select request_id, name, h from r where r = 1")
def _(spark, d):
    return st.race(_responses(spark, d))


@query(
    "strategy_xor",
    f"""with {_RESP}, w as (select request_id, 'xor(' || string_agg(name, ',' order by ord) || ')' as name, case when min(kind) = max(kind) then min(kind) else 'mixed' end as kind, case when bool_or(privacy = 'private') then 'private' else 'public' end as privacy from resp group by 1 having bool_and(ok)),
    b as (select request_id, i, bit_xor(('0x' || substr(h, (2 * i + 1)::int, 2))::int) as b from resp, range(0, 32) r(i) group by all), x as (select request_id, string_agg(printf('%02x', b), '' order by i) as h from b group by 1) select request_id, name, kind, privacy, h from w join x using (request_id)""",
)
def _(spark, d):
    return st.xor_mix(_responses(spark, d))


@query("histogram_decay", f"with {BYTES}, c as (select source, pos // 4096 as chunk, b // 8 as bin, count(*) as c from byt group by all), l as (select source, max(chunk) as last from c group by source) select source, bin::int as bin, round(sum(c * 0.9::double ** (last - chunk)), 6) as weight from c join l using (source) group by all")
def _(spark, d):
    return rounded(fr.decayed_histogram(chunk_stream(spark, d)))


@query("frame_roundtrip", "select event_id, round(event_id::double, 6) as x, round(value, 6) + 0.0 as y from events")
def _(spark, d):
    nan = F.lit(float("nan"))
    f = read(spark, d, "events").select("event_id", fr.frame_points(fr.series_frame(7)(F.array(F.col("event_id").cast("double"), F.col("value"), nan, nan))).alias("p"))
    return rounded(f.select("event_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))


@query("ring_buffer", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 5")
def _(spark, d):
    return fr.last_n(read(spark, d, "events"), ["user_id"], "event_id", 5).select("user_id", "event_id")


@query("scales", "with r as (select event_type, min(value) as lo, max(value) as hi from events group by 1), p as (select event_type, lo - 0.05::double * (hi - lo) as low, hi + 0.05::double * (hi - lo) as high from r), s as (select *, (high - low) / 5 as raw, 10.0::double ** floor(log10((high - low) / 5)) as pw from p) select event_type, round(low, 6) + 0.0 as low, round(high, 6) + 0.0 as high, round(pw * case when raw / pw < 1.5 then 1 when raw / pw < 3.5 then 2 when raw / pw < 7.5 then 5 else 10 end, 6) as step from s")
def _(spark, d):
    r = read(spark, d, "events").groupBy("event_type").agg(*fr.auto_range("value"))
    return rounded(r.withColumn("step", fr.nice_step(F.col("low"), F.col("high"))))


def _folder(spark):
    """Where streams keep chunks and state: the cluster's shared folder; only on one machine, if none is named, a folder of it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="stream-")


@query("stream_trials", f"with {BYTES} select source, pos // 25 as t, sum(bit_count(b))::int as sum from byt group by all having count(*) = 25")
def _(spark, d):
    at = f"{_folder(spark)}/chunks-{uuid.uuid4().hex}"
    stream = live.replayed(rechunk(chunk_stream(spark, d), BUCKET), "off", F.length("bytes"), 1 << 26, at)
    return live.run_available(live.trial_stream(stream, 200), at, 8)
