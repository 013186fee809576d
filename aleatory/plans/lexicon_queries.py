"""Lexicon draws, chambers, accounts, sessions and small conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics as nu
from ..functions.bytes import read_varint
from ..functions.chunks import BUCKET, low_bits, rechunk
from ..operators import draws, extract, letters, lexicon, protocols, rates, spatial, trials
from ..sources import records, strategies
from ..streaming import live
from .more_queries import _RESP, _folder, _responses
from .protocol_queries import _APT
from .registry import BITSTR, BYTES, DIGEST, TRIALS, Z, chunk_stream, digest, query, read, rounded, trials256

_WORDS = "w as (select n_name as word, list_sum(list_transform(list_filter(string_split(lower(n_name), ''), lambda c: c between 'a' and 'z'), lambda c: ascii(c) - 96))::bigint as value from nation)"


def _drawn(n: str, limit: str) -> str:
    """Draws below n of one byte each."""
    return f"f as (select source, b, row_number() over (partition by source order by pos) - 1 as i from byt where b < {limit}), d as (select source, i, b % {n} as v from f)"


def _valued(spark, names):
    """``(word, value)`` of ``(text)``."""
    words = names.select(F.col("text").alias("id"), "text")
    return letters.profile(words, letters.cipher_rows(spark).where(F.col("cipher") == letters.resolve_cipher("simple"))).select(F.col("id").alias("word"), "value")


def _words(spark, d):
    return _valued(spark, read(spark, d, "nation").select(F.col("n_name").alias("text")))


@query("draw_words", f"with {BYTES}, {_WORDS}, p as (select word, row_number() over (order by word) - 1 as v from w), {_drawn('25', '250')} select source, i, word from d join p using (v)")
def _(spark, d):
    return lexicon.draw_words(chunk_stream(spark, d), _words(spark, d).select("word"))


_CHOSEN = "c as (select value, count(*) as c from w group by value order by c desc, value desc limit 1), p as (select word, w.value, row_number() over (order by word) - 1 as v, c.c as n from w join c on w.value = c.value), k as materialized (select any_value(n) as n, 256 // any_value(n) * any_value(n) as top from p)"


@query("draw_by_value", f"with {BYTES}, {_WORDS}, {_CHOSEN}, f as (select source, b % n as v, row_number() over (partition by source order by pos) - 1 as i from byt, k where b < top and n > 1 union all select distinct source, 0, 0 from byt, k where n = 1) select source, i, word, value from f join p using (v)")
def _(spark, d):
    """Words of the value that most words share, the greatest of such values."""
    words = _words(spark, d)
    shared = words.groupBy("value").agg(F.count("*").alias("c")).agg(F.max_by("value", F.struct("c", "value"))).first()[0]
    return lexicon.draw_by_value(chunk_stream(spark, d), words, shared or 0)


_SEGMENTS = _WORDS.replace("n_name", "word").replace("select word as word,", "select word,").replace("from nation", "from (select distinct c_mktsegment as word from customer)")


@query("draw_by_own_value", f"with {BYTES}, {_SEGMENTS}, m as materialized (select max(value) as value from w), p as (select word, w.value, row_number() over (order by word) - 1 as v, count(*) over () as n from w join m on w.value = m.value), k as materialized (select max(n) as n, 256 // max(n) * max(n) as top from p), f as (select source, b % n as v, row_number() over (partition by source order by pos) - 1 as i from byt, k where b < top and n > 1 union all select distinct source, 0, 0 from byt, k where n = 1) select source, i, word, value from f join p using (v)")
def _(spark, d):
    """Of the market segments, words of the greatest value: where that is one word's own, no bytes are taken."""
    names = read(spark, d, "customer").select(F.col("c_mktsegment").alias("text")).distinct()
    words = _valued(spark, names)
    return lexicon.draw_by_value(chunk_stream(spark, d), words, words.agg(F.max("value")).first()[0] or 0)


@query("cast_words", f"with {BYTES}, {_WORDS}, p as (select word, value, (1 + (value - 1) % 9)::int as root, count(*) over (partition by value) - 1 as matches, row_number() over (order by word) - 1 as v from w), {_drawn('25', '250')} select source, i, word, value, root, matches from d join p using (v)")
def _(spark, d):
    return lexicon.cast_words(chunk_stream(spark, d), _words(spark, d))


@query("cast_values", f"with {BYTES}, {_WORDS}, c as (select value, count(*) as words from w group by value), p as (select value, words, row_number() over (order by value) - 1 as v from c), {_drawn('(select count(*) from p)', '256 // (select count(*) from p) * (select count(*) from p)')} select source, i, value, words, round(words / (select count(*) from w), 6) as share from d join p using (v)")
def _(spark, d):
    return rounded(lexicon.cast_values(chunk_stream(spark, d), _words(spark, d)))


@query("cast_value_range", f"with {BYTES}, {_WORDS}, c as (select value, count(*) as words from w group by value), {_drawn('60', '240')} select source, i, (v + 40)::bigint as value, coalesce(words, 0) as words, round(coalesce(words, 0) / (select count(*) from w), 6) as share from d left join c on value = v + 40")
def _(spark, d):
    return rounded(lexicon.cast_values(chunk_stream(spark, d), _words(spark, d), 40, 99))


_HEB = "translate(lower(substr(p_name, 1, 1)), 'abcdefghijklmnopqrstuvwxyz', 'אבגדהוזחטיכלמנסעפצקרשתךםןף')"


@query("nine_chambers", f"with h as (select p_partkey, {_HEB} as letter from part), o as (select *, strpos('אבגדהוזחטיכלמנסעפצקרשתךםןףץ', letter) - 1 as i from h) select p_partkey, (i % 9 + 1)::int as chamber, (i // 9 + 1)::int as place from o where i >= 0")
def _(spark, d):
    letter = F.translate(F.lower(F.substring("p_name", 1, 1)), "abcdefghijklmnopqrstuvwxyz", letters.HEBREW + "ךםןף")
    out = read(spark, d, "part").select("p_partkey", letters.chamber(letter).alias("c")).where("c is not null")
    return out.select("p_partkey", "c.chamber", "c.place")


@query("reverse_values", "select p_partkey, list_sum(list_transform(list_filter(string_split(lower(p_name), ''), lambda c: c between 'a' and 'z'), lambda c: 123 - ascii(c)))::bigint as value from part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", letters.reverse_value(F.col("p_name")).alias("value"))


@query("geomancy_houses", f"with {DIGEST}, s as (select source, t, {BITSTR} as s from dig), b as (select source, t, list_transform(range(0, 16), lambda i: substr(s, (i + 1)::int, 1)::int) as b from s), m as (select source, t, list_transform(range(0, 4), lambda m: 8 * b[(4 * m + 1)::int] + 4 * b[(4 * m + 2)::int] + 2 * b[(4 * m + 3)::int] + b[(4 * m + 4)::int]) as m, list_transform(range(0, 4), lambda k: 8 * b[(k + 1)::int] + 4 * b[(k + 5)::int] + 2 * b[(k + 9)::int] + b[(k + 13)::int]) as d from b) select source, t, array_to_string(m || d || [xor(m[1], m[2]), xor(m[3], m[4]), xor(d[1], d[2]), xor(d[3], d[4])], ',') as houses from m")
def _(spark, d):
    n = digest(spark, d).select("source", "t", F.conv(F.substring("h", 1, 4), 16, 10).cast("int").alias("n"))
    return n.select("source", "t", F.concat_ws(",", draws.houses(draws.figures(F.col("n"))).cast("array<string>")).alias("houses"))


_VN = f"{BYTES}, bits as (select source, pos * 8 + i as p, (b >> (7 - i)::int) & 1 as bit from byt, range(0, 8) r(i)), pr as (select source, p // 2 as p, max(case when p % 2 = 0 then bit end) as a, max(case when p % 2 = 1 then bit end) as b from bits group by all), vn as (select source, p // 128 * 32 as off, count(*) as n, sum(count(*)) over (partition by source order by p // 128 * 32) as upto from pr where a <> b group by 1, 2)"


@query("debias_account", f"with {_VN} select source, off, (upto // 8 - (upto - n) // 8)::bigint as bytes, round(8.0 * (upto // 8 - (upto - n) // 8), 6)::double as bits, 'input: independent bits of one bias; von-neumann' as trace from vn")
def _(spark, d):
    return extract.debias_account(extract.von_neumann(chunk_stream(spark, d)))


@query("record_session", f"""with {TRIALS}, ali as (select * from tri where t <= (select min(m) from (select max(t) as m from tri group by source))) select '{{"v":1,"t":' || t || ',"source":"' || source || '","sum":' || sum || ',"bitsPerTrial":256}}' as value from ali""")
def _(spark, d):
    return protocols.record_lines(trials.aligned(trials256(spark, d)), 256)


@query("session_round_trip", f"with {TRIALS} select source, t::double as t, sum::bigint as sum, 256::bigint as bits, null::varchar as error from tri")
def _(spark, d):
    """Written as lines by a committing sink and read back."""
    at = f"{_folder(spark)}/recorded-{live.new_name()}"
    records.write_session(trials256(spark, d), at, 256)
    return records.read_session(spark, at).select("source", "t", "sum", F.col("bitsPerTrial").alias("bits"), "error")


_FAULTS = ("version", "timestamp", "source", "bitsPerTrial", "sum")


@query("session_faults", "select case s_suppkey % 9 when 5 then 'not JSON' " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(_FAULTS)) + " end as error, count(*) as lines from supplier group by 1")
def _(spark, d):
    """Of a line for each supplier, of which most have a fault: how many are found to have which."""
    k = F.col("s_suppkey")
    field = lambda i, fine, bad: F.when(k % 9 == i, F.lit(bad)).otherwise(F.lit(fine) if isinstance(fine, str) else fine)
    parts = [field(0, "1", "2"), field(1, k.cast("string"), '"soon"'), field(2, F.format_string('"s%d"', k % 3), '""'), field(4, "100", "201"), field(3, "200", "7")]
    line = F.format_string('{"v":%s,"t":%s,"source":%s,"sum":%s,"bitsPerTrial":%s}', *parts)
    at = f"{_folder(spark)}/faults-{live.new_name()}"
    read(spark, d, "supplier").select(F.when(k % 9 == 5, '{"v":1,').otherwise(line).alias("value")).write.text(at)
    return records.read_session(spark, at).groupBy("error").agg(F.count("*").alias("lines"))


@query("constant_bits", f"with {TRIALS} select source, count(*) as records, true as constant from tri group by source")
def _(spark, d):
    return protocols.session_bits(protocols.parse_records(protocols.record_lines(trials256(spark, d), 256)))


@query("receipts", """with r as (select s_suppkey, s_suppkey % 44 || '-' || s_suppkey * 7 % 44 as target, case when s_suppkey % 2 = 0 then sha256(s_name) end as w from supplier) select s_suppkey, '{"v":1,"t":' || s_suppkey * 1000 || ',"target":"' || target || '"' || case when w is null then '' else ',"witnessHash":"' || w || '"' end || ',"bytesConsumed":' || s_suppkey * 16 || ',"resonances":' || s_suppkey % 3 || ',"rounds":' || s_suppkey || '}' as line, true as ok from r""")
def _(spark, d):
    k = F.col("s_suppkey")
    r = read(spark, d, "supplier").select(k, (k * 1000).alias("t"), F.concat_ws("-", k % 44, k * 7 % 44).alias("target"), F.when(k % 2 == 0, F.sha2("s_name", 256)).alias("witnessHash"), (k * 16).alias("bytesConsumed"), (k % 3).alias("resonances"), k.alias("rounds"))
    lines = r.select("s_suppkey", protocols.receipt_line().alias("line"))
    return lines.select("s_suppkey", "line", protocols.receipt_ok(F.col("line")).alias("ok"))


@query("digit_degrees", "select p_partkey, round(p_partkey % 44 * 360 / 44.0::double, 6) as degrees from part")
def _(spark, d):
    return rounded(read(spark, d, "part").select("p_partkey", rates.degrees(F.col("p_partkey") % 44).alias("degrees")))


@query("regions", "select s_suppkey, case when s_suppkey % 3 = 0 then 'disk' else 'rect' end as kind, round(case when s_suppkey % 3 = 0 then pi() * s_suppkey * s_suppkey else (s_suppkey % 7)::double * s_suppkey end, 6) as area, s_suppkey > 0 and (s_suppkey % 3 = 0 or s_suppkey % 7 > 0) as valid from supplier")
def _(spark, d):
    k = F.col("s_suppkey").cast("double")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "disk").otherwise("rect")
    r = read(spark, d, "supplier").select("s_suppkey", kind.alias("kind"), (k % 7).alias("width"), k.alias("height"), k.alias("radius"))
    return rounded(r.select("s_suppkey", "kind", spatial.region_area().alias("area"), spatial.valid_region().alias("valid")))


@query("point_to_place", "with p as (select vec_id, embedding[1]::double * 1000 as x, embedding[2]::double * 1000 as y from embeddings), q as (select vec_id, atan2(x, y) as b, sqrt(x * x + y * y) / 6371008.8::double as d, radians(48.2::double) as a from p), z as (select *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b)) as lat from q) select vec_id, round(degrees(lat), 6) as lat, round(16.37::double + degrees(atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * sin(lat))), 6) as lon from z")
def _(spark, d):
    e = F.col("embedding")
    p = read(spark, d, "embeddings").select("vec_id", spatial.point_to_place(F.lit(48.2), F.lit(16.37), e[0].cast("double") * 1000, e[1].cast("double") * 1000).alias("p"))
    return rounded(p.select("vec_id", "p.*"))


@query("composite_privacy", f"with {_RESP} select request_id, case when bool_and(privacy = 'private') then 'private' else 'public' end as privacy, count(*) as members from resp group by 1")
def _(spark, d):
    return _responses(spark, d).groupBy("request_id").agg(strategies.pessimistic_privacy(F.col("privacy")).alias("privacy"), strategies.members("request").alias("members"))


@query("varints", f"with {DIGEST}, b as (select source, t, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::int) as b from dig), n as (select *, list_position(list_transform(b, lambda x: x < 128), true) as n from b) select source, t, list_sum(list_transform(range(0, n), lambda i: (b[i + 1] & 127)::bigint << (7 * i)))::bigint as value, n::int as length from n where n is not null")
def _(spark, d):
    v = digest(spark, d).select("source", "t", read_varint(F.substring(F.unhex("h"), 1, 8)).alias("v")).where("v.length > 0")
    return v.select("source", "t", "v.value", "v.length")


@query("chi2_cdf", "with x as (select o_orderkey, (o_orderkey % 40 + 2) // 2 * 2 as df, (floor(o_totalprice)::bigint % 997) / 10.0::double as x from orders) select o_orderkey, round(1 - exp(-x / 2) * list_sum(list_transform(range(0, df // 2), lambda i: (x / 2) ** i / exp(lgamma(i + 1)))), 6) + 0.0 as p from x")
def _(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", (F.floor((F.col("o_orderkey") % 40 + 2) / 2) * 2).alias("df"), ((F.floor("o_totalprice") % 997) / 10.0).alias("x"))
    return rounded(x.select("o_orderkey", nu.chi2_cdf(F.col("x"), F.col("df")).alias("p")))


_THIRDS = f"""with {BYTES}, r as (select source, (max(pos) + 1) // 75 as rounds from byt group by source),
c as (select source, rounds, pos // (25 * rounds) as part, pos % 25 as ord, sum(b & 1)::bigint as k from byt join r using (source) where pos < 75 * rounds group by all)
select source, ['high', 'low', 'baseline'][(part + 1)::int] as intention, n_name as name, k, round((k - rounds / 2) / sqrt(rounds / 4), 6) + 0.0 as z from c join nation on ord = n_nationkey"""


@query("scan_tripolar", _THIRDS)
def _(spark, d):
    items = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("name"))
    return rounded(draws.scan_tripolar(items, 25, chunk_stream(spark, d)).select("source", "intention", "name", "k", "z"))


_TICKS = f"{TRIALS}, zz as (select t, source, (sum - 128) / 8.0::double as z from tri), ro as (select t, string_agg(source, ',' order by source) as present, sum(z) / sqrt(count(*)) as zs from zz group by t), tk as (select t as step, t, present, zs, sum(zs * zs) over (order by t) as netvar from ro)"


def _ticks(spark, d):
    """All event types' digests as one live session: each source ends where its events do, and the others go on without it."""
    at = f"{_folder(spark)}/session-{live.new_name()}"
    tri = trials256(spark, d).select(F.lit("all").alias("session"), "source", "t", F.col("sum").cast("double").alias("sum"))
    ends = tri.groupBy("session", "source").agg((F.max("t") + 1).alias("t")).withColumn("sum", F.lit(None).cast("double"))
    stream = live.replayed(tri.unionByName(ends), "t", 1, 1 << 21, at)
    roster = [r[0] for r in tri.select("source").distinct().collect()]  # a session's sources
    live.rocksdb_state(spark)
    return live.run_available(live.session_ticks(stream, roster, 256), at, 8)


@query("stream_session", f"with {_TICKS} select step, t, present, round(zs, 9) + 0.0 as stouffer, round(netvar, 9) as netvar, round(netvar - step - 1, 9) + 0.0 as cumdev from tk")
def _(spark, d):
    return rounded(_ticks(spark, d).select("step", "t", F.array_join("present", ",").alias("present"), "stouffer", "netvar", "cumdev"), 9)


@query("session_events", f"with {_TICKS} select step, s_suppkey as id from tk join supplier on step >= s_suppkey * 3 and step < s_suppkey * 3 + 50")
def _(spark, d):
    k = F.col("s_suppkey")
    events = read(spark, d, "supplier").select(k.alias("id"), (k * 3).alias("start"), (k * 3 + 50).alias("stop"))
    return live.active_events(_ticks(spark, d), events).select("step", "id")


_NIB = f"{BYTES}, nib as (select source, pos, b & 1 as b from byt)"
_RCT = "g as (select *, pos - row_number() over (partition by source, b order by pos) as g from nib), r as (select source, pos, b, row_number() over (partition by source, b, g order by pos) as r from g), rct as (select source, pos, b from r where r >= 9 and (r - 9) % 8 = 0)"

def _low_stream(spark, d, name):
    at = f"{_folder(spark)}/{name}-{live.new_name()}"
    rows = rechunk(chunk_stream(spark, d).withColumn("bytes", low_bits("bytes")), BUCKET).select("source", "off", "bytes")
    return live.replayed(rows, "off", F.length("bytes"), 1 << 26, at), at


@query("stream_alarms", f"with {_NIB}, {_RCT} select source, pos, b from rct")
def _(spark, d):
    stream, at = _low_stream(spark, d, "alarms")
    return live.run_available(live.alarm_stream(stream, 9), at, 8)


@query("stream_health", f"with {_NIB}, {_RCT}, {_APT} select source, pos as sample, 'rct' as test, 9 as count, b as value from rct union all select source, pos, 'apt', 42, b from apt")
def _(spark, d):
    stream, at = _low_stream(spark, d, "health")
    return live.run_available(live.health_stream(stream, 9, 42, 64), at, 8)


@query("stream_health_strict", f"with {_NIB}, {_RCT}, {_APT}, e as (select source, pos, 0 as o, 'rct' as test, 9 as count, b from rct union all select source, pos, 1, 'apt', 42, b from apt) select source, pos as sample, test, count, b as value from (select *, row_number() over (partition by source order by pos, o) as n from e) where n = 1")
def _(spark, d):
    stream, at = _low_stream(spark, d, "strict")
    return live.run_available(live.health_stream(stream, 9, 42, 64, strict=True), at, 8)
