"""Closed forms, invariants and restated loops."""

import base64
import hashlib
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from aleatory import plans
from aleatory.functions import bytes as by
from aleatory.functions import modular
from aleatory.functions import numerics as nu
from aleatory.functions.chunks import rechunk, xor_mask
from aleatory.functions.positions import positions, ranked
from aleatory.operators import draws, estimators, extract, flow, health, letters, lexicon, network, protocols, rates, spatial, trials, vdf
from aleatory.sources import frames, providers
from aleatory.streaming import live


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_special_functions():
    assert nu.gamma_q_np(np.array([1.0, 5.0]), np.array([2.0, 5.0])) == pytest.approx([math.exp(-2), sum(5**i / math.factorial(i) for i in range(5)) * math.exp(-5)], rel=1e-12)
    assert nu.norm_sf_np(np.array([1.959963984540054]))[0] == pytest.approx(0.025, rel=1e-9)
    p, k = np.array([0.05, 0.5, 0.95, 0.999]), np.array([1.0, 4.0, 10.0, 255.0])
    assert 1 - nu.gamma_q_np(k / 2, nu.chi2_ppf_np(p, k) / 2) == pytest.approx(p, rel=1e-9)
    assert nu.norm_ppf_np(np.array([0.0, 0.5, 1.0])).tolist() == [-math.inf, 0.0, math.inf]


def test_quantiles_of_many_degrees_of_freedom():
    import time

    k = np.array([200.0, 201.0, 555.0, 3000.0, 40001.0])
    for p in (1e-5, 0.05, 0.5, 0.95, 0.999):
        z = float(nu.norm_ppf_np(np.array([p]))[0])
        guess = k * (1 - 2 / (9 * k) + z * np.sqrt(2 / (9 * k))) ** 3
        assert nu.chi2_ppf_np(np.full(k.shape, p), k) == pytest.approx(nu._ppf_bisected(np.full(k.shape, p), k, guess), abs=2e-7)
    many = np.arange(1e7, 1e7 + 20000)
    start = time.process_time()
    x = nu.chi2_ppf_np(np.full(many.shape, 0.95), many)
    assert time.process_time() - start < 10 and (np.diff(x) > 1).all()  # bisection took some 10**6 steps per row


def test_even_chi_square_agrees_with_the_udf(spark):
    df = frame(spark, [(x, k) for x in (0.5, 10.0, 40.0) for k in (2, 4, 10, 30)], "x double, k int")
    got = df.select(nu.chi2_sf_even(F.col("x"), F.col("k")).alias("a"), nu.chi2_sf(F.col("x"), F.col("k").cast("double")).alias("b")).toPandas()
    assert got.a.tolist() == pytest.approx(got.b.tolist(), rel=1e-9)


def test_positions_across_buckets(spark):
    ids = random.Random(1).sample(range(1000), 300)
    df = frame(spark, [("ab"[i % 2], i) for i in ids], "g string, o bigint")
    got = positions(df, ["g"], "o", bucket=16).toPandas()
    for g, part in got.groupby("g"):
        assert part.sort_values("o").t.tolist() == list(range(len(part)))


def test_ranks_of_hot_groups(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 4 else f"g{i % 12}", i, rng.choice([rng.random() ** 9, 0.5])) for i in range(2000)]
    got = ranked(frame(spark, rows, "g string, t bigint, x double"), ["g"], "x", "t", bucket=50).collect()
    order = {(g, t): k for g in {r[0] for r in rows} for k, (_, t) in enumerate(sorted((x, t) for h, t, x in rows if h == g))}
    assert len(got) == 2000 and all(r.r == order[r.g, r.t] for r in got)


def test_rct_alarms_follow_the_counter(spark):
    rng = random.Random(3)
    data = [(s, i, rng.random() < 0.8) for s in "xy" for i in range(700)]
    data = [(s, i, int(b)) for s, i, b in data]
    want = []
    for s in "xy":
        count, last = 0, None
        for _, i, b in (r for r in data if r[0] == s):
            count = count + 1 if b == last else 1
            last = b
            if count >= 6:
                want.append((s, i))
                count = 1
    for size in (1, 7, 100):
        chunks = [(s, i, bytearray(b for t, j, b in data if t == s and i <= j < i + size)) for s in "xy" for i in range(0, 700, size)]
        got = health.rct_alarms(frame(spark, chunks, "source string, off bigint, bytes binary"), 6, bucket=32)
        assert sorted((r.source, r.pos) for r in got.collect()) == sorted(want)


def test_chunks_of_any_size_give_the_same(spark):
    """Trials, debiasing, draws and pools of a stream, however it is cut, against whole-array values."""
    rng = np.random.default_rng(5)
    whole = {s: rng.integers(0, 256, n).astype(np.uint8) for s, n in (("x", 1000), ("y", 333), ("z", 1))}
    rows = []
    for s, b in whole.items():
        at = 0
        while at < len(b):
            size = int(rng.integers(1, 40))
            rows.append((s, at, bytearray(b[at : at + size].tobytes())))
            at += size
    df = frame(spark, rows + [("x", 1000, bytearray())], "source string, off bigint, bytes binary").repartition(3)
    for bits in (8, 13, 200):
        want = {(s, t): int(x.sum()) for s, b in whole.items() for t, x in enumerate(np.unpackbits(b)[: 8 * len(b) // bits * bits].reshape(-1, bits))}
        assert {(r.source, r.t): r["sum"] for r in trials.trials_from_bytes(df, bits).collect()} == want
    got = sorted((r.source, r.i, r.bits) for r in extract.von_neumann(df).collect())
    for s, b in whole.items():
        pairs = np.unpackbits(b).reshape(-1, 2)
        mine = [r for r in got if r[0] == s]
        assert "".join(x for *_, x in mine) == "".join(str(a) for a, c in pairs if a != c)
        assert [i for _, i, _ in mine] == np.append(0, np.cumsum([len(x) for *_, x in mine]))[:-1].tolist()
    for n in (6, 256, 1000, 100_000):
        k = draws.width(n)
        values = {s: [v % n for v in (int.from_bytes(b[i : i + k].tobytes(), "big") for i in range(0, len(b) - k + 1, k)) if v < 256**k // n * n] for s, b in whole.items()}
        drawn = draws.uniform_ints(df, n, chunk=16).collect()
        assert sorted((r.source, r.i, r.v) for r in drawn) == sorted((s, i, v) for s, vs in values.items() for i, v in enumerate(vs))
    pools = {(r.source, r.block): r.digest for r in extract.condition(df, 48).collect()}
    assert pools == {(s, i): hashlib.sha256(b[48 * i : 48 * i + 48].tobytes()).hexdigest() for s, b in whole.items() for i in range(len(b) // 48)}
    masked = df.select("source", "off", xor_mask([7, 200, 3])("bytes", "off").alias("bytes"))
    again = rechunk(masked.select("source", "off", xor_mask([7, 200, 3])("bytes", "off").alias("bytes")), 64).collect()
    assert {(r.source, r.off): bytes(r.bytes) for r in again} == {(s, i): b[i : i + 64].tobytes() for s, b in whole.items() for i in range(0, len(b), 64)}


def test_toeplitz_against_the_matrix(spark):
    rng = random.Random(6)
    seed, h = "".join(rng.choice("01") for _ in range(100 + 20 - 1)), [f"{rng.getrandbits(100):025x}" for _ in range(20)]
    got = frame(spark, [(x,) for x in h], "h string").select("h", extract.toeplitz(seed, 100, 20)(F.unhex(F.concat("h", F.lit("0")))).alias("y")).collect()
    for r in got:
        x = [int(c) for c in f"{int(r.h, 16):0100b}"]
        assert r.y == "".join(str(sum(int(seed[i - j + 99]) * x[j] for j in range(100)) % 2) for i in range(20))


def test_apt_alarms_follow_the_sequential_test_across_segments(spark):
    rng = random.Random(4)
    data = [(s, i, int(rng.random() < p)) for s, p, n in (("x", 0.5, 1000), ("y", 0.7, 1037), ("z", 1.0, 333), ("w", 0.5, 7)) for i in range(n)]
    want = []
    for s in "xyzw":
        b, i = [r[2] for r in data if r[0] == s], 0
        while i < len(b):
            hits = [j for j in range(i, min(i + 16, len(b))) if b[j] == b[i]]
            if len(hits) >= 11:
                want.append((s, hits[10]))
                i = hits[10] + 1
            else:
                i += 16
    chunks = [(s, i, bytearray(r[2] for r in data if r[0] == s)[i : i + 37]) for s in "xyzw" for i in range(0, sum(r[0] == s for r in data), 37)]
    for segment in (50, 16, 1 << 16):
        got = health.apt_alarms(frame(spark, chunks, "source string, off bigint, bytes binary"), 16, 11, segment=segment)
        assert sorted((r.source, r.pos) for r in got.collect()) == sorted(want)


def test_cutoffs():
    assert [health.rct_cutoff(h) for h in (0.5, 1, 8)] == [41, 21, 4]
    assert health.apt_cutoff(0.5, 512) == 410 and health.apt_cutoff(0.3, 512) == 456


def test_peres_rate():
    assert extract.peres_rate(0.5) == pytest.approx(1, abs=1e-3) and extract.peres_rate(0.5, 1) == 0.25


def test_transfer_entropy_of_a_delayed_copy_is_one_bit(spark):
    rng = random.Random(5)
    x = [rng.randrange(2) for _ in range(4000)]
    df = frame(spark, [(t, x[t], x[t - 1] if t else 0) for t in range(4000)], "t bigint, x int, y int")
    assert flow.transfer_entropy(df).first().te == pytest.approx(1, abs=5e-3)
    assert flow.transfer_entropy(df.select("t", F.col("y").alias("x"), F.col("x").alias("y"))).first().te < 5e-3
    local = flow.local_transfer_entropy(df).agg(F.avg("te")).first()[0]
    assert local == pytest.approx(flow.transfer_entropy(df).first().te, rel=1e-9)


def test_mutual_information_is_symmetric(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.randrange(3)) for _ in range(500)]
    df = frame(spark, rows, "x int, y int")
    a = flow.mutual_information(df).first().mi
    b = flow.mutual_information(df.select(F.col("y").alias("x"), F.col("x").alias("y"))).first().mi
    assert a == pytest.approx(b) and a >= 0


def test_event_windows_and_rolling_over_bucket_borders(spark):
    rng = random.Random(7)
    z = [("s", t, rng.gauss(0, 1)) for t in range(900)]
    df = frame(spark, z, "source string, t bigint, z double")
    got = network.event_windows(df, frame(spark, [(1, 200, 600), (2, 5, 5)], "id int, start_t bigint, end_t bigint")).collect()
    assert [(r.id, r.df) for r in got] == [(1, 400)] and got[0].statistic == pytest.approx(sum(v * v for _, t, v in z if 200 <= t < 600))
    r = protocols.rolling(df.select("t", F.col("z").alias("zs")), 50, 7, bucket=64).toPandas().sort_values("t")
    assert r.t.tolist() == list(range(49, 900, 7))
    assert r.stouffer.tolist() == pytest.approx([sum(v for _, t, v in z[e - 49 : e + 1]) / math.sqrt(50) for e in r.t])


def test_canonical_json_ignores_key_order():
    assert protocols.canonical_json({"b": 1.0, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'
    assert protocols.register({"a": 1, "b": 2}) == protocols.register({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        protocols.canonical_json({"a": float("nan")})


def test_bad_records_are_marked(spark):
    lines = ['{"v":1,"t":0,"source":"a","sum":3,"bitsPerTrial":8}', '{"v":2,"t":0,"source":"a","sum":3,"bitsPerTrial":8}', "junk", '{"v":1,"t":0,"source":"a","sum":9,"bitsPerTrial":8}']
    assert [r.ok for r in protocols.parse_records(frame(spark, [(x,) for x in lines], "value string")).collect()] == [True, False, False, False]


def test_varints_and_content_identifiers():
    assert by.varint(b"\xac\x02\x01", 0) == (300, 2) and by.varint(b"\x00\x7f", 1) == (127, 2)
    for bad in (b"", b"\x80", b"\xff" * 9):
        with pytest.raises(ValueError):
            by.varint(bad, 0)
    digest = hashlib.sha256(b"x").digest()
    cid = "b" + base64.b32encode(b"\x01\x71\x12\x20" + digest).decode().lower().rstrip("=")
    assert by.cid_digest(cid) == digest
    for bad in ("z" + cid[1:], cid[:20], "b" + base64.b32encode(b"\x02\x71\x12\x20" + digest).decode().lower().rstrip("=")):
        with pytest.raises(ValueError):
            by.cid_digest(bad)


def test_large_numbers(spark):
    numbers = [2**61 - 1, 33550336, 2305843008139952128, 10**18 + 9, 10**18, 561, 3215031751, 1, 2, 6]
    got = {r.n: r.p for r in frame(spark, [(n,) for n in numbers], "n bigint").select("n", letters.number_properties(F.col("n")).alias("p")).collect()}
    assert [n for n in numbers if got[n].prime] == [2**61 - 1, 10**18 + 9, 2] and [n for n in numbers if got[n].perfect] == [33550336, 2305843008139952128, 6]


def test_letters_are_looked_up_in_their_row(spark):
    words = frame(spark, [(1, "Ab, é"), (1, "b"), (2, None), (3, "7 !"), (None, "z"), (4, ""), (5, "אב")], "id long, text string")
    ciphers = letters.cipher_rows(spark).where("cipher in ('en-ordinal', 'he-katan-mispari')")
    got = letters.profile(words, ciphers)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "en-ordinal", 2, 2), (1, "en-ordinal", 8, 8), (5, "he-katan-mispari", 3, 3), (None, "en-ordinal", 26, 8)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan  # a task holds no groups of the words
    assert letters.profile(words, ciphers.limit(0)).count() == 0


def test_lexicon_errors(spark):
    data = frame(spark, [("a", 0, bytearray(b"\x00\x01"))], "source string, off bigint, bytes binary")
    words = frame(spark, [("x", 3), ("y", 3), ("z", 4)], "word string, value bigint")
    with pytest.raises(ValueError):
        lexicon.draw_words(data, words.limit(0))
    with pytest.raises(ValueError):
        letters.resolve_cipher("none")
    assert lexicon.draw_by_value(data, words, 9).count() == 0 and letters.resolve_cipher("hebrew") == "he-hechrachi"
    assert sorted(tuple(r) for r in lexicon.draw_by_value(data, words, 3).collect()) == [("a", 0, "x", 3), ("a", 1, "y", 3)]


def test_frames_against_fixed_bytes():
    assert frames.encode_bytes(7, b"ab") == bytes.fromhex("010107006162")
    assert frames.encode_series(1, [(1.0, -2.0, 0.5, 0.0)]).hex() == "01020100" + "000000000000f03f" + "00000000000000c0" + "000000000000e03f" + "0000000000000000"
    assert frames.encode_matrix(2, 1, 2, [1.0, 0.5]).hex() == "01030200" + "01000200" + "0000803f" + "0000003f"


def test_decodings(spark):
    df = frame(spark, [("2NEpo7TZRRrLZSi2U", "mzxw6ytboi")], "a string, b string")
    r = df.select(by.base58_decode("a"), by.base32_decode("b")).first()
    assert bytes(r[0]) == b"Hello World!" and bytes(r[1]) == b"foobar"


def test_fnv(spark):
    def fnv(t):
        h = 2166136261
        for c in t:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    words = ["", "a", "foobar", "NATION"]
    got = frame(spark, [(w,) for w in words if w], "w string").select(by.fnv1a(F.col("w"))).collect()
    assert [r[0] for r in got] == [fnv(w) for w in words if w]


def test_hexagram_and_shield(spark):
    bits = "000" + "001" + "100" + "111" + "011" + "110"
    c = frame(spark, [(bits,)], "s string").select(draws.hexagram(F.col("s")).alias("c")).first().c
    assert list(c.lines) == [6, 7, 8, 9, 7, 8] and list(c.changing) == [1, 4]
    assert c.primary == draws.KING_WEN[draws.TRIGRAMS.index("010")][draws.TRIGRAMS.index("110")]
    assert sorted(v for row in draws.KING_WEN for v in row) == list(range(1, 65))
    judges = frame(spark, [(f"{v:016b}",) for v in range(0, 65536, 97)], "s string").select(draws.shield(F.col("s"))["judge"].alias("j")).collect()
    assert all(bin(r.j).count("1") % 2 == 0 for r in judges)


def test_figures_of_a_shield(spark):
    rows = [(f"{v:016b}" + "01" * (v % 3),) for v in range(0, 65536, 61)] + [(None,), ("01",)]
    for r in frame(spark, rows, "s string").select("s", draws.shield(F.col("s")).alias("c"), draws.houses(draws.shield(F.col("s"))).alias("h")).collect():
        if not r.s or len(r.s) < 16:
            assert all(v is None for v in [*r.h, *r.c.mothers, *r.c.daughters, *r.c.nieces, *r.c.witnesses, r.c.judge])
            continue
        b = [int(x) for x in r.s[:16]]
        mothers = [int("".join(map(str, b[4 * m : 4 * m + 4])), 2) for m in range(4)]
        daughters = [int("".join(str(b[4 * m + k]) for m in range(4)), 2) for k in range(4)]
        nieces = [mothers[0] ^ mothers[1], mothers[2] ^ mothers[3], daughters[0] ^ daughters[1], daughters[2] ^ daughters[3]]
        assert (r.c.mothers, r.c.daughters, r.c.nieces, r.h) == (mothers, daughters, nieces, mothers + daughters + nieces)
        assert r.c.witnesses == [nieces[0] ^ nieces[1], nieces[2] ^ nieces[3]] and r.c.judge == r.c.witnesses[0] ^ r.c.witnesses[1]


def test_houses_read_a_digest_once(spark, tmp_path):
    """Its text was made again for each bit of each house, a millisecond a row; lambdas around the houses kept Spark from seeing that."""
    frame(spark, [(i, "ab"[i % 2]) for i in range(10)], "event_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    plan = plans.QUERIES["geomancy_houses"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == 1 and "transform(" not in plan


def test_draws_are_distinct_and_counted(spark):
    data = bytes(range(256))
    r = frame(spark, [(bytearray(data),), (bytearray(b""),), (None,)], "x binary").select(draws.draw_without_replacement(78, 10)("x").alias("r")).collect()
    assert len(set(r[0].r.drawn)) == 10 and r[0].r.used >= 10
    assert r[1].r.drawn is None and r[2].r.drawn is None


def test_rates(spark):
    df = frame(spark, [("07-13-43",), ("7.44",), ("1-2.3",), ("x",)], "s string")
    got = [r[0] for r in df.select(rates.parse_rate(F.col("s"))).collect()]
    assert [None if g is None else list(g) for g in got] == [[7, 13, 43], None, None, None]
    twice = frame(spark, [(b, i) for i, b in enumerate((0, 7, 200, 255))], "b int, i int")
    m = F.array(F.lit(3), F.lit(20))
    assert [r[0] for r in twice.select(rates.xor_imprint(rates.xor_imprint(F.col("b"), m, F.col("i")), m, F.col("i"))).collect()] == [0, 7, 200, 255]


def test_point_patterns_against_all_pairs(spark):
    rng = random.Random(8)
    pts = [(i, rng.random() * 10, rng.random() * 8) for i in range(150)] + [(150, 90.0, 90.0)]
    df = frame(spark, pts, "id bigint, x double, y double")
    d = {i: min(math.hypot(x - a, y - b) for j, a, b in pts if j != i) for i, x, y in pts}
    got = {r.id: r.d for r in spatial.nearest(df, 80.0, len(pts)).collect()}
    assert got == pytest.approx(d)
    lr = spatial.ripley_l(df, 80.0, len(pts), [0.5, 2.0]).toPandas().set_index("radius").l
    for r in (0.5, 2.0):
        c = sum(math.hypot(x - a, y - b) <= r for i, x, y in pts for j, a, b in pts if i != j)
        assert lr[r] == pytest.approx(math.sqrt(80 * c / len(pts) ** 2 / math.pi) - r)


def test_letter_values():
    t = letters.cipher_tables()
    assert len(t) == 31
    value = lambda c, w: sum(t[c][1].get(x, 0) for x in w)
    assert value("he-hechrachi", "יהוה") == 26 and value("gr-isopsephy", "ιησους") == 888 and value("ar-abjad", "الله") == 66
    assert [letters.milui("יהוה", v) for v in ("ab", "sag", "mah", "ban")] == [72, 63, 45, 52]
    assert t["en-cross"][1]["z"] == 77 and t["en-prime-cross"][1]["z"] == 103 and t["en-primes"][1]["z"] == 101
    assert t["la-agrippa"][1]["z"] == 500 and t["he-kidmi"][1]["ת"] == 1495


def test_normalise_and_scripts(spark):
    df = frame(spark, [("Ἰησοῦς",), ("שָׁלוֹם",), ("Ébène",), (None,)], "t string")
    assert [r[0] for r in df.select(letters.normalise("t")).collect()] == ["ιησους", "שלום", "ebene", None]
    assert [r[0] for r in df.select(letters.detect_script(F.col("t"))).collect()] == ["greek", "hebrew", "latin", None]


def test_number_properties(spark):
    got = {r.n: r.p for r in spark.range(1, 500).select(F.col("id").alias("n"), letters.number_properties(F.col("id")).alias("p")).collect()}
    assert [n for n, p in got.items() if p.perfect] == [6, 28, 496]
    assert [n for n, p in got.items() if p.prime][:5] == [2, 3, 5, 7, 11] and [n for n, p in got.items() if p.square][:3] == [1, 4, 9]


def test_delay_proofs():
    n = (2**89 - 1) * (2**107 - 1)
    for t in (1, 2, 3, 7, 20):
        y, mus = vdf.prove(b"seed", t, n)
        assert y == pow(vdf.group_element(b"seed", n), 2**t, n) and vdf.check(b"seed", t, y, mus, n)
        assert not vdf.check(b"other", t, y, mus, n) and not vdf.check(b"seed", t, (y + 1) % n, mus, n)
        raw = vdf.to_bytes(t, y, mus, n)
        assert vdf.from_bytes(raw, n) == (t, y, mus) and vdf.from_bytes(raw[:-1], n) is None


@pytest.mark.parametrize("n", [vdf.RSA_2048, (1 << 4096) - 1, (1 << 64) + 13])
def test_powers_of_many_rows(n):
    r = random.Random(3)
    bases = [r.randrange(n) for _ in range(150)] + [0, 1, 2, n - 1, n - 2]
    exponents = [r.getrandbits(128) for _ in range(150)] + [0, 0, 1, 2**128 - 1, 2**128 - 1]
    assert modular.modulus(n).powers(bases, exponents) == [pow(b, e, n) for b, e in zip(bases, exponents, strict=True)]


def plain_check(data, t, y, mus, n):
    x = vdf.group_element(data, n)
    for mu in mus:
        r = vdf.challenge(x, y, mu, t, n)
        x, y, t = pow(x, r, n) * mu % n, pow(mu, r, n) * (y * y if t % 2 else y) % n, (t + 1) // 2
    return y == x * x % n


def test_delay_proofs_of_a_batch():
    """Proofs of many rows are those of one row and of long delays; every kind of forgery has the outcome of the plain folding."""
    n = (2**89 - 1) * (2**107 - 1)
    data, ts = [b"%d" % i for i in range(80)], [i % 40 + 1 for i in range(78)] + [129, 300]
    proofs = vdf.prove_all(data, ts, n)
    assert proofs[5] == vdf.prove(data[5], ts[5], n) and all(plain_check(d, t, y, mus, n) for d, t, (y, mus) in zip(data, ts, proofs, strict=True))
    assert all(vdf.check_all(data, [(t, *p) for t, p in zip(ts, proofs, strict=True)], n))
    forged = []
    for i, (y, mus) in enumerate(proofs):
        k = i % len(mus) if mus else 0
        forged += [(data[i], ts[i], n - y, mus), (data[i], ts[i], y, [*mus[:k], n - mus[k], *mus[k + 1 :]] if mus else mus), (data[i], ts[i], n - y, [n - mus[0], *mus[1:]] if mus else mus), (data[i] + b"!", ts[i], y, mus)]
    got = vdf.check_all([f[0] for f in forged], [f[1:] for f in forged], n)
    assert got == [plain_check(*f, n) for f in forged] and True in got and False in got


def test_delay_proofs_of_the_challenge_number():
    n = vdf.assert_modulus(vdf.RSA_2048)
    assert n.bit_length() == 2048 and len(str(n)) == 617
    y, mus = vdf.prove(b"seed", 37, n)
    assert vdf.from_bytes(vdf.to_bytes(37, y, mus, n), n) == (37, y, mus)
    assert vdf.check(b"seed", 37, y, mus, n) and not vdf.check(b"seed", 36, y, mus, n)
    for bad in (2**80, 2**61 - 1):
        with pytest.raises(ValueError):
            vdf.seal(bad)
    for bad in (0, 2**32):
        with pytest.raises(ValueError):
            vdf.assert_steps(bad)


def test_rate_catalog_prefers_dials_of_ten(spark):
    def entry(term, **system):
        return (term, {k: system.get(k) for k in ("combe_base10", "delawarr", "copen_homeo", "copen_organ", "krt", "combe_base44")})

    rows = [
        entry("both", delawarr="149", krt="62.00-38.00"),
        entry("hundred", delawarr="x", krt="62.00-38.00"),
        entry("labels", krt="a-b", combe_base44=" 05 09 12 "),
        entry("out of range", combe_base44="05 44"),
        entry("none"),
        entry("", delawarr="149"),
        entry(None, delawarr="149"),
    ]
    fields = ", ".join(f"{k}: string" for k in rows[0][1])
    got = rates.catalog(spark.createDataFrame(rows, f"term string, systems struct<{fields}>"))
    assert {r.term: r.rate for r in got.collect()} == {"both": [4, 18, 40], "hundred": [27, 17], "labels": [5, 9, 12], "out of range": None, "none": None}


def test_permuted_keeps_the_values_of_each_series(spark):
    pairs = spark.range(200).select(F.col("id").alias("t"), (F.col("id") * F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("y"))
    got = flow.permuted(pairs, 3, 1).toPandas().sort_values(["surrogate", "t"])
    own = pairs.toPandas()
    orders = [g for _, g in got.groupby("surrogate")]
    assert len(orders) == 3
    for g in orders:
        assert g.t.tolist() == list(range(200)) and g.y.tolist() == own.y.tolist()
        assert sorted(g.x) == sorted(own.x) and g.x.tolist() != own.x.tolist()
    assert orders[0].x.tolist() != orders[1].x.tolist()


def test_ripley_by_field_is_ripley_of_each_field(spark):
    rng = np.random.default_rng(5)
    rows = [(f, i, float(x), float(y)) for f, n in (("a", 60), ("b", 25), ("lonely", 1)) for i, (x, y) in enumerate(rng.random((n, 2)))]
    p = frame(spark, rows, "f string, id int, x double, y double")
    got = {(r.f, r.radius): r.l for r in spatial.ripley_l_by(p, "f", 1.0, [0.05, 0.2]).collect()}
    for f, n in (("a", 60), ("b", 25), ("lonely", 1)):
        for r in spatial.ripley_l(p.where(F.col("f") == f).drop("f"), 1.0, n, [0.05, 0.2]).collect():
            assert got[f, r.radius] == pytest.approx(r.l)


def test_races_and_vitality_of_stated_bytes(spark):
    def run(udf, data):
        return spark.createDataFrame([(bytearray(data),)], "x binary").select(udf("x").alias("r")).first().r

    # Of 3 items all are chosen, two draws order them (the last takes no byte); then each gains 10 a round.
    race = run(draws.energy_race(3), bytes([0, 0]) + bytes([10]) * 28)
    assert race.drawn == [0, 100, 1, 90, 2, 90] and race.used == 2 + 28
    assert run(draws.energy_race(3), bytes([0, 0, 10])).drawn is None
    # Two bytes a draw of 0..1000, one a draw of 0..100.
    calm = run(draws.vitality, b"".join(v.to_bytes(2, "big") for v in (7, 950, 12)))
    assert calm.drawn == [950] and calm.used == 6
    lively = run(draws.vitality, b"".join(v.to_bytes(2, "big") for v in (7, 951, 12)) + bytes([60, 50, 49]))
    assert lively.drawn == [951 + 110] and lively.used == 9


def test_attractors_against_a_loop(spark):
    rng = np.random.default_rng(11)
    xy = rng.random((80, 2))
    radius = math.sqrt(4.0 / 80 / math.pi)
    near = [sum(i != j and float(((a - b) ** 2).sum()) <= radius * radius for j, b in enumerate(xy)) for i, a in enumerate(xy)]
    p = frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    got = {r.kind: r for r in spatial.attractors(p, 1.0, 80).collect()}
    most, least = max(near), min(near)
    pmf = [math.exp(-4) * 4**k / math.factorial(k) for k in range(80)]
    assert (got["attractor"].id, got["attractor"].neighbours) == (near.index(most), most) and got["attractor"].p == pytest.approx(sum(pmf[most:]), rel=1e-9)
    assert (got["void"].id, got["void"].neighbours) == (near.index(least), least) and got["void"].p == pytest.approx(sum(pmf[: least + 1]), rel=1e-9)


def test_frames_round_trip():
    assert frames.decode(frames.encode_bytes(3, b"abc")) == {"kind": "bytes", "channel": 3, "data": b"abc"}
    assert frames.decode(frames.encode_matrix(1, 1, 2, [0.5, 1.5]))["values"] == [0.5, 1.5]
    with pytest.raises(ValueError):
        frames.decode(b"\x02\x01\x00\x00")


def test_sources(spark):
    providers.register(spark)
    got = spark.read.format("system_bytes").option("chunks", 5).option("chunk_bytes", 16).option("partitions", 2).load()
    assert sorted((r.seq, len(r.bytes)) for r in got.collect()) == [(i, 16) for i in range(5)]
    answers = {"u?n=2&seq=0": {"data": {"hex": "00ff"}}, "u?n=2&seq=1": {"data": {"hex": "0102"}}}
    reader = providers.RestReader({"url": "u?n={n}&seq={seq}", "path": "data.hex", "chunk_bytes": "2", "chunks": "2", "source": "x"}, lambda url, headers: answers[url])
    assert [(r[0], r[1], r[3]) for p in reader.partitions() for r in reader.read(p)] == [("x", 0, b"\x00\xff"), ("x", 1, b"\x01\x02")]
    with pytest.raises(ValueError):
        providers.decode({"hex": "00"}, "hex", "hex", 2)


def test_stream_of_trials_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = {s: rng.integers(0, 256, 300, dtype=np.uint8).tobytes() for s in "ab"}
    for k in range(3):
        rows = [(s, 10 * (10 * k + i), bytearray(data[s][100 * k + 10 * i : 100 * k + 10 * i + 10])) for s in "ab" for i in range(10)]
        frame(spark, rows, "source string, off bigint, bytes binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, off bigint, bytes binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.run_available(live.trial_stream(stream, 56), str(tmp_path)).toPandas()
    for s in "ab":
        bits = np.unpackbits(np.frombuffer(data[s], np.uint8))
        want = bits[: len(bits) // 56 * 56].reshape(-1, 56).sum(1).tolist()
        assert got[got.source == s].sort_values("t")["sum"].tolist() == want


def test_stream_of_alarms_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = {s: (rng.random(300) < p).astype(np.uint8).tobytes() for s, p in (("a", 0.8), ("b", 1.0))}
    for k in range(3):
        rows = [(s, 10 * (10 * k + i), bytearray(data[s][100 * k + 10 * i : 100 * k + 10 * i + 10])) for s in "ab" for i in range(10)]
        frame(spark, rows, "source string, off bigint, bytes binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, off bigint, bytes binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.run_available(live.alarm_stream(stream, 5), str(tmp_path)).collect()
    batch = health.rct_alarms(frame(spark, [(s, 0, bytearray(b)) for s, b in data.items()], "source string, off bigint, bytes binary"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(got) > 50


def test_interval_trials(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 0, 1), bytearray(b"\xff")), ("a", datetime(2024, 1, 1, 0, 0, 2), bytearray(b"\x01")), ("a", datetime(2024, 1, 1, 0, 0, 12), bytearray(b"\x00"))]
    got = live.interval_trials(frame(spark, rows, "source string, at timestamp, bytes binary"), "10 seconds").toPandas().sort_values("start")
    assert got["sum"].tolist() == [9, 0] and got.n.tolist() == [16, 8]


def test_sample_entropy_of_a_restated_loop():
    x = np.random.default_rng(2).normal(size=80)
    r, m = 0.2 * x.std(), 2
    count = lambda k, n: sum(max(abs(x[i + q] - x[j + q]) for q in range(k)) <= r for i in range(n) for j in range(i + 1, n))
    assert estimators._sample_entropy(x) == pytest.approx(-math.log(count(m + 1, 78) / count(m, 79)))


def test_estimates_of_long_series_are_of_the_whole_series(spark):
    rng = random.Random(8)
    data = [(s, t, f(t)) for s, n, f in (("noise", 601, lambda t: rng.gauss(5, 2)), ("ties", 350, lambda t: float(rng.randrange(4))), ("wave", 303, lambda t: math.sin(t / 9)), ("flat", 300, lambda t: 1.0), ("short", 40, lambda t: rng.random())) for t in range(n)]
    series = frame(spark, data, "series string, t bigint, x double")
    got = estimators.series_estimates(series, most=100).toPandas().sort_values("series").reset_index(drop=True)
    want = estimators.series_estimates(series).toPandas().sort_values("series").reset_index(drop=True)
    assert got.series.tolist() == want.series.tolist() == ["noise", "short", "ties", "wave"] and got.n.tolist() == [601, 40, 350, 303]
    for c in want.columns[1:]:
        assert got[c].tolist() == pytest.approx(want[c].tolist(), rel=1e-9, abs=1e-12)
