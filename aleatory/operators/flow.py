"""Information flow between symbol streams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import xorshift32
from ..functions.positions import BUCKET, haloed, ranked
from ..functions.shared import cut


def quantile_bins(series: DataFrame, bins: int) -> DataFrame:
    """``(series, t, s)``: floor(rank * bins / n), ties in order of t (not ntile, which parts remainders differently)."""
    return ranked(series, ["series"], "x", "t").select("series", "t", F.floor(F.col("r") * bins / F.col("n")).cast("int").alias("s"))


def equal_width_bins(series: DataFrame, bins: int) -> DataFrame:
    """``(series, t, s)`` over each series' range; a constant one is 0."""
    ends = series.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    return series.join(ends, "series").select("series", "t", s.cast("int").alias("s"))


def ordinal_patterns(series: DataFrame, order: int = 3, delay: int = 1) -> DataFrame:
    """``(series, t, s, weight)``: Lehmer code of the stable ranks of x(t), x(t + delay), ...; weight is their population variance. ``t`` is dense."""
    reach = (order - 1) * delay
    w = Window.partitionBy("series", "__b").orderBy("t")
    held = haloed(series.select("series", "t", "x"), ["series"], "t", reach)
    df = held.select("series", "__own", (F.col("t") - reach).alias("t"), *[(F.lag("x", reach - j * delay).over(w) if j < order - 1 else F.col("x")).alias(f"x{j}") for j in range(order)])
    df = df.where(F.col("__own") & (F.col("t") >= 0))
    code = F.lit(0)
    for i in range(order):
        for j in range(i + 1, order):
            code = code + (F.col(f"x{j}") < F.col(f"x{i}")).cast("int") * math.factorial(order - 1 - i)
    mean = sum((F.col(f"x{j}") for j in range(order)), F.lit(0.0)) / order
    var = sum(((F.col(f"x{j}") - mean) * (F.col(f"x{j}") - mean) for j in range(order)), F.lit(0.0)) / order
    return df.select("series", "t", code.alias("s"), var.alias("weight"))


def entropies(symbols: DataFrame, sets: list[list[str]], keys: list[str] | None = None) -> DataFrame:
    """Keys, n and one entropy in bits per set of columns (named h_ and the columns), from one pass of grouping sets."""
    keys = keys or []
    columns = sorted({c for s in sets for c in s})
    grouped = symbols.groupingSets([[*keys, *s] for s in sets], *keys, *columns).agg(F.count("*").alias("c"), F.grouping_id().alias("g"))
    bits = {tuple(s): sum(1 << i for i, c in enumerate(reversed([*keys, *columns])) if c not in [*keys, *s]) for s in sets}
    term = F.col("c") * F.log2("c")
    per = [(F.log2(F.sum(F.when(F.col("g") == g, F.col("c")))) - F.sum(F.when(F.col("g") == g, term)) / F.sum(F.when(F.col("g") == g, F.col("c")))).alias("h_" + "".join(s)) for s, g in bits.items()]
    n = F.sum(F.when(F.col("g") == next(iter(bits.values())), F.col("c"))).alias("n")
    return grouped.groupBy(*keys).agg(n, *per)


def mutual_information(symbols: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(n, mi)`` of columns x, y; not under 0."""
    h = entropies(symbols, [["x", "y"], ["x"], ["y"]], keys)
    return h.select(*(keys or []), "n", F.greatest(F.col("h_x") + F.col("h_y") - F.col("h_xy"), F.lit(0.0)).alias("mi"))


def conditional_mutual_information(symbols: DataFrame) -> DataFrame:
    h = entropies(symbols, [["x", "y", "z"], ["x", "z"], ["y", "z"], ["z"]])
    return h.select("n", F.greatest(F.col("h_xz") + F.col("h_yz") - F.col("h_xyz") - F.col("h_z"), F.lit(0.0)).alias("cmi"))


def miller_madow(h: Column, kinds: Column, n: Column) -> Column:
    return h + (kinds - 1) / (2 * n * math.log(2))


def _history(name: str, first: int, length: int, alphabet: int, w) -> Column:
    """The symbols ``first``, ``first + 1``, ... places back as one number in base ``alphabet``, the latest the lowest digit; an array where 63 bits don't hold it."""
    past = [F.lag(name, first + j).over(w) for j in range(length)]
    if alphabet**length >= 1 << 63:
        return F.array(*past)
    return sum((p.cast("bigint") * alphabet**j for j, p in enumerate(past[1:], 1)), past[0].cast("bigint"))


def embed(pairs: DataFrame, lag: int = 1, k: int = 1, l: int = 1, keys: list[str] | None = None, alphabet: int | None = None, bucket: int = BUCKET) -> DataFrame:  # noqa: E741
    """``(keys, t, x, y)`` to ``(keys, t, y1, y0, x0)``: the symbol y1 at t, the ``k`` symbols of y before it and ``l`` symbols of x, the latest ``lag`` before it.

    Histories are mixed-radix codes made in one pass over range buckets with a
    halo, so that any k and l cost one shuffle and a single long stream is
    dealt to all tasks. ``alphabet`` bounds the symbols (0 <= symbol <
    alphabet); unless given it is looked up. Steps whose history has a gap or
    isn't whole give no row.
    """
    if min(lag, k, l) < 1:
        raise ValueError("lag, k and l are at least 1")
    keys = keys or []
    most, least = (alphabet - 1, 0) if alphabet else pairs.agg(F.max(F.greatest("x", "y")), F.min(F.least("x", "y"))).first()
    if least is not None and least < 0:
        raise ValueError("symbols are numbers from 0")
    reach = max(k, lag + l - 1)
    w = Window.partitionBy(*keys, "__b").orderBy("t")
    code = lambda name, first, length: _history(name, first, length, (most or 0) + 1, w)
    held = haloed(pairs.select(*keys, "t", "x", "y"), keys, "t", reach, bucket)
    e = held.select(*keys, "t", "__own", F.col("y").alias("y1"), code("y", 1, k).alias("y0"), code("x", lag, l).alias("x0"), (F.lag("t", reach).over(w) == F.col("t") - reach).alias("__whole"))
    return e.where("__own and __whole").select(*keys, "t", "y1", "y0", "x0")


def transfer_entropy(pairs: DataFrame, keys: list[str] | None = None, lag: int = 1, k: int = 1, l: int = 1, miller_madow: bool = False, alphabet: int | None = None) -> DataFrame:  # noqa: E741
    """``(keys, n, te)`` from x to y in bits, with histories of ``k`` symbols of y and ``l`` of x; embedded pairs, or counts ``c`` of such, are taken as they are.

    Not under 0, unless corrected by ``miller_madow``: each of the four
    entropies then gains (kinds - 1) / (2 n ln 2).
    Joint states are counted first, the marginals over those rows.
    """
    keys = keys or []
    return _te(pairs if "y0" in pairs.columns else embed(pairs, lag, k, l, keys, alphabet), keys, miller_madow)


def _te(e: DataFrame, keys: list[str], miller_madow: bool = False) -> DataFrame:
    joint = e.groupBy(*keys, "y1", "y0", "x0").agg((F.sum("c") if "c" in e.columns else F.count("*")).alias("c"))
    over = lambda *c: F.sum("c").over(Window.partitionBy(*keys, *c))
    ratio = F.log2(F.col("c") * over("y0") / (over("y0", "x0") * over("y1", "y0")))
    te = F.sum(F.col("c") * F.col("l")) / F.sum("c")
    if not miller_madow:
        return joint.withColumn("l", ratio).groupBy(*keys).agg(F.sum("c").alias("n"), F.greatest(te, F.lit(0.0)).alias("te"))
    # A kind counts once: its rows share it out.
    share = lambda *c: 1 / F.count("*").over(Window.partitionBy(*keys, *c))
    kinds = share("y1", "y0") + share("y0", "x0") - 1 - share("y0")
    by = joint.select(*keys, "c", ratio.alias("l"), kinds.alias("kinds")).groupBy(*keys)
    return by.agg(F.sum("c").alias("n"), (te + F.round(F.sum("kinds")) / (2 * F.sum("c") * math.log(2))).alias("te"))


def local_transfer_entropy(pairs: DataFrame, lag: int = 1, k: int = 1, l: int = 1, alphabet: int | None = None) -> DataFrame:  # noqa: E741
    """``(t, te)`` of each step with a whole history; their mean is the transfer entropy."""
    e = embed(pairs, lag, k, l, alphabet=alphabet)
    joint = e.groupBy("y1", "y0", "x0").agg(F.count("*").alias("c"))
    over = lambda *c: F.sum("c").over(Window.partitionBy(*c))
    local = joint.withColumn("te", F.log2(F.col("c") * over("y0") / (over("y0", "x0") * over("y1", "y0")))).drop("c")
    return e.join(local, ["y1", "y0", "x0"]).select("t", "te")


def circular_offsets(n: int, count: int, seed: int = 0x9E3779B9) -> list[int]:
    """Offsets 1 + floor(u * (n - 1)) of seeded circular-shift surrogates, one draw each."""
    states = xorshift32(seed)
    return [1 + int((next(states) + 0.5) / 4294967296 * (n - 1)) for _ in range(count)]


def shifted(pairs: DataFrame, offsets: list[int], n: int) -> DataFrame:
    """``(surrogate, t, x, y)`` with x rotated by each offset (a stated, small list): step t takes the symbol of step t + offset."""
    x = pairs.select("t", "x")
    turned = x.select(F.posexplode(F.array(*map(F.lit, offsets))).alias("surrogate", "o"), "t", "x").select("surrogate", F.pmod(F.col("t") - F.col("o"), F.lit(n)).alias("t"), "x")
    return turned.join(pairs.select("t", "y"), "t")


def _ring(pairs: DataFrame, n: int, lag: int, k: int, l: int) -> tuple[DataFrame, int]:  # noqa: E741
    """What ``embed`` makes of a series closed to a ring, and the first step whose history doesn't cross its ends."""
    reach = max(k, lag + l - 1)
    at = F.array(F.struct((F.col("t") + reach).alias("t")), F.struct((F.col("t") + reach - n).alias("t")))
    ring = pairs.select(F.explode(F.filter(at, lambda p: p["t"] >= 0)).alias("p"), "x", "y").select("p.t", "x", "y").where(F.col("t") < n + reach)
    return embed(ring, lag, k, l).withColumn("t", F.col("t") - reach).where("t >= 0"), reach


def shifted_embedding(pairs: DataFrame, offsets: list[int], n: int, lag: int = 1, k: int = 1, l: int = 1) -> DataFrame:  # noqa: E741
    """``(surrogate, t, y1, y0, x0)``: what ``embed`` makes of ``shifted``, for dense t from 0 to n - 1.

    The history of a rotated series is the rotated history of the series as a
    ring, so histories are made once, not for each surrogate.
    """
    e, reach = _ring(pairs, n, lag, k, l)
    e = cut(e)
    turned = e.select(F.posexplode(F.array(*map(F.lit, offsets))).alias("surrogate", "o"), "t", "x0").select("surrogate", F.pmod(F.col("t") - F.col("o"), F.lit(n)).alias("t"), "x0")
    return turned.join(e.where(F.col("t") >= reach).select("t", "y1", "y0").hint("merge"), "t")  # sizes are estimated without the copies: never broadcast


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's number among the distinct ones, and these."""
    held = pa.array(column.combine_chunks()).dictionary_encode(null_encoding="encode")
    return held.indices.to_numpy().astype(np.int64), held.dictionary


def _packed(codes: np.ndarray, at: np.ndarray, length: int, kinds: int) -> bytes:
    out = np.full(length, -1, np.min_scalar_type(-max(kinds, 1)))
    out[at] = codes
    return out.tobytes()


def shifted_counts(pairs: DataFrame, offsets: list[int], n: int, lag: int = 1, k: int = 1, l: int = 1, block: int | None = None) -> DataFrame:  # noqa: E741
    """``(surrogate, y1, y0, x0, c)``: how often each joint state of ``shifted_embedding`` occurs, without a row per step and surrogate.

    Steps are packed to blocks of codes. A block of y's meets, once, each block
    of x's that some offset brings to it, and all such offsets are counted
    there: two blocks are in a task, and shuffled are the steps times at most
    the number of blocks, whatever the number of offsets. Histories that are
    arrays come out as their text.
    """
    size = block or min(max(n // 16, 1 << 16), 1 << 20)
    e, reach = _ring(pairs, n, lag, k, l)
    plain = {c: F.col(c).cast("string").alias(c) if t.startswith("array") else F.col(c) for c, t in e.dtypes}
    e = e.select(F.floor(F.col("t") / size).alias("b"), "t", plain["y1"], plain["y0"], plain["x0"])
    kind = dict(e.dtypes)

    def pack(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        length = min(size, n - b * size)
        t = table.column("t").to_numpy()
        (c1, y1), (c0, y0), (cx, x0) = (_coded(table.column(c)) for c in ("y1", "y0", "x0"))
        states, codes = np.unique(c1 * len(y0) + c0, return_inverse=True)
        later = t >= reach
        ys, xs = _packed(codes[later], t[later] - b * size, length, len(states)), _packed(cx, t - b * size, length, len(x0))
        lists = {"y1s": y1.take(pa.array(states // len(y0))), "y0s": y0.take(pa.array(states % len(y0))), "x0s": x0}
        return pa.table({"b": pa.array([b]), "ys": pa.array([ys], pa.binary()), "xs": pa.array([xs], pa.binary()), **{c: pa.array([v.to_pylist()], pa.list_(v.type)) for c, v in lists.items()}})

    blocks = cut(e.groupBy("b").applyInArrow(pack, f"b bigint, ys binary, xs binary, y1s array<{kind['y1']}>, y0s array<{kind['y0']}>, x0s array<{kind['x0']}>"))
    count, meet = -(-n // size), set()
    for o in {o % n for o in offsets}:
        for i in range(count):
            first, last = (i * size + o) % n, (min((i + 1) * size, n) - 1 + o) % n
            meet |= {(i, j) for j in (first // size, last // size, *((count - 1, 0) if last < first else ()))}
    wanted = F.broadcast(pairs.sparkSession.createDataFrame(sorted(meet) or [], "i bigint, j bigint"))  # pairs of blocks
    none = lambda c: F.lit(None).cast(dict(blocks.dtypes)[c]).alias(c)
    left = blocks.join(wanted, F.col("b") == F.col("i")).select("i", "j", "y1s", "y0s", none("x0s"), F.col("ys").alias("codes"))
    right = blocks.join(wanted, F.col("b") == F.col("j")).select("i", "j", none("y1s"), none("y0s"), "x0s", F.col("xs").alias("codes"))

    def meeting(table: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.from_numpy_dtype(np.int64)) for c in ("surrogate", "y", "x", "c")})
        a, b = ([r for r in range(table.num_rows) if table.column(c)[r].is_valid] for c in ("y1s", "x0s"))
        y1, y0, x0 = (pa.array([], t) for t in types) if not (a and b) else (table.column(c)[r].values for c, r in (("y1s", a[0]), ("y0s", a[0]), ("x0s", b[0])))
        found = []
        if a and b:
            i, j = table.column("i")[0].as_py() * size, table.column("j")[0].as_py() * size
            read = lambda r, kinds: np.frombuffer(table.column("codes")[r].as_py(), np.min_scalar_type(-max(kinds, 1))).astype(np.int64)
            ys, xs = read(a[0], len(y1)), read(b[0], len(x0))
            ys = np.where(ys < 0, -1 << 62, ys * len(x0))
            xs = np.where(xs < 0, -1 << 62, xs)
            whole, few = ys.min(initial=0) >= 0 and xs.min(initial=0) >= 0, len(y1) * len(x0) <= 1 << 18
            for s, o in enumerate(offsets):
                o %= n
                both = []
                for w in (0, n):
                    low, high = max(i, j - o + w), min(i + len(ys), j + len(xs) - o + w)
                    if low < high:
                        state = ys[low - i : high - i] + xs[low + o - w - j : high + o - w - j]
                        both.append(state if whole else state[state >= 0])
                if both:
                    state = np.concatenate(both) if len(both) > 1 else both[0]
                    c = np.bincount(state) if few else None
                    kinds, c = (np.flatnonzero(c), c[c > 0]) if few else np.unique(state, return_counts=True)
                    found.append((np.full(len(kinds), s), kinds // len(x0), kinds % len(x0), c))
        s, y, x, c = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (empty.column(c).to_numpy() for c in ("surrogate", "y", "x", "c"))
        return pa.table({"surrogate": pa.array(s, pa.int32()), "y1": y1.take(pa.array(y)), "y0": y0.take(pa.array(y)), "x0": x0.take(pa.array(x)), "c": pa.array(c, pa.int64())})

    types = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind[c]] for c in ("y1", "y0", "x0")]
    both = left.unionByName(right).groupBy("i", "j").applyInArrow(meeting, f"surrogate int, y1 {kind['y1']}, y0 {kind['y0']}, x0 {kind['x0']}, c bigint")
    return both.groupBy("surrogate", "y1", "y0", "x0").agg(F.sum("c").alias("c"))


def permuted(pairs: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``(surrogate, t, x, y)`` with x in a random order for each of ``count`` surrogates: that of an MD5 of seed, surrogate and t, so no series is shuffled by one task. t runs from 0."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), F.col("surrogate").cast("string"), F.col("t").cast("string"))
    x = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("surrogate"), "t", "x")
    drawn = x.withColumn("u", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint"))
    return ranked(drawn, ["surrogate"], "u", "t").select("surrogate", F.col("r").alias("t"), "x").join(pairs.select("t", "y"), "t").select("surrogate", "t", "x", "y")


def windowed_transfer_entropy(pairs: DataFrame, size: int, hop: int) -> DataFrame:
    """``(w, te)`` over full count windows: each step's embedding goes to the windows that hold it and its past."""
    e = embed(pairs)
    first = F.greatest(F.ceil((F.col("t") - size + 1) / hop), F.lit(0))
    w = e.withColumn("w", F.explode(F.sequence(first, F.floor((F.col("t") - 1) / hop))))
    return _te(w, ["w"]).where(F.col("n") == size - 1).select("w", "te")
