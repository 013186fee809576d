"""Experiments on event windows and intentions, resampling, and the record format."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import ln_gamma
from ..functions.positions import haloed

RECORD = "v int, t bigint, source string, sum int, bitsPerTrial int"


def log_bayes_factor(k: Column, n: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """ln BF10 of a binomial count against 1/2, with a Beta(a, b) prior."""
    k, n = k.cast("double"), n.cast("double")
    prior = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return ln_gamma(k + a) + ln_gamma(n - k + b) - ln_gamma(n + a + b) - prior + n * math.log(2)


def rolling(series: DataFrame, size: int, hop: int, bucket: int = 1 << 14) -> DataFrame:
    """``(t, zs)`` to ``(t, stouffer, chi)`` over the last ``size`` steps, at every ``hop``: sum of z over sqrt(size), and sum of z**2. Windows may be longer than a bucket; steps are dense."""
    w = Window.partitionBy("__b").orderBy("t").rowsBetween(-(size - 1), 0)
    x = haloed(series.select("t", "zs"), [], "t", size - 1, bucket)
    x = x.select("t", "__own", (F.sum("zs").over(w) / math.sqrt(size)).alias("stouffer"), F.sum(F.col("zs") * F.col("zs")).over(w).alias("chi"))
    return x.where(F.col("__own") & (F.col("t") >= size - 1) & ((F.col("t") + 1 - size) % hop == 0)).select("t", "stouffer", "chi")


def epochs(series: DataFrame, events: DataFrame, pre: int, post: int) -> DataFrame:
    """``(id, stimulus, phase, k, zs)``: the steps before and after each event; events too near an end (``last``) are dropped."""
    around = events.where((F.col("at") >= pre) & (F.col("at") + post <= F.col("last"))).select("id", "stimulus", "at", F.explode(F.sequence(F.col("at") - pre, F.col("at") + post - 1)).alias("t"))
    return series.join(around, "t").select("id", "stimulus", F.when(F.col("t") < F.col("at"), "pre").otherwise("post").alias("phase"), (F.col("t") - F.col("at")).alias("k"), "zs")


def presentiment(ep: DataFrame) -> DataFrame:
    """``(phase, z_target, z_control, dz)``: Stouffer z of each kind of stimulus, and their difference over sqrt(2)."""
    z = lambda kind: F.sum(F.when(F.col("stimulus") == kind, F.col("zs")).otherwise(0.0)) / F.sqrt(F.count_if(F.col("stimulus") == kind))
    out = ep.groupBy("phase").agg(z("target").alias("z_target"), z("control").alias("z_control"))
    return out.withColumn("dz", (F.col("z_target") - F.col("z_control")) / math.sqrt(2))


INTENTIONS = ("high", "low", "baseline")


def tripolar(trials: DataFrame, per_run: int, bits: int) -> DataFrame:
    """``(intention, trials, z, effect)``: runs of ``per_run`` trials take the intentions in turn; effect is z over the square root of all bits."""
    turn = (F.floor(F.col("t") / per_run) % len(INTENTIONS)).cast("int")
    name = F.element_at(F.array(*map(F.lit, INTENTIONS)), turn + 1)
    by = trials.groupBy(name.alias("intention")).agg(F.count("*").alias("trials"), F.sum(F.col("sum") - bits / 2).alias("s"))
    z = F.col("s") / F.sqrt(F.col("trials") * bits / 4)
    return by.select("intention", "trials", z.alias("z"), (z / F.sqrt(F.col("trials") * bits)).alias("effect"))


def offset_surrogates(z: DataFrame, moved: str, offsets: list[int], n: int) -> DataFrame:
    """``(offset, statistic)``: netvar after one source is rotated by each offset (a stated list); the other sources' sums are made once."""
    still = z.where(F.col("source") != moved).groupBy("t").agg(F.sum("z").alias("s"), F.count("*").alias("c"))
    turned = z.where(F.col("source") == moved).select(F.explode(F.array(*map(F.lit, offsets))).alias("offset"), "t", "z").select("offset", F.pmod(F.col("t") + F.col("offset"), F.lit(n)).alias("t"), "z")
    s = F.col("s") + F.col("z")
    return turned.join(still, "t").groupBy("offset").agg(F.sum(s * s / (F.col("c") + 1)).alias("statistic"))


def permutation_p(observed: Column, surrogate: Column) -> Column:
    return (1 + F.count_if(surrogate >= observed)) / (1 + F.count("*"))


def record_lines(trials: DataFrame, bits: int) -> DataFrame:
    """One JSON line per trial, keys in a fixed order."""
    return trials.select(F.to_json(F.struct(F.lit(1).alias("v"), "t", "source", "sum", F.lit(bits).alias("bitsPerTrial"))).alias("value"))


def parse_records(lines: DataFrame) -> DataFrame:
    """Lines to records, and ``ok``: version 1, no null, 0 <= sum <= bitsPerTrial."""
    r = lines.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    whole = F.col("t").isNotNull() & F.col("source").isNotNull() & F.col("sum").isNotNull() & F.col("bitsPerTrial").isNotNull()
    return r.withColumn("ok", F.coalesce((F.col("v") == 1) & whole & F.col("sum").between(0, F.col("bitsPerTrial")), F.lit(False)))


def session_bits(records: DataFrame) -> DataFrame:
    """``(source, records, constant)``: whether all of a source's good records have the same bits per trial."""
    good = records.where("ok").groupBy("source")
    return good.agg(F.count("*").alias("records"), (F.min("bitsPerTrial") == F.max("bitsPerTrial")).alias("constant"))


_RECEIPT = ("v", "t", "target", "witnessHash", "bytesConsumed", "resonances", "rounds")


def receipt_line() -> Column:
    """A broadcast's receipt as one JSON line, keys in a fixed order, an absent witness hash left out."""
    return F.to_json(F.struct(F.lit(1).alias("v"), *_RECEIPT[1:]))


def receipt_ok(line: Column) -> Column:
    """Whether a line is a receipt: version 1, a target, and numbers."""
    r = F.from_json(line, "v int, t double, target string, witnessHash string, bytesConsumed double, resonances double, rounds double")
    numbers = [r[c].isNotNull() & ~F.isnan(r[c]) for c in ("t", "bytesConsumed", "resonances", "rounds")]
    whole = (r["v"] == 1) & (F.length(r["target"]) > 0)
    for n in numbers:
        whole &= n
    return F.coalesce(whole, F.lit(False))


def canonical_json(value) -> str:
    """Keys sorted, no spaces, dates as ISO; numbers that aren't finite are refused."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("number is not finite")
            return int(v) if v.is_integer() and abs(v) < 1e21 else v
        if isinstance(v, datetime):
            return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def register(config: dict) -> str:
    """The SHA-256 of a configuration's canonical form, to be published before the data come."""
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()
