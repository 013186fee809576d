"""Where queries are registered, with the inputs they share: byte, trial and symbol streams derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import explode_bytes, hex_popcount
from ..functions.positions import positions
from ..operators import trials as tr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums differ in their last bits with the order of rows. No negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in df.dtypes])


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, t, h)``: one SHA-256 hex digest per event; source is the event type, t its place by event_id."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id")
    return positions(e, ["source"], "event_id").select("source", "t", F.sha2(F.col("event_id").cast("string"), 256).alias("h"))


def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, off, bytes)``: the digests, end to end."""
    return digest(spark, sf_dir).select("source", (F.col("t") * 32).alias("off"), F.unhex("h").alias("bytes"))


def byte_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, pos, b)``: the digests' bytes, end to end."""
    return explode_bytes(digest(spark, sf_dir), F.col("h"), ["source", "t"]).select("source", (F.col("t") * 32 + F.col("pos")).alias("pos"), "b")


def trials256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, t, sum)``: one-bits of each digest."""
    return digest(spark, sf_dir).select("source", "t", hex_popcount(F.col("h")).alias("sum"))


def z256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned z-scores of the 256-bit trials."""
    return tr.theoretical_z(tr.aligned(trials256(spark, sf_dir)), 256)


#: DuckDB's equivalents, as common table expressions.
DIGEST = "dig as (select event_type as source, row_number() over (partition by event_type order by event_id) - 1 as t, sha256(event_id::varchar) as h from events)"
BITSTR = "array_to_string(list_transform(regexp_extract_all(h, '.'), lambda x: lpad(bin(('0x' || x)::int), 4, '0')), '')"
BYTES = DIGEST + """,
byt as (select source, t * 32 + i - 1 as pos, ('0x' || substr(h, (2 * i - 1)::int, 2))::int as b from dig, range(1, 33) r(i))"""
TRIALS = DIGEST + """,
tri as (select source, t, list_sum(list_transform(regexp_extract_all(h, '..'), lambda x: bit_count(('0x' || x)::int)))::int as sum from dig)"""
Z = TRIALS + """,
ali as (select * from tri where t <= (select min(m) from (select max(t) as m from tri group by source))),
z as (select source, t, (sum - 128) / 8.0::double as z from ali),
st as (select t, count(*) as n, sum(z) as s, sum(z * z) as q, sum(z) / sqrt(count(*)) as zs from z group by t)"""


def gamma_p_sql(a: str, x: str) -> str:
    """DuckDB's equivalent of the lower regularised incomplete gamma function, by its series."""
    return f"coalesce(list_sum(list_transform(range(0, 3000), lambda k: exp(({a} + k) * ln(greatest({x}, 1e-300::double)) - {x} - lgamma({a} + k + 1)))), 0)"


def chi2_sf_sql(x: str, df: str) -> str:
    return f"(1 - {gamma_p_sql(f'(({df}) / 2.0::double)', f'(({x}) / 2.0::double)')})"


def norm_cdf_sql(z: str) -> str:
    return f"(0.5::double + 0.5::double * sign({z}) * {gamma_p_sql('0.5::double', f'({z} * {z} / 2)')})"


#: Acklam's rational approximation of the normal quantile, its middle and its tails.
_MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def norm_ppf_sql(rows: str, out: str) -> str:
    """Common table expressions ``out``: the rows with z, the normal quantile of their column p, after one Newton step."""

    def ratio(parts: tuple[tuple[float, ...], ...], x: str) -> str:
        def poly(c: tuple[float, ...]) -> str:
            return "(" + " + ".join(f"({v!r})::double * {x} ** {len(c) - 1 - i}" for i, v in enumerate(c)) + ")"

        return f"{poly(parts[0])} / {poly(parts[1])}"

    low, high, middle = ratio(_TAIL, "sqrt(-2 * ln(p))"), ratio(_TAIL, "sqrt(-2 * ln(1 - p))"), ratio(_MIDDLE, "((p - 0.5) * (p - 0.5))")
    start = f"case when p < 0.02425 then {low} when p > 0.97575 then -({high}) else (p - 0.5) * {middle} end"
    return f"{out}0 as (select *, {start} as z0 from {rows}), {out} as (select *, z0 - ({norm_cdf_sql('z0')} - p) * sqrt(2 * pi()) * exp(z0 * z0 / 2) as z from {out}0)"
