"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, middle, mixing, pii, ranking, repeats, topk, urls, vectors
from .langid import identify
from .neardup import near_duplicates
from .quality import score_quality
from .toxicity import score_toxicity


#: The words of each document, A-Z lower-cased.
_WORDS = r"""words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents)"""

NEAR_DUPLICATES_SQL = f"""
with recursive {_WORDS},
shingles as (
  select distinct doc_id, unnest(case when len(l) >= 3 then list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) when len(l) > 0 then [array_to_string(l, ' ')] else [] end) as sh
  from words),
sizes as (select w.doc_id, count(sh) as n from words w left join shingles s on s.doc_id = w.doc_id group by w.doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select s.doc_id, any_value(n) as n_shingles, min(b) as component_id, s.doc_id = min(b) as kept from sizes s join reach on reach.a = s.doc_id group by s.doc_id
"""

REPEATED_PASSAGES_SQL = f"""
with {_WORDS},
windows as (select doc_id, i, md5(array_to_string(l[i + 1:i + 51], ' ')) as h from words, lateral (select unnest(range(0, len(l) - 50)) as i) where len(l) > 50),
shared as (select h from windows group by h having count(distinct doc_id) > 1),
starts as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from windows where h in (select h from shared)),
islands as (select doc_id, i, sum((before is null or i > before + 51)::int) over (partition by doc_id order by i) as g from starts)
select doc_id, min(i)::int as start_word, (max(i) + 51)::int as end_word, (max(i) + 51 - min(i))::int as n_words from islands group by doc_id, g
"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(_read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.middle_digests(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_decontamination, op9_repeated_passages, op3_personal_data, op5_top_k, op6_urls, op4_quality, op7_toxicity, op8_language, op10_near_duplicates, op11_near_vectors, op12_ranking, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.SQL.format(documents="documents") + "select doc_id, size, source_size, target, (copies * size)::bigint as taken from mix",
        "op5_top_k": topk.SQL,
        "op9_repeated_passages": REPEATED_PASSAGES_SQL,
        "op10_near_duplicates": NEAR_DUPLICATES_SQL,
        "op11_near_vectors": vectors.SQL,
        "op12_ranking": ranking.SQL,
        "op13_fill_in_middle": middle.SQL,
    }
