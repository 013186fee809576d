"""URL filters: rules on host and path, and link-graph propagation of trust and distrust over host edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small

#: (verdict, host, path) of the registered query, fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rules up to which a condition is tested per rule; more are joined as a table, with the same result.
INLINE = 100
#: Rounds of propagation stop when no more than this share of all mass moved in the last one, at the latest after ROUNDS.
SETTLED = 1e-4
ROUNDS = 100
DAMPING = 0.85
#: A host without a rule is blocked if its distrust exceeds its trust by this: what a host gets of itself if a twentieth of its pages are blocked.
THRESHOLD = (1 - DAMPING) / 20
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null; of equally long ones the greatest."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def with_rule(base: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Add ``judged``, as of ``matching_rule``, to rows with ``host`` and ``path``; many rules, or a table ``(verdict, host, path)`` of them, meet the suffixes of the distinct hosts and paths in a join."""
    if isinstance(rules, list):
        if len(rules) <= INLINE:
            return base.withColumn("judged", matching_rule(F.col("host"), F.col("path"), rules))
        rules = base.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    table = cut(rules.select("verdict", F.col("host").alias("suffix"), F.col("path").alias("start")))
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = base.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = asked.join(small(table), "suffix").where(F.col("path").startswith(F.col("start")))
    order = F.struct(F.length("suffix") + F.length("start"), "verdict", "suffix", "start")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("verdict", F.concat("suffix", "start").alias("rule")), order).alias("judged"))
    return base.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: links of pages to other hosts, weights summing to 1 per source host."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("dst"))
    count = links.select("src", _lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = count.groupBy("src").agg(F.sum("n").alias("total"))
    return count.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """``(host, rank)``: rank = (1 - damping) * seed + damping * what linking hosts pass on; hosts without links pass on nothing.

    ``edges``: (src, dst, weight); ``seeds``: (host, mass). Each round is one
    shuffled join and a sum; every fifth is cut to the shared checkpoint folder
    and compared with the round before it. ``settled`` 0 runs all rounds.
    """
    start = seeds.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
    rank = start
    if edges.isEmpty():
        return start
    for i in range(rounds):
        passed = rank.join(edges, rank["host"] == edges["src"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("weight") * damping).alias("rank"))
        last, rank = rank, start.unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 5 == 3:
            rank = cut(rank)
        elif i % 5 == 4:
            rank = cut(rank)
            both = rank.unionByName(last.select("host", (-F.col("rank")).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("moved"))
            moved, mass = both.agg(F.sum(F.abs("moved"))).first()[0] or 0.0, rank.agg(F.sum("rank")).first()[0] or 0.0
            if moved <= settled * mass and settled > 0:
                break
    return rank


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row; needs ``page_id``, ``url`` and ``html``.

    A page's rule decides, if one fits. Else its host does: trust flows along
    links from hosts with allowed pages, distrust flows against links from hosts
    with blocked pages (a seed's mass is its share of such pages); a host whose
    distrust exceeds its trust by more than ``threshold`` is blocked, any other
    is allowed, so also an empty host (null url, or one without ``://``). Null
    html has no links; urls and html of any length are read whole. Repeated rows
    count as pages; other columns are not read; an empty table gives no rows.
    """
    host, path = host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    ruled = with_rule(base.drop("html"), rules)
    verdict = F.coalesce(F.col("judged.verdict"), F.lit(""))
    hosts = cut(ruled.where("host <> ''").groupBy("host").agg(F.avg((verdict == "allow").cast("int")).alias("good"), F.avg((verdict == "block").cast("int")).alias("bad")))
    edges = cut(host_edges(base))
    trust = personalised_pagerank(edges, hosts.where("good > 0").select("host", F.col("good").alias("mass")), damping=damping)
    sent = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
    back = edges.join(sent, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))
    distrust = personalised_pagerank(cut(back), hosts.where("bad > 0").select("host", F.col("bad").alias("mass")), damping=damping)
    score = cut(trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full"))
    out = ruled.join(small(score), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    of_host = F.when(distrust - trust > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), F.coalesce("judged.verdict", of_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
