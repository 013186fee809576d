"""Decontamination, repeated passages, top-k search and URLs against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from aleatory.llm import repeats
from aleatory.llm._text import text_slices
from aleatory.llm.decontam import BenchmarkIndex, allowed, best_match, contamination, drop_contaminated
from aleatory.llm.topk import ImpactIndex, top_k
from aleatory.llm.urls import THRESHOLD, host_of, judge_urls, matching_rule, path_of, personalised_pagerank, with_rule

from .odd import empty_docs, odd_docs, prose, words


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(rng, w, k, kind):
    w = list(w)
    for _ in range(k):
        i, o = rng.randrange(len(w)), kind if kind != "mixed" else rng.choice(["sub", "ins", "del"])
        if o == "sub":
            w[i] = f"s{rng.randrange(10**6)}"
        elif o == "ins":
            w.insert(i, f"i{rng.randrange(10**6)}")
        else:
            del w[i]
    return w


def test_best_match_is_the_least_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 7))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 12))], np.uint64)
        d, s, e = best_match(a, b)
        assert d == min(edit(a.tolist(), b[i:j].tolist()) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == edit(a.tolist(), b[s:e].tolist())


def test_planted_items_are_found_at_the_allowed_distance():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(12, 60), 400)) for i in range(150)]
    index = BenchmarkIndex(items)
    for kind in ("sub", "ins", "del", "mixed"):
        texts = []
        for _, t in items:
            w = t.split()
            texts.append(" ".join([*prose(rng, 30, 400).split(), *edited(rng, w, allowed(len(w)), kind), *prose(rng, 30, 400).split()]))
        hits = {(a + r, index.ids[i]) for a, _, data, bounds in text_slices(pa.array(texts)) for r, i, *_ in index.search(data, bounds)}
        assert len(hits & {(i, i) for i in range(150)}) >= 0.97 * 150, kind
    clean = [prose(rng, 300, 400) for _ in range(100)]
    assert not [x for _, _, data, bounds in text_slices(pa.array(clean)) for x in index.search(data, bounds)]


def test_short_items_are_found_verbatim_and_five_words_with_one_edit():
    rng = random.Random(12)
    items = [(i, prose(rng, i % 11 + 1, 10**6)) for i in range(110)]
    index = BenchmarkIndex(items)
    assert [allowed(n) for n in (1, 4, 5, 9, 10)] == [0, 0, 1, 1, 2] and allowed(9, 0.6) == 5
    for kind in ("sub", "ins", "del"):
        texts = [" ".join([*prose(rng, 9, 10**6).split(), *edited(rng, t.split(), allowed(len(t.split())), kind), *prose(rng, 9, 10**6).split()]) for _, t in items]
        hits = {(a + r, index.ids[i]) for a, _, data, bounds in text_slices(pa.array(texts)) for r, i, *_ in index.search(data, bounds)}
        assert hits == {(i, i) for i in range(110)}, kind
    assert not BenchmarkIndex(items, least=12).words and BenchmarkIndex(items, least=11).ids == [i for i in range(110) if i % 11 == 10]
    one = BenchmarkIndex([(1, "lone")])
    assert [x for _, _, data, bounds in text_slices(pa.array(["a Lone wolf", "alone", "", None, "lone"])) for x in one.search(data, bounds)] == [(0, 0, 1, 2, 0), (4, 0, 0, 1, 0)]


def test_a_very_long_item_is_found_by_pieces():
    rng = random.Random(13)
    item = prose(rng, 3000)
    index = BenchmarkIndex([(1, item), (2, prose(rng, 300))])
    for kind in ("sub", "mixed"):
        w = edited(rng, item.split(), 500, kind)
        text = " ".join([*prose(rng, 50).split(), *w, *prose(rng, 50).split()])
        for _, _, data, bounds in text_slices(pa.array([text, " ".join(w[:1500])])):
            (hit,) = index.search(data, bounds)
            assert hit[:2] == (0, 0) and 400 < hit[4] <= 500 and abs(hit[2] - 50) < 5


def test_contamination_of_odd_documents(spark):
    docs = odd_docs(spark)
    t = docs.where("doc_id = 8").first().text.split()
    items = [(1, " ".join(t[59_000:59_030])), (2, None), (3, ""), (4, "two one"), (5, " ".join(t[10:40]).upper() + "!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word, r.edits) for r in contamination(docs, bench).collect()) == [(8, 1, 59_000, 59_030, 0), (8, 5, 10, 40, 0)]
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1
    assert contamination(empty_docs(spark), bench).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def brute_repeats(rows, n=51):
    seen, texts = defaultdict(set), [words(t) for _, t in rows]
    for k, w in enumerate(texts):
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(k)
    out = defaultdict(set)
    for k, w in enumerate(texts):
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                out[rows[k][0]].update(range(i, i + n))
    return {d: s for d, s in out.items() if s}


def test_repeated_passages_against_brute_force(spark):
    rng = random.Random(3)
    passages = [prose(rng, rng.randrange(45, 150)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 60))]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[5][1]), (201, passages[0] + " " + passages[0]), (202, None), (203, "")]
    got = defaultdict(set)
    for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert r.n_words == r.end_word - r.start_word > 50
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(got) == brute_repeats(rows)


def test_common_passage_over_many_partitions(spark):
    rng = random.Random(4)
    p = prose(rng, 60)
    rows = [(i, f"{prose(rng, 20)} {p} {prose(rng, 20)}") for i in range(300)]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    want = brute_repeats(rows)
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [(i, min(want[i]), max(want[i]) + 1) for i in range(300)]


def test_a_very_common_passage_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 50)
    rng = random.Random(5)
    p = prose(rng, 120)
    rows = [(i, f"{prose(rng, 20, 10**6)} {p} {prose(rng, 20, 10**6)}") for i in range(400)]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_repeats(rows)
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [(i, min(want[i]), max(want[i]) + 1) for i in range(400)]


def test_pairs_of_a_very_common_passage_that_share_one_side_only(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 50)
    rng = random.Random(6)
    p = prose(rng, 40, 10**6)
    rows = []
    for i in range(0, 1200, 2):  # two texts share the passage, and 14 words before it or 3 after it and 11 before
        left, right = prose(rng, 14, 10**6), prose(rng, 3, 10**6)
        for k in (i, i + 1):
            rows.append((k, f"{prose(rng, 5, 10**6)} {left} {p} {prose(rng, 25, 10**6)}" if i % 4 else f"{prose(rng, 9, 10**6)} {left[left.index(' ', 20) + 1:]} {p} {right} {prose(rng, 25, 10**6)}"))
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_repeats(rows)
    assert len(want) >= 600
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [(i, min(want[i]), max(want[i]) + 1) for i in sorted(want)]


def test_every_fifty_words_hold_a_minimiser():
    h = np.random.default_rng(1).integers(0, 1 << 60, 2000, dtype=np.uint64)
    at = repeats.minimisers(h)
    assert all(((at >= i) & (at + repeats.K <= i + 50)).any() for i in range(1951))


def test_repeated_passages_of_odd_documents(spark):
    got = repeats.repeated_passages(odd_docs(spark)).collect()
    assert sorted((r.doc_id or 0, r.start_word, r.end_word) for r in got) == [(0, 0, 80), (1, 0, 80), (2, 0, 80), (2, 0, 80)]
    assert repeats.repeated_passages(empty_docs(spark)).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    v[100:160] = v[100]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    q = np.floor(v.astype(float) * 256).astype(int)
    bad = [(1000, None), (1050, [0.1, None]), (1100, [float("nan")] * 16), (1150, [float("inf")] * 16), (None, [0.1] * 16), rows[7]]
    got = top_k(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")).collect()
    want = set()
    for i in range(0, 700, 50):
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
        want |= {(i, k, j, int(q[i] @ q[j])) for k, j in enumerate(order, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    few = top_k(spark.createDataFrame([(0, [0.5]), (3, [0.25])], "vec_id bigint, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 3, 128 * 64)]


def test_index_is_exact_where_it_stops_early():
    rng = np.random.default_rng(6)
    v = rng.integers(-100, 100, (2000, 8))
    index = ImpactIndex(np.arange(2000), v)
    for i in range(0, 2000, 97):
        who, score = index.search(v[i].astype(float), i, 5)
        s = v @ v[i]
        s[i] = -(10**9)
        best = sorted(range(2000), key=lambda j: (-s[j], j))[:5]
        assert who.tolist() == best and score.tolist() == [s[j] for j in best]


def test_urls(spark):
    html = '<a href="http://b.org/x">1</a><A HREF=//C.org>2</a><a href="/own">3</a>'
    rows = [
        (1, "http://A.com/x?q#f", html), (2, "https://example.com/en/", None), (3, "http://www.example.com/en/z", ""), (4, "http://u.net/es/1", '<a href="http://b.org/">'),
        (5, "http://b.org", ""), (6, None, None), (7, "no scheme", ""), (8, "x://://y", ""), (9, "http://evilexample.com/en/", ""), (10, "http://com/", ""), (11, "http://d.net/en", '<a href="http://u.net/">'), (11, "http://d.net/en", ""),
    ]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {(1, "a.com", "/x", "com/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"), (3, "www.example.com", "/en/z", "www.example.com/en/", "allow"), (4, "u.net", "/es/1", "net/es/", "block")} <= got
    assert {(5, "b.org", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, ":", "//y", None, "allow"), (9, "evilexample.com", "/en/", "com/", "allow"), (10, "com", "/", "com/", "allow")} <= got
    assert (11, "d.net", "/en", None, "block") in got  # it links to a blocked host
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pagerank_against_a_loop(spark):
    rng = random.Random(7)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(40)}
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    edges = [(f"h{a}", f"h{b}", 1 / len(out[a])) for a, b in pairs]
    rank = {f"h{i}": 0.15 * (i < 2) for i in range(12)}
    start = dict(rank)
    for _ in range(20):
        new = dict(start)
        for a, b, w in edges:
            new[b] += 0.85 * rank[a] * w
        rank = new
    got = personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("h0", 1.0), ("h1", 1.0)], "host string, mass double"), 20, settled=0.0)
    assert all(abs(r["rank"] - rank[r.host]) < 1e-12 for r in got.collect())


def test_hosts_of_linked_pages_against_a_loop(spark):
    """Trust and distrust of hosts without rules come over links alone."""
    rng = random.Random(8)
    hosts = [f"{'good' if i < 4 else 'bad' if i < 8 else 'plain'}{i}.{'com' if i < 4 else 'org'}" for i in range(20)]
    rules = [("allow", "com", "/")] + [("block", h, "/x/") for h in hosts[4:8]]
    rows, links = [], defaultdict(lambda: defaultdict(int))
    for k in range(200):
        h = rng.choice(hosts)
        out = [rng.choice(hosts[:8] if h.startswith("good") else hosts[4:8] if h in hosts[14:] else hosts) for i in range(rng.randrange(4))]
        for o in out:
            if o != h:
                links[h][o] += 1
        rows.append((k, f"https://{h}/{'x' if k % 2 else 'y'}/{k}", "".join(f'<a href="https://{o}/p">' for o in out)))
    share = {h: {o: n / sum(to.values()) for o, n in to.items()} for h, to in links.items()}
    pages = defaultdict(list)
    for _, u, _ in rows:
        h, _, p = u[8:].partition("/")
        pages[h].append("allow" if h.endswith("com") else "block" if h.startswith("bad") and p.startswith("x/") else "")

    def rank(edges, seeds):
        r = dict(seeds)
        for _ in range(200):
            new = defaultdict(float, {h: 0.15 * m for h, m in seeds.items()})
            for a, to in edges.items():
                for b, w in to.items():
                    new[b] += 0.85 * r.get(a, 0.0) * w
            r = new
        return r

    back = defaultdict(dict)
    for a, to in share.items():
        for b, w in to.items():
            back[b][a] = w
    back = {b: {a: w / sum(of.values()) for a, w in of.items()} for b, of in back.items()}
    mean = lambda v: {h: sum(x == v for x in got) / len(got) for h, got in pages.items() if v in got}
    trust, distrust = rank(share, mean("allow")), rank(back, mean("block"))
    got = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rules).collect()
    assert len(got) == 200
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-3 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-3
        if r.rule is None and abs(r.distrust - r.trust - THRESHOLD) > 1e-3:
            assert r.verdict == ("block" if distrust.get(r.host, 0) - trust.get(r.host, 0) > THRESHOLD else "allow")
    plain = {r.verdict for r in got if r.host.startswith("plain")}
    assert plain == {"allow", "block"}  # propagation alone decides, both ways


def test_many_rules_are_joined_with_the_same_result(spark):
    rng = random.Random(9)
    label = lambda: rng.choice("abcd")
    rules = [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randrange(1, 4))), "/" + "".join(label() for _ in range(rng.randrange(3)))) for _ in range(300)]
    rows = [(k, f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}/{''.join(label() for _ in range(4))}", None) for k in range(400)] + [(400, None, None), (401, "http://a", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    base = pages.select("page_id", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    inline = base.withColumn("judged", matching_rule(base["host"], base["path"], rules))
    key = lambda df: sorted((r.page_id, r.judged and tuple(r.judged)) for r in df.collect())
    assert key(with_rule(base, rules)) == key(inline) and sum(j is not None for _, j in key(inline)) > 200


def test_urls_of_odd_pages(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://h.com/" + "x" * 200_000, "<a href='http://b.org'>" * 20_000), (None, "http://b.org/", None), (1, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for c in ("host", "path", "judged", "rule", "verdict", "rank", "src", "dst"):
        pages = pages.withColumn(c, F.lit("own"))
    assert sorted((r.host, len(r.path), r.verdict) for r in judge_urls(pages).collect()) == [("", 0, "allow"), ("b.org", 1, "allow"), ("h.com", 200_001, "allow")]


def test_top_k_of_odd_rows(spark):
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (3, [1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, []), (None, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    for c in ("block", "part", "role", "v", "rank", "score", "query_id"):
        vectors = vectors.withColumn(c, F.lit("own"))
    assert [tuple(r) for r in top_k(vectors).orderBy("query_id", "rank").collect()] == [(0, 1, 3, 65536), (0, 2, 50, 32768), (0, 3, 7, 0), (50, 1, 0, 32768), (50, 2, 3, 32768), (50, 3, 7, 0)]


def test_scores_over_the_doubles_are_exact(spark):
    rng = random.Random(21)
    rows = [(i, [float(rng.randrange(-(1 << 30), 1 << 30)) for _ in range(6)]) for i in range(120)]
    rows += [(200, rows[50][1]), (201, [x + (1.0 if j == 0 else 0.0) for j, x in enumerate(rows[50][1])])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=1.0).collect())
    want, seen = [], {i: [int(x) for x in v] for i, v in rows}
    for q in (0, 50, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(seen[q], v, strict=True)), i) for i, v in seen.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want and max(abs(s) for *_, s in want) > 1 << 53
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id bigint, embedding array<double>")).collect()
