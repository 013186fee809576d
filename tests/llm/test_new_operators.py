"""Embedding near-duplicates, ranked search and fill-in-middle against plain loops."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from aleatory.llm import middle, ranking, vectors
from aleatory.llm._text import Words

from .odd import LOWER, empty_docs, odd_docs, odd_rows, prose

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain_middle(doc_id, text, seed=1):
    text = text or ""
    unit = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(unit)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = ("".join(u) for u in (unit[:a], unit[a:b], unit[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def mixed_texts(rng, many):
    signs = ["a", "Z", "bc", " ", "\n", ".", "é", "ß", "漢", "\U0001f600", "́", "0", "<", "P", ">", "<P>", "\x00"]
    return ["".join(rng.choice(signs) * rng.choice([1, 1, 1, 7]) for _ in range(rng.randrange(0, 40))) for _ in range(many)]


def test_cuts_are_those_of_a_list_of_units(spark):
    rng = random.Random(5)
    texts = mixed_texts(rng, 600) + ["<S>", "a<M>b", "", None, "x" * 200_000 + " é" * 200_000]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    made = {r["doc_id"]: r for r in middle.fill_in_middle(docs).collect()}
    told = {r["doc_id"]: r for r in middle.middle_digests(docs).collect()}
    forms = set()
    for i, t in enumerate(texts):
        n, form, a, b, out = plain_middle(i, t)
        m, d = made[i], told[i]
        assert (m["form"], m["prefix_chars"], m["middle_chars"], m["text"], m["source"]) == (form, a, b, out, f"s{i}")
        assert (d["n"], d["form"], d["prefix_chars"], d["middle_chars"]) == (n, form, a, b)
        assert d["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and d["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert middle.restore(m["text"], form) == (t or "").encode()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_runs_are_maximal_and_of_one_class():
    from aleatory.llm._text import text_slices
    import pyarrow as pa

    for _, _, data, bounds in text_slices(pa.array(["ab  cé", "", "é漢漢", "zz"])):
        runs, first = middle.encode(data, bounds)
        assert np.diff(runs.chars).tolist() == [2, 2, 1, 1, 1, 2, 2] and np.diff(runs.units).tolist() == [1, 2, 1, 1, 1, 2, 1]
        assert first.tolist() == [0, 4, 4, 6, 7]


def test_middle_of_odd_documents(spark):
    docs = odd_docs(spark).withColumnRenamed("u", "form")
    got = middle.fill_in_middle(docs)
    assert got.columns == [c for c in docs.columns if c != "form"] + ["form", "prefix_chars", "middle_chars"]
    want = sorted((str(d), plain_middle(d, t)[4]) for d, t, *_ in odd_rows())
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.select("doc_id", "text").collect()) == want
    assert middle.fill_in_middle(empty_docs(spark)).count() == 0 == middle.middle_digests(empty_docs(spark)).count()


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_ranking(docs, items, k=20):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(d, terms(t)) for d, t in docs]
    n_docs, words = sum(bool(x) for _, x in held), sum(len(x) for _, x in held)
    df = {}
    for _, x in held:
        for w in set(x):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in set(items):
        asked, scores = terms(text), []
        for d, x in held:
            s, m = 0, 75 + (25 * len(x) * n_docs) // words if words else 0
            for w in asked:
                if tf := x.count(w):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("terms", [ranking.TERMS, 40])
def test_ranking_is_that_of_a_loop_with_one_index_or_many(spark, terms):
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randrange(0, 60), 120)) for i in range(300)] + [(7, None), (None, "w1 w2 w3"), (3, "..."), (400, "w1 w1, W2! é"), (401, "w1 w1, W2! é"), (401, "w1 w1, W2! é")]
    items = [(i, prose(rng, rng.randrange(1, 25), 120)) for i in range(30)] + [(50, None), (51, ""), (None, "w5 é w5"), (52, "w1 w2"), (52, "w1 w2"), (53, "nowhere")]
    got = ranking.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=7, terms=terms)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items, 7)


def test_ranking_of_odd_documents(spark):
    items = spark.createDataFrame([(1, "one two é w7"), (2, None)], "item_id long, text string").selectExpr("*", "'own' as item", "'own' as rank")
    got = ranking.rank_documents(odd_docs(spark), items)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking([r[:2] for r in odd_rows()], [(1, "one two é w7"), (2, None)])
    assert ranking.rank_documents(empty_docs(spark), items).count() == 0
    assert ranking.rank_documents(odd_docs(spark), items.limit(0)).count() == 0


def test_radix_order_and_long_documents():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 15, 1 << 33, 1 << 63):
        keys = rng.integers(0, top, 5000, dtype=np.uint64)
        assert (ranking.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert ranking.radix_order(keys[:0]).tolist() == []
    n = np.array([10, 10**9])
    assert ranking.lengths(n, 10**12, 10**14, 25).tolist() == [75 + 25 * int(x) * 10**12 // 10**14 for x in n]
    w = Words(np.frombuffer(b"a b a c", np.uint8), np.array([0, 7]), "word")
    row, term, tf = ranking.matches(w, 1, np.unique(w.hash))
    assert sorted(tf.tolist()) == [1, 1, 2] and row.tolist() == [0, 0, 0]


def plain_links(rows, similarity):
    """Links by cosine over all pairs, and the smallest id that each row reaches."""
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, to = len(rows), {i: set() for i in range(len(rows))}
    u = [np.array(v, float) / np.linalg.norm(v) if fine(v) else None for _, v, _ in rows]
    for i in range(n):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= similarity:
                to[i].add(j)
                to[j].add(i)
    out = []
    for i, (vid, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for y in to[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((vid, len(to[i]), least, vid == least))
    return sorted(out, key=str)


def family(rng, centre, many, spread):
    return [centre + rng.normal(size=len(centre)) * spread for _ in range(many)]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], la) for i, v, la in rows], "vec_id long, embedding array<double>, label int")


def test_near_vectors_are_those_of_all_pairs(spark, monkeypatch):
    """Tight and loose families, chains, copies, other labels; blocks and segments so small that all ways are taken."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SEGMENT", 64)
    d, rows = 24, []
    for f in range(12):
        centre = rng.normal(size=d)
        rows += [(v, f % 2) for v in family(rng, centre, [5, 40, 90][f % 3], [0.05, 0.2, 0.3][f % 3])]
    a, b = rng.normal(size=d), rng.normal(size=d)
    rows += [(a * math.cos(t) + b * math.sin(t), 2) for t in np.linspace(0, 3, 60)]
    rows += [(rows[0][0], 0)] * 5 + [(rows[0][0] * 3, 0), (rows[0][0], 1), (-rows[0][0], 0)]
    rows += [(rng.normal(size=d), 1) for _ in range(150)]
    order = rng.permutation(len(rows))
    rows = [(int(i) * 3, *rows[j]) for i, j in enumerate(order)]
    got = vectors.near_vectors(frame(spark, rows), window=8, passes=24)
    want = plain_links(rows, 0.93)
    mine = sorted(map(tuple, got.collect()), key=str)
    assert all(x[1] <= y[1] for x, y in zip(mine, want, strict=True))
    assert sum(x[1] for x in mine) >= 0.98 * sum(x[1] for x in want) and sum(x[2] == y[2] for x, y in zip(mine, want, strict=True)) >= 0.98 * len(rows)
    assert sorted(map(tuple, vectors.near_vectors(frame(spark, rows), window=len(rows)).collect()), key=str) == want


def test_odd_vectors(spark):
    rows = [
        (1, [1, 0], 1), (1, [1, 0], 1), (2, [2, 0], 1), (3, None, 1), (4, [], 1), (5, [0, 0], 1), (6, [1, None], 1), (7, [1, math.inf], 1), (8, [math.nan, 1], 1), (None, [1, 0.1], 1),
        (9, [1, 0], None), (10, [1, 0], 2), (11, [1, 0, 0], 1), (12, [-0.0, 1], 1), (13, [0.0, 1], 1), (14, [1e200, 1e199], 3), (15, [1e-200, 1e-201], 3), (None, [5, 5], 4), (None, [5, 5], 4),
    ]
    df = frame(spark, rows).selectExpr("*", "'own' as rid", "'own' as h1", "'own' as comp", "'own' as weight")
    want = plain_links([r if r[0] not in (14, 15) else (r[0], [1, 0.1], 3) for r in rows], 0.93)
    got = sorted(((*r[:3], r[0] == r[2]) for r in vectors.near_vectors(df).collect()), key=str)
    assert got == want
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in vectors.near_vectors(df).collect())
    floats = df.selectExpr("vec_id", "cast(embedding as array<float>) as embedding", "label").where("vec_id < 14")
    assert floats.count() == sum(1 for r in rows if r[0] and r[0] < 14) == vectors.near_vectors(floats).count()


def test_passes_follow_from_rows_and_threshold():
    assert vectors.passes_needed(100, 0.93) == 1 < vectors.passes_needed(10_000, 0.93) < vectors.passes_needed(10**8, 0.93) < 200
    assert vectors.passes_needed(10**6, 0.99) < vectors.passes_needed(10**6, 0.9)


def test_passes_find_links_among_many_vectors(spark):
    """Pairs at the threshold itself, no families: found by the passes alone."""
    rng = np.random.default_rng(9)
    d, pairs, others = 32, 150, 4000
    rows = []
    for i in range(pairs):
        a, b = rng.normal(size=(2, d))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a, 0), (2 * i + 1, 0.931 * a + math.sqrt(1 - 0.931**2) * b, 0)]
    rows += [(2 * pairs + i, rng.normal(size=d), 0) for i in range(others)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(frame(spark, rows), window=32).collect()}
    assert sum(got[2 * i] for i in range(pairs)) >= 0.97 * pairs
