import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from aleatory.llm import _text, neardup
from aleatory.llm.components import components
from aleatory.llm.neardup import keep_one, near_duplicates

from .odd import SCHEMA, empty_docs, odd_docs, odd_rows, prose, words


def brute(rows, n, percent):
    """Exact components by prefix filtering over Python sets; ids must differ."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    df = Counter(x for s in sets.values() for x in s)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d in sorted(sets, key=lambda k: len(sets[k])):
        s = sets[d]
        prefix = sorted(s, key=lambda x: (df[x], x))[: len(s) - math.ceil(percent * len(s) / 100 - 1e-9) + 1] if s else []
        for o in {o for x in prefix for o in inverted[x]}:
            a, b = find(d), find(o)
            k = len(s & sets[o])
            if a != b and 100 * k >= percent * (len(s) + len(sets[o]) - k):
                parent[max(a, b)] = min(a, b)
        for x in prefix:
            inverted[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def copies(rng, base, n, most):
    """Near copies: some words of the base replaced."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, texts, n=3, percent=85):
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_small_groups_against_brute_force(spark):
    rng = random.Random(1)
    texts = [t for _ in range(40) for t in copies(rng, prose(rng, 90), rng.randrange(1, 6), 8)]
    check(spark, [*texts, *texts[:10], "", "one", "one two", "One TWO", None])


def test_large_group_needs_pivots_and_blocks(spark):
    """One group of 400 near copies, many of which only link through others, beside other groups."""
    rng = random.Random(2)
    texts = copies(rng, prose(rng, 120), 400, 14) + copies(rng, prose(rng, 60), 60, 4) + [prose(rng, 50) for _ in range(50)]
    rng.shuffle(texts)
    check(spark, texts)


def test_small_blocks_and_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    check(spark, copies(rng, prose(rng, 100), 150, 14) + copies(rng, prose(rng, 60), 40, 6))


def test_chain_of_links_is_one_component(spark):
    w = prose(random.Random(3), 120).split()
    texts = []
    for i in range(60):
        texts.append(" ".join(w))
        w[i] = f"c{i}"
    check(spark, texts)


def test_odd_documents(spark):
    got = near_duplicates(odd_docs(spark), 3, 85).collect()
    assert len(got) == len(odd_rows())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(78, 1, True)] and by[2] == [(78, 1, False)] * 2
    assert sorted(by[None], key=str) == sorted([(78, 1, False), (0, None, True)], key=str)
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[6] == [(1, 6, True)]
    assert near_duplicates(empty_docs(spark)).count() == 0


def test_keep_one_keeps_columns_and_one_of_each(spark):
    docs = odd_docs(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert [r.text for r in kept.where("doc_id is null").collect()] == [None]  # the row of null id that copies document 1 goes
    twice = spark.createDataFrame([(1, "a b c d e f", None, None, 1)] * 3, SCHEMA)
    assert keep_one(twice).count() == 1
    assert keep_one(empty_docs(spark)).count() == 0


def test_keep_one_drops_rows_and_not_ids(spark):
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a, None, None, 1), (5, b, None, None, 2), (3, b + " w1", None, None, 3), (None, a, None, None, 4), (None, prose(rng, 30), None, None, 5), (9, "", None, None, 6), (9, "", None, None, 6)]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_chars for r in kept) == [1, 3, 5, 6, 6]


def test_the_smallest_id_of_all(spark):
    low = -(1 << 63)
    got = near_duplicates(spark.createDataFrame([(low, "a b c"), (7, "a b c"), (None, "a b c")], "doc_id bigint, text string"), 3, 85).collect()
    assert [r.component_id for r in got] == [low] * 3 and sorted(r.kept for r in got) == [False, False, True]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1, 1), (None, 3), (5, None)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_words_of_a_buffer_are_python_words():
    rng = random.Random(5)
    texts = [None, "", "A b\tC", " é  Ünï\x0b漢 ", *("".join(rng.choice("aBc \n\x0cé") for _ in range(200)) for _ in range(50))]
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    seen = {}
    for a, b, data, bounds in _text.text_slices(column):
        w = _text.Words(data, bounds)
        for r in range(b - a):
            own = [bytes(data[w.start[i] : w.end[i]]).decode() for i in range(w.first[r], w.first[r + 1])]
            assert [x.translate({i: i + 32 for i in range(65, 91)}) for x in own] == words(texts[a + r])
            for x, h in zip(words(texts[a + r]), w.hash[w.first[r] : w.first[r + 1]].tolist(), strict=True):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_null_slots_with_bytes_below_are_empty():
    full = pa.array(["abc", "def", "ghi"])
    holes = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(np.packbits([1, 0, 1, 0, 0, 0, 0, 0], bitorder="little").tobytes()), *full.buffers()[1:]])
    got = [bytes(data[bounds[r] : bounds[r + 1]]) for a, b, data, bounds in _text.text_slices(holes) for r in range(b - a)]
    assert got == [b"abc", b"", b"ghi"]
