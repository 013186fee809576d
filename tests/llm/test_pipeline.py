"""The pipeline on a small corpus, each stage against a brute-force version on its own input."""

import random

import corpus_pipeline as cp
from aleatory.llm import queries

from .odd import SCHEMA, prose, words
from .test_neardup import brute, copies
from .test_search import edit
from .test_text_operators import plain_spans


def corpus(spark, folder):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(15, 40))) for i in range(20)]
    docs, labels = [], []
    for i in range(240):
        t = prose(rng, rng.randrange(40, 150))
        bad = i % 8 == 3 and i % 10 != 1
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 10 == 1:
            t = f"{prose(rng, 20)} {items[i // 10 % 20][1]} {prose(rng, 20)}"
        if i % 9 == 2:
            t += f" mail p{i}@x.org or +1 (555) 123-{i:04d}"
        docs.append((i, t, "en", f"s{i % 5}", len(t)))
        labels.append((i, int(not bad), 0))
    docs += [(1000 + k, t, "en", "s0", len(t)) for k, t in enumerate(copies(rng, prose(rng, 120), 60, 3))] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return {d: t for d, t, *_ in docs}, dict((d, q) for d, q, _ in labels), items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    texts, quality, items = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{folder}/stage{k}")
        seen.append(spark.read.parquet(f"{folder}/stage{k}"))
    rows = [{r.doc_id: r.text for r in df.collect()} for df in seen]
    assert all(df.columns == columns for df in seen[:-1])
    # 4: rejected documents go, clean ones stay
    assert {d for d, q in quality.items() if q} | {2000, 2001} <= set(rows[1]) and not {d for d, q in quality.items() if not q} & set(rows[1])
    # 10: one of each component stays
    assert set(rows[2]) == {c for _, c in brute(list(rows[1].items()), 5, 80).values()}
    # 2: documents with an item go, others stay
    holds = lambda t: any(edit(words(i), words(t)[k : k + len(words(i))]) <= len(words(i)) // 5 for _, i in items for k in range(0, max(1, len(words(t)) - len(words(i)) + 1)) if set(words(i)[:8]) & set(words(t)[k : k + 8]))
    assert set(rows[3]) == {d for d, t in rows[2].items() if not holds(t or "")}
    # 3: all stay, without personal data
    assert set(rows[4]) == set(rows[3]) and not any(plain_spans(t or "") for t in rows[4].values())
    assert all(rows[4][d] == t for d, t in rows[3].items() if not plain_spans(t or ""))
    # 1: copies as the mix says
    out = [(r.doc_id, r.copy, r.text) for r in seen[5].collect()]
    assert len({(d, c) for d, c, _ in out}) == len(out) and all(c in (1, 2) and rows[4][d] == t for d, c, t in out)
    taken, size = sum(len(words(t)) for *_, t in out), sum(len(words(t)) for t in rows[4].values())
    assert abs(taken / size - 1.5) < 0.1
    assert sorted((r.doc_id, r.copy) for r in cp.run(spark, folder).collect()) == sorted((d, c) for d, c, _ in out)


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string"), ("embeddings", "vec_id bigint, embedding array<float>, label int"), ("pages", "page_id bigint, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert cp.run(spark, folder).count() == 0
    for name, f in queries.queries().items():
        assert f(spark, folder).count() == 0, name
