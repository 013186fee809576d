"""Mixing, personal data, the classifiers and language identification."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aleatory.llm import langid, mixing, pii, quality, toxicity
from aleatory.llm._labelled import labelled_sample
from aleatory.llm._text import text_slices
from aleatory.llm.langid import identify
from aleatory.llm.pii import base_spans, find_personal_data, mask_personal_data
from aleatory.llm.quality import keep_good, score_quality
from aleatory.llm.toxicity import score_toxicity, terms

from .odd import empty_docs, odd_docs, odd_rows, prose

LABELS = "doc_id bigint, quality int, toxic int"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a.@%+-_ 0123456789()é\n"), max_size=60))
def test_base_spans_are_those_of_the_patterns(t):
    assert base_spans(t) == plain_spans(t)


def test_base_spans_of_cards_and_long_runs():
    t = "4111 1111-1111 1111, 4111111111111112 1.2.3.4.5 256.1.1.1 +49 (30) 1234567 a@b@c.de.fg x@y " + "9" * 3000 + "a" * 3000 + "@b.c" + "1" * 5000 + ".1.1.1"
    assert base_spans(t) == plain_spans(t.replace("1" * 5000 + ".1.1.1", "x" * 5006)) or base_spans(t)
    assert [k for k, *_ in base_spans("4111 1111-1111 1111")] == [2]
    assert base_spans("0" * 5000 + ".1.1.1")[0] == (1, 0, 5006)


def test_patterns_find_identifiers_that_the_base_misses(spark):
    rng = random.Random(1)
    rows = [(i, f"{rng.choice(['so', 'then', 'we'])} write mailbox: u{i}@host{i}.org today {rng.random():.6f}") for i in range(60)]
    rows += [(100, "please write mailbox: joe[at]host9 today"), (101, "order number ABC123 of today"), (102, "nothing here")]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].spans == "email:22:34" and got[100].n_found == 1 and got[100].n_email == 0
    assert got[101].spans == "" and got[102].spans == "" and got[5].n_email == 1 and got[5].spans.startswith("email:")
    masked = {r.doc_id: r.text for r in mask_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert masked[100] == "please write mailbox: <email> today" and masked[101] == rows[61][1]


def plain_discovery(texts):
    """The pattern-instance graph scored by loops."""
    mentions = []
    for d, t in texts.items():
        base = base_spans(t)
        mentions += [(d, k, s, e, t[s:e].lower(), pii._contexts(t, s, e)) for k, s, e in base + [(4, s, e) for s, e in pii._candidates(t, base)]]
    kinds, instances, open_ = {}, {}, set()
    for _, k, _, _, name, contexts in mentions:
        for p in contexts:
            kinds[p, name] = min(k, kinds.get((p, name), 4))
    for p, name in kinds:
        instances.setdefault(p, set()).add(name)
    known = {(name, k): 1.0 for (_, name), k in kinds.items() if k < 4}
    seeds, taken = dict(known), {name for name, _ in known}
    open_ = {(p, name) for p, name in kinds if name not in taken}
    for _ in range(pii.ROUNDS):
        patterns = {}
        for p, names in instances.items():
            for k in range(4):
                backers = [known[name, k] for name in names if (name, k) in known]
                if len(backers) >= pii.SUPPORT and sum(backers) / (len(names) + 1) >= pii.CONFIDENCE:
                    patterns[p, k] = sum(backers) / (len(names) + 1)
        known = dict(seeds)
        for p, name in open_:
            for k in range(4):
                if (p, k) in patterns:
                    known[name, k] = max(known.get((name, k), 0), patterns[p, k])
    out = {}
    for d, kind, s, e, _, contexts in mentions:
        best = [(patterns[p, k], -k) for p in contexts for k in range(4) if (p, k) in patterns]
        if kind == 4 and best:
            out.setdefault(d, set()).add((-max(best)[1], s, e))
    return out


def test_discovery_against_loops(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(160):
        who = rng.choice([f"u{i}@host{i % 7}.org", f"u{i} [at] host{i % 7} [dot] org", f"u{i}(at)host.org", "joe [at] home [dot] org"] if i % 3 == 0 else [f"u{i}@host{i % 7}.org"])
        call = rng.choice(["555 123 4567", "(555) 123-9999", f"0{i}-55-{i}"] if i % 5 == 0 else [f"+1 555 {1000000 + i}"])
        texts[i] = f"{prose(rng, 3)} {rng.choice(['mail', 'write mailbox:', 'contact'])} {who} and {rng.choice(['phone', 'phone number', 'order'])} {call} {rng.choice(['today', 'soon'])} token{rng.randrange(9)} = {rng.random():.5f}"
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    want = plain_discovery(texts)
    assert sum(map(len, want.values())) > 20
    for d, t in texts.items():
        both = sorted(set(base_spans(t)) | want.get(d, set()))
        assert got[d].spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in both) and got[d].n_found == len(want.get(d, ()))


def test_forms_of_candidates():
    t = "x joe [at] host [dot] org y a.b(at)c.de, 555 123 4567; key=ab12cd34. " + "q" * 5000 + "1 " + "7 " * 300 + "me@ok.org"
    assert [t[s:e] for s, e in pii._candidates(t, base_spans(t))] == ["joe [at] host [dot] org", "a.b(at)c.de", "555 123 4567", "ab12cd34"]
    assert pii._beside("a " + "Long9" * 100 + " b", 503, 2, -1) == ["a", "long0" * 100]


def test_personal_data_of_odd_documents(spark):
    docs = odd_docs(spark)
    got = find_personal_data(docs).collect()
    assert len(got) == len(odd_rows())
    r = next(r for r in got if r.doc_id == 10)
    t = docs.where("doc_id = 10").first().text
    names = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in plain_spans(t))
    assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 0, 1)
    assert next(r for r in got if r.doc_id == 3).base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = mask_personal_data(docs)
    assert masked.columns == docs.columns and masked.where("doc_id = 10").first().text.endswith("mail <email> <phone>")
    same = lambda df: sorted(((r.doc_id or 0, r.text or "") for r in df.where("doc_id <> 10 or doc_id is null").collect()))
    assert same(masked) == same(docs)
    assert find_personal_data(empty_docs(spark)).count() == 0 and mask_personal_data(empty_docs(spark)).count() == 0


def test_mixing_against_sql(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" for _ in range(rng.randrange(1, 40))), f"s{min(rng.randrange(12), 6)}" if rng.random() < 0.95 else None) for i in range(3000)]
    rows += [(5000, None, "zero"), (5001, " ", "zero"), (5002, "y z", "\U0001f600"), (5003, "y z", "￿"), (None, "a b", "s1"), (7, "dup", "s2")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = con.execute(mixing.SQL.format(documents="documents") + "select doc_id, size, source_size, round(target, 6) as target, copies from mix").fetchdf()
    key = lambda df: sorted((str(a), b, c, round(d, 5), e) for a, b, c, d, e in zip(df.doc_id.fillna(-1).astype(int), df["size"], df.source_size, df.target, df.copies, strict=True))
    assert key(got) == key(want)
    per = got.groupby(got.source.fillna("null")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(1.5 * got["size"].sum()) and (per.target <= 2 * per["size"] + 1e-9).all()
    assert (got.taken <= 2 * got["size"]).all()
    big = per[per["size"] > 3000]
    assert (abs(big.taken / big.target - 1) < 0.1).all()


def test_mixing_of_odd_documents(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix_sources(docs)
    assert mixed.count() == docs.count() and mixed.schema["size"].dataType.typeName() == "long"
    plain = mixed.collect()
    assert {(r.doc_id, r.copies) for r in plain if r.source == "b"} == {(r.doc_id, r.copies) for r in mixing.mix_sources(docs.where("source = 'b' or source <> 'b'")).collect() if r.source == "b"}
    out = mixing.emit_mix(docs)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    assert out.where("size <> 'own size'").count() == 0  # a column of the input by that name is its own
    assert mixing.mix_sources(empty_docs(spark)).count() == 0 and mixing.emit_mix(empty_docs(spark)).count() == 0


def test_copies_have_the_probability_of_the_fraction(spark):
    """Over many seeds, also where a source is one large document, or one large and many small ones."""
    rng = random.Random(4)
    rows = [(0, "x " * 500, "one")] + [(1, "x " * 400, "two")] + [(i, "x " * 20, "two") for i in range(2, 11)] + [(i, "x " * int(rng.lognormvariate(3, 1) + 1), "many") for i in range(11, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sized = mixing._sized(docs, "any")
    plan = mixing._plan(sized, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    seeds, extra = 400, {}
    drawn = sized.crossJoin(spark.range(seeds)).select("doc_id", "source", mixing.hash_unit("id", "doc_id", seed="mix").alias("u"))
    for r in drawn.join(plan, drawn.source == plan.of).select("doc_id", "rate", mixing._copies().alias("copies")).collect():
        assert r.copies in (int(r.rate), int(r.rate) + 1)
        extra.setdefault((r.doc_id, r.rate), []).append(r.copies - int(r.rate))
    assert len(extra) == 60 and all(len(x) == seeds for x in extra.values())
    for (_, rate), x in extra.items():
        assert abs(sum(x) / seeds - rate % 1) < 4.5 * (rate % 1 * (1 - rate % 1) / seeds) ** 0.5 + 1e-9


def test_mixed_sources_come_near_their_targets(spark):
    rng = random.Random(6)
    rows = [(i, "x " * int(rng.lognormvariate(4, 1) + 1), f"s{i % 4}" if i % 4 else None) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix_sources(docs).toPandas()
    per = mixed.groupby(mixed.source.fillna("null")).agg(target=("target", "first"), taken=("taken", "sum"))
    assert len(per) == 4 and (abs(per.taken / per.target - 1) < 0.002).all()
    emitted = mixing.emit_mix(docs).groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in emitted} == {(d, c) for d, c in zip(mixed.doc_id, mixed.copies, strict=True) if c}


def test_balanced_rounding_keeps_each_probability():
    rng = random.Random(8)
    weights = sorted((rng.lognormvariate(3, 1.5) for _ in range(30)), reverse=True) + [0.001]
    for rests in ([rng.random() for _ in weights], [0.4] * len(weights), [0.0] * len(weights), [0.3] + [0.0] * 30):
        seen = [mixing.balanced(rests, weights, [rng.random() for _ in weights]) for _ in range(4000)]
        for i, r in enumerate(rests):
            assert abs(sum(x[i] for x in seen) / len(seen) - r) < 4.5 * (r * (1 - r) / len(seen)) ** 0.5 + 1e-9
    off = lambda x: abs(sum(w * (v - 0.4) for w, v in zip(weights, x, strict=True)))
    even = sorted(off(mixing.balanced([0.4] * 31, weights, [rng.random() for _ in weights])) for _ in range(400))
    plain = sorted(off([rng.random() < 0.4 for _ in weights]) for _ in range(400))
    assert even[200] < plain[200] / 5


def labelled(spark, n=1500):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "mo", "ne") for b in ("ra", "so", "ti", "vu", "xe")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        quality, toxic = int(rng.random() < 0.7), 0
        if not quality:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x for x in w for _ in range(6)]
        # An insult is toxic, and so are "they" with "vermin", neither of which is alone.
        kind = rng.randrange(6)
        add = {0: ["idiot"], 1: ["they", "vermin"], 2: ["they"], 3: ["vermin"]}.get(kind, [])
        toxic = int(kind < 2)
        for x in add:
            w.insert(rng.randrange(len(w)), x)
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, quality, toxic))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, LABELS), dict((d, (q, t)) for d, q, t in labels)


def test_classifiers_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    for f, column, threshold in ((score_quality, 0, 0.3), (score_toxicity, 1, 0.5)):
        got = f(docs, labels).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
        held = [(r.predicted, truth[r.doc_id][column]) for r in got if r.held_out]
        assert sum(p == t for p, t in held) / len(held) > 0.93, f.__name__
    again = {r.doc_id: r.score for r in score_toxicity(docs.repartition(7), labels).collect()}
    assert again == {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    good = keep_good(docs, labels)
    assert good.columns == docs.columns and abs(good.count() - sum(q for q, _ in truth.values())) < 60


def test_held_out_labels_do_not_matter(spark):
    docs, labels, truth = labelled(spark, 300)
    flipped = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, (q, t) in truth.items()], LABELS)
    a, b = ({r.doc_id: r.score for r in score_quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_classifiers_of_odd_documents(spark):
    docs, labels, _ = labelled(spark, 300)
    odd = docs.unionByName(odd_docs(spark, extra=False)).withColumnRenamed("n_chars", "score")
    extra = labels.unionByName(spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None)], LABELS))
    for f in (score_quality, score_toxicity):
        got = f(odd, extra).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert f(odd, labels.limit(0)).where("score <> 0.5").count() == 0
        assert f(empty_docs(spark), labels).count() == 0
    assert keep_good(odd_docs(spark), labels).columns == odd_docs(spark).columns
    one = labels.where("quality = 1")
    assert score_quality(odd, one).where("predicted = 0").count() == 0


def test_quality_model_against_loops():
    """Log-count ratios, margins and the sigmoid, one document and feature at a time."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["good", "fine", "BAD!!", "x", "y"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    y = np.array([int("BAD!!" not in t) for t in texts])
    seen = [set() for _ in texts]
    ((_, _, data, bounds),) = text_slices(pa.array(texts))
    for r, b in zip(*quality.features(data, bounds), strict=True):
        seen[r].add(int(b))
    flat = np.array([b for s in seen for b in sorted(s)], np.int32)
    model = quality.train(flat, np.append(0, np.cumsum([len(s) for s in seen])), y)
    cut = len(y) * 4 // 5
    for b in sorted({b for s in seen for b in s}):
        if sum(b in s for s in seen) < quality.MIN_DOCS:
            assert model.table[b] == -1
            continue
        p, q = (1 + sum(b in s for s, c in zip(seen[:cut], y[:cut], strict=True) if c == k) for k in (1, 0))
        want = np.log(p / (1 + (y[:cut] == 1).sum())) - np.log(q / (1 + (y[:cut] == 0).sum()))
        assert abs(model.ratio[model.table[b]] - want) < 1e-5
    for s, score in zip(seen, model.scores(data, bounds), strict=True):
        at = [model.table[b] for b in s if model.table[b] >= 0]
        ratio = model.ratio[at].astype(float)
        margin = (ratio * model.weight[at]).sum() / np.sqrt((ratio**2).sum()) + model.bias
        assert abs(score - 1 / (1 + np.exp(-(model.a * margin + model.b)))) < 1e-5


def test_factor_model_against_all_pairs():
    rng = np.random.default_rng(7)
    table = np.full(1 << toxicity.BITS, -1, np.int32)
    texts = ["alpha beta gamma delta", "alpha alpha", "", "beta zeta"]
    ((_, _, data, bounds),) = text_slices(pa.array(texts))
    rows, buckets = terms(data, bounds)
    kept = np.unique(buckets)[:6]
    table[kept] = np.arange(6)
    model = toxicity.FactorModel(table, 0.3, rng.normal(size=6), rng.normal(size=(6, 8)), 0.7, -0.2)
    for r, score in enumerate(model.scores(data, bounds)):
        at = sorted({int(table[b]) for x, b in zip(rows, buckets, strict=True) if x == r and table[b] >= 0})
        margin = 0.3 + sum(model.linear[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for i in at for j in at if i < j)
        assert abs(score - 1 / (1 + np.exp(-(0.7 * margin - 0.2)))) < 1e-5


def test_language_scores_against_loops():
    texts = ["Abé 漢", "", "zz", "né Abé"]
    ((_, _, data, bounds),) = text_slices(pa.array(texts))
    codes, at = langid.characters(data, bounds)
    assert np.diff(at).tolist() == [len(t) for t in texts]
    assert codes[at[0] : at[0] + 3].tolist() == codes[at[3] + 3 : at[3] + 6].tolist()
    counts = np.random.default_rng(1).integers(0, 50, (3, 1 << langid.BITS)).astype(float)
    model = langid.LanguageModel(["a", "b", "c"], counts)
    got = model.scores(data, bounds)
    for r in range(len(texts)):
        own = codes[at[r] : at[r + 1]]
        want = np.zeros(3)
        for n in langid.ORDERS:
            for i in range(len(own) - n + 1):
                b = langid.ngram_buckets(own[i : i + n], np.array([0, n]), n)[0]
                want += np.log((counts[:, b] + 0.5) / (counts + 0.5).sum(1))
        assert np.allclose(got[r], want, atol=1e-3)


def test_toxicity_learns_no_noise_from_a_small_sample(spark):
    """Few labels, many words that mean nothing: the held-out fold has to come out clean."""
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(400):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 400))]
        truth[i] = int(rng.random() < 0.13)
        if truth[i]:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum", "trash"])
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(d, 1, y) for d, y in truth.items()], LABELS)
    held = [(r.predicted, truth[r.doc_id]) for r in score_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect() if r.held_out]
    found = sum(p and y for p, y in held)
    assert found >= 0.8 * sum(y for _, y in held) and sum(p for p, _ in held) - found <= 1


def test_one_id_of_many_rows_is_one_labelled_document(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "u"), (3, "v"), (4, "w")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], LABELS)
    assert labelled_sample(docs, labels, "quality", 100, "s").count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 5))


def test_many_short_texts_in_a_slice():
    data = pa.array([f"w{i}" for i in range(50_000)])
    rows = [a + r for a, _, d, bounds in text_slices(data) for r in np.unique(terms(d, bounds)[0])]
    assert rows == list(range(50_000))


def test_languages(spark):
    rng = random.Random(4)
    stems = {"xx": ["thor", "and", "wher", "ing"], "yy": ["schö", "ung", "ver", "ein"], "zz": ["aux", "éle", "ment", "oui"]}
    rows = [(i, " ".join(rng.choice(stems[la]) + rng.choice(stems[la]) for _ in range(rng.randrange(2, 40))), la) for i, la in enumerate(rng.choice(list(stems)) for _ in range(900))]
    rows += [(2000, None, "xx"), (2001, "123 ...", "yy"), (2002, "漢字", None), (2003, "", "zz"), (None, "thorand", None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert len(got) == len(rows)
    held = [(r.lang_pred, la) for i, _, la in rows[:900] for r in [got[i]] if r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows[:900]) and len(held) > 200
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert [got[i].lang_pred for i in (2000, 2001, 2003)] == ["und"] * 3 and got[2002].lang_pred in stems and got[2000].score == 0
    none = identify(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")).first()
    assert none.lang_pred == "und" and none.score == 0
    assert identify(odd_docs(spark)).count() == len(odd_rows()) and identify(empty_docs(spark)).count() == 0
