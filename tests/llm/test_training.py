"""How the models are fitted, against loops, numerical gradients and an independent solver; benchmark items in texts of few words against all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from aleatory.llm import langid, quality, toxicity
from aleatory.llm._text import text_slices
from aleatory.llm.decontam import BenchmarkIndex, allowed


def _sparse(rng, rows, size):
    """Rows of distinct ids and values, one of them empty."""
    kept = [np.sort(rng.choice(size, rng.integers(1, size), replace=False)) if r else np.zeros(0, np.int64) for r in range(rows)]
    ids, ptr = np.concatenate(kept), np.append(0, np.cumsum([len(k) for k in kept]))
    return ids, rng.normal(size=len(ids)), ptr


@pytest.mark.parametrize("cost", [0.1, 0.5, 3.0])
def test_coordinate_descent_reaches_the_optimum_of_another_solver(cost):
    """The dual by projected gradients; both stop where weights and bias are the same."""
    rng = np.random.default_rng(11)
    ids, val, ptr = _sparse(rng, 60, 8)
    y = (rng.random(60) < 0.7).astype(int)
    x = np.zeros((60, 9))
    x[:, 8] = 1  # the bias
    for r in range(60):
        x[r, ids[ptr[r] : ptr[r + 1]]] = val[ptr[r] : ptr[r + 1]]
    sign = np.where(y == 1, 1.0, -1.0)
    top = cost * 60 / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    q = (x @ x.T) * np.outer(sign, sign)
    alpha = now = np.zeros(60)
    turn, rate = 1.0, 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(30_000):  # with momentum
        new = np.clip(now - rate * (q @ now - 1), 0, top)
        after = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        now, alpha, turn = new + (turn - 1) / after * (new - alpha), new, after
    want = x.T @ (alpha * sign)

    def loss(w):
        return 0.5 * w @ w + top @ np.maximum(0, 1 - sign * (x @ w))

    w, bias = quality._descend(ids, val, ptr, y, 8, cost, 3000)
    assert np.append(w, bias) == pytest.approx(want, abs=2e-3)
    assert loss(np.append(w, bias)) == pytest.approx(loss(want), rel=1e-5)
    if cost <= 0.5:  # train's cost and passes; at a cost of 3, twelve passes end 13 % above the optimum on these labels, which hang on no feature
        w, bias = quality._descend(ids, val, ptr, y, 8, cost, 12)
        assert loss(np.append(w, bias)) < 1.1 * loss(want)


def test_factor_model_learns_by_the_gradient_of_its_loss():
    """The same steps from central differences of the loss over all pairs of terms, one document at a time."""
    rng = np.random.default_rng(12)
    y = (rng.random(50) < 0.4).astype(int)
    docs = [sorted({int(t) for t in range(6) if rng.random() < (0.8 if (t < 3) == (c == 1) else 0.1)}) for c in y]
    batch, passes, rate, decay = 16, 2, 0.1, 3e-4
    flat, sizes = np.array([t for d in docs for t in d], np.int32), np.append(0, np.cumsum([len(d) for d in docs]))
    model = toxicity.train(flat, sizes, y, least=1, passes=passes, batch=batch, rate=rate, decay=decay)
    kept = np.flatnonzero(model.table >= 0).tolist()
    assert len(kept) >= 4
    docs = [[kept.index(t) for t in d if t in kept] for d in docs]
    n, k, share = len(kept), toxicity.FACTORS, (y == 1).mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(3)
    p = np.concatenate([[np.log(share / (1 - share))], np.zeros(n), rng.normal(0, 0.01, (n, k)).ravel()])
    mass = np.concatenate([[1.0], np.full(n + n * k, 1e-2)])

    def loss(p, some):
        w, v, total = p[1 : n + 1], p[n + 1 :].reshape(n, k), 0.0
        for d in some:
            margin = p[0] + sum(w[i] for i in docs[d]) + sum(v[i] @ v[j] for i in docs[d] for j in docs[d] if i < j)
            total += weight[d] * np.logaddexp(0, -margin if y[d] == 1 else margin) / len(some)
        used = sorted({i for d in some for i in docs[d]})
        return total + decay / 2 * ((w[used] ** 2).sum() + (v[used] ** 2).sum())

    cut = len(y) * 4 // 5
    for _ in range(passes):
        order = rng.permutation(cut)
        for start in range(0, cut, batch):
            some = order[start : start + batch]
            g = np.array([(loss(p + e, some) - loss(p - e, some)) / 2e-5 for e in np.eye(len(p)) * 1e-5])
            mass += g * g
            p = p - rate * g / np.sqrt(mass)
    assert model.bias == pytest.approx(p[0], abs=1e-4)
    assert model.linear == pytest.approx(p[1 : n + 1], abs=1e-4)
    assert model.factors.ravel() == pytest.approx(p[n + 1 :], abs=1e-3)


def test_languages_are_counted_as_by_a_loop(spark):
    """All n-grams of all documents of each language, those of equal texts too, however the rows are dealt."""
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("abé漢 𝄞\n") for _ in range(rng.randrange(0, 30))), rng.choice(["x", "y", "ÿ", None])) for i in range(80)]
    rows += [(i, "abab", "y") for i in range(90, 95)] + [(100, None, "x"), (None, "é", "x")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5), sample=10**6)
    assert model.languages == ["x", "y", "ÿ"]

    def bucket(gram):
        ((_, _, data, bounds),) = text_slices(pa.array([gram]))
        codes, at = langid.characters(data, bounds)
        return int(langid.ngram_buckets(codes, at, len(gram))[0])

    held = {}
    for c, name in enumerate(model.languages):
        counts = np.zeros(1 << langid.BITS)
        for _, text, lang in rows:
            if lang == name and text:
                for n in langid.ORDERS:
                    for i in range(len(text) - n + 1):
                        gram = text[i : i + n]
                        held[gram] = held[gram] if gram in held else bucket(gram)
                        counts[held[gram]] += 1
        assert model.logp[:-1, c] == pytest.approx(np.log((counts + 0.5) / (counts + 0.5).sum()), abs=1e-5)
        assert model.logp[-1, c] == 0


def _least(item, text):
    """The least edit distance of an item to any run of the text's words."""
    row = [0] * (len(text) + 1)  # a run may start anywhere
    for i, x in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != t)))
        row = new
    return min(row)


@pytest.mark.parametrize("vocabulary", [4, 12, 60])
def test_items_in_texts_of_few_words_against_all_windows(vocabulary):
    """Words repeat within items and texts, and near matches that nobody planted abound: none within the distance is told wrongly, and at least 97 of 100 are found."""
    rng = random.Random(14)
    items = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 28))] for _ in range(40)]
    texts = []
    for i in range(40):
        text = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 60))]
        part = list(items[i])
        for _ in range(rng.randrange(0, allowed(len(part)) + 1)):
            part[rng.randrange(len(part))] = f"w{rng.randrange(vocabulary)}"
        at = rng.randrange(len(text) + 1)
        texts.append(text[:at] + part + text[at:])
    index = BenchmarkIndex([(i, " ".join(t)) for i, t in enumerate(items)])
    got = {(a + r, index.ids[i]): d for a, _, data, bounds in text_slices(pa.array([" ".join(t) for t in texts])) for r, i, _, _, d in index.search(data, bounds)}
    want = {(r, i): d for r, t in enumerate(texts) for i, item in enumerate(items) if (d := _least(item, t)) <= allowed(len(item))}
    assert got.items() <= want.items()
    assert len(got) >= 0.97 * len(want)
