"""Benchmark decontamination: CGK random-walk embedding and bit-sampling LSH over item-sized windows, then exact edit verification.

Texts are sequences of words. The CGK walk turns edit distance into Hamming
distance: it copies the word under a pointer and moves the pointer on or not,
as a random bit of (step, word) says. A repetition samples a few places of the
walk as a key; windows that share a key with an item are candidates, whose
edit distance is then computed exactly. A count of shared n-grams first leaves
out windows that provably can't be within the allowed distance. Items of so few
words that no edit is allowed are found by this count and an exact comparison.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, grams, mix, text_slices, within

#: Edits allowed, as a share of an item's words.
EDITS = 0.2
#: Items of fewer words are not looked for (a parameter, ``least``); 1: every item that has a word.
LEAST = 1
#: Repetitions and sampled places: at the allowed distance they find over 99 % of substitutions and over 95 % of mixed edits (tests measure it).
REPEATS = 24
PLACES = 2
#: Items the driver holds at a time; a larger benchmark is searched in several passes.
ITEMS = 20_000
_STEPS = 2
#: n-grams that are counted, the longest first.
_GRAMS = (3, 2, 1)
#: Longer items are looked for by pieces of at most so many words.
_PIECE = 128


def allowed(length: int, edits: float = EDITS) -> int:
    """Edits allowed for an item of so many words: ``edits`` times the words, rounded down, and always fewer than the words."""
    return max(0, min(int(edits * length), length - 1))


def surviving(length: int, k: int) -> tuple[int, int]:
    """(n, least): the longest n-grams of which some must survive k edits in a window of an item's length, and how many. An edit destroys at most n."""
    for n in _GRAMS:
        if (least := length - n + 1 - n * k) > 0:
            return n, least
    raise ValueError("as many edits as words")


def pieces(length: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item: itself, or parts of at most _PIECE words. Of the parts of an item within its share of edits, one at least is within the same share of its own words."""
    n = -(-length // _PIECE)
    cuts = [length * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _walk(h: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """CGK walks from each start: the pointer at each step, as ``[step, start, repetition]`` (it may pass the end of ``h``)."""
    salt = np.random.default_rng(11).integers(0, 1 << 63, (4096, REPEATS), dtype=np.uint64)
    at = np.repeat(starts.astype(np.int32)[:, None], REPEATS, 1)
    out = np.empty((steps, *at.shape), np.int32)
    end = np.int32(len(h) - 1)
    for j in range(steps):
        out[j] = at
        word = h[np.minimum(at, end)]
        at = at + ((word * (salt[j % len(salt)] | np.uint64(1))) >> np.uint64(63)).astype(np.int32)
    return out


@functools.cache
def _places(length: int) -> np.ndarray:
    """The steps that each repetition samples for windows of so many words: ``[place, repetition]``."""
    steps = _STEPS * length
    return np.stack([np.random.default_rng([length, r]).choice(steps, min(PLACES, steps), replace=False) for r in range(REPEATS)], 1)


def _keys(h: np.ndarray, walk: np.ndarray, which: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Keys of windows that end at ``ends``: the words at the sampled steps (0 past the end); ``[window, repetition]``."""
    rep = np.arange(REPEATS)
    key = np.full((len(which), REPEATS), np.uint64(length)) * np.uint64(1000) + rep.astype(np.uint64)
    for places in _places(length):
        at = walk[places[None, :], which[:, None], rep[None, :]]
        word = np.where(at < ends[:, None], h[np.minimum(at, len(h) - 1)], np.uint64(0))
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + word)
    return key


def cgk_keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """One LSH key per window ``h[start:end]`` and repetition, walked as if of ``length`` words."""
    return _keys(h, _walk(h, starts, _STEPS * length), np.arange(len(starts)), ends, length)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the substring of ``text`` nearest to ``item`` by edit distance (Sellers)."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        idx = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else idx.copy()
        for i, x in enumerate(a, 1):
            step = np.empty_like(row)
            step[0] = i
            step[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(step - idx) + idx
        return row

    row = last_row(item, text, True)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class _Grams:
    """The distinct n-grams of some items, behind a bitmap of their first bits."""

    def __init__(self, n: int, items: list[np.ndarray]) -> None:
        self.n, self.hashes = n, np.unique(np.concatenate([grams(x, n) for x in items]))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashes >> np.uint64(42)] = True

    def running(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the n-grams that start before each word are an item's; n-grams stay in their row."""
        g = grams(h, self.n)
        hit = self.seen[g >> np.uint64(42)] & within(row, self.n)
        at = np.flatnonzero(hit)
        hit[at] = self.hashes[np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)] == g[at]
        total = np.zeros(len(h) + 1, np.int64)
        np.cumsum(hit, out=total[1 : len(hit) + 1])
        total[len(hit) + 1 :] = total[len(hit)]
        return total


class BenchmarkIndex:
    """Items of a benchmark by length, their n-grams and their CGK keys."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, least: int = LEAST) -> None:
        self.edits, self.ids, self.words = edits, [], []
        texts = [t for _, t in items]
        for a, _, data, bounds in text_slices(pa.array(texts, pa.string())):
            w = Words(data, bounds, "word")
            for r in range(len(bounds) - 1):
                if w.first[r + 1] - w.first[r] >= max(least, 1):
                    self.ids.append(items[a + r][0])
                    self.words.append(w.hash[w.first[r] : w.first[r + 1]])
        self.parts, words = [], []  # (item, its word that the part starts with)
        for i, x in enumerate(self.words):
            for start, end in pieces(len(x)):
                self.parts.append((i, start))
                words.append(x[start:end])
        by_length = defaultdict(list)
        for i, x in enumerate(words):
            by_length[len(x)].append(i)
        self.need = {length: surviving(length, allowed(length, edits)) for length in by_length}
        self.grams = {n: _Grams(n, [x for x in words if self.need[len(x)][0] == n]) for n in {n for n, _ in self.need.values()}}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, members in by_length.items():
            keys = np.concatenate([cgk_keys(words[i], np.zeros(1, np.int64), np.array([length]), length)[0] for i in members])
            order = np.argsort(keys, kind="stable")
            self.keys[length] = keys[order], np.repeat(members, REPEATS)[order]

    def _candidates(self, h: np.ndarray, row: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, part) of windows that share a key with a part of an item."""
        total = {n: g.running(h, row) for n, g in self.grams.items()}
        longest, every = max(self.keys), np.arange(len(h))

        def count(n: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
            return total[n][np.maximum(e - n + 1, s)] - total[n][s]

        kept = np.zeros(len(h), bool)
        for n in self.grams:
            kept |= count(n, every, np.minimum(every + longest, stop)) >= min(least for m, least in self.need.values() if m == n)
        starts = every[kept]
        for i in range(0, len(starts), 1024):
            s = starts[i : i + 1024]
            walk = None
            for length, (keys, parts) in self.keys.items():
                n, least = self.need[length]
                ends = np.minimum(s + length, stop[s])
                ok = np.flatnonzero(count(n, s, ends) >= least)
                if not len(ok):
                    continue
                walk = _walk(h, s, _STEPS * longest) if walk is None else walk
                own = _keys(h, walk, ok, ends[ok], length)
                low = np.searchsorted(keys, own)
                for r, c in zip(*np.nonzero(keys[np.minimum(low, len(keys) - 1)] == own), strict=True):
                    for part in parts[low[r, c] : np.searchsorted(keys, own[r, c], "right")].tolist():
                        yield int(s[ok[r]]), part

    def search(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start word, end word, distance): the best match of each row and item within the allowed distance."""
        w = Words(data, bounds, "word")
        if not len(w) or not self.words:
            return []
        h = w.hash
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for start, part in self._candidates(h, w.row, w.first[w.row + 1]):
            item, offset = self.parts[part]
            row = int(w.row[start])
            found[row, item].add(max(start - offset, int(w.first[row])))
        out = []
        for (row, item), starts in sorted(found.items()):
            lo, hi = int(w.first[row]), int(w.first[row + 1])
            length = len(self.words[item])
            k = allowed(length, self.edits)
            best = (k + 1, 0, 0)
            where = sorted(starts)
            same = next((s for s in where if np.array_equal(h[s : min(s + length, hi)], self.words[item])), None)
            if same is not None:
                out.append((row, item, same - lo, same + length - lo, 0))
                continue
            n, least = surviving(length, k)
            own = grams(self.words[item], n)
            shift = k if length > _PIECE else 0  # edits before a part move it
            for s, e in _regions(where, length, k, shift, lo, hi):
                if np.isin(grams(h[s:e], n), own).sum() < least:
                    continue  # too few n-grams of this very item, by the same bound as above
                d, a, b = best_match(self.words[item], h[s:e])
                best = min(best, (d, s + a - lo, s + b - lo))
            if best[0] <= k:
                out.append((row, item, best[1], best[2], best[0]))
        return out


def _regions(starts: list[int], length: int, k: int, shift: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Join windows that overlap within the allowed shift; each region is searched once."""
    first = last = starts[0]
    for s in [*starts[1:], None]:
        if s is None or s > last + length + k + shift:
            yield max(low, first - k), min(high, last + length + k + shift)
            first = s
        last = s


def _passes(benchmark: DataFrame, edits: float, least: int) -> Iterator[BenchmarkIndex]:
    items = benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    passes = max(1, -(-items.count() // ITEMS))
    for i in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        yield BenchmarkIndex([tuple(r) for r in part.orderBy("item_id", "text").collect()], edits, least)


def contamination(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least: int = LEAST) -> DataFrame:
    """``(doc_id, item_id, start_word, end_word, edits)``: benchmark items found in documents, the best match of each row and item.

    Words are runs of letters, digits and bytes over 127, A-Z folded. An item is
    found where some run of a document's words is within ``edits`` * its words
    (rounded down) by edit distance: items of up to four words only where they
    stand verbatim, a five-word one with one word changed. Raise ``least`` where
    a benchmark has items that are everyday words. Null and empty texts hold
    nothing; null items and those of fewer words than ``least`` are not looked
    for; texts and items of any length are searched whole. Repeated rows give
    repeated results, a null doc_id is passed on; other columns are not read;
    empty tables give no rows. Every ``ITEMS`` items cost one pass over the
    documents, whose index is broadcast.
    """
    out = None
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    for index in _passes(benchmark, edits, least):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                for a, _, data, bounds in text_slices(batch.column("text")):
                    found = shared.value.search(data, bounds)
                    cols = [pa.array([x[i] for x in found], pa.int32()) for i in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + x[0] for x in found], pa.int64())), pa.array([shared.value.ids[x[1]] for x in found]).cast(pa.int64() if kinds[1] == "bigint" else pa.string()), *cols], names=["doc_id", "item_id", "start_word", "end_word", "edits"])

        part = base.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1] if kinds[1] == 'bigint' else 'string'}, start_word int, end_word int, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least: int = LEAST) -> DataFrame:
    """The documents without any benchmark item, columns as they are.

    Cases as for ``contamination``: null and empty texts stay, repeated rows
    stay or go alike, empty tables change nothing.
    """
    names = docs.columns
    for index in _passes(benchmark, edits, least):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, bounds in text_slices(batch.column(names.index("text"))):
                    clean = np.ones(b - a, bool)
                    clean[[x[0] for x in shared.value.search(data, bounds)]] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
