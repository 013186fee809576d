"""Personal data: base patterns, and bootstrapped contextual extraction.

The base finds e-mail addresses, IP addresses, card and phone numbers in whole
texts. They seed a graph of lexical patterns (the words around) and instances
(identifier-like strings): patterns are scored by the share of their instances
that is known to be of a kind, instances by their best patterns, in turns;
patterns of high confidence then mark identifiers that the base doesn't see.

An instance is a string of 4 to 128 characters: a base span, an address that is
spelled out (joe [at] host [dot] org), a row of digit groups, or a word with a
digit or @. Words beside it are taken whole, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts from so many known instances and this share of them among all its instances (plus one).
SUPPORT = 5
CONFIDENCE = 0.85

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of either never starts inside a run of digits, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_AT = re.compile(r"[\[({] ?[aA][tT] ?[\])}] ?")
_DOT = re.compile(r"(?: ?[\[({] ?[dD][oO][tT] ?[\])}] ?|\.)(?=[A-Za-z0-9])")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_GROUPS = re.compile(r"(?<![0-9])[0-9]+(?:[ .()-]{1,3}[0-9]+)+")
LEAST, MOST = 4, 128
_EDGE = ".,;:!?()[]{}<>\"'|"


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            yield start, m.end()
            done = m.end()
        at = t.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, non-overlapping per kind; failing matches dropped."""
    out = [(0, s, e) for s, e in _emails(t)]
    if first := _DIGIT.search(t):
        low = first.start()
        for m in _IP.finditer(t, low):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(t, low):
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(t, max(low - 1, 0)):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _spelled(t: str) -> Iterator[tuple[int, int]]:
    """Addresses with at and dot in brackets."""
    for m in _AT.finditer(t):
        name = m.start() - (m.start() > 0 and t[m.start() - 1] == " ")
        start, at = name, m.end()
        while start > 0 and name - start < MOST and t[start - 1] in _LOCAL:
            start -= 1
        if start == name or not (label := _LABEL.match(t, at)):
            continue
        end = label.end()
        while (dot := _DOT.match(t, end)) and (label := _LABEL.match(t, dot.end())):
            end = label.end()
        yield start, end


def _marked(t: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or @, without edge punctuation; the value after a last = or :."""
    done = 0
    for m in _MARK.finditer(t):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not t[start - 1].isspace():
            start -= 1
        while end < len(t) and not t[end].isspace():
            end += 1
        done = end
        while end > start and t[end - 1] in _EDGE:
            end -= 1
        start = max(start, t.rfind("=", start, end) + 1, t.rfind(":", start, end) + 1)
        while start < end and t[start] in _EDGE:
            start += 1
        yield start, end


def _candidates(t: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like strings outside the base spans, by place; of overlapping ones the spelled address, then the digit groups."""
    spans = sorted((s, e) for _, s, e in taken)
    for found in (_spelled(t), (m.span() for m in _GROUPS.finditer(t)), _marked(t)):
        new, i = [], 0
        for start, end in found:
            while i < len(spans) and spans[i][1] <= start:
                i += 1
            if LEAST <= end - start <= MOST and not any(s < end and start < e for s, e in spans[i : i + 8]):
                new.append((start, end))
        yield from new
        spans = sorted(spans + new)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _beside(t: str, at: int, n: int, step: int) -> list[str]:
    """The n whole words before (step -1) or after (step 1) a place, as many as there are; digits alike, lower-case."""
    size = 64
    while True:
        low, high = (max(0, at - size), at) if step < 0 else (at, min(len(t), at + size))
        got = t[low:high].split()
        if len(got) > n or (low == 0 if step < 0 else high == len(t)):
            got = got[-n:] if step < 0 else got[:n]
            return [_DIGIT.sub("0", w.lower()) for w in got]
        size *= 4


def _contexts(t: str, start: int, end: int) -> list[int]:
    """Patterns: the word before, the two words before, the words on either side."""
    left, right = _beside(t, start, 2, -1), _beside(t, end, 1, 1)
    out = []
    if left:
        out.append(_hash("l", left[-1]))
        if len(left) == 2:
            out.append(_hash("ll", *left))
        if right:
            out.append(_hash("lr", left[-1], *right))
    return out


_SPAN = "struct<kind:int,start:int,end:int>"
_MENTION = "struct<kind:int,start:int,end:int,instance:bigint,patterns:array<bigint>>"


def _describe(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mention = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    for batch in batches:
        found, digest = [], []
        for t in batch.column("text").to_pylist():
            t = t or ""
            base = base_spans(t)
            digest.append(hashlib.sha256(_describe(base).encode()).hexdigest())
            both = base + [(len(KINDS), s, e) for s, e in _candidates(t, base)]
            found.append([{"kind": k, "start": s, "end": e, "instance": _hash(t[s:e].lower()), "patterns": _contexts(t, s, e)} for k, s, e in both])
        kept = [batch.column(c) for c in ("doc_id", "h1", "h2")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(digest, pa.string()), pa.array(found, mention)], names=["doc_id", "h1", "h2", "base_sha256", "mentions"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumn("h1", F.xxhash64(text)).withColumn("h2", F.xxhash64(text, F.lit("again")))


def _discover(scanned: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """``(h1, h2, found)``: spans that high-confidence patterns add, by text."""
    mentions = scanned.where(F.exists("mentions", lambda m: m["kind"] == len(KINDS))).select("h1", "h2", F.explode("mentions").alias("m"))
    edges = scanned.select(F.explode("mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"), F.col("m.instance").alias("instance"), F.col("m.kind").alias("kind"))
    edges = cut(edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    known = edges.where(F.col("kind") < len(KINDS)).select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    size = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    seeds = known
    open_ = edges.join(known.select("instance").distinct(), "instance", "left_anti").select("pattern", "instance")
    for _ in range(rounds):
        backed = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("backers"))
        patterns = cut(backed.where(F.col("backers") >= support).join(size, "pattern").withColumn("confidence", F.col("mass") / (F.col("n") + 1)).where(F.col("confidence") >= confidence))
        scored = open_.join(patterns, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        known = cut(seeds.unionByName(scored))
    best = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"), F.max("confidence").alias("confidence"))
    open_mentions = mentions.where(F.col("m.kind") == len(KINDS)).select("h1", "h2", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    hit = open_mentions.join(small(cut(best)), "pattern").groupBy("h1", "h2", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return cut(hit.groupBy("h1", "h2").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found")))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found)`` for every row; needs ``doc_id`` and ``text``.

    The counts and the digest are those of the base spans, ``spans`` also has the
    ``n_found`` spans that the patterns add. A null text is empty. Equal texts
    have equal spans; repeated rows, ids that are null and other columns change
    nothing. An empty table gives no rows.
    """
    scanned = cut(_keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(_scan, f"doc_id {dict(docs.dtypes)['doc_id']}, h1 bigint, h2 bigint, base_sha256 string, mentions array<{_MENTION}>"))
    found = _discover(scanned, rounds, support, confidence)
    count = lambda k: F.size(F.filter("mentions", lambda m: m["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.transform(F.filter("mentions", lambda m: m["kind"] < len(KINDS)), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rows = scanned.select("doc_id", "h1", "h2", *[count(k) for k in range(len(KINDS))], "base_sha256", base.alias("base")).join(small(found, items="found"), ["h1", "h2"], "left")
    more = F.coalesce("found", F.array().cast(f"array<{_SPAN}>"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", _text_of(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_found"))


def mask_personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """The documents with each span (overlapping ones joined) replaced by its kind in angle brackets; other columns stay, n_chars follows the text.

    All rows stay, repeated ones too; a null text stays null, an empty one empty;
    columns may have any names; an empty table stays empty.
    """
    scanned = cut(_keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(_scan, f"doc_id {dict(docs.dtypes)['doc_id']}, h1 bigint, h2 bigint, base_sha256 string, mentions array<{_MENTION}>"))
    found = small(_discover(scanned, rounds, support, confidence), items="found")
    names, schema = docs.columns, docs.schema
    whole = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")).drop("text")  # so that columns may have any names
    joined = whole.join(found, ["h1", "h2"], "left").select(*[F.col("row")[c].alias(c) for c in names], F.col("found").alias("found" + "".join(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            texts = []
            for t, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if t is not None:
                    spans = sorted((s, e, k) for k, s, e in base_spans(t) + [(m["kind"], m["start"], m["end"]) for m in more or []])
                    out, done = [], 0
                    for s, e, k in spans:
                        if s >= done:
                            out += [t[done:s], f"<{KINDS[k]}>"]
                        done = max(done, e)
                    t = "".join([*out, t[done:]])
                texts.append(t)
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, schema)
