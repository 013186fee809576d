"""Fill-in-middle transformation over run-length encoded texts.

A unit is a maximal run of the letters A-Z and a-z, or any other single
character. A text is stored as its maximal runs of one character class
(letters, or other characters of one width in bytes) with cumulative counts of
units and characters. A cut after ``u`` units is found by binary search for the
run that holds it; within the run its place follows by multiplication, since
all characters of a run are equally wide. No list of units is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 of those so many get the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

_LETTER = 0


def _byte_classes() -> np.ndarray:
    """By first byte: letter, or the width of another character; 255 for a byte inside a character."""
    c = np.full(256, 1, np.uint8)
    c[65:91] = c[97:123] = _LETTER
    c[0x80:0xC0], c[0xC0:0xE0], c[0xE0:0xF0], c[0xF0:] = 255, 2, 3, 4
    return c


_CLASSES = _byte_classes()


class Runs(NamedTuple):
    """Maximal class runs of some texts, in order: first byte, bytes per character, bytes per unit (0: the run is one unit), and, with one entry more, the units and characters before each run."""

    start: np.ndarray
    width: np.ndarray
    step: np.ndarray
    units: np.ndarray
    chars: np.ndarray


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[Runs, np.ndarray]:
    """The runs of all rows of a slice and the first run of each row (one entry more than rows)."""
    kind = _CLASSES[data]
    inside = kind == 255
    new = np.zeros(len(data), bool)
    # A character's later bytes are of its class; a run ends where a first byte of another class stands.
    lead = np.flatnonzero(~inside)
    new[lead[np.flatnonzero(np.diff(kind[lead], prepend=254))]] = True
    new[bounds[:-1][bounds[:-1] < len(data)]] = True
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(data)))
    width = np.maximum(np.where(kind[start] == 255, 1, kind[start]), 1).astype(np.int64)
    letters = kind[start] == _LETTER
    chars = -(-length // width)
    units = np.where(letters, 1, chars)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    runs = Runs(start, width, np.where(letters, 0, width), total(units), total(chars))
    return runs, np.searchsorted(start, bounds)


def cut_at(runs: Runs, units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and character offsets of cuts after so many units, both counted over the whole slice."""
    at = np.searchsorted(runs.units, units, "right") - 1  # the run that the next unit is in
    last = at >= len(runs.start)
    at = np.minimum(at, max(len(runs.start) - 1, 0))
    over = units - runs.units[at]
    byte = np.where(last, end, runs.start[at] + over * runs.step[at]) if len(runs.start) else np.zeros_like(units)
    char = np.where(last, runs.chars[-1], runs.chars[at] + over * (runs.step[at] > 0)) if len(runs.start) else np.zeros_like(units)
    return byte, char


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits: the first groups of 8 digits of the SHA-256 of ``seed:id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))  # type: ignore[return-value]


def restore(output: str | bytes, form: str) -> bytes:
    """The text that ``output`` of a form was made of. Markers occur once each, as texts that hold one stay plain."""
    out = output.encode() if isinstance(output, str) else output
    if form == "plain":
        return out
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        prefix, rest = out[len(p) :].split(s, 1)
        suffix, middle = rest.split(m, 1)
    else:
        suffix, rest = out[len(s) :].split(p, 1)
        prefix, middle = rest.split(m, 1)
    return prefix + middle + suffix


def _transform(batches: Iterator[pa.RecordBatch], seed: int, digests: bool) -> Iterator[pa.RecordBatch]:
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        for a, b, data, bounds in text_slices(batch.column("text")):
            runs, first = encode(data, bounds)
            n = np.diff(runs.units[first])
            ids = batch.column("id").slice(a, b - a).to_pylist()
            h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            two = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            begin = runs.units[first[:-1]]
            (c1, k1), (c2, k2) = (cut_at(runs, begin + two[:, i], len(data)) for i in (0, 1))
            # A cut at a row's end is its last byte's end, wherever the next row's run begins.
            c1, c2 = np.minimum(c1, bounds[1:]), np.minimum(c2, bounds[1:])
            prefix_chars, middle_chars = k1 - runs.chars[first[:-1]], k2 - k1
            raw = data.tobytes()
            forms, outs = [], []
            for r in range(b - a):
                lo, hi = int(bounds[r]), int(bounds[r + 1])
                held = any(raw.find(m, lo, hi) >= 0 for m in marks)
                form = "plain" if lo == hi or held or h[r, 2] % 100 >= TRANSFORMED else "spm" if h[r, 3] % 100 < SUFFIX_FIRST else "psm"
                x, y = int(c1[r]), int(c2[r])
                if form == "plain":
                    out = raw[lo:hi]
                elif form == "psm":
                    out = b"".join((marks[0], raw[lo:x], marks[1], raw[y:hi], marks[2], raw[x:y]))
                else:
                    out = b"".join((marks[1], raw[y:hi], marks[0], raw[lo:x], marks[2], raw[x:y]))
                forms.append(form)
                outs.append(out)
            plain = np.array([f == "plain" for f in forms], bool)
            cols = [batch.column("id").slice(a, b - a), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain)]
            names = ["id", "n", "form", "prefix_chars", "middle_chars"]
            if digests:
                cols += [pa.array([hashlib.sha256(o).hexdigest() for o in outs], pa.string()), pa.array([hashlib.sha256(restore(o, f)).hexdigest() for o, f in zip(outs, forms, strict=True)], pa.string())]
                names += ["output_sha256", "restored_sha256"]
            else:
                cols += [batch.column("row").slice(a, b - a), pa.array(outs, pa.binary()).cast(pa.string(), safe=False)]
                names += ["row", "output"]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _number(docs: DataFrame) -> Column:
    return F.col("doc_id").cast("string").alias("id")


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents, ``text`` replaced by the transformed one, with ``form``, ``prefix_chars`` and ``middle_chars``; needs ``doc_id`` and ``text``.

    Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is
    ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; ``plain`` is the text itself:
    empty and null texts (null becomes empty), texts that hold one of the
    markers, and a tenth of the others. Cuts and form hang on the SHA-256 of the
    seed and the id alone, so reruns agree; rows of equal id (null counts as an
    empty one) share their draws. ``restore`` gives the text back. An empty
    table gives an empty one; other columns pass through, but for an input's
    own columns of the three new names, which are replaced. One pass, no
    shuffle; memory grows with the longest text.
    """
    own = ("form", "prefix_chars", "middle_chars")
    names = [c for c in docs.columns if c not in own]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"], F.lit(0).alias("none"))
    base = docs.select(_number(docs), F.col("text").cast("string").alias("text"), row.alias("row"))
    kind = base.schema["row"].dataType.simpleString()
    out = base.mapInArrow(lambda it: _transform(it, seed, False), f"id string, n long, form string, prefix_chars long, middle_chars long, row {kind}, output string")
    return out.select(*[F.col("output").alias(c) if c == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)], *own)


def middle_digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)``, one row per document: units, and digests of what ``fill_in_middle`` gives and of what ``restore`` makes of it. Cases as there."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(_number(docs), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(lambda it: _transform(it, seed, True), "id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    return out.select(F.col("id").cast(kind).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: DuckDB's equivalent of ``middle_digests``.
SQL = r"""
with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as l, sha256('1:' || doc_id::varchar) as h from documents),
drawn as (select *, len(l) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from units),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, array_to_string(l[1:a], '') as prefix, array_to_string(l[a + 1:b], '') as middle, array_to_string(l[b + 1:], '') as suffix from cuts)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256 from parts
"""
