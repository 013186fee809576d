"""Rates (digits on dials) as angles, byte masks, and circular statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import each, lists

BASE = 44
TAU = 2 * math.pi


def parse_rate(text: Column, base: int = BASE, one_based: bool = False) -> Column:
    """Digits of a rate whose groups are parted by one kind of separator, ``-`` or ``.``; null if it isn't one."""
    digits = F.transform(F.split(text, "[-.]"), lambda x: F.when(x.rlike("^[0-9]{1,9}$"), x.cast("int") - int(one_based)))
    mixed = text.contains("-") & text.contains(".")
    fine = F.forall(digits, lambda v: F.coalesce((v >= 0) & (v < base), F.lit(False)))
    return F.when(~mixed & fine, digits)


def format_rate(digits: Column, base: int = BASE, separator: str = "-", pad: bool = False) -> Column:
    size = len(str(base - 1)) if pad else 1
    return F.array_join(F.transform(digits, lambda v: F.when(F.length(v.cast("string")) < size, F.lpad(v.cast("string"), size, "0")).otherwise(v.cast("string"))), separator)


def angle(digit: Column, base: int = BASE) -> Column:
    return digit * F.lit(TAU) / F.lit(base)


def phases(digits: Column, base: int = BASE) -> Column:
    return F.transform(digits, lambda v: angle(v, base))


def convert_base(digits: Column, source: int, target: int) -> Column:
    """Digits on another dial, and the largest angular error."""
    to = lambda v: (F.floor(v * target / source + 0.5) % target).cast("int")
    gap = lambda v: angle(to(v), target) - angle(v, source)
    error = F.array_max(F.transform(digits, lambda v: F.abs(F.atan2(F.sin(gap(v)), F.cos(gap(v))))))
    return F.struct(F.transform(digits, to).alias("digits"), error.alias("error"))


#: The systems of a rate index that are dials of ten, most trusted first; two dials of a hundred and labels of base 44 come after them.
TEN_DIALS = ("combe_base10", "delawarr", "copen_homeo", "copen_organ")


def rate_of_systems(system: dict[str, Column]) -> Column:
    """The base-44 digits of the first system that holds a rate; null if none does."""
    ten = [F.when(c.rlike("^[0-9]+$"), convert_base(F.transform(F.regexp_extract_all(c, F.lit("([0-9])")), lambda x: x.cast("int")), 10, BASE)["digits"]) for c in (system[s] for s in TEN_DIALS if s in system)]
    found = list(ten)
    if "krt" in system:
        number = lambda x: F.floor(F.nullif(F.regexp_extract(x, r"^\s*([+]?[0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double") + 0.5)
        hundred = F.transform(F.split(system["krt"], "-"), lambda x: F.pmod(number(x), F.lit(100)))
        found.append(F.when(F.forall(hundred, lambda v: v.isNotNull()), convert_base(hundred, 100, BASE)["digits"]))
    if "combe_base44" in system:
        found.append(parse_rate(F.regexp_replace(F.trim(system["combe_base44"]), r"\s+", "-")))
    return F.coalesce(*found) if found else F.lit(None).cast("array<int>")


def catalog(entries: DataFrame) -> DataFrame:
    """Entries ``(term, systems struct, ...)`` with their base-44 ``rate``; those without a term are left out, those without a rate keep null."""
    fields = entries.schema["systems"].dataType.names
    rate = rate_of_systems({f: F.col("systems")[f] for f in fields})
    return entries.where(F.length("term") > 0).withColumn("rate", rate)


def degrees(digit: Column, base: int = BASE) -> Column:
    """A digit's angle in degrees."""
    return digit * F.lit(360.0) / base


def mask(digits: Column, base: int = BASE) -> Column:
    """A rate's period of mask bytes."""
    return F.transform(digits, lambda v: (F.floor(v * 256 / base + 0.5) % 256).cast("int"))


def mask_bytes(digits: list[int], base: int = BASE) -> list[int]:
    """The same for a fixed rate."""
    return [int(v * 256 / base + 0.5) % 256 for v in digits]


def mask_at(digits: Column, i: Column, base: int = BASE) -> Column:
    return F.element_at(mask(digits, base), (i % F.size(digits) + 1).cast("int"))


def xor_imprint(b: Column, digits: Column, i: Column, base: int = BASE) -> Column:
    """A byte XOR its place's mask byte; applied twice it is undone."""
    return b.bitwiseXOR(mask_at(digits, i, base))


def phase_modulate(data: DataFrame, digits: list[int], base: int = BASE) -> DataFrame:
    """Chunks ``(source, off, bytes)`` to ``(source, off, theta)``: each byte as a phase, turned by the digit of its place, the digits repeating; an array per chunk."""
    turns = TAU * np.array(digits) / base

    def turn(off: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        n = np.diff(bounds)
        place = np.repeat(off - bounds[:-1], n) + np.arange(len(raw))
        return np.arange(len(off)), {"theta": lists((TAU * raw / 256 + turns[place % len(turns)]) % TAU, n, pa.float64())}

    return each(data.where("bytes is not null"), turn, "theta array<double>", ("source", "off"))


def circular(theta: Column) -> list[Column]:
    """n, resultant length, mean direction in [0, 2 pi) and circular variance, as aggregates."""
    c, s, n = F.sum(F.cos(theta)), F.sum(F.sin(theta)), F.count(theta)
    mean = F.atan2(s, c)
    return [n.alias("n"), (F.hypot(s, c) / n).alias("resultant"), F.when(mean < 0, mean + TAU).otherwise(mean).alias("mean"), (1 - F.hypot(s, c) / n).alias("variance")]


def signature_rate(text: Column, size: int, base: int = BASE) -> Column:
    """Digits floor(byte / 256 * base) of a text's SHA-256."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int") * base / 256).cast("int"))


def char_code_rate(text: Column) -> Column:
    """round(sqrt(sum of character codes) * 100) / 100."""
    total = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.ascii(c))
    return F.floor(F.sqrt(total) * 100 + 0.5) / 100
