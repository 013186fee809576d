"""Byte, bit and encoding expressions."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

MASK32 = 4294967295


def hex_bytes(h: Column) -> Column:
    """Hex string to an array of ints 0..255."""
    return F.transform(F.regexp_extract_all(h, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def text_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def hex_popcount(h: Column) -> Column:
    """One-bits of a hex string, eight digits at a time."""
    words = F.regexp_extract_all(h, F.lit(".{1,8}"), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(F.conv(w, 16, 10).cast("bigint")))


def bit_string(h: Column, digits: int) -> Column:
    """The bits of a hex string of so many digits, as a string of 0 and 1."""
    return F.concat(*[F.lpad(F.conv(F.substring(h, i + 1, min(8, digits - i)), 16, 2), 4 * min(8, digits - i), "0") for i in range(0, digits, 8)])


def to_bits(b: Column) -> Column:
    """A byte's bits, most significant first."""
    return F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", b, i).bitwiseAND(F.lit(1)))


def explode_bytes(df: DataFrame, h: Column, keep: list[str]) -> DataFrame:
    """``keep``, pos, b: one row per byte of a hex column."""
    return df.select(*keep, F.posexplode(hex_bytes(h)).alias("pos", "b")).withColumn("pos", F.col("pos").cast("bigint"))


def explode_bits(df: DataFrame, keep: list[str]) -> DataFrame:
    """pos, b to pos, bit (most significant first)."""
    return df.select(*keep, F.col("pos").alias("__p"), F.posexplode(to_bits(F.col("b"))).alias("__i", "bit")).select(*keep, (F.col("__p") * 8 + F.col("__i")).alias("pos"), "bit")


def pack_bits(df: DataFrame, keys: list[str]) -> DataFrame:
    """pos, bit to pos, b; bits after the last full byte are left over."""
    byte = F.floor(F.col("pos") / 8)
    packed = df.groupBy(*keys, byte.alias("__b")).agg(F.sum(F.col("bit") * F.element_at(F.array(*[F.lit(1 << (7 - i)) for i in range(8)]), (F.col("pos") % 8 + 1).cast("int"))).cast("int").alias("b"), F.count("*").alias("__n"))
    return packed.where("__n = 8").select(*keys, F.col("__b").cast("bigint").alias("pos"), "b")


def fnv1a(text: Column) -> Column:
    """FNV-1a over the code units of a text (characters outside the basic plane aside), as an unsigned 32-bit number."""
    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(MASK32)))


def xorshift32(seed: int = 0x9E3779B9):
    """The generator's states, after the seed."""
    s = seed & MASK32
    while True:
        s ^= (s << 13) & MASK32
        s ^= s >> 17
        s ^= (s << 5) & MASK32
        yield s


@F.pandas_udf(BinaryType())
def hmac_sha256(key: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([_hmac.new(k, d, hashlib.sha256).digest() for k, d in zip(key, data, strict=True)])


_B58 = {c: i for i, c in enumerate("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")}


def _base58(text: str) -> bytes | None:
    n = 0
    for c in text:
        if c not in _B58:
            return None
        n = n * 58 + _B58[c]
    zeros = len(text) - len(text.lstrip("1"))
    return b"\x00" * zeros + (n.to_bytes((n.bit_length() + 7) // 8, "big") if n else b"")


@F.pandas_udf(BinaryType())
def base58_decode(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _base58(t) for t in text])


def _base32(text: str) -> bytes | None:
    alphabet = "abcdefghijklmnopqrstuvwxyz234567"
    if any(c not in alphabet for c in text):
        return None
    n = 0
    for c in text:
        n = n << 5 | alphabet.index(c)
    size = len(text) * 5 // 8
    return (n >> (len(text) * 5 - size * 8)).to_bytes(size, "big") if size else b""


@F.pandas_udf(BinaryType())
def base32_decode(text: pd.Series) -> pd.Series:
    """Lower-case RFC 4648 without padding; bits of a partial byte are dropped."""
    return pd.Series([None if t is None else _base32(t) for t in text])


def varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned LEB128 number of at most eight bytes and the place after it."""
    value = 0
    for i, b in enumerate(data[at : at + 8]):
        value |= (b & 127) << 7 * i
        if b < 128:
            return value, at + i + 1
    raise ValueError("truncated or too large varint")


def cid_digest(cid: str) -> bytes:
    """The digest in a base32 content identifier: after version 1, codec, hash function and length."""
    data, at, numbers = (_base32(cid[1:]) if cid[:1] == "b" else None), 0, []
    if data is None:
        raise ValueError("not a base32 identifier")
    for _ in range(4):
        value, at = varint(data, at)
        numbers.append(value)
    if numbers[0] != 1 or at + numbers[3] > len(data):
        raise ValueError("not a whole identifier of version 1")
    return data[at : at + numbers[3]]


_VARINT = StructType([StructField("value", LongType()), StructField("length", IntegerType())])


@F.pandas_udf(_VARINT)
def read_varint(data: pd.Series) -> pd.DataFrame:
    """The number that a binary value starts with, and its bytes; length 0 where there is none."""

    def one(x: bytes | None) -> tuple[int, int]:
        try:
            return varint(bytes(x or b""), 0)
        except ValueError:
            return 0, 0

    return pd.DataFrame([one(x) for x in data], columns=_VARINT.names)


@F.pandas_udf(ArrayType(IntegerType()))
def byte_histogram(text: pd.Series) -> pd.Series:
    """Counts of the 256 byte values of each text's UTF-8."""
    return pd.Series([np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256).astype(np.int32) for t in text])
