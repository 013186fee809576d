"""Small dimension tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .draws import KING_WEN, TRIGRAMS


class Figure(NamedTuple):
    rows: str
    name: str
    meaning: str


class Rune(NamedTuple):
    name: str
    invertible: bool


# Rows of the figures, top first (1 is one point, 0 two), with their names and what these mean.
FIGURES = (
    Figure("1111", "Via", "The Way"),
    Figure("1110", "Cauda Draconis", "Tail of the Dragon"),
    Figure("1101", "Puer", "The Boy"),
    Figure("1100", "Fortuna Minor", "Lesser Fortune"),
    Figure("1011", "Puella", "The Girl"),
    Figure("1010", "Amissio", "Loss"),
    Figure("1001", "Carcer", "The Prison"),
    Figure("1000", "Laetitia", "Joy"),
    Figure("0111", "Caput Draconis", "Head of the Dragon"),
    Figure("0110", "Conjunctio", "Conjunction"),
    Figure("0101", "Acquisitio", "Gain"),
    Figure("0100", "Rubeus", "Red"),
    Figure("0011", "Fortuna Major", "Greater Fortune"),
    Figure("0010", "Albus", "White"),
    Figure("0001", "Tristitia", "Sorrow"),
    Figure("0000", "Populus", "The People"),
)
# The elder runes in their order; those alike when turned can't be inverted.
RUNES = (
    Rune("Fehu", True),
    Rune("Uruz", True),
    Rune("Thurisaz", True),
    Rune("Ansuz", True),
    Rune("Raidho", True),
    Rune("Kenaz", True),
    Rune("Gebo", False),
    Rune("Wunjo", True),
    Rune("Hagalaz", False),
    Rune("Nauthiz", False),
    Rune("Isa", False),
    Rune("Jera", False),
    Rune("Eihwaz", False),
    Rune("Perthro", True),
    Rune("Algiz", True),
    Rune("Sowilo", False),
    Rune("Tiwaz", True),
    Rune("Berkano", True),
    Rune("Ehwaz", True),
    Rune("Mannaz", True),
    Rune("Laguz", True),
    Rune("Ingwaz", False),
    Rune("Dagaz", False),
    Rune("Othala", True),
)
AETTIR = ("Freyr", "Heimdall", "Tyr")
TRIGRAM_NAMES = {"111": "Heaven", "110": "Lake", "101": "Fire", "100": "Thunder", "011": "Wind", "010": "Water", "001": "Mountain", "000": "Earth"}
SUITS = ("Wands", "Cups", "Swords", "Pentacles")
SPREADS = {"single": 1, "threeCard": 3, "celticCross": 10}
VIRIDIS = ((68, 1, 84), (72, 40, 120), (62, 73, 137), (49, 104, 142), (38, 130, 142), (31, 158, 137), (53, 183, 121), (110, 206, 88), (181, 222, 43), (253, 231, 37))
#: Byte sources: kind, privacy, how to ask for access.
PROVIDERS = {
    "crypto": ("csprng", "private", "none"), "anu": ("qrng", "private", "key"), "anu-legacy": ("qrng", "private", "none"), "qrandom.io": ("qrng", "private", "none"), "lfdr.de": ("qrng", "private", "none"),
    "outshift": ("qrng", "private", "key"), "qci": ("qrng", "private", "token"), "random.org": ("trng", "private", "key"), "superrand": ("trng", "private", "key"), "drand": ("beacon", "public", "none"),
    "nist-beacon": ("beacon", "public", "none"), "nqsn": ("beacon", "public", "none"), "uchile": ("beacon", "public", "none"), "inmetro": ("beacon", "public", "none"), "curby": ("beacon", "public", "none"),
    "padova": ("qrng", "private", "none"), "qbck": ("qrng", "private", "key"), "randao": ("beacon", "public", "none"), "bitcoin": ("beacon", "public", "none"), "solana": ("beacon", "public", "none"),
    "tezos": ("beacon", "public", "none"), "flow": ("beacon", "public", "none"), "camera": ("trng", "private", "permission"), "microphone": ("trng", "private", "permission"), "serial": ("trng", "private", "none"),
    "sensor": ("trng", "private", "permission"), "sdr": ("trng", "private", "none"), "jitter": ("trng", "private", "none"),
}


def figures(spark: SparkSession) -> DataFrame:
    """``(binary, value, points, name, meaning)``; a row of 1 is one point, of 0 two."""
    rows = [(f.rows, int(f.rows, 2), 8 - f.rows.count("1"), f.name, f.meaning) for f in FIGURES]
    return spark.createDataFrame(rows, "binary string, value int, points int, name string, meaning string")


def runes(spark: SparkSession) -> DataFrame:
    """``(index, name, aett, invertible)``, eight runes to an aett."""
    return spark.createDataFrame([(i, r.name, AETTIR[i // 8], r.invertible) for i, r in enumerate(RUNES)], "index int, name string, aett string, invertible boolean")


def cards(spark: SparkSession) -> DataFrame:
    """``(index, arcana, suit, number)``: 22 majors, then four suits of 14."""
    rows = [(i, "major", None, i) for i in range(22)] + [(22 + 14 * s + r, "minor", suit, r + 1) for s, suit in enumerate(SUITS) for r in range(14)]
    return spark.createDataFrame(rows, "index int, arcana string, suit string, number int")


def hexagrams(spark: SparkSession) -> DataFrame:
    """``(number, binary, lower, upper)``, lines bottom up."""
    rows = [(KING_WEN[i][j], a + b, TRIGRAM_NAMES[a], TRIGRAM_NAMES[b]) for i, a in enumerate(TRIGRAMS) for j, b in enumerate(TRIGRAMS)]
    return spark.createDataFrame(rows, "number int, binary string, lower string, upper string")


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PROVIDERS.items()], "name string, kind string, privacy string, access string")


def viridis(spark: SparkSession, n: int) -> DataFrame:
    """``(i, r, g, b)``: n colours, linear between the stops."""
    last = len(VIRIDIS) - 1
    rows = []
    for i in range(n):
        x = i / max(n - 1, 1) * last
        k = min(int(x), last - 1)
        rows.append((i, *[int(a + (x - k) * (b - a) + 0.5) for a, b in zip(VIRIDIS[k], VIRIDIS[k + 1], strict=True)]))
    return spark.createDataFrame(rows, "i int, r int, g int, b int")
