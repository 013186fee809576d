"""Letter values of words: ciphers are rows of a small table, multiplied by letter counts."""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

# Alphabets in order of value, and the tables that no rule gives.
LATIN = "abcdefghijklmnopqrstuvwxyz"
HEBREW = "אבגדהוזחטיכלמנסעפצקרשת"
FINALS = {"ך": "כ", "ם": "מ", "ן": "נ", "ף": "פ", "ץ": "צ"}
GREEK = ["α", "β", "γ", "δ", "ε", "ϝϛ", "ζ", "η", "θ", "ι", "κ", "λ", "μ", "ν", "ξ", "ο", "π", "ϙϟ", "ρ", "σς", "τ", "υ", "φ", "χ", "ψ", "ω", "ϡ"]
ARABIC = "ابجدهوزحطيكلمنسعفصقرشتثخذضظغ"
CHALDEAN = (1, 2, 3, 4, 5, 8, 3, 5, 1, 1, 2, 3, 4, 5, 7, 8, 1, 2, 3, 4, 6, 6, 6, 5, 1, 7)
KEYPAD = ("abc", "def", "ghi", "jkl", "mno", "pqrs", "tuv", "wxyz")
NAEQ = "alwhsdozkvgrcnyjufqbmxitep"
LETTER_NAMES = ("אלף", "בית", "גמל", "דלת", "הה", "וו", "זין", "חית", "טית", "יוד", "כף", "למד", "מם", "נון", "סמך", "עין", "פא", "צדי", "קוף", "ריש", "שין", "תו")
SPELLINGS = {"ab": {"ה": "הי", "ו": "ויו"}, "sag": {"ה": "הי", "ו": "ואו"}, "mah": {"ה": "הא", "ו": "ואו"}, "ban": {"ה": "הה", "ו": "וו"}}


def decimal_value(i: int) -> int:
    """1..9, 10..90, 100..900, 1000, ... by place in an alphabet."""
    return (i % 9 + 1) * 10 ** (i // 9)


def digit_root_of(n: int) -> int:
    return 0 if n == 0 else 1 + (abs(n) - 1) % 9


def _primes() -> list[int]:
    return list(itertools.islice((n for n in itertools.count(2) if all(n % k for k in range(2, int(n**0.5) + 1))), 28))


def _fibonacci() -> list[int]:
    out = [1, 1]
    while len(out) < 26:
        out.append(out[-1] + out[-2])
    return out


def cipher_tables() -> dict[str, tuple[str, dict[str, int], bool]]:
    """Cipher id to (script, letter values, whether the sum is reduced to its digit root)."""
    latin = lambda values: ("latin", dict(zip(LATIN, values, strict=True)), False)
    n = range(1, 27)
    old = dict(zip("abcdefghiklmnopqrstuxyz", map(decimal_value, range(23)), strict=True))
    agrippa = old | {"v": 200, "j": 600, "u": 700, "w": 900}
    cross = [1] + [k for k in range(5, 78) if k % 6 in (1, 5)]
    standard = [decimal_value(i) for i in range(26)]
    out = {
        "en-ordinal": latin(n),
        "en-reduction": latin([digit_root_of(i) for i in n]),
        "la-agrippa": ("latin", agrippa, False),
        "la-jewish": ("latin", agrippa | {"u": 200, "v": 700}, False),
        "en-naeq": ("latin", {c: i for i, c in enumerate(NAEQ, 1)}, False),
        "en-english": latin([6 * i for i in n]),
        "en-sumerian": latin([6 * i for i in n]),
        "en-standard": latin(standard),
        "en-satanic": latin([i + 35 for i in n]),
        "en-primes": latin(_primes()[:26]),
        "en-squares": latin([i * i for i in n]),
        "en-trigonal": latin([i * (i + 1) // 2 for i in n]),
        "en-fibonacci": latin(_fibonacci()),
        "en-chaldean": latin(CHALDEAN),
        "en-septenary": latin([(i - 1) % 7 + 1 for i in n]),
        "en-keypad": ("latin", {c: k for k, cs in enumerate(KEYPAD, 2) for c in cs}, False),
        "en-cross": latin(cross),
        "en-prime-cross": latin([1, *_primes()[2:27]]),
    }
    base = [decimal_value(i) for i in range(22)]
    place = {c: i for i, c in enumerate(HEBREW)} | {f: HEBREW.index(c) for f, c in FINALS.items()}
    names = [sum(base[place[c]] for c in name) for name in LETTER_NAMES]
    hebrew = lambda f: ("hebrew", {c: f(i) for c, i in place.items()}, False)
    out |= {
        "he-hechrachi": hebrew(lambda i: base[i]),
        "he-gadol": ("hebrew", {c: base[i] for c, i in place.items()} | {f: 500 + 100 * k for k, f in enumerate(FINALS)}, False),
        "he-siduri": hebrew(lambda i: i + 1),
        "he-katan": hebrew(lambda i: digit_root_of(base[i])),
        "he-atbash": hebrew(lambda i: base[21 - i]),
        "he-albam": hebrew(lambda i: base[(i + 11) % 22]),
        "he-milui": hebrew(lambda i: names[i]),
        "he-kidmi": hebrew(lambda i: sum(base[: i + 1])),
        "he-perati": hebrew(lambda i: base[i] ** 2),
        "he-neelam": hebrew(lambda i: names[i] - base[i]),
        "he-katan-mispari": (*hebrew(lambda i: base[i])[:2], True),
        "gr-isopsephy": ("greek", {c: decimal_value(i) for i, cs in enumerate(GREEK) for c in cs}, False),
        "ar-abjad": ("arabic", {c: decimal_value(i) for i, c in enumerate(ARABIC)}, False),
    }
    return out


# Friendly names of ciphers.
ALIASES = {"hebrew": "he-hechrachi", "english": "en-english", "simple": "en-ordinal", "ordinal": "en-ordinal", "sumerian": "en-sumerian", "isopsephy": "gr-isopsephy"}


def resolve_cipher(name: str) -> str:
    """A friendly name's cipher; any other name as it is, an error if no cipher has it."""
    cipher = ALIASES.get(name, name)
    if cipher not in cipher_tables():
        raise ValueError(f"unknown_cipher: {name}")
    return cipher


def reverse_value(text: Column) -> Column:
    """Sum of a..z counted from z = 1; null for a text without such letters."""
    kept = F.regexp_replace(F.lower(text), "[^a-z]", "")
    total = F.aggregate(F.filter(F.split(kept, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a + 123 - F.ascii(c))
    return F.when(kept != "", total)


def chamber(letter: Column) -> Column:
    """The chamber (1 to 9) of a Hebrew letter and its place there: letters and finals in order of their values, nine to a place."""
    i = F.call_function("instr", F.lit(HEBREW + "".join(FINALS)), letter) - 1
    return F.when((F.length(letter) == 1) & (i >= 0), F.struct((i % 9 + 1).cast("int").alias("chamber"), (F.floor(i / 9) + 1).cast("int").alias("place")))


def cipher_rows(spark: SparkSession) -> DataFrame:
    """``(cipher, script, letter, value, reduced)``, some 600 rows made by rule."""
    rows = [(k, s, c, v, r) for k, (s, table, r) in cipher_tables().items() for c, v in table.items()]
    return spark.createDataFrame(rows, "cipher string, script string, letter string, value bigint, reduced boolean")


_MARKS = re.compile("[֑-ׇؐ-ًؚ-ٰٟـ]")


def _normal(t: str | None) -> str | None:
    if t is None or t.isascii():
        return t and t.lower()
    if re.search("[֐-׿؀-ۿ]", t):
        return re.sub("[أإآٱ]", "ا", _MARKS.sub("", unicodedata.normalize("NFC", t)))
    return re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", t)).lower()


@F.pandas_udf(StringType())
def normalise(text: pd.Series) -> pd.Series:
    """Hebrew and Arabic: composed, without points and marks, alef forms folded; others: decomposed, without accents, lower-cased."""
    return text.map(_normal)


def detect_script(text: Column) -> Column:
    return F.when(text.rlike("[֐-׿]"), "hebrew").when(text.rlike("[؀-ۿ]"), "arabic").when(text.rlike("[Ͱ-Ͽἀ-῿]"), "greek").when(text.rlike("[A-Za-z]"), "latin")


def letter_sums(words: DataFrame, ciphers: DataFrame) -> DataFrame:
    """``(id, text)`` to ``(id, cipher, sum, reduced)`` for every cipher that knows a letter of the text, a row of words being a word of its own.

    Letters are counted within their row, some thousand rows at a time, so none are grouped or shuffled; the cipher table is a parameter's size.
    """
    table = [r for r in ciphers.select("cipher", "letter", "value", "reduced").collect() if len(r.letter) == 1]
    names, known = sorted({r.cipher for r in table}), np.array(sorted({ord(r.letter) for r in table}), np.int64)
    reduced = {r.cipher: r.reduced for r in table}
    value, has = np.zeros((len(known), len(names)), np.int64), np.zeros((len(known), len(names)), np.int64)
    for r in table:
        at = np.searchsorted(known, ord(r.letter)), names.index(r.cipher)
        value[at] += r.value
        has[at] = 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_normal(t) or "" for t in batch.column("text").to_pylist()]
            code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.searchsorted(known, code)
            fine = known[np.minimum(at, len(known) - 1)] == code
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[fine]
            counts = np.bincount(row * len(known) + at[fine], minlength=len(texts) * len(known)).reshape(-1, len(known))
            i, c = np.nonzero(counts @ has)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), pa.array(names).take(pa.array(c)), pa.array((counts @ value)[i, c]), pa.array([reduced[n] for n in names], pa.bool_()).take(pa.array(c))], names=["id", "cipher", "sum", "reduced"])

    schema = f"id {dict(words.dtypes)['id']}, cipher string, sum bigint, reduced boolean"
    if not names:
        return words.sparkSession.createDataFrame([], schema)
    return words.select("id", "text").mapInArrow(counted, schema)


def rooted(sums: DataFrame) -> DataFrame:
    """``(id, cipher, value, root)`` of sums, those of some ciphers being reduced to their root."""
    root = digit_root(F.col("sum"))
    return sums.select("id", "cipher", F.when(F.col("reduced"), root).otherwise(F.col("sum")).cast("bigint").alias("value"), root.alias("root"))


def profile(words: DataFrame, ciphers: DataFrame) -> DataFrame:
    """``(id, text)`` to ``(id, cipher, value, root)`` for every cipher that knows a letter of the text."""
    return rooted(letter_sums(words, ciphers))


def digit_root(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(1 + (F.abs(n) - 1) % 9).cast("int")


def lexicon_matches(values: DataFrame, lexicon: DataFrame, tolerance: int) -> DataFrame:
    """``(id, value)`` with ``lexicon(word, value)``: ``(id, word, delta)`` within the tolerance, by an equi-join on buckets of that width."""
    size = tolerance + 1
    near = lexicon.select("word", F.col("value").alias("lv"), F.explode(F.array(*[F.floor(F.col("value") / size) + k for k in (-1, 0, 1)])).alias("k"))
    hit = values.withColumn("k", F.floor(F.col("value") / size)).join(near, "k").where(F.abs(F.col("value") - F.col("lv")) <= tolerance)
    return hit.select("id", "word", (F.col("lv") - F.col("value")).alias("delta"))


_FACTS = StructType([StructField("prime", BooleanType()), StructField("triangular_index", LongType()), StructField("square", BooleanType()), StructField("perfect", BooleanType())])
#: Bases that decide Miller and Rabin's test for every 64-bit number.
_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 for p in _BASES):
        return n in _BASES
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1

    def passes(a: int) -> bool:
        x = pow(a, odd, n)
        return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))

    return all(passes(a) for a in _BASES)


def is_perfect(n: int) -> bool:
    """Even perfect numbers are 2**(p - 1) * (2**p - 1) with a prime 2**p - 1; an odd one would have over 1500 digits."""
    p = (n & -n).bit_length() if n > 0 else 0
    return p > 1 and n == ((1 << p) - 1) << (p - 1) and is_prime((1 << p) - 1)


def triangular_index(n: int) -> int | None:
    """k of k * (k + 1) / 2 = n, if there is one."""
    k = (math.isqrt(8 * n + 1) - 1) // 2
    return k if k * (k + 1) // 2 == n else None


@F.pandas_udf(_FACTS)
def _number_facts(n: pd.Series) -> pd.DataFrame:
    rows = [(is_prime(x), triangular_index(x), math.isqrt(x) ** 2 == x, is_perfect(x)) for x in map(int, n)]
    return pd.DataFrame(rows, columns=_FACTS.names).astype({"triangular_index": "Int64"})


def number_properties(n: Column) -> Column:
    """Digit sum and root, prime, triangular (and its index), square, perfect; for 64-bit n >= 1, in a time that grows with its digits."""
    facts = _number_facts(n)
    return F.struct(
        F.aggregate(F.split(n.cast("string"), ""), F.lit(0), lambda a, c: a + c.cast("int")).alias("digit_sum"),
        digit_root(n).alias("root"),
        facts["prime"].alias("prime"),
        facts["triangular_index"].isNotNull().alias("triangular"),
        facts["triangular_index"].alias("triangular_index"),
        facts["square"].alias("square"),
        facts["perfect"].alias("perfect"),
    )


def temurah(text: Column, rule: str = "atbash", shift: int = 1) -> Column:
    """Substitution over the 22 letters (finals folded first): atbash, albam, avgad, achbi or a shift."""
    to = {"atbash": lambda i: 21 - i, "albam": lambda i: (i + 11) % 22, "avgad": lambda i: (i + 1) % 22, "achbi": lambda i: i // 11 * 11 + 10 - i % 11, "shift": lambda i: (i + shift) % 22}[rule]
    letters = HEBREW + "".join(FINALS)
    return F.translate(text, letters, "".join(HEBREW[to(HEBREW.index(FINALS.get(c, c)))] for c in letters))


def notariqon(text: Column, place: str = "first") -> Column:
    """First, last or middle letters of the words."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    at = {"first": lambda w: F.substring(w, 1, 1), "last": lambda w: F.substring(w, -1, 1), "medial": lambda w: F.substr(w, F.floor(F.length(w) / 2).cast("int") + 1, F.lit(1))}[place]
    return F.array_join(F.transform(words, at), "")


def milui(text: str, variant: str | None = None) -> int:
    """Value of a Hebrew word's letters spelled out; the four variants spell he and vav."""
    base = [decimal_value(i) for i in range(22)]
    names = dict(zip(HEBREW, LETTER_NAMES, strict=True)) | SPELLINGS.get(variant or "", {})
    fold = lambda c: FINALS.get(c, c)
    return sum(base[HEBREW.index(fold(x))] for c in text for x in names.get(fold(c), ""))
