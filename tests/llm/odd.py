"""Documents of every odd kind, and helpers."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and blank texts, one very long text, ties and repeated rows."""
    rng = random.Random(11)
    base = prose(rng, 80)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n", "de", None, 3),
        (None, base, None, "b", 1), (None, None, None, None, None), (6, "one", "en", "b", 3), (7, "one two", "en", "b", 7), (8, prose(rng, 60_000), "en", "b", 1),
        (9, "x" * 300_000, "en", "c", 1), (10, "\u00a0\u2003 é ß 漢字 \U0001f600 mail a@b.co +1 (555) 123-4567", "fr", "c", 9), (11, "..." * 50, "en", "c", 1),
    ]
    return [(d, t, la, s, n) for d, t, la, s, n in rows]


def odd_docs(spark, extra=True):
    """With extra columns whose names clash with those that the operators use inside or return."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    if extra:
        for c in ("n", "rid", "did", "th", "h1", "h2", "size", "target", "copies", "copy", "score", "predicted", "kept", "component_id", "found", "key", "b", "y", "u", "y0", "spans", "rank", "row", "r", "rows", "k_h1", "source_size", "rate", "turn", "of", "p", "m", "copies", "__u", "__turn", "__n", "__size", "__source", "mentions", "text_", "component"):
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
