"""Small frames with the awkward rows that every text operator must take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of stone river light code night grand zephyr quartz amber lantern orchard meadow velvet cobalt ember".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and blank texts, a long text, repeated rows."""
    long_text = sentence(random.Random(3), 6_000)
    return [
        (1_001, None, "en", "a", None),
        (1_002, "", None, None, 0),
        (1_003, " \n\t \n", "xx", "a", 5),
        (1_004, "word", "en", "b", 4),
        (1_005, long_text, "en", "b", len(long_text)),
        (1_006, "same row", "en", "a", 8),
        (1_006, "same row", "en", "a", 8),
        (None, "no id at all here", "en", None, 9),
        (1_007, "Ünïcode Straße naïve 漢字   words", "de", "c", 30),
    ]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        # Names that operators might use for columns of their own.
        for name in ("key", "n", "size", "score", "rank", "class", "component", "copies", "label", "features"):
            df = df.withColumn(name, F.lit("x"))
    return df


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
