"""Quality rules: divergence of a text's character and common-word histograms from its language.

Every text is counted into two histograms: character classes, and the common words of its
language. The histograms of a language, summed over all its texts that pass the base
rules, are its reference. A text is dropped when the Jensen-Shannon distance (the root of
the divergence in bits) to a reference is over a limit. Short texts have rough histograms,
so each distance counts from a least number of words on only.

The counts of a row are made in the row, in DataFrame functions; the references are five
rows at most (one for each language with a word list, one for all others), which is what
makes broadcasting them safe. Repeated 3-word windows are compared by 64-bit hashes.

Cases: a missing or empty text counts zero everywhere and fails the base rules; an unknown
or missing language shares one reference and has no common words; repeated rows are judged
separately; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger.llm.common import UPPER, WHITE, narrow, store, words

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in is was for that with as it on be at by from are this or".split(),
    "de": "der die und das den von zu in mit ist im für dem ein eine auf des nicht sich als".split(),
    "fr": "de la le les et des un une en du est que dans pour pas sur qui par au avec".split(),
    "es": "de la que el en y los se del las un por con no una su para es lo como".split(),
}
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
PUNCTUATION = ".,;:!?'\"()-"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CHAR_MIN_WORDS, CHAR_LIMIT = 80, 0.16
WORD_MIN_WORDS, WORD_LIMIT = 100, 0.40


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words in 3-word windows that occur twice or more in the text."""
    w, i = F.col("w"), F.col("i_")
    df = df.withColumn("i_", F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("h_", F.transform(i, lambda k: F.xxhash64(F.get(w, k - 1), F.get(w, k), F.get(w, k + 1))))
    repeats = F.size(F.array_distinct("h_")) < F.size("h_")
    zipped = F.arrays_zip(F.col("h_").alias("h"), i.alias("i"))
    df = df.withColumn("s_", F.when(repeats, F.sort_array(zipped)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("s_")

    def twin(x: Column, k: Column) -> Column:
        before = F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
        return before | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(
        starts, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"]
    )
    return df.withColumn("n_repeat_words", total.cast("long")).drop("i_", "h_", "s_")


def _common_counts(language: Column, spaced: Column) -> Column:
    """Occurrences of each common word of the language, in a text with two blanks between words."""

    def count(word: str) -> Column:
        gone = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(f" {word} "), F.lit("")))
        return (gone / (len(word.encode()) + 2)).cast("long")

    chosen = F.array().cast("array<bigint>")
    for name, listed in COMMON_WORDS.items():
        chosen = F.when(language == name, F.array(*[count(w) for w in listed])).otherwise(chosen)
    return chosen


def histograms(docs: DataFrame) -> DataFrame:
    """doc_id, language, the base counts, and the two histograms as arrays."""
    df = narrow(docs, doc_id="long", text="string", lang="string").withColumn("text", F.coalesce("text", F.lit("")))
    language = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("other"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.select(
        "doc_id", "text", language.alias("language"), words(F.col("text")).alias("w"), lines.alias("lines"),
        # Small letters go first: what is left is short, and counted class by class.
        F.regexp_replace("text", "[a-z]+", "").alias("rest"),
        F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "  "), F.lit(" ")).alias("spaced"),
    )
    df = _repeat_words(df)
    rest, chars = F.col("rest"), F.length("text")
    white, symbols = _without(rest, WHITE), _without(rest, SYMBOLS)
    upper, digits, marks = _without(rest, UPPER), _without(rest, DIGITS), _without(rest, PUNCTUATION)
    beyond = F.length(F.regexp_replace(rest, r"[\x00-\x7F]+", ""))
    df = df.select(
        "doc_id", "language", F.size("w").cast("long").alias("n_words"), (chars - white).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        chars.alias("n_all"), (chars - F.length(rest)).alias("n_lower"), white.alias("n_white"), upper.alias("n_upper"),
        digits.alias("n_digits"), marks.alias("n_marks"), beyond.alias("n_beyond"),
        _common_counts(F.col("language"), F.col("spaced")).alias("common"),
    )
    counted = [F.col(n) for n in ("n_lower", "n_white", "n_upper", "n_digits", "n_marks", "n_symbols", "n_beyond")]
    others = F.col("n_all") - sum(counted, F.lit(0))
    seen = F.aggregate("common", F.lit(0).cast("bigint"), lambda a, x: a + x)
    bins = F.concat(F.array(F.greatest(F.col("n_words") - seen, F.lit(0)).cast("bigint")), F.col("common"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select(
        "doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.array(*[c.cast("bigint") for c in (*counted, others)]).alias("char_bins"), bins.alias("word_bins"),
    )


def references(counted: DataFrame) -> DataFrame:
    """The summed histograms of each language, over all texts that pass the base rules."""

    def summed(name: str, n: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0)) for k in range(n)])

    longest = max(map(len, COMMON_WORDS.values())) + 1
    good = counted.where(~F.col("base_failed"))
    return good.groupBy("language").agg(summed("char_bins", 8).alias("char_ref"), summed("word_bins", longest).alias("word_ref"))


def shares(bins: Column) -> Column:
    total = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x)
    return F.transform(bins, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: 0 for equal, 1 for disjoint ones."""

    def bits(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def part(x: Column, y: Column) -> Column:
        a, b = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        return (bits(a, (a + b) / 2) + bits(b, (a + b) / 2)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _distances(counted: DataFrame, refs: DataFrame) -> DataFrame:
    """The two distances of each text to its language; null below the least length."""
    both = counted.join(F.broadcast(refs), "language", "left")
    enough = {
        "char": (F.col("n_words") >= CHAR_MIN_WORDS) & F.col("char_ref").isNotNull(),
        "word": (F.col("n_words") >= WORD_MIN_WORDS) & F.col("word_ref").isNotNull() & (F.col("language") != "other"),
    }
    for name, guard in enough.items():
        distance = js_distance(shares(F.col(f"{name}_bins")), shares(F.col(f"{name}_ref")))
        both = both.withColumn(f"{name}_distance", F.when(guard, distance))
    return both


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The counts of each text, its two distances (null below the least length), and the verdict.

    Junk bends a reference that is summed over everything, so the references are made
    twice: the second time from the texts that are within the limits of the first.
    """

    def far() -> Column:
        over = F.coalesce(F.col("char_distance") > char_limit, F.lit(False))
        return over | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))

    counted = store(histograms(docs), "histograms")
    near = _distances(counted, references(counted)).where(~far())
    both = _distances(counted, references(near))
    return both.select(
        "doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far()).alias("kept"), "char_distance", "word_distance",
    )
