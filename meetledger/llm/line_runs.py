"""Line dedup by a suffix array over line ids.

The corpus is one sequence of line ids for each document. Lines that occur once cannot be
in a repeated run, so they cut the sequences into stretches; blank lines are passed over.
The suffixes of the stretches are ordered by prefix doubling: their rank by 2k lines is the
rank of the pair (rank by k lines here, rank by k lines k lines on). Each round sorts the
distinct pairs over range partitions and adds up where each begins in the suffix array; the
pairs are few where lines repeat most.

Suffixes that share a prefix are neighbours in that order: an interval of a longest common
prefix of at least so many lines. The intervals looked at are those of the shortest
prefixes with ``MIN_WORDS`` words, and likewise those of the shortest runs with as many
words that end at a line; together they cover every maximal repeated run of ``MIN_WORDS``
words or more. Of each interval the first occurrence (by doc_id, then place) stays, and the
lines of all later ones are deleted. Two of the doubled ranks, overlapping, name a prefix of
any length, so the doubling stops at the longest of these prefixes.

All work is in DataFrame functions. A line is carried as 128 bits of hash.

Cases: a missing or empty text has no lines and stays as it is (a missing one is empty);
repeated rows (equal id and text) are one document and get the same result; a missing id
is the last in order; a run that overlaps its own copy keeps its first lines only; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetledger.llm.common import WHITE, narrow, store, word_count

MIN_WORDS = 50
_DOC = ["doc_id", "key"]


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))


def corpus_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, place (among the lines that are not blank), line (its number), a and b (hashes), words."""
    read = narrow(docs, doc_id="long", text="string").where(F.col("text").isNotNull())
    each = read.select("doc_id", _key().alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    each = each.where(F.btrim("content", F.lit(WHITE)) != "")
    each = each.select(
        *_DOC, "line", F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b"), word_count(F.col("content")).alias("words")
    )
    order = Window.partitionBy(*_DOC).orderBy("line")
    return store(each.dropDuplicates([*_DOC, "line"]).withColumn("place", F.row_number().over(order)), "lines")


def _ranks(values: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values with the place in the suffix array where each one's suffixes begin."""
    counted = values.groupBy(*columns).agg(F.count("*").alias("n"))
    dealt = store(counted.repartitionByRange(*columns).withColumn("part", F.spark_partition_id()), "ranges")
    # One row for each range partition.
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.sum("n").alias("total")).select("part", before.alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1))
    ranked = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, "part")
    return store(ranked.select(*columns, (F.col("before") + F.col("inside")).alias("rank")), "ranks")


def suffix_array(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The repeated lines with their stretch, the ranks by 1, 2, 4, ... lines, and the run lengths.

    ``ahead`` (``behind``) is the number of lines in the shortest run with ``min_words``
    words that starts (ends) at the line; null where the stretch is too short.
    """
    repeated = store(lines.groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated-lines")
    active = lines.join(repeated, ["a", "b"])
    stretch = F.col("place") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("place"))
    active = active.withColumn("stretch", stretch)
    along = Window.partitionBy(*_DOC, "stretch").orderBy("place")
    active = active.withColumn("upto", F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    active = active.withColumn("from", F.col("upto") - F.col("words"))
    to_right = Window.partitionBy(*_DOC, "stretch").orderBy("from").rangeBetween(0, min_words - 1)
    to_left = Window.partitionBy(*_DOC, "stretch").orderBy("upto").rangeBetween(-(min_words - 1), 0)
    for name, frame in (("ahead", to_right), ("behind", to_left)):
        active = active.withColumn(name, F.when(F.sum("words").over(frame) >= min_words, F.count("*").over(frame)))
    active = store(active.select(*_DOC, "line", "place", "stretch", "a", "b", "ahead", "behind"), "stretches")

    longest = active.agg(F.greatest(F.coalesce(F.max("ahead"), F.lit(1)), F.coalesce(F.max("behind"), F.lit(1)))).first()[0] or 1
    ranked = active.join(_ranks(active, ["a", "b"]), ["a", "b"]).drop("a", "b")
    ranked = store(ranked.withColumn("ranks", F.array("rank")), "suffixes")
    width = 1
    while 2 * width <= longest:
        pairs = ranked.withColumn("next", F.coalesce(F.lead("rank", width).over(along), F.lit(-1)))
        pairs = store(pairs.withColumnRenamed("rank", "here"), "rank-pairs")
        ranked = pairs.join(_ranks(pairs, ["here", "next"]), ["here", "next"]).drop("here", "next")
        ranked = store(ranked.withColumn("ranks", F.concat("ranks", F.array("rank"))), "suffixes")
        width *= 2
    return ranked


def later_copies(suffixes: DataFrame) -> DataFrame:
    """doc_id, key, start (place) and length of every run that occurs earlier in the corpus."""
    ahead = suffixes.where(F.col("ahead").isNotNull()).select(*_DOC, F.col("place").alias("start"), F.col("ahead").alias("length"))
    behind = suffixes.where(F.col("behind").isNotNull())
    behind = behind.select(*_DOC, (F.col("place") - F.col("behind") + 1).alias("start"), F.col("behind").alias("length"))
    runs = ahead.union(behind).distinct().withColumn("level", F.floor(F.log2(F.col("length").cast("double")) + 1e-9).cast("int"))
    tail = F.col("start") + F.col("length") - F.call_function("shiftleft", F.lit(1), F.col("level"))
    runs = runs.withColumn("tail", tail)
    at = suffixes.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "place", "ranks")
    for name, place in (("head_rank", "start"), ("tail_rank", "tail")):
        here = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col(place) == F.col("place"))
        runs = runs.join(at, here).withColumn(name, F.get("ranks", F.col("level"))).drop("d", "k", "place", "ranks")
    runs = store(runs, "runs")
    interval = ["length", "head_rank", "tail_rank"]
    # A missing id is the last in order.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    groups = runs.groupBy(*interval).agg(F.min(order).alias("first"), F.count("*").alias("members")).where("members > 1")
    groups = store(groups, "intervals")
    return runs.join(groups, interval).where(order != F.col("first")).select(*_DOC, "start", "length")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, and per document the removed lines as ranges of line numbers, and their number and words."""
    lines = corpus_lines(docs)
    runs = later_copies(suffix_array(lines, min_words))
    places = runs.select(*_DOC, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    own = lines.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("place").alias("p"), "line", "words")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("place") == F.col("p"))
    gone = places.join(own, same).select(*_DOC, "line", "words")
    # Neighbouring lines make one range.
    run = F.col("line") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("line"))
    ranges = gone.withColumn("run", run).groupBy(*_DOC, "run").agg(
        F.min("line").alias("start"), F.max("line").alias("end"), F.count("*").alias("n"), F.sum("words").alias("words")
    )
    found = ranges.groupBy(*_DOC).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"), F.sum("n").alias("removed_lines"), F.sum("words").alias("removed_words")
    )
    return store(found, "removed-lines")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the text without later copies of repeated runs, and what was removed."""
    gone = removed_lines(docs, min_words).withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k")
    read = narrow(docs, doc_id="long", text="string").withColumn("key", _key())
    # The same plan at every size: a small run must not hide what the join moves.
    both = read.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("ranges", lambda r: (r["start"] <= i) & (i <= r["end"])))
    text = F.when(F.col("ranges").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return both.select(
        "doc_id", text.alias("text"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"),
        F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
    )
