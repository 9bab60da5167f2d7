"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; every document of a source should be taken
``target / source size`` times, which is a whole part and a fraction. The fractions are
rounded in pairs: words move from one document of a pair to the other, in a random
direction that keeps each one's expectation, until one of the two is taken wholly or not
at all. What is left of a block of documents is one document with a fraction; those are
paired again, block by block, in a tree whose depth is the logarithm of the source's
size. The words of a source are kept exact all the way, so the last document alone makes
the result differ from the target: by less than its own size.

All work is in DataFrame functions. A block is a fixed number of documents on average,
dealt by a hash, so a hot source is as many tasks as it needs.

Cases: a missing text has size 0 and is taken by the whole part only (0 words); a missing
source is a source, the last one; repeated rows are separate documents; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetledger.llm.common import narrow, row_key, store, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 64
SEED = 20

_ITEM = "struct<at:bigint,doc_id:bigint,key:bigint,size:bigint,mass:double>"
_STATE = f"struct<rest:{_ITEM},done:array<struct<doc_id:bigint,key:bigint,size:bigint,mass:double>>>"


def _weighted(totals: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Each source's weight by its rank in code point order, without one task for all sources."""
    order = F.col("source").asc_nulls_last()
    dealt = store(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(table, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return dealt.join(starts, "part").select("source", "source_size", "n", weight.alias("weight"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, n, target: weighted shares, none above ``limit`` times its source.

    A level is raised until the targets ``least(limit * size, level * weight)`` use up the
    budget; each step is one aggregate over the sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = store(_weighted(totals, weights), "weights")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, None
    while True:
        full = F.col("source_size") * limit <= F.lit(level) * F.col("weight")
        count, held, open_weight = ranked.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if count == stopped or open_weight == 0:
            break
        stopped, level = count, (budget - held) / open_weight
    target = F.least(F.col("source_size") * limit, F.lit(level) * F.col("weight"))
    return store(ranked.select("source", "source_size", "n", target.alias("target")), "targets")


def _pair(state: Column, item: Column, level: int) -> Column:
    """Move words between the document carried along and the next one until one is whole."""
    rest = state["rest"]
    up = F.least(rest["size"] - rest["mass"], item["mass"])
    down = F.least(rest["mass"], item["size"] - item["mass"])
    draw = F.pmod(F.xxhash64(F.lit(SEED + level), rest["key"], item["key"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
    raised = draw * (up + down) < down
    rest_mass = F.when(raised, rest["mass"] + up).otherwise(rest["mass"] - down)
    item_mass = F.when(raised, item["mass"] - up).otherwise(item["mass"] + down)
    # The bound that was met is set as such, free of rounding.
    rest_whole = F.when(raised, up == rest["size"] - rest["mass"]).otherwise(down == rest["mass"])
    rest_mass = F.when(rest_whole, F.when(raised, rest["size"].cast("double")).otherwise(F.lit(0.0))).otherwise(rest_mass)
    item_whole = F.when(raised, up == item["mass"]).otherwise(down == item["size"] - item["mass"])
    item_mass = F.when(item_whole, F.when(raised, F.lit(0.0)).otherwise(item["size"].cast("double"))).otherwise(item_mass)

    def done(x: Column, mass: Column) -> Column:
        return F.array(F.struct(x["doc_id"].alias("doc_id"), x["key"].alias("key"), x["size"].alias("size"), mass.alias("mass")))

    def carried(x: Column, mass: Column) -> Column:
        return F.struct(
            x["at"].alias("at"), x["doc_id"].alias("doc_id"), x["key"].alias("key"), x["size"].alias("size"), mass.alias("mass")
        )

    nothing = F.lit(None).cast(_ITEM)
    rest_left = F.when(~rest_whole, carried(rest, rest_mass)).when(~item_whole, carried(item, item_mass)).otherwise(nothing)
    finished = F.concat(
        state["done"],
        F.when(rest_whole, done(rest, rest_mass)).otherwise(F.array()),
        F.when(item_whole, done(item, item_mass)).otherwise(F.array()),
    )
    paired = F.struct(rest_left.alias("rest"), finished.alias("done")).cast(_STATE)
    return F.when(rest.isNull(), F.struct(item.alias("rest"), state["done"].alias("done")).cast(_STATE)).otherwise(paired)


def _round_level(items: DataFrame, level: int, blocks: Column, last: Column) -> DataFrame:
    """One level of the tree: each block folds to whole documents and at most one fraction."""
    # Large documents pair first, so that what a block leaves open is one of its small ones.
    drawn = F.xxhash64(F.lit(SEED * 1000 + level), F.col("key"), F.col("doc_id"))
    dealt = items.withColumn("at", -F.col("size")).withColumn("block", F.pmod(drawn, blocks))
    folded = dealt.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "doc_id", "key", "size", "mass"))).alias("items"),
        F.first("blocks").alias("blocks"),
    )
    start = F.struct(F.lit(None).cast(_ITEM).alias("rest"), F.array().alias("done")).cast(_STATE)
    folded = folded.withColumn("end", F.aggregate("items", start, lambda state, item: _pair(state, item, level)))
    rest = F.col("end.rest")
    # At the root the last fraction is drawn on its own.
    draw = F.pmod(F.xxhash64(F.lit(SEED - 1), rest["key"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
    settled = F.when(last, F.when(draw * rest["size"] < rest["mass"], rest["size"].cast("double")).otherwise(F.lit(0.0)))
    left = F.struct(
        rest["doc_id"].alias("doc_id"), rest["key"].alias("key"), rest["size"].alias("size"),
        F.coalesce(settled, rest["mass"]).alias("mass"),
    )
    every = F.concat(F.col("end.done"), F.when(rest.isNotNull(), F.array(left)).otherwise(F.array()))
    return folded.select("source", "blocks", F.explode(every).alias("x")).select("source", "blocks", "x.*")


def dependent_rounding(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Round ``mass`` (0 to ``size``) to one of its bounds, keeping each source's sum.

    ``items``: source, n (documents of the source), doc_id, key, size, mass.
    """
    biggest = items.agg(F.max("n")).first()[0] or 1
    open_item = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    items = items.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.lit(1)))
    names = ("source", "doc_id", "key", "size", "mass")
    parts = [items.where(~open_item).select(*names)]
    rest, level, width = items.where(open_item).select(*names, "blocks"), 0, -(-biggest // block)
    while True:
        done = store(_round_level(rest, level, F.col("blocks"), F.col("blocks") == 1), "rounded")
        parts.append(done.where(~open_item).select(*names))
        if width <= 1:
            break
        rest = done.where(open_item).withColumn("blocks", F.ceil(F.col("blocks") / block))
        level, width = level + 1, -(-width // block)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """How often each document is taken.

    Returns doc_id, source, key, size, source_size, target, copies, taken (words).
    """
    read = narrow(docs, doc_id="long", source="string", text="string")
    sized = read.select("doc_id", "source", row_key("doc_id", "source", "text")["a"].alias("key"), word_count(F.col("text")).alias("size"))
    sized = store(sized, "sized")
    targets = source_targets(sized, weights, share, limit)
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.select("d.doc_id", "d.source", "d.key", "d.size", "n", rate.alias("rate"))
    items = joined.withColumn("mass", (F.col("rate") - F.floor("rate")) * F.col("size"))
    rounded = dependent_rounding(items.select("source", "n", "doc_id", "key", "size", "mass"), block)
    back = rounded.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    extra = F.when((F.col("r.size") > 0) & (F.col("r.mass") >= F.col("r.size")), 1).otherwise(0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    result = back.select(
        "r.doc_id", "r.source", "r.key", "r.size", "source_size", "target", (whole + extra).cast("long").alias("copies")
    )
    return result.withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it; rows of no words are not taken."""
    decided = mix(docs, **options).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies_"))
    decided = store(decided.where("copies_ > 0").select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"), "copies_"), "copies")
    names = [F.col(f"`{n}`") for n in docs.columns]
    keyed = docs.withColumn("key_", F.xxhash64(*[p for n in ("doc_id", "source", "text") for p in (F.col(n).isNull(), F.col(n))]))
    both = keyed.join(decided.hint("merge"), keyed["key_"].eqNullSafe(decided["key_"]) & keyed["doc_id"].eqNullSafe(decided["id_"]))
    both = both.drop(decided["key_"])
    # Rows that are equal in full share one number of copies.
    first = F.row_number().over(Window.partitionBy("key_", "doc_id").orderBy("key_"))
    each = both.withColumn("first_", first).where("first_ = 1")
    return each.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int")))).select(*names)
