"""N-gram Jaccard join by set relations.

A document is the set of its distinct 5-word shingles; two documents link when the
intersection holds three quarters of the union. Documents of equal sets are one class, and
only classes are compared.

Shingles are ordered by how rare their rarest word is, then by hash, and a class is listed
in the index under the first quarter of its shingles: classes that link share one of them.
Two relations between sets save work:

* *Index skipping.* The lists of a shingle are cut into blocks by size, and entries carry
  their position: a class looks only into blocks whose sizes can reach the threshold, and
  passes over entries after whose position too few shingles are left. Lists whose classes
  are all in one component already are passed over as a whole.
* *Answer skipping.* Every class is compared first with the most central classes of its
  minhash groups; the most similar of them is its leader. The overlap of two classes is
  bounded by that of their leaders and what each differs from its leader, which settles
  whole groups at once. Where it does not, the answer for a follower is derived from the
  answer for its leader and the few shingles in which the two differ.

Nothing here is approximate: minhashes only find leaders, and the order of the
shingles only changes how long lists are. Shingles are compared by 48 bits of a hash.

Cases: a text without words, or a missing one, has an empty set, links with nothing and is
its own component; fewer than five words are one shingle; a row without an id is not
linked and has no component; rows of one id are one document; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetledger.llm.common import bitmap_of, in_bitmap, narrow, small_batches, store
from meetledger.llm.components import components
from meetledger.llm.word_hashes import mix, numbers_of

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4  # of the union
LEADER_KEYS = 8
WORD_BITS = (16, 22)
ID_BITS = (20, 25)
TOKEN_BYTES = 6
FOLLOWERS = 256  # of a leader, in a chunk
MEETINGS = 64  # classes that meet one copy of a chunk
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_KEYS = np.array([(k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) | 1 for k in range(1, LEADER_KEYS + 1)], np.uint64)


def shingles(numbers: np.ndarray) -> np.ndarray:
    """One number for each run of five words; one for all words where they are fewer."""
    if len(numbers) == 0:
        return np.array([], np.uint64)
    width = min(WORDS, len(numbers))
    total = np.full(len(numbers) - width + 1, width, np.uint64)
    for k in range(width):
        total += mix(numbers[k : len(numbers) - width + 1 + k] + np.uint64(k)) * np.uint64(_ODD[k])
    return mix(total)


def _prefix(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1 if n else 0


def _rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket of words, the logarithm of the number of documents with one of them."""
    bits = int(np.clip(math.ceil(math.log2(max(docs.count(), 1))) + 2, *WORD_BITS))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for numbers in numbers_of(batch["text"]):
                seen[np.unique(numbers >> np.uint64(64 - bits)).astype(np.int64)] += 1
        at = np.flatnonzero(seen)
        for start in range(0, len(at), 50_000):
            some = at[start : start + 50_000]
            yield pd.DataFrame({"bucket": some.astype(np.int32), "n": seen[some]})

    counted = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # At most 2**bits rows, whatever the number of words.
    found = counted.select("bucket", F.floor(F.log2("n") * 2).cast("byte").alias("level")).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    levels[found["bucket"].to_numpy()] = found["level"].to_numpy()
    return levels, bits


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    short = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BYTES)
    full = np.zeros((len(short), 8), np.uint8)
    full[:, :TOKEN_BYTES] = short
    return full.view(np.uint64).ravel()


def _sets(docs: DataFrame) -> DataFrame:
    """Of each row: set size and signature, leader keys, and its index shingles in order."""
    shared = docs.sparkSession.sparkContext.broadcast(_rarity(docs))

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, bits = shared.value
        for batch in batches:
            n, a, b, keys, first = [], [], [], [], []
            for numbers in numbers_of(batch["text"]):
                every = shingles(numbers)
                level = levels[(numbers >> np.uint64(64 - bits)).astype(np.int64)]
                width = min(WORDS, len(numbers))
                rarest = np.zeros(len(every), np.uint8)
                if len(every):
                    rarest = np.lib.stride_tricks.sliding_window_view(level, width).min(axis=1)
                tokens, at = np.unique(every, return_index=True)
                n.append(len(tokens))
                with np.errstate(over="ignore"):
                    a.append(np.add.reduce(mix(tokens ^ np.uint64(1))).astype(np.uint64).view(np.int64))
                    b.append(np.add.reduce(mix(tokens ^ np.uint64(2))).astype(np.uint64).view(np.int64))
                    keys.append((tokens[None, :] * _KEYS[:, None]).min(axis=1).view(np.int64).tolist() if len(tokens) else [])
                # By rarity, then by hash: a stable sort of what is sorted by hash.
                order = np.argsort(rarest[at], kind="stable")[: _prefix(len(tokens))]
                first.append(_pack(tokens[order] >> np.uint64(64 - 8 * TOKEN_BYTES)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "a": a, "b": b, "keys": keys, "first": first})

    return docs.mapInPandas(summarize, "doc_id long, n long, a long, b long, keys array<long>, first binary")


def _reaches(x_n: Column, y_n: Column, overlap: Column) -> Column:
    return DENOMINATOR * overlap >= NUMERATOR * (x_n + y_n - overlap)


def _named_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n and tokens of the classes named in the column ``id``, from their whole texts.

    The sets are made again from the texts; a bitmap of the ids, of bounded size, keeps the
    other documents out of the shuffle.
    """
    ids = store(ids.distinct().select(F.xxhash64("id").alias("hash"), "id"), "named-ids")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select("hash"), ID_BITS, spare=16))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, bits = shared.value
        for batch in batches:
            batch = batch[in_bitmap(batch["hash"].to_numpy(np.int64), bitmap, bits)]
            sets, a = [], []
            for numbers in numbers_of(batch["text"]):
                tokens = np.unique(shingles(numbers))
                with np.errstate(over="ignore"):
                    a.append(np.add.reduce(mix(tokens ^ np.uint64(1))).astype(np.uint64).view(np.int64))
                sets.append(_pack(tokens >> np.uint64(64 - 8 * TOKEN_BYTES)))
            yield pd.DataFrame({"id": batch["doc_id"].to_numpy(), "a": np.array(a, np.int64), "tokens": sets})

    hashed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("hash"), "text")
    made = hashed.mapInPandas(make, "id long, a long, tokens binary")
    own = classes.select(F.col("class").alias("id"), "a", "n").join(ids.select("id"), "id", "left_semi")
    return store(made.join(own, ["id", "a"]).dropDuplicates(["id", "a"]).select("id", "n", "tokens"), "named-sets")


def _as(sets: DataFrame, name: str) -> DataFrame:
    return sets.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("tokens").alias(f"{name}_tokens"))


def _common(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))


def _overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """x, y, x_n, y_n and the overlap of pairs of classes."""
    pairs = store(pairs.select("x", "y").distinct(), "pairs")
    sets = _named_sets(pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))), docs, classes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_common(x, y) for x, y in zip(batch["x_tokens"], batch["y_tokens"], strict=True)]
            yield batch[["x", "y", "x_n", "y_n"]].assign(overlap=np.array(found, np.int64))

    both = pairs.join(_as(sets, "x"), "x").join(_as(sets, "y"), "y").select("x", "y", "x_n", "y_n", "x_tokens", "y_tokens")
    return store(both.mapInPandas(count, "x long, y long, x_n long, y_n long, overlap long"), "overlaps")


def _leader_pairs(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Each class with the most central class of every minhash group that it is in, sizes permitting.

    Central is a class that shares its minhashes with many others: the text that a group of
    near copies was made from, or one close to it, to which all of them are most similar.
    """
    own = sets.select("doc_id", "a", "b", "keys").join(classes, ["a", "b"]).where(F.col("doc_id") == F.col("class"))
    keyed = own.select("class", "n", F.posexplode("keys").alias("k", "key"))
    shared = store(keyed.groupBy("k", "key").agg(F.count("*").alias("size")).where("size > 1"), "minhashes")
    keyed = store(keyed.join(shared, ["k", "key"]), "minhash-groups")
    central = keyed.groupBy("class").agg(F.sum("size").alias("score"))
    scored = store(keyed.join(central, "class"), "minhash-scores")
    heads = scored.groupBy("k", "key").agg(F.max(F.struct("score", (-F.col("class")).alias("order"), "n")).alias("head"))
    heads = store(heads.select("k", "key", (-F.col("head.order")).alias("head"), F.col("head.n").alias("head_n")), "minhash-heads")
    met = scored.join(heads, ["k", "key"]).where(F.col("class") != F.col("head"))
    near = NUMERATOR * F.greatest("n", "head_n") <= DENOMINATOR * F.least("n", "head_n")
    return met.where(near).select(F.col("class").alias("x"), F.col("head").alias("y")).distinct()


def _lists(classes: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The index entries (token, class, component, n, place) of lists with several components."""
    own = classes.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
    own = own.select("a", "b", "n", "class", F.coalesce("component", "class").alias("component"))
    rows = sets.where("n > 0").select("doc_id", "a", "b", "first").join(own, ["a", "b"]).where(F.col("doc_id") == F.col("class"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 200):
                some = batch.iloc[start : start + 200]
                tokens = [_unpack(x) for x in some["first"]]
                many = [len(t) for t in tokens]
                yield pd.DataFrame(
                    {
                        "token": np.concatenate(tokens).view(np.int64), "class": np.repeat(some["class"].to_numpy(), many),
                        "component": np.repeat(some["component"].to_numpy(), many), "n": np.repeat(some["n"].to_numpy(np.int32), many),
                        "place": np.concatenate([np.arange(m, dtype=np.int32) for m in many]),
                    }
                )

    entries = rows.select("class", "component", "n", "first").mapInPandas(
        spread, "token long, class long, component long, n int, place int"
    )
    own_list = Window.partitionBy("token")
    low, high = F.min("component").over(own_list), F.max("component").over(own_list)
    mixed = entries.withColumn("low", low).withColumn("high", high).where("low < high").drop("low", "high")
    return store(mixed.dropDuplicates(["token", "class"]), "lists")


def _with_heads(lists: DataFrame, leaders: DataFrame) -> DataFrame:
    """The index entries with each class's leader (itself if it has none), and how far it is from it.

    ``own`` counts what the class has and its leader lacks.
    """
    best = F.max(F.struct(F.col("overlap") / (F.col("x_n") + F.col("y_n")), "y", "y_n", "x_n", "overlap")).alias("best")
    lead = leaders.groupBy(F.col("x").alias("class")).agg(best)
    lead = lead.select(
        "class", F.col("best.y").alias("head"),
        (F.col("best.x_n") - F.col("best.overlap")).alias("own"),
    )
    both = lists.join(store(lead, "leaders"), "class", "left")
    return store(
        both.select(
            "token", "class", "component", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"),
            F.coalesce("head", "class").alias("head"), F.coalesce("own", F.lit(0)).alias("own"),
            F.floor(F.log(F.col("n").cast("double")) / math.log(DENOMINATOR / NUMERATOR)).alias("block"),
        ),
        "led-lists",
    )


def _head_pairs(entries: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of leaders whose followers may link, with their overlap: x_head, y_head, overlap.

    All followers of a leader are passed over at once where the leaders' overlap, with all
    that any follower has beyond its leader, stays too small.
    """
    lists = entries.groupBy("token", "head").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("left"),
        F.min("block").alias("first_block"), F.max("block").alias("last_block"),
    )
    x = lists.withColumn("block", F.explode(F.sequence(F.col("first_block") - 1, F.col("last_block") + 1))).alias("x")
    y = lists.withColumn("block", F.explode(F.sequence("first_block", "last_block"))).alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.head") < F.col("y.head"))
    sizes = (DENOMINATOR * F.col("x.high") >= NUMERATOR * F.col("y.low")) & (DENOMINATOR * F.col("y.high") >= NUMERATOR * F.col("x.low"))
    left = F.least("x.left", "y.left")
    enough = (NUMERATOR + DENOMINATOR) * left >= NUMERATOR * (F.col("x.low") + F.col("y.low"))
    met = x.join(y, same & sizes & enough).select(F.col("x.head").alias("x"), F.col("y.head").alias("y"))
    known = _overlaps(met, docs, classes).select("x", "y", "overlap")
    group = store(entries.groupBy("head").agg(F.min("n").alias("low"), F.max("own").alias("own")), "leader-groups")
    for side in ("x", "y"):
        known = known.join(group.select(F.col("head").alias(side), F.col("low").alias(f"{side}_low"), F.col("own").alias(f"{side}_own")), side)
    most = F.col("overlap") + F.col("x_own") + F.col("y_own")
    known = known.where((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("x_low") + F.col("y_low")))
    return store(known.select(F.col("x").alias("x_head"), F.col("y").alias("y_head"), "overlap"), "open-leaders")


_CHUNK = "n array<long>, component array<long>, own binary, own_n array<long>, lost binary, lost_n array<long>"


def _pack_followers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A chunk of followers as flat columns: what each has of its own and what it lost, end to end."""
    for batch in batches:
        flat = []
        for followers in batch["followers"]:
            sides = {s: [f[s] or b"" for f in followers] for s in ("own", "lost")}
            counts = [[len(tokens) // TOKEN_BYTES for tokens in sides[s]] for s in ("own", "lost")]
            numbers = [[f[c] for f in followers] for c in ("n", "component")]
            flat.append((*numbers, b"".join(sides["own"]), counts[0], b"".join(sides["lost"]), counts[1]))
        columns = ["n", "component", "own", "own_n", "lost", "lost_n"]
        yield pd.concat([batch[["head", "chunk"]].reset_index(drop=True), pd.DataFrame(flat, columns=columns)], axis=1)


def _shared(x: np.ndarray, tokens: bytes, counts: np.ndarray) -> np.ndarray:
    """How many tokens of each follower, ``counts`` of them in a row, are in the set ``x``."""
    hits = np.concatenate([[0], np.cumsum(np.isin(_unpack(tokens), x))])
    ends = np.cumsum(counts)
    return hits[ends] - hits[ends - counts]


def _links_between(entries: DataFrame, heads: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (as pairs of components) between the followers of open pairs of leaders.

    Each class of the smaller group meets the followers of the other leader in chunks. Of a
    follower only the difference from its leader is kept: its answer is the leader's, less
    the shared shingles that it lost, and with those that it has of its own.
    """
    members = store(entries.select("class", "head", "n", "component", "own").distinct(), "members")
    size = members.groupBy("head").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("own").alias("most"))
    size = store(size, "member-counts")
    for side in ("x", "y"):
        sized = size.select(*[F.col(c).alias(f"{side}_{c}") for c in ("head", "size", "low", "most")])
        heads = heads.join(sized, f"{side}_head")
    smaller = F.col("x_size") <= F.col("y_size")
    pick = lambda c, one, other: F.when(smaller, F.col(f"{one}_{c}")).otherwise(F.col(f"{other}_{c}"))
    sides = heads.select(
        pick("head", "x", "y").alias("head"), pick("head", "y", "x").alias("met"), pick("low", "y", "x").alias("low"),
        pick("most", "y", "x").alias("most"), "overlap",
    )
    single = members.join(store(sides, "sides"), "head")
    bound = F.col("overlap") + F.col("own") + F.col("most")
    single = single.where((NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (F.col("n") + F.col("low")))
    single = store(single.select(F.col("class").alias("x"), F.col("component").alias("x_component"), F.col("met").alias("head")), "singles")
    followed = store(members.join(single.select("head").distinct(), "head", "left_semi").join(size.select("head", "size"), "head"), "followers")
    ids = [single.select(F.col("x").alias("id")), followed.select("class"), followed.select("head")]
    sets = _named_sets(ids[0].union(ids[1]).union(ids[2]), docs, classes)

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, lost = [], []
            for y, head in zip(batch["class_tokens"], batch["head_tokens"], strict=True):
                mine, theirs = _unpack(y), _unpack(head)
                own.append(_pack(np.setdiff1d(mine, theirs, assume_unique=True)))
                lost.append(_pack(np.setdiff1d(theirs, mine, assume_unique=True)))
            yield batch[["head", "class", "n", "component", "size"]].assign(own=own, lost=lost)

    pair = followed.join(_as(sets, "class"), "class").join(_as(sets, "head"), "head")
    pair = pair.select("head", "class", "n", "component", "size", "class_tokens", "head_tokens")
    differing = pair.mapInPandas(differ, "head long, class long, n long, component long, size long, own binary, lost binary")
    chunks = F.ceil(F.col("size") / FOLLOWERS)
    one = F.struct("class", "n", "component", "own", "lost")
    chunked = differing.groupBy("head", F.pmod(F.xxhash64("class"), chunks).alias("chunk")).agg(F.collect_list(one).alias("followers"))
    packed = store(chunked.mapInPandas(_pack_followers, f"head long, chunk long, {_CHUNK}"), "follower-chunks")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x, near = _unpack(row.x_tokens), _common(row.x_tokens, row.head_tokens)
                both = near + _shared(x, row.own, row.own_n) - _shared(x, row.lost, row.lost_n)
                reached = DENOMINATOR * both >= NUMERATOR * (row.x_n + row.n - both)
                out += [(row.x_component, c) for c in np.unique(row.component[reached]).tolist() if c != row.x_component]
            yield pd.DataFrame(sorted(set(out)), columns=["x", "y"]).astype("int64")

    # A chunk that many classes meet is copied for every so many of them, so that no task gets them all.
    meeting = store(single.groupBy("head").agg(F.ceil(F.count("*") / MEETINGS).alias("copies")), "meetings")
    counted = meeting.join(size.select("head", chunks.alias("chunks")), "head")
    part = F.pmod(F.xxhash64("x"), F.col("copies"))
    asking = single.join(counted, "head").select("x", "x_component", "head", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    asked = packed.join(meeting, "head").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asked = asked.join(_as(sets, "head").drop("head_n"), "head").drop("copies")
    met = asking.join(_as(sets, "x"), "x").join(asked, ["head", "chunk", "part"])
    met = met.select("x_component", "x_n", "x_tokens", "head_tokens", "n", "component", "own", "own_n", "lost", "lost_n")
    return store(met.mapInPandas(answer, "x long, y long"), "links-between")


def classes_and_labels(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, labels): sets by row, classes by set, and the component of each linked class."""
    small_batches(docs.sparkSession)
    read = narrow(docs, doc_id="long", text="string")
    sets = store(_sets(read), "sets")
    some = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = store(some.groupBy("a", "b", "n").agg(F.min("doc_id").alias("class")), "classes")
    leaders = _overlaps(_leader_pairs(classes, sets), read, classes)
    leaders = store(leaders.where(_reaches(F.col("x_n"), F.col("y_n"), F.col("overlap"))), "leader-links")
    labels = components(leaders)
    entries = _with_heads(_lists(classes, sets, labels), leaders)
    joined = components(_links_between(entries, _head_pairs(entries, read, classes), read, classes))
    labels = labels.select("node", F.col("component").alias("first"))
    nodes = labels.select("node").union(joined.select("node")).distinct()
    labels = nodes.join(labels, "node", "left").withColumn("first", F.coalesce("first", "node"))
    moved = joined.select(F.col("node").alias("first"), "component")
    labels = labels.join(moved, "first", "left").select("node", F.coalesce("component", "first").alias("component"))
    return sets, classes, store(labels, "components")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest id of an equal set) of every row."""
    sets, classes, labels = classes_and_labels(docs)
    own = classes.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
    own = store(own.select("a", "b", "n", "class", F.coalesce("component", "class").alias("component")), "class-components")
    rows = sets.select("doc_id", "n", "a", "b").join(own, ["a", "b", "n"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce("class", "doc_id").alias("class_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id stay."""
    linked = store(link(docs).select("doc_id", "component_id"), "linked")
    gone = linked.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    gone = store(gone.select(F.col("doc_id").alias("gone_")), "copies")
    names = [F.col(f"`{n}`") for n in docs.columns]
    kept = docs.join(gone.hint("merge"), docs["doc_id"] == gone["gone_"], "left_anti")
    with_id = linked.where(F.col("doc_id").isNotNull())
    if with_id.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept.select(*names)
    # Rows that repeat an id are one document.
    once = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return once.select(*names).union(kept.where(F.col("doc_id").isNull()).select(*names))
