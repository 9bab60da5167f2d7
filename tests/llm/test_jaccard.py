import random

from meetledger.llm import jaccard
from meetledger.llm.components import components
from tests.llm.cases import awkward_rows, empty_frame, frame, sentence


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def corpus(rng):
    """Texts with exact copies, chains of near copies, shared passages and random ones."""
    rows, passage = [], sentence(rng, 30)
    for _ in range(40):
        words = sentence(rng, rng.randint(3, 120)).split()
        for step in range(rng.choice([1, 1, 3, 6])):
            rows.append(" ".join(words))
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            if step % 2:
                rows.append(rows[-1].upper())
        if rng.random() < 0.4:
            rows.append(passage + " " + sentence(rng, rng.randint(5, 60)))
    rng.shuffle(rows)
    return [(i, text, "en", "s", 0) for i, text in enumerate(rows)]


def brute_force(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[:k]:
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                low, high = sorted((find(x), find(y)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_components_as_by_comparing_all_pairs(spark):
    rows = corpus(random.Random(5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(frame(spark, rows)).collect()}
    assert got == brute_force(rows)


def test_awkward_rows_and_one_kept_of_each(spark):
    rows = awkward_rows() + [(7, "same row", "en", "z", 1)]
    docs = frame(spark, rows)
    linked = jaccard.link(docs).collect()
    assert len(linked) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in linked if r["doc_id"] == 1_006} == {(1_006, 7)}
    assert [r["component_id"] for r in linked if r["doc_id"] is None] == [None]
    assert {r["n_shingles"] for r in linked if r["doc_id"] in (1_001, 1_002, 1_003)} == {0}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 7, 1_001, 1_002, 1_003, 1_004, 1_005, 1_007]


def test_empty_table(spark):
    assert jaccard.link(empty_frame(spark)).collect() == []
    assert jaccard.keep_one(empty_frame(spark)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (200, 199)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 130)}, 199: 199, 200: 199}
