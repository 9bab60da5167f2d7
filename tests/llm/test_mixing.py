from collections import defaultdict

import pytest

from meetledger.llm import mixing
from tests.llm.cases import awkward_rows, empty_frame, frame


def expected_targets(sizes):
    """Water filling by repeated resharing, as the rule is told."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    while True:
        open_names = [s for s in names if s not in target]
        total = sum(weight[s] for s in open_names)
        full = [s for s in open_names if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            return {**target, **{s: left * weight[s] / total for s in open_names}}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())


def test_targets_and_rounding(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", None if i % 11 == 0 else f"s{i % 5}", 0) for i in range(600)]
    got = mixing.mix(frame(spark, rows), block=4).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
    want = expected_targets(dict(sizes))
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for source, target in want.items():
        # The last document alone is off the target.
        assert abs(taken[source] - target) <= 50
    again = mixing.mix(frame(spark, rows).repartition(7), block=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_each_document_is_taken_as_often_as_expected(spark):
    """Over many sources of the same make, the share of copies is the rate, for small and large documents."""
    rows = [(i, "w " * (3 if i % 2 else 30), "en", f"s{i % 40:03}", 0) for i in range(8_000)]
    taken = defaultdict(list)
    for r in mixing.mix(frame(spark, rows, clash=False)).collect():
        taken[round(r["target"] / r["source_size"], 6), r["size"]].append(r["copies"])
    for (rate, _), copies in taken.items():
        assert sum(copies) / len(copies) == pytest.approx(rate, abs=0.12)


def test_awkward_rows(spark):
    docs = frame(spark, awkward_rows())
    got = mixing.mix(docs).collect()
    assert len(got) == len(awkward_rows())
    assert {r["taken"] for r in got if r["doc_id"] in (1_001, 1_002, 1_003)} == {0}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    size = {}
    for r in got:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["copies"]
    rows = [r["doc_id"] for r in mixed.collect()]
    assert {i: rows.count(i) for i in size} == size
    assert mixing.mix(empty_frame(spark)).collect() == []
    assert mixing.apply_mix(empty_frame(spark)).collect() == []
