import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meetledger.llm import periodic_runs as pr
from meetledger.llm.queries import op12_periodic_runs
from tests.llm.cases import awkward_rows, empty_frame, frame, sentence


def brute_force(ws, least=12):
    """All (start, length, period), by trying each period and each smaller one."""
    runs = []
    for q in range(1, len(ws) // 2 + 1):
        s = 0
        while s + q < len(ws):
            e = s + q
            while e < len(ws) and ws[e] == ws[e - q]:
                e += 1
            if e - s >= max(least, 2 * q) and not any(all(ws[k] == ws[k + r] for k in range(s, e - r)) for r in range(1, q)):
                runs.append((s, e - s, q))
            s = e - q + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def planted(doc_id, ws):
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def expected_row(doc_id, text):
    ws = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_force(ws)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)), len(ws),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_any_short_sequence(ws):
    assert pr.find_runs(np.array(ws, np.int64), 12) == brute_force(ws)
    assert pr.runs_of_texts([" ".join(map(str, ws))])[1] == [brute_force(ws)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 6)), max_size=8), st.integers(2, 12))
def test_nested_repeats(parts, least):
    ws = [w for unit, times in parts for w in unit * times]
    assert pr.find_runs(np.array(ws, np.int64), least) == brute_force(ws, least)
    assert pr.runs_of_texts([" ".join(map(str, ws)), None, " ".join(map(str, ws))], least)[1] == [brute_force(ws, least), [], brute_force(ws, least)]


def test_suffix_order():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 80)
    order, common = pr.suffix_order(ids)
    suffixes = sorted(range(80), key=lambda i: ids[i:].tolist())
    assert order.tolist() == suffixes
    for a, b, n in zip(order, order[1:], common):
        x, y = ids[a:].tolist(), ids[b:].tolist()
        assert x[:n] == y[:n] and x[: n + 1] != y[: n + 1]


def test_fibonacci_words_and_one_long_run():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert pr.find_runs(np.array(b), 12) == brute_force(b)
    began = time.time()
    assert pr.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert pr.find_runs(np.arange(100_000) % 30_000) == [(0, 100_000, 30_000)]
    assert time.time() - began < 30


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randint(0, 120)), "en", "s", 0) for i in range(150)]
    rows += [(500 + i, "\n".join(rng.choice(["a b  c", "d\te", "f"]) for _ in range(60)), "en", "s", 0) for i in range(40)]
    rows += [r for r in awkward_rows() if r[0] != 1_005] + [(77, "x " * 40 + "y", None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    expected = [expected_row(r[0], r[1]) for r in rows]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, expected))
    assert sum(r[1] > 0 for r in expected) > 40


def test_spans_and_text_of_the_operator(spark):
    docs = frame(spark, [(1, "start " + "one two three four " * 4 + "end", "en", "s", 0), (2, "a a a a a", "en", "s", 0)])
    got = {r["doc_id"]: r for r in pr.collapse(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 16, 4)] and got[1]["text"] == "start one two three four end"
    assert got[2]["runs"] == [] and got[2]["text"] == "a a a a a" and got[2]["n_words"] == 5
    got = {r["doc_id"]: r for r in pr.collapse(docs, least=4).collect()}
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 5, 1)] and got[2]["text"] == "a"


@pytest.mark.parametrize("n", [200_000])
def test_long_text(spark, n):
    rng = random.Random(1)
    text = " ".join(rng.choice("ab") for _ in range(n // 4)) + " " + " ".join(["c"] * n)
    began = time.time()
    row = pr.collapse(frame(spark, [(1, text, "en", "s", 0), (2, None, None, None, None)])).where("doc_id = 1").first()
    assert any(tuple(r) == (n // 4, n, 1) for r in row["runs"])
    assert time.time() - began < 60


def test_empty_table(spark):
    assert pr.collapse(empty_frame(spark)).collect() == []
    assert pr.digest(pr.collapse(pr.plant(empty_frame(spark)))).collect() == []
