import random
import re
import time

from meetledger.llm import licenses
from meetledger.llm.licenses import BASE_PHRASES, rules, scan, spans
from tests.llm.cases import awkward_rows, empty_frame, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_force(text):
    """All matches of all rules (no keyword gate), and those that no better one contains."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    line = f" {' '.join(words)} "
    base = [(k, label) for p, label in BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    found = []
    for no, _, label, priority, _, pattern in rules():
        for m in re.finditer(pattern, line):
            first = line[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), no, label, priority))
    kept = []
    for x in found:
        for y in found:
            around = y[0] <= x[0] and y[1] >= x[1] and y != x
            longer = (y[0], -y[1], y[2]) < (x[0], -x[1], x[2])
            if around and (y[4] < x[4] and (longer or (y[0], y[1]) == (x[0], x[1])) or y[4] == x[4] and longer):
                break
        else:
            kept.append(x)
    return len(words), sorted(base), sorted(kept)


def texts():
    rng = random.Random(9)
    parts = "licensed under the mit license|Apache License, Version 2.0|GNU General Public License v3|SPDX-License-Identifier: GPL-3.0-only"
    parts += "|all rights reserved|Creative Commons CC BY-NC 4.0|mit|license|general public license|foo bar|the terms of the BSD 3 clause license"
    parts += "|MIT License MIT License|in the public domain|ünder LICENSE apache license|copyright (c) 2020"
    return [" ".join(rng.choice(parts.split("|")) for _ in range(rng.randint(0, 12))) for _ in range(120)]


def test_spans_and_labels_as_by_trying_every_rule(spark):
    assert len(rules()) > 200
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    placed = {}
    for r in spans(docs).collect():
        placed.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"], r["rule"]))
    for i, text, *_ in rows:
        n, base, kept = brute_force(text)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert sorted(placed.get(i, [])) == sorted(x[:3] for x in kept), text
        assert r["labels"] == ",".join(sorted({label for _, label in base} | {x[3] for x in kept}))
        assert 0 <= r["score"] <= 1


def test_awkward_rows(spark):
    got = scan(frame(spark, awkward_rows())).collect()
    assert len(got) == len(awkward_rows())
    assert {(r["n_words"], r["labels"], r["score"]) for r in got if r["doc_id"] in (1_001, 1_002, 1_003)} == {(0, "", 0.0)}
    many = "mit license " * 300
    one = scan(frame(spark, [(1, many, None, None, None)])).first()
    assert (one["n_base"], one["first_word"], one["last_word"]) == (300, 0, 598)
    assert licenses.scan(empty_frame(spark)).collect() == []


def test_many_matches_in_one_text(spark):
    text = "Licensed under the MIT License; apache license, GNU General Public License v3. " * 12_500
    began = time.time()
    row = scan(frame(spark, [(1, text, None, None, None), (2, "MIT License", None, None, None)])).where("doc_id = 1").first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (150_000, 37_500, 3, 149_996)
    assert time.time() - began < 60
    short = "Licensed under the MIT License; apache license, GNU General Public License v3. " * 3
    one = scan(frame(spark, [(1, short, None, None, None)])).first()
    assert row["labels"] == one["labels"] and row["n_spans"] == 12_500 * one["n_spans"] / 3


def test_only_ascii_letters_are_lowered(spark):
    # The Kelvin sign would become a k, and the long dotted I two characters.
    rows = [(1, "MIT LICENſE and KMIT License İ", "en", "s", 0)]
    row = scan(frame(spark, rows)).first()
    assert (row["n_words"], row["n_base"]) == (6, 0)
