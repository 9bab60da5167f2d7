import math
import random
import re

import pytest

from meetledger.llm import divergence
from meetledger.llm.divergence import COMMON_WORDS, js_distance
from tests.llm.cases import awkward_rows, empty_frame, frame, sentence


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\f\r")]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_as_by_definition(spark):
    rng = random.Random(4)
    small = ["a b c d", "x y z a b", "a b c", "# $x", "é ß", "\tq\rs"]
    rows = awkward_rows()
    rows += [(i, "\n".join(rng.choice(small) for _ in range(rng.randint(0, 30))), "en", "s", 0) for i in range(150)]
    rows = [r for r in rows if r[0] != 1_005]
    got = divergence.judge(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r["doc_id"] or -1, *[r[n] for n in names]) for r in got) == sorted((r[0] or -1, *base_counts(r[1])) for r in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_distance_as_by_definition(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.0, 0.4, 0.5]
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    half = lambda v: sum(x * math.log2(x / y) for x, y in zip(v, m, strict=True) if x)
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    assert df.select(js_distance(df.p, df.q)).first()[0] == pytest.approx(math.sqrt((half(p) + half(q)) / 2))
    assert df.select(js_distance(df.p, df.p)).first()[0] == 0


def prose(rng, lang, n):
    return " ".join(rng.choice(COMMON_WORDS[lang]) if rng.random() < 0.4 else sentence(rng, 1).rstrip("0123456789") for _ in range(n))


def test_unlike_texts_go_and_like_ones_stay(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, ("en", "de")[i % 2], 150), ("en", "de")[i % 2], "s", 0) for i in range(60)]
    rows += [(100, prose(rng, "en", 150).upper(), "en", "s", 0), (101, re.sub(" ", "### ", prose(rng, "de", 150)), "de", "s", 0)]
    rows += [(102, prose(rng, "en", 60), "en", "s", 0)]
    kept = {r["doc_id"]: r["kept"] for r in divergence.judge(frame(spark, rows)).collect()}
    assert [i for i, ok in kept.items() if not ok] == [100, 101]


def test_empty_table(spark):
    assert divergence.judge(empty_frame(spark)).collect() == []
