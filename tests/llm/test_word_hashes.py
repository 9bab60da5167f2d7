import random

import numpy as np

from meetledger.llm import word_hashes


def test_equal_words_and_only_they_have_equal_numbers(monkeypatch):
    rng = random.Random(7)
    alphabet = ["a", "B", "b", "ab", "zz", "Z", "é", "漢", "\ud800", " ", "\n", "\x0b", "\t ", "\x1c", "\x85", "\xa0", "1", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "x" * 5_000, "x" * 5_001]
    rng.shuffle(texts)
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    for block in (1, 50, 1 << 20):
        monkeypatch.setattr(word_hashes, "BLOCK_BYTES", block)
        numbers = [n.tolist() for n in word_hashes.numbers_of(texts)]
        assert [len(n) for n in numbers] == [len(w) for w in words]
        pairs = {(w, n) for ws, ns in zip(words, numbers) for w, n in zip(ws, ns)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({n for _, n in pairs})
    assert list(word_hashes.numbers_of([])) == []


def test_numbers_do_not_depend_on_the_place():
    one = next(word_hashes.numbers_of(["alpha beta"]))
    two = list(word_hashes.numbers_of(["x" * 999, "gamma BETA  alpha"]))[1]
    assert np.array_equal(one[::-1], two[1:])
