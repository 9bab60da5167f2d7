import random

from meetledger.llm import line_runs
from tests.llm.cases import awkward_rows, empty_frame, frame, sentence


def brute_force(rows, min_words):
    """Delete every run of ``min_words`` words that some earlier place has too, line by line."""
    docs = [(i, [line for line in t.split("\n") if line.split()], t) for i, t in sorted(rows)]
    first, runs = {}, []
    for i, lines, _ in docs:
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += len(lines[e].split())
                if words >= min_words:
                    content = tuple(lines[s : e + 1])
                    first.setdefault(content, (i, s))
                    runs.append((i, s, e, content))
    gone = {(i, k) for i, s, e, content in runs if first[content] != (i, s) for k in range(s, e + 1)}
    result = {}
    for i, _, text in docs:
        kept, place = [], 0
        for line in text.split("\n"):
            if not line.split() or (i, place) not in gone:
                kept.append(line)
            place += bool(line.split())
        result[i] = "\n".join(kept)
    return result


def test_as_by_all_runs(spark):
    rng = random.Random(8)
    pool = [sentence(rng, rng.choice([1, 2, 4, 9, 15])) for _ in range(14)]
    rows = []
    for i in range(60):
        lines = []
        while len(lines) < rng.randint(1, 25):
            at = rng.randrange(len(pool))
            lines += rng.choice([[sentence(rng, rng.randint(1, 9))], [""], pool[at : at + rng.randint(1, 8)]])
        rows.append((i, "\n".join(lines)))
    for min_words in (10, 25):
        docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
        got = {r["doc_id"]: r["text"] for r in line_runs.dedup(docs, min_words).collect()}
        assert got == brute_force(rows, min_words)


def test_ranks_follow_the_order_of_suffixes(spark):
    rng = random.Random(2)
    pool = ["aa bb", "cc", "dd ee ff"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(12)), "en", "s", 0) for i in range(6)]
    suffixes = line_runs.suffix_array(line_runs.corpus_lines(frame(spark, rows)), 12).collect()
    numbers = {r["a"]: r for r in line_runs.corpus_lines(frame(spark, rows)).select("a", "b", "doc_id", "line").collect()}
    assert len(numbers) == 3
    lines = {(r["doc_id"], r["line"]): (r["a"], r["b"]) for r in line_runs.corpus_lines(frame(spark, rows)).collect()}
    depth = 2 ** (len(suffixes[0]["ranks"]) - 1)
    content = lambda r: [lines[r["doc_id"], k] for k in range(r["line"], min(r["line"] + depth, 12))]
    ordered = sorted(suffixes, key=lambda r: r["rank"])
    contents = [content(r) for r in ordered]
    assert contents == sorted(contents)
    assert [r["rank"] for r in ordered] == [contents.index(c) for c in contents]


def test_awkward_rows(spark):
    passage = sentence(random.Random(1), 60)
    rows = awkward_rows() + [(5, passage, "en", "s", 0), (6, "own\n" + passage, "en", "s", 0), (None, passage, "en", "s", 0)]
    got = [(r["doc_id"], r["text"], r["removed_words"]) for r in line_runs.dedup(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert (5, passage, 0) in got and (6, "own", 60) in got and (None, "", 60) in got
    assert (1_001, "", 0) in got and (1_003, " \n\t \n", 0) in got
    assert line_runs.dedup(empty_frame(spark)).collect() == []
