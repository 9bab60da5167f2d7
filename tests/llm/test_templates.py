import random

from meetledger.llm.templates import NAME, NUMBER, UNIT, Vocabulary, canonical, contaminated, decontaminate, windows
from tests.llm.cases import awkward_rows, empty_frame, frame, sentence

ITEMS = [
    (1, "On Monday the farmer sold 12 kg of apples to Maria and 30 kg to Peter before the market closed, how much was left of 50 kg?"),
    (2, "A train leaves the old station at 9 and rides 120 km to the coast while another one waits for its driver"),
    (3, "too short"),
    (4, None),
    (5, "exactly six small words are here"),
    (6, "A train leaves the old station at 9 and rides 120 km to the coast while another one waits for its driver"),
]


def benchmark(spark):
    return spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")


def typed(text):
    words, at, _, _, held = canonical(text, Vocabulary())
    return [(words[k], int(h)) for k, h in zip(at, held, strict=True)]


def test_placeholders():
    assert typed("Ann gave Bob 3 kg. Then $5 | for Eve!") == [
        ("Ann", 0), ("gave", 0), ("Bob", NAME), ("3", NUMBER), ("kg.", UNIT), ("Then", 0), ("$", UNIT), ("5", NUMBER), ("for", 0), ("Eve!", NAME),
    ] or typed("Ann gave Bob 3 kg. Then $5 | for Eve!")[4][0].startswith("kg")
    assert typed("") == []


def found(spark, texts, **options):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(frame(spark, rows), benchmark(spark), **options).collect()}


def test_copies_reparameterised_copies_and_clean_texts(spark):
    rng = random.Random(7)
    noise = lambda: sentence(rng, 40)
    one, two = ITEMS[0][1], ITEMS[1][1]
    other = one.replace("12", "17").replace("30", "44").replace("50", "99").replace("Maria", "Olga").replace("Peter", "Ivan")
    # One and the same number of the item stands for two of the document: not a copy of it.
    clash = "On Monday the farmer sold 12 kg of apples to Maria and 30 kg to Peter before the market closed, how much was left of 12 kg?"
    texts = [f"{noise()}. {one} {noise()}", f"{noise()}. {other}", noise(), two, f"exactly six small words are here", "too short", f"too short {noise()}"]
    texts += [f"{noise()}. {clash}", " ".join(two.split()[:12]), " ".join(two.split()[:3]) + " " + noise()]
    got = found(spark, texts)
    assert set(got) == {(0, 1), (1, 1), (3, 2), (3, 6), (4, 5), (5, 3), (8, 2), (8, 6)}
    assert not got[0, 1]["changed_slots"] and got[1, 1]["changed_slots"]
    assert got[0, 1]["coverage"] == 1.0 and got[1, 1]["coverage"] == 1.0


def test_a_clashing_value_costs_only_its_windows(spark, tmp_path):
    """As the query and the pipeline ask for it."""
    from corpus_pipeline import decontamination
    from meetledger.llm.queries import op9_templates

    rng = random.Random(8)
    one = ITEMS[0][1]
    twice = "Ann pays 12 euro for bread while Bob also has 12 euro in the pocket of an old coat that hangs near the kitchen door"
    made_equal = one.replace("50 kg", "12 kg")
    changed_once = twice.replace("12", "15", 1)
    # Two values of the item become one number, and the names change.
    merged = one.replace("12", "7").replace("30", "7").replace("50", "9").replace("Maria", "Olga").replace("Peter", "Ivan")
    # The item's 12 becomes two numbers so close that every window holds one of them, and little else is left.
    apart = "Ann pays 15 euro for bread while Bob also has 16 euro in the pocket"
    texts = [made_equal, changed_once, merged, apart, sentence(rng, 40), one, twice]
    docs = frame(spark, [(i, f"{sentence(rng, 30)}. {t}", "en", "s", 0) for i, t in enumerate(texts)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, one), (2, twice)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r for r in op9_templates(spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 1), (5, 1), (6, 2)}
    assert got[2, 1]["coverage"] == 1.0 and got[1, 2]["coverage"] < 1.0 and not got[6, 2]["changed_slots"]
    assert sorted(r["doc_id"] for r in decontamination(spark, docs, str(tmp_path)).collect()) == [3, 4]


def test_awkward_rows_and_decontamination(spark):
    rows = awkward_rows() + [(7, ITEMS[1][1], "en", "s", 0), (7, ITEMS[1][1], "en", "s", 0), (None, ITEMS[1][1], "en", "s", 0)]
    docs = frame(spark, rows)
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in contaminated(docs, benchmark(spark)).collect()) == [(-1, 2), (-1, 6), (7, 2), (7, 6)]
    clean = decontaminate(docs, benchmark(spark))
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in awkward_rows())
    assert contaminated(empty_frame(spark), benchmark(spark)).collect() == []
    assert contaminated(docs, benchmark(spark).limit(0)).collect() == []


def test_every_shared_window_is_found(spark):
    """Against comparing the plain words of all windows, in texts without numbers and names."""
    rng = random.Random(9)
    pool = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(20))) for i in range(6)]
    texts = []
    for _ in range(60):
        words = [rng.choice(pool) for _ in range(30)]
        at = rng.randint(0, 12)
        texts.append(" ".join(words[:10] + rng.choice(items)[1].split()[at : at + rng.randint(0, 14)] + words[10:]))
    cut = lambda t: [tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)]
    want = {}
    for d, text in enumerate(texts):
        for i, item in items:
            n = len({k for k, w in enumerate(cut(item)) if w in set(cut(text))})
            if n >= 0.3 * len(cut(item)):
                want[d, i] = n
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(d, t, "en", "s", 0) for d, t in enumerate(texts)]
    assert {(r["doc_id"], r["item_id"]): r["windows"] for r in contaminated(frame(spark, rows), bench).collect()} == want


def test_texts_worked_on_together_give_what_each_gives_alone():
    rng = random.Random(4)
    parts = ["don't", "It's", "3", "kg", "km.", "Maria", "Bob!", "$5", "...", "|", "½", "Été", "word", "the", ".", "a.b", "5."]
    texts = ["", *(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)), "four words are here", ""]

    def listed(block, first):
        for width, of, places, hashes, slots in windows(block, [4, 5, 8], known):
            for text, place, h in zip(of.tolist(), places.tolist(), hashes.tolist(), strict=True):
                yield first + text, width, place, h, tuple(slots(text, place))

    known = Vocabulary()
    together = sorted(listed(texts, 0))
    known = Vocabulary()
    known.MOST = known.LASTING = 3  # what is forgotten is found again
    assert together == sorted(row for i, text in enumerate(texts) for row in listed([text], i))
    sizes = [len(canonical(text, known)[1]) for text in texts]
    assert len(together) == sum((n == 4) + max(n - 4, 0) + max(n - 7, 0) for n in sizes)


def test_words_met_once_are_not_kept():
    known = Vocabulary()
    first = known["Quartz"]
    assert not known and known["Quartz"] == first and list(known) == ["Quartz"]
    known.PLACES, known.seen = 4, bytearray(4)
    numbers = {f"w{i}": known[f"w{i}"] for i in range(50)}  # forgets what it has seen, again and again
    assert {word: known[word] for word in numbers} == numbers and len(known.seen) == 4


def test_a_worker_keeps_the_words_of_one_operator():
    from meetledger.llm import common, templates, token_store
    from meetledger.llm.queries import tokenizer_file

    known = templates.vocabulary()
    assert templates.vocabulary() is known
    encode = token_store.encoder(tokenizer_file())
    assert token_store.encoder(tokenizer_file()) is encode and list(common._KEPT.values()) == [encode]
    assert templates.vocabulary() is not known and len(common._KEPT) == 1


def test_documents_stay_where_they_are_when_few_are_contaminated(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{chr(97 + i)}x" for i in range(20))), (2, "other"), (3, None)], "doc_id long, text string")
    left = decontaminate(docs, docs.where("doc_id = 1").withColumnRenamed("doc_id", "item_id"))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    assert "SortMergeJoin" not in left._jdf.queryExecution().toString()
