from meetledger.llm.site_style import Page, extract, style_tree
from tests.llm.cases import sentence
import random


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note --><div class="ad">Buy</div>
<div id="cookie-notice">Accept</div><aside><p>Side</p></aside>
<article><header><h1>Title &amp;  more</h1></header><p><b>Bold start<p>Second&nbsp;one &#233;&lt;x&gt;
 line</p><ul><li>first<li>second</ul>loose <i>text</i> here<form><input><label>Name</label></form>
<section class="comments"><p>Nice!</p></section></article><footer>&copy; host</footer></body></html>"""


def test_one_page():
    assert [t for _, t in Page(HTML).blocks] == [
        "Title & more", "Bold start", "Second one é<x> line", "first", "second", "loose text here",
    ]


def test_template_branches_go_and_articles_stay(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        body = [sentence(rng, 6) for _ in range(rng.randint(1, 4))]
        promo = f'<div class="x{i % 2}box"><p>Our best offers of the week</p></div>'
        html = f"<body><div class=top><p>All about us</p></div><div class=main>{''.join(f'<p>{b}</p>' for b in body)}</div>{promo}</body>"
        rows.append((i, f"https://One.org/{i}", html))
        want[i] = "\n".join(body)
    few = "<body><div class=top><p>All about us</p></div><div class=main><p>Own words</p></div></body>"
    rows.append((90, "https://small.org/", few))
    want[90] = "All about us\nOwn words"
    got = {r["page_id"]: r for r in extract(pages(spark, rows)).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_importance_as_by_definition(spark):
    rows = [(i, "h", f"<body><p class=a>{'same' if i < 4 else i}</p></body>", "one.org") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    tree = {r["path"]: r for r in style_tree(df).collect()}
    # Counts 4, 1, 1, 1, 1 of 8 pages: entropy 2 bits of 3; the look is the same on all pages.
    row = tree["/body/p.a"]
    assert (row["n_pages"], round(row["text_importance"], 6), row["look_importance"]) == (8, round(2 / 3, 6), 0.0)


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain text"), (3, "x", "plain text"), (None, "https://a.org", "<p>a<p>b</b></i>"), (4, "y", "<<<>&#xZZ;<p")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract(pages(spark, rows)).collect()]
    assert len(got) == 6
    assert {(1, "", 0), (2, "", 0), (3, "plain text", 10), (None, "a\nb", 3)} <= set(got)
    long_page = "<p>" + "word " * 50_000
    assert extract(pages(spark, [(5, "z", long_page)])).first()["n_chars"] == 249_999
    assert extract(pages(spark, []).limit(0)).collect() == []


def page_of(*paragraphs):
    return f"<html><body><div class=top><p>All about us</p></div><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article></body></html>"


def test_copies_of_a_page_are_one_page(spark):
    rng = random.Random(5)
    rows = [(i, "https://eight.org/x", page_of("The same words", "on all pages")) for i in range(8)]
    want = {i: "All about us\nThe same words\non all pages" for i in range(8)}
    copied = sentence(rng, 9)
    for i in range(100, 3_100):
        rows.append((i, f"https://hot.org/{i}", page_of(copied)))
        want[i] = copied
    for i in range(4_000, 4_200):
        body = sentence(rng, 8) + f" {i}"
        rows.append((i, f"https://hot.org/{i}", page_of(body)))
        want[i] = body
    assert {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()} == want


def test_branches_that_hold_articles_stay(spark):
    """Most pages have a fixed notice where others have their article; the low branch above both stays."""
    rows, want = [], {}
    for i in range(300):
        # The side note tells the pages apart.
        own = f"<article><p>Story number {i}</p></article>" if i < 20 else "<p>Nothing here yet</p>"
        rows.append((i, f"https://a.org/{i}", f"<body><div class=main>{own}</div><div class=note>Note {i}</div></body>"))
        want[i] = f"Story number {i}\nNote {i}" if i < 20 else f"Note {i}"
    assert {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()} == want


def furnished(i, rng):
    words = [sentence(rng, 7) for _ in range(rng.randint(1, 3))]
    story = "".join(f"<p>{w}</p>" for w in words)
    html = (
        f"<body><header><h2>The Site</h2></header><nav><ul><li>Start</li><li>News</li></ul></nav><div class=zq1>Cheap shoes</div>"
        f"<article><h1>Title {i}</h1>{story}<span>by hand</span></article><div class=zq2><p>We use crumbs</p></div><footer>All rights</footer></body>"
    )
    return html, "\n".join([f"Title {i}", *words, "by hand"])


def test_the_tree_alone_finds_furniture(spark):
    """Without any meaning of elements and names, on a host with pages enough; a small host keeps all."""
    rng = random.Random(8)
    made = [furnished(i, rng) for i in range(30)]
    rows = [(i, f"https://big.org/{i}", html) for i, (html, _) in enumerate(made)]
    rows += [(100 + i, f"https://small.org/{i}", html) for i, (html, _) in enumerate(made[:3])]
    got = {r["page_id"]: r for r in extract(pages(spark, rows), meaning=False).collect()}
    for i, (_, want) in enumerate(made):
        # Loose words in the article are on its path, which is important.
        assert got[i]["text"] == want
        assert (got[i]["n_by_style"], got[i]["n_by_meaning"]) == (6, 0)
    assert all("Cheap shoes" in got[100 + i]["text"] and got[100 + i]["n_by_style"] == 0 for i in range(3))
    named = {r["page_id"]: r for r in extract(pages(spark, rows)).collect()}
    assert all(named[i]["text"] == want and named[i]["n_by_style"] == 6 and named[i]["n_by_meaning"] == 0 for i, (_, want) in enumerate(made))
    assert all((named[100 + i]["n_by_style"], named[100 + i]["n_by_meaning"]) == (0, 4) for i in range(3))


def entropy_share(values):
    from collections import Counter
    from math import log2

    counts, n = Counter(values).values(), len(values)
    return 1.0 if n < 2 else -sum(c / n * log2(c / n) for c in counts) / log2(n)


def test_removal_as_by_a_tree_in_memory(spark):
    """Random pages against a tree of sets: importance of every path, branches without anything important."""
    rng = random.Random(21)
    rows = []
    for i in range(60):
        def branch(depth, rng=rng):
            if depth == 3:
                text = rng.choice(["same", "same", "same", "other", sentence(rng, 3)]) if rng.random() < 0.7 else "fixed"
                return f"<p class={rng.choice('ab')}>{text}</p>"
            return "".join(f"<div class={c}>{branch(depth + 1)}</div>" for c in "xyz" if rng.random() < 0.7)
        rows.append((i, f"https://h{i % 2}.org/", f"<body>{branch(0)}</body>"))
    parsed_pages = {}
    for i, url, html in rows:
        parsed_pages[i] = (url, Page(html))
    want = {}
    for host in ("https://h0.org/", "https://h1.org/"):
        distinct = {tuple(p.blocks): p for u, p in parsed_pages.values() if u == host}.values()
        looks, texts = {}, {}
        for p in distinct:
            below = {}
            for path, text in p.blocks:
                parts = path.split("/")
                for k in range(2, len(parts) + 1):
                    below.setdefault("/".join(parts[:k]), set()).add(text)
            for path, found in below.items():
                looks.setdefault(path, []).append(tuple(p.children.get(path, ())))
                texts.setdefault(path, []).append(frozenset(found))
        low = {path for path in texts if len(texts[path]) >= 8 and max(entropy_share(looks[path]), entropy_share(texts[path])) < 0.5}
        gone = {path for path in low if not any(other.startswith(path + "/") and other not in low for other in texts)}
        for i, (u, p) in parsed_pages.items():
            if u == host:
                want[i] = "\n".join(t for path, t in p.blocks if path not in gone)
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows), min_importance=0.5).collect()}
    assert got == want
    assert sum(len(w) for w in want.values()) < sum(len(t) + 1 for _, p in parsed_pages.values() for _, t in p.blocks) - 60


def test_time_is_linear():
    from time import perf_counter

    inline = "<p>" + "<i class=x>w</i> " * 60_000
    nested = "<div>word " * 60_000
    stray = "<b>" + "<table>" + "<x>" * 40_000 + "</b></q></i>" * 60_000
    unclosed = "<b>" * 60_000 + "<br>" * 60_000 + "<p>end"
    for html in (inline, nested, stray, unclosed):
        start = perf_counter()
        Page(html)
        assert perf_counter() - start < 10
    assert len(Page(nested).blocks) == 60_000


def test_names_with_signs_of_the_format():
    page = Page('<div class="a/b"><p id="\x00">one\x01two</p></div>' + f"<div class={'k' * 500}>x</div>")
    assert [t for _, t in page.blocks] == ["one\x01two", "x"]
    assert all(len(path) < 200 for path, _ in page.blocks)
