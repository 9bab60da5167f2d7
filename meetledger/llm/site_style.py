"""HTML extraction by site style trees.

The pages of a host are merged into one tree over all their content: menus, notices and adverts
as well as articles. A node of a page is known by its path: tags with their class, id and role
from the root down. For every path of a host two things are counted over its pages: how the
node's children look (its presentation), and what text is below it (its content). Both spread
out over many values, evenly, where authors write; they repeat where a template does. The
entropies, scaled to 0 to 1 by the number of pages, are the importance of the path. Branches of
low importance are removed from each page.

The tree cannot see furniture that differs from page to page (reader comments, adverts in
turn), nor that of a host with few pages. So elements that by their meaning are no article go
too (``meaning=False`` leaves everything to the tree). Their branches are rated apart from the
others: a varied comment below a menu does not keep the menu, and neither keeps the branch that
both stand in. Only what has no text to show (scripts, styles, form fields, media) is dropped
before the tree is built.

Copies say nothing about a template: pages of a host with the same blocks count as one.
The importance of a path counts where the host has ``MIN_PAGES`` different pages with that path.
A branch that holds a path of its own importance, or one met too seldom to tell, stays;
only the low branches in it go.

A page is parsed once, in time linear in its length, and stored: its blocks packed, its nodes as
arrays. Nodes are counted by (host, path, value), with partial sums before the shuffle; removed
paths meet the nodes of the pages by (host, path), so that no list of a host is ever built. Both
are ordinary joins and aggregations, in which Spark splits a hot host.

Cases: missing or empty html gives an empty text; a missing url is a host of its own, ``""``;
unclosed, crossed and unknown tags are tolerated; what is nested deeper than ``MAX_DEPTH`` is
rated with its ancestor there; repeated rows are extracted separately and count as one page; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bz2
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetledger.llm.common import LOWER, UPPER, narrow, small_batches, store

# HTML elements by what they do to a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(
    "head script style noscript template title iframe object embed svg canvas audio video map form button select option "
    "textarea input label".split()
)
MEANING = frozenset("nav footer aside menu dialog".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style".split())
# Words in a class, id or role that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "footer login menu modal nav navbar navigation newsletter notice pagination popup promo related replies reply respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}
CLOSED_BY |= {"tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
INLINE_SCOPE = frozenset("b i em strong u s small big font span a code sub sup mark q cite abbr tt".split())

BARRIERS = frozenset("td th table article body".split())

MIN_PAGES = 8
MIN_IMPORTANCE = 0.3
MAX_DEPTH, MAX_LABEL = 64, 80
_NAME = re.compile(r"[a-z0-9]+")


_KEPT, _FURNITURE, _NO_TEXT = range(3)


class Page(HTMLParser):
    """A page as blocks of text, each with the path of its element, and the looks of its nodes.

    ``blocks`` are what the page says, ``furniture`` what goes by its meaning.
    """

    def __init__(self, html: str, meaning: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.meaning = meaning
        self.open: list[tuple[str, str, int, int]] = [("", "", 0, _KEPT)]  # tag, path, depth of the path, kind
        # Places in ``open``: of each tag, of elements that make blocks, that stop end tags, that are not inline.
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.barriers: list[int] = []
        self.solid: list[int] = []
        self.blocks: list[tuple[str, str]] = []
        self.furniture: list[tuple[str, str]] = []
        self.children: dict[str, list[str]] = {}
        self.parts: list[str] = []
        self.inked = False
        self.at = ""
        self.other_parts: list[str] = []
        self.other_at = ""
        self.feed(html)
        self.close()
        self._break()

    def _break(self) -> None:
        for at, parts, blocks in ((self.at, self.parts, self.blocks), (self.other_at, self.other_parts, self.furniture)):
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((at, text))
        self.parts, self.other_parts, self.inked = [], [], False

    def _pop(self, depth: int) -> None:
        if self.block_places and self.block_places[-1] >= depth:
            self._break()
        for tag, *_ in self.open[depth:]:
            self.places[tag].pop()
        del self.open[depth:]
        for places in (self.block_places, self.barriers, self.solid):
            while places and places[-1] >= depth:
                places.pop()

    def _push(self, tag: str, path: str, depth: int, kind: int) -> None:
        place = len(self.open)
        self.open.append((tag, path, depth, kind))
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.block_places.append(place)
        if tag in BARRIERS:
            self.barriers.append(place)
        if tag not in INLINE_SCOPE:
            self.solid.append(place)

    def _kind(self, tag: str, marks: str) -> int:
        if tag in NO_TEXT:
            return _NO_TEXT
        if not self.meaning:
            return _KEPT
        names = _NAME.findall(marks)
        # A header is the page's, unless it stands in the article.
        of_page = (tag == "header" or "header" in names) and not (self.places.get("article") or self.places.get("main"))
        return _FURNITURE if of_page or tag in MEANING or not FURNITURE.isdisjoint(names) else _KEPT

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        if self.solid and tag in CLOSED_BY.get(self.open[self.solid[-1]][0], ()):
            self._pop(self.solid[-1])
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
        label = (f"{tag}.{marks}" if marks else tag).replace("/", "|")
        if len(label) > MAX_LABEL:
            label = f"{label[:MAX_LABEL]}~{zlib.crc32(label.encode('utf-8', 'replace')):08x}"
        _, path, depth, above = self.open[-1]
        kind = max(above, self._kind(tag, marks))
        if kind != _NO_TEXT:
            self.children.setdefault(path, []).append(label)
        if tag in BLOCKS:
            self._break()
        if tag in VOID:
            if tag in ("br", "wbr"):
                (self.parts if above == _KEPT else self.other_parts).append(" ")
            return
        self._push(tag, f"{path}/{label}" if depth < MAX_DEPTH else path, depth + 1, kind)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag and tag not in BLOCKS:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        places = self.places.get(tag)
        if places and not (tag in INLINE_SCOPE and self.barriers and self.barriers[-1] > places[-1]):
            self._pop(places[-1])

    def handle_data(self, data: str) -> None:
        tag, _, _, kind = self.open[-1]
        if kind == _NO_TEXT or tag in RAW:
            return
        if kind == _FURNITURE:
            at = self.open[self.solid[-1]][1] if self.solid else ""
            if at != self.other_at:
                text = " ".join("".join(self.other_parts).split())
                if text:
                    self.furniture.append((self.other_at, text))
                self.other_parts, self.other_at = [], at
            self.other_parts.append(data)
            return
        if not self.inked:
            # The block belongs to the innermost element that makes blocks.
            self.at = self.open[self.block_places[-1]][1] if self.block_places else ""
            self.inked = bool(data.strip())
        self.parts.append(data)


def host_of(url) -> F.Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def _ancestors(path: str) -> Iterator[str]:
    while path:
        yield path
        path = path.rpartition("/")[0]


def _content(page: Page) -> int:
    """64 bits of a page's blocks, by which copies are known."""
    import xxhash

    blocks = "\x00".join(f"{path}\x01{text}" for path, text in page.blocks)
    return xxhash.xxh64_intdigest(blocks.encode("utf-8", "surrogatepass")) - (1 << 63)


def _nodes(page: Page, blocks: list[tuple[str, str]], outside: frozenset) -> Iterator[tuple[str, int, int, int]]:
    """path, look, text and number of own blocks of every path with text, but for those ``outside``."""
    below: dict[str, set[int]] = {}
    own: Counter = Counter()
    for path, text in blocks:
        own[path] += 1
        crc = zlib.crc32(text.encode("utf-8", "replace"))
        for above in _ancestors(path):
            if above in outside:
                break
            below.setdefault(above, set()).add(crc)
    if "" in own:
        below.setdefault("", set())
    for path, crcs in below.items():
        look = zlib.crc32("|".join(page.children.get(path, ())).encode("utf-8", "replace"))
        # A page adds one content value to a path: its blocks taken together.
        text = zlib.crc32(repr(sorted(crcs)).encode())
        yield path, look - (1 << 31), text - (1 << 31), own[path]


_PARSED = "content long, paths array<string>, looks array<int>, texts array<int>, own array<int>, furniture array<boolean>, packed binary"


def parsed(pages: DataFrame, meaning: bool = True) -> DataFrame:
    """The columns of ``pages`` but html, and each page's nodes (as arrays) and packed blocks."""
    others = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in others]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for html in batch["html"]:
                page = Page(html or "", meaning)
                kept = list(_nodes(page, page.blocks, frozenset()))
                above = frozenset(node[0] for node in kept)
                nodes = [(*n, False) for n in kept] + [(*n, True) for n in _nodes(page, page.furniture, above) if n[0]]
                place = {node[0]: k for k, node in enumerate(kept)}
                # The packed blocks are written and shuffled once each; bz2 makes them an eighth smaller than zlib.
                blocks = json.dumps([(place[path], text) for path, text in page.blocks], ensure_ascii=False)
                rows.append((_content(page), *([n[k] for n in nodes] for k in range(5)), bz2.compress(blocks.encode("utf-8", "surrogatepass"))))
            made = pd.DataFrame(rows, columns=["content", "paths", "looks", "texts", "own", "furniture", "packed"])
            yield pd.concat([batch[names].reset_index(drop=True), made], axis=1)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in others] + [_PARSED])
    return pages.mapInPandas(parse, schema)


def style_tree(pages: DataFrame, copies: bool = True) -> DataFrame:
    """host, path, furniture, n_pages, look_importance, text_importance and importance of every path with text.

    ``pages`` are rows of host and html, parsed or not. Without ``copies``, pages of a host with the
    same blocks count as one (with the least of their looks).
    """
    if "html" in pages.columns:
        pages = parsed(pages.select("host", "html"))
    node = F.explode(F.arrays_zip("paths", "looks", "texts", "furniture")).alias("node")
    each = pages.select("host", "content", node).select(
        "host", F.col("node.paths").alias("path"), "node.furniture", "content", F.col("node.looks").alias("look"), F.col("node.texts").alias("text")
    )
    each = each.where("path <> ''")
    where = ["host", "path", "furniture"]
    if copies:
        counted = each.groupBy(*where, "look", "text").agg(F.count("*").alias("n"))
    else:
        counted = each.groupBy(*where, "content").agg(F.min("look").alias("look"), F.min("text").alias("text"), F.lit(1).cast("long").alias("n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in ("look", "text")])).alias("x")
    summed = counted.select(*where, "n", kinds).groupBy(*where, "x.kind", "x.value").agg(F.sum("n").alias("n"))
    x = F.col("n").cast("double")
    sides = summed.groupBy(*where).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "look", F.col("n"))), F.lit(0)).alias("n_pages"),
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == kind, x * F.log2(x))), F.lit(0.0)).alias(kind)
            for kind in ("look", "text")
        ],
    )

    # The entropy of the counts is log2(pages) - sum(n log2 n) / pages; divided by its maximum.
    def scaled(kind: str) -> F.Column:
        most = F.log2(F.col("n_pages").cast("double"))
        return F.when(most > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (most - F.col(kind) / F.col("n_pages")) / most))).otherwise(F.lit(1.0))

    tree = sides.select(*where, "n_pages", scaled("look").alias("look_importance"), scaled("text").alias("text_importance"))
    return tree.withColumn("importance", F.greatest("look_importance", "text_importance"))


def _removed(tree: DataFrame, min_pages: int, min_importance: float) -> DataFrame:
    """host, path and furniture of the low paths with nothing but low paths below: all that is removed."""
    where = ["host", "path", "furniture"]
    rated = tree.select(*where, ((F.col("n_pages") >= min_pages) & (F.col("importance") < min_importance)).alias("low"))
    rated = store(rated, "site-paths")
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    holding = rated.where(~F.col("low")).select("host", F.explode(above).alias("path"), "furniture").distinct()
    return rated.where("low").select(*where).join(holding, where, "left_anti")


def _place(host, path, furniture) -> F.Column:
    return F.xxhash64(host, path, furniture)


def _low_nodes(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """row, the places of its low nodes, and how many blocks stand there, in all and as furniture."""
    node = F.posexplode(F.arrays_zip("paths", "furniture", "own"))
    each = pages.select("row", "host", node.alias("place", "node")).where("node.own > 0")
    each = each.select("row", "place", "node.own", "node.furniture", _place(F.col("host"), F.col("node.paths"), F.col("node.furniture")).alias("key"))
    low = removed.select(_place(F.col("host"), F.col("path"), F.col("furniture")).alias("key"))
    of_furniture = F.when(F.col("furniture"), F.col("own")).otherwise(F.lit(0))
    return each.join(low, "key").groupBy("row").agg(
        F.collect_list(F.when(~F.col("furniture"), F.col("place"))).alias("low"), F.sum("own").alias("n_low"), F.sum(of_furniture).alias("n_low_furniture")
    )


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for low, packed in zip(batch["low"], batch["packed"], strict=True):
            gone = frozenset() if low is None else frozenset(low)
            texts.append("\n".join(text for place, text in json.loads(bz2.decompress(packed).decode("utf-8", "surrogatepass")) if place not in gone))
        yield batch.drop(columns=["low", "packed"]).assign(text=texts, n_chars=[len(t) for t in texts])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE, meaning: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page, and what decided about the blocks that went.

    ``n_by_style`` blocks stand on branches that the tree rates low, furniture by meaning among
    them; ``n_by_meaning`` went by their meaning alone.
    """
    small_batches(pages.sparkSession)
    read = narrow(pages, page_id="long", url="string", html="string")
    read = read.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    read = store(parsed(read, meaning).withColumn("row", F.monotonically_increasing_id()), "site-pages")
    low = _low_nodes(read, _removed(style_tree(read, copies=False), min_pages, min_importance))
    all_furniture = F.aggregate(
        F.arrays_zip("own", "furniture"), F.lit(0).cast("long"), lambda n, x: n + F.when(x["furniture"], x["own"]).otherwise(F.lit(0))
    )
    both = read.select("row", "page_id", "url", "packed", all_furniture.alias("n_furniture")).join(low, "row", "left")
    zero = F.lit(0).cast("long")
    both = both.select(
        "page_id", "url", "packed", "low", F.coalesce("n_low", zero).alias("n_by_style"),
        (F.col("n_furniture") - F.coalesce("n_low_furniture", zero)).alias("n_by_meaning"),
    )
    out = both.mapInPandas(_assemble, "page_id long, url string, n_by_style long, n_by_meaning long, text string, n_chars long")
    return out.select("page_id", "url", "text", "n_chars", "n_by_style", "n_by_meaning")
