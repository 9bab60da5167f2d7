"""License scans: ordered signature rules with a keyword gate.

A text is reduced to its words, in small letters, with one blank between two of them. Each
rule is a regular expression over such words with a keyword, a label, a priority and a
strength; the rules are built from a table of license names and a table of phrasings. A
text is only matched with the rules whose keyword is among its words, which most texts
have none of. Every match is a span of words. A span inside another one (or equal to it)
is suppressed when the other has the better priority; among equal priorities the longer
span and then the earlier rule stays.

All work is in DataFrame functions. Matching stays within the row; the spans found, which
few texts have, are suppressed by windows over the spans of a row, in time that grows with
their number.

Cases: a missing or empty text has no words and no spans; a text may hold any number of
spans, all are kept; repeated rows are scanned separately; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetledger.llm.common import ascii_lower, narrow, store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, gating word, and the name's pattern over words.
NAMES = [
    ("mit", "mit", "mit"),
    ("apache-2.0", "apache", "apache"),
    ("gpl", "gpl", "gpl"),
    ("gpl", "gnu", "gnu(?: general public)?"),
    ("lgpl", "lgpl", "lgpl"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public"),
    ("agpl", "agpl", "agpl"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("bsd", "bsd", "bsd"),
    ("mpl", "mpl", "mpl"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "cddl", "cddl"),
    ("cc", "cc", "cc"),
    ("cc", "creative", "creative commons"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("boost", "boost", "boost software"),
    ("artistic", "artistic", "artistic"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "ofl", "ofl"),
    ("ofl", "sil", "sil open font"),
    ("eupl", "eupl", "eupl"),
    ("postgresql", "postgresql", "postgresql"),
    ("psf", "psf", "psf"),
    ("vim", "vim", "vim"),
    ("ncsa", "ncsa", "ncsa"),
]
# Priority (1 wins), strength, and the phrasing around a name.
PHRASINGS = [
    (1, 1.0, "spdx license identifier {name}(?: [0-9]+)*(?: (?:only|or later|clause))?"),
    (2, 0.95, "(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: version)?(?: [0-9]+)*"),
    (2, 0.9, "under (?:the )?terms of (?:the )?{name}(?: licen[sc]e)?(?: version)?(?: [0-9]+)*"),
    (3, 0.85, "{name} licen[sc]e version [0-9]+(?: [0-9]+)*"),
    (4, 0.8, "{name} (?:public )?licen[sc]e"),
    (5, 0.6, "licen[sc]e {name}"),
    (5, 0.6, "{name} v?[0-9]+(?: [0-9]+)* licen[sc]ed?"),
    (6, 0.5, "{name} (?:only|or later|compatible)"),
]
# Whole rules that no name is part of.
OTHERS = [
    (1, 1.0, "cc-by-nc", "cc", "cc by nc(?: (?:sa|nd))?(?: [0-9] [0-9])?"),
    (1, 0.95, "cc-by", "cc", "cc by(?: sa)?(?: [0-9] [0-9])?"),
    (1, 1.0, "cc0", "cc0", "cc0(?: [0-9] [0-9])?(?: universal)?"),
    (1, 0.95, "gpl-3.0", "gpl", "gpl v?3(?: 0)?"),
    (1, 0.95, "gpl-2.0", "gpl", "gpl v?2(?: 0)?"),
    (1, 0.95, "gpl-3.0", "gnu", "gnu general public license version 3(?: 0)?"),
    (1, 0.95, "gpl-2.0", "gnu", "gnu general public license version 2(?: 0)?"),
    (1, 0.95, "apache-2.0", "apache", "apache license version 2 0"),
    (2, 0.9, "bsd-3-clause", "bsd", "(?:3 clause|three clause|new|modified) bsd"),
    (2, 0.9, "bsd-2-clause", "bsd", "(?:2 clause|two clause|simplified) bsd"),
    (3, 0.9, "bsd-3-clause", "bsd", "bsd 3(?: clause)?"),
    (3, 0.9, "bsd-2-clause", "bsd", "bsd 2(?: clause)?"),
    (3, 0.8, "public-domain", "public", "(?:in|into|to) the public domain"),
    (4, 0.7, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    (4, 0.7, "isc", "permission", "permission to use copy modify and or distribute this software"),
    (4, 0.7, "bsd", "redistribution", "redistribution and use in source and binary forms"),
    (4, 0.7, "proprietary", "proprietary", "proprietary and confidential"),
    (5, 0.5, "all-rights-reserved", "rights", "all rights reserved"),
    (5, 0.5, "all-rights-reserved", "alle", "alle rechte vorbehalten"),
    (5, 0.5, "all-rights-reserved", "tous", "tous droits réservés"),
    (5, 0.5, "all-rights-reserved", "todos", "todos los derechos reservados"),
    (6, 0.4, "copyright", "copyright", "copyright (?:c )?[0-9]{4}"),
]
PRIORITIES = 6
_OPEN, _SHUT = "\x01", "\x02"  # neither is part of a word

_RULE = "struct<no:int,word:string,label:string,priority:int,strength:double,regex:string>"
_SPAN = "struct<first:int,back:int,rule:int,label:string,priority:int,strength:double>"


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """Every rule: number, keyword, label, priority, strength, pattern between blanks."""
    built = [(p, s, label, word, text) for p, s, label, word, text in OTHERS]
    for priority, strength, phrasing in PHRASINGS:
        built += [(priority, strength, label, word, phrasing.format(name=f"(?:{name})")) for label, word, name in NAMES]
    return [(no, word, label, p, s, f"(?<= )(?:{text})(?= )") for no, (p, s, label, word, text) in enumerate(built)]


def _count(text: Column, what: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))


def _places(line: Column, pattern: Column, make) -> Column:
    """The first and last word of every match, made into an array by ``make(first, last)``.

    Matches are set between two signs that no word holds; then the places of words that
    begin or end with them are read off, each word once.
    """
    marked = F.regexp_replace(line, pattern, F.lit(f"{_OPEN}$0{_SHUT}"))
    words = F.split(F.btrim(marked), " ")
    signs = F.transform(words, lambda w, k: F.struct(k.alias("at"), F.startswith(w, F.lit(_OPEN)).alias("opens"), F.endswith(w, F.lit(_SHUT)).alias("shuts")))
    # An array of one element gives a value a name, so that the words are split once.
    edges = F.array(F.filter(signs, lambda w: w["opens"] | w["shuts"]))

    def pair(edge: Column) -> Column:
        first = F.transform(F.filter(edge, lambda w: w["opens"]), lambda w: w["at"])
        last = F.transform(F.filter(edge, lambda w: w["shuts"]), lambda w: w["at"])
        return F.zip_with(first, last, make)

    found = F.flatten(F.transform(edges, pair))
    return F.when(F.regexp_like(line, pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _span(first: Column, last: Column, rule: Column) -> Column:
    return F.struct(
        first.cast("int").alias("first"), (-last).cast("int").alias("back"), rule["no"].alias("rule"), rule["label"].alias("label"),
        rule["priority"].alias("priority"), rule["strength"].alias("strength"),
    ).cast(_SPAN)


def detect(docs: DataFrame) -> DataFrame:
    """row (a number for each row), doc_id, n_words, base and matched (arrays of spans), stored."""
    df = narrow(docs, doc_id="long", text="string")
    bare = F.btrim(F.regexp_replace(ascii_lower(F.col("text")), SEPARATORS, " "))
    df = df.select("doc_id", F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(" "), bare, F.lit(" "))).alias("line"))
    table = rules()
    every = F.array(*[F.struct(*[F.lit(v) for v in r]).cast(_RULE) for r in table])
    keywords = F.array(*[F.lit(w) for w in sorted({r[1] for r in table} | {"license"})])
    line = F.col("line")
    df = df.withColumn("keys", F.array_intersect(F.split(F.btrim(line), " "), keywords))

    def of_rule(rule: Column) -> Column:
        return _places(line, rule["regex"], lambda first, last: _span(first, last, rule))

    def of_phrase(phrase: str, label: str) -> Column:
        rule = F.struct(F.lit(-1).alias("no"), F.lit(label).alias("label"), F.lit(0).alias("priority"), F.lit(1.0).alias("strength"))
        return F.when(F.contains(line, F.lit(f" {phrase} ")), _places(line, F.lit(f"(?<= ){phrase}(?= )"), lambda a, b: _span(a, b, rule)))

    nothing = F.array().cast(f"array<{_SPAN}>")
    gated = F.filter(every, lambda r: F.array_contains(F.col("keys"), r["word"]) & (F.size("keys") > 0))
    matched = F.flatten(F.transform(gated, of_rule))
    base = F.concat(*[F.coalesce(of_phrase(p, label), nothing) for p, label in BASE_PHRASES.items()])
    df = df.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id", F.when(line == "", 0).otherwise(_count(line, " ") - 1).cast("long").alias("n_words"),
        F.when(F.size("keys") > 0, base).otherwise(nothing).alias("base"),
        F.when(F.size("keys") > 0, matched).otherwise(nothing).alias("matched"),
    )
    return store(df, "license-matches")


def unsuppressed(found: DataFrame) -> DataFrame:
    """row, doc_id and x, a span, for the spans that no better one contains.

    In the order of first word, then longest, then rule, whatever contains a span comes
    before it, or has its place: so the furthest last word so far of each priority decides.
    """
    each = found.where(F.size("matched") > 0).select("row", "doc_id", F.explode("matched").alias("x"))
    before = Window.partitionBy("row").orderBy("x.first", "x.back", "x.rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("x.priority") == p, -F.col("x.back"))).over(before).alias(f"reach{p}") for p in range(1, PRIORITIES + 1)]
    inside = reduce(
        lambda a, b: a | b, [F.coalesce((F.col(f"reach{p}") >= -F.col("x.back")) & (F.col("x.priority") >= p), F.lit(False)) for p in range(1, PRIORITIES + 1)]
    )
    return each.select("row", "doc_id", "x", *reach).where(~inside).select("row", "doc_id", "x")


def spans(docs: DataFrame) -> DataFrame:
    """One row for each detection that stays: doc_id, rule, label, first and last word, strength."""
    return unsuppressed(detect(docs)).select(
        "doc_id", "x.rule", "x.label", F.col("x.first").alias("first_word"), (-F.col("x.back")).alias("last_word"), "x.strength"
    )


def scan(docs: DataFrame) -> DataFrame:
    """The labels of each text, and how strong its strongest detection is."""
    found = detect(docs)
    kept = unsuppressed(found).groupBy("row").agg(
        F.collect_set("x.label").alias("names"), F.max("x.strength").alias("strength"), F.count("*").alias("n_spans")
    )
    df = found.drop("matched").join(kept, "row", "left")
    own = F.transform("base", lambda x: x["label"])
    labels = F.concat(own, F.coalesce("names", F.array().cast("array<string>")))
    starts = F.transform("base", lambda x: x["first"].cast("long"))
    base_strength = F.array_max(F.transform("base", lambda x: x["strength"]))

    def joined(names: Column) -> Column:
        return F.concat_ws(",", F.sort_array(F.array_distinct(names)))

    return df.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(own).alias("base_labels"), joined(labels).alias("labels"),
        F.coalesce(F.greatest("strength", base_strength), F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )
