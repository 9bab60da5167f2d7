"""URL filters: host and path rules first, then association rules mined by FP-growth.

A URL is a set of tokens (scheme, host and its parents, path segments, file ending, query
names). From labelled URLs, FP-growth mines which combinations of tokens are frequent
together with the label ``bad``. Rules below the least support or confidence go, and so
does a rule that holds more tokens than another one that is at least as sure. What
confidence is needed follows the share of bad URLs: ``MIN_LIFT`` times that share, but at
least ``MAJORITY`` and never more than ``MIN_CONFIDENCE``. A rule must also be telling: a
share that is ``MIN_SIGMAS`` standard deviations above what as many URLs drawn without
regard to their tokens would have. The rules are matched by an inverted index: URLs and rules meet on a token, and a rule fires where
as many tokens met as it has.

All work is in DataFrame functions and Spark's own FP-growth. All tokens that reach the
support are mined, whatever their own share of bad URLs. Tokens that occur in the very same
URLs (a host and its only child) are mined as one and spelled out in the rules, which keeps
long URLs from making endless combinations. A URL that occurs many times is matched once.

Cases: a missing URL, or one without ``://``, has an empty host and path, fits no rule and
is allowed; repeated rows are judged separately; without labels (or without a sure rule)
nothing is blocked beyond the host rules; further columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetledger.llm.common import LOWER, UPPER, empty, narrow, store

# The rules of the contract.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE = 20, 0.001, 0.7
MAJORITY, MIN_LIFT, MIN_SIGMAS = 0.5, 3.0, 4.0
BAD = "=bad"
_RULES = "rule long, tokens array<string>, confidence double, support double"


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict; null where none fits."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; digits count as one and the same."""
    host, path = url_parts(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    shape = F.regexp_replace(path, "[0-9]+", "0")
    segments = F.filter(F.split(shape, "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))),
        parents,
        F.transform(segments, lambda x: F.concat(F.lit("path:"), x)),
        F.array(F.concat(F.lit("ending:"), F.regexp_extract(shape, r"(\.[^./]*|/)$", 1))),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array()),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))


def mine(
    labelled: DataFrame,
    min_count: int = MIN_COUNT,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    min_sigmas: float = MIN_SIGMAS,
) -> DataFrame:
    """Rules (rule, tokens, confidence, support) from rows of url and bad (boolean)."""
    spark = labelled.sparkSession
    rows = store(labelled.select(url_tokens(F.col("url")).alias("tokens"), "bad").where(F.size("tokens") > 0), "url-labels")
    n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not n_bad or n_bad == n:
        return empty(spark, _RULES)
    # A little less, so that a count that just reaches it is not lost to rounding.
    support = min(1.0, max(min_support, min_count / n)) * (1 - 1e-9)
    each = rows.withColumn("row", F.monotonically_increasing_id())
    each = store(each.select("row", "bad", F.explode("tokens").alias("token")), "url-tokens")
    named = store(_alike(each, support * n), "url-token-classes")
    baskets = each.join(named.where("token = name"), "token").groupBy("row").agg(F.collect_set("token").alias("items"), F.first("bad").alias("bad"))
    baskets = store(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    if baskets.isEmpty():
        return empty(spark, _RULES)
    share = n / baskets.count()
    base = n_bad / n
    needed = min(min_confidence, max(MAJORITY, min_lift * base))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * share), minConfidence=needed).fit(baskets)
    mined = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    mined = mined.select("antecedent", "confidence", (F.col("support") / share).alias("support"))
    # As many urls as hold the rule's tokens, each bad with the share of all.
    urls = F.col("support") * n / F.col("confidence")
    mined = mined.where((F.col("confidence") - base) * F.sqrt(urls / (base * (1 - base))) >= min_sigmas)
    mined = store(mined.withColumn("rule", F.xxhash64(F.sort_array("antecedent"))), "rules-by-name")
    mined = mined.join(_implied(mined.withColumnRenamed("antecedent", "tokens")), "rule", "left_anti")
    return store(_spelled(mined, named), "rules")


def _alike(each: DataFrame, least: float) -> DataFrame:
    """token and name of the tokens with enough bad rows; tokens of the very same rows share a name.

    A combination with two of them is no surer than without one, and longer.
    """
    rows = [F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("b")]
    counted = each.groupBy("token").agg(*rows, F.sum(F.col("bad").cast("long")).alias("n_bad")).where(F.col("n_bad") >= least)
    # A few names at most have the same rows: they are parts of one and the same kind of url.
    names = counted.groupBy("n", "a", "b").agg(F.min("token").alias("name"))
    return counted.join(names, ["n", "a", "b"]).select("token", "name")


def _spelled(mined: DataFrame, named: DataFrame) -> DataFrame:
    """Each rule with every token that its names stand for, one at a time."""
    alike = named.groupBy("name").agg(F.sort_array(F.collect_list("token")).alias("choices"))
    each = mined.select("rule", "confidence", "support", F.explode("antecedent").alias("name")).join(alike, "name")
    whole = each.groupBy("rule").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.collect_list("choices").alias("choices"))
    spelled = F.aggregate(
        "choices",
        F.array(F.array().cast("array<string>")),
        lambda found, more: F.flatten(F.transform(found, lambda x: F.transform(more, lambda y: F.concat(x, F.array(y))))),
    )
    rules = whole.select("confidence", "support", F.explode(spelled).alias("tokens")).withColumn("tokens", F.sort_array("tokens"))
    return rules.select(F.xxhash64("tokens").alias("rule"), "tokens", "confidence", "support")


def _implied(rules: DataFrame) -> DataFrame:
    """Rules with a shorter rule inside that is at least as sure."""
    inside = rules.select(F.col("rule").alias("small"), F.col("confidence").alias("sure"), F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    around = rules.select("rule", "confidence", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    met = around.join(inside, "token").where((F.col("n") < F.col("m")) & (F.col("sure") >= F.col("confidence")))
    return met.groupBy("rule", "small", "n").agg(F.count("*").alias("met")).where("met = n").select("rule").distinct()


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct url that a rule fits: url, rule and its confidence (the surest one)."""
    index = rules.select("rule", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    tokens = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    met = tokens.join(index, "token").groupBy("url", "rule", "n", "confidence").agg(F.count("*").alias("met")).where("met = n")
    return met.groupBy("url").agg(F.max(F.struct("confidence", "rule")).alias("best")).select("url", "best.rule", "best.confidence")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict, and the mined rule that fired, if any."""
    read = narrow(pages, page_id="long", url="string")
    host, path = url_parts(F.col("url"))
    read = read.select("page_id", "url", host.alias("host"), path.alias("path"))
    hits = store(fired(read, rules), "fired").withColumnRenamed("rule", "mined_rule")
    both = read.join(hits, "url", "left").withColumn("own", host_rule(F.col("host"), F.col("path")))
    method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", method).alias("verdict"),
        "mined_rule", "confidence",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls with the quality label of the document whose number the path holds."""
    number = F.regexp_extract(url_parts(F.col("url"))[1], r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast(T.LongType())
    urls = narrow(pages, url="string").select("url", number.alias("doc_id")).where(F.col("doc_id").isNotNull())
    marks = narrow(labels, doc_id="long", quality="int").where(F.col("quality").isNotNull())
    return urls.join(marks, "doc_id").select("url", (F.col("quality") == 0).alias("bad"))
