"""The queries of the text operators, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetledger.llm import (
    divergence,
    factorization,
    histogram_sort,
    jaccard,
    licenses,
    line_runs,
    mixing,
    periodic_runs,
    site_style,
    templates,
    token_store,
    url_rules,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are similar to three quarters."""
    return jaccard.link(table(spark, sf_dir, "documents"))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each text, and whether its histograms are near those of its language."""
    return divergence.judge(table(spark, sf_dir, "documents"))


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the later copies of line runs that repeat in the corpus."""
    return line_runs.dedup(table(spark, sf_dir, "documents"))


def op4_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text by a factorisation machine."""
    return factorization.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written as compressed blocks and read back."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, without the branches that its host's style tree rates low."""
    return site_style.extract(table(spark, sf_dir, "pages"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rules, and association rules mined from the labelled pages, for each url."""
    pages = table(spark, sf_dir, "pages")
    rules = url_rules.mine(url_rules.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge(pages, rules)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and the labels of the signature rules, for each text."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers, names or units."""
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), strict=False).drop("a", "b")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to weighted source targets; taken words by pivotal rounding."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("key")


def op11_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes, as read from the shard files."""
    placed = histogram_sort.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "row.doc_id",
        "size",
        F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every text, after every tenth one was made to repeat itself."""
    return periodic_runs.digest(periodic_runs.collapse(periodic_runs.plant(table(spark, sf_dir, "documents"))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the eight leading components, with unit variance."""
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_divergence": op2_divergence,
    "op3_line_runs": op3_line_runs,
    "op4_factorization": op4_factorization,
    "op5_token_store": op5_token_store,
    "op6_site_style": op6_site_style,
    "op7_url_rules": op7_url_rules,
    "op8_licenses": op8_licenses,
    "op9_templates": op9_templates,
    "op10_mixing": op10_mixing,
    "op11_histogram_sort": op11_histogram_sort,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

# Where SQL can express a query over whole tables in reasonable time; the other queries are
# tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_jaccard": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM split
), sets AS (SELECT doc_id, unnest(s) AS shingle FROM listed),
sizes AS (SELECT doc_id, len(s) AS n FROM listed),
met AS (
  SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), linked AS (
  SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * met.n >= 75 * (a.n + b.n - met.n)
), both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other
), same AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY CASE WHEN len(s) = 0 THEN [doc_id::VARCHAR] ELSE list_sort(s) END) AS class_id FROM listed)
SELECT same.doc_id, len(same.s)::BIGINT AS n_shingles, min(reach.other) AS component_id, any_value(same.class_id) AS class_id
FROM same JOIN reach ON reach.doc_id = same.doc_id GROUP BY 1, 2""",
}
