"""Quality classifier: a factorisation machine over hashed words and structure.

A text becomes one sparse vector: its words, hashed, as shares of unit length; the roots of
structure shares (capitals, digits, symbols, repeated words and lines, ...); and its length
as the only metadata. A factorisation machine scores it with a weight for each entry and,
through low-rank factors, a weight for each pair of entries; the pair sum comes from the
square of the factor sums less the sum of squares, so a score takes time linear in the
entries. Spark ML's ``FMClassifier`` fits it, on a sample of labelled rows that is bounded
by ``MAX_TRAINING`` and drawn by a hash of the id.

Cases: a missing or empty text has the vector of no words and is scored like any other; a
row without an id is scored, and is not held out; repeated rows get the same score;
labelled rows of one class only (or none) give every text the share of label 1 (or 0.5);
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger.llm.common import UPPER, WHITE, narrow, store

FOLDS, HELD_OUT = 5, 0
MAX_TRAINING = 12_000
HASHED, FACTORS, STEPS, STEP_SIZE, PENALTY, SEED = 1 << 12, 8, 60, 0.2, 0.02, 11
THRESHOLD = 0.3
# Structure is a dozen entries against the hundreds of words of a text.
STRUCTURE_SCALE = 4.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def vectors(docs: DataFrame, hashed: int = HASHED) -> DataFrame:
    """``row`` (all columns of the frame) and the features of every whole text."""
    df = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    df = df.select(
        "row", tokens.alias("tokens"), F.length("text").alias("n"), F.regexp_replace("text", "[a-z]+", "").alias("rest"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"),
    )
    rest, n, size = F.col("rest"), F.col("n"), F.size("tokens")

    def among(characters: str) -> Column:
        return F.length(rest) - F.length(F.translate(rest, characters, ""))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.sqrt(F.greatest(part / whole, F.lit(0.0)))).otherwise(F.lit(0.0))

    structure = [
        share(among(UPPER), n), share(among("0123456789"), n), share(among("|"), n), share(among("!"), n),
        share(among("#*$%&<>=_{}[]\\/~^@+"), n), share(among(".,;:?'\"()-"), n), share(among(WHITE), n),
        share(F.length(F.regexp_replace(rest, r"[\x00-\x7F]+", "")), n),
        share(size - F.size(F.array_distinct("tokens")), size),
        share(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")),
        F.when(size > 0, F.least(n / size / 20, F.lit(1.0))).otherwise(F.lit(0.0)),
        F.least(F.log1p(n.cast("double")) / 15, F.lit(1.0)),
    ]
    df = df.select("row", "tokens", array_to_vector(F.array(*[c.cast("double") * STRUCTURE_SCALE for c in structure])).alias("structure"))
    # Else the assembler reads the first row to see how long the vectors are.
    df = VectorSizeHint(inputCol="structure", size=len(structure), handleInvalid="optimistic").transform(df)
    df = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=hashed).transform(df)
    df = Normalizer(inputCol="counts", outputCol="words").transform(df)
    df = VectorAssembler(inputCols=["words", "structure"], outputCol="features").transform(df)
    return df.select("row", "features")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """The features and labels of at most ``most`` labelled rows outside the held-out fold."""
    marks = narrow(labels, doc_id="long", quality="int").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    known = narrow(docs, doc_id="long").join(marks, "doc_id").dropDuplicates(["doc_id"])
    # Ids only are sorted here, and never more than the bound of them is sent on.
    chosen = store(known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most), "fm-sample")
    rows = vectors(narrow(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id"))
    return store(rows.select("features", F.col("row.quality").cast("double").alias("label")), "fm-rows")


def fit(rows: DataFrame):
    """The fitted model, or the share of label 1 where there are not two classes."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    machine = FMClassifier(
        featuresCol="features", labelCol="label", factorSize=FACTORS, maxIter=STEPS, stepSize=STEP_SIZE, regParam=PENALTY,
        initStd=0.05, seed=SEED, solver="adamW",
    )
    return machine.fit(rows)


def scored(docs: DataFrame, model) -> DataFrame:
    """``row`` and the score of every whole text."""
    rows = vectors(docs)
    if isinstance(model, float):
        return rows.select("row", F.lit(model).alias("score"))
    return model.transform(rows).select("row", vector_to_array("probability")[1].alias("score"))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """doc_id, held_out, score and predicted, for every whole text."""
    model = fit(training_rows(docs, labels, most))
    rows = scored(narrow(docs, doc_id="long", text="string"), model)
    doc_id = F.col("row.doc_id")
    return rows.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """The documents that are predicted to be good, with all their columns."""
    rows = scored(docs, fit(training_rows(docs, labels, most)))
    return rows.where(F.col("score") >= THRESHOLD).select("row.*")
