"""A training-data pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common, decontam, langid, neardup, packing, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that no language fits clearly better than another is rejected.
LEAST_SCORE = 0.3
#: Rows of keys that are broadcast, after they are counted.
MOST_BROADCAST = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language (``und``) or a score under LEAST_SCORE.  The network learns from labelled rows of docs.

    Null and empty texts, and texts without a letter, go; of a table without
    labels all rows go, as nothing can be learned.  Equal texts, however long,
    get one answer, null ids make no difference, and columns other than those of
    ``documents`` are left out.
    """
    net = langid.fit(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    known = langid.predict(docs.select(*COLUMNS), net)
    return known.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the least by doc_id (null last), hashes of its text, lang, source and n_chars.

    Repeated rows are copies of each other.  Null text is an empty text; empty
    texts are copies.  Columns other than those of ``documents`` are left out.
    """
    marks = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    classes = neardup.near_duplicates(docs.select("doc_id", "text"))
    best = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h1", "h2")).alias("x"))
    best = best.select("x.*").distinct()
    text = common.text_of()
    rows = docs.select(*COLUMNS, *marks, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    # repeated rows collapse before they are dealt; the join then meets texts where they are
    keys = ["id", "none", "h1", "h2"]
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    one = rows.groupBy(*keys).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), rest)
    return one.join(best, keys, "left_semi").select("doc_id", "text", "rest.*").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, those without doc_id too; repeated rows go or stay together.

    Null text holds nothing, and an empty benchmark drops nothing.  Columns other
    than those of ``documents`` are left out.
    """
    found = decontam.contaminated(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    found = common.stash(found.select(*decontam.DOC).distinct(), "found")
    text = common.text_of()
    rows = docs.select(*COLUMNS, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    held = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    return decontam.same(rows, held, decontam.DOC, "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows.

    No row goes: null and empty texts, repeated rows and null ids stay as they
    are.  Columns other than those of ``documents`` are left out.
    """
    done = secrets.redact(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts; one row for each piece.

    Null text is one end id; rows with one doc_id, or none, are documents each; a
    long text is cut.  Other columns are not read, and no documents give no rows.
    """
    return packing.packed_pieces(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("packing", pack)]
#: The trained network and models aren't expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table, which the next stage reads."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
