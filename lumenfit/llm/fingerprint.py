"""Canonical exact digests (operator 1), DataFrame functions only.

A text is brought to a canonical form (NFKC, full case folding, NFKC again,
white space folded and trimmed) and hashed to 256 bits of xxhash64.  Documents
with equal digests form a bucket; inside buckets of two and more the canonical
bytes are compared, so a class never rests on the hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenfit.llm import common

WHITE = r"[\s\p{Z}\u0085]+"


def canonical(text: Column) -> Column:
    """The canonical form; ICU's normaliser and case folding run in the JVM."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    # for ASCII, NFKC changes nothing and folding is lower()
    plain = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(compose(folded))
    return F.trim(F.regexp_replace(plain, WHITE, " "))


def wide_hash(canon: Column) -> Column:
    """256 bits of xxhash64 from four seeds, as 64 hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in range(4))))


def verified_classes(rows: DataFrame) -> DataFrame:
    """class_id of rows (doc_id, fingerprint, canon): the least doc_id with the same canonical bytes; rows must be stored.

    canon may be null where the fingerprint occurs once.  Copies collapse before
    they are shuffled, as the bytes are a grouping key.  Buckets are compared
    first; only if one holds different texts (a hash collision) are rows joined
    by their bytes too.
    """
    texts = rows.filter("canon IS NOT NULL").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("least"))
    buckets = common.stash(texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("one")), "buckets")
    one = buckets.filter("texts = 1").select(F.col("fingerprint").alias("f1"), "one")
    clashing = buckets.filter("texts > 1").select("fingerprint")
    if clashing.isEmpty():
        out = rows.drop("canon").join(one, F.col("fingerprint") == F.col("f1"), "left")
        return out.withColumn("class_id", F.coalesce("one", "doc_id")).drop("f1", "one")
    out = rows.join(one, F.col("fingerprint") == F.col("f1"), "left")
    clash = texts.join(clashing, "fingerprint").select(F.col("fingerprint").alias("f2"), F.col("canon").alias("c2"), F.col("least").alias("two"))
    out = out.join(clash, (F.col("fingerprint") == F.col("f2")) & (F.col("canon") == F.col("c2")), "left")
    return out.withColumn("class_id", F.coalesce("one", "two", "doc_id")).drop("f1", "f2", "c2", "one", "two", "canon")


def next_documents(keys: DataFrame) -> DataFrame:
    """For each distinct (doc_id, h) the next one by descending doc_id (null last, ties by h; after the last: the first).

    Keys are dealt by range, linked inside a range by a window, and across
    ranges by the first key of each, of which there are as many as ranges.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("h")]
    dealt = keys.select("doc_id", "h").distinct().repartitionByRange(4 * common.shuffle_width(keys.sparkSession), *order)
    in_range = W.partitionBy("range").orderBy(*order)
    dealt = dealt.withColumn("range", F.spark_partition_id())
    # stored, as ranges rest on a sample: both uses must see the same ones
    linked = common.stash(dealt.withColumn("next", F.lead(F.struct("doc_id", "h")).over(in_range)).withColumn("place", F.row_number().over(in_range)), "linked")
    firsts = linked.filter("place = 1").select(F.col("range").alias("r"), F.struct("doc_id", "h").alias("first"))
    ring = firsts.groupBy().agg(F.sort_array(F.collect_list(F.struct("r", "first"))).alias("all"))
    ahead = ring.select(F.posexplode("all").alias("i", "x"), "all").select(F.col("x.r").alias("r"), F.col("all")[(F.col("i") + 1) % F.size("all")]["first"].alias("ahead"))
    out = linked.join(ahead, linked["range"] == ahead["r"], "left").withColumn("to", F.coalesce("next", "ahead"))
    return out.select("doc_id", "h", F.col("to.doc_id").alias("next_id"), F.col("to.h").alias("next_h"))


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, h (xxhash64 of the raw text), n_chars, fingerprint of each row of ``doc_id, text``."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    seen = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("canon"))
    return seen.select("doc_id", "h", "n_chars", wide_hash(F.col("canon")).alias("fingerprint"))


def fingerprint_report(df: DataFrame) -> DataFrame:
    """Fingerprints and byte-verified classes of all rows, and of each row edited with its successor.

    The last floor(n_chars / 3) code points are replaced by the first as many of
    the next document by descending doc_id.  As digests are exact, a likeness is
    1.0 for equal fingerprints and else 0.0.

    Null text is an empty text; rows without doc_id come last in the order; rows
    with one doc_id are ordered by a hash of their text, and repeated rows count
    as one there, but each is reported.  A sole document succeeds itself.  Other
    columns are not read.  Whole texts are compared, however long.  An empty table
    gives no rows.
    """
    marks = common.stash(fingerprints(df), "fingerprints")
    distinct = marks.dropDuplicates(["doc_id", "h"])
    twice = marks.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    known = distinct.join(twice, "fingerprint").select("doc_id", "h", "n_chars", "fingerprint", "copies")
    links = next_documents(marks)
    told = distinct.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("fingerprint").alias("next_fp"))
    plan = known.join(links.withColumnsRenamed({"doc_id": "d1", "h": "h1"}), F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("h") == F.col("h1"))).drop("d1", "h1")
    plan = plan.join(told, F.col("next_id").eqNullSafe(F.col("d2")) & (F.col("next_h") == F.col("h2"))).drop("d2", "h2")
    plan = common.stash(plan, "successors")

    # texts are dealt by (doc_id, h) once; the second join meets them where they are
    texts = df.select(F.col("doc_id").cast("long").alias("id"), common.text_of().alias("text")).withColumn("hh", F.xxhash64("text"))
    need = plan.select("next_id", "next_h", F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("k"))
    heads = texts.join(need, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("hh") == F.col("next_h"))).select("for_id", "for_h", F.substring("text", F.lit(1), F.col("k")).alias("head"))
    heads = heads.dropDuplicates(["for_id", "for_h"])
    mine = plan.select("doc_id", "h", "n_chars", "fingerprint", "copies", "next_fp").join(heads, F.col("doc_id").eqNullSafe(F.col("for_id")) & (F.col("h") == F.col("for_h"))).drop("for_id", "for_h")
    both = texts.join(mine, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hh") == F.col("h")))
    keep = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep.cast("int")), F.col("head")))
    canon = edited.select(
        "doc_id", "n_chars", "fingerprint", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("edited")).alias("edited_canon"),
        F.when(F.col("copies") > 1, canonical(F.when(F.col("copies") > 1, F.col("text")).otherwise(""))).alias("canon"),
    )
    done = canon.select("doc_id", "n_chars", "edited_sha256", "fingerprint", wide_hash(F.col("edited_canon")).alias("edited_fingerprint"), "next_fp", "canon")
    done = common.stash(done, "edited")
    common.discard(marks, plan)
    like = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    out = verified_classes(done)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fp").alias("near_next"), "class_id")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(common.table(spark, sf_dir, "documents"))
