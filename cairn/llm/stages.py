"""The corpus pipeline's stages: each takes (spark, docs, sf_dir) and keeps, drops or rewrites rows of documents.

All but the last return the columns they were given. Rows are told apart by their contents, so null, repeated and shared
doc_ids need no special case: equal rows share their fate, except that near-duplicate removal leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid, neardup, packing, pii, quality
from .common import near, row_key, rows_filtered, shipped, staged, vocabulary_bytes, without

shipped(__name__)


def language(spark, docs: DataFrame, sf_dir: str, least_score: float = 0.5) -> DataFrame:
    """Drops documents without a letter and those that no language claims with at least least_score. Learns from docs' own
    labelled rows; where there are none, nothing is dropped but documents without a letter."""
    langs, p = langid.learned(docs)
    names = langid.piece_names(vocabulary_bytes())
    sent = spark.sparkContext.broadcast(p)

    def make():
        if not langs:
            return lambda texts: [any(any(map(str.isalpha, w)) for w in langid.words_of(x)) for x in texts]
        f = langid.predictor(names, langs, sent.value)
        return lambda texts: [lang != "und" and score >= least_score for lang, score in f(texts)]

    return rows_filtered(docs, make)


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or lie too far from their language and source."""
    key = row_key("doc_id", "text", "lang", "source")
    verdicts = quality.judged(docs.select(key.alias("doc_id"), "text", "lang", "source"))
    return without(docs, key, staged(verdicts.where("not kept").select("doc_id").distinct(), "rejected"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str, percent: int = 85) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group, and of equal rows one. percent: the least similarity of a
    link; 85 is op4's, the pipeline has its own."""
    key = row_key("doc_id", "text")
    judged = neardup.deduplicated(docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), "text"), percent)
    judged = staged(judged.groupBy(F.col("doc_id.key").alias("key"), "kept").agg(F.count(F.lit(1)).alias("n")), "judged")
    left = without(docs, key, judged.where("not kept").select("key"))
    again = judged.where("kept and n > 1").select(F.col("key").alias("__cairn_again"))
    if not (n := again.count()):
        return left
    keyed = left.withColumn("__cairn_key", key)
    on = [F.col(f"__cairn_key.{c}") == F.col(f"__cairn_again.{c}") for c in "ab"]
    once = keyed.join(near(again, n), on, "left_semi").dropDuplicates(["__cairn_key"])
    return keyed.join(near(again, n), on, "left_anti").unionByName(once).drop("__cairn_key")


def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text by its kind."""
    return pii.redacted(docs)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: doc_id, piece, start, length, bin_id, bin_offset, capacity."""
    return packing.packed_documents(docs)
