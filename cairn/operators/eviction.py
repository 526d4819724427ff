"""Least-recently-used eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 10_000


def total_size(nar_files: DataFrame) -> DataFrame:
    return nar_files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total"))


def utilisation(total: Column, most: Column) -> Column:
    return F.when((most > 0) & (total > 0), total / most).otherwise(0.0)


def over_budget(total: Column, most: Column) -> Column:
    return F.greatest(total - most, F.lit(0))


def candidates(narinfos: DataFrame, links: DataFrame, nar_files: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """id, hash, last_accessed_at, size of the oldest rows (nulls first, ties by id); the size is that of the first linked file
    by link id, 0 without one. The cap comes first, so all that follows runs over a bounded number of rows."""
    oldest = narinfos.select("id", "hash", "last_accessed_at").orderBy(F.asc_nulls_first("last_accessed_at"), "id").limit(most)
    linked = links.join(F.broadcast(oldest.select(F.col("id").alias("narinfo_id"))), "narinfo_id", "left_semi")
    first = linked.groupBy("narinfo_id").agg(F.min_by("nar_file_id", "id").alias("nar_file_id"))
    sizes = first.join(nar_files.select(F.col("id").alias("nar_file_id"), "file_size"), "nar_file_id").select(F.col("narinfo_id").alias("id"), "file_size")
    return oldest.join(sizes, "id", "left").select("id", "hash", "last_accessed_at", F.coalesce("file_size", F.lit(0)).alias("size"))


def prefix(rows: DataFrame, target: int) -> DataFrame:
    """The longest run from the oldest whose sizes sum to at most twice the target, and the first row in any case."""
    # without a partition: the rows are capped before
    order = Window.orderBy(F.asc_nulls_first("last_accessed_at"), "id")
    summed = rows.withColumn("running", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    broken = F.max(F.when(F.col("running") > 2 * target, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn("broken", broken).where("n = 1 or broken = 0").drop("broken")


def chosen(rows: DataFrame, pinned: DataFrame, target: int) -> DataFrame:
    """Of a prefix the rows to delete: unpinned ones in order until the target is met at the k-th, provided that k is less than
    the number of rows in the prefix less one; else all of them. Target 0 means all. pinned: hash."""
    order = Window.orderBy(F.asc_nulls_first("last_accessed_at"), "id")
    counted = rows.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy()))
    free = counted.join(pinned.select("hash").distinct(), "hash", "left_anti")
    free = free.withColumn("freed", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order))
    if target == 0:
        return free
    stop = F.min(F.when(F.col("freed") >= target, F.col("k"))).over(Window.partitionBy())
    free = free.withColumn("stop", stop)
    return free.where(F.col("stop").isNull() | (F.col("stop") >= F.col("of") - 1) | (F.col("k") <= F.col("stop"))).drop("stop")


def plan(narinfos: DataFrame, links: DataFrame, nar_files: DataFrame, chunk_links: DataFrame | None, chunks: DataFrame | None, pinned: DataFrame, target: int, most: int = CANDIDATES) -> DataFrame:
    """kind and id of every row that one eviction deletes: the chosen narinfos, then every file without a link, then, with
    chunks given, every chunk without one. The sweep of files and chunks is over all of them, not only those just unlinked."""
    gone = chosen(prefix(candidates(narinfos, links, nar_files, most), target), pinned, target).select("id")
    kept = links.join(F.broadcast(gone.withColumnRenamed("id", "narinfo_id")), "narinfo_id", "left_anti")
    files = nar_files.select("id").join(kept.select(F.col("nar_file_id").alias("id")), "id", "left_anti")
    out = gone.select(F.lit("narinfo").alias("kind"), "id").unionByName(files.select(F.lit("nar_file").alias("kind"), "id"))
    if chunks is not None:
        left = chunk_links.join(files.withColumnRenamed("id", "nar_file_id"), "nar_file_id", "left_anti")
        out = out.unionByName(chunks.select("id").join(left.select(F.col("chunk_id").alias("id")), "id", "left_anti").select(F.lit("chunk").alias("kind"), "id"))
    return out
