"""Listings and contents of stored objects, text records and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import parsed
from ..functions.values import text_fields


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size, modified of all objects under a folder of any store that Spark reads; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def archives(objects: DataFrame) -> DataFrame:
    """hash, compression, size, path of stored archives, of a listing() or an inventory (path, size); names that are none are
    passed over."""
    rows = objects.withColumn("p", parsed(F.element_at(F.split("path", "/"), -1))).where("p is not null")
    return rows.select("p.hash", "p.compression", "size", "path")


def chunk_objects(objects: DataFrame) -> DataFrame:
    """hash, size, path of stored chunks: every name is a hash."""
    return objects.select(F.element_at(F.split("path", "/"), -1).alias("hash"), "size", "path")


def narinfo_objects(objects: DataFrame) -> DataFrame:
    """hash, size, path of stored narinfos."""
    name = F.element_at(F.split("path", "/"), -1)
    return objects.where(name.endswith(".narinfo")).select(F.regexp_replace(name, r"\.narinfo$", "").alias("hash"), "size", "path")


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def narinfo_texts(spark: SparkSession, folder: str) -> DataFrame:
    """hash, text of stored narinfos."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.narinfo").text(folder, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return texts.select(F.regexp_replace(name, r"\.narinfo$", "").alias("hash"), F.col("value").alias("text"))


def parsed_narinfos(texts: DataFrame) -> DataFrame:
    """narinfo rows of (hash, text) records; references as an array. Signatures may repeat, so they are taken line by line."""
    m = text_fields(F.col("text"))
    field = lambda k: F.try_element_at(m, F.lit(k))
    lines = F.filter(F.split("text", "\n"), lambda x: F.startswith(x, F.lit("Sig: ")))
    return texts.select(
        "hash", field("StorePath").alias("store_path"), field("URL").alias("url"), field("Compression").alias("compression"), field("FileHash").alias("file_hash"),
        field("FileSize").try_cast("bigint").alias("file_size"), field("NarHash").alias("nar_hash"), field("NarSize").try_cast("bigint").alias("nar_size"), field("Deriver").alias("deriver"),
        F.filter(F.split(F.coalesce(field("References"), F.lit("")), " "), lambda x: x != "").alias("references"), F.transform(lines, lambda x: F.substr(x, F.lit(6))).alias("signatures"),
    )


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational database, for those who keep the model there; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def written_once(df: DataFrame, path: str, key: str = "hash") -> None:
    """Content-addressed objects as Parquet, one row a key."""
    df.dropDuplicates([key]).write.mode("append").parquet(path)
