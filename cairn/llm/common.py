"""Shared helpers: reading tables, cutting lineage in the shared folder, hashing words in bulk."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, staged  # noqa: F401  for the operators

#: Rows of the public vocabulary that op2, op8 and op9 read; a parameter of each of them.
VOCABULARY = "piece_bpe_32k.model"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shipped(module: str) -> None:
    """Send this module's functions to the executors by value, so that they need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


shipped(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_bytes(path: str | None = None) -> bytes:
    with open(path or vocabulary_path(), "rb") as f:
        return f.read()


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash. Emptied when it grows past the bound, so memory stays bounded; results do not change."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive elements (none where h is shorter)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


#: Rows of an Arrow batch of texts. Spark's own 10,000 would hold that many whole texts on both sides of each Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch to BATCH_ROWS, where it has more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def rows_mapped(df: DataFrame, of_texts: Callable[[], Callable[[list[bytes | None]], list[tuple]]], fields: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and what of_texts() makes of a batch of texts, a tuple for each, as columns named in fields ("a long, b string")."""
    small_batches(df.sparkSession)
    df = df.select(*keys, *([] if text in keys else [text]))
    names = [x.split()[0] for x in fields.split(",")]
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), fields])
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[x.split()[1]]) for n, x in zip(names, fields.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = of_texts()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = f(texts_of(part, text))
                columns = [pa.array([m[i] for m in made], arrow.field(i).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *columns], names=[*keys, *names])

    return df.mapInArrow(run, schema)


def rows_filtered(df: DataFrame, of_texts: Callable[[], Callable[[list[bytes | None]], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, for whose text of_texts() says true."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = of_texts()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(f(texts_of(part, text)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Rows up to which a table of keys is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def near(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows of a few numbers each, marked for broadcast if n is within the bound."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def row_key(*columns: str) -> Column:
    """128 bits of the given columns, two hashes of 64."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("b"), *columns).alias("b"))


def without(docs: DataFrame, key: Column, dropped_keys: DataFrame) -> DataFrame:
    """docs without the rows whose key (a row_key) is in dropped_keys (a staged table of one column)."""
    own, gone = "__cairn_own", dropped_keys.toDF("__cairn_gone")
    on = [F.col(f"{own}.{c}") == F.col(f"__cairn_gone.{c}") for c in "ab"]
    return docs.withColumn(own, key).join(near(gone, gone.count()), on, "left_anti").drop(own)
