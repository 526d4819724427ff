"""Best-fit packing with several permitted sequence lengths.

Documents, longest first, go to the open bin with the least room that holds them. Where none does, bins are opened, of the
size whose cost for each token packed is least, judged by filling such a bin greedily from the lengths still to come; at the
end each bin becomes the cheapest size that holds its contents. Documents longer than the largest size are cut into pieces.

Documents of one length are interchangeable, so all choices are made on the histogram of lengths, which the largest size
bounds whatever the number of documents: a plan says which ranks of each length go to which bins. Each piece then finds its
rank among its length, counted in buckets of doc_id so that no length lies in one task, and its bin from the plan.

A document's length is its word-piece count and one end token, so null and empty texts are packed as well, with length 1.
Bins of equal room are taken in the order they were opened in; ties among equal lengths go by bucket, doc_id and piece. Very long
texts become several pieces. Repeated rows are each packed. An empty table makes no bins. Extra columns are not read. What the
driver holds and broadcasts is the plan, a few placements for each length that occurs: 19,000 for 10^8 documents, measured.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import shipped
from .tokencount import token_counts

shipped(__name__)

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def attention_cost(capacity: int) -> float:
    """Linear work and attention's quadratic part, which equals it at 16384 tokens; with a fixed share for each sequence."""
    return 16 + capacity + capacity * capacity / 16384


class Plan:
    """placements: (length, first rank, count, first bin, offset), sorted; bins: (first bin, capacity), sorted."""

    def __init__(self, histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost):
        self.capacities, self.cost = sorted(capacities), cost
        self.left = {k: n for k, n in histogram.items() if n}
        self.lengths = sorted(self.left)
        self.placements: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, count, filled)
        self.rooms: list[int] = []
        self.n_bins = 0
        while self.lengths:
            length = self.lengths.pop()
            self.place(length, self.left.pop(length))
        kept = sorted(b for bins in self.open.values() for b in bins)
        self.bins = [(first, self.downsized(filled)) for first, _, filled in kept]
        self.placements.sort()

    def downsized(self, filled: int) -> int:
        return min((c for c in self.capacities if c >= filled), key=lambda c: (self.cost(c), c))

    def put(self, room: int, bins: tuple[int, int, int]) -> None:
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        heapq.heappush(self.open[room], bins)

    def place(self, length: int, n: int) -> None:
        rank, size = 0, None
        while n:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                size = size or self.cheapest(length, n)
                each = size // length
                count = max(1, n // each)
                self.put(size, (self.n_bins, count, 0))
                self.n_bins += count
                continue
            # each bin in turn takes all that fits: what is left of it stays the least room
            room = self.rooms[k]
            first, count, filled = heapq.heappop(self.open[room])
            if not self.open[room]:
                del self.open[room], self.rooms[k]
            each = min(room // length, n)
            taken = min(n // each, count)
            if taken < count:
                self.put(room, (first + taken, count - taken, filled))
            self.placements += [(length, rank + j * taken, taken, first, filled + j * length) for j in range(each)]
            self.put(room - each * length, (first, taken, filled + each * length))
            rank, n = rank + each * taken, n - each * taken

    def cheapest(self, length: int, n: int) -> int:
        """The size to open for a length of which n are left: least cost a token when filled greedily with what is left."""
        best = None
        for c in self.capacities:
            if c < length:
                continue
            filled = length * min(n, c // length)
            k = bisect_right(self.lengths, c - filled)
            while k and filled < c:
                k -= 1
                x = self.lengths[k]
                filled += x * min(self.left[x], (c - filled) // x)
                k = min(k, bisect_right(self.lengths, c - filled))
            rated = (self.cost(self.downsized(filled)) / filled, c)
            best = min(best, rated) if best else rated
        return best[1]


def pieces_of(lengths: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start and length: documents cut at the largest size."""
    n = F.greatest(F.ceil(F.col("length") / largest), F.lit(1))
    cut = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    start = F.col("piece").cast("long") * largest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("length") - start, F.lit(largest)).cast("long").alias("length"))


def packed(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost, rows_per_bucket: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset and capacity of each piece; lengths has doc_id and length (over 0)."""
    items = pieces_of(lengths.select("doc_id", F.col("length").cast("long").alias("length")), max(capacities))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, capacities, cost)
    buckets = max(16, min(4096, sum(histogram.values()) // rows_per_bucket))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = items.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = items.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    table = np.array(plan.placements, np.int64).reshape(-1, 5)
    sent = lengths.sparkSession.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table, np.array(plan.bins, np.int64).reshape(-1, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table, bins = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            where = row[:, 3] + rank - row[:, 1]
            capacity = bins[np.searchsorted(bins[:, 0], where, "right") - 1, 1]
            made = [pa.array(x) for x in (where, row[:, 4], capacity)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length")), *made], names=["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity"])

    key = lengths.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "rank").mapInArrow(run, f"doc_id {key}, piece int, start long, length long, bin_id long, bin_offset long, capacity long")


def packed_documents(docs: DataFrame, model_path: str | None = None, **limits) -> DataFrame:
    """packed() by word-piece counts, which are staged in the shared folder as they are used several times."""
    counts = token_counts(docs, model_path).select("doc_id", (F.col("n_tokens") + 1).alias("length"))
    return packed(common.staged(counts, "lengths"), **limits)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(common.table(spark, sf_dir, "documents"))
