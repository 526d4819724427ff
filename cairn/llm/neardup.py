"""Near-duplicates by min-max hashing.

A document's set is its distinct five-word shingles. Under each hash function both the smallest and the largest value are
kept, so 64 functions give 128 values, each pair of sets agreeing in each with a chance of their Jaccard similarity. Bands of
five values make buckets. Equal sets are one class from the start, so copies never meet in a bucket.

Links are confirmed on the full sets. In each bucket one class is the pivot and all others are compared with it; what is then
in one component needs no further comparison. Buckets of more than eight blocks that still hold several components get further
pivots, each compared with all members of other components, as long as that finds links. Where a bucket then still holds
several components, its members are compared across them, block by block, by their 128 values, and pairs that may reach the
threshold are confirmed in the same way. No cap is set on buckets or partners. With 25 bands of five, a pair at similarity 0.85
shares no bucket with a chance of 4e-7, and its values agree in less than 0.65 with one of 1e-8, when the full sets are not
looked at. Thresholds below 0.85 take 32 bands of four: at 0.8 the chances are 5e-8 and 8e-8.

Classes are told apart by 128-bit hashes of the sets of 64-bit shingles. Null and empty texts and texts without words have an
empty set and link to nothing. Fewer than five words: the whole sequence is the one shingle. Very long texts are read whole.
Repeated rows belong to one class and are each returned; rows that share only a doc_id are kept apart by their sets. Rows with a
null doc_id take part, but give no component its id; a component of such rows alone has a null id and its rows are kept. Ties
have no say: a component's id is its smallest. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WordHashes, dropped, mixed, near, shipped, staged, texts_of, windows
from .components import components

shipped(__name__)

SHINGLE, FUNCTIONS = 5, 64
BLOCK = 1024
PIVOTED = 8  # blocks of a bucket beyond which further pivots come first: up to it, no member is compared in more than 8 blocks
_draw = np.random.default_rng(20240501)
FACTORS = _draw.integers(0, 2**63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def banded(percent: int) -> tuple[int, int, float]:
    """Values a band, bands, and the margin: pairs whose 128 values agree in a share below percent / 100 - margin are not confirmed."""
    return (5, 25, 0.2) if percent >= 85 else (4, 32, 0.2)


def shingle_set(text: bytes | None, words: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = words.of(w)
    return np.unique(windows(h, min(SHINGLE, len(h))))


def class_of(s: np.ndarray) -> bytes:
    """A 128-bit hash of a set; nothing for the empty one."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def min_max(s: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each function, smallest first."""
    low, high = np.full(FUNCTIONS, np.uint64(2**64 - 1)), np.zeros(FUNCTIONS, np.uint64)
    for at in range(0, len(s), 1024):
        v = s[at : at + 1024, None] * FACTORS
        low, high = np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
    return np.concatenate([low, high])


def signature(s: np.ndarray, percent: int) -> tuple[list[int], bytes]:
    """Bucket keys, one a band, and 16 bits of each value."""
    rows, bands, _ = banded(percent)
    values = mixed(min_max(s))
    # a band takes values of different functions, lows and highs in turn
    order = (np.arange(rows * bands) * 67) % (2 * FUNCTIONS)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[order[r * bands : (r + 1) * bands]])
    return key.astype(np.int64).tolist(), (values >> np.uint64(48)).astype("<u2").tobytes()


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, h (of the set), keys and sketch of each row."""

    def make():
        words = WordHashes()

        def of(texts):
            out = []
            for x in texts:
                s = shingle_set(x, words)
                out.append((len(s), class_of(s), *(signature(s, percent) if len(s) else ([], b""))))
            return out

        return of

    return common.rows_mapped(docs, make, "n_shingles long, h binary, keys array<long>, sketch binary")


def scored(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that may reach percent, with share, the part of the 128 values in which they agree."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))

    least = percent / 100 - banded(percent)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, 2 * FUNCTIONS) for c in ("sa", "sb"))
                share = (x == y).mean(1)
                keep = pa.array(share >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(share).filter(keep)], names=["a", "b", "share"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, share double")


def full_sets(involved: DataFrame, classes: DataFrame, docs: DataFrame, member: DataFrame) -> DataFrame:
    """cls and set (the sorted hashes) of the classes in involved, a staged table; staged. member: doc_id and cls of each row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"]
    n = involved.count()
    chosen = staged(member.join(near(involved, n), "cls", "left_semi").groupBy("cls").agg(first.alias("doc_id")).join(classes.select("cls", "h"), "cls"), "chosen")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                made = [shingle_set(x, words) for x in texts_of(batch.slice(at, 200))]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())], names=["h", "set"])

    ids = chosen.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(near(ids, n), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.mapInArrow(sets, "h binary, set binary").join(near(chosen.select("cls", "h"), n), "h").select("cls", "set")
    out = staged_sets(found.dropDuplicates(["cls"]), "sets")
    dropped(chosen)
    return out


def staged_sets(df: DataFrame, what: str, rows: int = 500) -> DataFrame:
    """staged(), with few rows an Arrow batch: they carry whole sets, which for very long texts are large."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        return staged(df, what)
    finally:
        conf.set(name, usual)


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach percent."""
    involved = staged(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "involved")
    full = full_sets(involved, classes, docs, member)
    side = lambda c: full.select(F.col("cls").alias(c), F.col("set").alias(f"s{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("sa"), batch.column("sb"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    out = staged_sets(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    dropped(involved, full)
    return out


def undecided(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with theirs; staged."""
    known = component.select(F.col("node").alias("cls"), "component")
    m = members.join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    several = m.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return staged(m.join(several, "key", "left_semi").select("key", "cls", "c", "component"), "undecided")


def further(members: DataFrame, draw: int) -> DataFrame:
    """Pairs (a, b) of each bucket's pivot, drawn by a hash, and its members of other components."""
    least = F.min(F.struct(F.xxhash64("cls", "key", F.lit(draw)), "cls", "component"))
    pivots = members.groupBy("key").agg(least.alias("p")).select("key", F.col("p.cls").alias("pivot"), F.col("p.component").alias("its"))
    pairs = members.join(pivots, "key").where("cls <> pivot and component <> its")
    return pairs.select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()


def across(members: DataFrame, component: DataFrame, classes: DataFrame, docs: DataFrame, of_row: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket. members: key, cls, c (the bucket's size); component: node, component.

    Large buckets are compared block against block, in as many tasks. A first pass finds, by the 128 values, the classes with a
    possible partner at all; a second compares these on their full sets where they lie. What leaves a task is at most one row
    for each class in it: a link only where the two are not yet connected there. A pair is compared in the first band that
    it shares and in no other."""
    m = undecided(members, component)
    values = classes.select("cls", "n_shingles", "sketch", "keys")
    possible = staged(_dealt(m.join(values, "cls"), []).mapInArrow(_compared(percent, exact=False), "cls long").distinct(), "possible")
    full = full_sets(possible, classes, docs, of_row)
    out = staged_sets(_dealt(m.join(values, "cls").join(full, "cls"), ["set"]).mapInArrow(_compared(percent, exact=True), "a long, b long").distinct(), "across")
    dropped(m, possible, full)
    return out


GROUPED = ["key", "i", "j", "block", "cls", "component", "n_shingles", "sketch", "keys"]


def _dealt(m: DataFrame, more: list[str]) -> DataFrame:
    """Members of buckets by pairs of blocks (i, j), those of one pair together and in order."""
    blocks = F.ceil(F.col("c") / BLOCK)
    m = m.withColumn("block", F.pmod(F.xxhash64("cls"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    m = m.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return m.select(*GROUPED, *more).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls")


def _compared(percent: int, exact: bool):
    """For mapInArrow over _dealt(): the classes with a possible partner of another component, or the links that hold."""
    least = percent / 100 - banded(percent)[2]

    def candidates(rows: list[tuple], key: int) -> Iterator[tuple[int, np.ndarray]]:
        block, cls, comp, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        x = np.frombuffer(b"".join([r[4] for r in rows]), "<u2").reshape(len(rows), -1)
        keys = np.array([r[5] for r in rows], np.int64)
        same = block.min() == block.max()
        for k in range(len(rows) - 1 if same else len(rows)):
            rest = np.arange(k + 1, len(rows)) if same else np.flatnonzero(block > block[k])
            rest = rest[(comp[rest] != comp[k]) & (np.minimum(n[rest], n[k]) * 100 >= np.maximum(n[rest], n[k]) * percent)]
            if len(rest):
                rest = rest[(x[rest] == x[k]).mean(1) >= least]
            if len(rest):
                rest = rest[keys[k][(keys[rest] == keys[k]).argmax(1)] == key]
            if len(rest):
                yield k, rest

    def partners(rows: list[tuple], key: int) -> list[tuple]:
        return [(c,) for c in {rows[r][1] for k, rest in candidates(rows, key) for r in (k, *rest.tolist())}]

    def links(rows: list[tuple], key: int) -> list[tuple]:
        top = {r[2]: r[2] for r in rows}

        def root(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        out = []
        for k, rest in candidates(rows, key):
            mine = np.frombuffer(rows[k][6], np.uint64)
            for r in rest.tolist():
                p, q = root(rows[k][2]), root(rows[r][2])
                if p != q and reaches(mine, np.frombuffer(rows[r][6], np.uint64), percent):
                    top[p] = q
                    out.append((rows[k][1], rows[r][1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = (["a", "b"], links) if exact else (["cls"], partners)
        held, group, out = [], None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    if row[:3] != group:
                        if len(held) > 1:
                            out += found(held, group[0])
                        held, group = [], row[:3]
                    held.append(row[3:])
                if len(out) >= 5000:
                    yield made()
                    out = []
        if len(held) > 1:
            out += found(held, group[0])
        if out:
            yield made()

    return run


def classes_linked(docs: DataFrame, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls of each row; node, component of each class with links), both staged."""
    docs = docs.select("doc_id", "text")
    signed = staged(signatures(docs, percent), "signatures")
    full = signed.where("n_shingles > 0")
    # a class has a number of its own, so no two sets share one
    classes = full.groupBy("h").agg(*[F.first(c).alias(c) for c in ("n_shingles", "keys", "sketch")])
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    out = staged(signed.select("doc_id", "n_shingles", "h").join(classes.select("h", "cls"), "h", "left").select("doc_id", "n_shingles", "cls"), "rows")
    of_row = out.where("cls is not null").select("doc_id", "cls")
    rows = classes.select("cls", F.explode("keys").alias("key"))
    pivot = F.min(F.struct(F.xxhash64("cls", "key"), "cls"))["cls"].alias("pivot")
    buckets = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), pivot).where("c > 1"), "buckets")
    members = staged(rows.join(near(buckets, buckets.count()), "key"), "buckets")
    star = members.where("cls <> pivot").select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()
    first = staged(scored(star, classes, percent), "star")
    links = confirmed(first, classes, docs, of_row, percent)
    found, draw = staged(components(links), "components"), 0
    many = F.col("c") > PIVOTED * BLOCK
    while not buckets.where(many).isEmpty():
        # buckets of many blocks: further pivots while they find links
        large = undecided(members.where(many), found)
        draw += 1
        pairs = staged(scored(further(large, draw), classes, percent), "star")
        more = confirmed(pairs, classes, docs, of_row, percent) if not pairs.isEmpty() else pairs
        dropped(large)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = staged(components(links), "components")
    more = across(members, found, classes, docs, of_row, percent)
    if not more.isEmpty():
        found = staged(components(links.unionByName(more)), "components")
    dropped(signed, classes, buckets, members, first, more)
    return out, found


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows, found = classes_linked(docs, percent)
    own = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    own = own.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = own.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = own.join(ids, "component").select("cls", "component_id")
    linked = rows.where("n_shingles > 0").join(of_class, "cls").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"))
