"""Language-model scoring with a log-frequency Bloom filter.

An n-gram (of one or two tokens) with count c is held at the quantised level 1 + floor(log c / log base): the filter contains
(n-gram, 1), (n-gram, 2) ... up to its level. Reading a count is probing levels from 1 until one is missing; the level stands
for the mean of the counts it covers. A text's probability interpolates pairs with single tokens:

    P(w|h) = l c(h,w) / c(h) + (1 - l) P(w),   l = (1 - n1 / n) c(h) / (c(h) + history_prior),   P(w) = (c(w) + 1) / (N + V + 1)

n1 / n is the share of pairs in the training text that were seen once, over the whole of it. A text opens with a start symbol
as its first history and closes with an end token.

The key's top bits choose a shard of the filter. Counts are summed in each task over a million tokens, sent to their shards as
sorted runs, summed and written into the shard's bits; the number of shards follows the text's size, so a shard stays small,
while a task may have many. Of a large corpus the runs go to their shards in steps of STEP bits, summed again at each, so that
a run is never cut at more than 2^STEP borders. While the measured size of all shards is within most_bytes they are broadcast.
Beyond it, batches of documents send the keys they need to the shards, one request of a batch to a shard, which answer a few
requests at a time with a byte a key, so nothing grows with the corpus on any machine; the scores are the same.

Tokens are told apart by 64-bit hashes. Null and empty texts hold the end token alone. Very long texts are scored whole.
Repeated rows count each in training and are each scored. Rows without a doc_id are trained on and not held out. With nothing to train on every probability is 1.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WordHashes, mixed, remainder, shipped, staged, texts_of

shipped(__name__)

END, START = (np.uint64(xxhash.xxh3_64_intdigest(b" end")), np.uint64(xxhash.xxh3_64_intdigest(b" start")))
QUANTUM, TOP = 1.5, 64
BITS_PER_ENTRY, PROBE_BITS = 8, 4
STEP = 11
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Least count of each level, and the count that it stands for.
LEAST = np.array([QUANTUM**j for j in range(TOP)])
MEANS = np.array([0.0] + [(math.ceil(QUANTUM**j) + max(math.ceil(QUANTUM ** (j + 1)) - 1, math.ceil(QUANTUM**j))) / 2 for j in range(TOP)])


def tokens(text: bytes | None, words: WordHashes) -> np.ndarray:
    return np.append(words.of((text or b"").lower().split()), END)


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * GOLD + after)


def single_keys(h: np.ndarray) -> np.ndarray:
    return mixed(h ^ np.uint64(0x5851F42D4C957F2D))


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else np.empty(0, np.int64)


def probe(bits: np.ndarray, base: np.ndarray, size: np.ndarray, shift: int, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that holds (key, level), and its bits there."""
    h = mixed(keys + np.uint64(level * int(GOLD) & 2**64 - 1))
    shard = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    at = base[shard] + ((h >> np.uint64(32)) * size[shard] >> np.uint64(32)).astype(np.int64)
    mask = np.zeros(len(keys), np.uint64)
    for k in range(PROBE_BITS):
        mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return at, mask


def filter_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One shard's bits. keys are given without regard to the shard's number."""
    levels = np.searchsorted(LEAST, counts, "right")
    size = max(1, -(-int(levels.sum()) * BITS_PER_ENTRY // 64))
    bits = np.zeros(size, np.uint64)
    zero, whole = np.zeros(1, np.int64), np.array([size], np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, mask = probe(bits, zero, whole, 64, keys[levels >= level], level)
        np.bitwise_or.at(bits, at, mask)
    return bits


class Counts:
    """Counts by probing: of single tokens and pairs from the filter; and the exact counts of tokens."""

    def __init__(self, bits: np.ndarray, base: np.ndarray, size: np.ndarray, shift: int, words: np.ndarray, word_counts: np.ndarray):
        self.bits, self.base, self.size, self.shift, self.words, self.word_counts = bits, base, size, shift, words, word_counts

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(1, TOP + 1):
            at, mask = probe(self.bits, self.base, self.size, self.shift, keys[live], level)
            live = live[self.bits[at] & mask == mask]
            if not len(live):
                break
            out[live] = level
        return out

    def exact(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        keys = single_keys(h)
        k = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[k] == keys, self.word_counts[k], 0)


class Answered:
    """The same of the keys (sorted) that the shards have answered for one batch of documents."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, counts: np.ndarray):
        self.keys, self.found, self.counts = keys, levels, counts

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)]

    def exact(self, h: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.keys, single_keys(h))]


def keys_of(texts: list[bytes | None], words: WordHashes) -> np.ndarray:
    """The sorted distinct keys that scores() looks up."""
    each = [tokens(x, words) for x in texts]
    h = np.concatenate(each)
    before = np.concatenate([[START], h[:-1]])
    before[np.cumsum([0, *map(len, each[:-1])])] = START
    return np.unique(np.concatenate([single_keys(np.unique(h)), pair_keys(before, h)]))


def scores(texts: list[bytes | None], words: WordHashes, model, totals: dict, history_prior: float) -> list[tuple]:
    """n_tokens, n_known, base_score and score of each text."""
    each = [tokens(x, words) for x in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = np.concatenate(each)
    before = np.concatenate([[START], h[:-1]])
    before[starts] = START
    distinct, at = np.unique(h, return_inverse=True)
    exact = model.exact(distinct)
    single = MEANS[model.levels(single_keys(distinct))]
    whole = totals["tokens"] + totals["types"] + 1
    p = ((single + 1) / whole)[at]
    history = np.empty(len(h))
    history[1:] = single[at[:-1]]
    history[starts] = totals["texts"]
    pair = MEANS[model.levels(pair_keys(before, h))]
    share = (1 - totals["once"] / max(totals["pairs"], 1)) * history / (history + history_prior)
    follows = np.divide(np.minimum(pair, history), history, out=np.zeros(len(h)), where=history > 0)
    total = np.add.reduceat(np.log10(share * follows + (1 - share) * p), starts)
    base = np.add.reduceat(np.log10((exact + 1) / whole)[at], starts)
    known = np.add.reduceat((exact > 0)[at].astype(np.int64), starts)
    return list(zip(sizes.tolist(), known.tolist(), base.tolist(), total.tolist()))


def in_chunks(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start = size = 0
    for k, n in enumerate(sizes):
        if k > start and size + n > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if len(sizes) > start:
        yield batch.slice(start)


RUN = pa.schema([("part", pa.int32()), ("order", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def cut(sums: list[tuple[int, np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    """Sorted runs (order, keys, counts) cut where the first bits of the keys change: part, order, keys, counts."""
    rows = []
    for order, keys, n in sums:
        n = n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64)
        parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))[: len(keys)].tolist()
        rows += [(int(parts[a]), order, keys[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(keys)])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, RUN.types)], schema=RUN)


def counted(training: DataFrame, bits: int, chunk: int = 1_000_000) -> DataFrame:
    """part, order, keys and counts: sorted runs of the n-grams of a chunk of tokens, cut by the first bits of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        held: list[np.ndarray] = []

        def out(each: list[np.ndarray]) -> pa.RecordBatch:
            h = np.concatenate(each)
            before = np.concatenate([[START], h[:-1]])
            before[np.cumsum([0, *map(len, each[:-1])])] = START
            return cut([(1, *summed(single_keys(h))), (2, *summed(pair_keys(before, h)))], bits)

        size = 0
        for batch in batches:
            for part in in_chunks(batch):
                for x in texts_of(part):
                    held.append(tokens(x, words))
                    size += len(held[-1])
                    if size >= chunk:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    return training.select("text").mapInArrow(run, "part int, order int, keys binary, counts binary")


def _run(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint64 if len(counts) == len(keys) else np.uint32)


def dealt(runs: DataFrame, bits: int, tasks: int) -> DataFrame:
    """Runs of one part in one task, in order of parts; neighbouring parts share a task where there are more parts than tasks (a
    power of two)."""
    return runs.repartitionById(min(1 << bits, tasks), F.expr(f"cast(part >> {max(0, bits - tasks.bit_length() + 1)} as int)")).sortWithinPartitions("part")


def recut(runs: DataFrame, bits: int, finer: int, tasks: int, chunk: int = 4_000_000) -> DataFrame:
    """Runs cut by the first finer bits, summed over a chunk of keys; each task holds one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, {1: [], 2: []}, 0
        for batch in batches:
            for k, order, keys, n in zip(*(batch.column(c).to_pylist() for c in RUN.names)):
                if k != part or size >= chunk:
                    if size:
                        yield cut([(o, *_joined(p)) for o, p in held.items()], finer)
                    part, held, size = k, {1: [], 2: []}, 0
                held[order].append(_run(keys, n))
                size += len(held[order][-1][0])
        if size:
            yield cut([(o, *_joined(p)) for o, p in held.items()], finer)

    return dealt(runs, bits, tasks).mapInArrow(run, "part int, order int, keys binary, counts binary")


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs summed into one."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))


MODEL = "shard int, filter binary, words binary, word_counts binary, tokens long, types long, pairs long, once long"


def shards(runs: DataFrame, bits: int, tasks: int) -> DataFrame:
    """The model's shards: bits of the filter, exact counts of tokens, and what the totals are summed from."""
    names = [x.split()[0] for x in MODEL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {1: [], 2: []}

        def out() -> pa.RecordBatch:
            (w, n), (g, m) = (_joined(held[order]) for order in (1, 2))
            row = (shard, filter_of(np.concatenate([w, g]), np.concatenate([n, m])).tobytes(), w.tobytes(), n.astype(np.int64).tobytes(), int(n.sum()), len(w), int(m.sum()), int((m == 1).sum()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4))], names=names)

        for batch in batches:
            for k, order, keys, n in zip(*(batch.column(c).to_pylist() for c in RUN.names)):
                if k != shard:
                    if shard is not None:
                        yield out()
                    shard, held = k, {1: [], 2: []}
                held[order].append(_run(keys, n))
        if shard is not None:
            yield out()

    return dealt(runs, bits, tasks).mapInArrow(run, MODEL)


def trained(training: DataFrame, tokens_per_shard: int = 1_500_000, most_tasks: int = 8192, step: int = STEP) -> tuple[DataFrame, dict]:
    """The staged shards and the totals: tokens, types, pairs, once, texts, bits (of the shard's number) and bytes."""
    size = training.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    bits = max(0, math.ceil(math.log2(max(1, (size["bytes"] or 0) / 6 / tokens_per_shard))))
    at = min(bits, step)
    runs = counted(training, at)
    while at < bits:
        runs, at = recut(runs, at, min(bits, at + step), most_tasks), min(bits, at + step)
    model = staged(shards(runs, bits, most_tasks), "lm")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = [total(c).alias(c) for c in ("tokens", "types", "pairs", "once")] + [total(F.length("filter")).alias("filter")]
    totals = model.agg(*sums, total(F.length("filter") + F.length("words") + F.length("word_counts")).alias("bytes")).first()
    return model, totals.asDict() | {"texts": size["texts"], "bits": bits}


def gathered(model: DataFrame, totals: dict) -> Counts:
    """All shards as one model; only called for a model of a checked size. A shard at a time is copied into its place."""
    n = 1 << totals["bits"]
    base, size = np.zeros(n, np.int64), np.ones(n, np.uint64)
    bits = np.zeros(1 + totals["filter"] // 8, np.uint64)  # shards that hold nothing share the first word, which is empty
    words, counts = np.empty(totals["types"], np.uint64), np.empty(totals["types"], np.uint32 if totals["tokens"] < 1 << 32 else np.int64)
    at, first = 1, 0
    for r in model.select("shard", "filter", "words", "word_counts").orderBy("shard").toLocalIterator():
        part, w = np.frombuffer(r["filter"], np.uint64), np.frombuffer(r["words"], np.uint64)
        base[r["shard"]], size[r["shard"]] = at, len(part)
        bits[at : at + len(part)] = part
        words[first : first + len(w)] = w
        counts[first : first + len(w)] = np.frombuffer(r["word_counts"], np.int64)
        at, first = at + len(part), first + len(w)
    return Counts(bits, base, size, 64 - totals["bits"], words, counts)


FIELDS = (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
SCORED = "n_tokens long, n_known long, base_score double, score double"


def _rows(part: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(zip(*made), FIELDS))], names=["doc_id", *(n for n, _ in FIELDS)])


def scored(docs: DataFrame, model: DataFrame, totals: dict, history_prior: float = 5.0, most_bytes: int = 256 << 20, batch_rows: int = 2000) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each text."""
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCORED}"
    if totals["bytes"] > most_bytes:
        return _routed(docs, model, totals, history_prior, batch_rows, schema)
    sent = docs.sparkSession.sparkContext.broadcast(gathered(model, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordHashes(100_000), sent.value
        for batch in batches:
            for part in in_chunks(batch):
                yield _rows(part, scores(texts_of(part), words, counts, totals, history_prior))

    return docs.mapInArrow(run, schema)


def requested(docs: DataFrame, bits: int, batch_rows: int, batch_bytes: int = 8 << 20, most_tasks: int = 8192) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with their batch, a batch in one task; and shard, batch and keys: one request of each batch to each
    shard, whatever the tasks that docs came in. Both read one shuffle of the texts, so both keep all its columns."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-size["n"] // batch_rows), -(-(size["bytes"] or 0) // batch_bytes))
    docs = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(min(n, most_tasks), "batch")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, held = WordHashes(), None, []

        def out() -> pa.RecordBatch:
            made = cut([(1, np.unique(np.concatenate(held)), np.empty(0, np.uint64))], bits)
            return pa.RecordBatch.from_arrays([made.column("part"), pa.array([now] * made.num_rows, pa.int64()), made.column("keys")], names=["shard", "batch", "keys"])

        for batch in batches:
            for part in in_chunks(batch):
                of = part.column("batch").to_numpy()
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
                for a, b in zip(starts, [*starts[1:], len(of)]):
                    if now is not None and of[a] != now:
                        yield out()
                        held = []
                    now = int(of[a])
                    held.append(keys_of(texts_of(part.slice(a, b - a)), words))
        if held:
            yield out()

    return docs, docs.sortWithinPartitions("batch").mapInArrow(ask, "shard int, batch long, keys binary")


def _routed(docs: DataFrame, model: DataFrame, totals: dict, history_prior: float, batch_rows: int, schema: str, most_tasks: int = 8192) -> DataFrame:
    bits = totals["bits"]
    common.small_batches(docs.sparkSession)
    docs, asked = requested(docs, bits, batch_rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's row comes first (its batch is null), then its requests, a few at a time. Only words have exact counts."""
        shard = counts = None
        nothing = Counts(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.ones(1, np.uint64), 64, np.empty(0, np.uint64), np.empty(0, np.int64))
        for held in batches:
            for at in range(0, held.num_rows, 64):
                made = []
                for k, rows in groupby(held.slice(at, 64).to_pylist(), lambda r: r["shard"]):
                    rows = list(rows)
                    for r in rows:
                        if r["batch"] is None:
                            part = np.frombuffer(r["filter"], np.uint64)
                            shard, counts = k, Counts(part, np.zeros(1, np.int64), np.array([len(part)], np.uint64), 64, np.frombuffer(r["words"], np.uint64), np.frombuffer(r["word_counts"], np.int64))
                    rows = [r for r in rows if r["batch"] is not None]
                    if not rows:
                        continue
                    model, keys = counts if k == shard else nothing, np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64)
                    exact = np.zeros(len(keys), np.int64)
                    if len(model.words):
                        place = np.minimum(np.searchsorted(model.words, keys), len(model.words) - 1)
                        exact = np.where(model.words[place] == keys, model.word_counts[place], 0)
                    levels, some = model.levels(keys).astype(np.uint8), np.flatnonzero(exact)
                    ends = np.cumsum([len(r["keys"]) // 8 for r in rows])
                    for r, a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist()):
                        own = some[np.searchsorted(some, a) : np.searchsorted(some, b)]
                        made.append((r["batch"], k, levels[a:b].tobytes(), (own - a).astype(np.uint32).tobytes(), exact[own].tobytes()))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["batch", "shard", "levels", "places", "exact"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The batch's keys are made again from its texts: in order, they are those of the first shard, the second ..."""
        words = WordHashes()
        parts = [p for b in texts.to_batches() if b.num_rows for p in in_chunks(b)]
        keys = np.unique(np.concatenate([keys_of(texts_of(p), words) for p in parts]))
        answers = answers.sort_by("shard")
        levels = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)
        if len(levels) != len(keys):
            raise RuntimeError(f"{len(levels)} answers to {len(keys)} keys")
        counts, at = np.zeros(len(keys), np.int64), 0
        for n, places, exact in zip(pc.binary_length(answers.column("levels")).to_pylist(), answers.column("places").to_pylist(), answers.column("exact").to_pylist()):
            counts[at + np.frombuffer(places, np.uint32).astype(np.int64)] = np.frombuffer(exact, np.int64)
            at += n
        model = Answered(keys, levels, counts)
        return pa.Table.from_batches([_rows(p, scores(texts_of(p), words, model, totals, history_prior)) for p in parts])

    held = model.select("shard", "filter", "words", "word_counts").unionByName(asked, allowMissingColumns=True)
    tasks = min(1 << bits, most_tasks)
    held = held.repartitionById(tasks, F.expr(f"cast(shard >> {max(0, bits - tasks.bit_length() + 1)} as int)")).sortWithinPartitions("shard", F.asc_nulls_first("batch"))
    answers = held.select("shard", "batch", "keys", "filter", "words", "word_counts").mapInArrow(answer, "batch long, shard int, levels binary, places binary, exact binary")
    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    model, totals = trained(docs.where(~held).select("text"))
    out = scored(docs, model, totals)
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(int(totals["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")
