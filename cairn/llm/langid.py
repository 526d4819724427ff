"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the sum,
over all ways to cut it into pieces, of the product of the pieces' probabilities (the forward algorithm); a text's is the
product over its words. The probabilities come from a few rounds of expected piece counts (forward and backward) over the
words of labelled training rows, smoothed with the counts of all languages together.

Training rows: rows_per_language of each language in expectation, or all if there are fewer, chosen by a hash of the row (a
documented bound; every text is taken whole, a word of any length too: up to 40 letters with plain sums, beyond with their
logarithms). Words are runs of letters, in lower case. A null text, or one without a letter, is "und" with score 0; with
nothing to learn from, every text is. Ties go to the language first in code-point order. Repeated rows get equal verdicts;
an empty table gives an empty result. Extra columns are not read, and lang, source and doc_id do not enter a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import remainder, rows_mapped, shipped, texts_of, vocabulary_bytes
from .lookup import Lookup

shipped(__name__)
META = "▁"
WORD = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
WIDTHS, SLICE, UNKNOWN = (8, 12, 16, 24, 40), 32_000, 1e-7


def words_of(text: bytes | None) -> list[str]:
    return WORD.findall((text or b"").decode().lower())


def piece_names(model: bytes) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Lattice:
    """All cuts of words into pieces. Probabilities are an array [piece, language]; its last row is for unknown characters."""

    def __init__(self, names: list[str]):
        self.longest = max(map(len, names))
        self.power = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        keys = []
        for name in names:
            h = 0
            for c in name:
                h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
            keys.append(h)
        self.find, self.unknown = Lookup(np.array(keys, np.uint64)), len(names)

    def pieces(self, words: list[str], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths (the meta symbol in front included), and by piece length k the piece at each start, -1 for none."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.zeros((len(words), width + 1), np.uint64)
        codes[np.arange(width + 1) < sizes[:, None]] = np.frombuffer("".join([META + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        prefix = np.zeros((len(words), width + 2), np.uint64)
        for i in range(width + 1):
            prefix[:, i + 1] = prefix[:, i] * BASE + codes[:, i] + np.uint64(1)
        found = [self.find(prefix[:, k:] - prefix[:, :-k] * self.power[k]) for k in range(1, min(self.longest, width + 1) + 1)]
        found[0] = np.where(found[0] < 0, self.unknown, found[0])
        return sizes, found

    def forward(self, sizes: np.ndarray, found: list[np.ndarray], p: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """alpha[end, word, language], and the probabilities by piece length; of: take only that language of each word."""
        n, width = len(sizes), int(sizes.max())
        q = [np.where((f >= 0)[..., None], p[f], 0.0) if of is None else np.where(f >= 0, p[f, of[:, None]], 0.0)[..., None] for f in found]
        alpha = np.zeros((width + 1, n, q[0].shape[2]))
        alpha[0] = 1.0
        for end in range(1, width + 1):
            for k in range(1, min(len(q), end) + 1):
                alpha[end] += alpha[end - k] * q[k - 1][:, end - k]
        return alpha, q

    def log_likelihoods(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the summed probability of each word [word, language]."""
        out = np.zeros((len(words), p.shape[1]))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(chosen), SLICE // width):
                rows = chosen[at : at + SLICE // width]
                n, found = self.pieces([words[k] for k in rows.tolist()], width)
                alpha, _ = self.forward(n, found, p)
                out[rows] = np.log(alpha[n, np.arange(len(rows))])
            low = width
        for rows in self.slices(words, np.flatnonzero(sizes > low), sizes):
            n, _, _, alpha = self.logs([words[k] for k in rows.tolist()], p)
            out[rows] = alpha[n, np.arange(len(rows))]
        return out

    def logs(self, words: list[str], p: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For words of any length: lengths, pieces, their log probabilities by piece length [word, start, language], and the
        log of alpha [end, word, language]."""
        sizes, found = self.pieces(words, max(map(len, words)))
        lp = np.log(p)
        q = [np.where((f >= 0)[..., None], lp[f], -np.inf) if of is None else np.where(f >= 0, lp[f, of[:, None]], -np.inf)[..., None] for f in found]
        width = int(sizes.max())
        alpha = np.full((width + 1, len(words), q[0].shape[2]), -np.inf)
        alpha[0] = 0.0
        for end in range(1, width + 1):
            alpha[end] = logsum(np.stack([alpha[end - k] + q[k - 1][:, end - k] for k in range(1, min(len(q), end) + 1)]))
        return sizes, found, q, alpha

    def slices(self, words: list[str], chosen: np.ndarray, sizes: np.ndarray, cells: int = 20_000) -> Iterator[np.ndarray]:
        """Long words in slices of about so many characters, or of one word."""
        chosen = chosen[np.argsort(sizes[chosen], kind="stable")]
        at = 0
        while at < len(chosen):
            n = max(1, cells // int(sizes[chosen[at]]))
            while n > 1 and n * int(sizes[chosen[min(at + n, len(chosen)) - 1]]) > 2 * cells:
                n //= 2
            yield chosen[at : at + n]
            at += n

    def expected(self, words: list[str], counts: np.ndarray, of: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of pieces [piece, language], of words of any length."""
        out = np.zeros(p.size)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(chosen), SLICE // width):
                rows = chosen[at : at + SLICE // width]
                n, found = self.pieces([words[k] for k in rows.tolist()], width)
                alpha, q = self.forward(n, found, p, of[rows])
                every, most = np.arange(len(rows)), int(n.max())
                beta = np.zeros((most + 1, len(rows)))
                beta[n, every] = 1.0
                for start in range(most - 1, -1, -1):
                    for k in range(1, min(len(q), most - start) + 1):
                        beta[start] += q[k - 1][:, start, 0] * beta[start + k]
                weight = counts[rows] / alpha[n, every, 0]
                for k in range(1, min(len(q), most) + 1):
                    for start in range(most - k + 1):
                        e = weight * alpha[start, :, 0] * q[k - 1][:, start, 0] * beta[start + k]
                        if len(some := np.flatnonzero(e > 0)):
                            np.add.at(out, found[k - 1][some, start].astype(np.int64) * p.shape[1] + of[rows[some]], e[some])
            low = width
        for rows in self.slices(words, np.flatnonzero(sizes > low), sizes):
            n, found, q, alpha = self.logs([words[k] for k in rows.tolist()], p, of[rows])
            every, most = np.arange(len(rows)), int(n.max())
            beta = np.full((most + 1, len(rows)), -np.inf)
            beta[n, every] = 0.0
            total = alpha[n, every, 0]
            for start in range(most - 1, -1, -1):
                ways = np.stack([q[k - 1][:, start, 0] + beta[start + k] for k in range(1, min(len(q), most - start) + 1)])
                beta[start] = np.where(n == start, 0.0, logsum(ways))
                for k, way in enumerate(ways):
                    e = counts[rows] * np.exp(alpha[start, :, 0] + way - total)
                    if len(some := np.flatnonzero(e > 0)):
                        np.add.at(out, found[k][some, start].astype(np.int64) * p.shape[1] + of[rows[some]], e[some])
        return out.reshape(p.shape)


def logsum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp along the first axis."""
    most = x.max(0)
    base = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return base + np.log(np.exp(x - base).sum(0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            counts.update([(lang, w) for w in words_of(text)])
            if len(counts) > 100_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def learned(docs: DataFrame, model_path: str | None = None, rows_per_language: int = 3000, rounds: int = 2, most_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """The languages and the probabilities [piece, language] from rows with text and lang.

    What comes to the driver and goes to the workers is bounded by the vocabulary's size times the number of languages, and
    more than most_languages values of lang raise."""
    spark, model = docs.sparkSession, vocabulary_bytes(model_path)
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names, langs = piece_names(model), sorted(sizes)
    if not langs:
        return [], np.zeros((len(names) + 1, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows_per_language / sizes[k]))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = common.staged(chosen.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid")
    number = {k: i for i, k in enumerate(langs)}
    p = np.full((len(names) + 1, len(langs)), 1.0 / len(names))
    p[-1] = UNKNOWN
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, q = Lattice(names), sent.value
            total = np.zeros(q.shape)
            for batch in batches:
                of = np.fromiter((number[k] for k in batch.column("lang").to_pylist()), np.int64, batch.num_rows)
                total += lattice.expected(batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float), of, q)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        got = counts.mapInArrow(step, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        expected = np.zeros(p.shape)
        expected[got["piece"].to_numpy(np.int64), got["lang"].to_numpy(np.int64)] = got["n"].to_numpy(float)
        p = smoothed(expected[:-1])
        sent.unpersist()
    common.dropped(counts)
    return langs, p


def smoothed(expected: np.ndarray, strength: float = 500.0) -> np.ndarray:
    """Probabilities from expected counts, each language's mixed with those of all languages and a uniform floor."""
    total = expected.sum(1, keepdims=True)
    shared = (total + 0.1) / (total.sum() + 0.1 * len(total))
    p = (expected + strength * shared) / (expected.sum(0) + strength)
    return np.vstack([p * (1 - UNKNOWN), np.full((1, p.shape[1]), UNKNOWN)])


def predictor(names: list[str], langs: list[str], p: np.ndarray, bound: int = 100_000):
    """A function from texts to (lang_pred, score) pairs. bound: words a worker remembers."""
    lattice, known = Lattice(names), {}
    table = np.zeros((0, len(langs)))

    def of(texts: list[bytes | None]) -> list[tuple[str, float]]:
        nonlocal table
        split = [words_of(x) for x in texts]
        if new := {w for words in split for w in words} - known.keys():
            if len(known) + len(new) > bound:
                known.clear()
                table = table[:0]
                new = {w for words in split for w in words}
            new = list(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            table = np.concatenate([table, lattice.log_likelihoods(new, p)])
        out = []
        for words in split:
            if not langs or not any(any(map(str.isalpha, w)) for w in words):
                out.append(("und", 0.0))
                continue
            total = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            out.append((langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out

    return of


def identified(docs: DataFrame, langs: list[str], p: np.ndarray, model_path: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred and score of each text."""
    names = piece_names(vocabulary_bytes(model_path))
    sent = docs.sparkSession.sparkContext.broadcast(p)
    return rows_mapped(docs, lambda: predictor(names, langs, sent.value), "lang_pred string, score double", keys=keys)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    langs, p = learned(docs.where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return identified(docs, langs, p).select("doc_id", held, "lang_pred", "score")
