"""Quality rules: robust multivariate outliers.

Each document becomes a vector of transformed statistics. For each language and source, each language and all documents
together, the minimum covariance determinant estimate of centre and spread is found: from three deterministic starts (medians
and deviations; the correlation of squashed values; the spatial sign covariance) concentration steps take the share of rows
nearest the current centre and estimate again, as long as the determinant falls. The start that ends with the least
determinant stays. It is made consistent with the normal law, and estimated once more over all rows within the 0.975 quantile
of chi-squared. A document is rejected if its squared Mahalanobis distance from its language's and source's estimate is beyond
the quantile limit.

Each estimate leans on the one above it (source on language, language on all) as if prior_rows rows had come from there: this
counts in a group of a few rows and vanishes in a large one, so there is no least size and no document without a distance.
Null lang or source is a value of its own.

A step is one aggregation: rows fall into fine bins of distance, each group's bins carry counts, sums and products of the
statistics, and the nearest share is the first bins and the part of the next that make it up. No rows are sorted or gathered,
a group of any size is summed before the shuffle, and where the groups are too many to broadcast they are matched in salted
parts. Equal vectors count once in an estimate, so copies of one text cannot become a group's centre.

Null and empty texts have no words and fail the base rule, as do texts of fewer than 20 words. Very long texts are measured
whole, and vectors at the same distance share a bin, so ties have no order to depend on. Repeated rows are each judged and get
equal verdicts. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import WordHashes, rows_mapped, shipped, windows

shipped(__name__)

#: Fixed values of the contract.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The statistics and the least standard deviation that each counts with.
STATISTICS = {"words": 0.3, "word_length": 0.03, "symbols": 0.3, "upper": 0.3, "points": 0.3, "repeats": 0.15, "variety": 0.15, "lines": 0.4}
P = len(STATISTICS)
X = [f"x{i}" for i in range(P)]
BINS = 24  # bins of distance for each factor of e


def measured(texts: list[bytes | None], words_of: WordHashes) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector of each text."""
    out = []
    for x in texts:
        x = x or b""
        words = x.split()
        n = len(words)
        chars = len(x.translate(None, SPACE).decode())
        symbols = len(x) - len(x.translate(None, SYMBOLS))
        lines = [k for k in x.split(b"\n") if k.strip()]
        dup = len(lines) - len(set(lines))
        repeat = repeated(windows(words_of.of(words), 8), n) if n > 8 else 0
        upper = len(x) - len(x.translate(None, UPPER))
        points = len(x) - len(x.translate(None, b".,;:!?"))
        m, c = max(n, 1), max(chars, 1)
        rate = lambda k, of: math.asinh(100 * k / of)
        out.append((n, chars, symbols, dup, repeat, math.log1p(n), math.log(c / m), rate(symbols, c), rate(upper, c), rate(points, c), repeat / m, math.log((len(set(words)) + 1) / (m + 1)), math.log(m / max(len(lines), 1))))
    return out


def repeated(w: np.ndarray, n: int) -> int:
    """Words in windows of eight that occur twice or more, each word once."""
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    edge = np.zeros(n + 1, np.int64)
    at = order[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 8, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the vector's columns x0, x1 ..."""

    def make():
        hashes = WordHashes()
        return lambda texts: measured(texts, hashes)

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{x} double" for x in X)
    return rows_mapped(docs, make, fields, keys=("doc_id", "lang", "source"))


def chi2_cdf(x: float, k: int) -> float:
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 0
    while term > total * 1e-14:
        i += 1
        term *= z / (a + i)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def levels(rows: DataFrame) -> DataFrame:
    """g and vector of each group's rows, equal ones once: language and source ("l\1s"), language ("l") and all ("")."""
    own = rows.select("g", *X).distinct()
    lang = own.select(F.split_part("g", F.lit("\1"), F.lit(1)).alias("g"), *X).distinct()
    return own.unionByName(lang.select(F.concat(F.lit("\2"), "g").alias("g"), *X)).unionByName(lang.select(F.lit("").alias("g"), *X).distinct())


def matched(rows: DataFrame, found: DataFrame, groups: int, most_broadcast: int, salts: int = 32) -> DataFrame:
    """rows with their group's columns of found, a table of a few rows for each of so many groups: broadcast within the bound,
    else joined in salted parts, so that a group of any size is spread."""
    if groups <= most_broadcast:
        return rows.join(F.broadcast(found), "g")
    salt = F.pmod(F.xxhash64(*X), F.lit(salts))
    parts = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(parts, ["g", "_salt"]).drop("_salt")


def _distance():
    """The squared Mahalanobis distance of a row from its center by its precision. One SQL text: a call a term would be slow."""
    d = [f"(x{i} - center[{i}])" for i in range(P)]
    terms = [f"{d[i]} * {d[j]} * precision[{i * P + j}] * {1.0 if i == j else 2.0}D" for i in range(P) for j in range(i, P)]
    return F.expr(f"greatest({' + '.join(terms)}, 0.0D)")


ESTIMATE = "g string, start int, n long, center array<double>, spread array<double>, precision array<double>, logdet double, was double"
TYPES = [pa.string(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.float64()]
ROWS, COLUMNS = np.triu_indices(P)


def _sums(values: list[str]) -> list:
    """Aggregates: the count, and an array of the sums and products of the given P columns."""
    terms = [*values, *[f"{values[i]} * {values[j]}" for i, j in zip(ROWS.tolist(), COLUMNS.tolist())]]
    return [F.count(F.lit(1)).alias("n"), F.expr(f"array({', '.join(f'sum({t})' for t in terms)})").alias("sums")]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _moments(n: np.ndarray, sums: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and second moments of rows of sums, each with its weight."""
    w = np.ones(len(n)) if weight is None else weight
    v = w @ sums / (w @ n)
    second = np.zeros((P, P))
    second[ROWS, COLUMNS] = second[COLUMNS, ROWS] = v[P:]
    return v[:P], second


def _floor() -> np.ndarray:
    return np.diag(np.array(list(STATISTICS.values())) ** 2)


def _row(g: str, start: int, n: int, center: np.ndarray, spread: np.ndarray, was: float) -> pa.Table:
    row = (g, start, n, center.tolist(), spread.ravel().tolist(), np.linalg.inv(spread).ravel().tolist(), float(np.linalg.slogdet(spread)[1]), was)
    return pa.table([pa.array([x], t) for x, t in zip(row, TYPES)], names=[x.split()[0] for x in ESTIMATE.split(", ")])


def _first(sums: pa.Table) -> pa.Table:
    """One group's start: spreads of standardised values (0), squashed values (1) or directions (2), scaled back."""
    mean, second = _moments(sums["n"].to_numpy(), _matrix(sums["sums"]))
    center, scale = _matrix(sums["m"])[0], _matrix(sums["d"])[0]
    start = sums["start"][0].as_py()
    if start == 0:
        corr = np.eye(P)
    elif start == 1:
        cov = second - np.outer(mean, mean) + 1e-9 * np.eye(P)
        corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    else:
        corr = second * P
    return _row(sums["g"][0].as_py(), start, sums["n"][0].as_py(), center, corr * np.outer(scale, scale) + _floor(), math.inf)


def _concentrated(share: float):
    """Of one group's bins in order of distance: the estimate over the nearest share of its rows."""
    factor = share / chi2_cdf(chi2_quantile(share, P), P + 2)

    def f(bins: pa.Table) -> pa.Table:
        order = np.argsort(bins["bin"].to_numpy())
        n = bins["n"].to_numpy()[order]
        left = share * n.sum() - (np.cumsum(n) - n)
        mean, second = _moments(n, _matrix(bins["sums"])[order], np.clip(left / n, 0, 1))
        return _row(bins["g"][0].as_py(), bins["start"][0].as_py(), int(n.sum()), mean, (second - np.outer(mean, mean)) * factor + _floor(), bins["was"][0].as_py())

    return f


def _reweighted(within: float):
    factor = within / chi2_cdf(chi2_quantile(within, P), P + 2)

    def f(sums: pa.Table) -> pa.Table:
        mean, second = _moments(sums["n"].to_numpy(), _matrix(sums["sums"]))
        return _row(sums["g"][0].as_py(), 0, sums["of"][0].as_py(), mean, (second - np.outer(mean, mean)) * factor + _floor(), math.inf)

    return f


def leaned(found: DataFrame, prior_rows: float, most_broadcast: int) -> DataFrame:
    """Estimates of all levels, each drawn towards the one above by the weight of prior_rows rows."""

    def mixed(at: str) -> list:
        weight = prior_rows / (F.col("n") + prior_rows)
        return [F.zip_with(c, f"{at}_{c}", lambda x, y: x * (1 - weight) + y * weight).alias(c) for c in ("center", "spread")]

    named = lambda df, at: df.select(F.col("g").alias(f"{at}_g"), F.col("center").alias(f"{at}_center"), F.col("spread").alias(f"{at}_spread"))
    found = found.select("g", "n", "center", "spread")
    every = found.where("g = ''")
    lang = found.where(F.col("g").startswith("\2"))
    few = (lambda df: F.broadcast(df)) if lang.count() <= most_broadcast else (lambda df: df)
    lang = lang.withColumn("up_g", F.lit("")).join(F.broadcast(named(every, "up")), "up_g").select("g", "n", *mixed("up"))
    own = found.where(F.col("g").contains("\1"))
    of = F.concat(F.lit("\2"), F.split_part("g", F.lit("\1"), F.lit(1)))
    own = own.withColumn("up_g", of).join(few(named(lang, "up")), "up_g").select("g", "n", *mixed("up"))

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.linalg.inv(np.array(x).reshape(P, P)).ravel().tolist() for x in b.column("spread").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=[*b.schema.names, "precision"])

    out = every.unionByName(lang).unionByName(own)
    return out.mapInArrow(inverted, "g string, n long, center array<double>, spread array<double>, precision array<double>")


def middles(rows: DataFrame, values: list[str], parts: int = 16) -> DataFrame:
    """g and middle: each group's medians of P values (SQL), to a part of the least deviation that a statistic counts with. Counts
    of bins, not values, are what a group holds."""
    width = F.expr(f"array({', '.join(f'{w / parts}D' for w in STATISTICS.values())})")
    each = rows.select("g", F.expr(f"posexplode(array({', '.join(values)})) as (c, v)"))
    bins = each.groupBy("g", "c", F.floor(F.col("v") / F.get(width, F.col("c"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("g", "c").orderBy("bin")
    upto, of = F.sum("n").over(order), F.sum("n").over(Window.partitionBy("g", "c"))
    half = bins.withColumn("upto", upto).withColumn("of", of).where("2 * upto >= of").groupBy("g", "c").agg(F.min("bin").alias("bin"))
    value = ((F.col("bin") + 0.5) * F.get(width, F.col("c"))).alias("v")
    listed = F.sort_array(F.collect_list(F.struct("c", value)))
    return half.groupBy("g").agg(F.transform(listed, lambda x: x["v"]).alias("middle"))


def concentrated(rows: DataFrame, groups: int, share: float, falls: float, most_broadcast: int) -> DataFrame:
    """The estimate of least determinant for each group of rows (g and the vector's columns): g, n, center, spread, precision."""
    medians = common.staged(middles(rows, X).withColumnRenamed("middle", "m"), "medians")
    from_m = [f"abs({x} - m[{i}])" for i, x in enumerate(X)]
    apart = middles(matched(rows, medians, groups, most_broadcast), from_m)
    scale = ", ".join(f"greatest(middle[{i}] * 1.4826D, {w}D)" for i, w in enumerate(STATISTICS.values()))
    apart = apart.join(medians, "g").select("g", "m", F.expr(f"array({scale})").alias("d"))
    apart = common.staged(apart, "apart")
    z = [f"(({x} - m[{i}]) / d[{i}]) as z{i}" for i, x in enumerate(X)]
    scaled = matched(rows, apart, groups, most_broadcast).selectExpr("g", "m", "d", *z)
    norm = F.expr(f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(P))} + 1e-12D)")
    turns = [", ".join(f"{f.format(f'z{i}')} as t{i}" for i in range(P)) for f in ("{}", "tanh({})", "{} / norm")]
    turned = F.expr(f"explode(array({', '.join(f'struct({k} as start, {t})' for k, t in enumerate(turns))}))")
    three = scaled.withColumn("norm", norm).select("g", "m", "d", turned.alias("t")).select("g", "m", "d", "t.*")
    sums = three.groupBy("g", "start").agg(*_sums([f"t{i}" for i in range(P)]), F.max("m").alias("m"), F.max("d").alias("d"))
    now = common.staged(sums.groupBy("g", "start").applyInArrow(_first, ESTIMATE), "estimate")
    ended, used = [], [medians, apart]
    while True:
        near = matched(rows, now.select("g", "start", "center", "precision", F.col("logdet").alias("was")), groups, most_broadcast)
        binned = near.withColumn("bin", F.floor(F.log(_distance() + 1e-6) * BINS))
        sums = binned.groupBy("g", "start", "bin").agg(F.max("was").alias("was"), *_sums(X))
        step = common.staged(sums.groupBy("g", "start").applyInArrow(_concentrated(share), ESTIMATE), "estimate")
        # the first step's determinants follow starts that are no estimates over the share: they may rise
        first = not ended
        fell = F.lit(True) if first else F.col("was") - F.col("logdet") > falls
        ended.append(step.where(~fell))
        used += [now, step]
        now = step.where(fell)
        if now.isEmpty():
            break
    every = reduce(DataFrame.unionByName, ended)
    best = F.min_by(F.struct("n", "center", "spread", "precision"), F.struct("logdet", "start")).alias("e")
    out = common.staged(every.groupBy("g").agg(best).select("g", "e.*"), "concentrated")
    for x in used:
        if hasattr(x, "_cairn_path"):
            common.dropped(x)
    return out


def estimates(rows: DataFrame, share: float = 0.75, within: float = 0.975, falls: float = 1e-3, prior_rows: float = 2 * P, most_broadcast: int = 20_000) -> DataFrame:
    """g, n, center, spread and precision of each group of rows (g and the vector's columns): concentrated, leaned, reweighted
    and leaned again."""
    groups = rows.select("g").distinct().count()
    raw = concentrated(rows, groups, share, falls, most_broadcast)
    held = common.staged(leaned(raw, prior_rows, most_broadcast), "leaned")
    near = matched(rows, held.select("g", "center", "precision", F.col("n").alias("of")), groups, most_broadcast).where(_distance() <= chi2_quantile(within, P))
    again = near.groupBy("g").agg(F.max("of").alias("of"), *_sums(X))
    again = again.groupBy("g").applyInArrow(_reweighted(within), ESTIMATE).select("g", "n", "center", "spread")
    kept = raw.select("g", "n", "center", "spread").join(again.select("g"), "g", "left_anti")  # no row within: the raw estimate
    out = common.staged(leaned(common.staged(again.unionByName(kept), "reweighted"), prior_rows, most_broadcast), "estimates")
    common.dropped(raw)
    common.dropped(held)
    return out


def judged(docs: DataFrame, quantile: float = 0.9999, most_broadcast: int = 20_000, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, distance (squared) and kept, for each row. quantile: of chi-squared, the limit."""
    name = lambda c: F.translate(F.coalesce(F.col(c), F.lit("\0")), "\1\2", "")
    stats = statistics(docs).withColumn("g", F.concat(name("lang"), F.lit("\1"), name("source"))).drop("lang", "source")
    rows = common.staged(stats, "statistics")
    vectors = common.staged(levels(rows), "vectors")
    found = estimates(vectors, most_broadcast=most_broadcast, **limits).where(F.col("g").contains("\1")).select("g", "center", "precision")
    common.dropped(vectors)
    out = matched(rows, found, found.count(), most_broadcast).withColumn("distance", _distance())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "distance", (~failed & (F.col("distance") <= chi2_quantile(quantile, P))).alias("kept"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"))
