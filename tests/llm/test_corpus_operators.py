"""Near-duplicates, quality, personal data, URL filters and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import components, neardup, pii, quality, stages, urlfilter
from cairn.llm.lookup import Lookup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(urlfilter.UPPER, urlfilter.UPPER.lower())


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(rows):
    """doc_id -> component by comparing every pair; rows: (doc_id, text)."""
    sets = [(i, shingles(x)) for i, x in rows]
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def near_copies(n=60, seed=1):
    """A family in which many pairs are just below the threshold, others just above, chains among them."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        out.append((1000 + k, " ".join(words)))
    for k in range(20):
        out.append((2000 + k, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(40)) + " " + " ".join(base[:60])))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.deduplicated(df).collect()}
    assert got == groups(rows)


def test_near_duplicates_of_the_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.deduplicated(documents).collect()}
    assert got == groups(rows)


def test_near_duplicates_of_odd_rows(spark, edge, empty):
    out = neardup.deduplicated(edge).collect()
    assert len(out) == edge.count() and neardup.deduplicated(empty).count() == 0
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert (by[0], by[1], by[2]) == ([(0, 0, True)], [(0, 1, True)], [(0, 2, True)])
    assert by[3] == [(1, 3, True)] and by[6] == [(2, 5, False)] and sorted(by[5]) == [(1, 5, True), (2, 5, True), (2, 5, True)]
    assert by[None] == [(1, None, True)]


def test_components_of_links(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    top = {}
    for a, b in links:
        top.setdefault(a, a), top.setdefault(b, b)

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        p, q = root(a), root(b)
        top[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in top if any(i in x and x[0] != x[1] for x in links)}


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_base_and_verdicts(spark, documents, edge, empty):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (documents, edge.where("doc_id is not null and doc_id <> 5")):
        out = quality.judged(df).collect()
        assert {r["doc_id"]: tuple(r[c] for c in columns) for r in out} == {r["doc_id"]: base_counts(r["text"]) for r in df.collect()}
        assert not any(r["kept"] and r["base_failed"] for r in out)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [r["kept"] for r in out if labels[r["doc_id"]]], [r["kept"] for r in out if not labels[r["doc_id"]]]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    assert quality.judged(edge).count() == edge.count() and quality.judged(empty).count() == 0


def plain_mcd(x, share=0.75):
    """The least determinant over three starts, steps to convergence, all rows sorted by distance."""
    least = np.array(list(quality.STATISTICS.values()))
    factor = share / quality.chi2_cdf(quality.chi2_quantile(share, quality.P), quality.P + 2)
    c = np.median(x, 0)
    s = np.maximum(np.median(np.abs(x - c), 0) * 1.4826, least)
    z = (x - c) / s
    u = z / np.sqrt((z**2).sum(1, keepdims=True) + 1e-12)
    best = None
    for corr in (np.eye(quality.P), np.corrcoef(np.tanh(z).T), quality.P * u.T @ u / len(u)):
        center, spread, was = c, corr * np.outer(s, s) + np.diag(least**2), np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(spread), x - center)
            near = x[np.argsort(d, kind="stable")[: int(share * len(x))]]
            center, spread = near.mean(0), np.cov(near.T, bias=True) * factor + np.diag(least**2)
            now = np.linalg.slogdet(spread)[1]
            if was - now < 1e-9:
                break
            was = now
        if best is None or now < best[0]:
            best = now, center, spread
    return best


def test_estimates_are_the_least_determinant(spark):
    """Against FastMCD on two groups, one with a fifth of far rows in one place, correlated statistics in the other."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(4000, quality.P)) @ np.diag(np.arange(1, quality.P + 1)) + 3
    x[:800] += 60
    mix = rnd.normal(size=(quality.P, quality.P)) + 2 * np.eye(quality.P)
    y = rnd.normal(size=(1500, quality.P)) @ mix
    y[:300] = rnd.normal(size=(300, quality.P)) * 0.1 + 12
    both = {"a": x, "b": y}
    df = spark.createDataFrame([(g, *map(float, r)) for g, v in both.items() for r in v], ["g", *quality.X])
    for broadcast in (100, 0):
        got = {r["g"]: r for r in quality.concentrated(df, 2, 0.75, 1e-3, broadcast).collect()}
        for g, v in both.items():
            det, center, spread = plain_mcd(v)
            mine = np.array(got[g]["spread"]).reshape(quality.P, quality.P)
            assert got[g]["n"] == len(v) and abs(np.linalg.slogdet(mine)[1] - det) < 0.05
            assert np.allclose(got[g]["center"], center, atol=0.1 * np.sqrt(np.diag(spread)).max()) and np.allclose(mine, spread, atol=0.08 * np.abs(spread).max())
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_few_rows_lean_on_their_language(spark):
    """One, two or three documents of a source are judged too: by their language's estimate in the main."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    few = docs.where("lang = 'en'").withColumn("source", F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("few"), (F.col("doc_id") % 7).cast("string"))).otherwise("big"))
    odd = spark.createDataFrame([(-1, "#$% " * 40 + "&&& " * 60, "en", "lone"), (-2, "$$$ ### " * 50, "xx", "yy")], few.schema)
    out = {r["doc_id"]: r for r in quality.judged(few.unionByName(odd)).collect()}
    assert all(r["distance"] is not None for r in out.values()) and out[-1]["distance"] > quality.chi2_quantile(0.9999, quality.P)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [r["kept"] for i, r in out.items() if labels.get(i) == 1 and not r["base_failed"]]
    assert np.mean(good) > 0.99
    for n in (1, 2, 3):
        assert quality.judged(docs.limit(n)).where("distance is not null").count() == n


#: The contract's patterns, as given.
GIVEN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(GIVEN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(p) < 256 for p in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}
            if good[kind]():
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def pii_rows(df):
    return sorted([(r["doc_id"] is None, r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digests(df).collect()])


def pii_wanted(rows):
    out = []
    for i, x in rows:
        s = base_spans(x)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        out.append((i is None, i or 0, *(sum(y[3] == k for y in s) for k in GIVEN), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_base_spans(spark, documents, edge, empty):
    rnd = random.Random(7)
    parts = ["1", "2", "4111 1111 1111 1111", "-", " ", ".", "@", "a@b.c", "%", "+1", "(0)", "9", "é", "😀", "x", "\n", "255", "256", "1.2.3.4", "00000000000000255", "+", "555-1234"]
    odd = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))) for k in range(1500)] + [(7, "1" * 30000 + " " + "a" * 60000 + "@"), (None, "a@b.co"), (5, "a@b.co"), (5, "a@b.co")]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert pii_rows(df) == pii_wanted(odd)
    for df in (documents, edge):
        assert pii_rows(df) == pii_wanted([(r["doc_id"], r["text"]) for r in df.collect()])
    assert pii.digests(empty).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"some words here secret code {hashlib.md5(bytes([k])).hexdigest()} and more") for k in range(12)]
    rows += [(100 + k, f"and again the secret code qx{k}77-ab{k} is here") for k in range(3)] + [(200 + k, f"published in version {k}1.0.{k} of it") for k in range(9)]
    got = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for k in (100, 101, 102):
        kind, start, end = got[k].split(":")
        assert kind == "id" and text[k][int(start) : int(end)].startswith("qx")
    assert all(got[k] == "" for k in range(200, 209))


def test_redaction_replaces_the_spans(spark, documents, edge):
    for df in (documents, edge):
        before = sorted(tuple(map(str, r)) for r in df.drop("text", "n_chars").collect())
        out = pii.redacted(df)
        assert out.columns == df.columns and sorted(tuple(map(str, r)) for r in out.drop("text", "n_chars").collect()) == before
        assert not [r for r in out.collect() if base_spans(r["text"])]
    one = spark.createDataFrame([(1, "é mail a@b.co, call +1 (279) 555-0216 ok", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = pii.redacted(one).first()
    assert r["text"] == "é mail <EMAIL>, call <PHONE> ok" and r["n_chars"] == len(r["text"])


def test_url_filter_is_its_sql(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://com/"), (4, "http://COM"), (5, "https://x.example.com/en/a"), (6, "https://a.www.example.com/en/"), (7, "ftp://net/es/?q"), (8, "http://xnet/es/"), (9, "http://m.casino-win.org/a/?utm_source=x&b=1#f"), (10, "http://m.casino-win.org/a?b=1"), (11, "http://u@www.free-bets.org:80//"), (11, "http://u@www.free-bets.org:80//"), (None, "http://é.net/fr/é"), (12, "://h/p?x"), (13, "http://Free-bets.org"), (14, "http://a@b@c.org/x"), (15, "http://www.www.w.org:80/"), (16, "")] + [(20 + k, f"http://h{k}.net/{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("listed", F.lit("clash"))
    got = urlfilter.judged(df, urlfilter.listed_urls(df))
    duck = duckdb.connect()
    duck.register("pages", df.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    want = duck.sql(urlfilter.ORACLE_SQL["op7_url_filter"]).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    for limits in ({"most_bytes": 0}, {"most_rows": 0}):
        assert sorted(map(key, urlfilter.judged(df, urlfilter.listed_urls(df), **limits).collect())) == sorted(map(key, want))
    assert any(r["listed"] for r in got.collect()) and not all(r["listed"] for r in got.collect())
    assert urlfilter.judged(df.limit(0), urlfilter.listed_urls(df)).count() == 0 and urlfilter.judged(df, urlfilter.listed_urls(df.limit(0))).where("listed").count() == 0


def test_bloom_passes_all_that_is_listed_and_little_else(spark):
    listed = spark.range(3000).select(F.concat(F.lit("in"), "id").alias("k"))
    others = spark.range(3000).select(F.concat(F.lit("out"), "id").alias("k"))
    for rows in (10**6, 0):
        out = urlfilter.on_list(listed.unionByName(others), listed, "k", bits_per_entry=16, most_rows=rows)
        found = {(r["listed"], r["possible"]): r["n"] for r in out.groupBy("listed", "possible").agg(F.count("*").alias("n")).collect()}
        # false positives of the filter: 2 % at most at 16 bits an entry in blocks of 512, and the join takes them out
        assert found[True, True] == 3000 and (True, False) not in found and sum(found.values()) == 6000 and found.get((False, True), 0) < 60


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, np.uint64))
    find = Lookup(keys)
    assert (find(keys) == np.arange(len(keys))).all() and (find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Lookup(keys[:0])(keys) == -1).all()


def test_stages_keep_columns_and_do_their_work(spark, documents, edge):
    for df in (documents, edge):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == df.columns, name
            docs = spark.createDataFrame(out.collect(), df.schema)
    labelled = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages.near_duplicates(spark, labelled, SF)
    want = {i for i, g in groups([(r["doc_id"], r["text"]) for r in labelled.collect()]).items() if g[2]}
    assert {r["doc_id"] for r in kept.collect()} == want
    twice = labelled.limit(30).unionByName(labelled.limit(30))
    assert stages.near_duplicates(spark, twice, SF).count() == stages.near_duplicates(spark, labelled.limit(30), SF).count()
    assert stages.language(spark, labelled, SF).count() == labelled.count()
    assert {r["doc_id"] for r in stages.language(spark, edge.where("doc_id in (0, 1, 2, 11)"), SF).collect()} == set()
