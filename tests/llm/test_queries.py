"""Every query of the subpackage and the pipeline: whole results against brute force, and odd and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import components, fingerprint, langid, neardup, packing, pii, registry, tokencount, urlfilter
from cairn.llm.common import vocabulary_bytes, vocabulary_path

from .test_advice_r01 import kept_at
from .test_corpus_operators import SF, WORD, base_counts, base_spans, groups

QUERIES = registry.queries()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, sf=SF):
    return QUERIES[name](spark, sf).collect()


def test_op1(spark, texts):
    split = {i: [*WORD.findall(x.translate(LOWER)), None] for i, x in texts.items()}
    out_of = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in split.items() if not out_of[i] for w in t)
    n, v = sum(c.values()), len(c)
    out = rows(spark, "op1_lm_score")
    assert len(out) == len(texts)
    for r in out:
        t = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out_of[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r["score"] < 0


def test_op2_and_op3(spark, texts):
    lengths = {r["doc_id"]: r["n_tokens"] + 1 for r in rows(spark, "op2_token_counts")}
    assert lengths.keys() == texts.keys()
    bins, made = {}, Counter()
    for r in rows(spark, "op3_packing"):
        made[r["doc_id"]] += r["length"]
        bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["length"]))
    assert made == lengths and len({b for b, _ in bins}) == len(bins)
    for (_, capacity), parts in bins.items():
        ends = np.cumsum([0, *[x for _, x in sorted(parts)]])
        assert [at for at, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= capacity
        assert capacity == min((x for x in packing.CAPACITIES if x >= ends[-1]), key=packing.attention_cost)


def test_op4(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(spark, "op4_near_duplicates")}
    assert got == groups(list(texts.items()))


def test_op5(spark, texts):
    out = rows(spark, "op5_quality")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out}
    assert got == {i: base_counts(x) for i, x in texts.items()} and not any(r["kept"] and r["base_failed"] for r in out)


def test_op6(spark, texts):
    show = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
    out = rows(spark, "op6_pii")
    assert len(out) == len(texts)
    for r in out:
        want = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[3] == k for s in want) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(show(want).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("id:")] == [x for x in show(want).split(",") if x]


def test_op7(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = sorted(map(repr, (tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "listed")) for r in rows(spark, "op7_url_filter"))))
    assert got == sorted(map(repr, duck.sql(urlfilter.ORACLE_SQL["op7_url_filter"]).fetchall()))


def test_op8(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows(spark, "op8_sentencepiece"):
        ids = sp.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
        assert r["library_agrees"]


def test_op9(spark, texts):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = rows(spark, "op9_language_id")
    assert len(out) == len(texts)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[r["doc_id"]]))
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean(held) >= 0.95


def test_op10(spark, texts):
    order = sorted(texts)
    f = fingerprint.Fingerprints()
    tree = {i: f.tree(x.encode()) for i, x in texts.items()}
    got = {r["doc_id"]: r for r in rows(spark, "op10_fingerprints")}
    assert got.keys() == texts.keys()
    for k, i in enumerate(order):
        x, then = texts[i], order[(k + 1) % len(order)]
        cut = len(x) // 4
        edited = x[: len(x) - cut] + texts[then][:cut]
        t, r = f.tree(edited.encode()), got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(x), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.written(tree[i]), fingerprint.written(t))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(fingerprint.likeness(tree[i], t)), pytest.approx(fingerprint.likeness(tree[i], tree[then])))
        if edited != x:
            a, b = x.split("\n"), edited.split("\n")
            assert a[: r["edit_from_line"]] == b[: r["edit_from_line"]]
            tail = len(a) - r["edit_to_line"]
            assert not tail or a[-tail:] == b[-tail:]


def test_pipeline_stage_by_stage(spark):
    """Each stage against brute force over what the one before left, and run() against the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, p = langid.learned(docs)
    judge = langid.predictor(langid.piece_names(vocabulary_bytes()), langs, p)
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, (lang, score) in zip(now, judge([None if x is None else x.encode() for x in now.values()])) if lang != "und" and score >= 0.5}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            break
        out = spark.createDataFrame(out.collect(), docs.schema)
        then = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert then.keys() == want
        elif name == "quality_rules":
            assert all(not base_counts(x)[5] for x in then.values()) and len(then) > 0.8 * sum(not base_counts(x)[5] for x in now.values())
        elif name == "near_duplicates":
            assert then.keys() == kept_at(list(now.items()), 80)
        else:
            assert then.keys() == now.keys() and not any(base_spans(x) for x in then.values())
            assert all(then[i] == x for i, x in now.items() if not base_spans(x) and not re.search("<(ID|EMAIL)>", then[i]))
        docs, now = out, then
    lengths = {r["doc_id"]: r["n_tokens"] + 1 for r in tokencount.token_counts(docs).collect()}
    made, rooms = Counter(), Counter()
    for r in out.collect():
        made[r["doc_id"]] += r["length"]
        rooms[r["bin_id"], r["capacity"]] += r["length"]
    assert made == lengths and all(n <= c for (_, c), n in rooms.items())
    whole = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        whole[r["doc_id"]] += r["length"]
    assert whole == made


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_odd_and_empty_tables(spark, tmp_path, edge, empty, name):
    """Null ids, languages and texts, repeated rows, one id with two texts, clashing columns; and nothing at all."""
    run = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    urls = spark.createDataFrame([(1, None), (1, None), (None, "http://a.net/es/"), (2, ""), (3, "x" * 3000)], "page_id long, url string").withColumn("listed", F.lit("clash")).withColumn("block", F.lit("clash"))
    for docs, pages, folder in ((edge, urls, "odd"), (empty, urls.limit(0), "empty")):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        pages.write.parquet(f"{tmp_path}/{folder}/pages.parquet")
        n = run(spark, f"{tmp_path}/{folder}").count()
        if folder == "empty":
            assert n == 0
        elif name == "op7_url_filter":
            assert n == urls.count()
        elif name in ("op3_packing", "pipeline"):
            assert n >= (0 if name == "pipeline" else edge.count())
        else:
            assert n == edge.count()


def test_long_chains_are_one_component(spark):
    """A chain far longer than any fixed number of rounds would reach from its ends."""
    links = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k")).select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))
    out = components.components(links)
    assert out.count() == 20_001 and out.where("component <> 0").count() == 0


def test_words_of_any_length_are_learned_from():
    """Long words add the expected counts that the plain sums give, and a text without spaces is learned from."""
    names = langid.piece_names(vocabulary_bytes())
    rnd = np.random.default_rng(3)
    p = rnd.random((len(names) + 1, 2)) * 1e-3
    p[-1] = langid.UNKNOWN
    lattice = langid.Lattice(names)
    words, counts, of = ["thing", "internationalisation", "中文字", "a"], np.array([2.0, 1.0, 3.0, 1.0]), np.array([0, 1, 0, 1])
    short = lattice.expected(words, counts, of, p)
    widths, langid.WIDTHS = langid.WIDTHS, (1,)
    try:
        assert np.allclose(lattice.expected(words, counts, of, p), short) and np.allclose(lattice.log_likelihoods(words, p), [lattice.log_likelihoods([w], p)[0] for w in words])
    finally:
        langid.WIDTHS = widths
    long = ["thing" * 60, "x" * 45, "天地玄黄宇宙洪荒" * 30]
    lengths = np.array([*map(len, names), 1])
    assert np.allclose(lengths @ lattice.expected(long, np.ones(3), np.array([0, 1, 0]), p), [1 + 300 + 1 + 240, 46])


def test_context_of_any_length_and_short_identifiers(spark):
    """A context word of 100 letters far from the end of the gap, identifiers of three characters, and emails without a digit."""
    far = "w" * 100
    rows = [(k, f"text {far} mark{' ' * 80}u{k}@mail.org and") for k in range(8)] + [(10 + k, f"here {far} mark{' ' * 80}a{k} and") for k in range(3)]
    rows += [(20 + k, f"write to person{chr(97 + k)}@mail.org now") for k in range(8)] + [(40, "write to zz#b77 now")]
    out = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("id:" in out[10 + k] for k in range(3)) and out[40] == "id:12:15"
    assert all("email:" in out[k] for k in [*range(8), *range(20, 28)])


def test_few_pairs_over_the_threshold_agree_too_little():
    """Pairs of sets just over 0.85: their 128 values agree in far more than the share at which full sets are not looked at."""
    rnd = np.random.default_rng(6)
    least = 1.0
    for _ in range(400):
        n = int(rnd.integers(60, 400))
        both = rnd.integers(0, 2**63, n, np.uint64)
        own = [rnd.integers(0, 2**63, int(n * 0.085), np.uint64) for _ in range(2)]
        x, y = (np.frombuffer(neardup.signature(np.unique(np.concatenate([both, o])), 85)[1], "<u2") for o in own)
        least = min(least, float((x == y).mean()))
    assert least > 0.85 - neardup.banded(85)[2] + 0.02
