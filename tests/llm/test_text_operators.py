"""Token counts, sentencepiece, language identification, packing, fingerprints and scoring against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import fingerprint, langid, lmscore, packing, pieces, tokencount
from cairn.llm.common import remainder, vocabulary_bytes, vocabulary_path

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_token_counts_are_those_of_greedy_word_pieces(spark, documents, edge, empty):
    from tokenizers.models import WordPiece

    begin, inner = tokencount.vocabulary(vocabulary_bytes())
    names = {"[UNK]": 0}
    for x in [*sorted(begin), *("##" + x for x in sorted(inner))]:
        names[x] = len(names)
    wp = WordPiece(names, unk_token="[UNK]", max_input_chars_per_word=10**6)

    def count(text):
        made = [wp.tokenize(w.decode()) for w in (text or "").encode().split()]
        return len(made), sum(map(len, made)), sum(m[0].value == "[UNK]" for m in made)

    for df in (documents.limit(60), edge.where("doc_id is not null and text not like 'other%'")):
        want = {r["doc_id"]: count(r["text"]) for r in df.collect()}
        assert by_id(tokencount.token_counts(df), "n_words", "n_tokens", "n_unknown") == want
    assert tokencount.token_counts(edge).count() == edge.count() and tokencount.token_counts(empty).count() == 0


def test_sentencepiece_is_the_library(spark, documents, edge, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())

    def digest(text):
        ids = sp.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), True

    for df in (documents, edge.where("doc_id is not null and text not like 'other%'")):
        want = {r["doc_id"]: digest(r["text"]) for r in df.collect()}
        assert by_id(pieces.digests(df), "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees") == want
    rnd = random.Random(5)
    codec = pieces.Codec(vocabulary_bytes())
    for _ in range(2000):
        text = "".join(rnd.choice("ab \n▁éth😀\x00") for _ in range(rnd.randrange(40)))
        ids = codec.encode(text)
        assert ids == sp.encode(text, add_eos=True) and codec.decode(ids) == sp.decode(ids)
    segments = [s for x in TEXTS for s in codec.segments(x or "")]
    assert codec.encode_segments(segments) == [codec.encode_segment(s) for s in segments]
    bounded = pieces.Remembered(vocabulary_bytes(), 3)  # a memory that is emptied all the time changes nothing
    texts = [x.encode() if x is not None else None for x in TEXTS]
    assert bounded.digests(texts) == [digest(x) for x in TEXTS]
    assert pieces.digests(empty).count() == 0 and pieces.encoded(edge).count() == edge.count()


def forward(lattice_names, p, word):
    names = {n: k for k, n in enumerate(lattice_names)}
    text = "▁" + word
    alpha = [np.ones(p.shape[1])]
    for end in range(1, len(text) + 1):
        a = np.zeros(p.shape[1])
        for start in range(end):
            part = text[start:end]
            row = names.get(part, len(lattice_names) if len(part) == 1 else None)
            if row is not None:
                a += alpha[start] * p[row]
        alpha.append(a)
    return np.log(alpha[-1])


def test_forward_sums_all_segmentations():
    names = langid.piece_names(vocabulary_bytes())
    rnd = np.random.default_rng(1)
    p = rnd.random((len(names) + 1, 3)) * 1e-4
    p[-1] = langid.UNKNOWN
    lattice = langid.Lattice(names)
    words = ["a", "the", "thing", "éclair", "中文字", "internationalisation", "x", "q" * 45, "thing" * 12, "über" * 3]
    got = lattice.log_likelihoods(words, p)
    assert np.allclose(got, [forward(names, p, w) for w in words])
    # expected counts of one word add up to the pieces of its segmentations, and their lengths to the word
    counts = lattice.expected(["thing", "the"], np.array([2.0, 1.0]), np.array([0, 1]), p)
    lengths = np.array([*map(len, names), 1])
    assert np.allclose(lengths @ counts, [12, 4, 0])


def test_language_is_found_on_held_out_rows(spark, documents, edge, empty):
    langs, p = langid.learned(documents.where(remainder("doc_id", 5) != 0))
    assert langs == ["de", "en", "es", "fr"] and np.allclose(p[:-1].sum(0), 1 - langid.UNKNOWN)
    held = documents.where(remainder("doc_id", 5) == 0)
    out = langid.identified(held, langs, p).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    odd = langid.identified(edge, langs, p)
    assert odd.count() == edge.count()
    got = by_id(odd.where("doc_id in (0, 1, 2, 11)"), "lang_pred", "score")
    assert set(got.values()) == {("und", 0.0)}
    none, q = langid.learned(empty)
    assert none == [] and {r["lang_pred"] for r in langid.identified(edge, none, q).collect()} == {"und"} and langid.identified(empty, langs, p).count() == 0


def one_by_one(lengths, capacities, cost):
    """Best fit, one document at a time, under the plan's rules: the contents and size of each bin."""
    bins = []  # [room, contents]
    left = Counter(lengths)
    for length in sorted(left, reverse=True):
        n, size = left.pop(length), None
        for k in range(n):
            fits = [b for b in bins if b[0] >= length]
            if not fits:
                if size is None:
                    size = cheapest(length, n - k, left, capacities, cost)
                bins.append([size, []])
                fits = [bins[-1]]
            best = min(fits, key=lambda b: b[0])
            best[0] -= length
            best[1].append(length)
    return Counter((tuple(sorted(c)), min((x for x in capacities if x >= sum(c)), key=lambda x: (cost(x), x))) for _, c in bins)


def cheapest(length, n, left, capacities, cost):
    rated = []
    for c in sorted(capacities):
        if c >= length:
            filled = length * min(n, c // length)
            for x in sorted(left, reverse=True):
                filled += x * min(left[x], (c - filled) // x)
            rated.append((cost(min((y for y in capacities if y >= filled), key=lambda y: (cost(y), y))) / filled, c))
    return min(rated)[1]


@pytest.mark.parametrize("seed", range(8))
def test_bins_are_those_of_best_fit(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 2, 3, 7, 7, 7, 12, 20, 31, 32]) for _ in range(rnd.choice([0, 1, 5, 60, 300]))]
    plan = packing.Plan(Counter(lengths), (8, 16, 32), lambda c: c + 2)
    got: dict = {}
    for length, _, n, first, offset in plan.placements:
        for b in range(first, first + n):
            got.setdefault(b, []).append((offset, length))
    starts = [b for b, _ in plan.bins]
    made = Counter()
    for b, parts in got.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        capacity = plan.bins[np.searchsorted(starts, b, "right") - 1][1]
        assert at <= capacity
        made[tuple(sorted(x for _, x in parts)), capacity] += 1
    assert made == one_by_one(lengths, (8, 16, 32), lambda c: c + 2)


def test_every_token_is_packed_once(spark, documents, edge, empty):
    for df in (documents, edge):
        out = packing.packed_documents(df, capacities=(64, 128, 256)).collect()
        n = sum(r["n_tokens"] + 1 for r in tokencount.token_counts(df).collect())
        assert sum(r["length"] for r in out) == n
        bins: dict = {}
        for r in out:
            bins.setdefault(r["bin_id"], []).append(r)
        for rows in bins.values():
            ends = 0
            for r in sorted(rows, key=lambda r: r["bin_offset"]):
                assert r["bin_offset"] == ends
                ends += r["length"]
            assert len({r["capacity"] for r in rows}) == 1 and ends <= rows[0]["capacity"]
    assert packing.packed_documents(empty).count() == 0


def test_fingerprints(spark, documents, edge, empty):
    rows = sorted(documents.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.against_next(documents, rows_per_range=30).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        following = rows[(k + 1) % len(rows)]["text"]
        cut = len(r["text"]) // 4
        edited = r["text"][: len(r["text"]) - cut] + following[:cut]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(r["text"]), hashlib.sha256(edited.encode()).hexdigest())
        assert g["near_edited"] == pytest.approx(fingerprint.compare(g["fingerprint"], g["edited_fingerprint"]))
        assert g["near_next"] == pytest.approx(fingerprint.compare(g["fingerprint"], got[rows[(k + 1) % len(rows)]["doc_id"]]["fingerprint"]))
    long = [g for g in got.values() if g["n_chars"] > 400]
    assert np.mean([g["near_edited"] for g in long]) > 0.65 and np.mean([g["near_next"] for g in long]) < 0.1
    assert len({g["fingerprint"] for g in got.values()}) == len({r["text"] for r in rows})
    assert fingerprint.against_next(edge).count() == edge.count() and fingerprint.against_next(empty).count() == 0
    assert fingerprint.against_next(edge.where("doc_id is null")).count() == 1
    one = fingerprint.fingerprints(edge.where("doc_id in (0, 1)")).select("fingerprint").distinct().count()
    assert one == 1
    with pytest.raises(ValueError):
        fingerprint.against_next(documents.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_hot_and_null_ids_are_walked_in_order(spark):
    """Half of the rows have one id, some none: every row is followed by the next in order, whatever the ranges."""
    rows = [(k, f"text {k}") for k in range(200)] + [(77, f"hot {k}") for k in range(300)] + [(None, f"none {k}") for k in range(100)] + [(77, "same"), (77, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["fingerprint"], r["edited_sha256"]) for r in fingerprint.against_next(df, rows_per_range=7).collect())
    hashed = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    ordered = sorted(hashed, key=lambda r: (fingerprint.LEAST if r[0] is None else r[0], r[2], r[1]))
    f, want = fingerprint.Fingerprints(), Counter()
    for k, (i, x, _) in enumerate(ordered):
        cut = len(x) // 4
        edited = x[: len(x) - cut] + ordered[(k + 1) % len(ordered)][1][:cut]
        want[i, fingerprint.written(f.tree(x.encode())), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert got == want


def plain_tree(text, most=32):
    """root, level, sections as lists of (paragraph node, leaves), by plain Python."""
    import xxhash

    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    def sha(x):
        return hashlib.sha256(x).digest()

    lines = text.split(b"\n")
    leaves = []
    for line in lines:
        hs = [mix(xxhash.xxh3_64_intdigest(w)) for w in line.split()]
        leaves.append([(h >> 38, min(20, (h & -h).bit_length() - 1)) for h in hs])
    bound, level = most + sum(map(bool, leaves)), 0
    up = lambda now, level: [merge(x, level) for x in now]

    def merge(x, level):
        out, run = [], []
        for d, r in x:
            run.append(mix(d + len(run) * 0x9E3779B97F4A7C15 + level & mask))
            last = r
            if r >= level:
                out.append((mix(sum(run) & mask) >> 38, r))
                run = []
        if run:
            out.append((mix(sum(run) & mask) >> 38, last))
        return out

    while sum(map(len, leaves)) > bound and level < 20:
        level += 1
        leaves = up(leaves, level)
    sections = []
    for k, line in enumerate(lines):
        if not k or bool(line.split()) != bool(lines[k - 1].split()):
            sections.append([])
        sections[-1].append(k)
    root = sha(b"".join(sha(b"".join(sha(lines[k]) for k in s)) for s in sections)).hex()
    nodes = [int.from_bytes(sha(line)[:4], "little") & 0x3FFFFFFF for line in lines]
    return {"root": root, "level": level, "nodes": nodes, "sections": sections, "leaves": leaves, "raise": up}


def plain_likeness(a, b):
    if a["root"] == b["root"]:
        return 1.0
    level = max(a["level"], b["level"])
    trees = []
    for t in (a, b):
        leaves = t["leaves"]
        for k in range(t["level"] + 1, level + 1):
            leaves = t["raise"](leaves, k)
        trees.append((t["nodes"], t["sections"], leaves))
    size = sum(len(n) + sum(map(len, x)) for n, _, x in trees)
    named = lambda n, s: tuple(n[k] for k in s)
    common = Counter(named(trees[0][0], s) for s in trees[0][1]) & Counter(named(trees[1][0], s) for s in trees[1][1])
    whole, rest = 0, []
    for n, sections, x in trees:
        left, mine = Counter(common), []
        for s in sections:
            if left[named(n, s)]:
                left[named(n, s)] -= 1
                whole += sum(1 + len(x[k]) for k in s)
            else:
                mine += s
        rest.append(mine)
    common = Counter(trees[0][0][k] for k in rest[0]) & Counter(trees[1][0][k] for k in rest[1])
    parts = []
    for (n, _, x), mine in zip(trees, rest):
        left, bag = Counter(common), Counter()
        for k in mine:
            if left[n[k]]:
                left[n[k]] -= 1
                whole += 1 + len(x[k])
            else:
                bag.update(d for d, _ in x[k])
        parts.append(bag)
    return (whole + 2 * sum((parts[0] & parts[1]).values())) / size


def test_trees_and_likeness_are_those_of_plain_python(documents):
    texts = [x.encode() for x in TEXTS if x is not None] + [r["text"].encode() for r in documents.limit(40).collect()]
    f = fingerprint.Fingerprints()
    made, plain = [f.tree(x) for x in texts], [plain_tree(x) for x in texts]
    for t, p in zip(made, plain):
        back = fingerprint.parsed(fingerprint.written(t))
        for x in (t, back):
            assert (x.root, x.level, x.nodes.tolist(), np.flatnonzero(x.first).tolist()) == (p["root"], p["level"], p["nodes"], [s[0] for s in p["sections"]])
            assert list(zip(x.digest.tolist(), x.rank.tolist(), x.of.tolist())) == [(d, r, k) for k, leaves in enumerate(p["leaves"]) for d, r in leaves]
    rnd = random.Random(4)
    for _ in range(400):
        i, j = rnd.randrange(len(texts)), rnd.randrange(len(texts))
        assert fingerprint.likeness(made[i], made[j]) == pytest.approx(plain_likeness(plain[i], plain[j]))
    for _ in range(60):  # edited copies
        x = rnd.choice(texts[-40:])
        lines = x.split(b"\n")
        lines[rnd.randrange(len(lines))] += b" more"
        a, b = f.tree(x), f.tree(b"\n".join(lines))
        assert fingerprint.likeness(a, b) == pytest.approx(plain_likeness(plain_tree(x), plain_tree(b"\n".join(lines))))


def test_differing_branches_locate_edits():
    a = [f"line {k}" if k % 5 else "" for k in range(40)]
    b = [*a[:17], "changed", "and new", *a[18:]]
    f = fingerprint.Fingerprints()
    text = lambda x: fingerprint.written(f.tree("\n".join(x).encode()))
    assert fingerprint.locate(text(a), text(a)) is None and fingerprint.locate(text(a), text(b)) == (17, 18, 17, 19)
    assert fingerprint.locate(text([""]), text(["x"])) == (0, 1, 0, 1)
    rnd = random.Random(8)
    for _ in range(200):
        x = [rnd.choice(["", "a b", "c", "d e f"]) for _ in range(rnd.randrange(1, 12))]
        i, j = sorted(rnd.randrange(len(x) + 1) for _ in range(2))
        y = [*x[:i], *[rnd.choice(["", "new", "d e f"]) for _ in range(rnd.randrange(3))], *x[j:]] or [""]
        found = fingerprint.locate(text(x), text(y))
        if x == y:
            assert found is None
        else:
            p, q, r, s = found
            assert p == r and x[:p] == y[:r] and x[q:] == y[s:] and 0 <= p <= q <= len(x) and r <= s <= len(y)


def test_scores(spark, documents, edge, empty):
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b" end"] for r in documents.collect()}
    c = Counter(t for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in w)
    n, v = sum(c.values()), len(c)
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    model, totals = lmscore.trained(documents.where(~held).select("text"), tokens_per_shard=4000)
    assert (totals["tokens"], totals["types"]) == (n, v) and totals["bits"] > 1
    out = lmscore.scored(documents, model, totals).collect()
    for r in out:
        w = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(c[t] > 0 for t in w))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w))
    routed = {r["doc_id"]: r["score"] for r in lmscore.scored(documents, model, totals, most_bytes=0, batch_rows=40).collect()}
    assert all(routed[r["doc_id"]] == pytest.approx(r["score"]) for r in out)
    h = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in h) > sum(r["base_score"] for r in h)
    odd = lmscore.trained(edge.select("text"))
    assert lmscore.scored(edge, *odd).count() == edge.count() and lmscore.scored(empty, *odd).count() == 0
    stepped, its = lmscore.trained(documents.where(~held).select("text"), tokens_per_shard=1000, most_tasks=4, step=2)
    assert its["bits"] > 4 and {k: v for k, v in its.items() if k in ("tokens", "types", "pairs", "once")} == {k: totals[k] for k in ("tokens", "types", "pairs", "once")}
    again = {r["doc_id"]: r["score"] for r in lmscore.scored(documents, stepped, its).collect()}
    other = {r["doc_id"]: r["score"] for r in lmscore.scored(documents, stepped, its, most_bytes=0, batch_rows=25).collect()}
    assert all(other[i] == pytest.approx(x) for i, x in again.items())
    nothing = lmscore.trained(empty.select("text"))
    assert {r["score"] for r in lmscore.scored(edge, *nothing).collect()} == {0.0}


class ExactCounts:
    """What a filter without a false positive would give."""

    def __init__(self, counts):
        self.counts = counts

    def levels(self, keys):
        return np.searchsorted(lmscore.LEAST, [self.counts[k] for k in keys.tolist()], "right")

    def exact(self, h):
        return np.array([self.counts[k] for k in lmscore.single_keys(h).tolist()])


def test_scores_are_the_interpolation(documents):
    """score against the formula in plain Python, over counts of words themselves."""
    texts = [r["text"] or "" for r in documents.limit(60).collect()] + TEXTS
    split = [(x or "").encode().lower().split() + ["end"] for x in texts]
    train = split[:40]
    one, two = Counter(w for t in train for w in t), Counter((a, b) for t in train for a, b in zip(["start", *t], t))
    mean = lambda c: next(((math.ceil(1.5**j) + max(math.ceil(1.5 ** (j + 1)) - 1, math.ceil(1.5**j))) / 2 for j in reversed(range(64)) if c >= 1.5**j), 0.0)
    n, v, once, pairs = sum(one.values()), len(one), sum(c == 1 for c in two.values()), sum(two.values())

    def score(t):
        total = 0.0
        for a, b in zip(["start", *t], t):
            p = (mean(one[b]) + 1) / (n + v + 1)
            history = len(train) if a == "start" else mean(one[a])
            share = (1 - once / pairs) * history / (history + 5.0)
            total += math.log10((share * min(mean(two[a, b]), history) / history if history else 0.0) + (1 - share) * p)
        return total

    words = lmscore.WordHashes()
    counts = Counter()
    for x in texts[:40]:
        h = lmscore.tokens((x or "").encode(), words)
        counts.update(lmscore.single_keys(h).tolist())
        counts.update(lmscore.pair_keys(np.append([lmscore.START], h[:-1]), h).tolist())
    totals = {"tokens": n, "types": v, "pairs": pairs, "once": once, "texts": len(train)}
    got = lmscore.scores([None if x is None else x.encode() for x in texts], words, ExactCounts(counts), totals, 5.0)
    for t, r in zip(split, got):
        assert r[0] == len(t) and r[3] == pytest.approx(score(t))


def test_counts_come_back_from_the_filter():
    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 2**63, 20000, np.uint64) * np.uint64(2))
    counts = rnd.geometric(0.3, len(keys))
    bits = lmscore.filter_of(keys, counts)
    model = lmscore.Counts(bits, np.zeros(1, np.int64), np.array([len(bits)], np.uint64), 64, keys[:0], counts[:0])
    levels = np.searchsorted(lmscore.LEAST, counts, "right")
    got = model.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.9
    assert (model.levels(keys + np.uint64(1)) > 0).mean() < 0.06
    assert list(lmscore.MEANS[1:4]) == [1, 2, 3]
