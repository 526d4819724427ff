"""Traps of the model's semantics on small tables, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import hashing, urls, values
from cairn.operators import chunks, dml, eviction, graph, integrity, recovery, relational

NOW_SQL = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"
AT = datetime(2024, 2, 1)
H52, H64, INFO = "0" * 52, "a" * 64, "n5glp" + "0" * 27


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def evicted(rows, pinned, target):
    """rows: (id, size) in order. The prefix, then deletion until the target is met at a k below n - 1."""
    prefix, total = [], 0
    for id, size in rows:
        total += size
        if prefix and total > 2 * target:
            break
        prefix.append((id, size))
        if total > 2 * target:
            break
    free = [r for r in prefix if r[0] not in pinned]
    if target == 0:
        return [r[0] for r in free]
    freed, out = 0, []
    for k, (id, size) in enumerate(free, 1):
        freed += size
        out.append(id)
        if freed >= target and k < len(prefix) - 1:
            break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_eviction_stops_where_the_rule_says(spark, seed):
    rnd = random.Random(seed)
    n = [1, 2, 3, 6, 9, 12][seed]
    sizes = [rnd.choice([0, 1, 5, 40]) for _ in range(n)]
    rows = spark.createDataFrame([(k, f"h{k}", AT, s) for k, s in enumerate(sizes)], "id long, hash string, last_accessed_at timestamp_ntz, size long")
    pinned = [k for k in range(n) if rnd.random() < 0.3]
    pins = spark.createDataFrame([(f"h{k}",) for k in pinned], "hash string")
    for target in (0, 4, 20):
        got = [r["id"] for r in eviction.chosen(eviction.prefix(rows, target), pins, target).orderBy("id").collect()]
        assert got == evicted(list(enumerate(sizes)), pinned, target)


def test_closure_ends_on_cycles_and_keeps_unknown_roots(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (99,)], "node long")
    assert {r[0] for r in graph.closure(roots, edges).collect()} == {1, 2, 3, 99}
    long = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.closure(spark.createDataFrame([(0,)], "node long"), long).count() == 41


def test_urls(spark):
    cases = {
        f"nar/{H52}.nar": (H52, "none", ""), f"nar/{H52}.nar.xz?a=1&b": (H52, "xz", "a=1&b"), f"{INFO}-{H64}.nar.zst": (f"{INFO}-{H64}", "zstd", ""),
        f"deep/er/{H52}.nar.lzip": (H52, "lzip", ""), f"{H52}.nar.rar": None, f"{H52}.narxz": None, "nar/short.nar": None, "": None, f"nar/{H52}": None, ".nar": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", urls.parse_url(F.col("url")).alias("p"))
    assert {r["url"]: None if r["p"] is None else tuple(r["p"]) for r in df.collect()} == cases
    u = lambda url: urls.parse_upstream_url(F.lit(url), F.lit(H52))
    got = one(spark, u("nar/opaque.nar.xz").alias("a"), u("nar/castore/blob?narsize=3").alias("b"), u("helloworld").alias("c"), u(f"nar/{H64}.nar").alias("d"))
    assert tuple(got["a"]) == (H52, "xz", "", "nar/opaque.nar.xz") and tuple(got["b"]) == (H52, "none", "narsize=3", "nar/castore/blob")
    assert got["c"] is None and tuple(got["d"])[0] == H64
    got = one(spark, urls.normalised_hash(F.lit(f"{INFO}_{H52}")).alias("a"), urls.normalised_hash(F.lit(f"{INFO}-x")).alias("b"), urls.written(F.lit(H52), F.lit("bzip2"), F.lit("q=1")).alias("c"), urls.joined(F.lit("http://x/"), F.lit("a=1"), F.lit("/p"), F.lit("b=2")).alias("d"), urls.query_encoded(F.lit("b=2&a=x%20y&a=1")).alias("e"))
    assert tuple(got) == (H52, None, f"nar/{H52}.nar.bz2?q=1", "http://x/p?a=1&b=2", "a=x+y&a=1&b=2")


def test_hashes(spark):
    got = one(spark, hashing.valid_info_hash(F.lit(INFO)), hashing.valid_info_hash(F.lit("e" * 32)), hashing.valid_archive_hash(F.lit(f"{INFO}_{H52}")), hashing.valid_archive_hash(F.lit("a" * 63)), hashing.sharded_path(F.lit("ab")), hashing.sharded_path(F.lit("abc")), hashing.storage_key(F.lit("sha256:xyz")), hashing.storage_key(F.lit("xyz")), hashing.closure_hash(F.lit(f"{INFO}-name")), hashing.closure_hash(F.lit(f"{INFO}-name"), 52))
    assert tuple(got) == (True, False, True, False, None, "a/ab/abc", "xyz", "", INFO, None)
    digest = bytes(range(32))
    text = hashing.to_base32(digest)
    assert len(text) == 52 and all(hashing.parse_digest(x) == digest for x in (text, f"sha256:{text}", digest.hex()))
    import base64

    assert hashing.parse_digest("sha256-" + base64.b64encode(digest).decode()) == digest and hashing.parse_digest("nothing") is None
    got = spark.createDataFrame([(digest.hex(),), (None,)], "h string").select(hashing.hex_to_base32(F.col("h"))).collect()
    assert [r[0] for r in got] == [text, None]


def test_values(spark):
    sizes = {"10B": 10, "1k": 1024, "3M": 3 * 1024**2, "2T": 2 * 1024**4, "5": None, "K": None, "1KB": None, "": None, "-1K": None, "99999999999999999999T": None}
    df = spark.createDataFrame([(k,) for k in sizes], "s string").select("s", values.size_literal(F.col("s")).alias("n"))
    got = {r["s"]: None if r["n"] is None else int(r["n"]) for r in df.collect()}
    assert {k: v for k, v in got.items() if k[:5] != "99999"} == {k: v for k, v in sizes.items() if k[:5] != "99999"}
    ts = lambda s: F.expr(f"TIMESTAMP_NTZ '{s}'")
    got = one(spark, values.touched(ts("2024-01-31 23:55:00"), F.expr(NOW_SQL)), values.touched(ts("2024-01-31 23:54:59"), F.expr(NOW_SQL)), values.due(ts("2024-01-31 00:00:00"), F.expr(NOW_SQL), 86400), values.due(ts("2024-01-30 23:59:59"), F.expr(NOW_SQL), 86400), values.due(F.lit(None).cast("timestamp_ntz"), F.expr(NOW_SQL), 9), values.due(ts("2024-02-01 00:00:00"), F.expr(NOW_SQL), 0))
    assert tuple(got) == (datetime(2024, 1, 31, 23, 55), AT, False, True, True, True)
    info = one(spark, values.cache_info(F.lit("StoreDir: /s\nWantMassQuery: 1\nPriority: 40")).alias("a"), values.cache_info(F.lit("StoreDir: /s\nOther: 1")).alias("b"), values.cache_info(F.lit("Priority: x")).alias("c"))
    assert tuple(info["a"]) == ("/s", True, 40) and info["b"] is None and info["c"] is None
    got = one(spark, urls.accepted_encoding(F.lit("gzip, br;q=0.1")), urls.accepted_encoding(F.lit(None).cast("string")), values.existence(F.lit(404)), values.existence(F.lit(200)), values.existence(F.lit(500)), values.existence(F.lit(None).cast("int")))
    assert tuple(got) == ("br", "none", "absent", "present", "unknown", "unknown")


@pytest.mark.parametrize(("resolvable", "off", "flagged", "started", "want"), [(True, True, None, None, "normalise"), (True, True, 5, None, "normalise+clear"), (True, False, 5, None, "clear"), (True, False, None, None, "none"), (False, True, None, None, "set"), (False, False, 23, None, "wait"), (False, False, 24, None, "reclaim"), (False, False, 99, 0.9, "skip"), (False, False, 99, 1, "reclaim")])
def test_residue(spark, resolvable, off, flagged, started, want):
    ago = lambda h: F.lit(None).cast("timestamp_ntz") if h is None else F.expr(f"TIMESTAMP_NTZ '{AT - timedelta(hours=h)}'")
    assert one(spark, integrity.residue_decision(F.lit(resolvable), F.lit(off), ago(flagged), ago(started), F.expr(NOW_SQL)))[0] == want


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", None, 5), (2, "b", "u", 6)], "id long, hash string, url string, size long")
    new = spark.createDataFrame([(7, "a", "x", 9), (8, "c", "y", 8)], "id long, hash string, url string, size long")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(dml.insert_or_ignore(old, new.unionByName(new), ["hash"])) == [(1, "a", None, 5), (2, "b", "u", 6), (8, "c", "y", 8)]
    assert key(dml.upsert(old, new, ["hash"], ["size"])) == [(1, "a", None, 9), (2, "b", "u", 6), (8, "c", "y", 8)]
    assert key(dml.upsert(old, new, ["hash"], {"size": F.col("size") + F.col("n_size")})) == [(1, "a", None, 14), (2, "b", "u", 6), (8, "c", "y", 8)]
    assert key(dml.fill_stubs(old, new, ["hash"])) == [(1, "a", "x", 9), (2, "b", "u", 6), (8, "c", "y", 8)]
    assert key(dml.update_where(old, F.col("url") == "u", {"size": F.lit(0)})) == [(1, "a", None, 5), (2, "b", "u", 0)]
    assert key(dml.delete_where(old, F.col("url") == "u")) == [(1, "a", None, 5)]
    found = schema.violations({"pinned_closures": spark.createDataFrame([(1, "a"), (2, "a"), (3, "")], "id long, hash string")})
    assert {r["rule"]: r["n"] for r in found.collect()} == {"unique pinned_closures(hash)": 1, "not empty pinned_closures(hash)": 1}


def test_broken_rules_raise(spark):
    pins = lambda *rows: {"pinned_closures": spark.createDataFrame(list(rows), "id long, hash string")}
    assert schema.checked(pins((1, "a"), (2, "b")))
    with pytest.raises(schema.ConstraintError, match="unique"):
        schema.checked(pins((1, "a"), (2, "a")))
    with pytest.raises(schema.ValidationError, match="not empty"):
        schema.checked(pins((1, "")))


def test_single_row_or_failure(spark):
    q = relational.Query(spark.range(3))
    assert q.where(F.col("id") == 1).single().collect()[0]["id"] == 1
    for wrong in (q, q.where(F.lit(False))):
        with pytest.raises(Exception, match="not (found|singular)"):
            wrong.single().collect()
    with pytest.raises(Exception, match="not found"):
        recovery.config_value(spark.createDataFrame([("a", "1")], "key string, value string"), "b").collect()
    with pytest.raises(RuntimeError, match="deeper"):
        graph.closure(spark.createDataFrame([(0,)], "node long"), spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), most_levels=10)


def test_builder_errors(spark):
    q = relational.Query(spark.range(3))
    assert q.where(F.col("id") == 1).only()["id"] == 1 and q.first_row()["id"] == 0
    with pytest.raises(relational.NotSingular):
        q.only()
    with pytest.raises(relational.NotFound):
        q.where(F.lit(False)).only()


def test_three_valued_absence(spark):
    files, links = spark.range(5), spark.createDataFrame([(0, 10), (1, 11), (2, 12), (3, 13)], "nar_file_id long, narinfo_id long")
    probes = spark.createDataFrame([(10, "absent"), (10, "absent"), (11, "absent"), (11, None), (12, "present")], "narinfo_id long, status string")
    got = {r[0]: r[1] for r in recovery.probed(files, links, probes).collect()}
    assert got == {0: "delete_absent", 1: "keep", 2: "keep", 3: "keep", 4: "delete_linkless"}


def test_touches_depend_on_the_last_accepted_one(spark):
    log = spark.createDataFrame([(1, AT + timedelta(minutes=m)) for m in (0, 4, 8, 12, 13.1)], "k long, t timestamp_ntz")
    assert recovery.touches(log, "k", "t").first()["accepted"] == 3  # 0, 8, 13.1


def test_content_defined_chunks(spark):
    rnd = random.Random(1)
    data = rnd.randbytes(200_000)
    table = chunks.gear()
    ends = chunks.boundaries(data, table, 512, 2048, 8192)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= 8192 and min(sizes[:-1]) >= 512
    moved = chunks.boundaries(b"xyz" + data, table, 512, 2048, 8192)
    assert len({e - 3 for e in moved} & set(ends)) > 0.8 * len(ends)
    got = chunks.chunked(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "id long, content binary"), 512, 2048, 8192)
    assert chunks.assembled_bytes(got).first()["content"] == data and got.where("nar_file_id > 1").count() == 0


def test_codecs(spark):
    import bz2
    import lzma

    import zstandard

    raw = b"hello world" * 50
    rows = [("none", raw), ("bzip2", bz2.compress(raw)), ("xz", lzma.compress(raw)), ("zstd", zstandard.ZstdCompressor().compress(raw)), ("xz", b"not xz")]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "k string, c binary")
    got = [bytes(r[0]) for r in df.select(chunks.decompressed(F.col("c"), F.col("k"))).collect()]
    assert got == [raw] * 4 + [b"not xz"]
    two = zstandard.ZstdCompressor().compress(raw) + zstandard.ZstdCompressor().compress(b"more")
    odd = [("zstd", two), ("", raw), ("zstd", two[:-3]), ("bzip2", bz2.compress(raw)[:-5]), ("xz", lzma.compress(raw)[:-8]), ("bzip2", bz2.compress(raw) + bz2.compress(b"x")), ("br", raw), ("rar", raw), (None, raw), ("xz", None)]
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in odd], "k string, c binary").select(chunks.decoded(F.col("c"), F.col("k")).alias("d")).collect()
    got = [(None if r["d"]["data"] is None else bytes(r["d"]["data"]), r["d"]["error"]) for r in rows]
    assert got == [(raw + b"more", None), (raw, None), (None, "truncated zstd"), (None, "truncated bzip2"), (None, "truncated xz"), (raw + b"x", None), (None, "no decoder for br"), (None, "unsupported compression rar"), (raw, None), (None, None)]
    back = df.limit(1).select(chunks.decompressed(chunks.zstd_compressed(F.col("c")), F.lit("zstd"))).first()[0]
    assert bytes(back) == raw
