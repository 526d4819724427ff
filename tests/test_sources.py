"""Listings, contents and text records from a folder."""

from cairn.operators import recovery
from cairn.sources import storage

H = "0" * 52
TEXT = """StorePath: /store/abc-hello
URL: nar/%s.nar.xz
Compression: xz
FileSize: 12
NarHash: sha256:%s
NarSize: 34
References: abc-hello def-lib
Sig: k1:aa
Sig: k2:bb
""" % (H, H)


def test_stored_objects(spark, tmp_path):
    (tmp_path / "nar" / "0").mkdir(parents=True)
    (tmp_path / "nar" / "0" / f"{H}.nar.xz").write_bytes(b"abc")
    (tmp_path / "nar" / "0" / "readme").write_bytes(b"x")
    (tmp_path / "info").mkdir()
    (tmp_path / "info" / "abc.narinfo").write_text(TEXT)
    found = storage.archives(storage.listing(spark, str(tmp_path / "nar"))).select("hash", "compression", "size").collect()
    assert [tuple(r) for r in found] == [(H, "xz", 3)]
    assert {r["hash"] for r in storage.chunk_objects(storage.listing(spark, str(tmp_path / "nar"))).collect()} == {f"{H}.nar.xz", "readme"}
    assert [r["hash"] for r in storage.narinfo_objects(storage.listing(spark, str(tmp_path))).collect()] == ["abc"]
    assert bytes(storage.contents(spark, str(tmp_path / "nar"), "readme").first()["content"]) == b"x"
    r = storage.parsed_narinfos(storage.narinfo_texts(spark, str(tmp_path / "info"))).first()
    assert (r["hash"], r["url"], r["file_size"], r["nar_size"], r["references"], r["signatures"]) == ("abc", f"nar/{H}.nar.xz", 12, 34, ["abc-hello", "def-lib"], ["k1:aa", "k2:bb"])
    storage.written_once(spark.createDataFrame([("a", 1), ("a", 1)], "hash string, n int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_config_drift(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    now = {"avg": "2", "max": "3"}
    got = [tuple(recovery.config_drift(s, now).first()) for s in (rows(("x", "1")), rows(("avg", "2")), rows(("avg", "2"), ("max", "3")), rows(("avg", "9"), ("max", "8")))]
    assert got == [("new", ""), ("partial", ""), ("same", ""), ("drift", "avg: stored 9, current 2; max: stored 8, current 3")]
