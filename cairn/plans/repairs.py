"""Queries: the repair chain and other work of several steps, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls, values
from ..operators import chunks, dml, integrity, recovery, relational
from ..sources import storage
from .bindings import NOW
from .registry import query
from .reports import RESIDUE, _residue

now = lambda: F.expr(f"TIMESTAMP_NTZ '{NOW}'")
T = f"TIMESTAMP '{NOW}'"
MD5 = r"^nar/([^.]+)\."


@query("q_residue_applied", f"""SELECT f.id, CASE WHEN d.decision = 'set' THEN {T} WHEN d.decision IN ('clear', 'normalise+clear') THEN NULL ELSE f.dechunk_residue_flagged_at END AS flagged
  FROM nar_files f LEFT JOIN ({RESIDUE}) d ON d.id = f.id WHERE coalesce(d.decision, '') <> 'reclaim'""")
def _(t):
    out = integrity.residue_applied(t.nar_files, t.narinfos, t.narinfo_nar_files, _residue(t), now())
    return out["nar_files"].select("id", F.col("dechunk_residue_flagged_at").alias("flagged"))


@query("q_residue_urls", f"""SELECT i.id, coalesce(x.plain, i.url) AS url, CASE WHEN x.plain IS NOT NULL THEN 'none' ELSE i.compression END AS compression
  FROM narinfos i LEFT JOIN (SELECT l.narinfo_id, min_by('nar/' || f.hash || '.nar', f.id) AS plain FROM narinfo_nar_files l JOIN nar_files f ON f.id = l.nar_file_id
    JOIN ({RESIDUE}) d ON d.id = f.id AND starts_with(d.decision, 'normalise') GROUP BY 1) x ON x.narinfo_id = i.id""")
def _(t):
    return integrity.residue_applied(t.nar_files, t.narinfos, t.narinfo_nar_files, _residue(t), now())["narinfos"].select("id", "url", "compression")


REPAIRED = f"""WITH plan AS (SELECT i.id AS narinfo_id, min_by(f.id, (CASE WHEN f.compression = i.compression THEN 0 ELSE 1 END) * 100000000 + f.id) AS nar_file_id
    FROM cdc_infos i JOIN cdc_files f ON f.hash = regexp_extract(i.url, '{MD5}', 1) WHERE i.id NOT IN (SELECT narinfo_id FROM narinfo_nar_files) GROUP BY i.id),
  links1 AS (SELECT narinfo_id, nar_file_id FROM narinfo_nar_files UNION SELECT * FROM plan),
  infos1 AS (SELECT * FROM cdc_infos WHERE id IN (SELECT narinfo_id FROM links1)),
  files2 AS (SELECT * FROM cdc_files WHERE id IN (SELECT nar_file_id FROM links1) AND NOT (total_chunks <= 0 AND id NOT IN (SELECT id FROM stored))),
  links2 AS (SELECT * FROM links1 WHERE nar_file_id IN (SELECT id FROM files2)),
  issues AS (SELECT f.id FROM cdc_files f LEFT JOIN (SELECT nar_file_id, count(*) AS n FROM nar_file_chunks GROUP BY 1) l ON l.nar_file_id = f.id WHERE f.total_chunks > 0 AND coalesce(l.n, 0) <> f.total_chunks),
  files3 AS (SELECT * FROM files2 WHERE id NOT IN (SELECT id FROM issues)),
  links3 AS (SELECT * FROM links2 WHERE nar_file_id IN (SELECT id FROM files3)),
  infos3 AS (SELECT * FROM infos1 WHERE id IN (SELECT narinfo_id FROM links3)),
  off AS (SELECT DISTINCT f.id FROM files3 f JOIN links3 l ON l.nar_file_id = f.id JOIN infos3 i ON i.id = l.narinfo_id WHERE f.total_chunks > 0 AND i.nar_size IS NOT NULL AND i.nar_size <> f.file_size
    INTERSECT SELECT DISTINCT f.id FROM cdc_files f JOIN narinfo_nar_files l ON l.nar_file_id = f.id JOIN cdc_infos i ON i.id = l.narinfo_id WHERE f.total_chunks > 0 AND i.nar_size IS NOT NULL AND i.nar_size <> f.file_size),
  files4 AS (SELECT * FROM files3 WHERE id NOT IN (SELECT id FROM off) AND id % 97 <> 5 AND id % 89 <> 4),
  links4 AS (SELECT * FROM links3 WHERE nar_file_id IN (SELECT id FROM files4)),
  infos4 AS (SELECT * FROM infos3 WHERE id IN (SELECT narinfo_id FROM links4)),
  bad AS (SELECT i.id FROM infos4 i WHERE i.compression = 'xz' AND i.id NOT IN (SELECT l.narinfo_id FROM links4 l JOIN files4 f ON f.id = l.nar_file_id WHERE f.compression = 'xz')
    AND regexp_extract(i.url, '{MD5}', 1) NOT IN (SELECT hash FROM files4 WHERE compression = 'xz')
    AND (i.id, regexp_extract(i.url, '{MD5}', 1)) IN (SELECT l.narinfo_id, f.hash FROM links4 l JOIN files4 f ON f.id = l.nar_file_id)),
  left_ AS (SELECT * FROM chunks WHERE id IN (SELECT chunk_id FROM nar_file_chunks WHERE nar_file_id IN (SELECT id FROM files4) OR nar_file_id NOT IN (SELECT id FROM cdc_files)))
  SELECT 'narinfos' AS kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM infos4 UNION ALL SELECT 'nar_files', count(*), CAST(sum(id) AS BIGINT) FROM files4
  UNION ALL SELECT 'links', count(*), CAST(sum(narinfo_id + nar_file_id) AS BIGINT) FROM links4 UNION ALL SELECT 'chunks', count(*), CAST(sum(id) AS BIGINT) FROM left_
  UNION ALL SELECT 'stored', count(*), CAST(sum(id) AS BIGINT) FROM stored WHERE id IN (SELECT id FROM cdc_files)
  UNION ALL SELECT 'stored_chunks', count(*), CAST(NULL AS BIGINT) FROM chunks
  UNION ALL SELECT 'rewritten', count(*), CAST(sum(id) AS BIGINT) FROM infos4 WHERE compression <> 'none' AND id IN (SELECT id FROM bad)"""


@query("q_repaired", REPAIRED)
def _(t):
    t = t.staged("rows").staged("chunks", "nar_file_chunks", "narinfo_nar_files").staged("cdc_files", "cdc_infos")
    every = t.rows.select("hash").distinct()
    tables = {"narinfos": t.cdc_infos, "nar_files": t.cdc_files, "narinfo_nar_files": t.narinfo_nar_files.select("narinfo_id", "nar_file_id"), "chunks": t.chunks, "nar_file_chunks": t.nar_file_chunks,
              "stored": t.stored, "stored_chunks": every.union(t.nation.select(F.md5("n_name")))}
    found = {
        "1a": integrity.unlinked_infos(t.cdc_infos, t.narinfo_nar_files), "1b": integrity.unlinked_files(t.cdc_files, t.narinfo_nar_files),
        "1c": integrity.missing_files(t.cdc_files, t.stored, ["id"]), "1d": integrity.unknown_files(t.stored, t.cdc_files, ["id"]), "1e": integrity.unlinked_chunks(t.chunks, t.nar_file_chunks),
        "1f": integrity.chunk_issues(t.cdc_files, t.nar_file_chunks, t.chunks, every), "1g": integrity.size_mismatches(t.cdc_files, t.narinfo_nar_files, t.cdc_infos),
        "1h": tables["stored_chunks"].join(t.chunks.select("hash"), "hash", "left_anti"), "1i": t.cdc_files.where("id % 97 = 5"), "1j": t.cdc_files.where("id % 89 = 4"),
    }
    out = integrity.repaired(tables, found, ["id"])
    one = lambda k, n, total: out[k].agg(F.lit(n).alias("kind"), F.count(F.lit(1)).alias("n"), total.cast("bigint").alias("total"))
    ids = F.sum("id")
    made = [one("narinfos", "narinfos", ids), one("nar_files", "nar_files", ids), one("narinfo_nar_files", "links", F.sum(F.col("narinfo_id") + F.col("nar_file_id"))), one("chunks", "chunks", ids), one("stored", "stored", ids), one("stored_chunks", "stored_chunks", F.lit(None))]
    before = t.cdc_infos.where("compression <> 'none'").select("id")
    out["rewritten"] = out["narinfos"].where("compression = 'none'").join(before, "id", "left_semi")
    made.append(one("rewritten", "rewritten", ids))
    total = made[0]
    for m in made[1:]:
        total = total.unionByName(m)
    return total


@query("q_desync_repaired", f"""SELECT i.id, CASE WHEN b.id IS NOT NULL THEN 'nar/' || regexp_extract(i.url, '{MD5}', 1) || '.nar' ELSE i.url END AS url,
   CASE WHEN b.id IS NOT NULL THEN 'none' ELSE i.compression END AS compression, CASE WHEN b.id IS NULL THEN i.file_size END AS file_size
  FROM narinfos i LEFT JOIN (SELECT i.id FROM narinfos i JOIN narinfo_nar_files l ON l.narinfo_id = i.id JOIN nar_files f ON f.id = l.nar_file_id AND f.hash = regexp_extract(i.url, '{MD5}', 1)
    WHERE i.compression = 'xz' AND i.id NOT IN (SELECT l.narinfo_id FROM narinfo_nar_files l JOIN nar_files f ON f.id = l.nar_file_id WHERE f.compression = 'xz') AND f.compression <> 'xz') b ON b.id = i.id""")
def _(t):
    return integrity.desync_repaired(t.narinfos, t.narinfo_nar_files, t.nar_files).select("id", "url", "compression", "file_size")


@query("q_safe_delete", """WITH kept AS (SELECT narinfo_id, nar_file_id FROM narinfo_nar_files WHERE NOT (nar_file_id % 4 = 0 AND narinfo_id % 2 = 0))
  SELECT 'narinfos' AS kind, count(*) AS n FROM narinfos WHERE NOT (id IN (SELECT narinfo_id FROM narinfo_nar_files WHERE nar_file_id % 4 = 0 AND narinfo_id % 2 = 0) AND id NOT IN (SELECT narinfo_id FROM kept))
  UNION ALL SELECT 'links', count(*) FROM kept UNION ALL SELECT 'nar_files', count(*) FROM nar_files WHERE NOT (id % 4 = 0 AND id NOT IN (SELECT nar_file_id FROM kept))""")
def _(t):
    out = recovery.safe_delete(t.narinfos, t.narinfo_nar_files, t.nar_files, t.nar_files.where("id % 4 = 0"), t.narinfos.where("id % 2 = 0"))
    one = lambda k, n: out[k].agg(F.lit(n).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("narinfos", "narinfos").unionByName(one("narinfo_nar_files", "links")).unionByName(one("nar_files", "nar_files"))


def _put(t):
    put = t.part.where("p_partkey % 2 = 0").select(F.md5(F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).alias("hash"), F.lit("xz").alias("compression"), F.lit("").alias("query"), F.lit(5).cast("bigint").alias("size"))
    stored = t.nar_files.where("id % 3 = 0").select("hash", F.lit("xz").alias("compression"), "query", (F.col("file_size") + 1).alias("size"))
    return recovery.put_archives(put, stored, t.nar_files, t.narinfos, t.narinfo_nar_files.select("narinfo_id", "nar_file_id"), now())


@query("q_put_archives", f"""SELECT hash, compression, CASE WHEN id % 2 = 0 AND compression = 'xz' THEN CASE WHEN id % 3 = 0 THEN file_size + 1 ELSE 5 END ELSE file_size END AS file_size, total_chunks,
   CASE WHEN id % 2 = 0 AND compression = 'xz' THEN {T} ELSE bytes_stored_at END AS bytes_stored_at FROM nar_files
  UNION ALL SELECT hash, 'xz', CASE WHEN id % 3 = 0 THEN file_size + 1 ELSE 5 END, 0, {T} FROM nar_files WHERE id % 2 = 0 AND compression <> 'xz'""")
def _(t):
    return _put(t)["nar_files"].select("hash", "compression", "file_size", "total_chunks", "bytes_stored_at")


@query("q_put_links", f"""SELECT l.narinfo_id, f.hash, f.compression FROM narinfo_nar_files l JOIN nar_files f ON f.id = l.nar_file_id
  UNION SELECT i.id, f.hash, 'xz' FROM narinfos i JOIN nar_files f ON f.hash = regexp_extract(i.url, '{MD5}', 1) WHERE f.id % 2 = 0 AND ends_with(i.url, '.xz')""")
def _(t):
    out = _put(t)
    return out["narinfo_nar_files"].join(out["nar_files"].select(F.col("id").alias("nar_file_id"), "hash", "compression"), "nar_file_id").select("narinfo_id", "hash", "compression")


@query("q_deleted_archives", f"""SELECT id, CASE WHEN hash IN (SELECT regexp_extract(url, '{MD5}', 1) FROM narinfos WHERE id % 5 = 0 AND ends_with(url, '.nar')) AND compression IN ('zstd', 'xz', 'none') THEN NULL ELSE bytes_stored_at END AS bytes_stored_at FROM nar_files""")
def _(t):
    plain = t.narinfos.where("id % 5 = 0").select(urls.parsed(F.col("url")).alias("p")).where("p.compression = 'none'")
    removed = recovery.deletion_plan(plain.select("p.hash", "p.query", "p.compression").distinct(), t.nar_files)
    return recovery.deleted_archives(t.nar_files, removed).select("id", "bytes_stored_at")


@query("q_served_variants", f"""SELECT hash, compression, file_size, CASE WHEN id % 4 < 2 AND compression IN ('zstd', 'xz', 'none') THEN {T} ELSE NULL END AS last_accessed_at FROM nar_files WHERE id % 4 <> 1 OR compression NOT IN ('zstd', 'xz', 'none')
  UNION ALL SELECT hash, compression, file_size, {T} FROM nar_files WHERE id % 4 = 1 AND compression IN ('zstd', 'xz', 'none')""")
def _(t):
    """A quarter of the stored archives has lost its row, which the request for it heals."""
    stored = t.nar_files.select("hash", "query", "compression", F.col("file_size").alias("size"))
    rows = t.nar_files.where("id % 4 <> 1 or compression not in ('zstd', 'xz', 'none')").withColumn("last_accessed_at", F.lit(None).cast("timestamp_ntz"))
    out = recovery.served(t.nar_files.where("id % 4 < 2").select("hash", "query"), stored, rows, now())
    return out.select("hash", "compression", "file_size", "last_accessed_at")


def _texts(t):
    """Stored narinfo texts of every second narinfo (one in seven without a URL) and of narinfos that no table has."""
    refs = t.refs.groupBy(F.col("src").alias("id")).agg(F.concat_ws(" ", F.sort_array(F.collect_set(F.concat(F.lit("p"), F.col("dst").cast("string"))))).alias("refs"))
    sigs = t.signatures.groupBy(F.col("narinfo_id").alias("id")).agg(F.sort_array(F.collect_set("signature")).alias("sigs"))
    rows = t.narinfos.where("id % 2 = 0").select("id", "hash", "nar_size").unionByName(t.narinfos.where("id % 10 = 1").select("id", F.md5(F.concat(F.lit("new"), F.col("id").cast("string"))).alias("hash"), "nar_size"))
    rows = rows.join(refs, "id", "left").join(sigs, "id", "left")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    text = F.concat_ws("\n", line("StorePath", "hash"), F.when(F.col("id") % 7 != 0, line("URL", F.concat(F.lit("nar/"), "hash", F.lit(".nar")))), F.lit("Compression: none"), F.lit("FileSize: 0"), line("NarSize", F.col("nar_size").cast("string")), line("References", F.coalesce("refs", F.lit(""))),
        F.array_join(F.transform(F.coalesce("sigs", F.array().cast("array<string>")), lambda s: F.concat(F.lit("Sig: "), s)), "\n"))
    return storage.parsed_narinfos(rows.select("hash", text.alias("text")))


def _migrated(t):
    infos = t.narinfos.select("id", "hash", "url", "compression", "file_size", "nar_size", "deriver")
    references = t.refs.where("src % 3 = 0").select(F.col("src").alias("narinfo_id"), F.concat(F.lit("p"), F.col("dst").cast("string")).alias("reference")).distinct()
    return recovery.migrated_narinfos(_texts(t), infos, references, t.signatures.where("narinfo_id % 3 = 0").distinct())


TEXTS = """SELECT id, hash, nar_size, id AS of_ FROM narinfos WHERE id % 2 = 0 UNION ALL SELECT NULL, md5('new' || CAST(id AS VARCHAR)), nar_size, id FROM narinfos WHERE id % 10 = 1"""
FRESH = f"""SELECT x.* FROM ({TEXTS}) x WHERE of_ % 7 <> 0 AND hash NOT IN (SELECT hash FROM narinfos WHERE coalesce(url, '') <> '')"""


@query("q_migration_outcomes", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN of_ % 7 = 0 THEN 'invalid' WHEN hash IN (SELECT hash FROM narinfos WHERE coalesce(url, '') <> '') THEN 'already' ELSE 'migrated' END AS outcome FROM ({TEXTS}) x) y GROUP BY outcome""")
def _(t):
    return _migrated(t)["outcomes"].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("q_migrated_narinfos", f"""SELECT i.hash, CASE WHEN f.hash IS NOT NULL THEN 'nar/' || i.hash || '.nar' ELSE i.url END AS url, CASE WHEN f.hash IS NOT NULL THEN 'none' ELSE i.compression END AS compression,
   CASE WHEN f.hash IS NULL THEN i.file_size END AS file_size, i.nar_size FROM narinfos i LEFT JOIN ({FRESH}) f ON f.hash = i.hash
  UNION ALL SELECT hash, 'nar/' || hash || '.nar', 'none', NULL, nar_size FROM ({FRESH}) g WHERE id IS NULL""")
def _(t):
    return _migrated(t)["narinfos"].select("hash", "url", "compression", "file_size", "nar_size")


@query("q_migrated_children", f"""SELECT 'references' AS kind, count(*) AS n FROM (SELECT i.hash, r.dst FROM refs r JOIN narinfos i ON i.id = r.src WHERE r.src % 3 = 0 UNION SELECT f.hash, r.dst FROM ({FRESH}) f JOIN refs r ON r.src = f.of_) x
  UNION ALL SELECT 'signatures', count(*) FROM (SELECT i.hash, s.signature FROM signatures s JOIN narinfos i ON i.id = s.narinfo_id WHERE s.narinfo_id % 3 = 0 UNION SELECT f.hash, s.signature FROM ({FRESH}) f JOIN signatures s ON s.narinfo_id = f.of_) y""")
def _(t):
    out = _migrated(t)
    one = lambda k, n: out[k].agg(F.lit(n).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("narinfo_references", "references").unionByName(one("narinfo_signatures", "signatures"))


def _archives(t):
    """Whole files with their bytes: a text each, stored in one of five ways; some are chunked already, some unreadable."""
    plain = F.col("text").cast("binary")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("none", "zstd", "", "br", "xz")]), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.when(F.col("doc_id") % 5 == 1, chunks.zstd_compressed(plain)).otherwise(plain)
    files = t.documents.select(F.col("doc_id").alias("id"), F.md5(F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("hash"), kind.alias("compression"), F.lit(0).cast("bigint").alias("file_size"), F.when(F.col("doc_id") % 6 == 0, 2).otherwise(0).cast("bigint").alias("total_chunks"), F.lit(None).cast("timestamp_ntz").alias("chunking_started_at"), content.alias("content"))
    none = t._spark.range(0)
    return chunks.to_chunks(files, none.select("id", F.lit("").alias("hash"), F.lit(0).cast("bigint").alias("size")), none.select(F.col("id").alias("nar_file_id"), F.col("id").alias("chunk_id"), F.col("id").alias("chunk_index")), 256, 1024, 4096)


@query("q_archives_to_chunks", """SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN element_at(['none', 'zstd', '', 'br', 'xz'], CAST(doc_id % 5 + 1 AS INT)) WHEN doc_id % 5 = 3 THEN 'br' ELSE 'none' END AS compression, CASE WHEN doc_id % 6 = 0 OR doc_id % 5 = 3 THEN 0 ELSE strlen(text) END AS file_size, doc_id % 6 <> 0 AND doc_id % 5 = 3 AS failed FROM documents WHERE strlen(text) > 0""".replace("element_at(", "list_extract("))
def _(t):
    out = _archives(t)
    lost = out["failed"].select("id", F.lit(True).alias("failed"))
    return out["nar_files"].join(t.documents.where("octet_length(text) > 0").select(F.col("doc_id").alias("id")), "id", "left_semi").join(lost, "id", "left").select("id", "compression", "file_size", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("q_chunks_reassembled", "SELECT doc_id AS id, strlen(text) AS size, sha256(text) AS sha256, true AS complete FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 5 <> 3 AND strlen(text) > 0")
def _(t):
    """What was archived, decoded, cut and recorded comes back from the chunk tables byte by byte."""
    out = _archives(t)
    contents = out["chunked"].select("hash", "content").dropDuplicates(["hash"])
    linked = out["nar_file_chunks"].join(out["chunks"].select(F.col("id").alias("chunk_id"), "hash"), "chunk_id").join(contents, "hash")
    whole = chunks.assembled_digests(linked)
    counts = out["nar_files"].select(F.col("id").alias("nar_file_id"), "total_chunks")
    return whole.join(counts, "nar_file_id").select(F.col("nar_file_id").alias("id"), "size", "sha256", (F.col("n") == F.col("total_chunks")).alias("complete"))


@query("q_recompressed", "SELECT doc_id AS id, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents")
def _(t):
    lined = F.concat(F.when(F.col("chunk_index") > 0, "\n").otherwise(""), "data").cast("binary")
    whole = chunks.assembled_bytes(t.rows.select("nar_file_id", "chunk_index", lined.alias("content")))
    packed = whole.select(F.col("nar_file_id").alias("id"), chunks.zstd_compressed(F.col("content")).alias("content"))
    back = packed.select("id", chunks.decoded(F.col("content"), F.lit("zstd")).alias("d"))
    return back.select("id", F.sha2("d.data", 256).alias("sha256"), "d.error")


OUTCOME = """SELECT d.id, CASE WHEN d.total_chunks <= 0 THEN 'already_whole' WHEN d.id % 5 = 0 THEN 'no_hash' WHEN coalesce(l.n, 0) <> d.total_chunks THEN 'missing_chunk' WHEN d.id % 3 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS outcome
  FROM doc_files d LEFT JOIN (SELECT nar_file_id, count(*) AS n FROM nar_file_chunks GROUP BY 1) l ON l.nar_file_id = d.id"""


@query("q_made_whole", f"""WITH ok AS (SELECT id FROM ({OUTCOME}) x WHERE outcome = 'ok')
  SELECT 'files' AS kind, count(*) AS n FROM doc_files WHERE total_chunks > 0 AND id NOT IN (SELECT id FROM ok)
  UNION ALL SELECT 'urls', count(*) FROM narinfos WHERE id IN (SELECT narinfo_id FROM narinfo_nar_files WHERE nar_file_id IN (SELECT id FROM ok)) OR ends_with(url, '.nar')
  UNION ALL SELECT 'links', count(*) FROM nar_file_chunks WHERE nar_file_id NOT IN (SELECT id FROM ok)
  UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE id NOT IN (SELECT chunk_id FROM nar_file_chunks WHERE nar_file_id IN (SELECT id FROM ok)) OR id IN (SELECT chunk_id FROM nar_file_chunks WHERE nar_file_id NOT IN (SELECT id FROM ok))""")
def _(t):
    got = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))
    expected = got.select("id", F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 3 == 0, "wrong").otherwise(F.col("sha256")).alias("nar_hash"), F.col("size").alias("nar_size"))
    files = t.doc_files.withColumns({"hash": F.md5(F.concat(F.lit("f"), F.col("id").cast("string"))), "compression": F.lit("xz")})
    out = chunks.made_whole(files, t.nar_file_chunks, t.chunks, t.narinfos, t.narinfo_nar_files, chunks.to_whole(t.doc_files, t.nar_file_chunks, expected, got))
    one = lambda k, n, df: df.agg(F.lit(n).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one(0, "files", out["nar_files"].where("total_chunks > 0")).unionByName(one(0, "urls", out["narinfos"].where("endswith(url, '.nar')"))).unionByName(one(0, "links", out["nar_file_chunks"])).unionByName(one(0, "chunks", out["chunks"]))


@query("q_stale_reclaimed", """SELECT 'links' AS kind, count(*) AS n FROM nar_file_chunks WHERE nar_file_id NOT IN (SELECT id FROM doc_files WHERE total_chunks <= 0)
  UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE id IN (SELECT chunk_id FROM nar_file_chunks WHERE nar_file_id NOT IN (SELECT id FROM doc_files WHERE total_chunks <= 0)) OR id NOT IN (SELECT chunk_id FROM nar_file_chunks)""")
def _(t):
    stale = chunks.stale_links(t.nar_file_chunks, t.doc_files.withColumn("chunking_started_at", F.lit(None).cast("timestamp_ntz"))).select(F.col("nar_file_id").alias("id")).distinct()
    _, links, left = chunks.purged(t.doc_files, t.nar_file_chunks, t.chunks, stale)
    return links.agg(F.lit("links").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(left.agg(F.lit("chunks").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("q_relinked_after_change", f"""WITH kept AS (SELECT * FROM nar_files WHERE NOT (compression = 'xz' AND id % 2 = 0)), changed AS (SELECT id, hash FROM nar_files WHERE compression = 'xz' AND id % 2 = 0)
  SELECT narinfo_id, nar_file_id FROM narinfo_nar_files WHERE nar_file_id IN (SELECT id FROM kept)
  UNION SELECT i.id, c.id + 1000000 FROM narinfos i JOIN changed c ON c.hash = regexp_extract(i.url, '{MD5}', 1)""")
def _(t):
    old = t.nar_files.where("compression = 'xz' and id % 2 = 0")
    links = dml.delete_matching(t.narinfo_nar_files.select("narinfo_id", "nar_file_id"), old.select(F.col("id").alias("nar_file_id")), ["nar_file_id"])
    named = t.narinfos.where("coalesce(url, '') <> ''").select(F.col("id").alias("narinfo_id"), urls.parsed(F.col("url"))["hash"].alias("hash"))
    return dml.relink(links, named.join(old.select("hash", (F.col("id") + 1000000).alias("nar_file_id")), "hash").select("narinfo_id", "nar_file_id"))


@query("q_trace_upsert", """SELECT drv_path, output_name, '{"key":{"drvPath":"' || drv_path || '","outputName":"' || output_name || '"},"value":{"outPath":"' || out_path || '","signatures":[{"keyName":"' || CASE WHEN turn % 2 = 0 THEN 'new' ELSE key_name END || '","sig":"s"}]}}' AS entry
  FROM (SELECT conv_id, turn, drv_path, output_name, CASE WHEN turn % 2 = 0 THEN md5(out_path) ELSE out_path END AS out_path, key_name FROM build_traces) x""")
def _(t):
    """Entries and their signatures after every second one was put again, read back as JSON."""
    key = ["drv_path", "output_name"]
    fresh = t.build_traces.where("turn % 2 = 0")
    entries = dml.upsert(t.build_traces.select(*key, "out_path"), fresh.select(*key, F.md5("out_path").alias("out_path")), key, ["out_path"])
    named = lambda df, name: df.select(F.struct(*key).alias("entry"), name.alias("key_name"))
    signed = dml.replace_children(named(t.build_traces, F.col("key_name")), named(fresh, F.lit("new")), "entry")
    grouped = signed.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct(F.col("key_name").alias("keyName"), F.lit("s").alias("sig")))).alias("signatures"))
    both = entries.join(grouped.select("entry.*", "signatures"), key)
    json = F.to_json(F.struct(F.struct(F.col("drv_path").alias("drvPath"), F.col("output_name").alias("outputName")).alias("key"), F.struct(F.col("out_path").alias("outPath"), "signatures").alias("value")))
    return both.select(*key, json.alias("entry"))


@query("q_staged_parts", """SELECT conv_id, CAST(count(*) AS BIGINT) AS parts, sha256(string_agg(data, '' ORDER BY part)) AS sha256 FROM pieces WHERE part < parts_available GROUP BY conv_id""")
def _(t):
    ready = chunks.parts_ready(t.pieces, F.col("parts_available"))
    rows = ready.select(F.col("conv_id").alias("nar_file_id"), F.col("part").alias("chunk_index"), F.col("data").cast("binary").alias("content"))
    return chunks.assembled_digests(rows).select(F.col("nar_file_id").alias("conv_id"), F.col("n").alias("parts"), "sha256")


@query("q_chunk_page", "SELECT chunk_index, chunk_id FROM nar_file_chunks WHERE nar_file_id = 5 AND chunk_index > 2 ORDER BY chunk_index LIMIT 512")
def _(t):
    return relational.page_after(t.nar_file_chunks.where("nar_file_id = 5"), 2, 512, "chunk_index").select("chunk_index", "chunk_id")


@query("q_links_with_chunks", "SELECT l.nar_file_id, l.chunk_index, c.hash, c.hash IS NULL AS missing FROM nar_file_chunks l LEFT JOIN (SELECT id, hash FROM chunks WHERE size % 10 <> 7) c ON c.id = l.chunk_id")
def _(t):
    return chunks.links_with_chunks(t.nar_file_chunks, t.chunks.where("size % 10 <> 7"))


@query("q_flushes", 'SELECT nar_file_id, CAST(floor((rn - 1) / 3) AS BIGINT) AS flush, count(*) AS n FROM (SELECT nar_file_id, row_number() OVER (PARTITION BY nar_file_id ORDER BY chunk_index) AS rn FROM rows) x GROUP BY 1, 2')
def _(t):
    return chunks.flushes(t.rows, "nar_file_id", "chunk_index", 3).groupBy("nar_file_id", "flush").agg(F.count(F.lit(1)).alias("n"))


@query("q_chunk_indexed", 'SELECT nar_file_id, CAST(row_number() OVER (PARTITION BY nar_file_id ORDER BY o) - 1 AS BIGINT) AS chunk_index, hash FROM (SELECT nar_file_id, hash, sum(size) OVER (PARTITION BY nar_file_id ORDER BY chunk_index) + chunk_index AS o FROM rows) x')
def _(t):
    placed = chunks.offsets(t.rows).withColumn("offset", F.col("offset") + F.col("chunk_index"))
    return chunks.indexed(placed.drop("chunk_index"), "nar_file_id", "offset").select("nar_file_id", "chunk_index", "hash")


@query("q_superseded", f"""SELECT id FROM nar_files WHERE total_chunks <= 0 AND compression <> 'none' AND created_at < {T} - INTERVAL 1 DAY AND id % 3 = 0""")
def _(t):
    """Whole files next to a chunked row of their hash, as re-chunking leaves them."""
    twins = t.nar_files.where("id % 3 = 0").withColumns({"id": F.col("id") + 10**6, "compression": F.lit("none"), "total_chunks": F.lit(2).cast("bigint")})
    whole = t.nar_files.where("total_chunks <= 0")
    return chunks.superseded(whole.unionByName(twins), now()).select("id")


@query("q_bytes_stored", "SELECT DISTINCT hash FROM nar_files WHERE id % 2 = 0 AND bytes_stored_at IS NOT NULL")
def _(t):
    return recovery.bytes_stored(t.nar_files.where("id % 2 = 0").select("hash", "query").distinct(), t.nar_files).select("hash")
