"""Queries: snapshot mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import chunks, dml, integrity, recovery
from .bindings import NOW
from .registry import query

now = lambda: F.expr(f"TIMESTAMP_NTZ '{NOW}'")
T = f"TIMESTAMP '{NOW}'"


@query("q_insert_ignore", "SELECT hash, file_size FROM (SELECT hash, file_size FROM nar_files WHERE id % 2 = 0 UNION ALL SELECT hash, CAST(-1 AS BIGINT) FROM nar_files WHERE id % 2 = 1 AND id % 3 = 0) x")
def _(t):
    old = t.nar_files.where("id % 2 = 0").select("hash", "file_size")
    new = t.nar_files.where("id % 3 = 0").select("hash", F.lit(-1).cast("bigint").alias("file_size"))
    return dml.insert_or_ignore(old, new.unionByName(new), ["hash"])


@query("q_upsert_set", "SELECT hash, CASE WHEN id % 3 = 0 THEN file_size + 1 ELSE file_size END AS file_size, CASE WHEN id % 2 = 1 THEN 0 ELSE total_chunks END AS total_chunks FROM nar_files WHERE id % 2 = 0 OR id % 3 = 0")
def _(t):
    old = t.nar_files.where("id % 2 = 0").select("hash", "file_size", "total_chunks")
    new = t.nar_files.where("id % 3 = 0").select("hash", (F.col("file_size") + 1).alias("file_size"), F.lit(0).cast("bigint").alias("total_chunks"))
    return dml.upsert(old, new, ["hash"], ["file_size"])


@query("q_stub_fill", "SELECT id, CASE WHEN coalesce(url, '') = '' AND id % 2 = 0 THEN 'nar/new.nar' ELSE url END AS url, CASE WHEN coalesce(url, '') = '' AND id % 2 = 0 THEN NULL ELSE compression END AS compression FROM narinfos")
def _(t):
    new = t.narinfos.where("id % 2 = 0").select("hash", "id", F.lit("nar/new.nar").alias("url"), values.empty_to_null(F.lit("")).alias("compression"))
    return dml.fill_stubs(t.narinfos.select("id", "hash", "url", "compression"), new, ["hash"]).select("id", "url", "compression")


@query("q_touch", f"SELECT id, CASE WHEN last_accessed_at IS NULL OR last_accessed_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 300 SECOND THEN TIMESTAMP '1998-01-01 00:00:00' ELSE last_accessed_at END AS last_accessed_at FROM narinfos")
def _(t):
    at = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return t.narinfos.select("id", values.touched(F.col("last_accessed_at"), at).alias("last_accessed_at"))


@query("q_update_where", "SELECT id, CASE WHEN compression = 'xz' THEN CAST(NULL AS TIMESTAMP) ELSE bytes_stored_at END AS bytes_stored_at FROM nar_files")
def _(t):
    return dml.update_where(t.nar_files, F.col("compression") == "xz", {"bytes_stored_at": F.lit(None)}).select("id", "bytes_stored_at")


@query("q_update_from", """SELECT id, CASE WHEN hit THEN 'none' ELSE compression END AS compression FROM (SELECT id, compression,
  compression = 'xz' AND id IN (SELECT narinfo_id FROM narinfo_nar_files l JOIN nar_files f ON f.id = l.nar_file_id WHERE f.compression = 'none')
  AND id NOT IN (SELECT narinfo_id FROM narinfo_nar_files l JOIN nar_files f ON f.id = l.nar_file_id WHERE f.compression = 'xz') AS hit FROM narinfos) x""")
def _(t):
    of = t.narinfo_nar_files.join(t.nar_files.select(F.col("id").alias("nar_file_id"), F.col("compression").alias("has")), "nar_file_id").select(F.col("narinfo_id").alias("id"), "has")
    keys = t.narinfos.where("compression = 'xz'").join(of.where("has = 'none'"), "id", "left_semi").join(of.where("has = 'xz'"), "id", "left_anti")
    return dml.update_matching(t.narinfos, keys, ["id"], {"compression": F.lit("none")}).select("id", "compression")


@query("q_delete_where", "SELECT id FROM nar_files WHERE NOT (total_chunks > 1)")
def _(t):
    return dml.delete_where(t.nar_files, F.col("total_chunks") > 1).select("id")


@query("q_delete_semi", "SELECT nar_file_id, chunk_index FROM nar_file_chunks WHERE nar_file_id NOT IN (SELECT id FROM doc_files WHERE total_chunks > 5)")
def _(t):
    return dml.delete_matching(t.nar_file_chunks, t.doc_files.where("total_chunks > 5").select(F.col("id").alias("nar_file_id")), ["nar_file_id"]).select("nar_file_id", "chunk_index")


@query("q_cascade_delete", """SELECT 'links' AS kind, count(*) AS n FROM narinfo_nar_files WHERE narinfo_id % 7 <> 0
  UNION ALL SELECT 'narinfos', count(*) FROM narinfos WHERE id % 7 <> 0 UNION ALL SELECT 'refs', count(*) FROM refs WHERE src % 7 <> 0""")
def _(t):
    tables = {"narinfos": t.narinfos, "links": t.narinfo_nar_files, "refs": t.refs}
    out = dml.cascade(tables, {"links": [("narinfo_id", "narinfos")], "refs": [("src", "narinfos")]}, "narinfos", t.narinfos.where("id % 7 = 0"))
    one = lambda k: out[k].agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("links").unionByName(one("narinfos")).unionByName(one("refs"))


@query("q_replace_children", "SELECT conv_id, turn, key_name FROM build_traces WHERE conv_id % 2 = 1 UNION ALL SELECT conv_id, turn, 'replaced' FROM build_traces WHERE conv_id % 2 = 0 AND turn = 0")
def _(t):
    old = t.build_traces.select("conv_id", "turn", "key_name")
    new = old.where("conv_id % 2 = 0 and turn = 0").withColumn("key_name", F.lit("replaced"))
    return dml.replace_children(old, new, "conv_id")


@query("q_relink", """SELECT narinfo_id, nar_file_id FROM narinfo_nar_files UNION
  SELECT i.id, f.id FROM narinfos i JOIN nar_files f ON f.hash = regexp_extract(i.url, '^nar/([^.]+)\\.', 1) WHERE i.url IS NOT NULL""")
def _(t):
    named = t.narinfos.where("url is not null").select(F.col("id").alias("narinfo_id"), F.regexp_extract("url", r"^nar/([^.]+)\.", 1).alias("hash"))
    pairs = named.join(t.nar_files.select("hash", F.col("id").alias("nar_file_id")), "hash").select("narinfo_id", "nar_file_id")
    return dml.relink(t.narinfo_nar_files.select("narinfo_id", "nar_file_id"), pairs)


@query("q_relink_plan", """SELECT i.id AS narinfo_id, min_by(f.id, (CASE WHEN f.compression = i.compression THEN 0 ELSE 1 END) * 100000000 + f.id) AS nar_file_id
  FROM narinfos i JOIN nar_files f ON f.hash = regexp_extract(i.url, '^nar/([^.]+)\\.', 1)
  WHERE i.url IS NOT NULL AND i.id NOT IN (SELECT narinfo_id FROM narinfo_nar_files) GROUP BY i.id""")
def _(t):
    return integrity.relink_plan(t.narinfos, t.narinfo_nar_files, t.nar_files, F.regexp_extract("url", r"^nar/([^.]+)\.", 1), F.col("compression"))


@query("q_split_links", "SELECT DISTINCT l_orderkey AS narinfo_id, l_partkey AS nar_file_id FROM lineitem")
def _(t):
    return t.lineitem.select(F.col("l_orderkey").alias("narinfo_id"), F.col("l_partkey").alias("nar_file_id")).distinct()


@query("q_merge_links", "SELECT i.id, f.hash, f.file_size FROM narinfos i JOIN narinfo_nar_files l ON l.narinfo_id = i.id JOIN nar_files f ON f.id = l.nar_file_id")
def _(t):
    links = t.narinfo_nar_files.select(F.col("narinfo_id").alias("id"), "nar_file_id")
    files = t.nar_files.select(F.col("id").alias("nar_file_id"), F.col("hash"), "file_size")
    return t.narinfos.select("id").join(links, "id").join(files, "nar_file_id").select("id", "hash", "file_size")


@query("q_check_and_fix", """SELECT i.id, CASE WHEN compression = 'none' THEN NULL WHEN s.size IS NOT NULL THEN s.size ELSE i.file_size END AS file_size
  FROM narinfos i LEFT JOIN (SELECT o_orderkey AS id, CAST(round(o_totalprice * 91) AS BIGINT) AS size FROM orders WHERE o_orderkey % 3 = 0) s ON s.id = i.id""")
def _(t):
    actual = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 91).cast("bigint").alias("size"), F.lit("h").alias("file_hash"))
    return recovery.check_and_fix(t.narinfos.withColumn("file_hash", F.lit(None).cast("string")), actual).select("id", "file_size")


@query("q_record_batch", "SELECT r.nar_file_id, r.chunk_index, r.hash FROM rows r")
def _(t):
    known, links = chunks.recorded(t.rows.select("nar_file_id", "chunk_index", "hash", "size"), t.chunks.where("id % 2 = 0"), t.nar_file_chunks.limit(0))
    return links.join(known.select(F.col("id").alias("chunk_id"), "hash"), "chunk_id").select("nar_file_id", "chunk_index", "hash")


@query("q_purge_chunked", """SELECT 'chunks' AS kind, count(*) AS n FROM chunks WHERE id IN (SELECT chunk_id FROM nar_file_chunks WHERE nar_file_id % 4 <> 1) OR id NOT IN (SELECT chunk_id FROM nar_file_chunks)
  UNION ALL SELECT 'links', count(*) FROM nar_file_chunks WHERE nar_file_id % 4 <> 1""")
def _(t):
    _, links, left = chunks.purged(t.doc_files, t.nar_file_chunks, t.chunks, t.doc_files.where("id % 4 = 1"))
    return left.agg(F.lit("chunks").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(links.agg(F.lit("links").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("q_stale_links", "SELECT nar_file_id, chunk_index FROM nar_file_chunks WHERE nar_file_id IN (SELECT id FROM doc_files WHERE total_chunks <= 0)")
def _(t):
    return chunks.stale_links(t.nar_file_chunks, t.doc_files.withColumn("chunking_started_at", F.lit(None).cast("timestamp_ntz"))).select("nar_file_id", "chunk_index")


@query("q_mark_complete", "SELECT d.id, coalesce(x.n, d.total_chunks) AS total_chunks FROM doc_files d LEFT JOIN (SELECT nar_file_id, count(*) AS n FROM rows WHERE nar_file_id % 2 = 0 GROUP BY 1) x ON x.nar_file_id = d.id")
def _(t):
    done = t.rows.where("nar_file_id % 2 = 0").groupBy(F.col("nar_file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    files = t.doc_files.withColumns({"file_size": F.lit(0).cast("bigint"), "chunking_started_at": F.lit(None).cast("timestamp_ntz")})
    return chunks.completed(files, done).select("id", "total_chunks")


