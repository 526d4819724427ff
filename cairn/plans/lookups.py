"""Queries: the builder's surface, lookups, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, urls, values
from ..operators import dml, graph, integrity, recovery, relational
from ..operators.relational import Query
from .bindings import NOW
from .registry import query

now = lambda: F.expr(f"TIMESTAMP_NTZ '{NOW}'")
T = f"TIMESTAMP '{NOW}'"


@query("q_scan_project", "SELECT id, hash, compression, file_size FROM nar_files")
def _(t):
    return Query(t.nar_files).select("id", "hash", "compression", "file_size")


@query("q_filter_state", "SELECT id, url, nar_size FROM narinfos WHERE url IS NOT NULL AND nar_size BETWEEN 1000000 AND 30000000 AND NOT (compression = 'xz' OR compression = 'zstd')")
def _(t):
    c = F.col
    return Query(t.narinfos).where(c("url").isNotNull(), (c("nar_size") >= 1000000) & (c("nar_size") <= 30000000), ~((c("compression") == "xz") | (c("compression") == "zstd"))).select("id", "url", "nar_size")


@query("q_point_lookup", "SELECT id, hash, url FROM narinfos WHERE hash = md5('i5')")
def _(t):
    return Query(t.narinfos).where(F.col("hash") == F.md5(F.lit("i5"))).select("id", "hash", "url")


@query("q_composite_lookup", "SELECT id, file_size FROM nar_files WHERE hash IN (md5('f7'), md5('f8'), md5('f9')) AND compression <> 'none' AND query = ''")
def _(t):
    return Query(t.nar_files).where(F.col("hash").isin(*[F.md5(F.lit(x)) for x in ("f7", "f8", "f9")]), F.col("compression") != "none", F.col("query") == "").select("id", "file_size")


@query("q_membership", "SELECT id, hash FROM chunks WHERE hash IN (SELECT hash FROM rows WHERE chunk_index = 0)")
def _(t):
    return t.chunks.join(t.rows.where("chunk_index = 0").select("hash"), "hash", "left_semi").select("id", "hash")


@query("q_order_limit_offset", "SELECT id, file_size FROM nar_files ORDER BY file_size DESC, id LIMIT 20 OFFSET 5")
def _(t):
    return Query(t.nar_files).order(F.desc("file_size"), "id").offset(5).limit(20).select("id", "file_size")


@query("q_distinct", "SELECT DISTINCT compression, total_chunks FROM nar_files")
def _(t):
    return Query(t.nar_files.select("compression", "total_chunks")).unique().all()


@query("q_order_by_edge_count", "SELECT f.id, count(l.narinfo_id) AS n FROM nar_files f LEFT JOIN narinfo_nar_files l ON l.nar_file_id = f.id GROUP BY f.id ORDER BY n DESC, f.id LIMIT 25")
def _(t):
    n = t.narinfo_nar_files.groupBy(F.col("nar_file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    top = Query(t.nar_files).order_by_count(t.narinfo_nar_files, "nar_file_id", descending=True).limit(25).select("id")
    return top.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("q_order_by_edge_term", "SELECT i.id FROM narinfos i LEFT JOIN (SELECT narinfo_id, min(nar_file_id) AS t FROM narinfo_nar_files GROUP BY 1) l ON l.narinfo_id = i.id ORDER BY l.t ASC NULLS FIRST, i.id")
def _(t):
    return Query(t.narinfos).order_by_child(t.narinfo_nar_files, "narinfo_id", "nar_file_id").select("id")


@query("q_first", "SELECT id, hash FROM narinfos WHERE compression = 'xz' ORDER BY id LIMIT 1")
def _(t):
    return Query(t.narinfos).where(F.col("compression") == "xz").first().select("id", "hash")


@query("q_ids", "SELECT id FROM narinfos WHERE nar_hash IS NULL")
def _(t):
    return Query(t.narinfos).where(F.col("nar_hash").isNull()).ids()


@query("q_count", "SELECT count(*) AS count FROM narinfos WHERE compression = 'none'")
def _(t):
    return Query(t.narinfos).where(F.col("compression") == "none").count()


@query("q_exist", "SELECT count(*) > 0 AS exist FROM nar_files WHERE total_chunks > 0")
def _(t):
    return Query(t.nar_files).where(F.col("total_chunks") > 0).exist()


@query("q_group_aggregate", "SELECT compression, count(*) AS n, max(file_size) AS most, min(file_size) AS least, CAST(sum(file_size) AS BIGINT) AS total, round(avg(CAST(file_size AS DOUBLE)), 4) AS mean FROM nar_files GROUP BY compression")
def _(t):
    s = F.col("file_size")
    return Query(t.nar_files).group_by("compression").agg(F.count(F.lit(1)).alias("n"), F.max(s).alias("most"), F.min(s).alias("least"), F.sum(s).alias("total"), F.round(F.avg(s.cast("double")), 4).alias("mean"))


@query("q_eager_children", "SELECT i.id, coalesce(l.files, '') AS files FROM narinfos i LEFT JOIN (SELECT narinfo_id, string_agg(CAST(nar_file_id AS VARCHAR), ',' ORDER BY id) AS files FROM narinfo_nar_files GROUP BY 1) l ON l.narinfo_id = i.id")
def _(t):
    out = Query(t.narinfos).with_children(t.narinfo_nar_files, "narinfo_id", "files", "id")
    return out.select("id", F.array_join(F.transform("files", lambda x: x["nar_file_id"].cast("string")), ",").alias("files"))


@query("q_eager_parent", "SELECT r.nar_file_id, r.chunk_index, c.hash FROM nar_file_chunks r JOIN chunks c ON c.id = r.chunk_id")
def _(t):
    return Query(t.nar_file_chunks, "id").with_parent(t.chunks, "chunk_id", "chunk_").select("nar_file_id", "chunk_index", F.col("chunk_hash").alias("hash"))


@query("q_edge_traversal", "SELECT l.narinfo_id, l.nar_file_id FROM narinfo_nar_files l JOIN narinfos i ON i.id = l.narinfo_id WHERE i.compression = 'zstd' AND i.nar_size > 40000000")
def _(t):
    big = Query(t.narinfos).where(F.col("compression") == "zstd", F.col("nar_size") > 40000000)
    return big.traverse(t.narinfo_nar_files, "narinfo_id").select("narinfo_id", "nar_file_id")


@query("q_semi_linked", "SELECT id FROM narinfos WHERE id IN (SELECT narinfo_id FROM narinfo_nar_files WHERE nar_file_id % 50 = 3)")
def _(t):
    return Query(t.narinfos).has(t.narinfo_nar_files, "narinfo_id", F.col("nar_file_id") % 50 == 3).ids()


@query("q_anti_unlinked", "SELECT id, hash FROM narinfos WHERE id NOT IN (SELECT narinfo_id FROM narinfo_nar_files)")
def _(t):
    return integrity.unlinked_infos(t.narinfos, t.narinfo_nar_files).select("id", "hash")


@query("q_two_hop_semi", "SELECT id FROM narinfos WHERE id IN (SELECT l.narinfo_id FROM narinfo_nar_files l JOIN nar_files f ON f.id = l.nar_file_id WHERE f.hash = md5('f9') AND f.query = '')")
def _(t):
    files = t.nar_files.where((F.col("hash") == F.md5(F.lit("f9"))) & (F.col("query") == "")).select(F.col("id").alias("nar_file_id"))
    return Query(t.narinfos).has(t.narinfo_nar_files.join(files, "nar_file_id", "left_semi"), "narinfo_id").ids()


@query(
    "q_compression_desync",
    """SELECT id FROM narinfos WHERE compression = 'xz' AND id IN (SELECT narinfo_id FROM narinfo_nar_files)
       AND id NOT IN (SELECT l.narinfo_id FROM narinfo_nar_files l JOIN nar_files f ON f.id = l.nar_file_id WHERE f.compression = 'xz')""",
)
def _(t):
    xz = t.narinfo_nar_files.join(t.nar_files.where("compression = 'xz'").select(F.col("id").alias("nar_file_id")), "nar_file_id", "left_semi")
    return Query(t.narinfos).where(F.col("compression") == "xz").has(t.narinfo_nar_files, "narinfo_id").has_not(xz, "narinfo_id").ids()


@query("q_or_join", "SELECT id FROM nar_files WHERE id IN (SELECT nar_file_id FROM narinfo_nar_files WHERE narinfo_id % 500 = 1) OR id IN (SELECT id FROM nar_files WHERE hash IN (md5('f3'), md5('f4')))")
def _(t):
    linked = t.narinfo_nar_files.where("narinfo_id % 500 = 1").select(F.col("nar_file_id").alias("id"))
    named = t.nar_files.where((F.col("hash") == F.md5(F.lit("f3"))) | (F.col("hash") == F.md5(F.lit("f4")))).select("id")
    return dml.or_join(t.nar_files, "id", linked, named).select("id")


@query("q_prefix_join", "SELECT f.id AS nar_file_id, i.id AS narinfo_id FROM nar_files f JOIN narinfos i ON starts_with(i.url, 'nar/' || f.hash || '.') AND i.url <> 'nar/' || f.hash || '.nar'")
def _(t):
    named = t.narinfos.where("url is not null").select(F.col("id").alias("narinfo_id"), "url", F.regexp_extract("url", r"^nar/([^.]+)\.", 1).alias("hash"))
    return t.nar_files.select(F.col("id").alias("nar_file_id"), "hash").join(named, "hash").where(F.col("url") != F.concat(F.lit("nar/"), "hash", F.lit(".nar"))).select("nar_file_id", "narinfo_id")


@query("q_link_or_url_hash", """
SELECT f.id, coalesce(l.h, u.h) AS nar_hash FROM nar_files f
LEFT JOIN (SELECT k.nar_file_id, min_by(i.nar_hash, k.id) AS h FROM narinfo_nar_files k JOIN narinfos i ON i.id = k.narinfo_id WHERE i.nar_hash IS NOT NULL GROUP BY 1) l ON l.nar_file_id = f.id
LEFT JOIN (SELECT regexp_extract(url, '^nar/([^.]+)\\.', 1) AS hash, min_by(nar_hash, id) AS h FROM narinfos WHERE coalesce(nar_hash, '') <> '' AND url IS NOT NULL GROUP BY 1) u ON u.hash = f.hash""".replace("\\\\", "\\"))
def _(t):
    linked = t.narinfo_nar_files.join(t.narinfos.where("nar_hash is not null").select(F.col("id").alias("narinfo_id"), "nar_hash"), "narinfo_id")
    by_link = linked.groupBy(F.col("nar_file_id").alias("id")).agg(F.min_by("nar_hash", "id").alias("l"))
    by_url = t.narinfos.where("coalesce(nar_hash, '') <> '' and url is not null").groupBy(F.regexp_extract("url", r"^nar/([^.]+)\.", 1).alias("hash")).agg(F.min_by("nar_hash", "id").alias("u"))
    return t.nar_files.select("id", "hash").join(by_link, "id", "left").join(by_url, "hash", "left").select("id", F.coalesce("l", "u").alias("nar_hash"))


FALLBACK = """SELECT w.hash, w.query, w.compression, min_by(f.id, (CASE WHEN f.compression = {first} THEN 0 ELSE 1 END) * 100000000 + f.id) AS id
FROM (SELECT DISTINCT f.hash, f.query, c.compression FROM nar_files f CROSS JOIN (VALUES ('xz'), ('none'), ('zstd')) c(compression) WHERE f.id % 3 = 0) w
JOIN nar_files f ON f.hash = w.hash AND f.query = w.query AND f.compression IN (w.compression, 'none') GROUP BY 1, 2, 3"""


def _wanted(t):
    some = t.nar_files.where("id % 3 = 0").select("hash", "query").distinct()
    return some.withColumn("compression", F.explode(F.array(F.lit("xz"), F.lit("none"), F.lit("zstd"))))


@query("q_fallback_lookup", FALLBACK.format(first="w.compression"))
def _(t):
    return recovery.fallback_lookup(_wanted(t), t.nar_files)


@query("q_fallback_plain_first", FALLBACK.format(first="'none'"))
def _(t):
    return recovery.fallback_lookup(_wanted(t), t.nar_files, plain_first=True)


@query("q_stored_variant", "SELECT hash, query, min_by(compression, CASE compression WHEN 'zstd' THEN 1 WHEN 'xz' THEN 2 ELSE 3 END) AS compression FROM nar_files WHERE compression IN ('zstd', 'xz', 'none') GROUP BY 1, 2")
def _(t):
    return recovery.stored_variant(t.nar_files.select("hash", "query").distinct(), t.nar_files)


@query("q_deletion_plan", "SELECT DISTINCT s.hash, s.query, s.compression FROM nar_files s JOIN narinfos i ON i.url = 'nar/' || s.hash || '.nar' WHERE i.id % 5 = 0 AND s.compression IN ('zstd', 'xz', 'none')")
def _(t):
    plain = t.narinfos.where("id % 5 = 0").select(urls.parsed(F.col("url")).alias("p")).where("p.compression = 'none'")
    return recovery.deletion_plan(plain.select("p.hash", "p.query", "p.compression").distinct(), t.nar_files)


@query("q_self_semi", f"SELECT id FROM nar_files WHERE total_chunks <= 0 AND compression <> 'none' AND created_at < {T} - INTERVAL 1 DAY AND file_size % 7 IN (SELECT file_size % 7 FROM nar_files WHERE total_chunks > 0)")
def _(t):
    from ..operators import chunks

    keyed = t.nar_files.withColumn("hash", (F.col("file_size") % 7).cast("string"))  # a key that whole and chunked rows share
    return chunks.superseded(keyed, now()).select("id")


@query("q_null_counts", "SELECT count(*) FILTER (WHERE url IS NULL) AS unmigrated, count(*) FILTER (WHERE url IS NOT NULL) AS migrated FROM narinfos")
def _(t):
    return t.narinfos.agg(F.count_if(F.col("url").isNull()).alias("unmigrated"), F.count_if(F.col("url").isNotNull()).alias("migrated"))


@query("q_text_predicates", "SELECT id FROM narinfos WHERE contains(url, 'ab') AND (starts_with(hash, 'a') OR ends_with(url, '.xz')) AND (lower(system) = '1-urgent' OR contains(lower(system), 'low'))")
def _(t):
    c = F.col
    return Query(t.narinfos).where(c("url").contains("ab"), c("hash").startswith("a") | c("url").endswith(".xz"), relational.equal_fold(c("system"), "1-Urgent") | relational.contains_fold(c("system"), "LOW")).ids()


@query("q_keyset_page", "SELECT id, hash FROM nar_files WHERE id > 40 ORDER BY id LIMIT 30")
def _(t):
    return relational.page_after(t.nar_files, 40, 30).select("id", "hash")


@query("q_cursor", "SELECT CASE WHEN count(*) < 100 THEN 0 ELSE max(id) END AS cursor FROM (SELECT id FROM nar_files WHERE id > 10 AND total_chunks = 0 ORDER BY id LIMIT 100) x")
def _(t):
    return relational.next_cursor(relational.page_after(t.nar_files.where("total_chunks = 0"), 10, 100), 100)


@query("q_preferred", "SELECT system, min(id) AS id FROM narinfos GROUP BY system")
def _(t):
    return relational.preferred(t.narinfos.select("system", "id"), ["system"], F.lit(0))


@query("q_set_difference", "SELECT id FROM doc_files EXCEPT SELECT id FROM stored")
def _(t):
    return t.doc_files.select("id").subtract(t.stored)


@query("q_set_intersection", "SELECT id FROM doc_files WHERE total_chunks > 4 INTERSECT SELECT id FROM stored")
def _(t):
    return t.doc_files.where("total_chunks > 4").select("id").intersect(t.stored)


@query("q_reverified", "SELECT id FROM doc_files WHERE total_chunks = 0 AND id NOT IN (SELECT id FROM stored) AND id % 3 <> 0")
def _(t):
    suspects = integrity.missing_files(t.doc_files, t.stored, ["id"])
    return integrity.reverified(suspects, t.doc_files.where("id % 3 <> 0"), ["id"]).select("id")


@query("q_newly_orphaned", "SELECT id FROM nar_files WHERE id NOT IN (SELECT nar_file_id FROM narinfo_nar_files WHERE narinfo_id % 40 = 0) EXCEPT SELECT id FROM nar_files WHERE id NOT IN (SELECT nar_file_id FROM narinfo_nar_files)")
def _(t):
    before = integrity.unlinked_files(t.nar_files, t.narinfo_nar_files).select("id")
    after = integrity.unlinked_files(t.nar_files, t.narinfo_nar_files.where("narinfo_id % 40 = 0")).select("id")
    return after.join(before, "id", "left_anti")


@query("q_url_parse", """SELECT id, regexp_extract(url, '^nar/([0-9a-f]+)\\.nar', 1) AS hash,
  CASE WHEN ends_with(url, '.xz') THEN 'xz' WHEN ends_with(url, '.zst') THEN 'zstd' ELSE 'none' END AS compression FROM narinfos WHERE coalesce(url, '') <> ''""")
def _(t):
    return t.narinfos.select("id", urls.parsed(F.col("url")).alias("p")).where("p is not null").select("id", "p.hash", "p.compression")


@query("q_url_normalize", """SELECT id, sha256(hash) AS hash, 'nar/' || sha256(hash) || '.nar' || CASE compression WHEN 'none' THEN '' WHEN 'xz' THEN '.xz' ELSE '.zst' END AS url
  FROM (SELECT id, hash, compression FROM narinfos) x""")
def _(t):
    prefixed = F.concat(F.translate("hash", "e", "f"), F.lit("-"), F.sha2("hash", 256))
    hash = urls.normalised_hash(prefixed)
    return t.narinfos.select("id", hash.alias("hash"), urls.written(hash, F.col("compression"), F.lit("")).alias("url"))


@query("q_page_urls", """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
  regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages""")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/?#]*)", 1).alias("host"), F.regexp_extract(u, "://[^/]*([^?#]*)", 1).alias("path"), F.regexp_extract(u, r"\?([^#]*)", 1).alias("query"))


@query("q_query_encode", """SELECT page_id, string_agg(p, '&' ORDER BY p) AS query FROM (
  SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages WHERE contains(url, '?')) x GROUP BY page_id""")
def _(t):
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    return t.pages.where(F.contains("url", F.lit("?"))).select("page_id", urls.query_encoded(q).alias("query"))


@query("q_size_literal", """SELECT p_partkey, CASE WHEN p_size % 6 = 5 THEN NULL
  ELSE CAST(p_size AS BIGINT) * CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE 1099511627776 END END AS bytes FROM part""")
def _(t):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("B", "k", "M", "g", "T", "")]), F.col("p_size") % 6 + 1)
    return t.part.select("p_partkey", values.size_literal(F.concat(F.col("p_size").cast("string"), unit)).cast("bigint").alias("bytes"))


@query("q_ext_compression", "SELECT id, CASE compression WHEN 'bzip2' THEN 'bz2' WHEN 'zstd' THEN 'zst' WHEN 'none' THEN '' ELSE compression END AS extension, compression FROM nar_files")
def _(t):
    extension = urls.extension_of(F.col("compression"))
    return t.nar_files.select("id", extension.alias("extension"), urls.compression_of(extension).alias("compression"))


@query("q_hash_checks", """SELECT id, regexp_matches(hash, '^[0-9a-df-np-sv-z]{32}$') AS info, regexp_matches(sha256(hash), '^[0-9a-f]{64}$') AS archive,
  substr(hash, 1, 1) || '/' || substr(hash, 1, 2) || '/' || hash AS path FROM narinfos""")
def _(t):
    return t.narinfos.select("id", hashing.valid_info_hash(F.col("hash")).alias("info"), hashing.valid_archive_hash(F.sha2("hash", 256)).alias("archive"), hashing.sharded_path(F.col("hash")).alias("path"))


@query("q_closure_hash", "SELECT id, CASE WHEN length(r) >= 32 THEN substr(r, 1, 32) END AS h FROM (SELECT id, CASE WHEN id % 3 = 0 THEN hash || '-name-1.0' ELSE substr(hash, 1, 20) END AS r FROM narinfos) x")
def _(t):
    ref = F.when(F.col("id") % 3 == 0, F.concat("hash", F.lit("-name-1.0"))).otherwise(F.substring("hash", 1, 20))
    return t.narinfos.select("id", hashing.closure_hash(ref).alias("h"))


@query("q_accept_encoding", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'zstd' WHEN 1 THEN 'br' WHEN 2 THEN 'gzip' ELSE 'none' END AS encoding FROM part""")
def _(t):
    header = F.element_at(F.array(F.lit("gzip, zstd;q=0.5"), F.lit("gzip;q=1.0 , br"), F.lit("deflate,gzip"), F.lit("identity")), F.col("p_size") % 4 + 1)
    return t.part.select("p_partkey", urls.accepted_encoding(header).alias("encoding"))


@query("q_backoff", "SELECT p_partkey, least(CAST(30 AS DOUBLE), 0.5 * pow(2.0, p_size % 12)) AS wait FROM part")
def _(t):
    return t.part.select("p_partkey", values.backoff(F.col("p_size") % 12 + 1, 0.5, 30.0).alias("wait"))


@query("q_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("q_json_trace", "SELECT drv_path, output_name, out_path, key_name FROM build_traces")
def _(t):
    key, value = F.struct(F.col("drv_path").alias("drvPath"), F.col("output_name").alias("outputName")), F.struct(F.col("out_path").alias("outPath"), F.array(F.struct(F.col("key_name").alias("keyName"), F.lit("s").alias("sig"))).alias("signatures"))
    text = t.build_traces.select(F.to_json(F.struct(key.alias("key"), value.alias("value"))).alias("j"))
    schema = "key struct<drvPath:string,outputName:string>, value struct<outPath:string,signatures:array<struct<keyName:string,sig:string>>>"
    j = text.select(F.from_json("j", schema).alias("j")).where("j.key.drvPath is not null and j.value.outPath is not null")
    return j.select(F.col("j.key.drvPath").alias("drv_path"), F.col("j.key.outputName").alias("output_name"), F.col("j.value.outPath").alias("out_path"), F.col("j.value.signatures")[0]["keyName"].alias("key_name"))


@query("q_fingerprint", "SELECT id, '1;' || hash || ';' || coalesce(nar_hash || ';', '') || coalesce(CAST(nar_size AS VARCHAR) || ';', '') || deriver || ',' || system AS fingerprint FROM (SELECT * REPLACE (CASE WHEN deriver < system THEN deriver ELSE system END AS deriver, CASE WHEN deriver < system THEN system ELSE deriver END AS system) FROM narinfos) x")
def _(t):
    return t.narinfos.select("id", values.fingerprint(F.col("hash"), F.col("nar_hash"), F.col("nar_size"), F.array("deriver", "system")).alias("fingerprint"))


@query("q_narinfo_text", "SELECT id, hash AS store_path, CASE WHEN url IS NULL THEN NULL ELSE url END AS url, nar_size FROM narinfos")
def _(t):
    text = F.concat_ws("\n", F.concat(F.lit("StorePath: "), "hash"), F.concat(F.lit("URL: "), "url"), F.concat(F.lit("NarSize: "), F.col("nar_size").cast("string")))
    m = values.text_fields(text)
    return t.narinfos.select("id", F.try_element_at(m, F.lit("StorePath")).alias("store_path"), F.try_element_at(m, F.lit("URL")).alias("url"), F.try_element_at(m, F.lit("NarSize")).cast("bigint").alias("nar_size"))


@query("q_existence", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'absent' WHEN p_size % 5 = 1 THEN 'present' ELSE 'unknown' END AS existence FROM part")
def _(t):
    status = F.element_at(F.array(F.lit(404), F.lit(200), F.lit(500), F.lit(None).cast("int"), F.lit(403)), F.col("p_size") % 5 + 1)
    return t.part.select("p_partkey", values.existence(status).alias("existence"))


@query("q_closure", "WITH RECURSIVE reach(node) AS (SELECT id FROM pinned UNION SELECT r.dst FROM refs r JOIN reach c ON r.src = c.node) SELECT node FROM reach")
def _(t):
    return graph.closure(t.pinned.select(F.col("id").alias("node")), t.refs)


@query("q_referrers", "SELECT src, dst FROM refs WHERE dst IN (SELECT id FROM pinned)")
def _(t):
    return graph.referrers(t.refs, t.pinned.select(F.col("id").alias("node")))


@query("q_pin", "SELECT hash FROM pinned UNION SELECT hash FROM narinfos WHERE id BETWEEN 10 AND 20")
def _(t):
    return graph.pin(t.pinned.select("hash"), t.narinfos.where("id between 10 and 20").select("hash").union(t.pinned.sparkSession.range(1).select(F.lit("nowhere"))), t.narinfos)


@query("q_unpin", "SELECT id, hash FROM pinned WHERE id % 100 <> 0")
def _(t):
    return graph.unpin(t.pinned, t.pinned.where("id % 100 = 0"))
