"""Queries: hashes, URLs, records and JSON as functions of columns, the schema's tools, and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import hashing, urls, values
from ..operators import dml, recovery
from ..operators.relational import Query
from ..sources import storage
from .bindings import NOW
from .registry import query

now = lambda: F.expr(f"TIMESTAMP_NTZ '{NOW}'")
T = f"TIMESTAMP '{NOW}'"
_pick = lambda by, *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (F.col(by) % len(xs) + 1).cast("int"))


@query("q_only", "SELECT id, hash FROM narinfos WHERE hash = md5('i7')")
def _(t):
    return Query(t.narinfos.select("id", "hash")).where(F.col("hash") == F.md5(F.lit("i7"))).single()


@query("q_not_in", "SELECT id, hash FROM nar_files WHERE compression NOT IN ('xz', 'zstd') AND hash NOT IN (SELECT hash FROM nar_files WHERE total_chunks > 0)")
def _(t):
    chunked = t.nar_files.where("total_chunks > 0").select("hash")
    return Query(t.nar_files).where(~F.col("compression").isin("xz", "zstd")).all().join(chunked, "hash", "left_anti").select("id", "hash")


@query("q_url_parse_strict", """SELECT id, CASE WHEN id % 4 < 2 THEN sha256(hash) END AS hash, CASE id % 4 WHEN 0 THEN 'xz' WHEN 1 THEN 'none' END AS compression, CASE id % 4 WHEN 0 THEN 'a=1&b' WHEN 1 THEN '' END AS query FROM narinfos""")
def _(t):
    h = F.sha2("hash", 256)
    url = _pick("id", F.concat(F.lit("nar/"), h, F.lit(".nar.xz?a=1&b")), F.concat(F.lit("deep/er/"), h, F.lit(".nar")), F.concat(F.lit("nar/"), "hash", F.lit(".nar")), F.concat(h, F.lit(".nar.rar")))
    return t.narinfos.select("id", urls.parse_url(url).alias("p")).select("id", "p.hash", "p.compression", "p.query")


@query("q_upstream_url", """SELECT id, CASE id % 4 WHEN 0 THEN sha256(hash) WHEN 3 THEN NULL ELSE sha256('f' || hash) END AS hash, CASE id % 4 WHEN 0 THEN 'xz' WHEN 1 THEN 'zstd' WHEN 2 THEN 'none' END AS compression,
   CASE id % 4 WHEN 1 THEN 'nar/' || hash || '.nar.zst' WHEN 2 THEN 'castore/' || hash END AS opaque_path, CASE id % 4 WHEN 2 THEN 'narsize=3' WHEN 3 THEN NULL ELSE '' END AS query FROM narinfos""")
def _(t):
    url = _pick("id", F.concat(F.lit("nar/"), F.sha2("hash", 256), F.lit(".nar.xz")), F.concat(F.lit("nar/"), "hash", F.lit(".nar.zst")), F.concat(F.lit("castore/"), "hash", F.lit("?narsize=3")), F.col("hash"))
    p = urls.parse_upstream_url(url, F.sha2(F.concat(F.lit("f"), "hash"), 256))
    return t.narinfos.select("id", p.alias("p")).select("id", "p.hash", "p.compression", "p.opaque_path", "p.query")


@query("q_join_url", "SELECT id, 'http://cache.example/' || hash || CASE id % 3 WHEN 0 THEN '?a=1&b=2' WHEN 1 THEN '?a=1' ELSE '' END AS url FROM narinfos")
def _(t):
    base_query, query_ = _pick("id", "a=1", "a=1", ""), _pick("id", "b=2", "", "")
    return t.narinfos.select("id", urls.joined(F.lit("http://cache.example/"), base_query, F.concat(F.lit("/"), "hash"), query_).alias("url"))


@query("q_reference_round_trip", "SELECT id, 'nar/' || hash AS opaque_path, CASE WHEN id % 2 = 0 THEN 'x=1?y' ELSE '' END AS query FROM narinfos")
def _(t):
    text = urls.reference(F.concat(F.lit("nar/"), "hash"), _pick("id", "x=1?y", ""))
    return t.narinfos.select("id", urls.reference_parts(text).alias("p")).select("id", "p.*")


@query("q_object_paths", """SELECT id, CASE WHEN regexp_matches(hash, '^[0-9a-df-np-sv-z]{32}$') THEN substr(hash, 1, 1) || '/' || substr(hash, 1, 2) || '/' || hash || '.narinfo' END AS info,
   substr(sha256(hash), 1, 1) || '/' || substr(sha256(hash), 1, 2) || '/' || sha256(hash) || '.nar' || CASE compression WHEN 'xz' THEN '.xz' WHEN 'zstd' THEN '.zst' ELSE '' END AS archive FROM narinfos""")
def _(t):
    return t.narinfos.select("id", hashing.info_path(F.col("hash")).alias("info"), hashing.archive_path(F.sha2("hash", 256), urls.extension_of(F.col("compression"))).alias("archive"))


@query("q_storage_keys", "SELECT id, '/store/' || hash || '-name' AS path, CASE WHEN id % 2 = 0 THEN coalesce(nar_hash, '') ELSE '' END AS key FROM narinfos")
def _(t):
    marked = F.when(F.col("id") % 2 == 0, F.concat(F.lit("sha256:"), F.col("nar_hash"))).otherwise(F.col("nar_hash"))
    return t.narinfos.select("id", hashing.store_path("/store", F.concat("hash", F.lit("-name"))).alias("path"), hashing.storage_key(marked).alias("key"))


@query("q_digests", "SELECT id, CASE id % 5 WHEN 4 THEN NULL ELSE sha256(hash) END AS digest, 52 AS digits FROM narinfos")
def _(t):
    """Digests in four encodings and in none, all to hexadecimal; base32 has 52 digits for 256 bits."""
    h = F.sha2("hash", 256)
    base32 = hashing.hex_to_base32(h)
    text = _pick("id", h, F.concat(F.lit("sha256:"), "b"), F.concat(F.lit("sha256-"), F.base64(F.unhex(h))), F.col("b"), "nothing")
    return t.narinfos.select("id", "hash", base32.alias("b")).select("id", text.alias("x"), "b").select("id", hashing.digest_to_hex(F.col("x")).alias("digest"), F.length("b").alias("digits"))


RANK = "CASE {} WHEN 'requested' THEN 1 WHEN 'staging' THEN 2 ELSE 3 END"


@query("q_staging_advanced", f"""SELECT hash, CASE WHEN {RANK.format("event")} > {RANK.format("status")} THEN event ELSE status END AS status
  FROM (SELECT hash, status, CASE CAST(substr(hash, 2) AS INTEGER) % 2 WHEN 0 THEN 'staging' ELSE 'requested' END AS event FROM staging_states) x""")
def _(t):
    event = F.when(F.substring("hash", 2, 20).cast("int") % 2 == 0, "staging").otherwise("requested")
    return t.staging_states.select("hash", recovery.staging_advanced(F.col("status"), event).alias("status"))


@query("q_retriable", "SELECT id, id % 4 IN (0, 1) AS again FROM narinfos")
def _(t):
    message = _pick("id", "read: connection reset by peer", "http2: server sent GOAWAY and closed", "404 not found", F.lit(None).cast("string"))
    return t.narinfos.select("id", values.retriable(message).alias("again"))


@query("q_trace_canonical", """SELECT conv_id, turn, '{"key":{"drvPath":"' || drv_path || '","outputName":"' || output_name || '"},"value":{"outPath":"' || out_path || '"}}' AS text FROM build_traces""")
def _(t):
    return t.build_traces.select("conv_id", "turn", values.canonical_trace(F.col("drv_path"), F.col("output_name"), F.col("out_path")).alias("text"))


@query("q_pin_array", """SELECT '["' || string_agg(hash, '","' ORDER BY hash) || '"]' AS pins FROM pinned""")
def _(t):
    return t.pinned.agg(F.to_json(F.sort_array(F.collect_list("hash"))).alias("pins"))


def _signed(t):
    return t.signatures.groupBy(F.col("narinfo_id").alias("id")).agg(F.sort_array(F.collect_list("signature")).alias("signatures"))


@query("q_trusted", "SELECT narinfo_id AS id, count(*) FILTER (WHERE starts_with(signature, 'key1:') OR starts_with(signature, 'here-1:')) > 0 AS trusted FROM signatures GROUP BY 1")
def _(t):
    return _signed(t).select("id", values.trusted(F.col("signatures"), ["key1", "here-1"]).alias("trusted"))


@query("q_signed_by", """SELECT narinfo_id AS id, string_agg(signature, ' ' ORDER BY signature) FILTER (WHERE NOT starts_with(signature, 'here-1:')) || ' here-1:new' AS signatures FROM signatures GROUP BY 1""")
def _(t):
    return _signed(t).select("id", F.array_join(values.signed_by(F.col("signatures"), F.lit("here-1:new")), " ").alias("signatures"))


@query("q_progress", "SELECT nar_file_id, count(*) * 100.0::DOUBLE / max(d.total_chunks) AS percent FROM rows r JOIN (SELECT id, total_chunks FROM doc_files WHERE total_chunks > 0) d ON d.id = r.nar_file_id GROUP BY 1 UNION ALL SELECT id, 0 FROM doc_files WHERE total_chunks = 0")
def _(t):
    done = t.rows.groupBy(F.col("nar_file_id").alias("id")).agg(F.count(F.lit(1)).alias("done"))
    return t.doc_files.join(done, "id", "left").select(F.col("id").alias("nar_file_id"), values.percent(values.or_zero(F.col("done")), F.col("total_chunks")).alias("percent"))


@query("q_cache_info", """SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 2 THEN '/store' END AS store_dir, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS want_mass_query, CASE WHEN n_nationkey % 4 < 2 THEN CAST(n_nationkey AS BIGINT) END AS priority FROM nation""")
def _(t):
    text = F.concat(F.lit("StoreDir: /store\nWantMassQuery: "), _pick("n_nationkey", "1", "0", "2", "1"), F.lit("\nPriority: "), F.col("n_nationkey").cast("string"), _pick("n_nationkey", "", "", "", "\nOther: x"))
    return t.nation.select("n_nationkey", values.cache_info(text).alias("c")).select("n_nationkey", "c.*")


@query("q_config_value", "SELECT value FROM config WHERE key = 'setting7'")
def _(t):
    return recovery.config_value(t.config, "setting7")


@query("q_config_set", "SELECT key, CASE WHEN id % 3 = 0 THEN 'set' ELSE value END AS value FROM config UNION ALL SELECT 'setting' || CAST(id + 100 AS VARCHAR), 'set' FROM config WHERE id % 3 = 0")
def _(t):
    some = t.config.where("id % 3 = 0")
    new = some.select("key").unionByName(some.select(F.concat(F.lit("setting"), (F.col("id") + 100).cast("string")).alias("key"))).withColumn("value", F.lit("set"))
    return dml.upsert(t.config.select("key", "value"), new, ["key"], ["value"])


@query("q_null_on_write", "SELECT id, nullif(url, '') AS url, CASE WHEN id % 3 = 0 THEN NULL ELSE file_size END AS file_size, coalesce(nar_size, 0) AS nar_size FROM narinfos")
def _(t):
    size = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("file_size"))
    return t.narinfos.select("id", values.empty_to_null(F.col("url")).alias("url"), values.zero_to_null(size).alias("file_size"), values.or_zero(F.col("nar_size")).alias("nar_size"))


@query("q_add_references", "SELECT src, dst FROM refs UNION SELECT id, id + 1 FROM narinfos WHERE id % 2 = 0")
def _(t):
    new = t.narinfos.where("id % 2 = 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return dml.insert_or_ignore(t.refs.distinct(), new.unionByName(new), ["src", "dst"])


@query("q_add_signatures", "SELECT narinfo_id, signature FROM signatures UNION SELECT id, 'extra:' || hash FROM narinfos UNION SELECT narinfo_id, signature FROM signatures")
def _(t):
    new = t.narinfos.select(F.col("id").alias("narinfo_id"), F.concat(F.lit("extra:"), "hash").alias("signature")).unionByName(t.signatures)
    return dml.insert_or_ignore(t.signatures.distinct(), new, ["narinfo_id", "signature"])


@query("q_stored_marker", f"SELECT hash, CASE WHEN id % 3 = 0 THEN 77 ELSE file_size END AS file_size, CASE WHEN id % 3 = 0 THEN {T} ELSE bytes_stored_at END AS bytes_stored_at, total_chunks FROM nar_files")
def _(t):
    key = ["hash", "compression", "query"]
    new = t.nar_files.where("id % 3 = 0").select(*key, F.lit(77).cast("bigint").alias("file_size"), now().alias("bytes_stored_at"), F.lit(0).cast("bigint").alias("total_chunks"))
    return dml.upsert(t.nar_files.select(*key, "file_size", "bytes_stored_at", "total_chunks"), new, key, ["file_size", "bytes_stored_at"]).select("hash", "file_size", "bytes_stored_at", "total_chunks")


@query("q_touch_upsert", f"SELECT hash, file_size, CASE WHEN id % 3 = 0 THEN {T} ELSE created_at END AS last_accessed_at FROM nar_files UNION ALL SELECT md5(hash), 5, {T} FROM nar_files WHERE id % 3 = 0")
def _(t):
    new = t.nar_files.where("id % 3 = 0").select("hash").unionByName(t.nar_files.where("id % 3 = 0").select(F.md5("hash").alias("hash"))).withColumns({"file_size": F.lit(5).cast("bigint"), "last_accessed_at": now()})
    return dml.upsert(t.nar_files.select("hash", "file_size", F.col("created_at").alias("last_accessed_at")), new, ["hash"], ["last_accessed_at"])


@query("q_rebuilt", "SELECT id, hash, coalesce(compression, 'none') AS compression, CAST(file_size AS VARCHAR) AS size_text, CAST(NULL AS BIGINT) AS added FROM nar_files")
def _(t):
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL("id bigint, hash string, compression string, size_text string, added bigint")
    return schema.rebuilt(t.nar_files, shape, {"size_text": F.col("file_size"), "compression": F.coalesce("compression", F.lit("none"))})


@query("q_copied_versions", f"SELECT CAST(CAST(n_nationkey AS VARCHAR) || '2024' AS BIGINT) AS version, true AS applied, {T} AS at FROM nation")
def _(t):
    texts = t.nation.select(F.concat(F.col("n_nationkey").cast("string"), F.lit("2024")).alias("version"))
    return texts.select(F.col("version").cast("bigint").alias("version"), F.lit(True).alias("applied"), now().alias("at"))


@query("q_pending", "SELECT n_nationkey AS version FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)")
def _(t):
    return schema.pending(t.nation.select(F.col("n_nationkey").alias("version")), t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("version")))


@query("q_schema_differences", """SELECT * FROM (VALUES ('last_accessed_at', 'timestamp_ntz', NULL), ('size', NULL, 'int'), ('total_chunks', 'bigint', 'string'), ('updated_at', 'timestamp_ntz', NULL)) x("column", declared, actual)""")
def _(t):
    actual = t.nar_files.withColumn("total_chunks", F.col("total_chunks").cast("string")).withColumn("size", F.lit(1)).schema
    return schema.differences(t._spark, schema.SCHEMAS["nar_files"], actual)


@query("q_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)])


@query("q_stored_archives", "SELECT hash, CASE id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'xz' ELSE 'zstd' END AS compression, file_size AS size FROM nar_files WHERE id % 5 < 3")
def _(t):
    return storage.archives(t.objects).select("hash", "compression", "size")


@query("q_stored_narinfos", "SELECT hash, file_size AS size FROM nar_files WHERE id % 5 = 3")
def _(t):
    return storage.narinfo_objects(t.objects).select("hash", "size")


@query("q_stored_chunks", "SELECT hash || CASE id % 5 WHEN 0 THEN '.nar' WHEN 1 THEN '.nar.xz' WHEN 2 THEN '.nar.zst' WHEN 3 THEN '.narinfo' ELSE '.part' END AS hash, file_size AS size FROM nar_files")
def _(t):
    return storage.chunk_objects(t.objects).select("hash", "size")


@query("q_narinfo_records", """SELECT i.id, hash, 'nar/' || hash || '.nar' AS url, nar_size, coalesce(deriver, '') AS deriver, coalesce((SELECT string_agg(signature, ',' ORDER BY signature) FROM signatures s WHERE s.narinfo_id = i.id), '') AS sigs, 2 AS n_references FROM narinfos i""")
def _(t):
    rows = t.narinfos.join(_signed(t), "id", "left")
    lines = F.concat_ws("\n", F.concat(F.lit("StorePath: "), "hash"), F.concat(F.lit("URL: nar/"), "hash", F.lit(".nar")), F.concat(F.lit("NarSize: "), F.col("nar_size").cast("string")), F.concat(F.lit("Deriver: "), F.coalesce("deriver", F.lit(""))), F.lit("References: a-b c-d"), F.array_join(F.transform(F.coalesce("signatures", F.array().cast("array<string>")), lambda s: F.concat(F.lit("Sig: "), s)), "\n"))
    out = storage.parsed_narinfos(rows.select(F.col("id").cast("string").alias("hash"), lines.alias("text")))
    return out.select(F.col("hash").cast("bigint").alias("id"), F.col("store_path").alias("hash"), "url", "nar_size", "deriver", F.array_join("signatures", ",").alias("sigs"), F.size("references").alias("n_references"))
