"""The integrity checks with their repair plans, and what is left of interrupted chunking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import parsed, written
from ..functions.values import due, older_than
from ..shared import staged
from . import dml

#: Ids and labels of the checks, in the report's order.
CHECKS = [
    ("1a", "narinfos without a file"), ("1b", "files without a narinfo"), ("1c", "files missing from storage"), ("1d", "stored files without a row"),
    ("1e", "chunks without a file"), ("1f", "files with chunk issues"), ("1g", "size mismatch"), ("1h", "stored chunks without a row"),
    ("1i", "corrupt chunks"), ("1j", "assembled hash mismatch"), ("11", "recoverable residue"), ("12", "reclaimable residue"),
]


def unlinked_infos(narinfos: DataFrame, links: DataFrame) -> DataFrame:
    return narinfos.join(links.select(F.col("narinfo_id").alias("id")), "id", "left_anti")


def unlinked_files(nar_files: DataFrame, links: DataFrame) -> DataFrame:
    return nar_files.join(links.select(F.col("nar_file_id").alias("id")), "id", "left_anti")


def missing_files(nar_files: DataFrame, stored: DataFrame, key: list[str], now: Column | None = None, verified_since: int = 0) -> DataFrame:
    """Whole files (no chunks) that storage lacks; those verified lately are passed over."""
    whole = nar_files.where(F.col("total_chunks") <= 0)
    if now is not None:
        whole = whole.where(due(F.col("verified_at"), now, verified_since))
    return whole.join(stored.select(*key), key, "left_anti")


def unknown_files(stored: DataFrame, nar_files: DataFrame, key: list[str]) -> DataFrame:
    return stored.join(nar_files.select(*key), key, "left_anti")


def unlinked_chunks(chunks: DataFrame, chunk_links: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Chunks without a file; of a candidate set only, if given (id)."""
    if candidates is not None:
        chunks = chunks.join(candidates.select("id"), "id", "left_semi")
    return chunks.join(chunk_links.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def incomplete(nar_files: DataFrame, chunk_links: DataFrame) -> DataFrame:
    """Chunked files whose number of links is not total_chunks."""
    n = chunk_links.groupBy(F.col("nar_file_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return nar_files.where("total_chunks > 0").join(n, "id", "left").where(F.coalesce("links", F.lit(0)) != F.col("total_chunks")).drop("links")


def chunk_issues(nar_files: DataFrame, chunk_links: DataFrame, chunks: DataFrame, stored_chunks: DataFrame) -> DataFrame:
    """id of chunked files with too few or many links, or a chunk that storage lacks. stored_chunks: hash."""
    lost = chunks.join(stored_chunks.select("hash"), "hash", "left_anti").select(F.col("id").alias("chunk_id"))
    touched = chunk_links.join(lost, "chunk_id", "left_semi").select(F.col("nar_file_id").alias("id"))
    chunked = nar_files.where("total_chunks > 0")
    return incomplete(nar_files, chunk_links).select("id").unionByName(chunked.join(touched, "id", "left_semi").select("id")).distinct()


def size_mismatches(nar_files: DataFrame, links: DataFrame, narinfos: DataFrame) -> DataFrame:
    """Chunked files of another size than any of their narinfos says (null says nothing), once each."""
    says = links.join(narinfos.where("nar_size is not null").select(F.col("id").alias("narinfo_id"), "nar_size"), "narinfo_id")
    of_file = nar_files.where("total_chunks > 0").select(F.col("id").alias("nar_file_id"), "file_size")
    bad = says.join(of_file, "nar_file_id").where("nar_size <> file_size").select(F.col("nar_file_id").alias("id"))
    return nar_files.join(bad, "id", "left_semi")


def corrupt(nar_files: DataFrame, chunk_links: DataFrame, chunks: DataFrame, contents: DataFrame, flagged: DataFrame) -> DataFrame:
    """id of files with a stored chunk whose content is not what its hash says, but for those flagged before (id).
    contents: hash, content."""
    bad = contents.where(F.sha2("content", 256) != F.col("hash")).select("hash")
    ids = chunks.join(bad, "hash", "left_semi").select(F.col("id").alias("chunk_id"))
    files = chunk_links.join(ids, "chunk_id", "left_semi").select(F.col("nar_file_id").alias("id")).distinct()
    return nar_files.select("id").join(files, "id", "left_semi").join(flagged.select("id"), "id", "left_anti")


def assembled_mismatches(assembled: DataFrame, links: DataFrame, narinfos: DataFrame, flagged: DataFrame) -> DataFrame:
    """id of assembled files (id, sha256) whose hash is not that of their narinfo with the lowest link id. No narinfo, or one
    without a hash, is no mismatch; files flagged before are passed over."""
    first = links.groupBy(F.col("nar_file_id").alias("id")).agg(F.min_by("narinfo_id", "id").alias("narinfo_id"))
    expected = first.join(narinfos.select(F.col("id").alias("narinfo_id"), "nar_hash"), "narinfo_id").select("id", "nar_hash")
    wrong = assembled.join(expected, "id").where((F.coalesce("nar_hash", F.lit("")) != "") & (F.col("nar_hash") != F.col("sha256")))
    return wrong.select("id").join(flagged.select("id"), "id", "left_anti")


def reverified(suspects: DataFrame, again: DataFrame, key: list[str]) -> DataFrame:
    """Second phase: of the first phase's suspects those that a fresh look still finds."""
    return suspects.join(again.select(*key), key, "left_semi")


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """position, check, label and n for each check, with a total at the end."""
    rows = [found[k].agg(F.lit(i).alias("position"), F.lit(k).alias("check"), F.lit(label).alias("label"), F.count(F.lit(1)).alias("n")) for i, (k, label) in enumerate(CHECKS) if k in found]
    each = reduce(DataFrame.unionByName, rows)
    return each.unionByName(each.agg(F.lit(len(CHECKS)).alias("position"), F.lit("all").alias("check"), F.lit("total").alias("label"), F.sum("n").alias("n")))


def residue_decision(resolvable: Column, inconsistent: Column, flagged_at: Column, started_at: Column, now: Column, grace: int = 86400, lock_ttl: int = 3600) -> Column:
    """skip, normalise, normalise+clear, clear, set, reclaim or wait, for one file left behind by chunking."""
    running = F.coalesce(~(older_than(started_at, now, lock_ttl) | (started_at == now - F.make_dt_interval(secs=F.lit(lock_ttl)))), F.lit(False))
    ripe = older_than(flagged_at, now, grace) | (flagged_at == now - F.make_dt_interval(secs=F.lit(grace)))
    return (
        F.when(running, "skip")
        .when(resolvable & inconsistent & flagged_at.isNotNull(), "normalise+clear")
        .when(resolvable & inconsistent, "normalise")
        .when(resolvable & flagged_at.isNotNull(), "clear")
        .when(resolvable, "none")
        .when(flagged_at.isNull(), "set")
        .when(ripe, "reclaim")
        .otherwise("wait")
    )


def resolvable(nar_files: DataFrame, links: DataFrame, narinfos: DataFrame) -> DataFrame:
    """id, resolvable, inconsistent of each file. A narinfo linked to it with a hash that is not null decides; an empty hash
    there resolves nothing. Without one, a narinfo whose URL names the file does. Inconsistent: some narinfo, linked or naming it, has a URL other
    than the uncompressed one."""
    linked = links.join(narinfos.select(F.col("id").alias("narinfo_id"), "nar_hash", "url"), "narinfo_id")
    by_link = linked.where("nar_hash is not null").groupBy(F.col("nar_file_id").alias("id")).agg(F.min_by("nar_hash", "id").alias("linked_hash"))
    named = narinfos.where("url is not null").select(F.regexp_extract("url", r"^nar/([^.]+)\.", 1).alias("hash"), F.col("url").alias("named_url"), F.col("nar_hash").alias("named_hash"), F.col("id").alias("named_id"))
    by_url = named.where("coalesce(named_hash, '') <> '' and hash <> ''").groupBy("hash").agg(F.min_by("named_hash", "named_id").alias("url_hash"))
    plain = F.concat(F.lit("nar/"), F.col("hash"), F.lit(".nar"))
    urls = linked.select(F.col("nar_file_id").alias("id"), "url").unionByName(nar_files.select("id", "hash").join(named, "hash").select("id", F.col("named_url").alias("url")))
    off = urls.where("url is not null").join(nar_files.select("id", "hash"), "id").where(F.col("url") != plain).select("id").distinct().withColumn("off", F.lit(True))
    out = nar_files.select("id", "hash").join(by_link, "id", "left").join(by_url, "hash", "left").join(off, "id", "left")
    return out.select("id", (F.coalesce(F.col("linked_hash"), F.col("url_hash"), F.lit("")) != "").alias("resolvable"), F.coalesce("off", F.lit(False)).alias("inconsistent"))


def residue(nar_files: DataFrame, links: DataFrame, narinfos: DataFrame, now: Column, **limits) -> DataFrame:
    """id and decision of every chunked file."""
    chunked = nar_files.where("total_chunks > 0").select("id", "dechunk_residue_flagged_at", "chunking_started_at")
    known = chunked.join(resolvable(nar_files, links, narinfos), "id")
    return known.select("id", residue_decision(F.col("resolvable"), F.col("inconsistent"), F.col("dechunk_residue_flagged_at"), F.col("chunking_started_at"), now, **limits).alias("decision"))


def residue_report(decisions: DataFrame) -> DataFrame:
    """issue and n: reclaim goes before normalise; setting and clearing flags is no issue."""
    issue = F.when(F.col("decision") == "reclaim", "reclaimable").when(F.col("decision").startswith("normalise"), "recoverable")
    return decisions.withColumn("issue", issue).where("issue is not null").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def residue_applied(nar_files: DataFrame, narinfos: DataFrame, links: DataFrame, decisions: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The next snapshots: reclaimed files gone, flags set and cleared, linked narinfos' URLs written uncompressed."""
    known = nar_files.join(decisions, "id", "left")
    flag = F.when(F.col("decision") == "set", now).when(F.col("decision").isin("clear", "normalise+clear"), None).otherwise(F.col("dechunk_residue_flagged_at"))
    files = known.withColumn("dechunk_residue_flagged_at", flag).where("coalesce(decision, '') <> 'reclaim'").select(*nar_files.columns)
    plain = decisions.where(F.col("decision").startswith("normalise")).join(nar_files.select("id", "hash"), "id").select(F.col("id").alias("nar_file_id"), F.concat(F.lit("nar/"), "hash", F.lit(".nar")).alias("plain"))
    by_info = links.join(plain, "nar_file_id").groupBy(F.col("narinfo_id").alias("id")).agg(F.min_by("plain", "nar_file_id").alias("plain"))
    infos = narinfos.join(by_info, "id", "left").withColumn("url", F.coalesce("plain", "url")).withColumn("compression", F.when(F.col("plain").isNotNull(), "none").otherwise(F.col("compression"))).select(*narinfos.columns)
    return {"nar_files": files, "narinfos": infos}


def relink_plan(narinfos: DataFrame, links: DataFrame, nar_files: DataFrame, hash: Column, compression: Column) -> DataFrame:
    """narinfo_id, nar_file_id for narinfos without a file: a file of the same hash, of the same compression before others."""
    loose = unlinked_infos(narinfos, links).select(F.col("id").alias("narinfo_id"), hash.alias("hash"), compression.alias("wanted"))
    pairs = loose.join(nar_files.select("hash", F.col("compression").alias("has"), F.col("id").alias("nar_file_id")), "hash")
    return pairs.groupBy("narinfo_id").agg(F.min_by("nar_file_id", F.struct(F.when(F.col("wanted") == F.col("has"), 0).otherwise(1), "nar_file_id")).alias("nar_file_id"))


def desync(narinfos: DataFrame, links: DataFrame, nar_files: DataFrame) -> DataFrame:
    """id, hash and query (of the archive) of narinfos that say xz, are linked but to no xz file, whose URL names no xz file, and one of
    whose files is the one that the URL names: what can be served uncompressed."""
    has = nar_files.select(F.col("id").alias("nar_file_id"), F.col("hash").alias("_hash"), F.col("query").alias("_query"), F.col("compression").alias("_has"))
    linked = links.select("narinfo_id", "nar_file_id").join(has, "nar_file_id")
    wrong = narinfos.where("compression = 'xz' and coalesce(url, '') <> ''").select(F.col("id").alias("narinfo_id"), parsed(F.col("url")).alias("p")).where("p is not null")
    wrong = wrong.join(linked.where("_has = 'xz'").select("narinfo_id"), "narinfo_id", "left_anti")
    backed = wrong.select("narinfo_id", F.col("p.hash").alias("_hash"), F.col("p.query").alias("_query")).join(linked.select("narinfo_id", "_hash", "_query"), ["narinfo_id", "_hash", "_query"], "left_semi")
    named_xz = has.where("_has = 'xz'").select("_hash", "_query")
    return backed.join(named_xz, ["_hash", "_query"], "left_anti").select(F.col("narinfo_id").alias("id"), F.col("_hash").alias("hash"), F.col("_query").alias("query"))


def desync_repaired(narinfos: DataFrame, links: DataFrame, nar_files: DataFrame) -> DataFrame:
    """narinfos with those of desync() written uncompressed: URL and compression; file hash and size are not known any more."""
    fixes = desync(narinfos, links, nar_files).select("id", written(F.col("hash"), F.lit("none"), F.col("query")).alias("_url"))
    hit = narinfos.join(fixes, "id", "left")
    values = {"url": F.col("_url"), "compression": F.lit("none"), "file_hash": F.lit(None), "file_size": F.lit(None)}
    return dml.update_where(hit, F.col("_url").isNotNull(), {c: v for c, v in values.items() if c in narinfos.columns}).select(*narinfos.columns)


#: What goes with a file.
OF_FILE = {"narinfo_nar_files": [("nar_file_id", "nar_files")], "nar_file_chunks": [("nar_file_id", "nar_files")]}


def _without_files(t: dict[str, DataFrame], lost: DataFrame) -> dict[str, DataFrame]:
    """Files (id) go with their links, then the narinfos that only they backed, then chunks that only they had."""
    out = dml.cascade(t, OF_FILE, "nar_files", lost.select("id").distinct())
    touched = t["narinfo_nar_files"].join(lost.select(F.col("id").alias("nar_file_id")), "nar_file_id", "left_semi").select(F.col("narinfo_id").alias("id")).distinct()
    loose = touched.join(out["narinfo_nar_files"].select(F.col("narinfo_id").alias("id")), "id", "left_anti")
    out["narinfos"] = dml.delete_matching(t["narinfos"], loose, ["id"])
    had = t["nar_file_chunks"].join(lost.select(F.col("id").alias("nar_file_id")), "nar_file_id", "left_semi").select(F.col("chunk_id").alias("id")).distinct()
    out["chunks"] = dml.delete_matching(t["chunks"], unlinked_chunks(t["chunks"], out["nar_file_chunks"], had).select("id"), ["id"])
    return out


def repaired(tables: dict[str, DataFrame], found: dict[str, DataFrame], file_key: list[str]) -> dict[str, DataFrame]:
    """The twelve repair steps in order, each on what the one before left, and each only for what the checks found (by check: id,
    or hash of stored chunks) and still holds: a narinfos without a file are relinked where one fits and go otherwise; b files
    without a narinfo; c files missing from storage, with the narinfos that this leaves bare; d stored files without a row; e
    chunks without a file; f files with chunk issues; f2 of another size; f3 with corrupt chunks; f4 with another hash; g stored
    chunks without a row; e2 chunks that these steps left without a file; and narinfos that say xz where nothing is.

    tables: narinfos, nar_files, narinfo_nar_files, chunks, nar_file_chunks, stored, stored_chunks. Written to the shared folder
    after a to c and after f4, as the plan would grow with the steps."""

    def kept(t: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
        return t | {n: staged(t[n], n) for n in names}

    t = dict(tables)
    suspects = t["narinfos"].join(found["1a"].select("id"), "id", "left_semi")
    pairs = relink_plan(suspects, t["narinfo_nar_files"], t["nar_files"], F.regexp_extract("url", r"^nar/([^.]+)\.", 1), F.col("compression"))
    t["narinfo_nar_files"] = staged(dml.relink(t["narinfo_nar_files"].select("narinfo_id", "nar_file_id"), pairs), "links")
    t["narinfos"] = dml.delete_matching(t["narinfos"], unlinked_infos(suspects, t["narinfo_nar_files"]).select("id"), ["id"])
    bare = unlinked_files(t["nar_files"], t["narinfo_nar_files"]).join(found["1b"].select("id"), "id", "left_semi").select("id")
    t = dml.cascade(t, OF_FILE, "nar_files", staged(bare, "bare"))
    lost = missing_files(t["nar_files"], t["stored"], file_key).join(found["1c"].select("id"), "id", "left_semi").select("id")
    chunks = t["chunks"]
    t = kept(_without_files(t, staged(lost, "lost")) | {"chunks": chunks}, "narinfos", "nar_files", "narinfo_nar_files", "nar_file_chunks")
    t["stored"] = dml.delete_matching(t["stored"], unknown_files(t["stored"].join(found["1d"].select(*file_key), file_key, "left_semi"), t["nar_files"], file_key).select(*file_key), file_key)
    t["chunks"] = dml.delete_matching(t["chunks"], unlinked_chunks(t["chunks"], t["nar_file_chunks"], found["1e"]).select("id"), ["id"])
    still = {
        "1f": lambda: chunk_issues(t["nar_files"], t["nar_file_chunks"], t["chunks"], t["stored_chunks"]),
        "1g": lambda: size_mismatches(t["nar_files"], t["narinfo_nar_files"], t["narinfos"]),
        "1i": lambda: t["nar_files"], "1j": lambda: t["nar_files"],
    }
    for check, again in still.items():
        lost = again().select("id").join(found[check].select("id"), "id", "left_semi")
        t = kept(_without_files(t, staged(lost, "lost")), "narinfos", "nar_files", "narinfo_nar_files", "nar_file_chunks", "chunks")
    loose = t["stored_chunks"].join(found["1h"].select("hash"), "hash", "left_semi").join(t["chunks"].select("hash"), "hash", "left_anti")
    t["stored_chunks"] = dml.delete_matching(t["stored_chunks"], loose.select("hash"), ["hash"])
    t["chunks"] = dml.delete_matching(t["chunks"], unlinked_chunks(t["chunks"], t["nar_file_chunks"]).select("id"), ["id"])
    t["narinfos"] = desync_repaired(t["narinfos"], t["narinfo_nar_files"], t["nar_files"])
    return t
