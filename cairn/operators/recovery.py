"""States of files, recovery of interrupted work, garbage, staging, upstreams and small state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.values import older_than
from . import dml


def servability(stored: Column, total_chunks: Column, started_at: Column, locked: Column) -> tuple[Column, Column]:
    """(servable, finished): a whole file, chunks, or chunking under way; the last is not finished."""
    finished = F.coalesce(stored, F.lit(False)) | F.coalesce(total_chunks > 0, F.lit(False))
    return finished | (started_at.isNotNull() & F.coalesce(locked, F.lit(False))), finished


def chunking_state(total_chunks: Column, started_at: Column, locked: Column) -> Column:
    return F.when(total_chunks > 0, "complete").when(started_at.isNotNull() & F.coalesce(locked, F.lit(False)), "in_progress").when(started_at.isNotNull(), "orphan").otherwise("placeholder")


def recovery_candidates(files: DataFrame, now: Column, cutoff: int, cursor: int = 0, batch: int | None = 100) -> DataFrame:
    """Files without chunks behind the cursor whose chunking began before the cutoff, or never began and that were made
    before it; batch null means all of them."""
    before = older_than(F.col("chunking_started_at"), now, cutoff) | (F.col("chunking_started_at").isNull() & older_than(F.col("created_at"), now, cutoff))
    out = files.where((F.col("total_chunks") == 0) & before & (F.col("id") > cursor)).orderBy("id")
    return out if batch is None else out.limit(batch)


def recovery_class(stored: Column, links: Column, locked: Column) -> Column:
    return F.when(F.coalesce(locked, F.lit(False)), "busy").when(F.coalesce(stored, F.lit(False)), "rechunk").when(F.coalesce(links, F.lit(0)) > 0, "partial").otherwise("backingless")


def probed(files: DataFrame, links: DataFrame, probes: DataFrame) -> DataFrame:
    """nar_file_id and decision of files without backing: delete without a narinfo, or if each of its narinfos is absent
    from every healthy upstream, one at least; an unknown answer keeps it. probes: narinfo_id, status (a row for each healthy
    upstream)."""
    return decided(files, links, probes.groupBy("narinfo_id").agg((F.count_if(F.coalesce("status", F.lit("unknown")) != "absent") == 0).alias("gone")))


def absent(assets: DataFrame, upstreams: DataFrame, hits: DataFrame) -> DataFrame:
    """narinfo_id and gone, as decided() reads them, of narinfos that ask every upstream of their class, without a row for each
    narinfo and upstream. assets: narinfo_id, class; upstreams: class, answers (null: no); hits: narinfo_id of what an upstream
    that answers has. A class without upstreams gives no row."""
    heard = upstreams.groupBy("class").agg(F.every(F.coalesce("answers", F.lit(False))).alias("_heard"))
    there = hits.select("narinfo_id").distinct().withColumn("_there", F.lit(True))
    asked = assets.join(heard, "class").groupBy("narinfo_id").agg(F.every("_heard").alias("_heard"))
    return asked.join(there, "narinfo_id", "left").select("narinfo_id", (F.col("_heard") & F.col("_there").isNull()).alias("gone"))


def decided(files: DataFrame, links: DataFrame, absent: DataFrame) -> DataFrame:
    """nar_file_id and decision as probed() has them, of narinfos (narinfo_id, gone) that were asked for."""
    told = links.select("nar_file_id", "narinfo_id").where("narinfo_id is not null").join(absent, "narinfo_id", "left")
    of = told.groupBy("nar_file_id").agg(F.count_if(~F.coalesce("gone", F.lit(False))).alias("_left"))
    known = files.select(F.col("id").alias("nar_file_id")).distinct().join(of, "nar_file_id", "left")
    return known.select("nar_file_id", F.when(F.col("_left").isNull(), "delete_linkless").when(F.col("_left") == 0, "delete_absent").otherwise("keep").alias("decision"))


def narinfo_purge(links: DataFrame, ids: DataFrame) -> DataFrame:
    """nar_file_id of files that only the narinfos to be purged (id) link to."""
    marked = links.join(ids.select(F.col("id").alias("narinfo_id"), F.lit(1).alias("hit")), "narinfo_id", "left")
    return marked.groupBy("nar_file_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("gone")).where("n = gone").select("nar_file_id")


def staging_garbage(states: DataFrame, now: Column, retention: int, orphan_age: int) -> DataFrame:
    """hash, status of staging rows past their time: the last change strictly older than the limit of the status."""
    last = F.coalesce("updated_at", "created_at")
    old = F.when(F.col("status") == "complete", older_than(last, now, retention)).otherwise(older_than(last, now, orphan_age))
    return states.where(old).select("hash", "status")


def staging_advanced(state: Column, event: Column) -> Column:
    """Requested, staging, complete: never backwards."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in ("requested", "staging", "complete")]), c)
    return F.when(state.isNull() | (rank(event) > rank(state)), event).otherwise(state)


def check_and_fix(narinfos: DataFrame, actual: DataFrame) -> DataFrame:
    """narinfos with file_size and file_hash set right. actual: id, size, file_hash. Uncompressed files have neither."""
    known = narinfos.join(actual.select("id", F.col("size").alias("_size"), F.col("file_hash").alias("_hash")), "id", "left")
    none, hit = F.col("compression") == "none", F.col("_size").isNotNull()
    size = F.when(none, None).when(hit, F.col("_size")).otherwise(F.col("file_size"))
    digest = F.when(none, None).when(hit, F.coalesce(F.nullif("file_hash", F.lit("")), "_hash")).otherwise(F.col("file_hash"))
    return known.withColumn("file_size", size).withColumn("file_hash", digest).select(*narinfos.columns)


def served_compression(compression: Column, mode: str, chunked: Column) -> Column:
    """What a narinfo's URL says when served: chunked files, and in eager mode all, are uncompressed."""
    return F.when(F.lit(mode == "eager") | F.coalesce(chunked, F.lit(False)), "none").otherwise(compression)


def miss_decision(stored: Column, local_job: Column, remote_job: Column, recheck: Column, recorded: Column) -> Column:
    return F.when(stored, "hit").when(local_job, "attach_local").when(remote_job, "attach_remote").when(recheck, "hit_after_recheck").when(recorded, "pull_nar").otherwise("miss")


def readable(narinfos: DataFrame, references: DataFrame, signatures: DataFrame) -> DataFrame:
    """narinfos with a URL, with their references and signatures as sorted arrays."""
    refs = references.groupBy(F.col("narinfo_id").alias("id")).agg(F.sort_array(F.collect_set("reference")).alias("references"))
    sigs = signatures.groupBy(F.col("narinfo_id").alias("id")).agg(F.sort_array(F.collect_set("signature")).alias("signatures"))
    out = narinfos.where("coalesce(url, '') <> ''").join(refs, "id", "left").join(sigs, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("references", "signatures")})


def bytes_stored(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The wanted (hash, query) whose bytes some row says are stored, in any compression."""
    return wanted.join(files.where("bytes_stored_at is not null").select("hash", "query"), ["hash", "query"], "left_semi")


def safe_delete(narinfos: DataFrame, links: DataFrame, nar_files: DataFrame, files: DataFrame, verified: DataFrame) -> dict[str, DataFrame]:
    """The snapshots after deleting files (id) whose verified narinfos (id) are gone upstream: their links go, then verified
    narinfos that have no other link, then the files that nothing links to any more."""
    gone = links.join(files.select(F.col("id").alias("nar_file_id")), "nar_file_id", "left_semi").join(verified.select(F.col("id").alias("narinfo_id")), "narinfo_id", "left_semi")
    kept = links.join(gone.select("narinfo_id", "nar_file_id"), ["narinfo_id", "nar_file_id"], "left_anti")
    loose = gone.select(F.col("narinfo_id").alias("id")).distinct().join(kept.select(F.col("narinfo_id").alias("id")), "id", "left_anti")
    bare = files.select("id").join(kept.select(F.col("nar_file_id").alias("id")), "id", "left_anti")
    return {"narinfos": dml.delete_matching(narinfos, loose, ["id"]), "narinfo_nar_files": kept, "nar_files": dml.delete_matching(nar_files, bare, ["id"])}


def put_archives(put: DataFrame, stored: DataFrame, nar_files: DataFrame, narinfos: DataFrame, links: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The snapshots after archives were put, again or for the first time. put: hash, compression, query, size. What storage has
    already keeps its size; the record is made or gets size and marker; narinfos whose URL names the archive are linked."""
    key = ["hash", "compression", "query"]
    sized = put.join(stored.select(*key, F.col("size").alias("_has")), key, "left").withColumn("file_size", F.coalesce("_has", "size"))
    new = sized.select(F.xxhash64(*key).alias("id"), *key, "file_size", F.lit(0).cast("long").alias("total_chunks"), now.alias("bytes_stored_at"), now.alias("created_at"))
    files = dml.upsert(nar_files, new, key, ["file_size", "bytes_stored_at"])
    named = narinfos.where("coalesce(url, '') <> ''").select(F.col("id").alias("narinfo_id"), urls.parsed(F.col("url")).alias("p")).select("narinfo_id", "p.hash", "p.compression", "p.query")
    pairs = named.join(files.join(put.select(*key), key, "left_semi").select(F.col("id").alias("nar_file_id"), *key), key).select("narinfo_id", "nar_file_id")
    return {"nar_files": files, "narinfo_nar_files": dml.relink(links, pairs)}


def deleted_archives(nar_files: DataFrame, removed: DataFrame) -> DataFrame:
    """nar_files after stored objects (hash, query, compression) were removed: their markers are cleared."""
    return dml.update_matching(nar_files, removed, ["hash", "query", "compression"], {"bytes_stored_at": F.lit(None)})


def served(wanted: DataFrame, stored: DataFrame, nar_files: DataFrame, now: Column) -> DataFrame:
    """nar_files after requests for uncompressed archives (hash, query) were served from what storage has: the row asked for is
    touched, else the row of the variant served, else that row is made."""
    chosen = stored_variant(wanted, stored).withColumnRenamed("compression", "_served")
    exact = nar_files.where("compression = 'none'").select("hash", "query", F.lit("none").alias("_exact"))
    target = chosen.join(exact, ["hash", "query"], "left").select("hash", "query", F.coalesce("_exact", "_served").alias("compression"))
    sizes = stored.select("hash", "query", "compression", F.col("size").alias("file_size"))
    new = target.join(sizes, ["hash", "query", "compression"], "left").select(F.xxhash64("hash", "compression", "query").alias("id"), "hash", "query", "compression", F.coalesce("file_size", F.lit(0)).cast("long").alias("file_size"), F.lit(0).cast("long").alias("total_chunks"), now.alias("last_accessed_at"), now.alias("created_at"))
    return dml.upsert(nar_files, new, ["hash", "query", "compression"], ["last_accessed_at"])


def migrated_narinfos(stored: DataFrame, narinfos: DataFrame, references: DataFrame, signatures: DataFrame) -> dict[str, DataFrame]:
    """The snapshots after stored narinfos (parsed: hash, url ... references, signatures) moved into the tables, and the outcome
    of each (hash, outcome): invalid without a store path or URL, already with a URL in the table, else migrated. Stubs are filled
    whole, references and signatures added once each. Everything but invalid texts may then leave storage."""
    known = narinfos.where("coalesce(url, '') <> ''").select("hash", F.lit(True).alias("_known"))
    invalid = (F.coalesce("store_path", F.lit("")) == "") | (F.coalesce("url", F.lit("")) == "")
    marked = stored.join(known, "hash", "left").withColumn("outcome", F.when(invalid, "invalid").when(F.col("_known"), "already").otherwise("migrated"))
    fresh = marked.where("outcome = 'migrated'")
    columns = [c for c in narinfos.columns if c in stored.columns and c != "hash"]
    nulled = [F.when(F.col(c) == F.lit(0 if c == "file_size" else ""), None).otherwise(F.col(c)).alias(c) if c in ("file_size", "deriver", "file_hash", "ca", "system") else F.col(c) for c in columns]
    infos = dml.fill_stubs(narinfos, fresh.select(F.xxhash64("hash").alias("id"), "hash", *nulled), ["hash"])
    ids = infos.select(F.col("id").alias("narinfo_id"), "hash")
    children = lambda c, name: fresh.select("hash", F.explode(c).alias(name)).join(ids, "hash").select("narinfo_id", name)
    return {
        "narinfos": infos, "outcomes": marked.select("hash", "outcome"),
        "narinfo_references": dml.insert_or_ignore(references, children("references", "reference"), ["narinfo_id", "reference"]),
        "narinfo_signatures": dml.insert_or_ignore(signatures, children("signatures", "signature"), ["narinfo_id", "signature"]),
    }


def fallback_lookup(wanted: DataFrame, files: DataFrame, plain_first: bool = False) -> DataFrame:
    """For each wanted (hash, query, compression) the file to serve: of that compression, else uncompressed; the other way round
    where chunking is on."""
    pairs = wanted.join(files.select("id", "hash", "query", F.col("compression").alias("has")), ["hash", "query"])
    same, plain = F.col("has") == F.col("compression"), F.col("has") == "none"
    rank = F.when(plain if plain_first else same, 0).when(same if plain_first else plain, 1)
    ranked = pairs.withColumn("_rank", rank).where("_rank is not null")
    return ranked.groupBy("hash", "query", "compression").agg(F.min_by("id", F.struct("_rank", "id")).alias("id"))


def stored_variant(wanted: DataFrame, stored: DataFrame, variants=("zstd", "xz", "none")) -> DataFrame:
    """For each uncompressed request (hash, query) the variant that storage has, by preference."""
    rank = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("compression"))
    pairs = wanted.select("hash", "query").join(stored.select("hash", "query", "compression"), ["hash", "query"]).withColumn("_rank", rank).where("_rank > 0")
    return pairs.groupBy("hash", "query").agg(F.min_by("compression", "_rank").alias("compression"))


def deletion_plan(wanted: DataFrame, stored: DataFrame, variants=("zstd", "xz")) -> DataFrame:
    """hash, query, compression of every stored object that deleting the wanted rows removes; an uncompressed one takes its
    variants with it. Rows with nothing to remove are not found."""
    tries = F.when(F.col("compression") == "none", F.array(*[F.lit(v) for v in (*variants, "none")])).otherwise(F.array("compression"))
    return wanted.select("hash", "query", F.explode(tries).alias("compression")).distinct().join(stored.select("hash", "query", "compression"), ["hash", "query", "compression"], "left_semi")


def config_drift(stored: DataFrame, current: dict[str, str]) -> DataFrame:
    """state and message: what stored settings (key, value) say against the current ones. No setting stored: "new"."""
    got = stored.groupBy().agg(F.map_from_entries(F.collect_list(F.when(F.col("key").isin(*current), F.struct("key", "value")))).alias("m"))
    parts = [F.when(F.try_element_at("m", F.lit(k)).isNotNull() & (F.try_element_at("m", F.lit(k)) != v), F.concat(F.lit(f"{k}: stored "), F.try_element_at("m", F.lit(k)), F.lit(f", current {v}"))) for k, v in sorted(current.items())]
    message = F.concat_ws("; ", *parts)
    return got.select(F.when(F.size("m") == 0, "new").when(F.size("m") < len(current), "partial").when(message == "", "same").otherwise("drift").alias("state"), message.alias("message"))


def config_value(stored: DataFrame, key: str) -> DataFrame:
    """value of one setting; without it the query fails when it runs, as nothing stands for a setting that is not there."""
    got = stored.where(F.col("key") == key).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return got.select(F.when(F.col("n") > 0, F.col("value")).otherwise(F.raise_error(F.lit(f"not found: {key}")).cast("string")).alias("value"))


def mode_detected(config: DataFrame, key: str, nar_files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: on_by_config, on_by_files, on_by_chunks or off, the first that holds."""
    said = config.where((F.col("key") == key) & (F.col("value") == "true")).limit(1).agg((F.count(F.lit(1)) > 0).alias("said"))
    files = nar_files.where("total_chunks > 0").limit(1).agg((F.count(F.lit(1)) > 0).alias("files"))
    some = chunks.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    return said.crossJoin(files).crossJoin(some).select(F.when(F.col("said"), "on_by_config").when(F.col("files"), "on_by_files").when(F.col("some"), "on_by_chunks").otherwise("off").alias("mode"))


def upstream_selected(probes: DataFrame, by: str = "priority") -> DataFrame:
    """asset and upstream: of healthy upstreams that have it the first by priority (or latency), ties by name."""
    return probes.where("healthy and status = 'present'").groupBy("asset").agg(F.min_by("upstream", F.struct(by, "upstream")).alias("upstream"))


def state_changes(rows: DataFrame, key: str, at: str, state: Column) -> DataFrame:
    """key, at, was, now of each change of a boolean state in time."""
    order = Window.partitionBy(key).orderBy(at, *[c for c in ("event_id",) if c in rows.columns])
    seen = rows.withColumn("now", state).withColumn("was", F.lag("now").over(order))
    return seen.where("was is not null and was <> now").select(key, at, "was", "now")


def failure_runs(rows: DataFrame, key: str, order_by: list[str], failed: Column) -> DataFrame:
    """rows with failures: how many in a row there have been up to each; a success sets it to 0."""
    order = Window.partitionBy(key).orderBy(*order_by)
    marked = rows.withColumn("_failed", failed).withColumn("_island", F.sum(F.when(failed, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, "_island").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("failures", F.sum(F.when(F.col("_failed"), 1).otherwise(0)).over(inner)).drop("_failed", "_island")


def breaker(rows: DataFrame, key: str, at: str, failed: Column, threshold: int = 5, pause: int = 60) -> DataFrame:
    """key, state at the end of each key's log: open after threshold failures in a row, half_open once the pause has passed."""
    order = [at, *[c for c in ("event_id",) if c in rows.columns]]
    runs = failure_runs(rows, key, order, failed)
    last = runs.groupBy(key).agg(F.max_by("failures", F.struct(*order)).alias("failures"), F.max(at).alias("last"))
    now = rows.agg(F.max(at).alias("now"))
    both = last.crossJoin(F.broadcast(now))
    return both.select(key, "failures", F.when(F.col("failures") < threshold, "closed").when(older_than(F.col("last"), F.col("now"), pause), "half_open").otherwise("open").alias("state"))


def touches(log: DataFrame, key: str, at: str, seconds: int = 300) -> DataFrame:
    """key, accepted, last: accesses that rewrote the access time, each more than so many seconds after the last accepted one.

    Each depends on the one accepted before, so a key's times are walked in order, sorted in their task and not gathered."""
    schema = log.select(key, at).schema
    kinds = [schema[c].dataType.simpleString() for c in (key, at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types, out = None, None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], types[0]), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], types[1])], names=[key, "accepted", "last"])
        for batch in batches:
            types = batch.column(0).type, batch.column(1).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is None or held[0] != k:
                    if held is not None:
                        out.append(held)
                    held = (k, int(t is not None), t)
                elif t is not None and (held[2] is None or (t - held[2]).total_seconds() > seconds):
                    held = (k, held[1] + 1, t)
            if len(out) >= 5000:
                yield made()
                out = []
        if held is not None:
            out.append(held)
        if out:
            yield made()

    walked = log.select(key, at).repartition(key).sortWithinPartitions(key, at)
    return walked.mapInArrow(run, f"`{key}` {kinds[0]}, accepted long, last {kinds[1]}")


def coalesced(log: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, start, end, n of jobs: requests that overlap in time share one."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = log.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_job", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_job").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_job")
