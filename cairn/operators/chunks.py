"""Chunking, deduplication, reassembly and verification of stored files."""

from __future__ import annotations

import bz2
import hashlib
import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dml

#: Least, mean and largest chunk in bytes.
LEAST, MEAN, MOST = 16384, 65536, 262144


def gear(seed: int = 1) -> np.ndarray:
    """256 pseudo-random 64-bit numbers from a rule: the digests of (seed, byte)."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([seed & 255, b])).digest()[:8], "little") for b in range(256)], np.uint64)


def boundaries(data: bytes, table: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of content-defined chunks. A position may end one where the gear hash of the 64 bytes before it has its high bits
    zero: one more bit than the mean's below the mean size, one fewer above; never below least, always at most."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    values = table[np.frombuffer(data, np.uint8)]
    rolling = values.copy()
    width = 1
    while width < 64:  # rolling[i] = sum of values[i - k] << k over 64 bytes, by doubling
        shifted = np.zeros(n, np.uint64)
        shifted[width:] = rolling[:-width] if n > width else 0
        rolling = rolling + (shifted << np.uint64(width))
        width *= 2
    bits = mean.bit_length() - 1
    strict = np.flatnonzero(rolling >> np.uint64(64 - bits - 1) == 0) + 1
    loose = np.flatnonzero(rolling >> np.uint64(64 - bits + 1) == 0) + 1
    out, start = [], 0
    while start < n:
        if n - start <= least:
            out.append(n)
            break
        end = min(start + most, n)
        a = np.searchsorted(strict, start + least)
        if a < len(strict) and strict[a] < min(start + mean, end):
            end = int(strict[a])
        else:
            b = np.searchsorted(loose, start + max(mean, least))
            if b < len(loose) and loose[b] < end:
                end = int(loose[b])
        out.append(end)
        start = end
    return out


def chunked(files: DataFrame, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> DataFrame:
    """nar_file_id, chunk_index, hash (SHA-256), size, offset, content of each chunk of files (id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear()
        for batch in batches:
            for id, content in zip(batch.column("id").to_pylist(), batch.column("content")):
                data = content.as_py() or b""
                ends = boundaries(data, table, least, mean, most)
                rows = [(id, k, hashlib.sha256(data[a:b]).hexdigest(), b - a, a, data[a:b]) for k, (a, b) in enumerate(zip([0, *ends], ends))]
                for at in range(0, len(rows), 64):
                    part = rows[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["nar_file_id", "chunk_index", "hash", "size", "offset", "content"])

    return files.select(F.col("id").cast("long").alias("id"), "content").mapInArrow(run, "nar_file_id long, chunk_index long, hash string, size long, offset long, content binary")


def line_chunked(texts: DataFrame) -> DataFrame:
    """nar_file_id, chunk_index, hash, size, data of each line of texts (id, text): deterministic chunks without Python."""
    rows = texts.select(F.col("id").alias("nar_file_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "data"))
    return rows.select("nar_file_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("size"), "data")


def _streams(data: bytes, decoder) -> tuple[bytes, bytes]:
    """All streams that follow one another in data, and what is left; EOFError if the last is not whole."""
    out, rest = [], data
    while rest:
        d = decoder()
        try:
            out.append(d.decompress(rest))
        except Exception:
            if len(out):  # what follows a whole stream is no stream: trailing bytes
                break
            raise
        if not d.eof:
            raise EOFError
        rest = d.unused_data.lstrip(b"\0")
    return b"".join(out), rest


def _lzip(data: bytes) -> bytes:
    out = []
    while data[:4] == b"LZIP":
        size = 1 << (data[5] & 31)
        size -= (size // 16) * (data[5] >> 5)
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2}])
        out.append(d.decompress(data[6:]))
        if not d.eof or len(d.unused_data) < 20:
            raise EOFError
        data = d.unused_data[20:]
    return b"".join(out)


#: First bytes of a stream that its decoder can start on; fixed values of the formats.
MAGIC = {"bzip2": b"BZh", "xz": b"\xfd7zXZ\0", "zstd": b"\x28\xb5\x2f\xfd", "lzip": b"LZIP"}


def _decoded(data: bytes | None, kind: str | None) -> tuple[bytes | None, str | None]:
    import zstandard

    if data is None:
        return None, None
    if not kind or kind == "none":
        return data, None
    if kind in ("lz4", "br"):
        return None, f"no decoder for {kind}"
    if kind not in MAGIC:
        return None, f"unsupported compression {kind}"
    if not data.startswith(MAGIC[kind]):
        return data, None
    try:
        if kind == "lzip":
            return _lzip(data), None
        decoder = {"bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}[kind]
        return _streams(data, decoder)[0], None
    except EOFError:
        return None, f"truncated {kind}"
    except (OSError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        return None, f"corrupt {kind}"


def decoded(content: Column, compression: Column) -> Column:
    """struct(data, error) of content by its compression: none (or empty), bzip2, zstd, xz and lzip (whose body is raw LZMA), with
    all streams or frames that follow one another. Content that does not begin as its format does stays as it is, as the decoder
    cannot start. A stream that ends early or breaks, an unknown compression, and lz4 and br, whose packages are not at hand,
    give an error and no data; null content gives neither."""

    def f(c, k):
        rows = [_decoded(x, y) for x, y in zip(c, k)]
        return pd.DataFrame({"data": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    f.__annotations__ = {"c": pd.Series, "k": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(f, "data binary, error string")(content, compression)


def decompressed(content: Column, compression: Column) -> Column:
    """The data of decoded()."""
    return decoded(content, compression)["data"]


def zstd_compressed(content: Column) -> Column:
    def f(c):
        import zstandard

        z = zstandard.ZstdCompressor()
        return c.map(lambda x: None if x is None else z.compress(x))

    f.__annotations__ = {"c": pd.Series, "return": pd.Series}
    return F.pandas_udf(f, "binary")(content)


def offsets(rows: DataFrame, key: str = "nar_file_id") -> DataFrame:
    """rows with the byte offset of each chunk in its file."""
    order = Window.partitionBy(key).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(order), F.lit(0)))


def gaps(chunk_links: DataFrame) -> DataFrame:
    """nar_file_id, chunk_index of links that are not where the run from 0 expects them."""
    order = Window.partitionBy("nar_file_id").orderBy("chunk_index")
    return chunk_links.withColumn("expected", F.row_number().over(order) - 1).where("chunk_index <> expected").select("nar_file_id", "chunk_index", "expected")


def first_seen(rows: DataFrame) -> DataFrame:
    """hash and the first index at which each distinct chunk of a batch was seen."""
    return rows.groupBy("hash").agg(F.min("chunk_index").alias("first_index"))


def recorded(rows: DataFrame, chunks: DataFrame, chunk_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunk and link tables after a batch: chunks that are new by hash, once each, and every link. rows: nar_file_id,
    chunk_index, hash, size. Ids of new chunks follow from their hash."""
    new = rows.groupBy("hash").agg(F.max("size").alias("size")).select(F.xxhash64("hash").alias("id"), "hash", "size")
    known = dml.insert_or_ignore(chunks.select("id", "hash", "size"), new, ["hash"])
    links = rows.join(known.select(F.col("id").alias("chunk_id"), "hash"), "hash").select("nar_file_id", "chunk_id", "chunk_index")
    return known, dml.insert_or_ignore(chunk_links.select("nar_file_id", "chunk_id", "chunk_index"), links, ["nar_file_id", "chunk_index"])


def truncated(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """nar_file_id, size, declared_size of files whose chunks do not add up. declared: nar_file_id, declared_size."""
    total = rows.groupBy("nar_file_id").agg(F.sum("size").cast("bigint").alias("size"))
    return declared.join(total, "nar_file_id", "left").withColumn("size", F.coalesce("size", F.lit(0))).where("size <> declared_size").select("nar_file_id", "size", "declared_size")


def assembled(rows: DataFrame, data: Column) -> DataFrame:
    """nar_file_id, n and data: each file's chunks in order, one behind the other."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", data.alias("data"))))
    grouped = rows.groupBy("nar_file_id").agg(ordered.alias("parts"))
    return grouped.select("nar_file_id", F.size("parts").alias("n"), F.array_join(F.transform("parts", lambda p: p["data"]), "").alias("data"))


def assembled_bytes(rows: DataFrame) -> DataFrame:
    """The same for binary content (rows: nar_file_id, chunk_index, content)."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    whole = F.aggregate(F.transform(ordered, lambda p: p["content"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.groupBy("nar_file_id").agg(whole.alias("content"))


def assembled_digests(rows: DataFrame) -> DataFrame:
    """nar_file_id, n, size and sha256 of each file's chunks in order. Chunks are sorted in their task and fed to the digest one
    by one, so no file is ever whole in memory. rows: nar_file_id, chunk_index, content."""
    kind = rows.schema["nar_file_id"].dataType.simpleString()
    arrow = pa.schema([("n", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, size, digest, out = None, 0, 0, None, []
        made = lambda t: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], t), *(pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow, 1))], names=["nar_file_id", *arrow.names])
        type_ = None
        for batch in batches:
            type_ = batch.column("nar_file_id").type
            for id, content in zip(batch.column("nar_file_id").to_pylist(), batch.column("content")):
                if digest is None or id != at:
                    if digest is not None:
                        out.append((at, n, size, digest.hexdigest()))
                    at, n, size, digest = id, 0, 0, hashlib.sha256()
                data = content.as_py() or b""
                n, size = n + 1, size + len(data)
                digest.update(data)
            if len(out) >= 1000:
                yield made(type_)
                out = []
        if digest is not None:
            out.append((at, n, size, digest.hexdigest()))
        if out:
            yield made(type_)

    rows = rows.select("nar_file_id", "chunk_index", "content").repartition("nar_file_id").sortWithinPartitions("nar_file_id", "chunk_index")
    return rows.select("nar_file_id", "content").mapInArrow(run, f"nar_file_id {kind}, n long, size long, sha256 string")


def to_chunks(files: DataFrame, chunks: DataFrame, chunk_links: DataFrame, *sizes: int) -> dict[str, DataFrame]:
    """Archives become chunks: decoded, cut, recorded and marked complete. files: nar_file rows with content. Those chunked
    already stay as they are, those that cannot be decoded too, and are in "failed" (id, error). The results share the cut
    chunks, which are staged; "chunked" holds them with their content."""
    from ..shared import staged

    whole = files.where("total_chunks <= 0").withColumn("_d", decoded(F.col("content"), F.col("compression")))
    cut = staged(chunked(whole.where("_d.error is null and _d.data is not null").select("id", F.col("_d.data").alias("content")), *sizes), "cut")
    known, links = recorded(cut.select("nar_file_id", "chunk_index", "hash", "size"), chunks, chunk_links)
    done = cut.groupBy(F.col("nar_file_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    rows = completed(files.drop("content"), done)
    marked = rows.join(done.select("id", F.lit(True).alias("_done")), "id", "left")
    rows = dml.update_where(marked, F.col("_done"), {"compression": F.lit("none")}).select(*rows.columns)
    return {"nar_files": rows, "chunks": known, "nar_file_chunks": links, "chunked": cut, "failed": whole.where("_d.error is not null").select("id", "_d.error")}


def made_whole(files: DataFrame, chunk_links: DataFrame, chunks: DataFrame, narinfos: DataFrame, links: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """The snapshots after chunked files whose outcome is ok were written whole: no chunks to their name, uncompressed; their
    narinfos' URLs say so; their chunk links go, and chunks that no other file has."""
    ok = outcomes.where("outcome = 'ok'").select("id")
    rows = dml.update_matching(files, ok, ["id"], {"total_chunks": F.lit(0), "compression": F.lit("none")})
    plain = files.join(ok, "id", "left_semi").select(F.col("id").alias("nar_file_id"), F.concat(F.lit("nar/"), "hash", F.lit(".nar")).alias("plain"))
    by_info = links.join(plain, "nar_file_id").groupBy(F.col("narinfo_id").alias("id")).agg(F.min_by("plain", "nar_file_id").alias("plain"))
    infos = narinfos.join(by_info, "id", "left").withColumns({"url": F.coalesce("plain", "url"), "compression": F.when(F.col("plain").isNotNull(), "none").otherwise(F.col("compression"))}).select(*narinfos.columns)
    _, kept, left = purged(files, chunk_links, chunks, ok)
    return {"nar_files": rows, "narinfos": infos, "nar_file_chunks": kept, "chunks": left}


def flushes(rows: DataFrame, key: str, order: str, most: int = 100) -> DataFrame:
    """rows with flush, the number of the micro-batch they are recorded in: at most so many chunks of a file each."""
    return rows.withColumn("flush", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / most).cast("long"))


def indexed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the index that each gets in its file's order, from 0."""
    return rows.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def links_with_chunks(chunk_links: DataFrame, chunks: DataFrame) -> DataFrame:
    """nar_file_id, chunk_index, hash and missing of every link: one whose chunk is gone is not lost but marked."""
    named = chunks.select(F.col("id").alias("chunk_id"), "hash")
    return chunk_links.join(named, "chunk_id", "left").select("nar_file_id", "chunk_index", "hash", F.col("hash").isNull().alias("missing"))


def parts_ready(parts: DataFrame, available: Column) -> DataFrame:
    """Staged parts that may be read: those before the number that is available."""
    return parts.where(F.col("part") < available)


def dedup(rows: DataFrame) -> DataFrame:
    """One row: links, distinct chunks, logical and stored bytes, and their ratio."""
    each = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    out = each.agg(F.sum("n").cast("bigint").alias("links"), F.count(F.lit(1)).alias("chunks"), F.sum(F.col("n") * F.col("size")).cast("bigint").alias("logical"), F.sum("size").cast("bigint").alias("stored"))
    return out.withColumn("ratio", F.when(F.col("stored") > 0, F.col("logical") / F.col("stored")).otherwise(0.0))


def shared(rows: DataFrame) -> DataFrame:
    """hash, files: chunks that more than one file has."""
    return rows.select("hash", "nar_file_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def to_whole(files: DataFrame, links: DataFrame, expected: DataFrame, got: DataFrame) -> DataFrame:
    """id and outcome of turning chunked files whole again: already_whole, no_hash, missing_chunk, hash_mismatch or ok.
    links: nar_file_id; expected: id, nar_hash, nar_size; got: id, sha256, size."""
    n = links.groupBy(F.col("nar_file_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    all_ = files.select("id", "total_chunks").join(n, "id", "left").join(expected, "id", "left").join(got, "id", "left")
    outcome = (
        F.when(F.col("total_chunks") <= 0, "already_whole")
        .when(F.coalesce("nar_hash", F.lit("")) == "", "no_hash")
        .when((F.coalesce("links", F.lit(0)) != F.col("total_chunks")) | F.col("sha256").isNull(), "missing_chunk")
        .when((F.col("sha256") != F.col("nar_hash")) | (F.col("nar_size").isNotNull() & (F.col("size") != F.col("nar_size"))), "hash_mismatch")
        .otherwise("ok")
    )
    return all_.select("id", outcome.alias("outcome"))


def completed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files marked complete: total_chunks and file_size set, chunking_started_at cleared. done: id, n, size."""
    marks = done.select("id", F.col("n").alias("_n"), F.col("size").alias("_size"))
    hit = files.join(marks, "id", "left")
    values = {"total_chunks": F.col("_n"), "file_size": F.col("_size"), "chunking_started_at": F.lit(None)}
    return dml.update_where(hit, F.col("_n").isNotNull(), values).select(*files.columns)


def purged(files: DataFrame, chunk_links: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, links and chunks after purging chunked files (id): links and rows go, and those of their chunks left alone."""
    gone = chunk_links.join(ids.select(F.col("id").alias("nar_file_id")), "nar_file_id", "left_semi")
    kept = chunk_links.join(ids.select(F.col("id").alias("nar_file_id")), "nar_file_id", "left_anti")
    candidates = gone.select(F.col("chunk_id").alias("id")).distinct()
    orphans = candidates.join(kept.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    return dml.delete_matching(files, ids.select("id"), ["id"]), kept, dml.delete_matching(chunks, orphans, ["id"])


def stale_links(chunk_links: DataFrame, files: DataFrame) -> DataFrame:
    """Links of files with no chunks to their name and no chunking under way."""
    stale = files.where("total_chunks <= 0 and chunking_started_at is null").select(F.col("id").alias("nar_file_id"))
    return chunk_links.join(stale, "nar_file_id", "left_semi")


def superseded(files: DataFrame, now: Column, delay: int = 86400) -> DataFrame:
    """Whole compressed files whose hash also has a chunked row, older than the delay."""
    from ..functions.values import older_than

    chunked_ = files.where("total_chunks > 0").select("hash").distinct()
    whole = files.where((F.col("total_chunks") <= 0) & (F.col("compression") != "none") & older_than(F.col("created_at"), now, delay))
    return whole.join(chunked_, "hash", "left_semi")
