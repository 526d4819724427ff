"""Archive URLs: parsed, normalised, joined and written as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import ARCHIVE_HASH, INFO_HASH, valid_archive_hash

#: Compression types and their file extensions.
EXTENSIONS = {"none": "", "bzip2": "bz2", "zstd": "zst", "lzip": "lzip", "lz4": "lz4", "br": "br", "xz": "xz"}
#: Priority of encodings that a client may accept.
ENCODINGS = ["zstd", "br", "gzip"]


def _chosen(c: Column, pairs: dict[str, str]) -> Column:
    """What c stands for; null where it is none of the pairs' names."""
    out = F.lit(None).cast("string")
    for name, value in pairs.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def compression_of(extension: Column) -> Column:
    """The compression of an extension; null where it is unknown."""
    return _chosen(extension, {e: c for c, e in EXTENSIONS.items()})


def extension_of(compression: Column) -> Column:
    return _chosen(compression, EXTENSIONS)


#: A path whose last part, slashes at the end aside, begins with something before its first ".nar": that, and what follows.
FILE = r"^(?:.*/)?([^/]+?)\.nar([^/]*)/*$"


def parsed(url: Column) -> Column:
    """struct(path, hash, compression, query), all null unless the file name is hash.nar[.extension] with a known extension;
    the hash is not checked. Each part is worked out once a row: a transform over one element keeps it from being inlined."""

    def whole(u: Column) -> Column:
        cut = F.instr(u, "?")
        path = F.when(cut > 0, F.substr(u, F.lit(1), cut - 1)).otherwise(u)
        return F.struct(path.alias("path"), F.when(cut > 0, F.substr(u, cut + 1)).otherwise("").alias("query"))

    def named(p: Column) -> Column:
        hash, after = F.regexp_extract(p["path"], FILE, 1), F.regexp_extract(p["path"], FILE, 2)
        compression = F.when(after == "", "none").when(F.startswith(after, F.lit(".")) & (after != "."), compression_of(F.substr(after, F.lit(2))))
        return F.struct(p["path"].alias("path"), hash.alias("hash"), compression.alias("compression"), p["query"].alias("query"))

    one = F.transform(F.transform(F.array(url), whole), named)
    return F.get(F.filter(one, lambda x: (x["hash"] != "") & x["compression"].isNotNull()), F.lit(0))


def parse_url(url: Column) -> Column:
    """struct(hash, compression, query) of a URL with a valid hash; null otherwise."""
    p = parsed(url)
    return F.when(valid_archive_hash(p["hash"]), F.struct(p["hash"].alias("hash"), p["compression"].alias("compression"), p["query"].alias("query")))


def parse_upstream_url(url: Column, fallback: Column) -> Column:
    """struct(hash, compression, query, opaque_path): other servers' URLs, whose file name need not be a hash; fallback is then
    the hash. A path without .nar counts if it has a slash."""
    p = parsed(url)
    path = F.split_part(url, F.lit("?"), F.lit(1))
    query = F.when(F.contains(url, F.lit("?")), F.substr(url, F.length(path) + 2)).otherwise("")
    file = F.element_at(F.split(path, "/"), -1)
    bare = p.isNull() & F.contains(path, F.lit("/")) & ~file.isin("", ".") & ~F.contains(file, F.lit(".nar"))
    out = lambda h, c, q, o: F.struct(h.alias("hash"), c.alias("compression"), q.alias("query"), o.alias("opaque_path"))
    none = F.lit(None).cast("string")
    return (
        F.when(valid_archive_hash(p["hash"]), out(p["hash"], p["compression"], p["query"], none))
        .when(p.isNotNull() & valid_archive_hash(fallback), out(fallback, p["compression"], p["query"], p["path"]))
        .when(bare & valid_archive_hash(fallback), out(fallback, F.lit("none"), query, path))
    )


def normalised_hash(hash: Column) -> Column:
    """The hash without the other table's hash in front; null if what is left is not a hash."""
    rest = F.regexp_replace(hash, f"^{INFO_HASH}[-_]", "")
    return F.when(rest.rlike(f"^{ARCHIVE_HASH}$"), rest)


def reference(opaque_path: Column, query: Column) -> Column:
    """A path and its query as one text; reference_parts() takes them apart."""
    return F.concat(opaque_path, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))


def reference_parts(text: Column) -> Column:
    """struct(opaque_path, query) of a reference, cut at its first question mark."""
    cut = F.instr(text, "?")
    return F.struct(F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text).alias("opaque_path"), F.when(cut > 0, F.substr(text, cut + 1)).otherwise("").alias("query"))


def written(hash: Column, compression: Column, query: Column, opaque_path: Column | None = None) -> Column:
    extension = extension_of(compression)
    path = F.concat(F.lit("nar/"), hash, F.lit(".nar"), F.when(extension != "", F.concat(F.lit("."), extension)).otherwise(""))
    if opaque_path is not None:
        path = F.coalesce(F.nullif(opaque_path, F.lit("")), path)
    return F.concat(path, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))


def joined(base: Column, base_query: Column, path: Column, query: Column) -> Column:
    """A path under a base URL; both queries, with & between."""
    q = F.concat_ws("&", F.nullif(base_query, F.lit("")), F.nullif(query, F.lit("")))
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def query_map(query: Column) -> Column:
    """array<struct<key, value>> of a query, decoded, in its order; keys may repeat."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.try_url_decode(F.split_part(x, F.lit("="), F.lit(1))).alias("key"), F.try_url_decode(F.when(F.contains(x, F.lit("=")), F.substr(x, F.locate("=", x) + 1)).otherwise("")).alias("value")))


def query_encoded(query: Column) -> Column:
    """The query with its keys in order (equal keys keep theirs), percent-encoded."""
    numbered = F.transform(query_map(query), lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda x: F.concat(F.url_encode(x["key"]), F.lit("="), F.url_encode(x["value"]))), "&")


def accepted_encoding(header: Column) -> Column:
    """The best encoding that an Accept-Encoding header names, "none" without one."""
    names = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.trim(F.split_part(x, F.lit(";"), F.lit(1))))
    out = F.lit("none")
    for name in reversed(ENCODINGS):
        out = F.when(F.array_contains(names, name), name).otherwise(out)
    return out
