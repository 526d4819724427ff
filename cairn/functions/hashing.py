"""Hash and path functions as Column expressions; the few that SQL lacks as pandas UDFs."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet leaves out e, o, u and t.
ALPHABET = "0123456789abcdfghijklmnpqrsvwxyz"
INFO_HASH = "[0-9a-df-np-sv-z]{32}"
ARCHIVE_HASH = "(?:[0-9a-df-np-sv-z]{52}|[0-9a-f]{64})"


def valid_info_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{INFO_HASH}$"), F.lit(False))


def valid_archive_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^(?:{INFO_HASH}[-_])?{ARCHIVE_HASH}$"), F.lit(False))


def sharded_path(name: Column) -> Column:
    """a/ab/name; null for names of fewer than three characters."""
    return F.when(F.length(name) >= 3, F.concat_ws("/", F.substring(name, 1, 1), F.substring(name, 1, 2), name))


def info_path(hash: Column) -> Column:
    return F.when(valid_info_hash(hash), sharded_path(F.concat(hash, F.lit(".narinfo"))))


def archive_path(hash: Column, extension: Column) -> Column:
    name = F.concat(hash, F.lit(".nar"), F.when(extension != "", F.concat(F.lit("."), extension)).otherwise(""))
    return F.when(valid_archive_hash(hash), sharded_path(name))


def closure_hash(reference: Column, hash_len: int = 32) -> Column:
    """The hash that a reference begins with; null where it is shorter. hash_len 52 skips ordinary references."""
    return F.when(F.length(reference) >= hash_len, F.substring(reference, 1, hash_len))


def storage_key(archive_hash: Column) -> Column:
    """What follows the algorithm's name, "" if there is none."""
    return F.coalesce(F.regexp_extract(archive_hash, "^[^:]+:(.+)$", 1), F.lit(""))


def store_path(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix.rstrip("/") + "/"), name)


def content_address(content: Column) -> Column:
    return F.sha2(content, 256)


def to_base32(digest: bytes) -> str:
    """Digits of five bits, the digest's last bits first."""
    value = int.from_bytes(digest, "little")
    n = -(-len(digest) * 8 // 5)
    return "".join(ALPHABET[value >> 5 * k & 31] for k in range(n - 1, -1, -1))


def from_base32(text: str, size: int) -> bytes | None:
    value = 0
    for c in text:
        if (d := ALPHABET.find(c)) < 0:
            return None
        value = value << 5 | d
    return value.to_bytes(size, "little") if value < 1 << 8 * size else None


def parse_digest(text: str | None, size: int = 32) -> bytes | None:
    """A digest in any of its encodings, with or without the algorithm's name; null if it is none."""
    if not text:
        return None
    for mark in (":", "-"):
        head, _, tail = text.partition(mark)
        if tail and head in ("sha256", "sha512", "sha1", "md5"):
            text = tail
            break
    try:
        if len(text) == 2 * size:
            return bytes.fromhex(text)
        if len(text) == -(-size * 8 // 5):
            return from_base32(text, size)
        out = base64.b64decode(text, validate=True)
        return out if len(out) == size else None
    except ValueError:
        return None


def _udf(f):
    """A pandas UDF of strings; made when used, as importing this module on an executor must not need a session."""
    import pandas as pd

    def typed(s: pd.Series) -> pd.Series:
        return f(s)

    typed.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(typed, "string")


def hex_to_base32(hexes: Column) -> Column:
    f = lambda s: s.map(lambda x: None if x is None else to_base32(bytes.fromhex(x)))
    return _udf(f)(hexes)


def digest_to_hex(texts: Column) -> Column:
    """Any encoding of a digest as hexadecimal; null for what is none."""
    f = lambda s: s.map(lambda x: d.hex() if (d := parse_digest(x)) is not None else None)
    return _udf(f)(texts)
