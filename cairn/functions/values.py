"""Sizes, ages, null rules, back-off and text records as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size units by powers of 1024.
UNITS = "BKMGT"


def size_literal(text: Column) -> Column:
    """Bytes of a number and one unit letter, either case; null for anything else."""
    digits, unit = F.regexp_extract(text, "^([0-9]+)([BKMGTbkmgt])$", 1), F.upper(F.regexp_extract(text, "^([0-9]+)([BKMGTbkmgt])$", 2))
    power = F.create_map(*[F.lit(x) for k, u in enumerate(UNITS) for x in (u, 1024**k)])
    return F.when(digits != "", F.try_multiply(digits.try_cast("decimal(20,0)"), F.try_element_at(power, unit).cast("decimal(20,0)")).cast("decimal(38,0)"))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def older_than(ts: Column, now: Column, seconds: int) -> Column:
    """Strictly: whether ts lies more than so many seconds before now; null where ts is."""
    return ts < now - F.make_dt_interval(secs=F.lit(seconds))


def touched(last: Column, now: Column, seconds: int = 300) -> Column:
    """The access time after a touch at now: rewritten only if null or older than the threshold."""
    return F.when(last.isNull() | older_than(last, now, seconds), now).otherwise(last)


def due(verified: Column, now: Column, seconds: int) -> Column:
    """Whether to check again: never checked, checked longer ago than the threshold, or no threshold."""
    return F.lit(True) if seconds <= 0 else F.coalesce(older_than(verified, now, seconds), F.lit(True))


def backoff(attempt: Column, initial: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(2.0), attempt - 1))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done * 100.0 / total).otherwise(0.0)


def existence(status: Column) -> Column:
    """present, absent or unknown: only a 404 is absence, only an answer below 400 presence."""
    return F.when(status == 404, "absent").when(status < 400, "present").otherwise("unknown")


def text_fields(text: Column) -> Column:
    """map of "Key: value" lines; of repeated keys the last counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(": ")))
    pairs = F.transform(lines, lambda x: F.struct(F.split_part(x, F.lit(": "), F.lit(1)).alias("k"), F.substr(x, F.locate(": ", x) + 2).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def cache_info(text: Column) -> Column:
    """struct(store_dir, want_mass_query, priority) of a cache's description; null if a key is unknown or a value malformed."""
    m = text_fields(text)
    known = F.forall(F.map_keys(m), lambda k: k.isin("StoreDir", "WantMassQuery", "Priority"))
    want, priority = F.try_element_at(m, F.lit("WantMassQuery")), F.try_element_at(m, F.lit("Priority"))
    sound = (want.isNull() | want.isin("0", "1")) & (priority.isNull() | priority.try_cast("bigint").isNotNull())
    return F.when(known & sound, F.struct(F.try_element_at(m, F.lit("StoreDir")).alias("store_dir"), (want == "1").alias("want_mass_query"), priority.try_cast("bigint").alias("priority")))


#: Parts of the messages of transient transport errors.
TRANSIENT = ("http2: server sent GOAWAY", "http2: timeout awaiting response headers", "connection reset by peer", "broken pipe")


def retriable(message: Column) -> Column:
    """Whether an error's message names a transient transport error; no message does not."""
    hits = [F.contains(message, F.lit(x)) for x in TRANSIENT]
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False))


def signature_name(signature: Column) -> Column:
    """Who signed: what stands before the colon."""
    return F.split_part(signature, F.lit(":"), F.lit(1))


def trusted(signatures: Column, names: list[str]) -> Column:
    """Whether any signature's name is among the trusted ones. Membership only: nothing is verified."""
    return F.exists(F.coalesce(signatures, F.array().cast("array<string>")), lambda s: signature_name(s).isin(*names))


def signed_by(signatures: Column, own: Column) -> Column:
    """Signatures with those of the own key's name left out and the own one at the end."""
    others = F.filter(F.coalesce(signatures, F.array().cast("array<string>")), lambda s: signature_name(s) != signature_name(own))
    return F.concat(others, F.array(own))


def canonical_trace(drv_path: Column, output_name: Column, out_path: Column) -> Column:
    """What a build trace entry's signature signs: its JSON without the signatures, fields in a fixed order."""
    return F.to_json(F.struct(F.struct(drv_path.alias("drvPath"), output_name.alias("outputName")).alias("key"), F.struct(out_path.alias("outPath")).alias("value")))


def fingerprint(path: Column, hash: Column, size: Column, references: Column) -> Column:
    """What a package's signature signs."""
    return F.concat_ws(";", F.lit("1"), path, hash, size.cast("string"), F.array_join(F.array_sort(references), ","))
