"""The twelve tables of the model, and the integrity rules that Spark does not enforce, as queries that return violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "timestamp_ntz": T.TimestampNTZType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in map(str.split, fields.split(","))])


_TIMES = "created_at timestamp_ntz, updated_at timestamp_ntz"
#: Column names and types are fixed values of the model.
SCHEMAS: dict[str, T.StructType] = {
    "narinfos": _struct(f"id bigint, hash string, store_path string, url string, upstream_url string, compression string, file_hash string, file_size bigint, nar_hash string, nar_size bigint, deriver string, system string, ca string, last_accessed_at timestamp_ntz, {_TIMES}"),
    "nar_files": _struct(f"id bigint, hash string, compression string, file_size bigint, query string, total_chunks bigint, chunking_started_at timestamp_ntz, verified_at timestamp_ntz, bytes_stored_at timestamp_ntz, dechunk_residue_flagged_at timestamp_ntz, last_accessed_at timestamp_ntz, {_TIMES}"),
    "narinfo_nar_files": _struct("id bigint, narinfo_id bigint, nar_file_id bigint"),
    "narinfo_references": _struct("id bigint, narinfo_id bigint, reference string"),
    "narinfo_signatures": _struct("id bigint, narinfo_id bigint, signature string"),
    "chunks": _struct(f"id bigint, hash string, size bigint, compressed_size bigint, {_TIMES}"),
    "nar_file_chunks": _struct("id bigint, nar_file_id bigint, chunk_id bigint, chunk_index bigint"),
    "config": _struct(f"id bigint, key string, value string, {_TIMES}"),
    "pinned_closures": _struct(f"id bigint, hash string, {_TIMES}"),
    "build_trace_entries": _struct(f"id bigint, drv_path string, output_name string, out_path string, raw_json string, {_TIMES}"),
    "build_trace_signatures": _struct("id bigint, build_trace_entry_id bigint, key_name string, signature string"),
    "staging_states": _struct(f"id bigint, hash string, requested_at timestamp_ntz, parts_available bigint, compression string, status string, {_TIMES}"),
}
UNIQUE = {
    "narinfos": ["hash"], "nar_files": ["hash", "compression", "query"], "narinfo_nar_files": ["narinfo_id", "nar_file_id"],
    "narinfo_references": ["narinfo_id", "reference"], "narinfo_signatures": ["narinfo_id", "signature"], "chunks": ["hash"],
    "nar_file_chunks": ["nar_file_id", "chunk_index"], "config": ["key"], "pinned_closures": ["hash"],
    "build_trace_entries": ["drv_path", "output_name"], "build_trace_signatures": ["build_trace_entry_id", "key_name"], "staging_states": ["hash"],
}
#: child table -> (its column, parent table); deleting a parent deletes its children.
FOREIGN = {
    "narinfo_nar_files": [("narinfo_id", "narinfos"), ("nar_file_id", "nar_files")], "narinfo_references": [("narinfo_id", "narinfos")],
    "narinfo_signatures": [("narinfo_id", "narinfos")], "nar_file_chunks": [("nar_file_id", "nar_files"), ("chunk_id", "chunks")],
    "build_trace_signatures": [("build_trace_entry_id", "build_trace_entries")],
}
NOT_NEGATIVE = {"narinfos": ["file_size", "nar_size"], "chunks": ["size", "compressed_size"], "staging_states": ["parts_available"]}
NOT_EMPTY = {"narinfos": ["hash"], "nar_files": ["hash"], "chunks": ["hash"], "config": ["key", "value"], "pinned_closures": ["hash"], "staging_states": ["hash"]}


def duplicated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    return child.join(parent.select(F.col("id").alias(column)), column, "left_anti")


class ConstraintError(ValueError):
    """A key that is not unique, or a parent that is missing."""


class ValidationError(ValueError):
    """A value that its column may not hold."""


def checked(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, or an error that names the rules broken and how often: for the edge of an API, as it runs the checks."""
    broken = {r["rule"]: r["n"] for r in violations(tables).where("n > 0").collect()}
    if broken:
        keys = [rule for rule in broken if rule.startswith(("unique", "parent"))]
        raise (ConstraintError if keys else ValidationError)(", ".join(f"{rule}: {n}" for rule, n in sorted(broken.items())))
    return tables


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """rule and n: one row for each integrity rule of the given tables, n the number of violations."""
    checks = []
    for name, df in tables.items():
        checks.append((f"unique {name}({', '.join(UNIQUE[name])})", duplicated_keys(df, UNIQUE[name])))
        checks += [(f"parent {name}({c})", missing_parents(df, c, tables[p])) for c, p in FOREIGN.get(name, []) if p in tables]
        checks += [(f"not negative {name}({c})", df.where(F.col(c) < 0)) for c in NOT_NEGATIVE.get(name, [])]
        checks += [(f"not empty {name}({c})", df.where((F.col(c) == "") | F.col(c).isNull())) for c in NOT_EMPTY.get(name, [])]
    return reduce(DataFrame.unionByName, [d.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n")) for rule, d in checks])


def differences(spark, declared: T.StructType, actual: T.StructType) -> DataFrame:
    """column, declared and actual type (null where it is missing) of each column in which two schemas differ."""
    kinds = [{f.name: f.dataType.simpleString() for f in s.fields} for s in (declared, actual)]
    rows = [(c, kinds[0].get(c), kinds[1].get(c)) for c in sorted(kinds[0].keys() | kinds[1].keys()) if kinds[0].get(c) != kinds[1].get(c)]
    return spark.createDataFrame(rows, "column string, declared string, actual string")


def rebuilt(old: DataFrame, schema: T.StructType, mapping: dict[str, Column]) -> DataFrame:
    """A table copied into a new shape: mapped columns, then those of the same name, each cast; others null."""
    value = lambda f: mapping.get(f.name, F.col(f.name) if f.name in old.columns else F.lit(None))
    return old.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def pending(known: DataFrame, applied: DataFrame) -> DataFrame:
    """Versions that are known and not yet applied."""
    return known.select("version").distinct().join(applied.select("version"), "version", "left_anti")
