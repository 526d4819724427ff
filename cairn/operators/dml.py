"""Mutations as functions from an old snapshot to a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key is not there yet, one for each key."""
    return insert(old, new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: dict[str, Column] | list[str]) -> DataFrame:
    """new has one row a key. On conflict only the named columns change: to new's value, or to a given expression over the
    columns of old and of new, the latter as n_<name>."""
    update = update if isinstance(update, dict) else {c: F.col(f"n_{c}") for c in update}
    theirs = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n__there"))
    mine = old.withColumn("_there", F.lit(True))
    both = mine.join(theirs, [mine[k].eqNullSafe(theirs[f"n_{k}"]) for k in key], "full_outer")

    def column(c: str) -> Column:
        fresh = F.col(f"n_{c}") if c in new.columns else F.lit(None)
        kept = F.when(F.col("n__there"), update[c]).otherwise(F.col(c)) if c in update else F.col(c)
        return F.when(F.col("_there").isNull(), fresh).otherwise(kept).cast(old.schema[c].dataType).alias(c)

    return both.select(*[column(c) for c in old.columns])


def fill_stubs(old: DataFrame, new: DataFrame, key: list[str], url: str = "url") -> DataFrame:
    """Rows that are there with a url stay whole; rows without one are replaced whole; others are inserted."""
    theirs = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n__there"))
    mine = old.withColumn("_there", F.lit(True))
    both = mine.join(theirs, [mine[k] == theirs[f"n_{k}"] for k in key], "full_outer")
    takes = F.col("_there").isNull() | (F.col("n__there").isNotNull() & (F.coalesce(F.col(url), F.lit("")) == ""))
    keep = {"id", "created_at"}
    value = lambda c: F.when(takes & (F.col("_there").isNull() if c in keep else F.lit(True)), F.col(f"n_{c}")).otherwise(F.col(c))
    return both.select(*[(value(c) if c in new.columns else F.col(c)).cast(old.schema[c].dataType).alias(c) for c in old.columns])


def update_where(old: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return old.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)).cast(old.schema[c].dataType) for c, v in values.items()})


def update_matching(old: DataFrame, keys: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """update_where for the rows whose key is in keys, a table of one row a key."""
    marked = old.join(keys.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return update_where(marked, F.col("_hit"), values).select(*old.columns)


def delete_where(old: DataFrame, where: Column) -> DataFrame:
    return old.where(~F.coalesce(where, F.lit(False)))


def delete_matching(old: DataFrame, keys: DataFrame, on: list[str] | Column) -> DataFrame:
    return old.join(keys, on, "left_anti")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new are replaced by new."""
    return insert(delete_matching(old, new.select(parent).distinct(), [parent]), new)


def cascade(tables: dict[str, DataFrame], foreign: dict[str, list[tuple[str, str]]], parent: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables after the deletion of parent rows (ids), with what hangs on them."""
    out = dict(tables)
    out[parent] = delete_matching(out[parent], deleted.select("id"), ["id"])
    for child, links in foreign.items():
        for column, of in links:
            if of == parent and child in out:
                out[child] = delete_matching(out[child], deleted.select(F.col("id").alias(column)), [column])
    return out


def relink(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """INSERT ... SELECT with conflicts ignored: (narinfo_id, nar_file_id) pairs joined into the link table."""
    return insert_or_ignore(links, pairs, ["narinfo_id", "nar_file_id"])


def or_join(left: DataFrame, key: str, *keys: DataFrame) -> DataFrame:
    """Rows of left whose key is in any of several tables: a union of keys, not a join on OR."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [k.select(key) for k in keys]).distinct()
    return left.join(every, key, "left_semi")
