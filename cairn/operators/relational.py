"""A thin fluent query over one table, for those who know the generated query builder: every call is one DataFrame call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    pass


class NotSingular(LookupError):
    pass


class Query:
    """Immutable: each step returns a new Query, so a clone is the query itself."""

    def __init__(self, df: DataFrame, id: str = "id"):
        self.df, self.id = df, id

    def _of(self, df: DataFrame) -> Query:
        return Query(df, self.id)

    def where(self, *conditions: Column) -> Query:
        out = self.df
        for c in conditions:
            out = out.where(c)
        return self._of(out)

    def limit(self, n: int) -> Query:
        return self._of(self.df.limit(n))

    def offset(self, n: int) -> Query:
        return self._of(self.df.offset(n))

    def unique(self) -> Query:
        return self._of(self.df.distinct())

    def order(self, *terms: Column | str) -> Query:
        """Ascending names put nulls first."""
        return self._of(self.df.orderBy(*[F.asc_nulls_first(t) if isinstance(t, str) else t for t in terms]))

    def order_by_count(self, children: DataFrame, foreign: str, descending: bool = False) -> Query:
        n = children.groupBy(F.col(foreign).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
        out = self.df.join(n, self.df[self.id] == n["_fk"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        return self._of(out.orderBy(F.desc("_n") if descending else F.asc("_n"), self.id).drop("_fk", "_n"))

    def order_by_child(self, children: DataFrame, foreign: str, term: str) -> Query:
        """By the least value of a column of the children."""
        least = children.groupBy(F.col(foreign).alias("_fk")).agg(F.min(term).alias("_t"))
        out = self.df.join(least, self.df[self.id] == least["_fk"], "left")
        return self._of(out.orderBy(F.asc_nulls_first("_t"), self.id).drop("_fk", "_t"))

    def select(self, *fields: Column | str) -> DataFrame:
        return self.df.select(*fields)

    def all(self) -> DataFrame:
        return self.df

    def ids(self) -> DataFrame:
        return self.df.select(self.id)

    def first(self) -> DataFrame:
        """The row with the smallest id (the reference order is undefined; this one is fixed)."""
        return self.df.orderBy(self.id).limit(1)

    def one(self, n: int = 1):
        """The first n rows at the driver, for the API's edge."""
        return self.df.orderBy(self.id).limit(n).collect()

    def first_row(self):
        if not (rows := self.one()):
            raise NotFound
        return rows[0]

    def only(self):
        rows = self.one(2)
        if not rows:
            raise NotFound
        if len(rows) > 1:
            raise NotSingular
        return rows[0]

    def single(self) -> DataFrame:
        """The only row, as a table; with no row or several the query fails when it runs."""
        rows = self.df.limit(2).agg(F.collect_list(F.struct(*self.df.columns)).alias("r"))
        sound = F.when(F.size("r") == 1, F.get("r", F.lit(0))).otherwise(F.raise_error(F.when(F.size("r") == 0, "not found").otherwise("not singular")).cast(rows.schema["r"].dataType.elementType))
        return rows.select(sound.alias("r")).select("r.*")

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def exist(self) -> DataFrame:
        return self.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("exist"))

    def aggregate(self, **terms: Column) -> DataFrame:
        return self.df.agg(*[c.alias(n) for n, c in terms.items()])

    def group_by(self, *fields: str):
        return self.df.groupBy(*fields)

    def has(self, children: DataFrame, foreign: str, *conditions: Column) -> Query:
        for c in conditions:
            children = children.where(c)
        return self._of(self.df.join(children.select(F.col(foreign).alias(self.id)), self.id, "left_semi"))

    def has_not(self, children: DataFrame, foreign: str, *conditions: Column) -> Query:
        for c in conditions:
            children = children.where(c)
        return self._of(self.df.join(children.select(F.col(foreign).alias(self.id)), self.id, "left_anti"))

    def traverse(self, children: DataFrame, foreign: str) -> Query:
        """The children of the rows at hand."""
        return Query(children.join(self.df.select(F.col(self.id).alias(foreign)), foreign, "left_semi"), self.id)

    def with_children(self, children: DataFrame, foreign: str, name: str, order: str) -> DataFrame:
        """Each row with an array of its children, in order."""
        fields = [c for c in children.columns if c != foreign]
        item = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))
        grouped = children.groupBy(F.col(foreign).alias(self.id)).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))
        return self.df.join(grouped, self.id, "left").withColumn(name, F.coalesce(name, F.array()))

    def with_parent(self, parents: DataFrame, foreign: str, prefix: str) -> DataFrame:
        """Each row with its parent's columns."""
        named = parents.select(*[F.col(c).alias(f"{prefix}{c}") for c in parents.columns])
        return self.df.join(named, self.df[foreign] == named[f"{prefix}{self.id}"])


def equal_fold(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def contains_fold(c: Column, value: str) -> Column:
    return F.contains(F.lower(c), F.lit(value.lower()))


def page_after(df: DataFrame, last: int, size: int, key: str = "id") -> DataFrame:
    """One page by key; whole scans need none."""
    return df.where(F.col(key) > last).orderBy(key).limit(size)


def next_cursor(page: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Where to go on: the page's last key, or 0 after a short page."""
    return page.agg(F.when(F.count(F.lit(1)) < size, F.lit(0).cast("long")).otherwise(F.max(key)).alias("cursor"))


def preferred(df: DataFrame, key: list[str], rank: Column, tie: str = "id") -> DataFrame:
    """For each key the row with the lowest rank (null ranks are no candidates), ties by id."""
    rows = df.withColumn("_rank", rank).where("_rank is not null")
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct("_rank", tie)).alias("_best"))
    return best.select("_best.*")
