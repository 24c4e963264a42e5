"""Relational operators that both pipelines and the query catalogue are made of.  Each takes
and returns DataFrames and leaves the physical join to the planner, which broadcasts a side
only below its own checked threshold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_by_patterns(df: DataFrame, column: str, patterns: Sequence[str], reason: str = "EXCLUDE_REASON") -> tuple[DataFrame, DataFrame]:
    """(included, excluded): rows whose column finds any of the patterns are excluded, with the
    patterns as the reason.  Null finds none."""
    if not patterns:
        return df, df.limit(0).withColumn(reason, F.lit(None).cast("string"))
    hit = F.coalesce(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    return df.where(~hit), df.where(hit).withColumn(reason, F.lit("NAME_PATTERN"))


def synthesize_key(owner: Column, package: Column, name: Column, overload: Column) -> Column:
    """OWNER[.PKG].NAME[#overload]; the number stands if it is above 0 or a package is there."""
    has = F.coalesce(package, F.lit("")) != ""
    n = F.coalesce(overload.cast("int"), F.lit(0))
    base = F.concat_ws(".", owner, F.when(has, package), name)
    return F.when((n > 0) | has, F.concat(base, F.lit("#"), n.cast("string"))).otherwise(base)


def unsized(df: DataFrame) -> DataFrame:
    """A side that grows with the units or their lines: joined by sorting, never broadcast.  Spark
    takes an exploded or compressed table for as small as its file, so that its own threshold lets
    millions of rows into the driver."""
    return df.hint("merge")


def lookup_default(df: DataFrame, side: DataFrame, keys: Sequence[str], values: dict[str, object]) -> DataFrame:
    """Left join to a side with unique keys; missing values get their default."""
    joined = df.join(side.select(*keys, *values), list(keys), "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(v), F.lit(d)).alias(v) for v, d in values.items()))


def semi_flag(df: DataFrame, side: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Y if the keys are in the side, else N."""
    present = side.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return df.join(present, list(keys), "left").select(*df.columns, F.when(F.col("__hit"), "Y").otherwise("N").alias(flag))


def additive_counts(df: DataFrame, sides: Sequence[DataFrame], keys: Sequence[str], name: str) -> DataFrame:
    """The sum of each key's rows in several sides, 0 if none; counted before the join."""
    counted = reduce(DataFrame.unionByName, [s.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for s in sides])
    return lookup_default(df, unsized(counted.groupBy(*keys).agg(F.sum(name).alias(name))), keys, {name: 0})


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first by the order.  An aggregate, so that rows of a hot key
    are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    key = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*rest), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))).alias("__first")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest)).select(*df.columns)


def priority_lookup(df: DataFrame, tiers: Sequence[tuple[DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """The value of the first tier that has the row's key, null if none has it."""
    out, names = df, []
    for i, (side, keys) in enumerate(tiers):
        names.append(f"__v{i}")
        out = out.join(side.select(*keys, F.struct(F.col(value)).alias(f"__v{i}")), list(keys), "left")
    return out.select(*df.columns, F.coalesce(*names)[value].alias(value))


def anti(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't in the side."""
    return df.join(side.select(*keys).distinct(), list(keys), "left_anti")


def single_else(df: DataFrame, key: str, target: str, otherwise: Column | str, name: str = "resolved") -> DataFrame:
    """For each key: its target if it has exactly one, else the aggregate name."""
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return df.groupBy(key).agg(F.count_distinct(target).alias("n_targets"), F.min(target).cast("string").alias("one")).select(key, "n_targets", F.when(F.col("n_targets") == 1, F.col("one")).otherwise(other).alias(name))


def slices(df: DataFrame, by: Sequence[str], order: str, starts: Column, last: Column | None = None) -> DataFrame:
    """Slices from each start row to the row before the next: start and end by lead()."""
    w = Window.partitionBy(*by).orderBy(order)
    end = F.lead(order).over(w) - 1
    heads = df.where(starts).select(*df.columns, F.col(order).alias("slice_start"), end.alias("slice_end"))
    return heads if last is None else heads.withColumn("slice_end", F.coalesce("slice_end", last))


def assign_slice(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], start_value: Column, name: str) -> DataFrame:
    """The value of the latest start row at or before each row: a range join without a range join."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(start_value, ignorenulls=True).over(w))


def containment(texts: DataFrame, id_col: str, tokens: Column, names: DataFrame, name_col: str) -> DataFrame:
    """Pairs (id, name) of names that are tokens of a text: an equi-join on distinct tokens
    instead of every text against every name."""
    spread = texts.select(id_col, F.explode(F.array_distinct(tokens)).alias(name_col))
    return spread.join(names.select(name_col).distinct(), name_col).select(id_col, name_col)


def tristate(df: DataFrame, allowed: DataFrame, keys: Sequence[str], same: Column, name: str) -> DataFrame:
    """Y where the condition holds or the keys are allowed, else N."""
    hit = allowed.select(*keys).distinct().withColumn("__ok", F.lit(True))
    return df.join(hit, list(keys), "left").select(*df.columns, F.when(same | F.coalesce("__ok", F.lit(False)), "Y").otherwise("N").alias(name))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """kind (NEW, REMOVED, CHANGED), key, column, old and new text; two nulls are equal."""
    a = old.select(F.col(key), F.lit(True).alias("__a"), *(F.col(c).cast("string").alias(f"__o_{c}") for c in columns))
    b = new.select(F.col(key), F.lit(True).alias("__b"), *(F.col(c).cast("string").alias(f"__n_{c}") for c in columns))
    both = a.join(b, key, "full")
    text = F.lit(None).cast("string")
    whole = both.where(F.col("__a").isNull() | F.col("__b").isNull()).select(
        F.when(F.col("__a").isNull(), "NEW").otherwise("REMOVED").alias("kind"), F.col(key).cast("string").alias("key"), text.alias("column"), text.alias("old"), text.alias("new")
    )
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__o_{c}").alias("old"), F.col(f"__n_{c}").alias("new")) for c in columns))
    cell = both.where("__a and __b").select(F.col(key).cast("string").alias("key"), F.explode(cells).alias("c")).where(~F.col("c.old").eqNullSafe(F.col("c.new")))
    return whole.unionByName(cell.select(F.lit("CHANGED").alias("kind"), "key", "c.column", "c.old", "c.new"))


def wide_join(base: DataFrame, sides: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Chained left joins; a column that is there already gets the side's suffix."""
    out = base
    for side, suffix in sides:
        for c in side.columns:
            if c != key and c in out.columns:
                side = side.withColumnRenamed(c, c + suffix)
        out = out.join(side, key, "left")
    return out


def collisions(df: DataFrame, key: Sequence[str], value: str, least: int = 2, by_rows: bool = False) -> DataFrame:
    """Keys with several distinct values (or rows), and those values joined in order."""
    values = F.array_sort(F.collect_set(F.col(value).cast("string")))
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), values.alias("v")).where((F.col("n_rows") if by_rows else F.size("v")) >= least).select(*key, "n_rows", F.size("v").cast("long").alias("n_values"), F.array_join("v", ";").alias("value_list"))


def repeated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of keys that occur more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(many, list(keys), "left_semi")


def containing(df: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[str]) -> DataFrame:
    """Keys whose values include all the wanted ones."""
    return df.groupBy(*keys).agg(*(F.bool_or(F.col(value) == v).alias(f"__h{i}") for i, v in enumerate(wanted))).where(reduce(Column.__and__, [F.col(f"__h{i}") for i in range(len(wanted))])).select(*keys)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def joined_list(value: Column | str, separator: str = ";") -> Column:
    """Sorted values of a group in one text."""
    c = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.array_sort(F.collect_list(c.cast("string"))), separator)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows; each task keeps k, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def promote(df: DataFrame, group: str, value: str, ranks: Sequence[str]) -> DataFrame:
    """Each member of a group gets the group's value of highest rank; promoted tells if it changed."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(value))
    best = df.groupBy(group).agg(F.max_by(value, rank).alias("__best"))
    return df.join(best, group).select(*(F.col("__best").alias(c) if c == value else F.col(c) for c in df.columns), (F.col(value) != F.col("__best")).alias("promoted"))
