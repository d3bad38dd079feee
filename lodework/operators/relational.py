"""Operators over index-shaped tables. Each takes DataFrames and column names, so the same code serves the archive
index (entries, file_ids, chunks) and any other table of that shape. Ties always have a tiebreak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, *by: str, non_empty: bool = False, alias: str = "n") -> DataFrame:
    """Counts by one or more columns, most frequent first, ties by the columns."""
    if non_empty:
        for c in by:
            df = df.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return df.groupBy(*by).agg(F.count("*").alias(alias)).orderBy(F.desc(alias), *by)


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order: a single top-k with an offset."""
    return df.orderBy(*order).offset(offset).limit(limit)


def optional_filter(df: DataFrame, equal: dict[str, object] | None = None, *, where: Sequence[Column] = ()) -> DataFrame:
    """The conjunction of the conditions whose value isn't None."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    for w in where:
        df = df.where(w)
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in order."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct().orderBy(column)


def children(df: DataFrame, key: str, order: Sequence[str], label: Column, alias: str, sep: str = ";") -> DataFrame:
    """For each key its children's labels in order, joined."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], label.alias("label"))))
    return df.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["label"]), sep).alias(alias))


def first_n(values: Column, n: int = 8) -> Column:
    """The first n of an array joined by commas, with an ellipsis where there are more."""
    head = F.array_join(F.slice(values, 1, n), ",")
    return F.when(F.size(values) > n, F.concat(head, F.lit(",..."))).otherwise(head)


def invert(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """For each key its sorted values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(alias))


def id_contains(column: str, query: int) -> Column:
    """Whether a number's digits hold the query's; 0 asks for all."""
    return F.lit(True) if query == 0 else F.contains(F.col(column).cast("string"), F.lit(str(query)))


def changed(now: DataFrame, before: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows of `now` that `before` hasn't with this fingerprint."""
    return now.join(before.select(key, fingerprint), [key, fingerprint], "left_anti")


def fingerprint(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def arg_max_first(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """For each key its row of largest score, the first in order among equals."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), order))
    return df.withColumn("_r", best).where("_r = 1").drop("_r")


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def last_wins(df: DataFrame, key: str, value: str, order: str, alias: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(alias))


def upper_median(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """(key, value, k, alias): each distinct value of a key with its count and the key's upper median, the element at n div 2
    of its sorted values. Counts are combined before the shuffle, so a group's rows never meet in one list: the median
    is where the running count passes half."""
    by = df.groupBy(key, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(key)
    ranked = by.withColumn("_upto", F.sum("k").over(w.orderBy(value))).withColumn("_n", F.sum("k").over(w))
    held = F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col(value))
    return ranked.withColumn(alias, F.min(held).over(w)).drop("_upto", "_n")


def two_level(specific: Column, general: Column, known: Column, version: Column) -> Column:
    """A container's own variant, else the global one, else ?v<version> where the name is known at all, else empty."""
    return F.coalesce(specific, general, F.when(known, F.concat(F.lit("?v"), version.cast("string"))), F.lit(""))


def step_scan(df: DataFrame, index: str, step: int, start: int = 0) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(step)) == start)


def adjacent_double(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Rows whose neighbour before, in the group's order, has half their size."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("prev_key", F.lag(order).over(w)).withColumn("prev_size", F.lag(size).over(w)).where(F.col(size) == 2 * F.col("prev_size"))
