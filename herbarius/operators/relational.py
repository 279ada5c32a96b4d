"""Joins, set operations and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.zorder import Area


def in_values(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is in the other table (SQL IN)."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_semi").select(df.columns)


def not_in_values(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key isn't in the other table, by SQL's rules for nulls (NOT IN): none if
    the other table has a null, all if it is empty, no rows of null key otherwise.

    A flag from one small aggregate stands in for the null-aware join, so large sides meet in
    an ordinary shuffled anti join.
    """
    keys = other.select(F.col(other_key).alias(key))
    facts = keys.agg(F.count("*").alias("n"), F.count(key).alias("n_known"))
    name = "__facts"
    flagged = df.join(F.broadcast(facts.select(F.struct("n", "n_known").alias(name))))
    kept = flagged.filter((F.col(f"{name}.n") == 0) | ((F.col(f"{name}.n") == F.col(f"{name}.n_known")) & F.col(key).isNotNull()))
    return kept.join(keys.filter(F.col(key).isNotNull()), key, "left_anti").select(df.columns)


def with_existence(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """``df`` with 1 where its key is in the other table, else 0."""
    found = other.filter(F.col(other_key).isNotNull()).select(F.col(other_key).alias(key)).distinct().withColumn(name, F.lit(1))
    return df.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(0))).select(*df.columns, name)


def merge_all(base: DataFrame, parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Join (table, key, how) after (table, key, how) to a base."""
    return reduce(lambda a, part: a.join(part[0], part[1], part[2]) if part[2] != "cross" else a.crossJoin(part[0]), parts, base)


def append(first: DataFrame, second: DataFrame, drop: list[str] = ()) -> DataFrame:
    """Rows of both, the second's columns cast to the first's types, some of them dropped."""
    types = dict(first.dtypes)
    second = second.drop(*drop)
    return first.unionByName(second.select(*(F.col(c).cast(types[c]).alias(c) for c in second.columns)), allowMissingColumns=True)


def column_list(**tables: DataFrame) -> DataFrame:
    """``col, table_name`` of each column of each table."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(c, name) for name, df in tables.items() for c in df.columns], "col string, table_name string")


def predicate(fields: dict, joined: str = "and") -> Column:
    """A condition from a description: a list means one of, a (op, value) pair a comparison
    (``>``, ``>=``, ``<``, ``<=``, ``!=``), an :class:`Area` a place within it, anything else equality;
    joined by and / or."""
    compare = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "!=": Column.__ne__}

    def one(name, value):
        if isinstance(value, list):
            return F.col(name).isin(value)
        if isinstance(value, Area):
            return value.condition()
        if isinstance(value, tuple):
            return compare[value[0]](F.col(name), value[1])
        return F.col(name) == value

    parts = [one(k, v) for k, v in fields.items()]
    return reduce((lambda a, b: a & b) if joined == "and" else (lambda a, b: a | b), parts)


def occurrence_predicate(settings: dict, x: str = "decimalLongitude", y: str = "decimalLatitude", key: str | None = None) -> Column:
    """A condition from settings by field in capitals: GEOMETRY is an area's text, YEAR the last one before, LIMIT no condition,
    a list one of; records have coordinates and are present."""
    fields = {"hasCoordinate": True, "occurrenceStatus": "PRESENT"}
    for name, value in settings.items():
        if name == "GEOMETRY":
            fields[name] = Area(value, x, y, key)
        elif name != "LIMIT":
            first, *rest = name.lower().split("_")
            fields[first + "".join(w.capitalize() for w in rest)] = (">", value) if name == "YEAR" else value
    return predicate(fields)


def top_or_other(df: DataFrame, column: str, k: int, other: str = "Other", name: str = "category") -> DataFrame:
    """``df`` with the column's value if it is one of its k most frequent (ties by value), else ``other``."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    best = counts.orderBy(F.desc("__n"), F.col(column).asc_nulls_last()).limit(k).select(column)
    return df.join(F.broadcast(best.withColumn(name, F.col(column))), column, "left").withColumn(name, F.coalesce(name, F.lit(other)))


def running_lag(df: DataFrame, by: list[str], order: str, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())))
