"""Scalar column functions with SQL semantics that the oracle engine shares."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_away(x: str | Column, places: int = 0) -> Column:
    """Round the binary value, halves away from zero (Spark's round works on the decimal text)."""
    x, scale = col(x).cast("double"), float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def to_int(x: str | Column) -> Column:
    """Double to integer, halves to even; null if it doesn't fit."""
    return F.rint(col(x)).try_cast("int")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b in doubles; null where b is null or 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def to_date(x: str | Column) -> Column:
    """Date of a date, timestamp or ISO text; null where it is none (as in ranges)."""
    return col(x).try_cast("date")


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(to_date(end), to_date(start))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def value_map(x: str | Column, mapping: dict) -> Column:
    """The mapped value; null for values that the map lacks."""
    return reduce(lambda case, kv: case.when(col(x) == kv[0], F.lit(kv[1])), mapping.items(), F)


def month_pick(month: str | Column, columns: list[str]) -> Column:
    """Of twelve columns the one of the month (1 to 12); null for other months."""
    return F.get(F.array(*[col(c) for c in columns]), col(month).cast("int") - 1)


def occurrences(x: str | Column, part: str) -> Column:
    """How often a text holds a part; 0 for null."""
    x = F.coalesce(col(x), F.lit(""))
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def weighted_sum(weights: dict[str, float]) -> Column:
    return reduce(add, [F.lit(w) * col(c) for c, w in weights.items()])


def weighted_or_zero(weights: dict[str, float]) -> Column:
    """Weighted sum; 0 as soon as one term is null."""
    return F.coalesce(weighted_sum(weights), F.lit(0.0))


def logistic_decay(distance: str | Column, middle: float = 10.0, steepness: float = 0.5) -> Column:
    """1 near 0, one half at ``middle``, 0 far away."""
    return 1 / (1 + F.exp(steepness * (col(distance) - middle)))


def joined_key(*columns: str | Column) -> Column:
    """Values joined by underscores; null if one is null."""
    parts = [col(c).cast("string") for c in columns]
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("_", *parts))


def as_json(columns: list[str]) -> Column:
    """The columns as the text of a JSON object."""
    return F.to_json(F.struct(*columns))


def json_int(x: str | Column, path: str) -> Column:
    return F.get_json_object(col(x), path).try_cast("int")


def json_text(x: str | Column, path: str) -> Column:
    return F.get_json_object(col(x), path)


def json_entries(x: str | Column) -> Column:
    """Map of an object's entries as text; null for anything else."""
    return F.from_json(col(x), "map<string,string>")


def first_or_scalar(x: Column) -> Column:
    """The first element of a JSON array's text, else the text itself."""
    return F.when(x.startswith("["), F.get_json_object(x, "$[0]")).otherwise(x)


def json_members(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a row for each member of a JSON object or item of an array: ``pos, key, value`` (a variant, so that
    types are kept and nested values can be reached), ``kind``, the value's type; none for null and bad text."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(column)))
    members = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    return members.drop("__v").withColumn("kind", F.schema_of_variant("value"))
