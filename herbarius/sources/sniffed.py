"""Delimited files whose separator, quote and types are found out."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\t", ",", ";", "|")
QUOTES = ('"', "'")
#: Types by what all of a column's sampled values look like, the narrowest first.
TYPES = (
    (T.BooleanType(), r"true|false|TRUE|FALSE|True|False"),
    (T.LongType(), r"[+-]?[0-9]{1,18}"),
    (T.DoubleType(), r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"),
    (T.DateType(), r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    (T.TimestampType(), r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?"),
)
BAD = "malformed"


@dataclass
class Dialect:
    """How a file is written; ``quote`` is None where none is used."""

    separator: str
    quote: str | None
    header: bool
    schema: T.StructType


def _fields(lines: list[str], separator: str, quote: str | None) -> list[list[str]]:
    return list(csv.reader(lines, delimiter=separator, quotechar=quote or '"', quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE))


def _kind(values: list[str]) -> T.DataType:
    known = [v for v in values if v != ""]
    return next((kind for kind, pattern in TYPES if known and all(re.fullmatch(pattern, v) for v in known)), T.StringType())


def dialect(lines: list[str]) -> Dialect:
    """What a sample of lines is written in.

    The separator that most lines have equally often, and then often, wins; a quote counts if some field
    begins and ends with it and lines agree no less with it than without.  The first line is a header unless one of its fields is a
    number or empty.  A line that most others disagree with, as to fields, has no say on types.
    """
    lines = [x for x in lines if x.strip()]
    if not lines:
        return Dialect(",", None, False, T.StructType([]))
    best = None
    for separator in SEPARATORS:
        for quote in (None, *QUOTES):
            if quote and not any(re.search(rf"(^|{re.escape(separator)}){quote}.*{quote}({re.escape(separator)}|$)", x) for x in lines):
                continue
            rows = _fields(lines, separator, quote)
            sizes = [len(r) for r in rows]
            usual = max(set(sizes), key=lambda n: (sizes.count(n), n))
            score = (usual > 1, sizes.count(usual) / len(sizes), quote is not None, usual)
            if best is None or score > best[0]:
                best = (score, separator, quote, rows, usual)
    _, separator, quote, rows, usual = best
    sound = [r for r in rows if len(r) == usual]
    header = all(x and not re.fullmatch(TYPES[2][1], x) for x in rows[0]) and (len(rows) == 1 or any(x not in [r[i] for r in sound[1:]] for i, x in enumerate(rows[0])))
    names = rows[0] if header else [f"_c{i}" for i in range(usual)]
    body = sound[1:] if header and sound and sound[0] is rows[0] else sound
    kinds = [_kind([r[i] for r in body]) if i < usual else T.StringType() for i in range(len(names))]
    seen: dict[str, int] = {}
    fields = []
    for name, kind in zip(names, kinds, strict=True):
        seen[name] = seen.get(name, -1) + 1
        fields.append(T.StructField(name if not seen[name] else f"{name}_{seen[name]}", kind))
    return Dialect(separator, quote, header, T.StructType(fields))


def sniff(spark: SparkSession, path: str, sample: int = 1000) -> Dialect:
    """The dialect of a file or folder by its first ``sample`` lines."""
    return dialect([r[0] for r in spark.read.text(path).limit(sample).collect()])


def sniffed_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sample: int = 1000, bad: str = BAD) -> DataFrame:
    """A delimited file in one scan with types, and a column ``bad`` with the text of lines that don't fit them.

    Such a line keeps what could be read of it; no line is lost.  Types are of the sample, so a line further on that
    doesn't fit is in ``bad`` too.  ``columns`` is pushed into the scan, and coordinates come as a struct
    ``geom`` as in :func:`..landed.occurrences`.
    """
    found = sniff(spark, path, sample)
    taken = {f.name.lower() for f in found.schema}
    while bad.lower() in taken:
        bad += "_"
    schema = T.StructType([*found.schema.fields, T.StructField(bad, T.StringType())])
    reader = spark.read.schema(schema).option("sep", found.separator).option("header", found.header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("enforceSchema", True)
    df = reader.option("quote", found.quote or "\0").option("escape", found.quote or "\\").csv(path)
    df = df.select(*columns, bad) if columns else df
    if {"decimalLongitude", "decimalLatitude"} <= set(df.columns):
        df = df.withColumn("geom", F.struct(F.col("decimalLongitude").cast("double").alias("x"), F.col("decimalLatitude").cast("double").alias("y")))
    return df
