"""Scaling, encoding and splitting of feature tables."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations
from operator import add, or_

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import joined_key, ratio
from ..sources.landed import stored_table
from .aggregates import before_slices, exact_quantiles, in_slices


def scaled(df: DataFrame, linear: list[str] = (), log: list[str] = ()) -> DataFrame:
    """Columns brought to 0..1: (x - min) / (max - min), or log(1 + x) over its maximum; null
    where the divisor is 0.  One aggregate finds all bounds."""
    bounds = df.agg(
        *(F.min(c).cast("double").alias(f"__a_{c}") for c in linear),
        *(F.max(c).cast("double").alias(f"__b_{c}") for c in linear),
        *(F.max(F.log1p(c)).alias(f"__l_{c}") for c in log),
    )
    new = {c: (F.col(c) - F.col(f"__a_{c}")) / F.nullif(F.col(f"__b_{c}") - F.col(f"__a_{c}"), F.lit(0.0)) for c in linear}
    new |= {c: F.log1p(c) / F.nullif(F.col(f"__l_{c}"), F.lit(0.0)) for c in log}
    return df.join(F.broadcast(bounds)).select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right, r`` of each pair of columns, from one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    entries = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(entries).alias("x")).select("x.*")


def principal_components(df: DataFrame, record: str, columns: list[str], explained: float = 0.99, prefix: str = "pca") -> DataFrame:
    """``record`` and as many principal components as explain the variance asked for."""
    centred = df.select(record, *columns).na.fill(0, columns)
    means = centred.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns))
    centred = centred.join(F.broadcast(means)).select(record, *((F.col(c) - F.col(f"__m_{c}")).alias(c) for c in columns))
    vectors = VectorAssembler(inputCols=columns, outputCol="__v").transform(centred)
    model = PCA(k=len(columns), inputCol="__v", outputCol="__p").fit(vectors)
    total, k = 0.0, 0
    while k < len(columns) and (k < 2 or total <= explained):
        total, k = total + float(model.explainedVariance[k]), k + 1
    values = vector_to_array(F.col("__p"))
    return model.transform(vectors).select(record, *(values[i].alias(f"{prefix}{i + 1}") for i in range(k)))


def encoded(df: DataFrame, record: str, columns: list[str] | None = None, limit: float = 0.8, explained: float = 0.99, rare_below: float = 0.01) -> DataFrame:
    """``record`` and principal components of the numeric columns that correlate with an earlier one
    beyond the limit, if there are two at least; else the table as it is, text columns as codes."""
    kinds = dict(df.dtypes)
    numeric = [c for c in (columns or df.columns) if c != record and kinds[c] not in ("string", "boolean", "date", "timestamp")]
    high = {r["right"] for r in correlations(df, numeric).filter(F.abs("r") > limit).select("right").distinct().collect()} if len(numeric) > 1 else set()
    chosen = [c for c in numeric if c in high]
    if len(chosen) > 1:
        return principal_components(df, record, chosen, explained)
    for c in [c for c in df.columns if c != record and kinds[c] == "string"]:
        df = factorized(df, c, rare_below, name=f"{c}_encoded").drop(c)
    return df


def encoded_table(spark: SparkSession, name: str, record: str, **options) -> DataFrame:
    """The table ``transformed.<name>``, or ``features.<name>`` where that is missing, encoded."""
    layer = "transformed" if spark.catalog.tableExists(f"transformed.{name}") else "features"
    return encoded(spark.table(f"{layer}.{name}"), record, **options)


def dense_codes(values: DataFrame, column: str, name: str) -> DataFrame:
    """``column, name``: the place, from 0, of each of some different values in their order.

    Places count within slices of the values, and only the slices' sizes meet in one place.
    """
    dealt = in_slices(values.select(column), column)
    starts = before_slices(dealt.groupBy("__p").agg(F.count("*").alias("__t"))).drop("__all")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1
    return dealt.withColumn("__i", place).join(F.broadcast(starts), "__p").select(column, (F.col("__s") + F.col("__i")).cast("int").alias(name))


def factorized(df: DataFrame, column: str, rare_below: float = 0.01, rare: str = "rare", name: str = "code") -> DataFrame:
    """``df`` with a code for the column's value, values of a smaller share of rows taken as
    ``rare``; codes count up with the value's text from 0, null has -1."""
    total = df.agg(F.count("*").alias("__all"))
    counts = df.groupBy(column).agg(F.count("*").alias("__n")).join(F.broadcast(total))
    kept = counts.withColumn("__v", F.when(F.col(column).isNotNull(), F.when(F.col("__n") / F.col("__all") < rare_below, F.lit(rare)).otherwise(F.col(column).cast("string"))))
    codes = dense_codes(kept.select("__v").filter("__v is not null").distinct(), "__v", name)
    table = kept.join(codes, "__v", "left").select(F.col(column).alias("__k"), F.coalesce(name, F.lit(-1)).alias(name))
    return df.join(table, F.col(column).eqNullSafe(F.col("__k"))).drop("__k")


#: Edges that are compared one by one, which Spark compiles; more would make more code than the JVM compiles, and go through a lambda.
COMPARED = 64


def quantile_bins(df: DataFrame, column: str, bins: int, name: str, source: DataFrame | None = None) -> DataFrame:
    """``df`` with the bin (from 0) of a column between its exact quantiles; equal edges are one.

    The quantiles are taken of ``source``, if given, which has the column's values without what ``df`` is joined to.
    """
    edges = exact_quantiles(df if source is None else source, column, [i / bins for i in range(bins + 1)]).select(F.array_distinct("edges").alias("__e"))
    edges = edges.select(F.slice("__e", F.lit(2), F.greatest(F.size("__e") - 2, F.lit(0))).alias("__e"))
    if bins <= COMPARED:
        below = reduce(add, (F.when(F.get("__e", F.lit(i)) < F.col(column), 1).otherwise(0) for i in range(bins - 1)), F.lit(0))
    else:
        below = F.size(F.filter("__e", lambda x: x < F.col(column)))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), below)).drop("__e")


def strata(df: DataFrame, space: str, species: str, time: str, space_bins: int = 10, time_bins: int = 12, rare_below: float = 0.01, name: str = "stratum") -> DataFrame:
    """``df`` with a composite stratum ``space_species_time``: quantile bins of place and time, codes
    of the species (rare ones are one), a text time as codes; strata of one row are ``mixed_stratum``,
    and so are rows with a null part."""
    out = quantile_bins(df, space, space_bins, "__a")
    out = factorized(out, species, rare_below, "rare_species", "__b")
    out = factorized(out, time, 0.0, name="__c") if dict(df.dtypes)[time] == "string" else quantile_bins(out, time, time_bins, "__c")
    out = out.withColumn("__s", joined_key("__a", "__b", "__c"))
    several = out.groupBy("__s").agg(F.count("*").alias("__n")).filter("__n > 1").select("__s", F.col("__s").alias(name))
    return out.join(several, "__s", "left").withColumn(name, F.coalesce(name, F.lit("mixed_stratum"))).select(*df.columns, name)


def stratified_split(df: DataFrame, record: str, stratum: str, parts: dict[str, float], seed: int = 42, name: str = "part") -> DataFrame:
    """``df`` with the part of each row, in the shares asked for within each stratum, by the
    percent rank of a seeded hash of the record.

    The hash's upper bits cut a stratum into 4096 even slices.  Their counts say in which of them a part
    ends; only rows of those slices are ranked, for the first row of the next part, and all rows are
    compared with these firsts, so that no row is shuffled for the split unless strata are many.
    Both small tables are written to the shared folder, so that they are found once.
    """
    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(record).cast("string"))).withColumn("__p", F.shiftright("__h", 52))
    edges = list(accumulate(parts.values()))[:-1]
    if not edges:
        return df.withColumn(name, F.lit(list(parts)[0]))
    share = lambda place: F.coalesce(ratio(place, F.col("__all") - 1), F.lit(0.0))
    order = Window.partitionBy("__g")
    counts = rows.groupBy(F.col(stratum).alias("__g"), "__p").agg(F.count("*").alias("__n"))
    counts = counts.select("__g", "__p", "__n", F.coalesce(F.sum("__n").over(order.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"), F.sum("__n").over(order).alias("__all"))
    ends = lambda edge: F.min(F.when(share(F.col("__s") + F.col("__n") - 1) >= edge, F.struct("__p", "__s")))
    slices = stored_table(counts.groupBy("__g").agg(F.first("__all").alias("__all"), *(ends(e).alias(f"__q{i}") for i, e in enumerate(edges))), "slices")

    met = rows.select(F.col(stratum).alias("__k"), "__h", "__p", F.col(record).alias("__id")).join(slices, F.col("__k").eqNullSafe(F.col("__g"))).drop("__k")
    here = [F.coalesce(F.col("__p") == F.col(f"__q{i}.__p"), F.lit(False)) for i in range(len(edges))]
    ranked = met.filter(reduce(or_, here)).withColumn("__r", F.rank().over(Window.partitionBy("__g", "__p").orderBy("__h", "__id")) - 1)
    firsts = [F.min(F.when(here[i] & (share(F.col(f"__q{i}.__s") + F.col("__r")) >= e), F.struct("__h", "__id"))).alias(f"__f{i}") for i, e in enumerate(edges)]
    cuts = stored_table(ranked.groupBy("__g").agg(*(F.first(f"__q{i}.__p").alias(f"__q{i}") for i in range(len(edges))), *firsts), "cuts")

    def before(i: int):
        """Whether a row comes before the end of part i; without that slice or row, all of it does."""
        at, end, first = F.col("__p"), F.col(f"__q{i}"), F.col(f"__f{i}")
        inside = (at == end) & (first.isNull() | (F.struct("__h", F.col(record).alias("__id")) < first))
        return end.isNull() | (at < end) | inside

    chosen = F.lit(list(parts)[-1])
    for i, part in reversed(list(enumerate(list(parts)[:-1]))):
        chosen = F.when(before(i), part).otherwise(chosen)
    return rows.join(cuts, F.col(stratum).eqNullSafe(F.col("__g")), "left").withColumn(name, chosen).select(*df.columns, name)


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """``column, information``: bits that each column, in quantile bins, tells of the target in such
    bins; rows with a null in either are left out of a pair."""
    known = df.select(*columns, target)
    rows = quantile_bins(known, target, bins, "__t", known)
    for c in columns:
        rows = quantile_bins(rows, c, bins, f"__b_{c}", known)
    pairs = rows.select("__t", *(F.col(f"__b_{c}").alias(c) for c in columns)).unpivot("__t", columns, "column", "b")
    cells = pairs.filter("__t is not null and b is not null").groupBy("column", "b", "__t").agg(F.count("*").cast("double").alias("c"))
    # At most bins * bins cells a column, so these windows are small, and a column's cells meet in one task for all of them.
    cells = cells.repartition("column")
    of = lambda *by: F.sum("c").over(Window.partitionBy("column", *by))
    return cells.select("column", (F.col("c") / of() * F.log2(F.col("c") * of() / (of("b") * of("__t")))).alias("i")).groupBy("column").agg(F.sum("i").alias("information"))
