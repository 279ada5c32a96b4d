"""Group statistics without fan-out joins, shares, gaps and ranks."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import days_between, ratio, round_half_away, to_date
from ..sources.landed import checkpointed


def entropy(df: DataFrame, by: str, value: str, name: str = "entropy", places: int = 4) -> DataFrame:
    """``by`` and the Shannon entropy (bits) of ``value`` within it.

    From counts c of total n: log2(n) - sum(c log2 c) / n, so one group-by over the counts
    does, with no window over the groups.
    """
    counts = df.groupBy(by, value).agg(F.count("*").cast("double").alias("c"))
    sums = counts.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select(by, round_half_away(F.abs(F.log2("n") - F.col("s") / F.col("n")), places).alias(name))


def mean_of_counts(df: DataFrame, by: str, parts: list[str], name: str, places: int = 2) -> DataFrame:
    """``by`` and the mean number of rows of its parts."""
    return df.groupBy(by, *parts).agg(F.count("*").alias("c")).groupBy(by).agg(round_half_away(F.avg("c"), places).alias(name))


def share_of_total(df: DataFrame, by: str, value: str, name: str = "share") -> DataFrame:
    """``by, value, n`` and the share of the value in its group."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def mean_gap(df: DataFrame, by: str, date: str, name: str) -> DataFrame:
    """``by`` and the mean number of days between one row's date and the next's (null for one row).

    The gaps of dated rows telescope: (last - first) / (rows - 1); no sort is needed.
    """
    dates = df.select(by, to_date(date).alias("d")).groupBy(by).agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("d").alias("n"))
    return dates.select(by, ratio(F.datediff("b", "a"), F.col("n") - 1).alias(name))


def _by_sets(rows: DataFrame, who: str, sets: dict[str, list[str]], *extra) -> tuple[DataFrame, callable]:
    """Rows counted (``__c``) by ``who`` and each of some sets of columns, in one shuffle that
    spreads a frequent ``who`` by the sets' values; and a function (set, column) -> column there, else null."""
    columns = [who, *dict.fromkeys(c for s in sets.values() for c in s)]
    number = {n: sum(1 << i for i, c in enumerate(reversed(columns)) if c != who and c not in s) for n, s in sets.items()}
    grouped = rows.groupingSets([[who, *s] for s in sets.values()], *columns).agg(F.count("*").cast("double").alias("__c"), F.grouping_id().alias("__g"), *extra)
    return grouped, lambda name, x: F.when(F.col("__g") == number[name], x)


def _entropy(counts, places: int = 4):
    """Entropy (bits) of counts that a group holds."""
    n = F.sum(counts)
    return round_half_away(F.abs(F.log2(n) - F.sum(counts * F.log2(counts)) / n), places)


def activity(df: DataFrame, who: str, record: str, species: str, date: str, prefix: str = "") -> DataFrame:
    """Profile of each ``who``: diversity, counts, days and years of activity, rates and gaps.

    One pass counts by species, month, year, day and record; a second aggregate takes all
    figures from these counts.  Rows of null ``who`` have no profile.
    """
    rows = df.filter(F.col(who).isNotNull()).select(who, record, species, to_date(date).alias("__d")).withColumns({"__y": F.year("__d"), "__m": F.month("__d")})
    counts, of = _by_sets(rows, who, {"species": [species], "month": ["__y", "__m"], "year": ["__y"], "day": ["__d"], "record": [record]})
    c, dated = F.col("__c"), of("day", F.col("__d"))
    got = counts.groupBy(who).agg(
        F.count(of("record", F.col(record))).alias("obs_count"),
        F.count(of("year", F.col("__y"))).alias("unique_years"),
        F.count(dated).alias("unique_dates"),
        _entropy(of("species", c)).alias("species_diversity"),
        round_half_away(F.avg(of("month", c)), 2).alias("avg_monthly_obs"),
        round_half_away(F.avg(of("year", c)), 2).alias("avg_yearly_obs"),
        ratio(F.datediff(F.max(dated), F.min(dated)), F.sum(F.when(dated.isNotNull(), c)) - 1).alias("avg_obs_time"),
    )
    got = got.withColumn("obs_per_year", ratio("obs_count", "unique_years"))
    return got.select(who, *(F.col(x).alias(prefix + x) for x in ("obs_count", "unique_years", "unique_dates", "obs_per_year", "species_diversity", "avg_monthly_obs", "avg_yearly_obs", "avg_obs_time")))


def identifications(df: DataFrame, who: str, author: str, species: str, observed: str, identified: str) -> DataFrame:
    """Profile of those who identify other people's records, in one pass over them."""
    rows = df.filter(F.col(who) != F.col(author)).withColumns({"__d": to_date(observed), "__lag": F.abs(days_between(observed, identified))}).withColumns({"__y": F.year("__d"), "__m": F.month("__d")})
    # Undealt rows meet nearly every group in every task.  By who and year each task has groups of its own, as many as fit
    # Spark's advisory size of a partition, and a frequent who's rows go to several.
    rows = rows.select(who, species, "__y", "__m", "__lag").hint("rebalance", F.col(who), F.col("__y"))
    counts, of = _by_sets(rows, who, {"species": [species], "month": ["__y", "__m"], "year": ["__y"]}, F.sum("__lag").alias("__s"), F.count("__lag").alias("__n"))
    c = F.col("__c")
    return counts.groupBy(who).agg(
        F.sum(of("year", c)).cast("long").alias("id_count"),
        round_half_away(ratio(F.sum(of("year", F.col("__s"))), F.sum(of("year", F.col("__n")))), 2).alias("avg_id_time"),
        _entropy(of("species", c)).alias("id_species_entropy"),
        round_half_away(F.avg(of("month", c)), 2).alias("id_avg_monthly_obs"),
        round_half_away(F.avg(of("year", c)), 2).alias("id_avg_yearly_obs"),
    )


def log_z_scores(df: DataFrame, columns: list[str], suffix: str = "_log_z") -> DataFrame:
    """``df`` with (log10(1 + x) - mean) / deviation of each column; null where that is 0."""
    logs = {c: F.log10(1 + F.col(c)) for c in columns}
    stats = df.agg(*(F.avg(x).alias(f"__m_{c}") for c, x in logs.items()), *(F.stddev_pop(x).alias(f"__s_{c}") for c, x in logs.items()))
    return df.join(F.broadcast(stats)).select(*df.columns, *(((x - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))).alias(f"{c}{suffix}") for c, x in logs.items()))


def in_slices(values: DataFrame, column: str) -> DataFrame:
    """Different values of a column, nulls last, sorted over all partitions: ``__p`` numbers the slices in their order.

    The slices are Spark's own range partitions, so there are as many as the session's shuffle partitions ask for.
    They are written to the shared folder, as a second sort might cut them elsewhere.
    """
    return checkpointed(values.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("__p", F.spark_partition_id()))


def before_slices(totals: DataFrame) -> DataFrame:
    """Of a row ``__p, __t`` for each slice, what the slices before have as ``__s``, and all of them as ``__all``."""
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__p", F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__s"), F.sum("__t").over(Window.partitionBy()).alias("__all"))


def running_counts(df: DataFrame, column: str) -> DataFrame:
    """``__v, __n, __before, __all``: each value of a column, its rows, rows of smaller values, all rows; nulls last.

    Rows are counted by value; running counts form within slices of values (:func:`in_slices`), and
    only the slices' totals meet in one place.
    """
    counts = in_slices(df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n")), "__v")
    before = Window.partitionBy("__p").orderBy(F.col("__v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sliced = counts.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    starts = before_slices(counts.groupBy("__p").agg(F.sum("__n").alias("__t")))
    return sliced.join(F.broadcast(starts), "__p").select("__v", "__n", (F.col("__s") + F.col("__b")).alias("__before"), "__all")


def percent_rank(df: DataFrame, column: str, name: str, places: int = 3) -> DataFrame:
    """``df`` with the global percent rank of a column, nulls last (see :func:`running_counts`)."""
    ranks = running_counts(df, column).select("__v", F.coalesce(ratio("__before", F.col("__all") - 1), F.lit(0.0)).alias(name))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("__v"))).drop("__v").withColumn(name, round_half_away(name, places))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with ``edges``: the exact quantiles of a column without its nulls, linear between
    neighbours; empty for no values.  Only the values at the ranks asked for leave their slices."""
    counts = running_counts(df.filter(F.col(column).isNotNull()), column)
    # Compared with each rank as it is: a lambda over the ranks isn't compiled, and there is a row for each different value.
    places = [F.lit(float(p)) * (F.col("__all") - 1) for p in shares]
    ranks = [f(x).cast("long") for x in places for f in (F.floor, F.ceil)]
    at = lambda r: F.when((r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")), F.col("__v").cast("double"))
    row = counts.agg(F.max("__all").alias("n"), *(F.max(at(r)).alias(f"v{i}") for i, r in enumerate(ranks)))

    def edge(i: int, p: float):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return row.select(F.filter(F.array(*(edge(i, p) for i, p in enumerate(shares))), lambda x: x.isNotNull()).alias("edges"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, n_null, n_distinct``: one row per column, from one pass."""
    row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"k_{c}") for c in columns), *(F.count_distinct(c).alias(f"d_{c}") for c in columns))
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), (F.col("n") - F.col(f"k_{c}")).alias("n_null"), F.col(f"d_{c}").alias("n_distinct")) for c in columns])
    return row.select(F.explode(entries).alias("x")).select("x.*")


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, n_null, least, greatest, mean, variance`` of numeric columns (sample variance), from one pass."""
    stats = {"known": F.count, "least": F.min, "greatest": F.max, "mean": F.avg, "variance": F.var_samp}
    row = df.agg(F.count("*").alias("n"), *(f(F.col(c).cast("double")).alias(f"{s}_{c}") for c in columns for s, f in stats.items()))
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), (F.col("n") - F.col(f"known_{c}")).alias("n_null"), *(F.col(f"{s}_{c}").alias(s) for s in list(stats)[1:])) for c in columns])
    return row.select(F.explode(entries).alias("x")).select("x.*")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``n, n_duplicate``: rows, and rows that repeat another in the columns (all if none are given)."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicate"))


def row_shares(df: DataFrame, columns: list[str], suffix: str = "_per") -> DataFrame:
    """``df`` with the sum of some columns of a row, nulls as 0, and each one's share of it (null for a sum of 0)."""
    total = reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    return df.withColumn("sum", total).withColumns({f"{c}{suffix}": ratio(c, "sum") for c in columns})
