"""The engine's operators over the test tables, each with its SQL.

Roles: orders stand for observations (customer the observer, priority the species), line items
for identifications, synthetic coordinates come from integer keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import geo as G
from .functions.zorder import Area
from .operators import aggregates as A
from .operators import models as M
from .operators import prep as P
from .operators import relational as R
from .operators import spatial as S
from .plans import clean
from .plans.score import DEGREES, METRES
from .sources.keyed import KeyedTable
from .sources.landed import fresh_folder
from .sources.places import save_places
from .sources.sniffed import sniffed_csv
from .streaming.landing import keep_once, kept, landing_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Synthetic coordinates of a key, as SQL that both engines read.
LON, LAT = "((({k} * 37) % 4001) / 1000.0 - 74)", "((({k} * 91) % 2003) / 1000.0 + 45)"


def lon(k: str):
    return (F.col(k) * 37 % 4001) / F.lit(1000.0) - 74


def lat(k: str):
    return (F.col(k) * 91 % 2003) / F.lit(1000.0) + 45


def sql_round(x: str, n: int = 6) -> str:
    return f"sign(CAST({x} AS DOUBLE)) * floor(abs(CAST({x} AS DOUBLE)) * 1e{n} + 0.5) / 1e{n}"


# Projections and filters


@query("SELECT o_orderkey AS id, CAST(day(o_orderdate) AS INTEGER) AS tempo_day, CAST(month(o_orderdate) AS INTEGER) AS tempo_month, CAST(year(o_orderdate) AS INTEGER) AS tempo_year FROM orders")
def scan_project_rename(s, d):
    return t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.dayofmonth("o_orderdate").alias("tempo_day"), F.month("o_orderdate").alias("tempo_month"), F.year("o_orderdate").alias("tempo_year"))


@query("SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")
def star_exclude(s, d):
    return t(s, d, "orders").drop("o_orderpriority", "o_orderdate")


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity < 30 AND month(l_shipdate) >= 4 AND month(l_shipdate) < 9 AND l_returnflag = 'R' AND l_tax IS NOT NULL")
def clean_filter_conjunction(s, d):
    m = F.month("l_shipdate")
    return t(s, d, "lineitem").filter((F.col("l_quantity") < 30) & (m >= 4) & (m < 9) & (F.col("l_returnflag") == "R") & F.col("l_tax").isNotNull()).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE nullif(event_type, 'error') IS NULL) AS BIGINT) AS n_null, CAST(count(nullif(event_type, 'error')) AS BIGINT) AS n_known FROM events")
def null_checks(s, d):
    x = F.nullif(F.col("event_type"), F.lit("error"))
    return t(s, d, "events").agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.count(x).alias("n_known"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR c_custkey IN (1, 5, 9)")
def in_list_or_null(s, d):
    x = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t(s, d, "customer").filter(x.isNull() | F.col("c_custkey").isin(1, 5, 9)).select("c_custkey", x.alias("segment"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join_in_subquery(s, d):
    return R.in_values(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", t(s, d, "customer").filter("c_acctbal > 5000"), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def null_aware_not_in(s, d):
    return R.not_in_values(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", t(s, d, "customer").filter("c_acctbal > 5000"), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 7) FROM customer WHERE c_acctbal > -100000)")
def null_aware_not_in_with_null(s, d):
    keys = t(s, d, "customer").select(F.nullif(F.col("c_custkey"), F.lit(7)).alias("k"))
    return R.not_in_values(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", keys, "k").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END AS matched FROM orders")
def existence_flag(s, d):
    return R.with_existence(t(s, d, "orders").select("o_orderkey"), "o_orderkey", t(s, d, "lineitem").filter("l_returnflag = 'R'"), "l_orderkey", "matched")


@query("SELECT l_orderkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey")
def column_inequality(s, d):
    rows = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.filter("s_nationkey <> c_nationkey").select("l_orderkey", "l_suppkey", "o_custkey")


@query("SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 11 WHEN 'purchase' THEN 13 END AS INTEGER) AS code FROM events")
def value_map_case(s, d):
    return t(s, d, "events").select("event_id", C.value_map("event_type", {"click": 10, "view": 11, "purchase": 13}).alias("code"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part")
def searched_case(s, d):
    return t(s, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("size_class"))


@query("SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def predicate_builder(s, d):
    return t(s, d, "orders").filter(R.predicate({"o_orderstatus": ["O", "F"], "o_totalprice": (">", 100000), "o_orderpriority": "1-URGENT"}))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 200000")
def predicate_builder_or(s, d):
    return t(s, d, "orders").filter(R.predicate({"o_orderstatus": "P", "o_totalprice": (">", 200000)}, "or")).select("o_orderkey")


# Joins and set operations


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice IS NOT NULL")
def inner_equi_join(s, d):
    return t(s, d, "orders").filter("o_totalprice is not null").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_partkey, l_quantity, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size = CAST(l_quantity AS INTEGER)")
def left_composite_join(s, d):
    right = t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("__q"), "p_brand")
    return t(s, d, "lineitem").withColumn("__q", C.to_int("l_quantity")).join(right, ["l_partkey", "__q"], "left").select("l_orderkey", "l_partkey", "l_quantity", "p_brand")


@query("WITH a AS (SELECT l_orderkey AS k, max(l_quantity) AS mx FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, min(l_tax) AS mn FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders) SELECT a.k, mx, mn, st FROM a JOIN b USING (k) JOIN c USING (k)")
def merge_three_way(s, d):
    lines = t(s, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    both = lines.groupBy("k").agg(F.max("l_quantity").alias("mx"), F.min("l_tax").alias("mn"))
    return both.join(t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st")), "k")


@query(f"""SELECT r_name, p_type, CAST(count(*) AS BIGINT) AS n, {sql_round('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def star_join(s, d):
    rows = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("r_name", "p_type").agg(F.count("*").alias("n"), C.round_half_away(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT avg(log10(1 + n)) AS m, stddev_pop(log10(1 + n)) AS sd FROM c)
SELECT k, CAST(n AS BIGINT) AS n, {sql_round('(log10(1 + n) - m) / nullif(sd, 0)')} AS n_log_z FROM c CROSS JOIN s""")
def cross_join_stats_zscore(s, d):
    counts = t(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return A.log_z_scores(counts, ["n"]).withColumn("n_log_z", C.round_half_away("n_log_z", 6))


@query("SELECT o_orderkey, l_suppkey, a.n_name AS customer_nation, b.n_name AS supplier_nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey WHERE l_linenumber = 1")
def role_join(s, d):
    n = t(s, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    rows = t(s, d, "lineitem").filter("l_linenumber = 1").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(a, "c_nationkey", "left").join(b, "s_nationkey", "left").select("o_orderkey", "l_suppkey", "customer_nation", "supplier_nation")


@query("""WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal > 0), c AS (SELECT o_custkey AS k, max(o_totalprice) AS mx FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(x.k, c.k) AS k, n, c_acctbal, mx FROM (SELECT coalesce(a.k, b.k) AS k, n, c_acctbal FROM a RIGHT JOIN b ON a.k = b.k) x FULL JOIN c ON x.k = c.k""")
def kway_merge(s, d):
    o = t(s, d, "orders").withColumnRenamed("o_custkey", "k")
    a = o.filter("o_orderstatus = 'O'").groupBy("k").agg(F.count("*").alias("n"))
    b = t(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_acctbal")
    c = o.filter("o_orderstatus = 'P'").groupBy("k").agg(F.max("o_totalprice").alias("mx"))
    return R.merge_all(a, [(b, "k", "right"), (c, "k", "outer")])


@query("""WITH e AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT o_orderkey, o_custkey, 'expert' AS origin FROM orders WHERE o_custkey IN (SELECT c_custkey FROM e)
UNION ALL SELECT o_orderkey, o_custkey, 'citizen' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM e)""")
def union_insert(s, d):
    o, e = t(s, d, "orders").select("o_orderkey", "o_custkey"), t(s, d, "customer").filter("c_mktsegment = 'MACHINERY'")
    return R.append(R.in_values(o, "o_custkey", e, "c_custkey").withColumn("origin", F.lit("expert")), R.not_in_values(o, "o_custkey", e, "c_custkey").withColumn("origin", F.lit("citizen")))


@query("SELECT column_name AS col, 'nation' AS table_name FROM (DESCRIBE nation) UNION ALL SELECT column_name, 'region' FROM (DESCRIBE region)")
def union_all_columns(s, d):
    return R.column_list(nation=t(s, d, "nation"), region=t(s, d, "region"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL AS bal FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def concat_missing_columns(s, d):
    a = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return a.unionByName(t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


# Aggregates


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2, 3")
def count_by_three(s, d):
    return t(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS dates, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years FROM orders GROUP BY 1")
def count_distinct(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count_distinct(C.to_date("o_orderdate")).alias("dates"), F.count_distinct(F.year("o_orderdate")).alias("years"))


@query(f"SELECT o_custkey, {sql_round('count(DISTINCT o_orderpriority) FILTER (WHERE o_totalprice > 100000) / count(DISTINCT o_orderkey)', 3)} AS pct FROM orders GROUP BY 1")
def filtered_distinct_ratio(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(C.round_half_away(C.ratio(F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority"))), F.count_distinct("o_orderkey")), 3).alias("pct"))


@query(f"SELECT l_suppkey, {sql_round('avg(l_quantity)', 2)} AS avg_quantity, {sql_round('avg(l_discount)', 4)} AS avg_discount FROM lineitem GROUP BY 1")
def avg_round(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(C.round_half_away(F.avg("l_quantity"), 2).alias("avg_quantity"), C.round_half_away(F.avg("l_discount"), 4).alias("avg_discount"))


@query(f"""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2), p AS (SELECT o_custkey, c / sum(c) OVER (PARTITION BY o_custkey) AS p FROM c)
SELECT o_custkey, {sql_round('abs(-sum(p * log2(p)))', 4)} AS entropy FROM p GROUP BY 1""")
def shannon_entropy(s, d):
    return A.entropy(t(s, d, "orders"), "o_custkey", "o_orderpriority")


@query(f"""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS yearly FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS monthly FROM orders GROUP BY 1, 2, 3),
c AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2), p AS (SELECT o_custkey, c / sum(c) OVER (PARTITION BY o_custkey) AS p FROM c), e AS (SELECT o_custkey, {sql_round('abs(-sum(p * log2(p)))', 4)} AS e FROM p GROUP BY 1),
g AS (SELECT o_custkey, datediff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), CAST(o_orderdate AS DATE)) AS g FROM orders), h AS (SELECT o_custkey, avg(g) AS g FROM g GROUP BY 1)
SELECT o.o_custkey, e AS species_diversity, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS obs_count, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS unique_years, CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS unique_dates,
{sql_round('count(DISTINCT o_orderkey) / count(DISTINCT year(o_orderdate))')} AS obs_per_year, {sql_round('avg(monthly)', 2)} AS avg_monthly_obs, {sql_round('avg(yearly)', 2)} AS avg_yearly_obs, {sql_round('any_value(h.g)')} AS avg_obs_time
FROM orders o JOIN y ON o.o_custkey = y.o_custkey JOIN m ON o.o_custkey = m.o_custkey JOIN e ON o.o_custkey = e.o_custkey JOIN h ON o.o_custkey = h.o_custkey GROUP BY o.o_custkey, e""")
def observer_features(s, d):
    got = A.activity(t(s, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return got.withColumns({c: C.round_half_away(c, 6) for c in ("obs_per_year", "avg_obs_time")})


@query(f"""WITH r AS (SELECT l_suppkey, p_type, o_orderdate, abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS lag_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_suppkey <> o_custkey),
b AS (SELECT l_suppkey, CAST(count(*) AS BIGINT) AS id_count, {sql_round('avg(lag_)', 2)} AS avg_id_time FROM r GROUP BY 1), c AS (SELECT l_suppkey, p_type, count(*) AS c FROM r GROUP BY 1, 2), p AS (SELECT l_suppkey, c / sum(c) OVER (PARTITION BY l_suppkey) AS p FROM c),
e AS (SELECT l_suppkey, {sql_round('abs(-sum(p * log2(p)))', 4)} AS id_species_entropy FROM p GROUP BY 1), m AS (SELECT l_suppkey, {sql_round('avg(c)', 2)} AS id_avg_monthly_obs FROM (SELECT l_suppkey, year(o_orderdate), month(o_orderdate), count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1),
y AS (SELECT l_suppkey, {sql_round('avg(c)', 2)} AS id_avg_yearly_obs FROM (SELECT l_suppkey, year(o_orderdate), count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1) SELECT * FROM b JOIN e USING (l_suppkey) JOIN m USING (l_suppkey) JOIN y USING (l_suppkey)""")
def identifier_features(s, d):
    rows = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return A.identifications(rows.select("l_suppkey", "o_custkey", "p_type", "o_orderdate", "l_shipdate"), "l_suppkey", "o_custkey", "p_type", "o_orderdate", "l_shipdate")


@query("SELECT p_type, l_suppkey, CAST(count(l_orderkey) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def taxon_observer_counts(s, d):
    return t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "l_suppkey").agg(F.count("l_orderkey").alias("n"))


@query("SELECT p_partkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS confusability FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY 1")
def confusability_index(s, d):
    pairs = t(s, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    return t(s, d, "part").select("p_partkey").distinct().join(pairs, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("confusability"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_dim(s, d):
    return t(s, d, "part").select("p_brand", "p_type").distinct()


@query(f"SELECT p_type, {sql_round('avg(CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN 1 ELSE 0 END)')} AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def target_rate_by_category(s, d):
    return t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(C.round_half_away(F.avg(C.flag(F.col("l_returnflag") == "R")), 6).alias("rate"))


@query("""SELECT 'event_type' AS "column", count(*) AS n, count(*) - count(nullif(event_type, 'error')) AS n_null, count(DISTINCT nullif(event_type, 'error')) AS n_distinct FROM events UNION ALL SELECT 'user_id', count(*), count(*) - count(user_id), count(DISTINCT user_id) FROM events""")
def profile_null_dup(s, d):
    return A.profile(t(s, d, "events").select(F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "user_id"), ["event_type", "user_id"])


@query("SELECT CAST(least(9, floor(l_quantity / 5)) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def histogram_bins(s, d):
    return t(s, d, "lineitem").groupBy(F.least(F.lit(9), F.floor(F.col("l_quantity") / 5)).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS obs_count, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS matched, {sql_round("avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)")} AS match_pct FROM orders""")
def match_stats(s, d):
    f = C.flag(F.col("o_orderstatus") == "F")
    return t(s, d, "orders").agg(F.count("*").alias("obs_count"), F.sum(f).alias("matched"), C.round_half_away(F.avg(f), 6).alias("match_pct"))


@query(f"""WITH x AS (SELECT l_quantity AS v, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) SELECT {sql_round('(avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0)) / nullif(stddev_samp(v) FILTER (WHERE y = 1), 0)')} AS separation FROM x""")
def class_separation(s, d):
    y, v = F.col("l_returnflag") == "R", F.col("l_quantity")
    return t(s, d, "lineitem").agg(C.round_half_away((F.avg(F.when(y, v)) - F.avg(F.when(~y, v))) / F.nullif(F.stddev_samp(F.when(y, v)), F.lit(0.0)), 6).alias("separation"))


# Windows, order, top k


@query(f"SELECT o_custkey, o_orderpriority, CAST(count(*) AS BIGINT) AS n, {sql_round('count(*) / sum(count(*)) OVER (PARTITION BY o_custkey)')} AS share FROM orders GROUP BY 1, 2")
def share_of_total(s, d):
    return A.share_of_total(t(s, d, "orders"), "o_custkey", "o_orderpriority").withColumn("share", C.round_half_away("share", 6))


@query(f"WITH g AS (SELECT o_custkey, datediff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), CAST(o_orderdate AS DATE)) AS g FROM orders) SELECT o_custkey, {sql_round('avg(g)')} AS gap FROM g GROUP BY 1")
def lag_gap_avg(s, d):
    return A.mean_gap(t(s, d, "orders"), "o_custkey", "o_orderdate", "gap").withColumn("gap", C.round_half_away("gap", 6))


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id NULLS LAST) AS before FROM events")
def lag_value(s, d):
    return R.running_lag(t(s, d, "events"), ["user_id"], "event_id", "event_type", "before").select("event_id", "before")


@query(f"SELECT p_partkey, {sql_round('percent_rank() OVER (ORDER BY nullif(p_size, 7) NULLS LAST)', 3)} AS size_rank FROM part")
def percent_rank_nulls(s, d):
    rows = t(s, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("x"))
    return A.percent_rank(rows, "x", "size_rank").select("p_partkey", "size_rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ordered_limit(s, d):
    return t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5) SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN p_brand ELSE 'Other' END AS category FROM part")
def topk_other(s, d):
    return R.top_or_other(t(s, d, "part"), "p_brand", 5).select("p_partkey", "category")


# JSON, text, pivots


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text FROM events")
def json_path_extract(s, d):
    return t(s, d, "events").select("event_id", C.json_int("props", "$.k").alias("k"), C.json_text("props", "$.k").alias("k_text"))


@query("SELECT event_id, e.key AS key, CAST(e.value AS VARCHAR) AS value FROM events, json_each(CAST(props AS JSON)) e")
def json_each_explode(s, d):
    return t(s, d, "events").select("event_id", F.explode(C.json_entries("props")))


@query("SELECT page_id, CAST((length(html) - length(replace(html, '<a ', ''))) / 3 AS INTEGER) AS links FROM pages")
def substring_count(s, d):
    return t(s, d, "pages").select("page_id", C.occurrences("html", "<a ").alias("links"))


@query("SELECT doc_id, CASE WHEN nullif(lang, 'de') IS NULL THEN 0 ELSE 1 END AS has_lang, CAST(length(text) AS INTEGER) AS text_length FROM documents")
def null_flag_length(s, d):
    return t(s, d, "documents").select("doc_id", C.flag(F.nullif(F.col("lang"), F.lit("de")).isNotNull()).alias("has_lang"), F.coalesce(F.length("text"), F.lit(0)).alias("text_length"))


_MONTHLY = ", ".join(f"count(*) FILTER (WHERE month(o_orderdate) = {m}) AS month_{m}" for m in range(1, 13))
_DENSITY = ", ".join(f"{sql_round(f'month_{m} / nullif(c, 0)', 3)} AS month_{m}_density" for m in range(1, 13))


def _monthly(s, d):
    counts = t(s, d, "orders").groupBy("o_custkey").agg(*(F.count_if(F.month("o_orderdate") == m).alias(f"month_{m}") for m in clean.MONTHS), F.count("*").alias("count"))
    return clean.densities(counts, 3)


@query(f"WITH m AS (SELECT o_custkey, count(*) AS c, {_MONTHLY} FROM orders GROUP BY 1) SELECT o_custkey, {_DENSITY} FROM m")
def month_histogram_density(s, d):
    return _monthly(s, d).select("o_custkey", *(f"month_{m}_density" for m in clean.MONTHS))


@query(f"""WITH m AS (SELECT o_custkey, count(*) AS c, {_MONTHLY} FROM orders GROUP BY 1), p AS (SELECT o_custkey, {_DENSITY} FROM m)
SELECT o_orderkey, CASE month(o_orderdate) {' '.join(f'WHEN {m} THEN month_{m}_density' for m in range(1, 13))} END AS density FROM orders LEFT JOIN p USING (o_custkey)""")
def month_case_pick(s, d):
    joined = t(s, d, "orders").join(_monthly(s, d), "o_custkey", "left")
    return joined.select("o_orderkey", C.month_pick(F.month("o_orderdate"), [f"month_{m}_density" for m in clean.MONTHS]).alias("density"))


@query("SELECT o_orderstatus, metric, value FROM (SELECT o_orderstatus, max(o_totalprice) AS highest, min(o_totalprice) AS lowest FROM orders GROUP BY 1) UNPIVOT (value FOR metric IN (highest, lowest))")
def unpivot_metrics(s, d):
    rows = t(s, d, "orders").groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("highest"), F.min("o_totalprice").alias("lowest"))
    return rows.unpivot("o_orderstatus", ["highest", "lowest"], "metric", "value")


@query("SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1")
def pivot_counts(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


# Space


@query(f"SELECT o_orderkey, {sql_round('radians(' + LON.format(k='o_orderkey') + ') * 6378137.0', 3)} AS x, {sql_round('ln(tan(pi() / 4 + radians(' + LAT.format(k='o_orderkey') + ') / 2)) * 6378137.0', 3)} AS y FROM orders")
def mercator_project(s, d):
    return t(s, d, "orders").select("o_orderkey", C.round_half_away(G.mercator_x(lon("o_orderkey")), 3).alias("x"), C.round_half_away(G.mercator_y(lat("o_orderkey")), 3).alias("y"))


def _near_pairs(s, d):
    """Every order with the customers at most ``DEGREES`` away."""
    c = t(s, d, "orders").select("o_orderkey", lon("o_orderkey").alias("cx"), lat("o_orderkey").alias("cy"))
    e = t(s, d, "customer").select(F.col("c_custkey").alias("expert_id"), lon("c_custkey").alias("ex"), lat("c_custkey").alias("ey"))
    return S.within_distance(c, e, DEGREES, [], ("cx", "cy"), ("ex", "ey"))


_PAIRS = f"""WITH c AS (SELECT o_orderkey, {LON.format(k='o_orderkey')} AS cx, {LAT.format(k='o_orderkey')} AS cy FROM orders),
e AS (SELECT c_custkey AS expert_id, {LON.format(k='c_custkey')} AS ex, {LAT.format(k='c_custkey')} AS ey FROM customer),
p AS (SELECT * FROM c JOIN e ON cx BETWEEN ex - 0.2 AND ex + 0.2 WHERE sqrt((cx - ex) * (cx - ex) + (cy - ey) * (cy - ey)) <= {DEGREES})"""
_METRES = f"sqrt(pow(radians(cx - ex) * 6378137.0, 2) + pow((ln(tan(pi() / 4 + radians(cy) / 2)) - ln(tan(pi() / 4 + radians(ey) / 2))) * 6378137.0, 2)) <= {METRES}"


@query(f"{_PAIRS} SELECT o_orderkey, expert_id FROM p")
def spatial_distance_join(s, d):
    return _near_pairs(s, d).select("o_orderkey", "expert_id")


@query(f"{_PAIRS} SELECT o_orderkey, expert_id, {sql_round('1 / (1 + exp(0.5 * (1000 * sqrt((cx - ex) * (cx - ex) + (cy - ey) * (cy - ey)) - 10)))')} AS spatial_score FROM p")
def spatial_logistic_score(s, d):
    return _near_pairs(s, d).select("o_orderkey", "expert_id", C.round_half_away(C.logistic_decay(1000 * G.distance("cx", "cy", "ex", "ey")), 6).alias("spatial_score"))


@query(f"{_PAIRS} SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM p WHERE {_METRES}) THEN 1 ELSE 0 END AS expert_match FROM orders")
def spatial_label(s, d):
    plane = lambda k, x, y: (G.mercator_x(lon(k)).alias(x), G.mercator_y(lat(k)).alias(y))
    orders = t(s, d, "orders").select("o_orderkey", *plane("o_orderkey", "cx", "cy"))
    customers = t(s, d, "customer").select(*plane("c_custkey", "ex", "ey"))
    return S.exists_within(orders, customers, METRES, [], ("cx", "cy"), ("ex", "ey"), "expert_match").select("o_orderkey", "expert_match")


#: A square with a hole and a triangle (fixed values).
_RINGS = [[(-73.5, 45.2), (-71.5, 45.2), (-71.5, 46.8), (-73.5, 46.8)], [(-73.0, 45.6), (-72.0, 45.6), (-72.0, 46.2), (-73.0, 46.2)], [(-71.2, 45.1), (-70.2, 45.1), (-70.7, 46.5)]]
_EDGES = ", ".join(f"({a}, {b}, {c}, {e})" for a, b, c, e in G.edges_of(_RINGS))


@query(f"""WITH o AS (SELECT o_orderkey, {LON.format(k='o_orderkey')} AS x, {LAT.format(k='o_orderkey')} AS y FROM orders), e(x1, y1, x2, y2) AS (VALUES {_EDGES}), f AS (SELECT CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM e)
SELECT o_orderkey, CAST(count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 AS INTEGER) AS in_range FROM o CROSS JOIN f GROUP BY 1""")
def point_in_polygon(s, d):
    points = t(s, d, "orders").select("o_orderkey", F.lit(1).alias("taxon"), lon("o_orderkey").alias("x"), lat("o_orderkey").alias("y"))
    shape = s.range(1).select(F.lit(1).alias("taxon"), G.edge_array(_RINGS).alias("edges"))
    return S.with_range(points, shape, "taxon", "x", "y").select("o_orderkey", "in_range")


#: A ring for each market segment: its customers in order of key around a centre, at distances by their keys.
_RING = """SELECT c_mktsegment AS taxon, -72 + (0.3 + (c_custkey * 7919 % 1000) / 800.0) * cos(2 * pi() * (i - 1) / n) AS x, 46 + (0.2 + (c_custkey * 7919 % 1000) / 1200.0) * sin(2 * pi() * (i - 1) / n) AS y, i, n
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)"""


def _segment_ranges(s, d):
    """``taxon, edges``: a polygon with as many edges as the segment has customers."""
    t(s, d, "customer").createOrReplaceTempView("__customer")
    ring = s.sql(_RING.replace("FROM customer", "FROM __customer"))
    points = ring.groupBy("taxon").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    turned = F.concat(F.slice("p", F.lit(2), F.size("p") - 1), F.slice("p", 1, 1))
    edge = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return points.select("taxon", F.zip_with("p", turned, edge).alias("edges"))


@query(f"""WITH r AS ({_RING}), e AS (SELECT taxon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM r WINDOW w AS (PARTITION BY taxon ORDER BY i)),
o AS (SELECT o_orderkey, c_mktsegment AS taxon, {LON.format(k='o_orderkey')} AS x, {LAT.format(k='o_orderkey')} AS y FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, CAST(count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 AS INTEGER) AS in_range FROM o JOIN e USING (taxon) GROUP BY 1""")
def range_tiles(s, d):
    """Orders in the range of their customer's segment."""
    taxon = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("taxon"))
    points = t(s, d, "orders").select("o_orderkey", "o_custkey", lon("o_orderkey").alias("x"), lat("o_orderkey").alias("y")).join(taxon, "o_custkey")
    return S.with_range(points, _segment_ranges(s, d), "taxon", "x", "y").select("o_orderkey", "in_range")


#: An area with a hole, far from square (fixed values).
_AREA = "POLYGON ((-73.6 45.2, -71.4 45.3, -70.9 46.4, -72.2 46.0, -73.1 46.8, -73.6 45.2), (-72.9 45.5, -72.3 45.5, -72.5 45.9, -72.9 45.5))"
_AREA_EDGES = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE))" for a, b, c, e in G.edges_of(G.wkt_rings(_AREA)))


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice, {LON.format(k='o_orderkey')} AS x, {LAT.format(k='o_orderkey')} AS y FROM orders WHERE o_totalprice > 100000), f(x1, y1, x2, y2) AS (VALUES {_AREA_EDGES})
SELECT o_orderkey, o_totalprice FROM o CROSS JOIN f GROUP BY ALL HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1""")
def area_predicate(s, d):
    """Orders of an area above a price, from a table by Z-order key."""
    path = fresh_folder(s, "places")
    save_places(t(s, d, "orders").select("o_orderkey", "o_totalprice", lon("o_orderkey").alias("x"), lat("o_orderkey").alias("y")), path, "x", "y")
    found = s.read.parquet(path).filter(R.predicate({"o_totalprice": (">", 100_000), "place": Area(_AREA, "x", "y", "z")}))
    return found.select("o_orderkey", "o_totalprice")


@query(f"SELECT o_custkey, min({LON.format(k='o_orderkey')}) AS minx, min({LAT.format(k='o_orderkey')}) AS miny, max({LON.format(k='o_orderkey')}) AS maxx, max({LAT.format(k='o_orderkey')}) AS maxy FROM orders GROUP BY 1")
def bbox(s, d):
    return S.bounding_boxes(t(s, d, "orders").select("o_custkey", lon("o_orderkey").alias("x"), lat("o_orderkey").alias("y")), "o_custkey", "x", "y")


@query(f"""WITH o AS (SELECT o_orderkey, {LON.format(k='o_orderkey')} AS x, {LAT.format(k='o_orderkey')} AS y FROM orders)
SELECT o_orderkey, {sql_round('2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(45.5 - y) / 2), 2) + cos(radians(y)) * cos(radians(45.5)) * pow(sin(radians(-73.6 - x) / 2), 2))))', 4)} AS km FROM o""")
def haversine_distance(s, d):
    return t(s, d, "orders").select("o_orderkey", C.round_half_away(G.haversine_km(lon("o_orderkey"), lat("o_orderkey"), F.lit(-73.6), F.lit(45.5)), 4).alias("km"))


# Tables that are updated, landed and read again


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS orders, max(o_orderdate) AS latest, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN top IS NULL THEN c_acctbal ELSE top END AS c_acctbal, CAST(orders AS BIGINT) AS orders, CAST(latest AS DATE) AS latest FROM customer LEFT JOIN a ON k = c_custkey WHERE coalesce(orders, 0) <> 7""")
def keyed_upsert(s, d):
    """Customers, updated by what their orders say; those of seven orders go."""
    table = KeyedTable(s, fresh_folder(s, "customers"), ["c_custkey"], 16)
    table.upsert(t(s, d, "customer").select("c_custkey", "c_acctbal"))
    sums = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.count("*").alias("orders"), F.max("o_orderdate").cast("date").alias("latest"))
    known = sums.join(t(s, d, "customer").select("c_custkey"), "c_custkey", "left_semi").withColumn("gone", F.col("orders") == 7)
    for _ in range(2):  # the same again changes nothing
        table.upsert(known, delete="gone")
    return table.read()


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_once(s, d):
    """Kinds of events of each user, taken in by a stream that is started twice."""
    rows = t(s, d, "events").schema
    stream = landing_stream(s, d, rows, ["user_id", "event_type"], "ts", format="parquet", pathGlobFilter="events.parquet").select("user_id", "event_type", "ts")
    target, checkpoint = fresh_folder(s, "events"), fresh_folder(s, "progress")
    for _ in range(2):
        keep_once(stream, target, checkpoint, ["user_id", "event_type"])
    return kept(s, target, stream.schema).select("user_id", "event_type")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def detected_csv(s, d):
    """Orders as delimited text and back, with types found out."""
    path = fresh_folder(s, "orders")
    t(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate")).write.option("sep", ";").option("header", True).csv(path)
    return sniffed_csv(s, path).filter("malformed is null").drop("malformed")


@query("SELECT event_id, j.key, CAST(j.value AS BIGINT) AS value FROM events, json_each(props) AS j WHERE j.type IN ('BIGINT', 'UBIGINT')")
def json_members(s, d):
    found = C.json_members(t(s, d, "events").select("event_id", "props"), "props")
    return found.filter("kind = 'BIGINT'").select("event_id", "key", F.try_variant_get("value", "$", "bigint").alias("value"))


# Scores and preparation


@query(f"""WITH a AS (SELECT l_orderkey AS k, avg(l_quantity) AS q, max(l_discount) AS m FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey, {sql_round('coalesce(0.2 * q + 0.5 * m + 0.3 * nullif(o_custkey, 3), 0)')} AS score FROM orders LEFT JOIN a ON o_orderkey = k""")
def weighted_score_null_collapse(s, d):
    a = t(s, d, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("q"), F.max("l_discount").alias("m"))
    rows = t(s, d, "orders").join(a, "o_orderkey", "left").withColumn("c", F.nullif(F.col("o_custkey"), F.lit(3)))
    return rows.select("o_orderkey", C.round_half_away(C.weighted_or_zero({"q": 0.2, "m": 0.5, "c": 0.3}), 6).alias("score"))


@query(f"""WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS a FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_tax) AS b FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS k, o_totalprice AS c FROM orders)
SELECT k, {sql_round('a + b + c', 4)} AS score FROM a JOIN b USING (k) JOIN c USING (k)""")
def score_total(s, d):
    lines = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("a"), F.max("l_tax").alias("b"))
    rows = lines.join(t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("c")), "k")
    return rows.select("k", C.round_half_away(C.weighted_sum({"a": 1.0, "b": 1.0, "c": 1.0}), 4).alias("score"))


@query(f"WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, {sql_round('(p_retailprice - lo) / nullif(hi - lo, 0)')} AS p_retailprice FROM part CROSS JOIN b")
def minmax_scale(s, d):
    return P.scaled(t(s, d, "part").select("p_partkey", "p_retailprice"), linear=["p_retailprice"]).withColumn("p_retailprice", C.round_half_away("p_retailprice", 6))


@query(f"WITH b AS (SELECT max(ln(1 + p_size)) AS hi FROM part) SELECT p_partkey, {sql_round('ln(1 + p_size) / nullif(hi, 0)')} AS p_size FROM part CROSS JOIN b")
def log1p_scale(s, d):
    return P.scaled(t(s, d, "part").select("p_partkey", "p_size"), log=["p_size"]).withColumn("p_size", C.round_half_away("p_size", 6))


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {sql_round(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def correlation_pairs(s, d):
    return P.correlations(t(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", C.round_half_away("r", 6))


@query("""WITH c AS (SELECT p_brand, count(*) AS n, sum(count(*)) OVER () AS total FROM part GROUP BY 1), v AS (SELECT p_brand, CASE WHEN n / total < 0.04 THEN 'rare' ELSE p_brand END AS v FROM c), k AS (SELECT DISTINCT v FROM v), r AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM k)
SELECT p_partkey, code FROM part JOIN v USING (p_brand) JOIN r USING (v)""")
def rare_collapse_factorize(s, d):
    return P.factorized(t(s, d, "part"), "p_brand", 0.04).select("p_partkey", "code")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [1/6, 2/6, 3/6, 4/6, 5/6]) AS e FROM orders) SELECT o_orderkey, CAST(len(list_filter(e, lambda x: x < o_totalprice)) AS INTEGER) AS stratum FROM orders CROSS JOIN q""")
def quantile_strata(s, d):
    return P.quantile_bins(t(s, d, "orders"), "o_totalprice", 6, "stratum").select("o_orderkey", "stratum")


@query(f"""WITH r AS (SELECT *, month(o_orderdate) AS m FROM orders), q AS (SELECT quantile_cont(o_totalprice, [i / 6 FOR i IN range(7)]) AS e, list_distinct(quantile_cont(m, [i / 12 FOR i IN range(13)])) AS f FROM r),
c AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders GROUP BY 1),
s AS (SELECT o_orderkey, CAST(len(list_filter(list_slice(e, 2, 6), lambda x: x < o_totalprice)) AS INTEGER) || '_' || code || '_' || len(list_filter(list_sort(f)[2:len(f) - 1], lambda x: x < m)) AS k FROM r JOIN c USING (o_orderpriority) CROSS JOIN q)
SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY k) < 2 THEN 'mixed_stratum' ELSE k END AS stratum FROM s""")
def composite_strata(s, d):
    rows = t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.month("o_orderdate").alias("m"))
    return P.strata(rows, "o_totalprice", "o_orderpriority", "m", 6, 12).select("o_orderkey", "stratum")


def _split(s, d):
    return P.stratified_split(t(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", M.PARTS)


@query(None)
def stratified_split(s, d):
    return _split(s, d)


@query("""WITH r AS (SELECT o_orderpriority, percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders)
SELECT o_orderpriority, CASE WHEN p < CAST(0.7 AS DOUBLE) THEN 'train' WHEN p < CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE) THEN 'validate' ELSE 'test' END AS part, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def stratified_split_counts(s, d):
    return _split(s, d).groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_null, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, {sql_round(f'avg({c})', 4)} AS mean, {sql_round(f'var_samp({c})', 3)} AS variance FROM lineitem""" for c in ("l_quantity", "l_discount")))
def described(s, d):
    got = A.described(t(s, d, "lineitem"), ["l_quantity", "l_discount"])
    return got.withColumns({"mean": C.round_half_away("mean", 4), "variance": C.round_half_away("variance", 3)})


@query("SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS n_duplicate FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type)")
def duplicate_rows(s, d):
    return A.duplicate_rows(t(s, d, "events"), ["user_id", "event_type"])


@query(f"SELECT l_orderkey, l_linenumber, l_discount + l_tax AS sum, {sql_round('l_discount / nullif(l_discount + l_tax, 0)')} AS l_discount_per, {sql_round('l_tax / nullif(l_discount + l_tax, 0)')} AS l_tax_per FROM lineitem")
def row_shares(s, d):
    rows = A.row_shares(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", "sum", *(C.round_half_away(c, 6).alias(c) for c in ("l_discount_per", "l_tax_per")))


_TEN = {c: f"list_sort(list_distinct(quantile_cont({c}, [i / 10 FOR i IN range(11)])))" for c in ("l_quantity", "l_discount", "l_extendedprice")}
_BINS = ", ".join(f"len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda x: x < {c})) AS b_{c}" for c in _TEN)


@query(f"""WITH q AS (SELECT {', '.join(f'{e} AS e_{c}' for c, e in _TEN.items())} FROM lineitem), b AS (SELECT {_BINS} FROM lineitem CROSS JOIN q),
x AS (SELECT 'l_quantity' AS "column", b_l_quantity AS b, b_l_extendedprice AS t, count(*) AS c FROM b GROUP BY ALL UNION ALL SELECT 'l_discount', b_l_discount, b_l_extendedprice, count(*) FROM b GROUP BY ALL),
i AS (SELECT "column", c / sum(c) OVER (PARTITION BY "column") * log2(c * sum(c) OVER (PARTITION BY "column") / (sum(c) OVER (PARTITION BY "column", b) * sum(c) OVER (PARTITION BY "column", t))) AS i FROM x)
SELECT "column", {sql_round('sum(i)', 5)} AS information FROM i GROUP BY 1""")
def mutual_information(s, d):
    return P.mutual_information(t(s, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice").withColumn("information", C.round_half_away("information", 5))


@query(f"""WITH x AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem) SELECT {sql_round('avg(abs(y - p))', 3)} AS mae, {sql_round('avg((y - p) * (y - p))', 1)} AS mse, {sql_round('sqrt(avg((y - p) * (y - p)))', 3)} AS rmse, {sql_round('1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0)')} AS r2 FROM x""")
def regression_metrics(s, d):
    rows = t(s, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p"))
    got = M.regression_metrics(rows, "y", "p")
    return got.select(*(C.round_half_away(c, n).alias(c) for c, n in (("mae", 3), ("mse", 1), ("rmse", 3), ("r2", 6))))


@query(None)
def kmeans(s, d):
    return S.kmeans_clusters(t(s, d, "orders").select("o_orderkey", lon("o_orderkey").alias("x"), lat("o_orderkey").alias("y")), ["x", "y"], 6)


@query(f"""WITH RECURSIVE p AS (SELECT s_suppkey AS id, {LON.format(k='s_suppkey')} AS x, {LAT.format(k='s_suppkey')} AS y FROM supplier),
e AS (SELECT p.id AS a, q.id AS b FROM p JOIN p q ON p.id <> q.id WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(q.y - p.y) / 2), 2) + cos(radians(p.y)) * cos(radians(q.y)) * pow(sin(radians(q.x - p.x) / 2), 2)))) <= 10.0),
r AS (SELECT id, id AS m FROM p UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id)
SELECT id AS s_suppkey, CAST(CASE WHEN count(*) > 1 THEN min(m) ELSE -1 END AS BIGINT) AS spatial_cluster FROM r GROUP BY 1""")
def dbscan(s, d):
    return S.density_clusters(t(s, d, "supplier").select("s_suppkey", lon("s_suppkey").alias("x"), lat("s_suppkey").alias("y")), "s_suppkey", "x", "y", 10.0)


@query(None)
def pca_encode(s, d):
    rows = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("top"))
    return P.principal_components(rows, "o_custkey", ["n", "total", "top"])


_FACTS = ["l_quantity", "l_discount", "l_tax"]


def _lines(s, d):
    key = C.joined_key("l_orderkey", "l_linenumber").alias("id")
    return t(s, d, "lineitem").select(key, "l_returnflag", *_FACTS, F.col("l_extendedprice").alias("label"))


#: Trees of the registered forest and boosting: 500 of depth 12 would be some four million nodes on the driver.
_TREES = 50


def _fitted(s, d, kind: str):
    """Metrics on the validation and test parts of a model fitted on the training part of all lines."""
    return M.evaluated(_lines(s, d), "id", "l_returnflag", "label", _FACTS, kind, _TREES)[1]


@query(None)
def linear_regression(s, d):
    return _fitted(s, d, "linear")


@query(None)
def forest_regression(s, d):
    return _fitted(s, d, "forest")


@query(None)
def gbt(s, d):
    return _fitted(s, d, "boosted")


@query(None)
def binary_classifier(s, d):
    """Metrics on the test part of a classifier of returned lines, classes weighted."""
    rows = P.stratified_split(_lines(s, d).withColumn("returned", C.flag(F.col("l_returnflag") == "R")), "id", "l_returnflag", M.PARTS)
    model = M.trained_classifier(rows.filter("part = 'train'"), "returned", [*_FACTS, "label"])
    got = M.classification_metrics(model.transform(rows.filter("part = 'test'")), "returned")
    return s.createDataFrame([(k, float(v)) for k, v in got.items()], "metric string, value double")


@query(None)
def logistic_curve(s, d):
    rows = t(s, d, "lineitem").select("l_quantity", C.flag(F.col("l_returnflag") == "R").alias("returned"))
    return M.logistic_curve(rows, "l_quantity", "returned")


@query(None)
def overall_quality(s, d):
    rows = P.stratified_split(_lines(s, d), "id", "l_returnflag", {"train": 0.75, "test": 0.25}).withColumns({"a": F.col("label") / 1000, "b": F.col("l_quantity") * F.col("l_tax"), "c": F.sqrt("l_quantity"), "d": F.col("l_discount") * 10})
    got = M.overall_quality(rows.filter("part = 'test'"), rows.filter("part = 'train'"), ["a", "b", "c", "d"], _FACTS)
    return got.select("id", *(f"{c}_predicted" for c in "abcd"), "overall")


@query(None)
def elbow(s, d):
    return S.elbow(t(s, d, "orders").select(lon("o_orderkey").alias("x"), lat("o_orderkey").alias("y")), ["x", "y"])


@query(None)
def encoded_features(s, d):
    """Correlated columns as principal components, text as codes."""
    rows = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("top"))
    return P.encoded(rows, "o_custkey")


__all__ = ["ORACLE_SQL", "QUERIES"]
