"""Times the headline queries, and DuckDB on their SQL, and prints one JSON line."""

import glob
import json
import os
import time

from pyspark.sql import SparkSession

from herbarius.queries import ORACLE_SQL, QUERIES

HEADLINE = ("observer_features", "identifier_features", "star_join", "spatial_distance_join", "spatial_label", "point_in_polygon", "range_tiles", "month_case_pick", "percent_rank_nulls", "null_aware_not_in", "merge_three_way", "score_total", "correlation_pairs")


def best_of_two(run) -> float:
    """Seconds of the better of two runs, as the first compiles."""
    seconds = []
    for _ in range(2):
        began = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - began)
    return round(min(seconds), 3)


def by_duckdb(sf_dir: str, cpus: str) -> dict[str, float]:
    """Seconds of the same queries in DuckDB, none where it isn't installed."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    con = duckdb.connect()
    con.execute(f"SET threads = {int(cpus)}")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return {name: best_of_two(lambda name=name: con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {ORACLE_SQL[name]}")) for name in HEADLINE}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: best_of_two(lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    spark.stop()
    out = {"metric": "headline queries, better of two runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out | {"duckdb": by_duckdb(sf_dir, cpus)}))


if __name__ == "__main__":
    main()
