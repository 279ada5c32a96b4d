"""Every query of the engine against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from herbarius.operators import models
from herbarius.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    mine = sorted(str([plain(r[c]) for c in order]) for r in rows)
    theirs = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert mine == theirs


def test_spatial_queries_by_brute_force(spark, tmp_path):
    place = lambda k: (k * 37 % 4001 / 1000.0 - 74, k * 91 % 2003 / 1000.0 + 45)
    orders, customers = list(range(1, 1500)), list(range(1, 200))
    spark.createDataFrame([(k,) for k in orders], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in customers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    up = lambda y: math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * 6378137.0
    want, labelled = {}, set()
    for o in orders:
        for c in customers:
            (x1, y1), (x2, y2) = place(o), place(c)
            r = math.hypot(x1 - x2, y1 - y2)
            if r <= 0.1:
                want[o, c] = 1 / (1 + math.exp(0.5 * (1000 * r - 10)))
                if math.hypot(math.radians(x1 - x2) * 6378137.0, up(y1) - up(y2)) <= 4000:
                    labelled.add(o)
    pairs = QUERIES["spatial_distance_join"](spark, str(tmp_path)).collect()
    assert sorted((r.o_orderkey, r.expert_id) for r in pairs) == sorted(want) and any(o % 20 and c % 20 for o, c in want)
    scores = {(r.o_orderkey, r.expert_id): r.spatial_score for r in QUERIES["spatial_logistic_score"](spark, str(tmp_path)).collect()}
    assert scores.keys() == want.keys() and all(abs(scores[k] - x) < 1e-6 for k, x in want.items())
    labels = {r.o_orderkey: r.expert_match for r in QUERIES["spatial_label"](spark, str(tmp_path)).collect()}
    assert labels == {o: int(o in labelled) for o in orders} and labelled


@pytest.mark.parametrize(("name", "kind"), [("linear_regression", "linear"), ("forest_regression", "forest"), ("gbt", "boosted")])
def test_regressions_fit_on_the_training_part_of_all_rows(spark, monkeypatch, name, kind):
    seen, fit = [], models.trained

    def trained(rows, label, columns, kind, trees=500):
        seen.append((rows.count(), kind, trees))
        return fit(rows, label, columns, "linear")

    monkeypatch.setattr(models, "trained", trained)
    got = {r.part: r for r in QUERIES[name](spark, DATA).collect()}
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert len(seen) == 1 and abs(seen[0][0] - 0.7 * n) <= 3 and seen[0][1:] == (kind, 50)
    assert set(got) == {"validate", "test"} and all(-0.2 < r.r2 <= 1 and abs(r.rmse - math.sqrt(r.mse)) < 1e-6 for r in got.values())


def test_components_and_clusters_keep_what_they_must(spark):
    rows = [(r.o_custkey, r) for r in QUERIES["pca_encode"](spark, DATA).collect()]
    names = [c for c in rows[0][1].asDict() if c != "o_custkey"]
    columns = [[r[c] for _, r in rows] for c in names]
    mean = [sum(c) / len(c) for c in columns]
    dot = lambda i, j: sum((a - mean[i]) * (b - mean[j]) for a, b in zip(columns[i], columns[j], strict=True))
    assert all(abs(m) < 1e-6 * max(map(abs, c)) for m, c in zip(mean, columns, strict=True))
    assert all(abs(dot(i, j)) < 1e-6 * math.sqrt(dot(i, i) * dot(j, j)) for i in range(len(names)) for j in range(i))
    points = QUERIES["kmeans"](spark, DATA).collect()
    middles = {k: [sum(v) / len(v) for v in zip(*((r.x, r.y) for r in points if r.spatial_cluster == k), strict=True)] for k in {r.spatial_cluster for r in points}}
    nearest = lambda r: min(middles, key=lambda k: math.hypot(r.x - middles[k][0], r.y - middles[k][1]))
    assert len(middles) == 6 and sum(nearest(r) == r.spatial_cluster for r in points) >= 0.99 * len(points)
    costs = [r["cost"] for r in sorted(QUERIES["elbow"](spark, DATA).collect(), key=lambda r: r["k"])]
    assert len(costs) == 10 and costs[-1] < costs[0] / 4 and all(b < a * 1.05 for a, b in zip(costs, costs[1:], strict=False))
