"""Areas by key ranges, updates by key, landing that resumes, detected text."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from herbarius.functions import geo, zorder
from herbarius.functions.columns import json_members
from herbarius.operators.relational import occurrence_predicate, predicate
from herbarius.sources import keyed, places, sniffed
from herbarius.streaming import landing

AREA = "POLYGON ((-74 45, -71 45.2, -70 47, -72 46, -73.5 47, -74 45), (-73 45.4, -72.5 45.4, -72.7 45.8, -73 45.4))"


def parity(x, y, rings):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in geo.edges_of(rings)) % 2 == 1


def test_keys_and_ranges_hold_an_area(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(-75, -69), r.uniform(44, 48)) for i in range(4000)] + [(5000, None, 1.0), (5001, float("nan"), 45.0), (5002, -181.0, 95.0), (5003, -74.0, 45.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double").withColumn("z", zorder.z_key("x", "y"))
    keys = {row.i: row.z for row in df.collect()}
    assert keys[5000] is keys[5001] is None and keys[5002] == sum(1 << 2 * k + 1 for k in range(zorder.BITS))
    step = lambda v, lo, wide: int((v - lo) // (wide / 2**20))
    for i, x, y in rows[:50]:
        a, b = step(x, -180, 360), step(y, -90, 180)
        assert keys[i] == sum((a >> k & 1) << 2 * k | (b >> k & 1) << 2 * k + 1 for k in range(20))
    rings = geo.wkt_rings(AREA)
    want = {i for i, x, y in rows if x is not None and x == x and parity(x, y, rings)}
    for most in (1, 7, 64, 500):
        ranges = zorder.cover(rings, most)
        assert 1 <= len(ranges) <= most and all(any(a <= keys[i] <= b for a, b in ranges) for i in want)
    held = sum(any(a <= k <= b for a, b in zorder.cover(rings, 500)) for k in keys.values() if k is not None)
    assert len(want) <= held < 1.15 * len(want)
    for key in (None, "z"):
        assert {row.i for row in df.filter(zorder.within(AREA, "x", "y", key)).collect()} == want


def test_a_key_is_worked_out_once(spark):
    df = spark.range(10).selectExpr("id", "if(id = 1, null, if(id = 2, double('NaN'), id * 7.3D)) as x", "if(id = 3, null, if(id = 4, double('inf'), id * -3.1D)) as y")
    keyed = df.withColumn("z", zorder.z_key("x", "y"))
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(keyed._jdf.queryExecution(), "codegen")
    # Once for each axis; not for each time that a step of drawing bits apart names the one before.
    assert code.count("Math.floor") == 2
    keys = {r.id: r.z for r in keyed.collect()}
    assert dict(keyed.dtypes)["z"] == "bigint" and {i for i, z in keys.items() if z is None} == {1, 2, 3}
    apart = lambda v: sum((v >> k & 1) << 2 * k for k in range(zorder.BITS))
    for i in (0, 5, 6, 7, 8, 9):
        assert keys[i] == apart(int((i * 7.3 + 180) // (360 / 2**20))) | apart(int((i * -3.1 + 90) // (180 / 2**20))) << 1
    assert keys[4] == apart(int((4 * 7.3 + 180) // (360 / 2**20))) | apart(2**20 - 1) << 1


def test_an_area_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/places"
    df = spark.range(40_000).selectExpr("id", "-180 + (id * 7919 % 36000) / 100.0D as x", "-90 + (id * 104729 % 18000) / 100.0D as y", "id % 7 as n").unionAll(spark.sql("select -1L, null, 3.0D, 1L"))
    places.save_places(df, path, "x", "y", group_bytes=20_000)
    table = spark.read.parquet(path)
    assert table.count() == 40_001 and table.filter("z is null").count() == 1
    area = "POLYGON ((10 10, 20 12, 18 22, 10 10))"
    found = table.filter(predicate({"n": [1, 2, 3], "place": zorder.Area(area, "x", "y", "z")}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(n, [1,2,3]), Or(" in plan
    rings = geo.wkt_rings(area)
    assert {r.id for r in found.collect()} == {r.id for r in df.collect() if r.x is not None and r.n in (1, 2, 3) and parity(r.x, r.y, rings)}
    read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read < 8_000
    groups = [g.column(i).statistics for f in glob.glob(f"{path}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups)) for i in range(g.num_columns) if g.column(i).path_in_schema == "z"]
    ranges = zorder.cover(rings)
    assert sum(any(s.has_min_max and s.min <= b and a <= s.max for a, b in ranges) for s in groups) < len(groups) / 2


def test_occurrence_settings(spark):
    rows = [("a", True, "PRESENT", 2021, 7, -73.9, 45.1), ("b", True, "PRESENT", 2019, 7, -73.9, 45.1), ("c", False, "PRESENT", 2021, 7, -73.9, 45.1), ("d", True, "PRESENT", 2021, 9, -73.9, 45.1), ("e", True, "PRESENT", 2021, 7, -60.0, 45.1), ("f", True, "ABSENT", 2021, 7, -73.9, 45.1)]
    df = spark.createDataFrame(rows, "k string, hasCoordinate boolean, occurrenceStatus string, year int, taxonKey int, decimalLongitude double, decimalLatitude double")
    settings = {"YEAR": 2020, "TAXON_KEY": [7, 8], "GEOMETRY": "POLYGON ((-74 45, -73 45, -73 46, -74 46))", "LIMIT": 5}
    assert [r.k for r in df.filter(occurrence_predicate(settings)).collect()] == ["a"]


def files(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_updates_by_key(spark, tmp_path):
    path = f"{tmp_path}/table"
    table = keyed.KeyedTable(spark, path, ["k"], 8)
    table.upsert(spark.createDataFrame([(i, f"v{i}", 1) for i in range(100)] + [(None, "none", 1)], "k int, v string, n int"))
    assert table.read().count() == 100
    before = files(path)
    bucket = lambda k: spark.sql(f"select pmod(xxhash64({k}), 8)").first()[0]
    touched = {bucket(3), bucket(500)}
    changes = spark.createDataFrame([(3, "old", 1.0, 5), (3, "new", 2.0, 6), (500, "added", 3.0, 1)], "k int, v string, more double, at int")
    for _ in range(2):
        table.upsert(changes, newest="at")
        rows = {r.k: r for r in table.read().collect()}
        assert len(rows) == 101 and (rows[3].v, rows[3].n, rows[3].more) == ("new", 1, 2.0) and (rows[500].v, rows[500].n) == ("added", None) and rows[4].v == "v4" and rows[4].n == 1
    after = files(path)
    same = [f for f in before if not any(f"bucket={b}/" in f for b in touched)]
    assert len(same) >= 6 and all(after[f] == before[f] for f in same)
    everyone = table.read().select("k").filter(f"pmod(xxhash64(k), 8) = {bucket(3)}").selectExpr("k", "true as gone")
    table.upsert(everyone, delete="gone")
    assert table.read().filter(f"pmod(xxhash64(k), 8) = {bucket(3)}").count() == 0 and table.read().count() > 50


def test_landing_goes_on_where_it_stopped(spark, tmp_path):
    folder, target, progress = (f"{tmp_path}/{x}" for x in ("landed", "kept", "progress"))
    schema = "item_key int, json string, at timestamp"
    put = lambda rows: spark.createDataFrame(rows, "item_key int, json string, at string").coalesce(1).write.mode("append").json(folder)
    put([(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:01:00"), (1, "again", "2024-01-01 00:02:00")])
    seen = []

    def take(fail=False):
        def then(batch, number):
            if fail:
                raise RuntimeError("stopped")
            seen.extend(r.item_key for r in batch.collect())

        landing.keep_once(landing.landing_stream(spark, folder, schema, ["item_key"], "at"), target, progress, ["item_key"], then)
        return sorted(r.item_key for r in landing.kept(spark, target, schema).collect())

    assert take() == [1, 2] and take() == [1, 2]
    put([(2, "late", "2024-03-01 00:00:00"), (3, "c", "2024-03-01 00:00:00")])  # the second long after its first
    with pytest.raises(Exception, match="stopped"):
        take(fail=True)
    assert take() == [1, 2, 3] and sorted(seen) == [1, 2, 3]


@pytest.mark.parametrize(("separator", "quote"), [("\t", '"'), (",", '"'), (";", '"'), ("|", "'")])
def test_text_is_found_out(spark, tmp_path, separator, quote):
    path = tmp_path / "x.csv"
    lines = [["id", "name", "size", "day", "at", "flag", "decimalLongitude", "decimalLatitude"]]
    lines += [[str(i), f"{quote}n{separator}{i}{quote}" if i % 3 == 0 else f"n{i}", f"{i / 2}", "2024-01-02", "2024-01-02T03:04:05", "true", "-73.5", "45"] for i in range(40)]
    text = [separator.join(x) for x in lines] + [separator.join(["x9", "bad", "1.5", "2024-01-02", "2024-01-02T03:04:05", "true", "1", "2"]), "too few", separator.join(["7"] + ["n"] * 20)]
    path.write_text("\n".join(text) + "\n")
    df = sniffed.sniffed_csv(spark, str(path), sample=30)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "date", "timestamp", "boolean", "double", "bigint", "string", "struct<x:double,y:double>"]
    rows = df.collect()
    assert len(rows) == 43 and [r.id for r in rows[:40]] == list(range(40)) and rows[3].name == f"n{separator}3" and rows[0].geom.y == 45.0
    assert [r.malformed is not None for r in rows] == [False] * 40 + [True] * 3 and rows[41].malformed == "too few"
    some = sniffed.sniffed_csv(spark, str(path), ["id", "day"], 30)
    assert some.columns == ["id", "day", "malformed"] and some.count() == 43


def test_dialects_of_odd_samples():
    assert sniffed.dialect([]).schema.fieldNames() == [] and sniffed.dialect(["only"]).schema.fieldNames() == ["only"]
    d = sniffed.dialect(["1,2.5,x", "2,,y"])
    assert (d.separator, d.header, [f.dataType.simpleString() for f in d.schema]) == (",", False, ["bigint", "double", "string"])
    assert sniffed.dialect(["a,b,a", "1,2,3"]).schema.fieldNames() == ["a", "b", "a_1"]


def test_members_of_unknown_json(spark):
    rows = [(1, '{"a": 1, "b": {"c": [1, "x"]}, "d": null, "e": 1.5, "f": true}'), (2, "[1, 2]"), (3, "{bad"), (4, None), (5, "{}")]
    got = json_members(spark.createDataFrame(rows, "i int, j string"), "j")
    found = {(r.i, r.pos, r.key): r.kind for r in got.filter("pos is not null").collect()}
    assert found == {(1, 0, "a"): "BIGINT", (1, 1, "b"): "OBJECT<c: ARRAY<VARIANT>>", (1, 2, "d"): "VOID", (1, 3, "e"): "DECIMAL(2,1)", (1, 4, "f"): "BOOLEAN", (2, 0, None): "BIGINT", (2, 1, None): "BIGINT"}
    nested = got.filter("key = 'b'").selectExpr("try_variant_get(value, '$.c[1]', 'string') as x")
    assert nested.first().x == "x"
