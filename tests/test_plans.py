"""The domain dataflow on hand-made records."""

import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from herbarius.functions.columns import as_json, joined_key, value_map
from herbarius.functions.geo import clipped, geojson, wkt_rings
from herbarius.operators import aggregates, models, prep, relational, spatial
from herbarius.plans import clean, features, score
from herbarius.sources import landed

RAW = "gbifID string, occurrenceID string, year int, month int, day int, recordedBy string, recordedByID string, identifiedBy string, identifiedByID string, occurrenceRemarks string, eventDate string, dateIdentified string, institutionCode string, species string, taxonRank string, taxonID int, hasCoordinate boolean, coordinateUncertaintyInMeters double, mediaType string, sex string, reproductiveCondition string, dynamicProperties string, geom struct<x:double,y:double>"


def record(**over):
    base = {
        "gbifID": "1", "occurrenceID": "u1", "year": 2024, "month": 5, "day": 3, "recordedBy": "ann", "recordedByID": None, "identifiedBy": "bob", "identifiedByID": None, "occurrenceRemarks": None, "eventDate": "2024-05-03",
        "dateIdentified": "2024-05-10", "institutionCode": "iNaturalist", "species": "Acer rubrum", "taxonRank": "SPECIES", "taxonID": 7, "hasCoordinate": True, "coordinateUncertaintyInMeters": None, "mediaType": None, "sex": None,
        "reproductiveCondition": None, "dynamicProperties": None, "geom": (-73.5, 45.5),
    }
    return tuple((base | over).values())


def records(spark, *rows):
    return spark.createDataFrame([record(**r) for r in rows], RAW)


def test_clean_keeps_and_drops(spark):
    rows = records(
        spark,
        {"gbifID": "a"},
        {"gbifID": "b", "coordinateUncertaintyInMeters": 2999.6},
        {"gbifID": "c", "coordinateUncertaintyInMeters": 2998.4},
        {"gbifID": "d", "month": 3},
        {"gbifID": "e", "month": 9},
        {"gbifID": "f", "taxonRank": "GENUS"},
        {"gbifID": "g", "hasCoordinate": False},
        {"gbifID": "h", "taxonID": None},
        {"gbifID": "i", "institutionCode": "other"},
        {"gbifID": "j", "dateIdentified": None},
    )
    got = {r.gbifID: r.coordinateUncertaintyInMeters for r in clean.citizen(rows).collect()}
    assert got == {"a": 0, "c": 2998}


def test_annotations(spark):
    rows = records(
        spark,
        {"gbifID": "a", "sex": "Male", "reproductiveCondition": "flowers|flower buds", "mediaType": "StillImage;StillImage"},
        {"gbifID": "b", "sex": "other", "dynamicProperties": '{"a":"green leaves"}'},
        {"gbifID": "c", "dynamicProperties": '{"a":["colored leaves","x"]}'},
        {"gbifID": "d", "dynamicProperties": '{"a":"green leaves","b":"z"}'},
        {"gbifID": "e", "dynamicProperties": "{}"},
        {"gbifID": "f", "dynamicProperties": "no json"},
    )
    got = sorted((r.gbifID, r.pheno_sex or 0, r.pheno_repro or 0, r.pheno_leaves or 0, r.media_count) for r in clean.citizen(rows).collect())
    assert got == [("a", 11, 15, 0, 2), ("b", 0, 0, 38, 0), ("c", 0, 0, 39, 0), ("d", 0, 0, 0, 0), ("d", 0, 0, 38, 0), ("e", 0, 0, 0, 0), ("f", 0, 0, 0, 0)]


def test_dealt_and_null_experts(spark):
    c = clean.citizen(records(spark, {"gbifID": "a", "recordedBy": "ann"}, {"gbifID": "b", "recordedBy": "eve", "recordedByID": "x"}))
    observations = spark.createDataFrame([(1, "u1", "l", 5, 3, 0)], "id long, url string, user_login string, user_id long, num_identification_agreements int, num_identification_disagreements int")
    joined = clean.with_identifications(c, observations)
    experts = clean.experts_among(clean.observers(joined))
    expert_rows = clean.expert(records(spark, {"gbifID": "e", "sex": "Male"}))
    citizens, all_experts = clean.dealt(joined, expert_rows, experts)
    assert [r.gbifID for r in citizens.collect()] == ["a"]
    assert sorted(r.gbifID for r in all_experts.collect()) == ["b", "e"]
    with_null = experts.select("recordedBy").unionAll(spark.createDataFrame([(None,)], "recordedBy string"))
    assert clean.dealt(joined, expert_rows, with_null)[0].count() == 0


def test_landed_species_json(spark):
    months = {str(m): m for m in range(1, 13)}
    rows = [(0, 0, 7, json.dumps({"count": 78, "controlled_value": {"id": 38, "label": "green"}, "controlled_attribute": {"id": 36, "label": "leaves"}, "month_of_year": months})), (0, 1, 8, json.dumps({"month_of_year": {"1": 1}}))]
    landed_ = spark.createDataFrame(rows, landed.RESPONSES)
    h = {r.taxonID: r for r in clean.densities(clean.histogram(landed_)).collect()}
    assert h[7]["count"] == 78 and abs(h[7]["month_2_density"] - 2 / 78) < 1e-12 and h[8]["count"] is None and h[8]["month_1_density"] is None
    p = clean.densities(clean.phenology(landed_), 3).filter("taxonID = 7").first()
    assert (p["value_id"], p["month_12_density"]) == (38, 0.154)


def test_people_of_rank_above_one(spark):
    rows = [(0, 0, 5, json.dumps({"id": 5, "login": "a", "observations_count": 10, "universal_search_rank": 7})), (0, 0, 6, json.dumps({"id": 6, "universal_search_rank": 1}))]
    got = clean.people(spark.createDataFrame(rows, landed.RESPONSES)).collect()
    assert [(r.id, r.login, r.observations_count) for r in got] == [(5, "a", 10)]


def test_observer_profiles(spark):
    rows = clean.citizen(records(spark, {"gbifID": "1", "eventDate": "2024-05-01"}, {"gbifID": "2", "eventDate": "2024-05-04", "species": "B"}, {"gbifID": "3", "eventDate": "2024-05-04", "species": "B"}, {"gbifID": "4", "recordedBy": "solo"}, {"gbifID": "5", "recordedBy": None}))
    got = {r.recordedBy: r for r in features.observer(rows).collect()}
    assert set(got) == {"ann", "solo"}
    assert (got["ann"].obsv_obs_count, got["ann"].obsv_avg_obs_time, got["ann"].obsv_unique_dates) == (3, 1.5, 2)
    assert (got["solo"].obsv_avg_obs_time, got["solo"].obsv_species_diversity) == (None, 0.0)


def test_scores_near_experts(spark):
    c = clean.citizen(records(spark, {"gbifID": "a"}, {"gbifID": "b", "geom": (-73.0, 45.5)}, {"gbifID": "c", "species": "Other"}))
    e = clean.expert(records(spark, {"gbifID": "x", "geom": (-73.5, 45.5)}, {"gbifID": "y", "geom": (-73.5, 45.55)}))
    got = sorted((r.gbifID, round(r.spatial_score, 4)) for r in score.spatial(c, e).collect())
    assert got == [("a", 0.0), ("a", 0.9933)]
    assert {r.gbifID: r.expert_match for r in score.labelled(c, e).collect()} == {"a": 1, "b": 0, "c": 0}


def test_ranges(spark):
    texts = spark.createDataFrame([(7, "POLYGON ((-74 45, -73 45, -73 46, -74 46, -74 45), (-73.6 45.4, -73.4 45.4, -73.4 45.6, -73.6 45.6, -73.6 45.4))"), (7, "MULTIPOLYGON (((-80 40, -79 40, -79 41)), ((-73.6 45.4, -73.4 45.4, -73.4 45.6, -73.6 45.6)))")], "taxon_id int, wkt string")
    r = landed.ranges(texts, "taxon_id")
    c = clean.citizen(records(spark, {"gbifID": "hole"}, {"gbifID": "in", "geom": (-73.9, 45.1)}, {"gbifID": "none", "taxonID": 8}))
    got = sorted((x.gbifID, x.range) for x in features.ranges(c, r).collect())
    assert got == [("hole", 0), ("hole", 1), ("in", 0), ("in", 1)]
    assert len(wkt_rings("POLYGON ((0 0, 1 0, 1 1))")) == 1


def test_identifier_without_profile_scores_zero(spark):
    c = clean.citizen(records(spark, {"gbifID": "a"}))
    ids = features.identifier(c)
    none = spark.createDataFrame([], "recordedBy string, identifications_count_log_z double")
    assert score.identifier(c, ids, none).first().identifier_score == 0.0


def test_equal_counts_have_no_z_score(spark):
    df = spark.createDataFrame([(1, 4), (2, 4)], "k int, n int")
    assert [r.n_log_z for r in aggregates.log_z_scores(df, ["n"]).collect()] == [None, None]


def test_pending_keys(spark):
    items = spark.createDataFrame([(3,), (1,), (1,), (None,), (2,)], "id int")
    done = spark.createDataFrame([(0, 0, 2, "{}")], landed.RESPONSES)
    assert [r.id for r in landed.pending(items, "id", done).collect()] == [1, 3]
    assert landed.field_list({"a": True, "b": {"c": True}}) == "(a:!t,b:(c:!t))"


def test_density_clusters(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.3, 0.0), (3, 0.6, 0.0), (4, 5.0, 5.0), (5, 5.0, 5.0), (6, 40.0, 40.0)], "k int, x double, y double")
    got = {r.k: r.spatial_cluster for r in spatial.density_clusters(df, "k", "x", "y", 50.0).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: -1}


def test_split_and_scaling(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    parts = {r.part: r["count"] for r in prep.stratified_split(df, "id", "g", {"a": 0.7, "b": 0.15, "c": 0.15}).groupBy("part").count().collect()}
    assert abs(parts["a"] - 700) < 10 and sum(parts.values()) == 1000
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, v double")
    assert [r.v for r in prep.scaled(flat, linear=["v"]).collect()] == [None, None]


def test_split_moves_no_rows(spark):
    rows = [(i % 900, None if i % 7 == 0 else "ab"[i % 2] if i % 50 else f"rare{i}", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    sizes = {"a": 0.7, "b": 0.15, "c": 0.15}
    split = prep.stratified_split(df, "id", "g", sizes)
    assert "Exchange hashpartitioning" not in split._jdf.queryExecution().executedPlan().toString()
    hashed = [(r.g, r.h, r.id, r.x) for r in df.select("*", F.xxhash64(F.lit(42), F.col("id").cast("string")).alias("h")).collect()]
    want = {}
    for g, h, i, x in hashed:
        group = [(b, c) for a, b, c, _ in hashed if a == g]
        share = sum(o < (h, i) for o in group) / (len(group) - 1) if len(group) > 1 else 0.0
        want[x] = "a" if share < 0.7 else "b" if share < 0.85 else "c"
    assert {r.x: r.part for r in split.collect()} == want and set(want.values()) == set(sizes)


def test_not_in_on_empty(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    assert relational.not_in_values(a, "k", spark.createDataFrame([], "x int"), "x").count() == 2
    assert isinstance(a.first(), Row)


def test_flow_resumes_and_skips(spark):
    from herbarius.plans.steps import Flow, Step

    calls = []

    def first(_):
        calls.append("first")
        return spark.range(3)

    def broken(_):
        raise RuntimeError("no source")

    def second(made):
        calls.append("second")
        return made["raw.first"].filter("id > 0")

    flow = Flow([Step("raw.first", first), Step("raw.broken", broken, optional=True), Step("clean.second", second)])
    assert flow.run(spark)["clean.second"].count() == 2 and "raw.broken" in flow.failed
    flow.run(spark)
    assert calls == ["first", "second"]
    flow.run(spark, only=["clean.second"], force=True)
    assert calls == ["first", "second", "second"]


def near(points, km):
    """Connected groups of (key, lon, lat) by brute force."""

    def far(p, q):
        a, b = math.radians(p[2]), math.radians(q[2])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    label = {p[0]: p[0] for p in points}
    for _ in points:
        for p in points:
            for q in points:
                if label[q[0]] < label[p[0]] and far(p, q) <= km:
                    label[p[0]] = label[q[0]]
    sizes = list(label.values())
    return {k: v if sizes.count(v) > 1 else -1 for k, v in label.items()}


def test_density_clusters_know_no_borders(spark):
    r = random.Random(4)
    rows = [(1, 179.95, 10.0), (2, -179.95, 10.0), (3, 0.0, 89.99), (4, 180.0, 89.95), (5, -90.0, 89.9), (6, 12.0, -89.99), (7, -100.0, -89.98)]
    rows += [(10 + i, r.uniform(20, 21), r.uniform(59, 60)) for i in range(60)] + [(100 + i, 30 + r.gauss(0, 0.02), r.gauss(0, 0.02)) for i in range(50)] + [(200 + i, 30.28 + r.gauss(0, 0.02), r.gauss(0, 0.02)) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, lon double, lat double")
    for km in (5.0, 11.5, 25.0):
        got = {x.k: x.spatial_cluster for x in spatial.density_clusters(df, "k", "lon", "lat", km).collect()}
        assert got == near(rows, km)
    assert spatial.density_clusters(spark.createDataFrame([(1, None, 2.0)], "k int, lon double, lat double"), "k", "lon", "lat").first().spatial_cluster == -1


def test_research_grade_and_species(spark):
    o = spark.createDataFrame([(1, "u", "l", 5, 3, 0, "research"), (2, "v", "m", 6, 1, 1, "casual")], "id long, url string, user_login string, user_id long, num_identification_agreements int, num_identification_disagreements int, quality_grade string")
    assert [tuple(r) for r in clean.research_grade(o).collect()] == [(1, "u", "l", 5, 3, 0)]
    facts = spark.createDataFrame([(7, "A", "SPECIES", "p", "c", "o", "f", "g", "LC")] * 2, "taxonID int, species string, taxonRank string, phylum string, class string, `order` string, family string, genus string, iucnRedListCategory string")
    assert clean.species(facts).count() == 1
    s = spark.createDataFrame([(0, 0, 7, json.dumps({"count": 4, "taxon": {"id": 9}}))] * 2, landed.RESPONSES)
    assert [tuple(r) for r in clean.similar_species(s).collect()] == [(7, 4, 9)]
    types = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "attribute_label string, value_label string")
    assert clean.annotation_types(types).count() == 2
    who = spark.createDataFrame([("ann", None), ("eve", "x")], "recordedBy string, recordedByID string")
    assert [r.recordedBy for r in clean.citizens_among(who).collect()] == ["ann"]


STANDING = "user_id long, observations_count int, identifications_count int, species_count int, universal_search_rank int"


def test_observer_standing(spark):
    rows = [(1, 9, 0, 99, 5), (2, 99, 9, 9, 5), (3, 999, 99, 0, 5), (4, 99, 0, 0, 5)]
    who = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cat")], "user_id long, recordedBy string")
    got = {r.recordedBy: r for r in features.observer_standing(spark.createDataFrame(rows, STANDING), who).collect()}
    logs = [1, 2, 3, 2]
    spread = math.sqrt(sum((x - 2) ** 2 for x in logs) / 4)
    assert abs(got["ann"].observations_count_log_z - (1 - 2) / spread) < 1e-9 and got["ann"].universal_search_rank_log_z is None
    assert [got[n].obs_p_rank for n in ("ann", "bob", "cat")] == [0.0, 0.5, 1.0]


def test_small_features(spark):
    c = clean.citizen(records(spark, {"gbifID": "a", "occurrenceRemarks": "abc", "sex": "Male"}, {"gbifID": "b", "identifiedByID": "x"}, {"gbifID": "c", "identifiedBy": None}, {"gbifID": "d", "taxonID": 8}))
    assert sorted((r.taxonID, r.identifiedBy or "", r.taxon_id_count) for r in features.taxon_identifiers(c).collect()) == [(7, "", 1), (7, "bob", 2), (8, "bob", 1)]
    votes = c.withColumns({"num_identification_agreements": F.when(F.col("gbifID") == "a", 3).when(F.col("gbifID") == "b", 2).otherwise(0), "num_identification_disagreements": F.lit(1)})
    assert sorted(tuple(r) for r in features.community(votes).collect()) == [("a", 4, 0.75, 7, 0), ("b", 3, 0.6667, 7, 1)]
    meta = {r.gbifID: r for r in features.metadata(c).collect()}
    assert (meta["a"].meta_pheno_sex, meta["a"].meta_pheno_repro, meta["a"].meta_occurrenceRemarks, meta["a"].meta_coordinateUncertaintyInMeters, meta["b"].meta_occurrenceRemarks, meta["b"].meta_media_count) == (1, 0, 3, 0, 0, 0)
    assert tuple(features.temporal(c.filter("gbifID = 'a'")).first()) == ("a", 3, 5, 2024)
    similar = spark.createDataFrame([(7, 1, 9), (7, 2, 9), (7, 1, 10)], "taxonID int, count int, similar_taxon int")
    assert sorted(tuple(r) for r in features.confusability(c, similar).collect()) == [(7, 2), (8, 0)]


def densities(spark, *rows):
    return spark.createDataFrame(rows, "taxonID int, value_id int, count int, " + ", ".join(f"{d} double" for d in features.DENSITIES))


def test_densities_by_month(spark):
    c = clean.citizen(records(spark, {"gbifID": "a", "sex": "Male"}, {"gbifID": "b", "month": 6, "sex": "Female"}, {"gbifID": "d", "taxonID": 8}))
    table = densities(spark, (7, 11, 40, *(m / 100 for m in range(1, 13))))
    assert sorted(tuple(r) for r in features.monthly_density(c, table).select("gbifID", "histo_taxon_ttl_obs_count", "histo_taxon_obs_month_density").collect()) == [("a", 40, 0.05), ("b", 40, 0.06), ("d", None, None)]
    assert sorted(tuple(r) for r in features.annotation_density(c, table, "pheno_sex").collect()) == [("a", 0.05), ("b", 0.0), ("d", 0.0)]
    merged = features.annotations(c, table)
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 0.0, 0.0, 0.05), ("b", 0.0, 0.0, 0.0), ("d", 0.0, 0.0, 0.0)]
    got = {r.gbifID: r.pheno_score for r in score.phenology(merged, features.monthly_density(c, table)).collect()}
    assert abs(got["a"] - 0.025) < 1e-12 and abs(got["b"] - 0.015) < 1e-12 and got["d"] is None


def test_combined_features_and_scores(spark):
    c = clean.citizen(records(spark, {"gbifID": "a"}, {"gbifID": "b", "recordedBy": "solo"}, {"gbifID": "c", "taxonID": 8}, {"gbifID": "d", "recordedBy": "new"}))
    by_observer = [spark.createDataFrame([("ann", 1.0), ("solo", 2.0)], "recordedBy string, o double"), spark.createDataFrame([("ann", 3.0), ("solo", 4.0), ("new", 5.0)], "recordedBy string, oi double")]
    by_identifier = spark.createDataFrame([("solo", 9.0), ("bob", 8.0)], "identifiedBy string, i double")
    by_taxon = [spark.createDataFrame([(7, 5)], "taxonID int, t int")]
    one = lambda name, *ids: spark.createDataFrame([(i, 1) for i in ids], f"gbifID string, {name} int")
    by_record = [one(n, "a", "b", "c", "d") for n in ("h", "c", "a", "m", "gee", "sp", "r")]
    got = features.combined(c, by_observer, by_identifier, by_taxon, by_record, [one("p", "a")])
    assert got.columns == ["gbifID", "o", "oi", "i", "t", "h", "c", "a", "m", "gee", "sp", "r", "p"]
    assert sorted(tuple(r) for r in got.select("gbifID", "o", "oi", "i", "t", "p").collect()) == [("a", 1.0, 3.0, None, 5, 1), ("b", 2.0, 4.0, 9.0, 5, None)]

    part = lambda name, *rows: spark.createDataFrame(list(rows), f"gbifID string, {name} double")
    scores = [part("spatial_score", ("a", 0.5), ("a", 0.25), ("b", 1.0)), part("pheno_score", ("a", 0.1), ("b", None)), part("observer_score", ("a", 0.2), ("b", 0.2)), part("identifier_score", ("a", 0.3), ("b", 0.3)), one("cmva_expert_id", "a", "b")]
    five = score.combined(got, *scores)
    assert five.columns == ["gbifID", "spatial_score", "pheno_score", "observer_score", "identifier_score", "expert_id_score"] and five.count() == 3
    total = score.total(got, scores, ["spatial_score", "pheno_score", "observer_score", "identifier_score", "cmva_expert_id"])
    assert sorted((r.gbifID, None if r.score is None else round(r.score, 6), r.o) for r in total.collect()) == [("a", 1.85, 1.0), ("a", 2.1, 1.0), ("b", None, 2.0)]


def test_observer_score_and_matches(spark):
    c = clean.citizen(records(spark, {"gbifID": "a"}, {"gbifID": "b", "recordedBy": "solo"}, {"gbifID": "c", "recordedBy": "none"}))
    profile = features.observer(c)
    standing = spark.createDataFrame([("ann", 1.0, 2.0), ("solo", None, 2.0)], "recordedBy string, observations_count_log_z double, species_count_log_z double")
    got = {r.gbifID: r.observer_score for r in score.observer(c, profile.na.fill(0.0), standing).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] - (0.2 * 1 + 0.1 * 1 + 0.1 * 1.0 + 0.1 * 2.0)) < 1e-9 and got["b"] == 0.0
    assert {"obsv_unique_year_count", "obs_per_year"} <= set(profile.columns)
    labels = c.withColumn("expert_match", (F.col("gbifID") == "a").cast("int"))
    assert [round(x, 6) for x in score.matches(labels).first()] == [3, 1, 0.333333]
    gee = spark.createDataFrame([("a", "g1", "p", 0.5), ("z", "g2", "p", 0.7)], "gbifID string, gee_id string, coordinates string, ndvi double")
    assert sorted(tuple(r) for r in features.samples(labels, gee, gee).collect()) == [("a", 0.5), ("a", 0.5)]


def test_landed_files(spark, tmp_path):
    (tmp_path / "o.tsv").write_text('gbifID\tspecies\tdecimalLongitude\tdecimalLatitude\n1\tA "x\t-73.5\t45\n2\tB\t\tn\n')
    got = landed.occurrences(spark, str(tmp_path / "o.tsv")).collect()
    assert [(r.gbifID, r.species, r.geom.x, r.geom.y) for r in got] == [("1", 'A "x', -73.5, 45.0), ("2", "B", None, None)]
    assert landed.occurrences(spark, str(tmp_path / "o.tsv"), ["species"]).columns == ["species"]
    folder = tmp_path / "one"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n1,x\n")
    (folder / "b.txt").write_text("no")
    assert [tuple(r) for r in landed.single_csv(spark, str(folder)).collect()] == [("1", "x")]
    (folder / "c.csv").write_text("k\n")
    with pytest.raises(ValueError, match="one CSV"):
        landed.single_csv(spark, str(folder))
    landed.land(spark.createDataFrame([(5, "x")], "id int, login string"), "id", str(tmp_path / "landed"))
    back = landed.responses(spark, str(tmp_path / "landed")).first()
    assert (back.item_key, json.loads(back.json)) == (5, {"id": 5, "login": "x"})
    landed.save(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string"), "raw.letters")
    landed.save(spark.createDataFrame([(4, "d")], "k int, v string"), "raw.letters", append=True)
    assert [r.k for r in landed.loaded(spark, "raw.letters", ["k"], 2).collect()] == [1, 2] and landed.loaded(spark, "raw.letters").count() == 4
    answer = {"results": [{"uuid": "u", "quality_grade": "research", "location": "45.5,-73.5", "taxon": {"id": 7}, "user": {"id": 5}, "identifications": [{"id": 1}, {"id": 2}], "photos": []}]}
    (tmp_path / "obs.json").write_text(json.dumps(answer))
    o = landed.observation(spark, str(tmp_path / "obs.json")).first()
    assert (o.uuid, o.lat, o.lon, o.n_identifications, o.n_photos, o.taxon.id) == ("u", 45.5, -73.5, 2, 0, 7)


def test_clipped_ranges(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert sorted(clipped([(-1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (-1.0, 2.0)], square)) == [(0.0, 1.0), (0.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    assert clipped([(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)], square) == [] and sorted(clipped(square, square[::-1])) == sorted(square)
    texts = spark.createDataFrame([(1, "POLYGON ((-1 1, 2 1, 2 2, -1 2, -1 1))"), (2, "POLYGON ((9 9, 10 9, 10 10))")], "taxon_id int, wkt string")
    got = landed.ranges(texts, "taxon_id", area="POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))")
    assert [(r.taxon_id, r.minx, r.maxx) for r in got.collect()] == [(1, 0.0, 2.0)]
    assert [r.taxon_id for r in landed.in_box(landed.ranges(texts, "taxon_id"), 5, 5, 9.5, 9.5).collect()] == [2]
    assert geojson("POLYGON ((0 0, 1 0, 1 1, 0 0))") == {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    assert geojson("MULTIPOLYGON (((0 0, 1e1 0, 1 1)), ((5 5, 6 5, 6 6)))")["coordinates"][1] == [[[5, 5], [6, 5], [6, 6]]] and geojson("POINT (1 -2.5)")["coordinates"] == [1, -2.5]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, -73.5, 45.0, "n") for i in range(150)], "k int, x double, y double, name string")
    landed.export_features(df, str(tmp_path / "geo"), "x", "y", ["k", "name"])
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert len(lines) == 150 and lines[0]["geometry"] == {"type": "Point", "coordinates": [-73.5, 45.0]} and set(lines[0]["properties"]) == {"k", "name"}
    landed.export_sample(df, str(tmp_path / "csv"))
    assert sorted(int(r.k) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == list(range(100))


def test_strata_and_codes(spark):
    rows = [(i, float(i % 6), "common" if i % 50 else f"rare{i}", 4 + i % 5) for i in range(600)] + [(600, None, "common", 4)]
    df = spark.createDataFrame(rows, "k int, cluster double, species string, month int")
    got = {r.k: r.stratum for r in prep.strata(df, "cluster", "species", "month", 6, 12).collect()}
    assert got[600] == "mixed_stratum" and len(got) == 601
    counts = {}
    for v in got.values():
        counts[v] = counts.get(v, 0) + 1
    assert all(n > 1 for k, n in counts.items() if k != "mixed_stratum") and got[1] == got[31] and got[0].split("_")[1] == "1" and got[1].split("_")[1] == "0"
    values = spark.createDataFrame([(f"v{i:04}",) for i in range(1000)], "v string")
    assert all(int(r.v[1:]) == r.code for r in prep.dense_codes(values, "v", "code").collect())
    x = spark.createDataFrame([(float(v),) for v in (5, 1, 1, 2, 9, 9, 9, 30)] + [(None,)], "x double")
    edges = aggregates.exact_quantiles(x, "x", [0.0, 0.25, 0.3, 0.5, 1.0]).first().edges
    assert [round(e, 9) for e in edges] == [1.0, 1.75, 2.3, 7.0, 30.0]


def test_mutual_information_compares_edges_without_lambdas(spark, monkeypatch):
    r = random.Random(5)
    rows = [(r.choice([None, 1.0, 1.0, 2.0, 5.0]), r.choice([None, float(i % 7), 3.5]), r.choice([None, float(i)])) for i in range(300)]
    rows += rows[:90] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "a double, b double, y double")

    def bins(values, n):
        known = sorted(v for v in values if v is not None)
        places = [(len(known) - 1) * i / n for i in range(n + 1)]
        edges = sorted({known[int(p)] + (p - int(p)) * (known[math.ceil(p)] - known[int(p)]) for p in places})
        return [None if v is None else sum(e < v for e in edges[1:-1]) for v in values]

    a, b, y = (bins(list(x), 4) for x in zip(*rows, strict=True))
    found = prep.mutual_information(df, ["a", "b"], "y", 4)
    got = {x.column: x.information for x in found.collect()}
    for name, x in (("a", a), ("b", b)):
        pairs = [p for p in zip(x, y, strict=True) if None not in p]
        n, left, right = len(pairs), [p[0] for p in pairs], [p[1] for p in pairs]
        assert got[name] == pytest.approx(sum(c / n * math.log2(c * n / (left.count(p[0]) * right.count(p[1]))) for p in set(pairs) for c in (pairs.count(p),)))
    assert prep.mutual_information(df.filter("false"), ["a", "b"], "y").collect() == []
    # The only lambdas left are over the edges of each column, not over rows.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("lambda" in x for x in plan.splitlines()) <= 3
    # One by one or through a lambda, edges are compared alike, NaN, infinite and null values included.
    odd = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, None, -0.0, 0.0, float("nan"), float("inf"), float("-inf"), 7.5)], "x double")
    either = []
    for most in (64, 0):
        monkeypatch.setattr(prep, "COMPARED", most)
        either.append([sorted((repr(x.x), x.bin) for x in prep.quantile_bins(odd.withColumn("other", F.lit(1)), "x", n, "bin", odd).collect()) for n in (1, 3, 10)])
    assert either[0] == either[1]


def test_encoder(spark):
    r = random.Random(1)
    rows = [(i, float(i), 2.0 * i + r.random(), 3.0 * i + r.random(), r.random(), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, kind string")
    assert [c for c in prep.encoded(df, "id").columns] == ["id", "pca1", "pca2"]
    plain = prep.encoded(df.select("id", "a", "d", "kind"), "id")
    assert plain.columns == ["id", "a", "d", "kind_encoded"] and {x.kind_encoded for x in plain.collect()} == {0, 1}
    landed.save(df.select("id", "a", "d"), "features.enc")
    assert prep.encoded_table(spark, "enc", "id").columns == ["id", "a", "d"]
    landed.save(df.select("id", "a"), "transformed.enc")
    assert prep.encoded_table(spark, "enc", "id").columns == ["id", "a"]


def test_models(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.random(), r.random(), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, g, 3 * a + 0.1 * b, int(a > 0.8)) for i, a, b, g in rows], "id int, a double, b double, g string, y double, bad int")
    model, metrics = models.evaluated(df, "id", "g", "y", ["a", "b"], "linear")
    assert {m.part: m.r2 > 0.999 for m in metrics.collect()} == {"validate": True, "test": True}
    model.write().overwrite().save(str(tmp_path / "model"))
    again = models.PipelineModel.load(str(tmp_path / "model"))
    assert again.transform(df).agg(F.sum("prediction")).first()[0] == model.transform(df).agg(F.sum("prediction")).first()[0]
    forest = models.trained(df, "y", ["a", "b"], "forest", trees=5)
    ranked = models.importances(forest, ["a", "b"])
    assert [n for n, _, _ in ranked] == ["a", "b"] and all(d >= 0 for _, _, d in ranked)
    fitted = models.trained_classifier(df, "bad", ["a", "b"])
    got = models.classification_metrics(fitted.transform(df), "bad")
    assert got["recall"] > 0.9 and got["roc"] > 0.95 and got["tp"] + got["fn"] == sum(a > 0.8 for _, a, _, _ in rows)
    curve = [x.probability for x in models.logistic_curve(df, "a", "bad", 20).orderBy("a").collect()]
    assert len(curve) == 20 and curve == sorted(curve) and curve[0] < 0.1 < 0.9 < curve[-1]
    overall = models.overall_quality(df, df, ["y", "a"], ["a", "b"], trees=3, weights=(0.6, 0.4)).first()
    assert abs(overall.overall - 0.6 * overall.y_predicted - 0.4 * overall.a_predicted) < 1e-9


def test_columns(spark):
    df = spark.createDataFrame([(1, "x", None), (None, "y", "z")], "a int, b string, c string")
    assert [r[0] for r in df.select(joined_key("a", "b")).collect()] == ["1_x", None]
    assert json.loads(df.select(as_json(["a", "b"])).first()[0]) == {"a": 1, "b": "x"}
    assert [r[0] for r in df.select(value_map("b", {"x": 1, "q": 2})).collect()] == [1, None]
    shares = aggregates.row_shares(spark.createDataFrame([(1.0, 3.0), (None, 2.0), (0.0, 0.0)], "p double, q double"), ["p", "q"]).collect()
    assert [(r["sum"], r.p_per, r.q_per) for r in shares] == [(4.0, 0.25, 0.75), (2.0, None, 1.0), (0.0, None, None)]


def test_rows_of_identifiers_are_dealt_before_they_are_counted(spark):
    rows = spark.range(4000).select(F.concat(F.lit("w"), F.col("id") % 50).alias("who"), F.lit("x").alias("author"), (F.col("id") % 3).cast("string").alias("species"), F.lit("2024-05-03").alias("seen"), F.lit("2024-05-10").alias("named"))
    found = aggregates.identifications(rows.repartition(4), "who", "author", "species", "seen", "named")
    got = found.collect()
    assert len(got) == 50 and all((r.id_count, r.avg_id_time, r.id_avg_yearly_obs) == (80, 7.0, 80.0) for r in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("RebalancePartitions")  # an operator stands above its input
