"""The pipeline's stages, each judged on its own input."""

import pytest

from herbarius.llm import decontaminate, secret_scan
from herbarius.llm.common import stored, table
from test_operators import components_by_brute_force

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, DATA, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], DATA), name).cache())
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(steps):
    assert all(sorted(x.columns) == sorted(steps[0].columns) for x in steps[1:-1])


def test_quality_keeps_good_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    gone = ids(steps[0]) - ids(steps[1])
    assert sum(labels.get(i) == 1 for i in gone) <= 2 and gone


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids(steps[2]) == {d for d, (_, c) in components_by_brute_force(rows, 5, 4, 5).items() if d == c}


def test_leaks_go(spark, steps):
    items = [b" ".join(decontaminate.words_of(r.text)) for r in table(spark, DATA, "benchmark").collect()]
    left = [b" ".join(decontaminate.words_of(r.text)) for r in steps[3].collect()]
    assert not any(x in t for x in items for t in left)


def test_secrets_go_and_documents_stay(steps):
    assert ids(steps[4]) == ids(steps[3])
    assert not any(secret_scan.scan(r.text) for r in steps[4].collect())
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_run(spark, steps):
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {(r.doc_id, tuple(r.ids)) for r in steps[5].collect()}


def test_run_over_nulls_empty_tables_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, leaks boolean, keys int"
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "web", len(t or ""), "x", 0.5, True, 1) for i, t in enumerate([None, "", "  ", "one two three four five six", "one two three four five six", "token=abcdefgh12 and more words here"])]
    for name, some in (("full", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (None, 0, 1)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")][: len(some)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, at).collect()}
        assert got == ({0, 1, 2, 3, 5} if some else set())
