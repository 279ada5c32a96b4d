"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest

from herbarius.llm import decontaminate, hamming_topk, ngram_jaccard, pii, quality, secret_scan, sentencepiece_dropout, token_counts, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key int, score double, __text string, word string, base int"
LONG = "lorem ipsum dolor sit amet " * 20_000


def rows():
    extra = ("x", 1, 2, 0.5, "y", "w", 3)
    return [
        (1, "one two three four five six seven", "en", "a", 33, *extra),
        (1, "one two three four five six seven", "en", "a", 33, *extra),
        (2, "one two three four five six seven", None, None, None, *extra),
        (3, None, "en", "a", 0, *extra),
        (4, "", "en", "a", 0, *extra),
        (5, " \n\t ", "en", "a", 4, *extra),
        (6, LONG, "en", "b", len(LONG), *extra),
        (None, "one two three four five six seven", "en", "a", 33, *extra),
        (None, None, None, None, None, *extra),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven", "q"), (2, None, "q"), (None, "x y z", "q"), (3, "", "q")], "item_id long, text string, lang string")


def test_tokens(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.token_counts(docs, path).collect()
    assert len(got) == len(rows()) and {(r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id in (3, 4)} == {(0, 0, False)}
    assert token_counts.token_counts(none, path).count() == 0
    assert sorted(len(r.prefix_tokens) for r in token_counts.prefix_token_counts(docs.filter("doc_id < 6"), path).collect()) == [1, 1, 5, 34, 34, 34]


def test_sentencepiece(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    tokens = sentencepiece_dropout.encode(docs, path, 0.3, 5)
    got = sentencepiece_dropout.decode_ids(tokens, path).collect()
    want = sorted((str(r[0]), r[1] or "") for r in rows())
    assert sorted((str(r.doc_id), r.decoded) for r in got) == want
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 1
    assert sentencepiece_dropout.encode(none, path).count() == 0


def test_jaccard(docs, none):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard.jaccard_components(docs, 3, 9, 10).collect())
    assert got == [("1", 5, "1"), ("1", 5, "1"), ("2", 5, "1"), ("3", 0, "3"), ("4", 0, "4"), ("5", 0, "5"), ("6", 5, "6"), ("None", 0, "None"), ("None", 5, "None")]
    kept = ngram_jaccard.first_of_each(docs, 3, 9, 10)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "None", "None"]
    assert ngram_jaccard.jaccard_components(none).count() == 0 and ngram_jaccard.first_of_each(none).count() == 0


def test_secrets(docs, none):
    got = secret_scan.secret_spans(docs).collect()
    assert len(got) == len(rows()) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.exceptAll(docs).count() == 0
    assert secret_scan.secret_spans(none).count() == 0 and secret_scan.redact_secrets(none).count() == 0


def test_decontamination(docs, none, benchmark):
    got = sorted(str(r.doc_id) for r in decontaminate.leaks(docs, benchmark).collect())
    assert got == ["1", "1", "2", "None"]
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "None"]
    assert decontaminate.leaks(none, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == len(rows())


def test_personal_data(docs, none):
    got = pii.personal_data(docs, sanitised=True).collect()
    assert sorted((str(r.doc_id), r.sanitised or "") for r in got) == sorted((str(r[0]), r[1] or "") for r in rows())
    assert {r.spans for r in got} == {""} and pii.personal_data(none).count() == 0


def test_quality(docs, none, labels):
    got = quality.quality_scores(docs, labels)
    assert got.count() == len(rows()) and got.filter("score is null").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows())


def test_toxicity(docs, none, labels):
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == len(rows())


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, None, "a"), (3, "v\r\nX: y", None), (4, "w", ""), (None, "z", "a"), (1, "u", "a")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.round_trip(pages).collect())
    assert got == [("1", 1, "response", "None"), ("1", 1, "response", "None"), ("2", 1, "revisit", "1"), ("3", 0, "response", "None"), ("4", 0, "revisit", "3"), ("None", 1, "response", "None")]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_extra_columns_and_a_long_page(spark):
    pages = spark.createDataFrame([(1, "u", LONG * 8, 9, "x", "y"), (2, "v", LONG * 8, 9, "x", "y"), (3, "w", "\x00\x1f\x8b\x08" * 1000, None, None, None)], "page_id long, url string, html string, payload_bytes int, sha string, first string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(1, len(LONG) * 8, "response", None), (2, len(LONG) * 8, "revisit", 1), (3, 5000, "response", None)]


def test_hamming(spark):
    vectors = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, None]), (2, [1.0, None]), (3, None), (None, [1.0, 1.0]), (4, [])], "vec_id long, embedding array<float>")
    codes = hamming_topk.binary_codes(vectors)
    got = sorted(tuple(r) for r in hamming_topk.hamming_topk(codes, codes.filter("id = 1"), 2).collect())
    assert got == [(1, 1, 2, 0), (1, 2, 4, 1)]
    assert hamming_topk.hamming_topk(codes.limit(0), codes.limit(0)).count() == 0


def test_quality_of_renamed_columns(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id % 4 < 2"), spark.read.parquet(f"{data}/labels.parquet")
    names = {"text": "body", "lang": "language", "source": "origin", "n_chars": "size"}
    options = {"text_col": "body", "lang_col": "language", "source_col": "origin", "size_col": "size"}
    want = sorted(tuple(r) for r in quality.quality_scores(docs, labels, rounds=1).collect())
    renamed = docs.withColumnsRenamed(names)
    assert sorted(tuple(r) for r in quality.quality_scores(renamed, labels, rounds=1, **options).collect()) == want
    kept = quality.keep_good(renamed, labels, rounds=1, **options)
    assert kept.columns == renamed.columns and kept.count() == sum(r[-1] for r in want)
