"""Removal of repeated strings against all windows, and the suffix sort against sorted suffixes."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from herbarius.llm import suffix_dedup


def by_hand(texts, length):
    """n_bytes, n_removed, n_spans, kept of each text, from all its windows."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def got(spark, texts, length=400):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, n int").repartition(5)
    rows = sorted(suffix_dedup.remove_repeats(df, length).collect())
    for r in rows:
        assert sum(x.end - x.start for x in r.spans) == r.n_removed
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz é", k=r.randint(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    shared = [prose(r.randint(40, 160)) for _ in range(12)]
    texts = [None, "", " ", "short"]
    for _ in range(n):
        parts = [prose(r.randint(1, 80))]
        for _ in range(r.randint(0, 3)):
            x = r.choice(shared)
            if r.random() < 0.5:  # part of a passage, near the bound of 400 bytes
                a = r.randint(0, max(0, len(x) - 400))
                x = x[a : a + r.randint(330, 480)]
            if r.random() < 0.3:
                i = r.randrange(len(x))
                x = x[:i] + "#" + x[i + 1 :]
            parts += [x, prose(r.randint(0, 40))]
        texts.append(" ".join(parts))
    texts += [texts[10], texts[10], texts[11] + " end", texts[12][:-1], texts[13][50:], prose(300)]
    # Within one text, without cuts, of a short period, and with one.
    texts += [prose(70) + (x := prose(90)) + "|" + x, "a" * 3000, "b" * 399, "c" * 400, "d" * 401, "xyz" * 500, "=" * 1200 + texts[20], "0123456789abcdef" * 60, prose(5) + "-" * 450]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_all_windows(spark, seed):
    texts = corpus(seed)
    have, want = got(spark, texts), by_hand(texts, 400)
    assert [(i, h) for i, (h, w) in enumerate(zip(have, want, strict=True)) if h != w] == []


def test_other_lengths_and_edges(spark):
    texts = corpus(3, 25)
    assert got(spark, texts, 150) == by_hand(texts, 150)
    assert got(spark, [None, "", "a"]) == by_hand([None, "", "a"], 400)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_rows_without_id_and_repeated_rows(spark):
    x = "A passage that two rows have. " * 20
    df = spark.createDataFrame([(None, x), (1, x), (1, x), (2, "other"), (None, None)], "name string, body string")
    rows = suffix_dedup.remove_repeats(df, 400, "name", "body").collect()
    assert sorted((r.name or "", r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [("", 0, 0, 0), ("", 600, 600, 1), ("1", 600, 600, 1), ("1", 600, 600, 1), ("2", 5, 0, 0)]


def test_texts_are_shuffled_once(spark, monkeypatch):
    moved, store = [], suffix_dedup.stored

    def stored(df, name, *args, **more):
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        moved.extend(name for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan) if re.search(r"\btext#|\bfirst#|_0#\d+.*valueSet", x) and name in ("texts", "lots", "kept"))
        return store(df, name, *args, **more)

    monkeypatch.setattr(suffix_dedup, "stored", stored)
    r = random.Random(11)
    prose = lambda: " ".join(str(r.random()) for _ in range(60))
    same = prose()
    texts = [x := prose(), x[:700] + " other " + x[400:], x[:450] + prose(), "short", "", None, "short"] + [same] * 6 + [prose() for _ in range(10)]
    rows = sorted(suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == by_hand(texts, 400)
    assert moved == ["texts"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    # As many buckets as the session has partitions; rows are read back from tables as they were.
    df = spark.createDataFrame([(bytes([i]), str(i) if i % 3 else None) for i in range(50)], "fp binary, x string")
    out = store(df, "dealt", key="fp")
    assert sorted(out.collect()) == sorted(df.collect())
    assert {int(f.rpartition("_")[2].partition(".")[0]) for f in out.inputFiles()} == set(range(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    suffix_dedup.discard(out)


def test_ranks_are_those_of_sorted_suffixes(spark):
    r = random.Random(5)
    strings = [[r.randint(1, 3) for _ in range(r.randint(1, 40))] for _ in range(40)] + [[1] * 30, [1] * 31, [2, 1] * 15, [5]]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(strings)], "s long, path long, names array<bigint>")
    ranks = {(row.s, i): k for row in suffix_dedup.suffix_ranks(df, 40).collect() for i, k in zip(row.i, row.rank, strict=True)}
    suffixes = sorted((x[i:], s, i) for s, x in enumerate(strings) for i in range(len(x)))
    assert len(ranks) == len(suffixes)
    for (a, s, i), (b, t, j) in zip(suffixes, suffixes[1:], strict=False):
        assert ranks[s, i] == ranks[t, j] if a == b else ranks[s, i] < ranks[t, j]


def test_equal_texts_are_parsed_once_and_blocks_meet(spark, monkeypatch):
    parsed, store = [], suffix_dedup.stored

    def stored(df, *args, **more):
        out = store(df, *args, **more)
        if "cores" in out.columns:
            parsed.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "stored", stored)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3, raising=False)
    r = random.Random(9)
    texts = [x := " ".join(str(r.random()) for _ in range(60)), x[:700] + " other " + x[400:], x[:450], "short"] + [x] * 20
    assert got(spark, texts) == by_hand(texts, 400)
    assert parsed and max(parsed) == 3


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_neighbours_and_groups_over_batches(size):
    r = random.Random(size)
    chains = sorted([r.randint(1, 2) for _ in range(r.randint(1, 9))] for _ in range(40))
    at = [k + (k > 20) * 5 for k in range(40)]  # two blocks
    table = pa.table({"at": at, "own": [k % 7 != 0 for k in range(40)], "rank": list(range(100, 140)), "many": [k % 11 == 3 for k in range(40)], "chain": pa.array(chains, type=pa.list_(pa.int64()))})
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = {}
    for k, x in enumerate(chains):
        beside = [chains[j] for j in (k - 1, k + 1) if 0 <= j < 40 and abs(at[j] - at[k]) == 1]
        if k % 7:
            want[100 + k] = len(x) if k % 11 == 3 else max(common(x, y) for y in beside)
    rows = [(x["rank"], x["t"]) for b in suffix_dedup._common(iter(table.to_batches(size))) for x in b.to_pylist()]
    assert len(rows) == len(want) and dict(rows) == want
    keys = sorted(r.choices(range(8), k=40))
    groups = [b.column("s").to_pylist() for b in suffix_dedup._whole(iter(pa.table({"s": keys}).to_batches(size)))]
    assert sum(groups, []) == keys and all(a[-1] != b[0] for a, b in zip(groups, groups[1:], strict=False))


def test_tables_without_dictionaries(spark):
    """Building them for names and hashes is given up after each file's first megabyte at best."""
    import pyarrow.dataset as ds

    out = suffix_dedup.stored(spark.range(1000).selectExpr("id % 10 as x"), "plain")
    files = [f for f in ds.dataset(out._stored_at.removeprefix("file:"), format="parquet").get_fragments() if f.metadata.num_rows]
    assert files and not any("DICTIONARY" in e for f in files for e in f.metadata.row_group(0).column(0).encodings)
    assert spark.conf.get("parquet.enable.dictionary", None) is None and sorted({r.x for r in out.collect()}) == list(range(10))
