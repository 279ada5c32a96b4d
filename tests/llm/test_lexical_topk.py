"""Ranked search through wavelet trees against scores of all documents."""

import collections
import math
import random
import re
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from herbarius.llm import lexical_topk

WORDS = ["the", "The", "a", "of", "x1", "É", "été", "日本", "end", "rare", "İ"]


def by_hand(rows, items, k):
    """(item, rank, doc_id, score) by the definition, for rows (id, text)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [collections.Counter(cut(t)) for _, t in rows]
    n = [sum(c.values()) for c in tf]
    docs, total = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), c, length in zip(rows, tf, n, strict=True):
            score = 0
            for t in cut(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + (25 * length * docs) // total)))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def texts(n, seed, words=WORDS, most=30):
    r = random.Random(seed)
    return [r.choice([" ", ", ", "-"]).join(r.choices(words, [2.0**-j for j in range(len(words))], k=r.randint(0, most))) for _ in range(n)]


def test_search_is_the_definition(spark):
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts(300, 1))] + [(2000 + i, "rare end") for i in range(40)] + [(5000, None), (5001, ""), (5002, " \n."), (7, "été x"), (7, "été x"), (None, "rare end"), (6000, "rare " * 20_000)]
    items = [(1, "the rare end of"), (2, "rare rare end"), (3, None), (4, ""), (5, "nowhere"), (6, "É日本 été x1 The"), (6, "rare"), (7, "a")]
    docs = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, item string, rank int").repartition(7)
    asked = spark.createDataFrame([(*x, "z", 2.0) for x in items], "item_id long, text string, term string, score double")
    got = lexical_topk.lexical_topk(docs, asked, k=20)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, items, 20)


def test_ids_of_text_and_no_rows(spark):
    rows = [(c, t) for c, t in zip("fedcbahg", texts(8, 2), strict=True)]
    docs = spark.createDataFrame(rows, "name string, body string")
    asked = spark.createDataFrame([("q", "the a of")], "item string, words string")
    got = lexical_topk.lexical_topk(docs, asked, 3, "name", "body", "item", "words")
    want = by_hand([(ord(i), t) for i, t in rows], [("q", "the a of")], 3)
    assert sorted((r.item, r.rank, ord(r.name), r.score) for r in got.collect()) == sorted(want)
    assert lexical_topk.lexical_topk(docs.limit(0), asked, 3, "name", "body", "item", "words").collect() == []
    assert lexical_topk.lexical_topk(docs, asked.limit(0), 3, "name", "body", "item", "words").collect() == []
    assert lexical_topk.lexical_topk(docs.withColumn("body", docs["body"].substr(0, 0)), asked, 3, "name", "body", "item", "words").collect() == []


@pytest.mark.parametrize("documents", [1, 2, 37, 1000])
def test_tree_finds_the_best_of_one_shard(documents, monkeypatch):
    monkeypatch.setattr(lexical_topk, "AT_ONCE", 4)
    r = np.random.default_rng(documents)
    lists = [np.sort(r.choice(documents, size=r.integers(1, documents + 1), replace=False)) for _ in range(6)]
    impacts = [r.integers(1, 5, len(x)) for x in lists]
    order = [np.lexsort((d, -v)) for d, v in zip(lists, impacts, strict=True)]
    levels = max(1, (documents - 1).bit_length())
    seq, bits = np.concatenate([d[o] for d, o in zip(lists, order, strict=True)]), []
    for level in range(levels):
        bits.append(np.packbits((seq >> (levels - 1 - level)) & 1 == 1).tobytes())
        seq = seq[np.argsort(seq >> (levels - 1 - level), kind="stable")]
    tree = lexical_topk.Tree(documents, np.cumsum([0, *map(len, lists)]), np.concatenate([v[o] for v, o in zip(impacts, order, strict=True)]), b"".join(bits))
    for _ in range(20):
        terms = r.choice(6, size=r.integers(1, 6), replace=False)
        weight = r.integers(1, 4, len(terms))
        score = np.zeros(documents, dtype=np.int64)
        for t, w in zip(terms, weight, strict=True):
            score[lists[t]] += w * impacts[t]
        every = sorted((-s, d) for d, s in enumerate(score.tolist()) if s)
        for k in (1, 5, 50):
            assert tree.best(tree.starts[terms], tree.starts[terms + 1], weight, k) == [(-s, d) for s, d in every[:k]]
        if every:
            s, d = every[len(every) // 2]
            over = [(-x, y) for x, y in every if (x, y) < (s, d)][:5]
            assert tree.best(tree.starts[terms], tree.starts[terms + 1], weight, 5, -s, d)[: len(over)] == over


def test_best_documents_carry_from_shard_to_shard(monkeypatch):
    monkeypatch.setattr(lexical_topk, "SHARD_BYTES", 200)
    rows = [(i * 7 % 501, t) for i, t in enumerate(texts(500, 5))]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows])], names=["id", "text"])
    postings = list(lexical_topk._shards([batch]))
    assert len(postings) > 20
    n = [x for b in postings for x in b.column("n")[0].as_py()]
    docs, tokens = sum(x > 0 for x in n), sum(n)
    df = collections.Counter()
    for b in postings:
        starts = b.column("starts")[0].as_py()
        df.update({t: y - x for t, x, y in zip(b.column("terms")[0].as_py(), starts, starts[1:], strict=False)})
    items = [(0, "the a of"), (1, "rare end end")]
    weights = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for t, x in df.items()}
    block = [(i, dict(collections.Counter(lexical_topk.terms_of(t)))) for i, t in items]
    (got,) = lexical_topk._searched(block, weights, 20)(lexical_topk._trees(docs, tokens)(x for x in postings if len(x.column("terms")[0])))
    found = collections.defaultdict(list)
    for r in got.to_pylist():
        found[r["item"]].append((r["id"], r["score"]))
    assert sorted(((i, rank, d, s) for i, x in found.items() for rank, (d, s) in enumerate(x, 1)), key=str) == by_hand(rows, items, 20)


def test_a_row_group_has_one_shard(spark, monkeypatch):
    groups, plain = {}, lexical_topk.stored

    def stored(df, name, **more):
        out = plain(df, name, **more)
        files = [pq.ParquetFile(urlparse(f).path).metadata for f in out.inputFiles()]
        groups[name] = sorted(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups))
        return out

    monkeypatch.setattr(lexical_topk, "stored", stored)
    rows = spark.range(3, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("concat('t', id, repeat(' word', 1700000))").alias("text"))
    index = lexical_topk.build_index(rows)
    assert groups["postings"] == groups["shards"] == [1, 1, 1] and (index.documents, index.tokens) == (3, 5_100_003)
    index.discard()
