"""Alignment of tokenizers against a plain two-pointer walk."""

import collections
import hashlib
import random
from urllib.parse import urlparse

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from herbarius.llm import token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aàéΣσſKİiß'’` \t\n<|>.,!09½一한\U0001F600‍strelvm#@$_-\x1c\x85　▁\0"


def by_hand(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text, from the libraries' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    to_byte = token_align._byte_level()
    all_links, out = [], []
    for text in texts:
        links, groups, own = [], [], (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != own or b"".join(bytes_b) != own:
            ids_a, ids_b = [], []
        i = j = at_a = at_b = 0
        left, right = [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                at_a += len(bytes_a[i])
                left.append(ids_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                right.append(ids_b[j])
                j += 1
            if at_a == at_b:
                groups.append((left, right))
                links += [(x, y) for x in left for y in right]
                left, right = [], []
        name = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        all_links.append(links)
        out.append([len(ids_a), len(ids_b), len(groups), len(links), 0, 0, hashlib.sha256(name.encode()).hexdigest() if ids_a else ""])
    count = collections.Counter(p for links in all_links for p in set(links))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for row, links in zip(out, all_links, strict=True):
        row[4] = sum(count[p] == most[p[0]] for p in links)
        row[5] = sum(count[p] for p in links)
    return [tuple(x) for x in out]


def got(spark, rows):
    df = token_align.align_tokens(spark.createDataFrame(rows, "doc_id long, text string, pair int, n int, block string"), A, B)
    return sorted((r.doc_id is None, r.doc_id or 0, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def test_alignment_is_the_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK", 500)
    r = random.Random(3)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += [x[0] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    texts += [None, "", " ", "<|endoftext|> <s> </s><0x0A>", "\U0001F9EC" * 300, "x" * 5000, "qzjxw" * 400, " \n\t ", "same text", "same text"]
    want = by_hand(texts)
    rows = [(i, t, 1, 2, "z") for i, t in enumerate(texts)]
    assert got(spark, rows) == sorted((False, i, w) for i, w in enumerate(want))


def test_long_groups_by_their_ids():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = r.integers(0, 9, 500), r.integers(0, 9, 400)
    sizes, doc = (np.array([1, 300, 199]), np.array([2, 30, 368])), np.array([0, 0, 1])
    want, i, j = collections.Counter(), 0, 0
    for x, y, d in zip(*sizes, doc, strict=True):
        want.update((int(d) << 48) + (int(p) << 24) + int(q) for p in a[i : i + x] for q in b[j : j + y])
        i, j = i + x, j + y
    keys, often = token_align._expanded(a, b, *sizes, doc)
    assert dict(zip(keys.tolist(), often.tolist(), strict=True)) == want and sorted(keys.tolist()) == keys.tolist()


def test_ranks_give_the_librarys_ids():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(A), token_align.ByteBpe(A)
    library.encode_special_tokens = True
    texts = [f" a{chr(c)}b {chr(c)} 1{chr(c)}2 .{chr(c)}!{chr(c)}\n{chr(c)} 's{chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += ["<|endoftext|>x <|endoftext|>", "", "  ", "a" * 5000, " " * 5000]
    assert own.encode(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_edges(spark):
    want = by_hand(["one two", "one two", None, "", "one two"])
    rows = [(1, "one two", 1, 2, "z"), (1, "one two", 1, 2, "z"), (2, None, 1, 2, None), (3, "", 1, 2, "z"), (None, "one two", 1, 2, "z")]
    assert got(spark, rows) == sorted([(False, 1, want[0]), (False, 1, want[1]), (False, 2, want[2]), (False, 3, want[3]), (True, 0, want[4])])
    assert got(spark, []) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_go_to_their_library(tmp_path, name):
    import json

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(changed))
    assert token_align.ByteBpe(str(changed)).encode(["abc def"]) == [library.encode("abc def", add_special_tokens=False).ids]


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK", 50)
    groups, plans, plain = {}, {}, token_align.stored

    def stored(df, name, **more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = plain(df, name, **more)
        files = [pq.ParquetFile(urlparse(f).path).metadata for f in out.inputFiles()]
        groups[name] = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
        return out

    monkeypatch.setattr(token_align, "stored", stored)
    rows = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("some words that go on").alias("text"))
    assert token_align.align_tokens(rows, A, B).filter("n_best > 0").count() == 40
    assert len(groups["aligned"]) > 1 and set(groups["aligned"]) == {1}
    assert "collect_list" not in plans["links"]
