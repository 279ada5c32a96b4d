"""Alignment of two tokenizers' tokens on one text, by byte offsets.

Tokens of either side end at cumulative byte offsets.  Two pointers go over both rows of ends:
where an end of one side is an end of the other, a group closes, and all tokens of a group are
linked with each other.  The pointers' places are taken for all ends of a block of texts at
once, as the ends of a block's texts follow each other on one axis.

What the corpus says of a link is the number of documents that hold its pair of ids.  A block of texts
hands over each of its pairs once, with the number of its documents; Spark sums these by pair,
takes the highest count of each id, joins both to the pairs of the blocks and brings them to the
blocks' documents.  So a pair that every document has is one row a block, never one a document.

A group of k and m tokens has k * m links; their number comes by multiplication, and the different
pairs of long groups from the different ids of either side, so no group is written out.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Bytes of text of a block, and links of a group that are written one by one.
BLOCK, PLAIN = 2 << 20, 64
#: Bits of a pair's second id.
SHIFT = 24
#: Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for
    itself, the other bytes in order for the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE of a tokenizers file, special strings being plain text.

    Where ids follow the order of merges, as they do unless a vocabulary was changed by hand, and
    nothing but the usual split goes before, the ids are the ranks of merges, and the faster
    library for ranks gives the same ids; else the file's own library is used.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, table = spec["model"], _byte_level()
        special = {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
        size = 1 + max([*model["vocab"].values(), *special])
        self.bytes: list[bytes] = [b""] * size
        ranks = {}
        for token, i in model["vocab"].items():
            if i in special:
                self.bytes[i] = special[i]
            else:
                self.bytes[i] = bytes(table[c] for c in token)
                ranks[self.bytes[i]] = i
        order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        ahead = spec.get("pre_tokenizer") or {}
        usual = ahead.get("type") == "ByteLevel" and not ahead.get("add_prefix_space") and ahead.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges")
        if usual and order == sorted(order) and min(order) > 255 and len(ranks) == 256 + len(order):
            import tiktoken

            encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [encoding.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model; its pieces in bytes, the space mark as a space."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
        self.encode = lambda texts: own.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _both(a_path: str, b_path: str) -> tuple:
    """Both tokenizers with the lengths of their tokens, and the texts of ids with what may follow them."""
    a, b = ByteBpe(a_path), Pieces(b_path)
    names = [f"{i}{end}" for side, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(len(side.bytes))]
    return a, b, *(np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (a, b)), names


def _expanded(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``doc * 2**(2 * SHIFT) + a * 2**SHIFT + b`` of linked ids, sorted, different, and how often each is linked.

    ``size_a`` and ``size_b`` have the tokens of each group, ``doc`` its document.
    """
    links = size_a * size_b
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    top = doc.astype(np.int64) << (2 * SHIFT)
    few = links <= PLAIN
    n = np.where(few, links, 0)
    group = np.repeat(np.arange(len(links)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at_a, at_b = start_a[group] + k // size_b[group], start_b[group] + k % size_b[group]
    keys, often = [top[group] + (a[at_a] << SHIFT) + b[at_b]], [np.ones(len(group), dtype=np.int64)]
    for g in np.flatnonzero(~few):
        ua, ca = np.unique(a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
        keys.append((top[g] + (ua[:, None] << SHIFT) + ub[None, :]).ravel())
        often.append((ca[:, None] * cb[None, :]).ravel())
    keys, often = np.concatenate(keys), np.concatenate(often)
    order = np.argsort(keys, kind="stable")
    keys, often = keys[order], often[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(often, first) if len(first) else often


def aligned(texts: list[str | None], a_path: str, b_path: str) -> dict[str, list]:
    """Tokens, groups and links of texts, and the block's pairs.

    For each text ``n_a, n_b, n_groups, n_links, groups_sha256``; for all of them ``pairs`` and ``docs``,
    the number of texts that hold each; and by text, from ``held[i]`` to ``held[i + 1]``, ``pair`` (indexes of
    its different pairs in ``pairs``) and ``often`` (links of each).
    """
    a, b, len_a, len_b, names = _both(a_path, b_path)
    spaced = [" " + (t or "") for t in texts]
    ids_a, ids_b = a.encode(spaced), b.encode([t or "" for t in texts])
    for i, t in enumerate(texts):
        own = spaced[i].encode("utf-8", "surrogatepass")
        if not t or any(b"".join(map(side.bytes.__getitem__, ids)) != own for side, ids in ((a, ids_a[i]), (b, ids_b[i]))):
            ids_a[i], ids_b[i] = [], []
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    ta, tb = (np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    end_a, end_b = np.cumsum(len_a[ta]), np.cumsum(len_b[tb])
    # For each end on the left, where the right pointer stands; both ends of a text meet.
    there = np.searchsorted(end_b, end_a)
    meet = end_b[there] == end_a if len(end_b) else np.zeros(len(end_a), dtype=bool)
    last_a, last_b = np.flatnonzero(meet), there[meet]
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    doc_of = np.repeat(np.arange(len(texts)), n_a)[last_a] if len(last_a) else np.zeros(0, dtype=np.int64)
    n_groups = np.bincount(doc_of, minlength=len(texts))
    n_links = np.bincount(doc_of, weights=(size_a * size_b).astype(float), minlength=len(texts)).astype(np.int64)
    # The groups' text: tokens of both sides in the order of their groups, each with what follows it.
    group_a, group_b = np.repeat(np.arange(len(last_a)), size_a), np.repeat(np.arange(len(last_a)), size_b)
    code = np.empty(len(ta) + len(tb), dtype=np.int64)
    ends = np.zeros(len(ta), dtype=np.int64), np.zeros(len(tb), dtype=np.int64)
    ends[0][last_a], ends[1][last_b] = 1, 1
    code[np.arange(len(ta)) + (last_b - size_b + 1)[group_a]] = ta + ends[0] * len(a.bytes)
    code[np.arange(len(tb)) + (last_a + 1)[group_b]] = tb + ends[1] * len(b.bytes) + 2 * len(a.bytes)
    cuts = np.concatenate([[0], np.cumsum(n_a + n_b)])
    code = code.tolist()
    sha = [hashlib.sha256("".join(map(names.__getitem__, code[i:j]))[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:], strict=False)]
    keys, often = _expanded(ta, tb, size_a, size_b, doc_of)
    pairs, pair = np.unique(keys & ((1 << (2 * SHIFT)) - 1), return_inverse=True)
    held = np.searchsorted(keys >> (2 * SHIFT), np.arange(len(texts) + 1))
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha, "held": held, "pair": pair.astype(np.int32), "often": often, "pairs": pairs, "docs": np.bincount(pair, minlength=len(pairs))}


_TEXTS = "block bigint, ids array<string>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, held array<bigint>, pair array<int>, often array<bigint>, pairs array<bigint>, docs array<bigint>"


def _blocks(a_path: str, b_path: str):
    """A function for mapInPandas: rows ``rid, id, text`` to a row for each block of texts."""

    def run(frames):
        for pdf in frames:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            size = np.array([len(t or "") for t in texts], dtype=np.int64)
            part = (np.cumsum(size) - size) // BLOCK
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1) if texts else []:
                got = aligned([texts[i] for i in rows], a_path, b_path)
                ids = [x if isinstance(x, str) else None for x in pdf["id"].iloc[rows]]
                yield pd.DataFrame({"block": [pdf["rid"].iloc[rows[0]]], "ids": [ids], **{k: [v] for k, v in got.items()}})

    return run


def token_links(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Blocks of texts, stored, and the different pairs of ids that are linked anywhere.

    The first has a row for each block with the lists of :func:`aligned`, the second ``pair`` (a *
    2**SHIFT + b), ``n`` (documents that hold it), ``best_a``, ``best_b`` (whether n is the highest of
    the pairs of its first, its second id).
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    texts = stored(rows.mapInPandas(_blocks(a_path, b_path), _TEXTS), "aligned", batch_rows=1000, group_rows=1)
    held = texts.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = stored(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n")), "counts")
    sides = counts.withColumns({"a": F.shiftright("pair", SHIFT), "b": F.col("pair").bitwiseAND((1 << SHIFT) - 1)})
    of_a, of_b = (sides.groupBy(c).agg(F.max("n").alias("most_" + c)) for c in "ab")
    pairs = sides.join(of_a, "a").join(of_b, "b").select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))
    pairs = stored(pairs, "pairs")
    discard(counts)
    return texts, pairs


def align_tokens(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens, groups and links of each row of ``df``: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b``.

    ``a_path`` is a byte-level BPE (.json), which gets a space and the text, ``b_path`` a SentencePiece
    model (.model), which puts the space itself; special strings are plain text.  ``n_best`` counts
    the links whose pair is held by most documents of all pairs of its first id, ties
    included, ``n_best_b`` the same of its second id, and ``count_sum`` sums the links' numbers of
    documents.  A row is a document, so repeated rows count each.  Null and empty texts, and texts
    that a side doesn't give back byte by byte, have zeros and an empty ``groups_sha256``.  Rows
    without an id are documents as well.  Other columns are left out.
    """
    texts, pairs = token_links(df, a_path, b_path, id_col, text_col)
    held = texts.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    # What is known of a pair as one number; a block's come to it as rows, which are sorted on disk where they are many.
    code = F.shiftleft("n", 2).bitwiseOR(F.when(F.col("best_a"), 2).otherwise(0)).bitwiseOR(F.when(F.col("best_b"), 1).otherwise(0))
    known = held.join(pairs.select("pair", code.alias("code")), "pair").select("of", "at", "code")
    ids, counts = df.select(F.col(id_col)).schema[0].dataType.simpleString(), ["n_a", "n_b", "n_groups", "n_links"]
    sums = ["n_best", "count_sum", "n_best_b"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        code = np.zeros(right.num_rows, dtype=np.int64)
        code[right.column("at").to_numpy()] = right.column("code").to_numpy()
        lists = {c: left.column(c).combine_chunks()[0].values for c in left.column_names if c != "block"}
        at, often, cuts = (lists[c].to_numpy() for c in ("pair", "often", "held"))
        for c, of in zip(sums, (code >> 1 & 1, code >> 2, code & 1), strict=True):
            total = np.concatenate([[0], np.cumsum(often * of[at])])
            lists[c] = pa.array(total[cuts[1:]] - total[cuts[:-1]])
        return pa.table({c: lists[c] for c in ["ids", *counts, *sums, "groups_sha256"]}).rename_columns({"ids": "id"})

    lists = texts.select("block", "ids", *counts, "groups_sha256", "held", "pair", "often")
    scored = lists.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(score, "id string, " + ", ".join(f"{c} bigint" for c in [*counts, *sums]) + ", groups_sha256 string")
    out = stored(scored.select(F.col("id").cast(ids).alias(id_col), *counts, "n_best", "count_sum", "groups_sha256", "n_best_b"), "links", batch_rows=10_000)
    for x in (texts, pairs):
        discard(x)
    return out
