"""Ranked lexical search through dual-sorted wavelet trees.

A shard is a run of documents, numbered by id, small enough for one task.  Its postings stand in
one sequence, term by term, the documents of a term by falling impact (what the term adds to a
document's score, but for the term's weight).  A wavelet tree over the sequence sorts the same
postings by document number: level by level the documents' bits split each node stably into two,
so a term is a range at every node, and the first posting of a range is still that of most
impact.  Weights times first impacts, summed over a query's terms, bound the scores of a node's documents;
at a leaf the sum is the score.

A search expands the nodes of the highest bounds, some at a time, and ends when no bound is over
the kth score.  Documents are numbered by id, so at equal bounds only nodes are open that start
before the kth document.  Tasks carry each query's best documents from shard to shard and give
them at their end; Spark takes the best of the tasks' best.

An index is a table of shards, with the corpus' counts and a table of terms and document
frequencies.  Nothing but the queries of a block, at most ``BLOCK_ITEMS`` with ``BLOCK_TERMS``
terms, goes through the driver.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Bytes of text and documents of a shard at most, one document at least.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Nodes that a search expands at once, at most.
AT_ONCE = 256
#: Queries of a block, and their terms.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 200_000

#: A-Z to a-z; all ASCII but letters and digits to a space.
_TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)


def terms_of(text: str | None) -> list[str]:
    """Runs of ASCII letters and digits and of all other than ASCII characters, A-Z lower-cased."""
    return [t.decode("utf-8", "surrogatepass") for t in _normal(text).split()]


def _postings(texts: list[str | None]) -> dict:
    """Sorted terms of some documents, where each one's postings start, its documents and their counts,
    and the documents' lengths."""
    split = pc.ascii_split_whitespace(pa.array([_normal(t) for t in texts], type=pa.large_binary()).cast(pa.large_string()))
    flat = split.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False))
    some = pc.not_equal(pc.binary_length(flat), 0)
    flat, doc = flat.filter(some), doc[some.to_numpy(zero_copy_only=False).astype(bool)]
    coded = flat.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    keys, tf = np.unique(place[coded.indices.to_numpy()] * len(texts) + doc, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(order) + 1) * len(texts))
    return {"terms": coded.dictionary.take(pa.array(order)), "starts": starts, "docs": keys % max(len(texts), 1), "tf": tf, "n": np.bincount(doc, minlength=len(texts))}


_LISTS = {"terms": pa.list_(pa.string()), "starts": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()), "tf": pa.list_(pa.int32()), "n": pa.list_(pa.int64())}


def _one(value, kind: pa.DataType) -> pa.Array:
    """A column of one row, a list."""
    flat = value if isinstance(value, pa.Array) else pa.array(value)
    return pa.ListArray.from_arrays([0, len(flat)], flat.cast(kind.value_type))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``id, text`` to a row for each shard, its documents by id, those without one last."""

    def shard(ids, texts):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        got = _postings([texts[i] for i in order])
        return pa.RecordBatch.from_arrays([_one(pa.array([ids[i] for i in order], type=kind), pa.list_(kind)), *(_one(got[c], k) for c, k in _LISTS.items())], names=["ids", *_LISTS])

    ids, texts, size, kind = [], [], 0, pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= SHARD_BYTES or len(ids) == SHARD_DOCS:
                yield shard(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield shard(ids, texts)


def _trees(documents: int, tokens: int):
    """A function for mapInArrow: shards' postings to their trees.

    ``impacts`` follow the sequence; ``bits`` has a level after the other, eight bits a byte, each level beginning a byte.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, starts, docs, tf = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in ("n", "starts", "docs", "tf"))
                m = np.array([75 + 25 * x * documents // tokens for x in n.tolist()] if tokens else np.zeros(len(n)), dtype=np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[docs])
                term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                order = np.lexsort((docs, -impact, term))
                seq, bits = docs[order], []
                levels = max(1, (len(n) - 1).bit_length())
                for level in range(levels):
                    bits.append(np.packbits((seq >> (levels - 1 - level)) & 1 == 1).tobytes())
                    # Stable, so that each term's postings stay by falling impact at every node.
                    seq = seq[np.argsort((seq >> (levels - 1 - level)).astype(np.uint16), kind="stable")]
                part = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([part.column("ids"), part.column("terms"), part.column("starts"), _one(impact[order], pa.list_(pa.int32())), pa.array([b"".join(bits)], type=pa.binary())], names=["ids", "terms", "starts", "impacts", "bits"])

    return run


class Tree:
    """A shard's tree, ready for searches."""

    def __init__(self, documents: int, starts: np.ndarray, impacts: np.ndarray, bits: bytes):
        self.documents, self.starts = documents, starts.astype(np.int64)
        self.levels = max(1, (documents - 1).bit_length())
        size = len(impacts)
        self.width = size + 1
        packed = np.frombuffer(bits, dtype=np.uint8).reshape(self.levels, -1)
        #: For each level and place, the zeros before; and the impacts in the order of each level.
        self.zeros = np.zeros((self.levels, self.width), dtype=np.int32)
        self.impact = np.zeros((self.levels + 1, self.width), dtype=np.int32)
        self.impact[0, :size] = impacts
        node = np.zeros(size, dtype=np.uint16)
        for level in range(self.levels):
            ones = np.unpackbits(packed[level], count=size) if size else np.zeros(0, dtype=np.uint8)
            np.cumsum(1 - ones, out=self.zeros[level, 1:], dtype=np.int32)
            node = node * 2 + ones
            order = np.argsort(node, kind="stable")
            node = node[order]
            self.impact[level + 1, :size] = self.impact[level, :size][order]
        self.zeros, self.impact = self.zeros.ravel(), self.impact.ravel()

    def best(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, k: int, least: int = 0, before: int = -1) -> list[tuple[int, int]]:
        """The k best documents ``(score, number)`` for terms of ranges ``lo, hi`` of the sequence.

        What scores under ``least`` may be left out, and what scores just that from number ``before`` on.
        """
        level, base, size, prefix = (np.array([x], dtype=np.int64) for x in (0, 0, self.width - 1, 0))
        lo, hi = lo[None, :].astype(np.int64), hi[None, :].astype(np.int64)
        bound = np.where(lo < hi, self.impact[lo], 0) @ weight
        found: list[tuple[int, int]] = []  # a heap of (score, -number)
        at_once = 1
        while len(bound):
            first = prefix << (self.levels - level)
            open_ = (bound > least) | (bound == least) & (first < before)
            if not open_.all():
                level, base, size, prefix, lo, hi, bound = (x[open_] for x in (level, base, size, prefix, lo, hi, bound))
                if not len(bound):
                    break
            pick = np.argpartition(-bound, at_once)[:at_once] if len(bound) > at_once else np.arange(len(bound))
            rest = np.ones(len(bound), dtype=bool)
            rest[pick] = False
            leaf = pick[level[pick] == self.levels]
            for s, d in zip(bound[leaf].tolist(), prefix[leaf].tolist(), strict=True):
                if d < self.documents and s > 0:
                    (heapq.heappush if len(found) < k else heapq.heappushpop)(found, (s, -d))
            if len(found) == k and (found[0][0] > least or found[0][0] == least and -found[0][1] < before):
                least, before = found[0][0], -found[0][1]
            pick = pick[level[pick] < self.levels]
            row, b, old_lo, old_hi = level[pick] * self.width, base[pick], lo[pick], hi[pick]
            at_base = self.zeros[row + b]
            n_left = self.zeros[row + b + size[pick]] - at_base
            left_lo, left_hi = (self.zeros[row[:, None] + x] - at_base[:, None] for x in (old_lo, old_hi))
            b_right = b + n_left
            right_lo, right_hi = (b_right[:, None] + x - b[:, None] - y for x, y in ((old_lo, left_lo), (old_hi, left_hi)))
            new_lo, new_hi = np.concatenate([b[:, None] + left_lo, right_lo]), np.concatenate([b[:, None] + left_hi, right_hi])
            new_level = np.tile(level[pick] + 1, 2)
            new_bound = np.where(new_lo < new_hi, self.impact[(new_level * self.width)[:, None] + new_lo], 0) @ weight
            new = [new_level, np.concatenate([b, b_right]), np.concatenate([n_left, size[pick] - n_left]), np.concatenate([prefix[pick] * 2, prefix[pick] * 2 + 1]), new_lo, new_hi, new_bound]
            level, base, size, prefix, lo, hi, bound = (np.concatenate([x[rest], y]) for x, y in zip((level, base, size, prefix, lo, hi, bound), new, strict=True))
            at_once = min(AT_ONCE, at_once * 2)
        return sorted(((s, -d) for s, d in found), key=lambda x: (-x[0], x[1]))


@dataclass
class LexicalIndex:
    """``shards`` (ids, terms, starts, impacts, bits), ``frequencies`` (term, df), both stored, and counts of the corpus."""

    shards: DataFrame
    frequencies: DataFrame
    documents: int
    tokens: int

    def discard(self) -> None:
        discard(self.shards)
        discard(self.frequencies)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Trees of all rows of ``df``, in shards that follow its partitions; no row is moved."""
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    postings = stored(rows.mapInArrow(_shards, f"ids array<{kind}>, terms array<string>, starts array<int>, docs array<int>, tf array<int>, n array<bigint>"), "postings", group_rows=1)
    n = postings.select(F.explode("n").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    held = postings.select("terms", F.expr("transform(sequence(1, size(starts) - 1), i -> starts[i] - starts[i - 1])").alias("df")).filter(F.size("terms") > 0)
    held = held.select(F.explode(F.arrays_zip("terms", "df")).alias("x"))
    frequencies = stored(held.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df")), "frequencies")
    shards = stored(postings.filter(F.size("terms") > 0).mapInArrow(_trees(n["documents"], n["tokens"]), f"ids array<{kind}>, terms array<string>, starts array<int>, impacts array<int>, bits binary"), "shards", batch_rows=1, group_rows=1)
    discard(postings)
    return LexicalIndex(shards, frequencies, n["documents"], n["tokens"])


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        own = Counter(terms_of(row["text"]))
        if block and (len(block) == BLOCK_ITEMS or size + len(own) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row["id"], own))
        size += len(own)
    if block:
        yield block


def _searched(block: list[tuple[object, dict[str, int]]], weights: dict[str, int], k: int):
    """A function for mapInArrow: shards to each query's k best documents of the task; ``block`` has (number, terms)."""
    names = list(weights)
    places = {t: i for i, t in enumerate(names)}
    queries = [(i, np.array([places[t] for t in own], dtype=np.int64), np.array([weights[t] * n for t, n in own.items()], dtype=np.int64)) for i, own in block]
    order = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0)

    def run(batches):
        best: dict[int, list[tuple[int, object]]] = {i: [] for i, _, _ in queries}
        kind, wanted = pa.int64(), pa.array(names, type=pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                kind, terms = ids.type, batch.column("terms")[row].values
                place = pc.index_in(wanted, value_set=terms.cast(pa.string())).fill_null(-1).to_numpy()
                tree = Tree(len(ids), *(batch.column(c)[row].values.to_numpy() for c in ("starts", "impacts")), batch.column("bits")[row].as_py())
                numbers = ids.to_pylist()
                for i, of, weight in queries:
                    at = place[of]
                    own = best[i]
                    least, before = 0, -1
                    if len(own) == k:
                        # Documents from the first id over the kth one's on can't win at the same score.
                        least, last = own[-1]
                        before = _first_over(numbers, last)
                    here = at >= 0
                    if here.any():
                        got = tree.best(tree.starts[at[here]], tree.starts[at[here] + 1], weight[here], k, least, before)
                        best[i] = sorted(own + [(s, numbers[d]) for s, d in got], key=order)[:k]
        out = [(i, d, s) for i, found in best.items() for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=kind), pa.array([x[2] for x in out], type=pa.int64())], names=["item", "id", "score"])

    return run


def _first_over(numbers: list, last) -> int:
    """The place of the first id over ``last`` in a shard's ids, those without one being last."""
    if last is None:
        return len(numbers)
    return bisect.bisect_right(numbers, last, hi=len(numbers) - sum(x is None for x in numbers))


def search(index: LexicalIndex, items: DataFrame, k: int = 20, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``item_col, rank, id_col, score``: each item's k best documents of score above 0, ties by id, those
    without an id last.  Rows of ``items`` are ranked each by itself, repeated ones as well; items without
    terms that documents hold have no rows."""
    spark = items.sparkSession
    kind = items.select(F.col(item_col)).schema[0].dataType
    of_id = index.shards.schema["ids"].dataType.elementType.simpleString()
    parts = []
    for block in _item_blocks(items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))):
        wanted = sorted({t for _, own in block for t in own})
        known = {r["term"]: r["df"] for r in index.frequencies.join(spark.createDataFrame([(t,) for t in wanted], "term string"), "term").collect()} if wanted else {}
        weights = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1))) for t, df in known.items()}
        numbered = [(i, {t: n for t, n in own.items() if weights.get(t, 0) > 0}) for i, (_, own) in enumerate(block)]
        best = stored(index.shards.mapInArrow(_searched([x for x in numbered if x[1]], weights, k), f"item bigint, id {of_id}, score bigint"), "best", batch_rows=1)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
        ranked = best.select("item", rank.alias("rank"), "id", "score").filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item bigint, name {kind.simpleString()}")
        parts.append(ranked.join(names, "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` {of_id}, score bigint")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


def lexical_topk(df: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of ``df`` for each row of ``items`` (see :func:`search`).

    Scores are those of the frequencies of ``df``: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))),
    its impact (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L.  Null and blank texts have no terms
    and are never found; a row is a document, so repeated rows are found each.  Other columns are left out.
    """
    index = build_index(df, id_col, text_col)
    out = stored(search(index, items, k, item_col, item_text_col, id_col), "ranked")
    index.discard()
    return out
