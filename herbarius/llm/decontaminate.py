"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over the words of the benchmark.  A randomised
singular value decomposition of all these passages, from one pass over them, gives a latent
space; document windows close to a benchmark passage in it are candidates.  A candidate is
confirmed by the longest common subsequence of words: most of the passage makes a copy, at
least half of it together with its answer makes a paraphrase.  An item without an answer is
asked for half of its words by their weight, the inverse document frequency, out of those that documents hold at all.

Document frequencies, the decomposition and the search cover all documents and whole texts.
Every task holds the benchmark's words and vectors, so the benchmark is taken in blocks of a
bounded number of items and words, each with a pass over all documents of its own: some tens
of blocks are sound, larger benchmarks want a larger block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, free_name, slices, stored

#: Words of a base block; windows are of two blocks of 8, 16 or 32 words.
BLOCK = 8
SCALES = (16, 32, 64)
#: Size of a passage's windows against its own, as paraphrases may be longer.
ROOM = 1.3
#: Share of the words' weight that stands for the answer of a passage that has none.
WEIGHT = 0.5
#: ASCII punctuation separates words, as white space does.
_SPACED = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


@dataclass
class Passage:
    """A part of an item of at most 64 words, by numbers of words."""

    item: object
    ids: np.ndarray
    answer: frozenset  # words that a paraphrase has to hold, all of them
    weights: dict  # without an answer, its different words by weight
    scale: int
    masks: dict


@dataclass
class Space:
    """The latent space and the benchmark's place in it."""

    number: dict[bytes, int]
    passages: list[Passage]
    useful: np.ndarray  # words that count for retrieval; all count for confirmation
    terms: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray


def _numbered(df: DataFrame, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """``words``: the numbers (32-bit) of each text's words, -1 where the benchmark lacks a word."""
    shared = df.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        get = shared.value.get
        for batch in batches:
            for part in slices(batch, text_col):
                found = [np.array([get(w, -1) for w in words_of(t)], dtype=np.int32).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.binary())], names=["words"])

    return df.select(text_col).mapInArrow(run, "words binary")


def _document_frequencies(numbered: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                ids = np.unique(np.frombuffer(x, dtype=np.int32))
                total[ids[ids >= 0]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array(total[some])], names=["word", "n"])

    got = numbered.mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[got["word"].to_numpy()] = got["n"].to_numpy()
    return out


def _sketch(numbered: DataFrame, idf: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(random directions D, X'X D) for the matrix X of TF-IDF passages of all documents."""
    directions = np.random.default_rng(seed).standard_normal((len(idf), width)).astype(np.float32)
    shared = numbered.sparkSession.sparkContext.broadcast((idf.astype(np.float32), directions))
    names = [f"d{i}" for i in range(width)]

    def run(batches):
        idf, directions = shared.value
        weighted = directions * idf[:, None]
        total = np.zeros((len(idf), width))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, passages, n = [], [], 0
                for x in batch.column(0).slice(at, 128).to_pylist():
                    doc = np.frombuffer(x, dtype=np.int32)
                    ids.append(doc)
                    passages.append(np.arange(len(doc), dtype=np.int64) // SCALES[-1] + n)
                    n += -(-len(doc) // SCALES[-1])
                ids, passages = np.concatenate(ids), np.concatenate(passages)
                known = (ids >= 0) & (idf[ids] > 0)
                ids, passages = ids[known], passages[known]
                if not len(ids):
                    continue
                first = np.flatnonzero(np.diff(passages, prepend=-1))
                y = np.add.reduceat(weighted[ids], first, axis=0)
                norm = np.sqrt(np.add.reduceat(idf[ids] ** 2, first))
                y /= (norm**2)[:, None]  # passages of length one, on either side
                row = np.repeat(np.arange(len(first)), np.diff(first, append=len(ids)))
                order = np.argsort(ids, kind="stable")
                sorted_ids = ids[order]
                start = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
                total[sorted_ids[start]] += np.add.reduceat(y[row[order]], start, axis=0)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        total = total[some] * idf[some, None]
        yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), *(pa.array(total[:, i]) for i in range(width))], names=["word", *names])

    got = numbered.mapInArrow(run, "word int, " + ", ".join(f"{n} double" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((len(idf), width))
    out[got["word"].to_numpy()] = got[names].to_numpy()
    return directions.astype(float), out


def singular_vectors(directions: np.ndarray, image: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors from X'X times random directions (the Nystrom form)."""
    shift = 1e-6 * max(np.linalg.norm(image), 1e-12) / np.sqrt(len(image))
    moved = image + shift * directions
    core = directions.T @ moved
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-300)
    left, strengths, _ = np.linalg.svd(moved @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    keep = strengths > 1e-9 * max(strengths.max(initial=0.0), 1e-300)
    return left[:, keep][:, :rank]


def fit_space(df: DataFrame, items: list, text_col: str, rank: int, common: float, seed: int) -> Space | None:
    """The latent space of all passages of ``df`` for some items ``(id, text, answer)``."""
    cut = [(item, words_of(text), words_of(answer) if answer else None) for item, text, answer in items]
    number: dict[bytes, int] = {}
    for _, words, _ in cut:
        for w in words:
            number.setdefault(w, len(number))
    if not number:
        return None
    numbered = stored(_numbered(df, text_col, number), "numbered")
    total, frequency = numbered.count(), _document_frequencies(numbered, len(number))
    parts = []
    for item, words, answer in cut:
        n = -(-len(words) // SCALES[-1])
        parts += [(item, np.array([number[w] for w in words[k * len(words) // n : (k + 1) * len(words) // n]], dtype=np.int32), answer) for k in range(n)]
    # Words of many texts tell passages little apart; they stay for passages that have hardly any others,
    # so that a passage which many texts hold is found like the rest.
    useful = frequency <= common * total
    for _, ids, _ in parts:
        if useful[np.unique(ids)].sum() < 4:
            useful[ids] = True
    idf = np.where(useful, np.log((1 + total) / (1 + frequency)) + 0.1, 0.0)
    vectors = singular_vectors(*_sketch(numbered, idf, min(rank + 8, len(number)), seed), rank)
    discard(numbered)
    terms = (vectors * idf[:, None]).astype(np.float32)
    passages = []
    for item, ids, answer in parts:
        known = frozenset(number.get(w, -2) for w in answer) if answer else frozenset()
        weights = {} if answer else {i: float(np.log((1 + total) / (1 + frequency[i])) + 0.1) for i in set(ids.tolist()) if frequency[i]}
        passages.append(Passage(item, ids, known, weights, next((s for s in SCALES if ROOM * len(ids) <= s), SCALES[-1]), _masks(ids)))
    where = np.array([terms[p.ids].sum(axis=0) for p in passages]).reshape(len(passages), -1)
    lengths = np.maximum(np.linalg.norm(where, axis=1), 1e-9)
    return Space(number, passages, np.append(useful, False), terms, (where / lengths[:, None]).astype(np.float32), lengths.astype(np.float32))


def _masks(a: np.ndarray) -> dict[int, int]:
    """For each word a bit for each of its places."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_subsequence(masks: dict[int, int], size: int, b: list[int]) -> int:
    """Length of the longest common subsequence of ``b`` and the ``size`` words of the masks."""
    full = row = (1 << size) - 1
    for y in b:
        u = row & masks[y]
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def confirm(p: Passage, region: list[int], copy: float, half: float) -> tuple[int, str] | None:
    """(common words, kind) if a region of a document holds the passage."""
    inside = [y for y in region if y in p.masks]
    if len(inside) < half * len(p.ids):
        return None
    n = common_subsequence(p.masks, len(p.ids), inside)
    if n >= copy * len(p.ids):
        return n, "copy"
    if n >= half * len(p.ids) and p.answer <= (there := set(region)):
        if sum(p.weights[i] for i in p.weights.keys() & there) >= WEIGHT * sum(p.weights.values()):
            return n, "paraphrase"
    return None


def search(space: Space, texts: list, cosine: float, held: float, copy: float, half: float) -> list[dict]:
    """For each text: item -> (kind, common words, passage words, cosine) of its best confirmed passage."""
    get = space.number.get
    docs = [np.array([get(w, -1) for w in words_of(t)], dtype=np.int32) for t in texts]
    found: list[dict] = [{} for _ in texts]
    group = SCALES[-1] // 2
    blocks = [-(-len(d) // group) * (group // BLOCK) for d in docs]  # whole halves of the largest window
    ends = np.cumsum(blocks)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return found
    first = ends - blocks
    ids = np.concatenate(docs)
    place = np.concatenate([np.arange(len(d), dtype=np.int64) // BLOCK + f for d, f in zip(docs, first.tolist(), strict=True)])
    known = space.useful[ids]
    ids, place = ids[known], place[known]
    if not len(ids):
        return found
    start = np.flatnonzero(np.diff(place, prepend=-1))
    sums = np.zeros((total, space.terms.shape[1]), dtype=np.float32)
    sums[place[start]] = np.add.reduceat(space.terms[ids], start, axis=0)
    owner = np.repeat(np.arange(len(docs)), blocks)
    for scale in SCALES:
        here = [i for i, p in enumerate(space.passages) if p.scale == scale]
        if not here:
            continue
        # A window is two half windows; half windows are counted from each text's beginning.
        step = scale // 2 // BLOCK
        half_sums = sums.reshape(total // step, step, -1).sum(axis=1) if step > 1 else sums
        own = owner[::step]
        follows = np.append(own[1:] == own[:-1], False)
        windows = half_sums.copy()
        windows[:-1][follows[:-1]] += half_sums[1:][follows[:-1]]
        size = np.maximum(np.linalg.norm(windows, axis=1), 1e-9)
        for at in range(0, len(windows), 8192):
            # A candidate points the passage's way, and far enough to hold most of it.
            dot = windows[at : at + 8192] @ space.vectors[here].T
            near = dot / size[at : at + 8192, None]
            for w, k in np.argwhere((near >= cosine) & (dot >= held * space.lengths[here])).tolist():
                p, doc = space.passages[here[k]], int(own[at + w])
                begin = int((at + w) * step - first[doc]) * BLOCK
                if p.item in found[doc] and found[doc][p.item][0] == "copy":
                    continue
                region = docs[doc][max(0, begin - scale // 2) : begin + scale + scale // 2].tolist()
                got = confirm(p, region, copy, half)
                if got and (p.item not in found[doc] or got[0] > found[doc][p.item][1]):
                    found[doc][p.item] = (got[1], got[0], len(p.ids), float(near[w, k]))
    return found


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, answer_col: str | None, size: int):
    """Lists of about ``size`` items or of 64 times as many words, dealt by hash, without null ids or texts."""
    chosen = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    chosen = chosen.filter("id is not null and text is not null").distinct()
    n, words = chosen.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    blocks = max(1, -(-n // size), -(-(words or 0) // (size * SCALES[-1])))
    for b in range(blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        yield [tuple(r) for r in rows.orderBy("id", "text").collect()]


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    answer_col: str | None = None,
    rank: int = 128,
    common: float = 0.05,
    cosine: float = 0.4,
    held: float = 0.5,
    copy: float = 0.8,
    half: float = 0.5,
    block_items: int = 2000,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, item_id, kind, common_words, passage_words, cosine``: a row for each document and
    item that it holds, with the item's best confirmed passage.

    Items longer than 64 words are cut into passages; one of them is enough.  Without an
    ``answer_col`` a paraphrase has to hold half of the passage's words by weight.  Null and empty texts hold
    nothing, items without id, text or words are in nothing; repeated documents give
    repeated rows, null ids are passed on.
    """
    out = None
    id_type, item_type = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    for items in _blocks(benchmark, item_col, item_text_col, answer_col, block_items):
        space = fit_space(df, items, text_col, rank, common, seed)
        shared = df.sparkSession.sparkContext.broadcast(space)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, text_col):
                    found = search(shared.value, part.column(1).to_pylist(), cosine, held, copy, half) if shared.value else []
                    rows = [(i, item, *what) for i, items in enumerate(found) for item, what in items.items()]
                    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(columns[0], type=pa.int64())), pa.array(columns[1], type=pa_type), pa.array(columns[2], type=pa.string()), *(pa.array(columns[k], type=pa.int32()) for k in (3, 4)), pa.array(columns[5], type=pa.float64())],
                        names=[id_col, "item_id", "kind", "common_words", "passage_words", "cosine"],
                    )

        pa_type = to_arrow_type(item_type)
        rows = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, item_id {item_type.simpleString()}, kind string, common_words int, passage_words int, cosine double")
        out = rows if out is None else out.unionAll(rows)
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, rank: int = 128, common: float = 0.05, cosine: float = 0.4, held: float = 0.5, copy: float = 0.8, half: float = 0.5, block_items: int = 2000, seed: int = 0, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no item of the benchmark, with all columns."""
    out, flag = df, free_name(df, "leaks")
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])
    for items in _blocks(benchmark, item_col, item_text_col, None, block_items):
        space = fit_space(df, items, text_col, rank, common, seed)
        if space is None:
            continue
        shared = df.sparkSession.sparkContext.broadcast(space)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, text_col):
                    leaky = [bool(x) for x in search(shared.value, part.column(at).to_pylist(), cosine, held, copy, half)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaky)], names=[*part.schema.names, flag])

        out = out.mapInArrow(run, schema).filter(~F.col(flag)).select(df.columns)
    return out
