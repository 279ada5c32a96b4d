"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding follows the library's agenda: of all neighbouring symbols whose joint piece is in
the vocabulary, the pair with the best score, then the leftmost, is taken from the agenda.
With dropout, a pair that is taken is skipped if a keyed hash of (seed, document key,
position, pair) falls under the rate; it comes back only as part of other pairs once a
neighbour has changed.  The same seed and key always give the same segmentation, on any
machine and in any batch; other keys or seeds give others.  Any segmentation decodes to the
text: unknown characters, and the space mark itself, are encoded as bytes.

Words are independent in the agenda, as no piece has a space mark behind another character.
So words of a batch are taken together: those of equal length form a matrix on which each
step handles the best pair of every word at once; very long words go through a heap.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, splitmix

SPACE = "▁"
#: Words of more symbols than this go through the heap.
WIDE = 48
NONE = np.int32(1 << 30)


class Pieces:
    """A SentencePiece BPE model's pieces as tables for whole arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(self.names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.spelled = [b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        for b, i in enumerate(self.byte.tolist()):
            self.spelled[i] = bytes([b])
        self.space = normal[SPACE]
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = sorted(normal.values(), key=lambda i: (-sp.get_score(i), i))
        self.piece_of_rank = np.array(order, dtype=np.int32)
        pairs = {}
        for rank, i in enumerate(order):
            p = self.names[i]
            for k in range(1, len(p)):
                if p[:k] in normal and p[k:] in normal:
                    pairs[normal[p[:k]] * n + normal[p[k:]]] = rank
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        for key, rank in pairs.items():
            at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - bits)
            while self.keys[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.ranks[at] = key, rank
        self.mask = mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's piece, best first; NONE where it is none."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], NONE)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def skips(key: np.ndarray, position: np.ndarray, left: np.ndarray, right: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether the keyed hash drops each candidate merge."""
    with np.errstate(over="ignore"):
        pair = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        return splitmix(splitmix(key + position.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ pair) < limit


def document_keys(ids: list, seed: int) -> np.ndarray:
    """A key for each document: by its id if that is a number, else by a hash of its text."""
    import xxhash

    numbers = [x & (2**64 - 1) if isinstance(x, int) else xxhash.xxh3_64_intdigest(str(x).encode("utf-8", "surrogatepass")) for x in ids]
    return splitmix(np.array(numbers, dtype=np.uint64) ^ splitmix(np.array([seed & (2**64 - 1)], dtype=np.uint64)))


def _wide_word(p: Pieces, symbols: list[int], position: int, key: np.uint64, limit: np.uint64) -> list[int]:
    """The agenda for one long word, through a heap."""
    sym, nxt, prv = list(symbols), [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
    agenda: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j >= 0 and (rank := p.pairs.get(sym[i] * p.size + sym[j])) is not None and sym[i] >= 0 and sym[j] >= 0:
            heapq.heappush(agenda, (rank, i, sym[i], sym[j]))

    for i in range(len(sym) - 1):
        push(i)
    key = np.array([key])
    while agenda:
        rank, i, left, right = heapq.heappop(agenda)
        j = nxt[i]
        if j < 0 or sym[i] != left or sym[j] != right:
            continue
        if limit and skips(key, np.array([position + i]), np.array([left]), np.array([right]), limit)[0]:
            continue
        sym[i], sym[j] = int(p.piece_of_rank[rank]), -9
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        if prv[i] >= 0:
            push(prv[i])
        push(i)
    return [s for s in sym if s != -9]


def encode_all(p: Pieces, texts: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin (one more than texts)."""
    limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
    # As the library does: a space before each text, and spaces as the space mark.
    flat = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    sym = np.where(flat == 32, p.space, np.where(flat == ord(SPACE), -1, p.char[np.minimum(flat, 0x10FFFF)])).astype(np.int32)
    starts_of_text = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    space = flat == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[starts_of_text[lengths > 0]] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(starts, append=len(flat))
    # Byte pieces stand in for symbols that the vocabulary lacks, after the merges; until then -1.
    position = (np.arange(len(flat)) - starts_of_text[owner]).astype(np.int32)
    out = np.full(len(flat), -9, dtype=np.int32)  # merged symbols leave holes
    for width in np.unique(np.minimum(sizes, WIDE + 1)):
        if width == 1:
            at = starts[sizes == 1]
            out[at] = sym[at]
        elif width > WIDE:
            for s, n in zip(starts[sizes > WIDE].tolist(), sizes[sizes > WIDE].tolist(), strict=True):
                got = _wide_word(p, sym[s : s + n].tolist(), int(position[s]), keys[owner[s]], limit)
                out[s : s + len(got)] = got
        else:
            at = starts[sizes == width]
            _same_width(p, sym, at, int(width), position, keys[owner[at]], limit, out)
    left = out != -9
    unknown = np.flatnonzero(out == -1)
    if len(unknown):
        # A -1 in ``out`` is a single character, but merges may have moved it; its own place is kept below.
        return _with_bytes(p, flat, sym, out, left, starts, sizes, owner, len(texts))
    ids = out[left]
    counts = np.bincount(owner[left], minlength=len(texts))
    return ids, np.concatenate([[0], np.cumsum(counts)])


def _same_width(p: Pieces, sym, at, width: int, position, keys, limit, out) -> None:
    """The agenda of many words of ``width`` symbols at once; results go to ``out``.

    Column c of each word is row c of the matrices, which are kept flat.  A pair is held at its
    left symbol's column as rank * 64 + column, so that the smallest number of a word is its
    best pair, the leftmost of equals.  Merged symbols stay as holes that links pass over.
    """
    n = len(at)
    s = np.ascontiguousarray(sym[at + np.arange(width)[:, None]]).ravel()
    column = np.repeat(np.arange(width, dtype=np.int32), n)
    after, before = column + 1, column - 1
    pair = np.full(width * n, NONE, dtype=np.int32)
    first = p.rank(s[:-n], s[n:])
    pair[:-n] = np.where(first < NONE, first * 64 + column[:-n], NONE)
    begins = position[at]
    while n:
        best = pair.reshape(width, n).min(axis=0)
        x = np.flatnonzero(best < NONE)
        if len(x) < 0.7 * n:
            done = np.flatnonzero(best >= NONE)
            for c in range(width):
                out[at[done] + c] = s[c * n + done]
            keep = (np.arange(width)[:, None] * n + x).ravel()
            s, after, before, pair = s[keep], after[keep], before[keep], pair[keep]
            at, begins, keys, best, n = at[x], begins[x], keys[x], best[x], len(x)
            x = np.arange(n)
        if not n:
            return
        best = best[x]
        c = best & 63
        here = c * n + x
        pair[here] = NONE
        j = after[here]
        there = j * n + x
        if limit:
            go = np.flatnonzero(~skips(keys[x], begins[x] + c, s[here], s[there], limit))
            x, c, best, here, there = x[go], c[go], best[go], here[go], there[go]
        made = p.piece_of_rank[best >> 6]
        s[here], s[there], pair[there] = made, -9, NONE
        j = after[there]
        after[here] = j
        inner = np.flatnonzero(j < width)
        right = j[inner] * n + x[inner]
        before[right] = c[inner]
        rank = p.rank(made[inner], s[right])
        pair[here[inner]] = np.where(rank < NONE, rank * 64 + c[inner], NONE)
        i = before[here]
        inner = np.flatnonzero(i >= 0)
        left = i[inner] * n + x[inner]
        rank = p.rank(s[left], made[inner])
        pair[left] = np.where(rank < NONE, rank * 64 + i[inner], NONE)


def _with_bytes(p: Pieces, flat, sym, out, left, starts, sizes, owner, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the UTF-8 bytes of unknown characters where ``out`` has -1.

    Unknown characters take no part in merges, so the kth of them in ``out`` is the kth of
    them in the text.
    """
    chars = flat[sym == -1]
    spelled = [chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
    ids, own = out[left], owner[left]
    times = np.ones(len(ids), dtype=np.int64)
    times[ids == -1] = [len(b) for b in spelled]
    data = np.frombuffer(b"".join(spelled), dtype=np.uint8)
    holes = np.repeat(ids == -1, times)
    ids, own = np.repeat(ids, times), np.repeat(own, times)
    ids[holes] = p.byte[data]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def decode(p: Pieces, ids) -> str:
    """The text of one sequence of ids; begin, end and unknown pieces are left out."""
    text = b"".join(map(p.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(df: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids array<int>`` of every row.

    With ``dropout`` 0 the ids are those of the library (but for texts with U+2581, which
    only here survive decoding).  Null and empty texts have no ids (an empty array).  Ids of
    documents are passed on, null or repeated; rows with the same id and text get the same
    tokens.  Other columns are left out.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        p = pieces(path)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, cuts = encode_all(p, texts, document_keys(part.column(0).to_pylist(), seed), dropout)
                arrays = pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cuts), type=pa.int64()), arrays], names=[id_col, "n_tokens", "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, ids array<int>")


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of ``ids_col`` in a further column; null ids give null."""
    if out_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out_col} already")
    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        p = pieces(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [None if x is None else decode(p, x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string())], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)
