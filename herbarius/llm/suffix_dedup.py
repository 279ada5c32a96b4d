"""Removal of byte strings that occur twice, by a distributed difference-cover suffix sort.

Which of the strings of ``length`` bytes start anywhere else?  Sorting all suffixes by bytes would
shuffle every byte some dozen times over, so texts are first parsed into phrases at places
that their content alone chooses (local minima of a hash), and suffixes that start at such cuts are sorted as
strings of phrase names.  What a cut can't decide is decided by bytes, so results are exact.

1. Parse.  A phrase runs from a cut over the next one's gram; its name is a hash.  Whether a place is a cut depends on
   the bytes around it alone.  A window (a string of ``length`` bytes) that has its first cut within
   a gap holds the *core* of this cut, some whole phrases, or the bytes behind it if the next cut is far.  Where no
   other cut has this core, the window is unique.  Windows whose first cut comes late are told apart by the
   bytes before it, and those without any, which are ``bare``, are compared as they are.
2. Sort the suffixes of the cuts whose core repeats, by difference cover: the triples at places 1 and 2
   modulo 3 are sorted and named, the strings of names sorted in turn, until strings are
   short; then the suffixes at places 0 modulo 3 are merged with them by (name, rank of the next).  The merge
   is by counts: a sort of places 0 and 1, and one of 0 and 2, give how many of the others are before each.
3. Compare neighbours: the most phrases that a suffix shares with any other it shares with one beside it.
   Windows within these phrases repeat.
4. Windows that stick out of them by part of a phrase on either side are left: suffixes of other places, merged
   by their first ``length`` bytes.  Those that are known to repeat take part, one for each different
   left phrase and following bytes, where their core has a window that is left.

Texts that occur twice are sorted once, so large groups of copies cost one text.  All sorts are
range-partitioned, all joins on keys that many rows may have are with stored tables of one row a key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import discard, slices, splitmix

#: A cut is where the hash of ``GRAM`` bytes is least of all places up to ``WING`` on either side, and of equal ones the last, so
#: that text of a short period has one at its end.
GRAM, WING = 12, 16
#: Names of a string that is sorted at most, and one of how many names begins one.
PIECE, BREAK = 36, 16
#: Windows of a lot that are told from others by what they have in common first.
LOT = 8
#: Neighbours of the sorted order that a group compares.
BLOCK = 4096
#: Joins whose smaller side has no larger partition than this are by hash, without sorting either side.
HASHED = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}
#: Names and hashes hardly repeat within a file, so Parquet's dictionaries cost more time than they save space.
PLAIN = {"parquet.enable.dictionary": "false"}


def stored(df: DataFrame, name: str, batch_rows: int = 1000, key: str | None = None) -> DataFrame:
    return common.stored(df, name, batch_rows, HASHED | PLAIN, key=key)


def gap_of(length: int) -> int:
    """Bytes within which a window's first cut has to come."""
    return (length - GRAM) // 2 - WING


def cut_places(data: np.ndarray) -> np.ndarray:
    """The cuts of a text, or of several behind each other, of which those within ``WING`` of either end are to be left out."""
    if len(data) < GRAM + 2 * WING:
        return np.zeros(0, dtype=np.int64)
    h, p = data.astype(np.uint32), np.uint32(1000003)
    with np.errstate(over="ignore"):
        h = h[:-1] + h[1:] * p
        four = h[:-2] + h[2:] * (p * p)
        eight = four[:-4] + four[4:] * (p**4)
        h = eight[: len(data) - GRAM + 1] + four[8:] * (p**8)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761)
        h ^= h >> np.uint32(13)
    least = h
    for k in (1, 2, 4, 8):  # of WING places from each on
        least = np.minimum(least[:-k], least[k:])
    inner = h[WING : len(h) - WING]
    return np.flatnonzero((inner <= least[: len(inner)]) & (inner < least[WING + 1 : WING + 1 + len(inner)])) + WING


def window_hash(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _chained(names: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place a hash of the ``n`` names from it on, 0 where n is less than 0."""
    out, ahead, some = np.maximum(n, 0).astype(np.uint64), names.astype(np.uint64), np.flatnonzero(n > 0)
    for k in range(int(n.max(initial=0))):
        some = some[n[some] > k]
        out[some] = splitmix(out[some] ^ ahead[some + k])
    return np.where(n < 0, 0, np.maximum((out >> np.uint64(1)).astype(np.int64), 1))


def parsed(texts: list[bytes], length: int) -> dict[str, list]:
    """For each text the places of its ``cuts``, 0 first, ``names`` of the phrases from each, ``cores`` (0 for
    none), ``bare`` windows with their ``hashes``, and whether a text has one ``again``, which then is listed once; all such start in
    the ranges from ``lo`` to ``hi``; and hashes of the bytes before ``late`` cuts with the ranges of their windows.
    Nothing for texts shorter than a window."""
    buffer = b"".join(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(size) - size
    found = cut_places(np.frombuffer(buffer, dtype=np.uint8))
    owner = np.searchsorted(start, found, side="right") - 1
    sound = (found - start[owner] >= WING) & (found + WING + GRAM <= (start + size)[owner]) & (size[owner] >= length)
    found, owner = found[sound], owner[sound]
    held = length - WING - gap_of(length)
    out: dict[str, list] = {c: [] for c in LISTS}
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    name = xxhash.xxh3_64_intdigest
    alone: list[tuple[int, int, int]] = []
    for k, (n, at) in enumerate(zip(size.tolist(), start.tolist(), strict=True)):
        if n < length:
            for c in out.values():
                c.append([])
            continue
        real = found[ends[k] : ends[k + 1]] - at
        cuts = np.concatenate([[0], real])
        stops = (cuts + (at + GRAM)).tolist()
        names = [name(buffer[a - GRAM : b]) >> 1 or 1 for a, b in zip(stops, stops[1:], strict=False)]
        names.append(name(buffer[stops[-1] - GRAM : at + n], seed=1) >> 1 or 1)  # the last one is another than of the same bytes elsewhere
        names = np.array(names, dtype=np.int64)
        # A core ends with the last cut within what every window of the first holds, with all that makes it a cut, or is all of
        # that where no other cut is in it.
        last = np.where(cuts + held > n, -1, np.searchsorted(cuts, cuts + (held - GRAM - WING), side="right") - 1)
        whole = np.where(last < 0, -1, last - np.arange(len(cuts)))
        out["cuts"].append(cuts)
        out["names"].append(names)
        out["cores"].append(whole)
        alone += [(k, i, name(buffer[at + c : at + c + held], seed=2) >> 1 or 1) for i in np.flatnonzero(whole == 0).tolist() for c in (int(cuts[i]),)]
        # Where text repeats itself at short distances there are no cuts, but few different windows.
        first: dict[bytes, int] = {}
        twice: dict[bytes, None] = {}
        starts, late = _bare(real, n, length)
        # Such windows hold the bytes before the cut, as far as a gap goes, with all that makes it one.
        out["late"].append([name(buffer[at + c - WING - gap_of(length) : at + c + GRAM + WING], seed=3) >> 1 for c, _, _ in late])
        out["late_at"].append([c for c, _, _ in late])
        out["late_lo"].append([a for _, a, _ in late])
        out["late_hi"].append([b for _, _, b in late])
        own = [window_hash(buffer[at + i : at + i + length]) for i in starts]
        for i, x in zip(starts, own, strict=True):
            if first.setdefault(x, i) != i:
                twice[x] = None
        sure = np.array([i for i, x in zip(starts, own, strict=True) if x in twice], dtype=np.int64)
        edge = np.flatnonzero(np.diff(sure) != 1)
        out["bare"].append(list(first.values()))
        out["hashes"].append(list(first))
        out["again"].append([x in twice for x in first])
        out["lo"].append(sure[np.append(0, edge + 1)] if len(sure) else sure)
        out["hi"].append(sure[np.append(edge, len(sure) - 1)] if len(sure) else sure)
    whole = [np.asarray(x, dtype=np.int64) for x in out["cores"]]
    if whole:
        flat = _chained(np.concatenate([np.asarray(x, dtype=np.int64) for x in out["names"]]), np.concatenate(whole))
        out["cores"] = np.split(flat, np.cumsum([len(x) for x in whole])[:-1])
    for k, i, core in alone:
        out["cores"][k][i] = core
    return out


def _bare(real: np.ndarray, n: int, length: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Windows without a cut, and for cuts that come late in windows the cut and the range of these windows."""
    last, seen = n - length, length - GRAM - WING
    # Windows of a cut start after ``before``, and for those up to ``upto`` it is late; from ``first`` on they have it at all.
    before, upto = np.concatenate([[-1], real - WING]), np.concatenate([real - WING - gap_of(length) - 1, [n]])
    first = np.concatenate([np.maximum(real - seen, before[:-1] + 1), [n + 1]])
    bare: list[int] = []
    late = []
    for k in np.flatnonzero(np.minimum(upto, last) > before):
        a, b, c = int(before[k]) + 1, min(int(upto[k]), last), int(first[k])
        bare.extend(range(a, min(b, c - 1) + 1))
        if c <= b:
            late.append((int(real[k]), c, b))
    return bare, late


SPANS = "spans array<struct<start:bigint,end:bigint>>"
LISTS = {"cuts": pa.int32(), "names": pa.int64(), "cores": pa.int64(), "bare": pa.int32(), "hashes": pa.binary(), "again": pa.bool_(), "lo": pa.int32(), "hi": pa.int32(), "late": pa.int64(), "late_at": pa.int32(), "late_lo": pa.int32(), "late_hi": pa.int32()}
_PARSED = "fp binary, uid bigint, many boolean, n int, cuts array<int>, names array<bigint>, cores array<bigint>, bare array<int>, hashes array<binary>, again array<boolean>, lo array<int>, hi array<int>, late array<bigint>, late_at array<int>, late_lo array<int>, late_hi array<int>"


def _lists_of(values: list, kind: pa.DataType) -> pa.Array:
    """A list column of arrays or lists."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    if pa.types.is_binary(kind):
        return pa.ListArray.from_arrays(offsets, pa.array([x for v in values for x in v], type=kind))
    flat = np.concatenate([np.asarray(v, dtype=kind.to_pandas_dtype()) for v in values]) if values else []
    return pa.ListArray.from_arrays(offsets, pa.array(flat, type=kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the lengths of its lists, null as none."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parse(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                got = parsed(texts, length)
                lists = [_lists_of(got[c], kind) for c, kind in LISTS.items()]
                yield pa.RecordBatch.from_arrays([part.column("fp"), part.column("uid"), part.column("many"), pa.array([len(t) for t in texts], type=pa.int32()), *lists], names=["fp", "uid", "many", "n", *got])

    return run


# Order-preserving numbers for the rows of a table.


def _numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df``, whose keys are different, sorted over all partitions, stored with ``no`` from 1 on."""
    rows = df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(np.arange(seen + 1, seen + 1 + batch.num_rows))], names=[*keys, "part", "seq"])
            seen += batch.num_rows

    kinds = dict(df.dtypes)
    sorted_ = stored(rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", part int, seq bigint"), name, batch_rows=20_000)
    return sorted_.join(F.broadcast(_before(sorted_.groupBy("part").agg(F.max("seq").alias("rows")), {"rows": F.sum})), "part").select(*keys, (F.col("seq") + F.col("before_rows")).alias("no"))


def _before(parts: DataFrame, columns: dict) -> DataFrame:
    """For each partition of a sort what the ones before it have: one row for each, hence small."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", *(F.coalesce(f(c).over(ahead), F.lit(0)).alias("before_" + c) for c, f in columns.items()))


def _whole(batches):
    """Batches sorted by ``s``, cut so that each has all rows of its ``s``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column("s").to_numpy()
        if not len(key):
            continue
        start = int(np.searchsorted(key, key[-1]))
        if held and (start or held[-1].column("s")[0].as_py() != key[0]):
            yield pa.concat_batches([*held, batch.slice(0, start)])
            held = []
        elif start:
            yield batch.slice(0, start)
        held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)


def _lists(df: DataFrame, value: str) -> DataFrame:
    """Rows ``s, path, i, value`` as one list by ``i`` for each string, with the largest value where a place has several."""
    columns = [*STRING, "i", value]

    def run(batches):
        for batch in _whole(batches):
            s, path, i, v = (batch.column(c).to_numpy() for c in columns)
            order = np.lexsort((v, i, path, s))
            s, path, i, v = s[order], path[order], i[order], v[order]
            other = (np.diff(s) != 0) | (np.diff(path) != 0)
            last = np.append(other | (np.diff(i) != 0), True)
            s, path, i, v = s[last], path[last], i[last], v[last]
            first = np.append(0, np.flatnonzero((np.diff(s) != 0) | (np.diff(path) != 0)) + 1)
            offsets = pa.array(np.append(first, len(s)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(s[first]), pa.array(path[first]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (i, v))], names=columns)

    rows = df.select(*columns).repartition("s").sortWithinPartitions("s")
    return rows.mapInArrow(run, f"s bigint, path bigint, i array<int>, {value} array<{dict(df.dtypes)[value]}>")


STRING = ["s", "path"]
#: Strings of at most so many names are sorted as they are.
SHORT = 12


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of all places of a batch's strings: the row, the place in its string, the names, and how many places are left."""
    names, n = _flat(batch.column("names"))
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(names)) - np.repeat(np.cumsum(n) - n, n)
    return row, i, names, np.repeat(n, n) - i


def _ahead(values: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The values ``k`` places on in the same string, 0 after its end."""
    return np.where(left > k, np.concatenate([values, np.zeros(k, dtype=values.dtype)])[k:], 0)


def _of_strings(batch: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    return [pa.array(batch.column(c).to_numpy()[row]) for c in STRING]


def _triples(batches):
    """Strings to the triples of names at the places that aren't 0 modulo 3."""
    for batch in batches:
        row, i, names, left = _places(batch)
        some = i % 3 != 0
        yield pa.RecordBatch.from_arrays([*_of_strings(batch, row[some]), pa.array(i[some].astype(np.int32)), *(pa.array(_ahead(names, left, k)[some]) for k in range(3))], names=[*STRING, "i", "a", "b", "c"])


def _tails(batches):
    """Strings to all their suffixes."""
    for batch in batches:
        row, i, names, left = _places(batch)
        starts = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], left) + np.repeat(np.arange(len(names)), left)
        yield pa.RecordBatch.from_arrays([*_of_strings(batch, row), pa.array(i.astype(np.int32)), pa.ListArray.from_arrays(starts, pa.array(names[at]))], names=[*STRING, "i", "tail"])


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lists ``s, path, i, rank`` of rows ``s, path, i`` by the order of their keys, stored."""
    rows = stored(rows, "rows", batch_rows=2_000)
    different = stored(rows.select(*keys).distinct(), "different")
    names = stored(_numbered(different, keys, "sorted"), "names")
    named = stored(_lists(rows.join(names, keys).select(*STRING, "i", F.col("no").alias("rank")), "rank"), "named", batch_rows=20_000)
    for x in (rows, different, names):
        discard(x)
    return named


def suffix_ranks(strings: DataFrame, enough: int) -> DataFrame:
    """Ranks of all suffixes of ``strings`` (``s, path, names``): ``s, path, i, rank``, lists by place, stored.

    Names are over 0, and no string has more than ``enough`` of them.  Equal suffixes have one rank; a string
    that ends is before what goes on.
    """
    if enough <= SHORT:
        return _named(strings.mapInArrow(_tails, "s bigint, path bigint, i int, tail array<bigint>"), ["tail"])
    named = _named(strings.mapInArrow(_triples, "s bigint, path bigint, i int, a bigint, b bigint, c bigint"), ["a", "b", "c"])
    # Strings of names: of the places 1 modulo 3, and of those 2 modulo 3.
    of = lambda m: F.transform(F.filter(F.arrays_zip("i", "rank"), lambda x: x["i"] % 3 == m), lambda x: x["rank"])
    halves = named.select("s", F.explode(F.array(*(F.struct((F.col("path") * 3 + m).alias("path"), of(m).alias("names")) for m in (1, 2)))).alias("x"))
    below = suffix_ranks(halves.select("s", "x.*").filter(F.size("names") > 0), -(-enough // 3))
    discard(named)
    samples = below.select("s", "path", F.explode(F.arrays_zip("i", "rank")).alias("x"))
    samples = samples.select("s", F.floor(F.col("path") / 3).alias("path"), (F.col("x.i") * 3 + F.col("path") % 3).cast("int").alias("i"), "x.rank")
    samples = stored(_lists(samples, "rank").withColumnRenamed("i", "at"), "samples", batch_rows=20_000)
    discard(below)
    out = _merged(strings, samples)
    discard(samples)
    return out


_KEYS = ["kind", "k1", "k2", "k3"]


def _keys(batches):
    """Strings with the ranks of their samples to the merge's keys: of kind 1 (name, rank of the next place) for places 0
    and 1 modulo 3, of kind 2 (name, name, rank of the next but one) for places 0 and 2."""
    for batch in batches:
        row, i, names, left = _places(batch)
        start = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if len(row) else row
        first = np.zeros(batch.num_rows, dtype=np.int64)
        first[row[start]] = start
        at, n = _flat(batch.column("at"))
        rank = np.zeros(len(names), dtype=np.int64)
        rank[np.repeat(first, n) + at] = _flat(batch.column("rank"))[0]
        out = []
        for kind in (1, 2):
            some = (i % 3 == 0) | (i % 3 == kind)
            two = _ahead(names, left, 1) if kind == 2 else np.zeros(len(names), dtype=np.int64)
            own = np.where(i % 3 == 0, 0, rank)
            out.append([x[some] for x in (row, i.astype(np.int32), np.full(len(i), kind), names, two, _ahead(rank, left, kind), own)])
        row, *columns = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([*_of_strings(batch, row), *map(pa.array, columns)], names=[*STRING, "i", *_KEYS, "own"])


def _merged(strings: DataFrame, samples: DataFrame) -> DataFrame:
    """Ranks of all places from those of the samples (``s, path, at, rank``).

    A suffix at a place 0 modulo 3 comes after the samples before it, and among its like by its key.  Of the samples
    before it the last is of kind 1 or 2, so the larger rank of the two sorts tells it.
    """
    rows = stored(strings.join(samples, STRING, "left").mapInArrow(_keys, "s bigint, path bigint, i int, kind bigint, k1 bigint, k2 bigint, k3 bigint, own bigint"), "keys", batch_rows=2_000)
    different = stored(rows.groupBy(*_KEYS).agg(F.max(F.when(F.col("own") == 0, 1).otherwise(0)).alias("zero"), F.max("own").alias("own")), "different")
    columns = [*_KEYS, "zero", "own"]
    sorted_ = different.select(*columns).repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)

    def run(batches):
        part, zeros, most = TaskContext.get().partitionId(), {1: 0, 2: 0}, {1: 0, 2: 0}
        for batch in batches:
            kind, zero, own = (batch.column(c).to_numpy() for c in ("kind", "zero", "own"))
            before, last = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
            for k in (1, 2):
                of = kind == k
                if of.any():
                    running, top = np.cumsum(zero[of]) + zeros[k], np.maximum(np.maximum.accumulate(own[of]), most[k])
                    before[of], last[of] = running - zero[of], top
                    zeros[k], most[k] = int(running[-1]), int(top[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(before), pa.array(last), pa.array(np.full(len(kind), part, dtype=np.int32))], names=[*columns, "before", "last", "part"])

    sorted_ = stored(sorted_.mapInArrow(run, ", ".join(f"{c} bigint" for c in _KEYS) + ", zero int, own bigint, before bigint, last bigint, part int"), "sorted", batch_rows=20_000)
    of = lambda c, k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    parts = sorted_.withColumn("upto", F.col("before") + F.col("zero")).groupBy("part").agg(*(of(c, k) for c in ("upto", "last") for k in (1, 2)))
    ahead = _before(parts, {"upto1": F.sum, "upto2": F.sum, "last1": F.max, "last2": F.max})
    pick = lambda c: F.when(F.col("kind") == 1, F.col(f"before_{c}1")).otherwise(F.col(f"before_{c}2"))
    known = sorted_.join(F.broadcast(ahead), "part").select(*_KEYS, (F.col("before") + pick("upto")).alias("zeros"), F.greatest("last", pick("last")).alias("last"), (F.col("own") > 0).alias("same"))
    known = stored(known, "known")
    # Of the two sorts that with the larger rank before tells a place's own: zeros are the same in both, and that of ``same`` takes less than one more does.
    rank = F.when(F.col("own") > 0, 2 * (F.col("zeros") + F.col("own"))).otherwise(2 * (F.col("zeros") + F.col("last")) + F.when(F.col("same"), 0).otherwise(1))
    out = stored(_lists(rows.join(known, _KEYS).select(*STRING, "i", (rank + 1).alias("rank")), "rank"), "ranks", batch_rows=20_000)
    for x in (rows, different, sorted_, known):
        discard(x)
    return out


def _pieces(length: int):
    """Texts with the places of repeated cores to strings of names, each of some suffixes and what follows of them.

    ``need`` has the names that each suffix takes to reach over a window and a gap on, or over the next
    core that is unique, as it shares no more.  A string begins with the first place of a run and where a name's content
    says so, so copies have the same strings; with more than ``PIECE`` names it is split, if it has several suffixes.
    """
    reach = length + gap_of(length)
    held = length - WING - gap_of(length)

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("uid", "first", "names", "need")}
            for uid, cuts, names, cores, places in zip(*(batch.column(c) for c in ("uid", "cuts", "names", "cores", "i")), strict=True):
                uid, cuts, names, cores, places = uid.as_py(), *(x.values.to_numpy() for x in (cuts, names, cores, places))
                places = np.sort(places)
                # The first place from whose cut on enough is covered, or all.
                upto = np.minimum(np.searchsorted(cuts, cuts[places] + reach), len(names))
                runs = np.flatnonzero(np.diff(places, prepend=-9) != 1)
                after = places[np.append(runs[1:], len(places)) - 1] + 1
                known = (after < len(names)) & (cores[np.minimum(after, len(names) - 1)] != 0)
                ends = np.where(known, np.maximum(np.searchsorted(cuts, cuts[np.minimum(after, len(names) - 1)] + (held - GRAM - WING), side="right") - 1, after + 1), len(names))
                upto = np.minimum(upto, np.repeat(ends, np.diff(np.append(runs, len(places)))))
                breaks = np.flatnonzero((np.diff(places, prepend=-9) != 1) | (names[places] % BREAK == 0)).tolist()
                for a, b in zip(breaks, [*breaks[1:], len(places)], strict=True):
                    while a < b:
                        e = min(b, max(a + 1, int(np.searchsorted(upto[a:b], places[a] + PIECE, side="right")) + a))
                        out["uid"].append(uid)
                        out["first"].append(int(places[a]))
                        out["names"].append(names[places[a] : upto[e - 1]])
                        out["need"].append((upto[a:e] - places[a:e]).astype(np.int32))
                        a = e
            key = [xxhash.xxh3_128_digest(x.tobytes() + y.tobytes()) for x, y in zip(out["names"], out["need"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, type=pa.binary()), pa.array(out["uid"], type=pa.int64()), pa.array(out["first"], type=pa.int32()), _lists_of(out["names"], pa.int64()), _lists_of(out["need"], pa.int32())], names=["key", *out])

    return run


def _shared(pieces: DataFrame) -> DataFrame:
    """``uid, first, t``: the most names that each suffix of a text's pieces shares with any other, lists by piece, stored.

    Equal pieces are sorted once.
    """
    strings = stored(pieces.groupBy("key").agg(F.first(F.struct("names", "need")).alias("x"), (F.count("*") > 1).alias("many")).select("key", "x.*", "many", F.monotonically_increasing_id().alias("s")), "strings")
    most = strings.agg(F.max(F.size("names"))).first()[0] or 0
    ranks = suffix_ranks(strings.select("s", F.lit(0).cast("bigint").alias("path"), "names"), most)
    places = ranks.select("s", F.explode(F.arrays_zip("i", "rank")).alias("x")).select("s", "x.i", "x.rank")
    places = stored(places.join(strings.select("s", "many", F.size("need").alias("own")), "s").filter("i < own").select("s", "i", "rank", "many"), "places")
    discard(ranks)
    each = stored(places.groupBy("rank").agg((F.max("many") | (F.count("*") > 1)).alias("many"), F.min(F.struct("s", "i")).alias("x")).select("rank", "many", "x.*"), "each")
    order = stored(_numbered(each, ["rank"], "sorted"), "order")
    chain = F.slice("names", F.col("i") + 1, F.get("need", F.col("i")))
    chains = stored(each.join(order, "rank").join(strings.select("s", "names", "need"), "s").select("no", "rank", "many", chain.alias("chain")), "chains")
    # Neighbours of the sorted order, in blocks that have the rows beside them too.
    block = F.floor(F.col("no") / BLOCK)
    rows = chains.select(F.explode(F.array_distinct(F.array(block, F.floor((F.col("no") - 1) / BLOCK), F.floor((F.col("no") + 1) / BLOCK)))).alias("block"), block.alias("home"), "no", "rank", "many", "chain")
    rows = rows.select("block", (F.col("block") * (BLOCK + 2) + F.col("no") - F.col("block") * BLOCK + 1).alias("at"), (F.col("block") == F.col("home")).alias("own"), "rank", "many", "chain")
    known = stored(rows.repartition("block").sortWithinPartitions("at").mapInArrow(_common, "rank bigint, t int"), "known", batch_rows=5_000)
    lists = stored(_lists(places.join(known, "rank").select("s", F.lit(0).cast("bigint").alias("path"), "i", "t"), "t").join(strings.select("s", "key"), "s").select("key", "t"), "lists", batch_rows=20_000)
    out = stored(pieces.select("key", "uid", "first").join(lists, "key").select("uid", "first", "t"), "shared")
    for x in (strings, places, each, order, chains, known, lists):
        discard(x)
    return out


def _common(batches):
    """Rows sorted by ``at`` to the most names that each ``own`` one begins with in common with those one place before or after it."""

    def found(batch, start):
        at, (names, n) = batch.column("at").to_numpy(), _flat(batch.column("chain"))
        begin = np.cumsum(n) - n
        both = np.where(np.diff(at) == 1, np.minimum(n[:-1], n[1:]), 0)
        row = np.repeat(np.arange(len(both)), both)
        k = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
        differ = names[begin[row] + k] != names[begin[row + 1] + k]
        t = both.copy()
        np.minimum.at(t, row[differ], k[differ])
        most = np.maximum(np.append(0, t), np.append(t, 0))
        many, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("many", "own"))
        own[:start] = False
        return batch.column("rank").to_numpy(), np.where(many, n, most), own

    def rows(rank, t, own):
        return pa.RecordBatch.from_arrays([pa.array(rank[own]), pa.array(t[own].astype(np.int32))], names=["rank", "t"])

    # The last row waits for the next batch, and the one before it goes there once more.
    held, start = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_batches([held, batch]) if held else batch
        rank, t, own = found(held, start)
        yield rows(rank[:-1], t[:-1], own[:-1])
        start = min(1, held.num_rows - 1)
        held = held.slice(held.num_rows - 1 - start)
    if held:
        yield rows(*found(held, start))


_LEFT = {"core": pa.int64(), "key": pa.int64(), "at": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "open": pa.bool_()}
_DECIDED = "uid bigint, lo array<int>, hi array<int>, left array<struct<core:bigint,key:bigint,at:int,lo:int,hi:int,open:boolean>>"


def _decided(length: int):
    """Texts with what their suffixes share to the windows that repeat for sure, as ranges, and to those left.

    Windows from a cut on, within the whole phrases that it shares, repeat.  Of the windows that have
    their first cut at a place, those stay left which may lie in what it shares, part of a phrase more included; ``open``
    says that some of them aren't sure to repeat, ``key`` stands for their bytes and those of all the windows of the place.
    """
    gap = gap_of(length)

    def run(batches):
        for batch in batches:
            los, his, lefts = [], [], []
            for n, cuts, names, cores, shared in zip(*(batch.column(c) for c in ("n", "cuts", "names", "cores", "shared")), strict=True):
                n = n.as_py()
                cuts, names, cores = (x.values.to_numpy().astype(np.int64) for x in (cuts, names, cores))
                first, (t, own) = shared.values.field("first").to_numpy(), _flat(shared.values.field("t"))
                places = np.repeat(first, own) + np.arange(len(t)) - np.repeat(np.cumsum(own) - own, own)
                order = np.argsort(places)
                places, t = places[order].astype(np.int64), t[order].astype(np.int64)
                # Where the grams of cuts end, and the text.
                ends = np.concatenate([cuts + GRAM, [n]])
                whole = np.where(t > 0, ends[places + t], cuts[places])
                # What else may be common ends before the next cut with all that makes it one.
                part = np.minimum(ends[np.minimum(places + t + 1, len(cuts))] + WING, n)
                sure = whole - length >= cuts[places]
                los.append(cuts[places][sure])
                his.append((whole - length)[sure])
                reach = np.zeros(len(cuts), dtype=np.int64)
                reach[places] = whole
                reach = np.maximum.accumulate(reach)
                # Cuts, but for the beginning.
                places, part = places[places > 0], part[places > 0]
                c, z = cuts[places], cuts[places - 1]
                lo = np.maximum(np.maximum(np.where(places > 1, z + 1, 0) - WING, c - WING - gap), 0)
                hi = np.minimum(np.minimum(c - WING, part - length), n - length)
                some = lo <= hi
                places, c, z, lo, hi = places[some], c[some], z[some], lo[some], hi[some]
                # Of those from the cut before on, and of those ahead of it.
                ahead = np.where(places > 1, reach[np.maximum(places - 2, 0)], 0)
                open_ = (hi >= z) & (hi > reach[places - 1] - length) | (lo < z) & (np.minimum(hi, z - 1) > ahead - length)
                raw, upto = names.tobytes(), np.searchsorted(cuts, c + length - GRAM)
                key = [xxhash.xxh3_64_intdigest(raw[8 * max(i - 2, 0) : 8 * j], seed=min(i, 2)) >> 1 for i, j in zip(places.tolist(), upto.tolist(), strict=True)]
                lefts.append((cores[places], np.array(key, dtype=np.int64), c, lo, hi, open_))
            offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in lefts])]).astype(np.int32)
            flat = [pa.array(np.concatenate([x[k] for x in lefts]).astype(kind.to_pandas_dtype()), type=kind) for k, kind in enumerate(_LEFT.values())] if lefts else [pa.array([], type=kind) for kind in _LEFT.values()]
            left = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=list(_LEFT)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), _lists_of(los, pa.int32()), _lists_of(his, pa.int32()), left], names=["uid", "lo", "hi", "left"])

    return run


def _windows(length: int):
    """Texts with ranges of windows to ``common, uid, p, hashes, open``: some windows following each other, and what they have in common.

    Windows of a cut are dealt by their distance to it, so windows that are equal are of lots that have equal
    bytes in common, and only such lots are looked at window by window.
    """

    def run(batches):
        for batch in batches:
            for uid, text, ranges in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                common, starts, hashes, opens = [], [], [], []
                for r in ranges:
                    for k in range((r["at"] - r["hi"]) // LOT, (r["at"] - r["lo"]) // LOT + 1):
                        lo, hi = max(r["lo"], r["at"] - LOT * k - LOT + 1), min(r["hi"], r["at"] - LOT * k)
                        begin = r["at"] - LOT * k
                        common.append(xxhash.xxh3_128_digest(text[begin : begin - LOT + 1 + length], seed=1 + k))
                        starts.append(lo)
                        hashes.append([window_hash(text[i : i + length]) for i in range(lo, hi + 1)])
                        opens.append(r["open"])
                yield pa.RecordBatch.from_arrays([pa.array(common, type=pa.binary()), pa.array([uid] * len(common), type=pa.int64()), pa.array(starts, type=pa.int32()), _lists_of(hashes, pa.binary()), pa.array(opens, type=pa.bool_())], names=["common", "uid", "p", "hashes", "open"])

    return run


def dealt_texts(texts: DataFrame, length: int) -> DataFrame:
    """``fp, text, many, uid``: each different text of ``texts`` (``fp, text``) as long as ``length``, and whether it occurs several times.

    Stored in buckets of fp: texts are shuffled here and never again, as later joins bring to them what belongs to each.
    """
    different = texts.filter(F.octet_length("text") >= length).groupBy("fp").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("many"))
    return stored(different.withColumn("uid", F.monotonically_increasing_id()), "texts", key="fp")


def repeated_windows(texts: DataFrame, length: int = 400, dealt: DataFrame | None = None) -> DataFrame:
    """``fp, many, lo, hi``: for each different text of ``texts`` (``fp, text``, equal fp meaning equal text) that has any, the
    ranges of the starts of its strings of ``length`` bytes that start anywhere else.  Of texts that occur
    several times (``many``) that is all of them, and the ranges are null.  Stored.  ``dealt`` has the :func:`dealt_texts`, if they are stored already."""
    different = dealt_texts(texts, length) if dealt is None else dealt
    # Equal texts are parsed once.
    docs = stored(different.mapInArrow(_parse(length), _PARSED), "distinct")
    cores = docs.select("uid", F.posexplode("cores").alias("i", "core")).filter("core <> 0")
    twice = stored(cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "cores")
    held = cores.join(twice, "core").select(F.col("uid").alias("s"), F.lit(0).cast("bigint").alias("path"), "i", F.col("i").alias("place"))
    held = stored(_lists(held, "place").select(F.col("s").alias("uid"), "i"), "held", batch_rows=20_000)
    # Texts that have any.
    some_docs = stored(docs.select("uid", "n", "cuts", "names", "cores").join(held, "uid"), "repeating")
    pieces = stored(some_docs.mapInArrow(_pieces(length), "key binary, uid bigint, first int, names array<bigint>, need array<int>"), "pieces")
    # The phrases of the other texts, most of what is stored, are not needed any more.
    parsed_docs, docs = docs, stored(docs.drop("n", "cuts", "names", "cores"), "known_texts")
    for x in (twice, held, parsed_docs):
        discard(x)
    shared = _shared(pieces)
    by_text = shared.groupBy("uid").agg(F.collect_list(F.struct("first", "t")).alias("shared"))
    decided = stored(some_docs.select("uid", "n", "cuts", "names", "cores").join(by_text, "uid").mapInArrow(_decided(length), _DECIDED), "decided")
    for x in (some_docs, pieces, shared):
        discard(x)
    # The windows left, of cores with any that is open; the others once for each key.
    left = decided.select("uid", F.explode("left").alias("x")).select("uid", "x.*")
    open_ = stored(left.filter("open").select("core").distinct(), "open")
    left = stored(left.join(open_, "core"), "left")
    one = left.filter("not open").groupBy("core", "key").agg(F.min(F.struct("uid", "at", "lo", "hi", "open")).alias("x")).select("x.*")
    late = docs.select("uid", F.explode(F.arrays_zip("late", "late_at", "late_lo", "late_hi")).alias("x")).select("uid", F.col("x.late").alias("core"), F.col("x.late_at").alias("at"), F.col("x.late_lo").alias("lo"), F.col("x.late_hi").alias("hi"), F.lit(True).alias("open"))
    both = stored(late.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "late")
    late = late.join(both, "core").select("uid", "at", "lo", "hi", "open")
    ranges = left.filter("open").select("uid", "at", "lo", "hi", "open").unionAll(late).unionAll(one).groupBy("uid").agg(F.collect_list(F.struct("at", "lo", "hi", "open")).alias("ranges"))
    ranges = stored(ranges.join(docs.select("uid", "fp"), "uid"), "ranges")
    merged = different.select("fp", "uid", "text").join(ranges.select("fp", "ranges"), "fp").select("uid", "text", "ranges")
    merged = merged.mapInArrow(_windows(length), "common binary, uid bigint, p int, hashes array<binary>, open boolean")
    bare = docs.select("uid", F.explode(F.arrays_zip("hashes", "bare", "again")).alias("x")).select("x.hashes", "uid", "x.bare", F.array("x.hashes"), ~F.col("x.again"))
    lots = stored(merged.unionAll(bare), "lots", batch_rows=64)
    shared_lots = stored(lots.groupBy("common").agg(F.count("*").alias("n")).filter("n > 1").select("common"), "common")
    windows = lots.join(shared_lots, "common").select("uid", "p", "open", F.posexplode("hashes").alias("k", "hash"))
    windows = stored(windows.select("hash", "uid", (F.col("p") + F.col("k")).alias("p"), "open"), "windows")
    again = stored(windows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "again")
    more = windows.filter("open").join(again, "hash").select(F.col("uid").alias("s"), F.lit(0).cast("bigint").alias("path"), F.col("p").alias("i"), "p")
    gathered = stored(_lists(more, "p").select(F.col("s").alias("uid"), "p"), "more", batch_rows=20_000)
    more = gathered.join(decided.select("uid", F.col("lo").alias("dlo"), F.col("hi").alias("dhi")), "uid", "full")
    all_ = docs.select("uid", "fp", "many", "lo", "hi").join(more, "uid", "left")
    some = lambda *columns: F.concat(*(F.coalesce(c, F.array().cast("array<int>")) for c in columns))
    all_ = all_.select("fp", "many", some("lo", "dlo", "p").alias("lo"), some("hi", "dhi", "p").alias("hi")).filter("many or size(lo) > 0")
    out = stored(all_.select("fp", "many", F.when(~F.col("many"), F.col("lo")).alias("lo"), F.when(~F.col("many"), F.col("hi")).alias("hi")), "repeated")
    for x in (docs, decided, open_, left, both, ranges, lots, shared_lots, windows, again, gathered, *([different] if dealt is None else [])):
        discard(x)
    return out


def cut_out(text: bytes, lo: list[int], hi: list[int], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """A text without the windows that start in the ranges, and the runs of bytes removed."""
    runs: list[list[int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b + length)
        else:
            runs.append([a, b + length])
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), [(a, b) for a, b in runs]


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row of ``df``.

    Removed is each byte of a string of ``length`` bytes (of the text in UTF-8, null as empty) that also starts anywhere else,
    in the same text or another; ``spans`` has the runs of bytes removed, ``start, end``.  Rows are documents, with or without an
    id, so of repeated rows as long as ``length`` nothing is left.  Shorter texts stay.  Other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sha = F.sha2(text, 256)
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), sha.alias("sha"), F.substring(F.unhex(sha), 1, 16).alias("fp"))
    texts = docs.select("fp", "text")
    dealt = dealt_texts(texts, length)
    found = repeated_windows(texts, length, dealt)

    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("text", "lo", "hi")), strict=True):
                rest, runs = cut_out(text, lo, hi, length)
                kept.append(hashlib.sha256(rest).hexdigest())
                spans.append(runs)
            gone = [sum(b - a for a, b in runs) for runs in spans]
            lists = pa.array([[{"start": a, "end": b} for a, b in runs] for runs in spans], type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.string()), lists], names=["fp", "n_removed", "kept_sha256", "spans"])

    # Texts go to Python only where something is cut out, and rows meet what was cut out without their texts.
    cut = dealt.select("fp", "text").join(found.filter("not many").select("fp", "lo", "hi"), "fp").select("fp", "text", "lo", "hi")
    cut = cut.mapInArrow(run, f"fp binary, n_removed bigint, kept_sha256 string, {SPANS}").withColumn("many", F.lit(False))
    gone = found.filter("many").select("fp", F.lit(None).cast("bigint").alias("n_removed"), F.lit(None).cast("string").alias("kept_sha256"), F.lit(None).cast(SPANS.partition(" ")[2]).alias("spans"), "many")
    rows = docs.select("id", "sha", F.octet_length("text").cast("long").alias("n_bytes"), "fp").join(cut.unionAll(gone), "fp", "left")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(F.col("many"), whole).otherwise(F.coalesce("spans", F.array().cast(SPANS.partition(" ")[2])))
    done = rows.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(F.col("many"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("bigint").alias("n_spans"),
        F.when(F.col("many"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        spans.alias("spans"),
    )
    out = stored(done, "kept", batch_rows=500)
    for x in (found, dealt):
        discard(x)
    return out
