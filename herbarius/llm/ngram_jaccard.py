"""Jaccard self-join on word n-grams through an R-tree of count vectors.

Shingles are hashed into groups, and a document's counts by group are a point.  A group holds
at most the smaller of two counts of common shingles, so the sum of coordinate minima bounds
the overlap of two documents, and that of a document with all of a node whose coordinate
maxima are known.  Pairs whose bound reaches what the similarity needs are verified on the sets.

Upper level.  Points of unlike documents are all about equally far apart, so boxes around
hundreds of them overlap everywhere and a tree on such boxes alone prunes nothing.  The nodes
below the root are therefore slabs: boxes that are one point wide in a block of coordinates and
open in all others.  The coordinates of a size band make blocks of ``FINE`` groups.  Each block in
which two points differ takes one at least from their sum of minima, so linked points are equal
in all but a bounded number ``d`` of blocks: they share a slab.

Which slabs.  A document need not be in the slabs of all its blocks: with all slabs in one
order, linked documents share one among the first ``d + 1`` of either.  The order is by the number
of points in a slab, those of one point first and those of empty blocks last.  Passages that many
documents share make full slabs, and these are left alone unless a document has little else.

Lower level.  A node's documents are packed into leaves with their coordinate maxima; leaves,
then documents and leaves, then documents are tested by the sums of minima.

Large groups of copies cost no more than others: equal sets are one point; each point is first
tried with the one that it shares most nodes with, which joins near copies in a star, then with
a few hubs of its nodes for what the star missed; nodes that lie in one component need no
further test, and the others are searched leaf by leaf.
Points have about as many coordinates as their documents have shingles, so that the bound is
sharp enough to keep all but a few unlinked pairs from the verification on sets.

Whatever is joined on a key that many rows may have is a stored table of one row a key, so that
Spark can split the other side (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, slices, splitmix, stored

#: Bounds of a point's number of coordinates, coordinates within nodes, and documents of a leaf.
LEAST, MOST, COARSE = 64, 4096, 128
LEAF = 128
#: Coordinates of a block, and leaves that a task of the leaf search holds on its left.
FINE = 1 << 20
STRIPE = 8
#: Hubs of a node in a round, and rounds of them, before what is left is searched.
HUBS, ROUNDS = 8, 2
#: Keys that a document carries in the search of nodes.
CARRIED = 12
#: Low bits of a slab's key: its band, and whether its block is empty.
BAND, EMPTY = 0xFF, 0x100


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the word n-grams of a text.

    A-Z are lower-cased; words are runs of other than ASCII white space.  A text of fewer
    words than ``words`` has one shingle, all of it; one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = min(words, len(w))
    s = splitmix(w[: len(w) - n + 1] + np.uint64(n))
    for k in range(1, n):
        s = splitmix(s ^ w[k : len(w) - n + 1 + k])
    return np.unique(s)


class Bands:
    """Size bands, each with its number of blocks, for similarity ``num / den``."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < most:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 3 // 2))
        self.low = np.array(self.low, dtype=np.int64)

    def of(self, n: int) -> list[int]:
        """The bands in which a document of n shingles can meet one as large or larger."""
        own = int(np.searchsorted(self.low, n, side="right")) - 1
        out = [own]
        while n * self.den >= self.num * int(self.low[out[-1] + 1]):
            out.append(out[-1] + 1)
        return out

    def blocks(self, band: int) -> int:
        """Blocks of the band: more than linked documents of it can differ in; 0 if they can't differ."""
        most = int(self.low[band + 1]) - 1
        differ = 2 * most * (self.den - self.num) // (self.den + self.num)
        return differ + 1 + differ // 8 if differ else 0

    def differ(self, band: int, n: int) -> int:
        """Shingles, and so blocks, in which a document of n can differ from one linked with it in the band."""
        other = min(int(self.low[band + 1]) - 1, n * self.den // self.num)
        return (n + other) * (self.den - self.num) // (self.den + self.num)


def point(s: np.ndarray, most: int = MOST) -> np.ndarray:
    """Counts by group, up to 255; groups are a power of two, half as many as shingles at least
    as long as that isn't over ``most``."""
    groups = min(most, max(LEAST, 1 << max(0, len(s) - 1).bit_length() >> 1))
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def points_of(vecs: list[bytes], width: int | None = None) -> np.ndarray:
    """Points as rows of one width, the least if none is given: others are folded, which adds up groups."""
    width = width or min(map(len, vecs))
    return np.array([np.frombuffer(v, dtype=np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int32) for v in vecs])


def slabs(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[dict]]:
    """Keys of the slabs of a set, and for each band their number ``held`` and how many of them,
    in the order of slabs, it has to be in (``take``).

    A key is a hash of a block's number and counts.  Empty blocks are last in the order, so those
    that can't be among the first ``take`` are left out.
    """
    keys, held = [], []
    for band in bands.of(len(s)):
        m = bands.blocks(band)
        if not m:
            continue
        block = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        edges = np.searchsorted(block, np.arange(m + 1, dtype=np.uint64))
        # A sum over shingles of hashes of their groups depends on the groups' counts alone.
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(s & np.uint64(FINE - 1)), dtype=np.uint64)])
        empty = edges[1:] == edges[:-1]
        key = splitmix(total[edges[1:]] - total[edges[:-1]] ^ splitmix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40)))
        key = key & np.uint64((1 << 64) - 512) | np.uint64(band) | np.where(empty, np.uint64(EMPTY), np.uint64(0))
        take = bands.differ(band, len(s)) + 1
        own = np.concatenate([key[~empty], key[empty][: max(0, take - int((~empty).sum()))]])
        keys.append(own)
        held.append({"band": band, "held": len(own), "take": take})
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64), held


_HELD = "array<struct<band:int,held:int,take:int>>"


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _features(df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """``id, n, fp, vec, coarse, keys, held``: set size, digest of the set (null if empty), point,
    the same with few coordinates, slabs."""
    arrow = pa.list_(pa.struct([("band", pa.int32()), ("held", pa.int32()), ("take", pa.int32())]))

    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            for part in slices(batch, text_col):
                n, fp, vec, coarse, keys, held = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words)
                    own, some = slabs(s, bands)
                    n.append(len(s))
                    fp.append(digest(s))
                    vec.append(point(s).tobytes())
                    coarse.append(point(s, COARSE).tobytes())
                    keys.append(own.view(np.int64))
                    held.append(some)
                cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                lists = pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pa.array(np.concatenate(keys), type=pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, type=pa.int64()), pa.array(fp, type=pa.binary()), pa.array(vec, type=pa.binary()), pa.array(coarse, type=pa.binary()), lists, pa.array(held, type=arrow)], names=["id", "n", "fp", "vec", "coarse", "keys", "held"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)).mapInArrow(run, f"id {kind}, n bigint, fp binary, vec binary, coarse binary, keys array<bigint>, held {_HELD}")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """``fp, n, shingles`` of rows ``id, text``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, words) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], type=pa.binary()), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([s.view(np.int64) for s in sets], type=pa.list_(pa.int64()))], names=["fp", "n", "shingles"])

    return df.select("text").mapInArrow(run, "fp binary, n bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, points: DataFrame, df: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` of points whose sets are as similar as asked.

    ``points`` has ``pid, id, fp``, ``df`` has ``id, text``.  An id may have several texts, so sets
    are told apart by their digests.
    """
    wanted = stored(points.select("pid", "id", "fp").join(pairs.select(F.explode(F.array("a", "b")).alias("pid")).distinct(), "pid", "left_semi"), "wanted")
    sets = _sets(df.join(wanted.select("id").distinct(), "id", "left_semi"), words).groupBy("fp").agg(F.first(F.struct("n", "shingles")).alias("x"))
    sets = stored(wanted.select("pid", "fp").join(sets, "fp").select("pid", "x.n", "x.shingles"), "sets")
    left = sets.select(F.col("pid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("pid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    out = stored(both.filter((num + den) * F.size(F.array_intersect("sa", "sb")) >= num * (F.col("na") + F.col("nb"))).select("a", "b"), "verified")
    discard(wanted)
    discard(sets)
    return out


def _promising(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that the sum of coordinate minima lets through; ``facts`` has ``pid, n, vec``."""
    left = facts.select(F.col("pid").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = facts.select(F.col("pid").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))

    def run(batches):
        for batch in batches:
            na, nb = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("na", "nb"))
            both = [points_of([x, y]) for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            # What a count over 255 leaves out may be common as well, as far as both have such.
            cut = np.minimum(na - [p[0].sum() for p in both], nb - [p[1].sum() for p in both])
            overlap = np.array([np.minimum(*p).sum() for p in both], dtype=np.int64) + cut
            keep = pa.array((num + den) * overlap >= num * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


_MEMBERS = "array<struct<pid:bigint,comp:bigint,n:bigint,vec:binary,least:array<bigint>>>"


def _near_in_nodes(members: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Different pairs ``a, b`` of unlike component within a node whose bound is high enough.

    ``members`` has ``key, pid, comp``, the node's first component as ``first`` and its ``size``;
    ``facts`` has ``pid, n, vec``.  A node of few documents is one leaf.  The documents of others are
    dealt to leaves by whether they are of the node's first component, which most are in a group of
    near copies, and pairs of leaves inside it are never made.  The leaves' boxes are tested
    first; what is left goes to tasks by node and stripe of leaves.

    A pair that shares many nodes is given by one of them: each document carries the least keys of
    its nodes, and a pair is left to the least key that both carry.
    """
    least = members.groupBy("pid").agg(F.slice(F.array_sort(F.collect_list("key")), 1, CARRIED).alias("least"))
    facts = stored(facts.join(least, "pid"), "carried")
    member = F.struct("pid", "comp", "n", "vec", "least")
    one = members.filter(F.col("size") <= LEAF).join(facts, "pid").groupBy("key").agg(F.collect_list(member).alias("pa")).select("key", "pa", F.lit(None).cast(_MEMBERS).alias("pb"))
    main = F.col("comp") == F.col("first")
    leaf = F.pmod(F.xxhash64("pid"), F.ceil(F.col("size") / LEAF).cast("long")) * 2 + F.when(main, 0).otherwise(1)
    leaves = members.filter(F.col("size") > LEAF).join(facts, "pid").select("key", leaf.alias("leaf"), main.alias("main"), member.alias("x")).groupBy("key", "leaf", "main").agg(F.collect_list("x").alias("xs"))
    leaves = stored(leaves.mapInArrow(_boxed, f"key bigint, leaf bigint, main boolean, xs {_MEMBERS}, box binary, least bigint, cut bigint"), "leaves", batch_rows=64)
    stripe = F.floor(F.col("leaf") / STRIPE)
    boxes = leaves.select("key", "leaf", "main", "box", "least", "cut")
    left = boxes.select("key", *(F.col(c).alias("l" + c) for c in boxes.columns[1:]))
    right = boxes.select("key", *(F.col(c).alias("r" + c) for c in boxes.columns[1:]))
    near = left.join(right, "key").filter("lleaf <= rleaf and not (lmain and rmain)").mapInArrow(_touching(num, den), "key bigint, la bigint, lb bigint")
    needed = near.select("key", F.floor(F.col("la") / STRIPE).alias("stripe"), F.col("lb").alias("leaf")).distinct()
    a = leaves.select("key", stripe.alias("stripe"), F.col("leaf").alias("la"), F.col("main").alias("ma"), F.col("xs").alias("pa"))
    b = needed.join(leaves.select("key", "leaf", "main", "xs"), ["key", "leaf"]).select("key", "stripe", F.col("leaf").alias("lb"), F.col("main").alias("mb"), F.col("xs").alias("pb"))
    several = a.join(b, ["key", "stripe"]).filter("la <= lb and not (ma and mb)").select("key", "pa", "pb")

    def run(batches):
        for batch in batches:
            found = set()
            for i in range(batch.num_rows):
                key, left, right = (batch.column(c)[i].as_py() for c in ("key", "pa", "pb"))
                found.update(_search(key, left, left if right is None else right, num, den))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], type=pa.int64()), pa.array([y for _, y in found], type=pa.int64())], names=["a", "b"])

    out = stored(one.unionAll(several).mapInArrow(run, "a bigint, b bigint").distinct(), "pairs", batch_rows=64)
    discard(leaves)
    discard(facts)
    return out


def _boxed(batches):
    """Leaves with their coordinate maxima, smallest set and largest cut (see :func:`_search`)."""
    for batch in batches:
        box, least, cut = [], [], []
        for xs in batch.column("xs").to_pylist():
            at = points_of([x["vec"] for x in xs], LEAST)
            n = np.array([x["n"] for x in xs], dtype=np.int64)
            box.append(at.max(axis=0).astype(np.int32).tobytes())
            least.append(int(n.min()))
            cut.append(int((n - at.sum(axis=1)).max()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box, type=pa.binary()), pa.array(least, type=pa.int64()), pa.array(cut, type=pa.int64())], names=["key", "leaf", "main", "xs", "box", "least", "cut"])


def _touching(num: int, den: int):
    """Pairs of leaves whose boxes' sum of minima is high enough for their smallest documents."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lbox, rbox = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.int32).reshape(batch.num_rows, -1) for c in ("lbox", "rbox"))
            least = batch.column("lleast").to_numpy() + batch.column("rleast").to_numpy()
            cut = np.minimum(batch.column("lcut").to_numpy(), batch.column("rcut").to_numpy())
            keep = pa.array((num + den) * (np.minimum(lbox, rbox).sum(axis=1) + cut) >= num * least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("key", "lleaf", "rleaf")], names=["key", "la", "lb"])

    return run


def _search(key: int, left: list[dict], right: list[dict], num: int, den: int) -> set[tuple]:
    """Pairs of two leaves of a node, smaller number first, that the sums of minima let through
    and that no node of a lesser key gives."""
    points = points_of([x["vec"] for x in left] + [x["vec"] for x in right])
    va, vb = points[: len(left)], points[len(left) :]
    na, nb = (np.array([x["n"] for x in leaf], dtype=np.int64) for leaf in (left, right))
    cut_a, cut_b = na - va.sum(axis=1), nb - vb.sum(axis=1)  # what counts over 255 leave out, which may be common as well
    # A document against a leaf: the leaf's maxima, and the smallest of its documents.
    ka = np.flatnonzero((num + den) * (np.minimum(va, vb.max(axis=0)).sum(axis=1) + cut_a) >= num * (na + nb.min()))
    kb = np.flatnonzero((num + den) * (np.minimum(vb, va.max(axis=0)).sum(axis=1) + cut_b) >= num * (nb + na.min()))
    own = np.array([x["comp"] for x in right], dtype=object)
    out = set()
    for i in ka:
        x = left[i]
        js = kb[own[kb] != x["comp"]]
        bound = np.minimum(va[i], vb[js]).sum(axis=1) + np.minimum(cut_a[i], cut_b[js])
        lesser = {k for k in x["least"] if k < key}
        out.update((min(x["pid"], right[j]["pid"]), max(x["pid"], right[j]["pid"])) for j in js[(num + den) * bound >= num * (na[i] + nb[js])] if lesser.isdisjoint(right[j]["least"]))
    return out


def jaccard_components(df: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``df``.

    Two rows are linked if ``den * |A and B| >= num * |A or B|`` for their sets of word
    n-grams (see :func:`shingle_set`); ``component_id`` is the smallest id that links reach,
    its own included.  Null, empty and blank texts have no shingles and no links.  Rows
    without an id have neither (their ``component_id`` is null).  Repeated rows are kept; rows
    of one id with different texts are linked each by its own text.  Other columns are left out.
    """
    docs = stored(_features(df, id_col, text_col, words, num, den), "documents")
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    slim = stored(docs.select("id", "n", "fp"), "sizes")
    points = docs.filter("id is not null and fp is not null").groupBy("fp").agg(F.min_by(F.struct("id", "n", "vec", "coarse", "keys", "held"), "id").alias("x"))
    points = stored(points.select("fp", "x.*").withColumn("pid", F.monotonically_increasing_id()), "points")
    discard(docs)
    live = _first_slabs(points)
    facts = points.select("pid", "n", "vec")

    # A star: each point with the one that is first in most of its nodes.
    votes = live.filter("pid <> hub").groupBy("pid", "hub").agg(F.count("*").alias("votes"))
    tried = stored(votes.groupBy("pid").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub")).select(F.col("hub").alias("a"), F.col("pid").alias("b")), "tried")
    links = _links(tried, facts, points, own, words, num, den)
    for left in range(ROUNDS, -1, -1):
        # What lies in nodes of several components.
        found = components(links)
        state = stored(live.join(found.select(F.col("node").alias("pid"), F.col("component").alias("c")), "pid", "left").select("key", "pid", F.coalesce("c", "pid").alias("comp")), "state")
        mixed = state.groupBy("key").agg(F.min_by("comp", "pid").alias("first"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).filter("x < y").select("key", "first", "size")
        mixed = stored(mixed, "mixed")
        members = stored(state.join(mixed, "key"), "members")
        for x in (found, state, mixed):
            discard(x)
        if not left or members.isEmpty():
            break
        pairs = stored(_with_hubs(members, left).join(tried, ["a", "b"], "left_anti"), "pairs")
        new = _links(pairs, facts, points, own, words, num, den)
        before, old = tried, links
        tried, links = stored(tried.unionAll(pairs), "tried"), stored(links.unionAll(new), "links")
        none = new.isEmpty()
        for x in (before, old, pairs, new):
            discard(x)
        if none:
            break
        discard(members)
    # Points go with each of their nodes, hence the coarse ones; a pair that is left is tried once on all coordinates.
    rough = _near_in_nodes(members, points.select("pid", "n", F.col("coarse").alias("vec")), num, den)
    more = _links(rough.join(tried, ["a", "b"], "left_anti"), facts, points, own, words, num, den)
    reach = components(links.unionAll(more))
    known = stored(points.select("pid", "id", "fp").join(reach.withColumnRenamed("node", "pid"), "pid"), "known")
    firsts = stored(known.groupBy("component").agg(F.min("id").alias("first")), "first")
    named = stored(known.join(firsts, "component").select("fp", F.col("first").alias("component_id")), "named")
    # What has no link is the smallest id of its text.
    alone = stored(points.select("fp", F.col("id").alias("own")), "alone")
    for x in (live, tried, links, members, rough, more, reach, known, firsts, points):
        discard(x)
    out = slim.join(alone, "fp", "left").join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "own", "id")).alias("component_id"))


def _links(pairs: DataFrame, facts: DataFrame, points: DataFrame, own: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that are linked, stored: bound first, then sets."""
    near = stored(_promising(pairs, facts, num, den), "near", batch_rows=512)
    out = _verified(near, points, own, words, num, den)
    discard(near)
    return out


def _with_hubs(members: DataFrame, salt: int) -> DataFrame:
    """Pairs ``a, b``, the smaller number first: each point with some that it shares nodes with, of other components.

    A node has ``HUBS`` hubs, the smallest by as many hashes, so that nodes of one group of near copies
    mostly have the same; a point meets the hub of each hash that most of its nodes have.  A point that
    is near enough to a fair share of its group is thus joined to it without a search of the group's pairs.
    """
    hub = lambda j: F.min_by(F.struct("pid", "comp"), F.xxhash64("pid", F.lit(salt * HUBS + j)))
    hubs = stored(members.groupBy("key").agg(F.array(*(F.struct(F.lit(j).alias("j"), hub(j).alias("h")) for j in range(HUBS))).alias("hubs")), "hubs")
    met = members.join(hubs, "key").select("pid", "comp", F.explode("hubs").alias("x")).filter(F.col("comp") != F.col("x.h.comp"))
    votes = met.groupBy("pid", "x.j", F.col("x.h.pid").alias("hub")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("pid", "j").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub"))
    out = stored(best.select(F.least("pid", "hub").alias("a"), F.greatest("pid", "hub").alias("b")).distinct(), "pairs")
    discard(hubs)
    return out


def _first_slabs(points: DataFrame) -> DataFrame:
    """``key, pid, hub``: the slabs that each point has to be in, as far as others are in them,
    and the first point of each."""
    entries = points.select("pid", F.explode("keys").alias("key"))
    full = stored(entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "full")
    shared = stored(entries.join(full, "key"), "shared")
    discard(full)
    # Slabs of one point come first in the order; all that is known of them is how many there are.
    order = F.struct(F.col("key").bitwiseAND(EMPTY).alias("empty"), "size", "key")
    some = shared.groupBy("pid", F.col("key").bitwiseAND(BAND).cast("int").alias("band")).agg(F.array_sort(F.collect_list(order)).alias("keys"))
    held = points.select("pid", F.explode("held").alias("x")).select("pid", "x.*")
    left = F.col("take") - (F.col("held") - F.size("keys"))
    first = some.join(held, ["pid", "band"]).filter(left > 0).select("pid", F.explode(F.slice("keys", F.lit(1), left)).alias("x")).select("pid", "x.key")
    first = stored(first, "slabs")
    discard(shared)
    hubs = stored(first.groupBy("key").agg(F.min("pid").alias("hub"), F.max("pid").alias("last")).filter("hub < last").select("key", "hub"), "hubs")
    live = stored(first.join(hubs, "key"), "live")
    discard(first)
    discard(hubs)
    return live


def first_of_each(df: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of linked rows, that of the smallest id.

    All columns stay.  Rows without an id, and rows without words, stay as they are; of
    repeated rows of one id one stays.
    """
    found = jaccard_components(df, words, num, den, id_col, text_col)
    firsts = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    with_id = df.filter(F.col(id_col).isNotNull()).join(stored(firsts, "firsts"), id_col, "left_semi").dropDuplicates([id_col])
    return with_id.select(df.columns).unionAll(df.filter(F.col(id_col).isNull()))
