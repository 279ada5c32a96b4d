"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of about as many bits as the number of codes has binary digits; an
index holds a row for each segment of each different code.  A query probes all segment values
at radius 0, then at 1, 2, ...  After radius r every code that hasn't been seen differs in at
least r + 1 bits in each of the segments, hence in ``segments * (r + 1)`` bits in all.  So a
query is answered once its kth verified distance is at most ``segments * (r + 1) - 1``; the
others go on to the next radius, up to the width of a segment, where everything has been seen.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

WORD = 64


def binary_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = WORD) -> DataFrame:
    """``id, code``: bit i of the code says that coordinate i is above zero.

    Codes of up to 64 bits are longs, others arrays of longs, the first 64 coordinates first.
    Vectors of more than ``bits`` coordinates raise an error at run time; missing coordinates
    and nulls inside a vector count as zero.  Rows without id or vector are left out.
    """
    vector = f"`{vector_col}`"

    def word(w: int) -> str:
        part = f"if(size({vector}) > {w * WORD}, slice({vector}, {w * WORD + 1}, {WORD}), slice({vector}, 1, 0))"
        return f"aggregate(transform({part}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (p, q) -> p | q)"

    code = F.expr(word(0)) if bits <= WORD else F.array(*(F.expr(word(w)) for w in range(-(-bits // WORD))))
    kind = "long" if bits <= WORD else "array<long>"
    checked = F.when(F.size(vector_col) <= bits, code).otherwise(F.raise_error(F.lit(f"vectors have more than {bits} coordinates")).cast(kind))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), checked.alias("code"))


class Layout:
    """How codes of some bits are cut into segments, none of which crosses words; expressions as SQL."""

    def __init__(self, bits: int, width: float):
        self.words = -(-bits // WORD)
        self.cuts = []  # word, first bit, bits
        for w in range(self.words):
            held = min(WORD, bits - w * WORD)
            n = max(1, min(held, round(held / max(width, 1.0)))) if held <= 32 else max(2, round(held / max(width, 1.0)))
            edges = [held * i // n for i in range(n + 1)]
            self.cuts += [(w, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        self.segments = len(self.cuts)
        self.widest = max(n for _, _, n in self.cuts)

    def word(self, code: str, w: int) -> str:
        return code if self.words == 1 else f"{code}[{w}]"

    def segment(self, code: str, s: int) -> str:
        w, at, n = self.cuts[s]
        return f"(shiftrightunsigned({self.word(code, w)}, {at}) & {(1 << n) - 1}L)" if n < WORD else self.word(code, w)

    def apart(self, a: str, b: str) -> str:
        return "(" + " + ".join(f"bit_count({self.word(a, w)} ^ {self.word(b, w)})" for w in range(self.words)) + ")"

    def parts(self, a: str, b: str) -> list[str]:
        """Distances within the segments."""
        return [f"bit_count({self.segment(a, s)} ^ {self.segment(b, s)})" for s in range(self.segments)]


def hamming_topk(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = WORD, width: float | None = None) -> DataFrame:
    """The ``k`` nearest codes of each query: ``query_id, rank, neighbour_id, distance``.

    ``codes`` and ``queries`` have ``id, code`` (see :func:`binary_codes`); other columns are left
    out.  Neighbours are ranked by distance, ties by id; a row with the query's own id is no
    neighbour of it.  Repeated rows (the same id and code) count once.  Queries get fewer rows
    only where fewer other rows exist; an empty table gives an empty result.  ``width`` is
    the segments' width, the logarithm of the number of different codes if none is given.

    Equal codes are held as one, with their ``k + 1`` smallest ids, which is all that any
    list of k can use; the row_number limit is applied before the shuffle, so that a vector
    that a third of all rows share costs no more than others.
    """
    codes, queries = codes.select("id", "code").filter("id is not null and code is not null"), queries.select("id", "code").filter("id is not null and code is not null")
    first = Window.partitionBy("code").orderBy("id")
    kept = stored(codes.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("code", "id"), "codes")
    if width is None:
        width = max(4.0, math.log2(kept.select("code").distinct().count() + 2))
    cut = Layout(bits, width)
    index = stored(
        kept.select("code").distinct().select("code", F.explode(F.expr("array(" + ", ".join(f"named_struct('seg', {s}, 'val', {cut.segment('code', s)})" for s in range(cut.segments)) + ")")).alias("x")).select("x.seg", "x.val", "code"),
        "segments",
    )
    few = codes.distinct().limit(k + 2).count()
    if few < k + 2:  # lists can't fill, and k + 1 rows at most may be sent to all tasks
        pairs = queries.distinct().select(F.col("id").alias("query_id"), F.col("code").alias("qcode")).join(F.broadcast(codes.distinct().limit(k + 1)), F.col("id") != F.col("query_id"))
        pairs = pairs.select("query_id", "id", F.expr(f"cast({cut.apart('qcode', 'code')} as int)").alias("distance"))
        ranks = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return pairs.withColumn("rank", ranks).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
    asked = stored(queries.distinct().select(F.col("id").alias("query_id"), F.col("code").alias("qcode"), F.lit(bits).alias("bound")), "queries")
    open_, best, answers = asked, None, []
    parts = cut.parts("qcode", "code")
    nearest = f"least({', '.join(parts)})" if cut.segments > 1 else parts[0]
    first_seg = "case " + " ".join(f"when {p} = {nearest} then {s}" for s, p in enumerate(parts)) + " end"
    own = "case " + " ".join(f"when seg = {s} then {cut.segment('qcode', s)}" for s in range(cut.segments)) + " end"
    size = "case " + " ".join(f"when seg = {s} then {n}" for s, (_, _, n) in enumerate(cut.cuts)) + " end"
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    for radius in range(cut.widest + 1):
        probes = open_.select("query_id", "qcode", "bound", F.explode(F.expr(f"sequence(0, {cut.segments - 1})")).alias("seg")).withColumns({"val": F.expr(own), "size": F.expr(size), "last": F.lit(-1)})
        for left in range(radius, 0, -1):  # one more bit, above the last, with room for those to come
            probes = probes.select("query_id", "qcode", "bound", "seg", "val", "size", F.explode(F.expr(f"if(size - {left} > last, sequence(last + 1, size - {left}), array())")).alias("last")).withColumn("val", F.expr("val ^ shiftleft(1L, last)"))
        probes = probes.select("query_id", "qcode", "bound", "seg", "val")
        # A code is found in several segments; it counts where the segment distance is smallest, first such segment,
        # and if it isn't farther than the query's kth so far.  The planner can't tell how many probes there are: merge.
        found = probes.hint("merge").join(index, ["seg", "val"]).withColumn("distance", F.expr(f"cast({cut.apart('qcode', 'code')} as int)")).filter(F.expr(f"distance <= bound and {nearest} = {radius} and seg = {first_seg}"))
        rows = found.select("query_id", "code", "distance").hint("merge").join(kept, "code").filter("id <> query_id").select("query_id", "distance", "id")
        if best is not None:
            rows = rows.unionAll(best.join(open_.select("query_id"), "query_id", "left_semi"))
        top = stored(rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k), "best")
        covered = cut.segments * (radius + 1) - 1
        state = top.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        done = state.filter((F.col("n") >= k) & (F.col("far") <= covered)).select("query_id")
        answers.append(top.join(done, "query_id", "left_semi") if radius < cut.widest else top)
        bounds = state.select("query_id", F.when(F.col("n") >= k, F.col("far")).otherwise(bits).alias("bound"))
        still = open_.drop("bound").join(done, "query_id", "left_anti").join(bounds, "query_id", "left")
        still = stored(still.select("query_id", "qcode", F.coalesce("bound", F.lit(bits)).alias("bound")), "queries")
        discard(open_)
        open_, best = still, top.drop("rank")
        if still.isEmpty():
            break
    for x in (index, kept, open_):
        discard(x)
    out = answers[0]
    for x in answers[1:]:
        out = out.unionAll(x)
    return out.select("query_id", F.col("rank").cast("int"), F.col("id").alias("neighbour_id"), "distance")
