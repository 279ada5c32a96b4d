"""Z-order keys of places, and areas as ranges of such keys."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col
from .geo import edge_array, edges_of, inside, wkt_rings

#: Bits of a key for each axis, and the box that keys cut up: longitudes and latitudes.
BITS = 20
WORLD = (-180.0, -90.0, 180.0, 90.0)
#: How a number's bits are drawn apart, by doubling steps (fixed values).
_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _place(v: Column, least: float, most: float) -> Column:
    """The step, of 2**BITS, that a coordinate is in; those outside go to the first or last."""
    step = F.floor((v - least) / ((most - least) / (1 << BITS)))
    return F.greatest(F.least(step, F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")


def _apart(v: Column) -> Column:
    for shift, mask in _STEPS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_key(x: str | Column, y: str | Column, box: tuple[float, float, float, float] = WORLD) -> Column:
    """The bits of both coordinates in turn, so that places near each other mostly have keys near each other; null without coordinates."""
    x, y = col(x), col(y)
    key = _apart(_place(x, box[0], box[2])).bitwiseOR(F.shiftleft(_apart(_place(y, box[1], box[3])), 1))
    # The key stands beside the condition, not in it: each step of it names the one before twice, and Spark works out what
    # is named several times only once where it is needed in any case.
    return key.bitwiseOR(F.when(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y), F.lit(0).cast("long")))


def _meets(edge: tuple[float, float, float, float], x1: float, y1: float, x2: float, y2: float) -> bool:
    """Whether an edge comes into a box, its borders included."""
    ax, ay, bx, by = edge
    if max(ax, bx) < x1 or min(ax, bx) > x2 or max(ay, by) < y1 or min(ay, by) > y2:
        return False
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x1, x2) for y in (y1, y2)]
    return min(side) <= 0 <= max(side)


def cover(rings: list[list[tuple[float, float]]], most: int = 64, box: tuple[float, float, float, float] = WORLD) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys, ends included, that hold all places in an area.

    Squares of keys are split, the largest with a border in them first, as long as there is room; squares all
    outside go.  Each square carries the edges that come into it.
    """
    edges, whole = edges_of(rings), 1 << BITS
    wide, high = (box[2] - box[0]) / whole, (box[3] - box[1]) / whole

    def parity(x: float, y: float) -> bool:
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1

    def square(level: int, i: int, j: int, near: list) -> tuple | None:
        """(order, level, i, j, edges, whether all inside), or None for one outside."""
        size = whole >> level
        # Coordinates beyond the box count as its outermost steps.
        x1 = -1e308 if i == 0 else box[0] + i * size * wide
        y1 = -1e308 if j == 0 else box[1] + j * size * high
        x2 = 1e308 if (i + 1) * size == whole else box[0] + (i + 1) * size * wide
        y2 = 1e308 if (j + 1) * size == whole else box[1] + (j + 1) * size * high
        slack_x, slack_y = wide * 1e-3, high * 1e-3
        own = [e for e in near if max(e[0], e[2]) >= x1 - slack_x and min(e[0], e[2]) <= x2 + slack_x and max(e[1], e[3]) >= y1 - slack_y and min(e[1], e[3]) <= y2 + slack_y and (max(abs(v) for v in (x1, x2, y1, y2)) > 1e300 or _meets(e, x1 - slack_x, y1 - slack_y, x2 + slack_x, y2 + slack_y))]
        if not own and not parity(box[0] + (i + 0.5) * size * wide, box[1] + (j + 0.5) * size * high):
            return None
        return level, i, j, own, not own

    first = square(0, 0, 0, edges)
    open_, done = [(0, 0, first)] if first else [], []
    count = 0
    while open_:
        _, _, (level, i, j, near, all_in) = heapq.heappop(open_)
        if all_in or level == BITS or len(done) + len(open_) + 4 > most:
            done.append((level, i, j))
            continue
        for a in (0, 1):
            for b in (0, 1):
                kid = square(level + 1, 2 * i + a, 2 * j + b, near)
                if kid:
                    count += 1
                    heapq.heappush(open_, (kid[0], count, kid))
    ranges = []
    for level, i, j in done:
        key = sum(((i >> k) & 1) << 2 * k | ((j >> k) & 1) << 2 * k + 1 for k in range(level)) << 2 * (BITS - level)
        ranges.append((key, key + (1 << 2 * (BITS - level)) - 1))
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] + 1 >= a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def within(area: str, x: str, y: str, key: str | None = None, most: int = 64) -> Column:
    """Whether a place lies in an area, a polygon's text.

    With the name of a column of :func:`z_key`, the area's ranges of keys come first as plain comparisons, which reach the
    scan; without, the area's box does.
    """
    rings = wkt_rings(area)
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    rough = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
    if key is not None:
        rough = reduce(or_, (F.col(key).between(a, b) for a, b in cover(rings, most)), F.lit(False))
    return rough & inside(x, y, edge_array(rings))


@dataclass
class Area:
    """A polygon's text as the value of a field in :func:`..operators.relational.predicate`: the coordinates' columns, and that of their key if there is one."""

    text: str
    x: str
    y: str
    key: str | None = None

    def condition(self) -> Column:
        return within(self.text, self.x, self.y, self.key)
