"""Pairs of points and the few places that may be closest to them, without listing all pairs within the radius.

Points and places meet in blocks that are wide beside the radius. Inside a block numpy sorts the places into cells and widens
the search of a point until enough places are found, so the work follows the answers and not the pairs within reach. Blocks
of very many rows are dealt out in parts, each of bounded size; callers pick the closest over all parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cartolith.session import materialise

BLOCK_ROWS = 100_000
SLICE_PAIRS = 2_000_000
# Cells start no smaller than these shares of the radius and of the extent, so that cell numbers fit 64 bits.
LEAST_OF_REACH, LEAST_OF_EXTENT = 2.0 ** -16, 2.0 ** -19


class _Cells:
    """Places sorted by the cells of one size."""

    def __init__(self, places: np.ndarray, size: float):
        self.low, self.size = places.min(axis=0), size * (1.0 + 1e-9)
        cells = np.floor((places - self.low) / self.size).astype(np.int64)
        self.last = cells.max(axis=0)
        self.width = self.last + 5
        codes = self._code(cells)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]

    def _code(self, cells: np.ndarray) -> np.ndarray:
        code = cells[:, 0] + 2
        for d in range(1, cells.shape[1]):
            code = code * self.width[d] + cells[:, d] + 2
        return code

    def fullest(self) -> int:
        return int(np.unique(self.codes, return_counts=True)[1].max())

    def beside(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the sorted places in the cell of each point and around it; cells along the last axis are one range."""
        cells = np.clip(np.floor((points - self.low) / self.size), -1, self.last + 1).astype(np.int64)
        first, until = [], []
        for step in product((-1, 0, 1), repeat=cells.shape[1] - 1):
            code = self._code(cells + np.array([*step, 0]))
            first.append(np.searchsorted(self.codes, code - 1, "left"))
            until.append(np.searchsorted(self.codes, code + 1, "right"))
        return np.stack(first, axis=1), np.stack(until, axis=1)


def closest_pairs(points: np.ndarray, places: np.ndarray, limit: int, reach: float, slack: float, extra: np.ndarray,
                  allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of at most ``reach`` and at most ``slack`` times the distance of the point's ``limit``-th place plus its ``extra``.

    Pairs that are not ``allowed`` do not count.
    """
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(points) or not len(places):
        return found_i[0], found_j[0]
    extent = float((places.max(axis=0) - places.min(axis=0)).max())
    least = max(reach * LEAST_OF_REACH, extent * LEAST_OF_EXTENT)
    widest = radius = max(reach, extent * LEAST_OF_EXTENT)
    cells = _Cells(places, radius)
    while radius / 2 >= least and cells.fullest() > 4 * limit:
        radius /= 2
        cells = _Cells(places, radius)
    todo = np.arange(len(points))
    while True:
        unsettled = []
        first, until = cells.beside(points[todo])
        upto = np.cumsum((until - first).sum(axis=1))
        start = 0
        while start < len(todo):
            # one point at least, whatever lies around it
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_PAIRS, "right")))
            rows, a, n = todo[start:end], first[start:end].ravel(), (until[start:end] - first[start:end]).ravel()
            j = cells.order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            i = np.repeat(np.repeat(np.arange(len(rows)), first.shape[1]), n)
            gap = places[j] - points[rows[i]]
            far = np.sqrt((gap * gap).sum(axis=1))
            near = far <= radius
            if allowed:
                near[near] = allowed(rows[i[near]], j[near])
            i, j, far = i[near], j[near], far[near]
            order = np.lexsort((far, i))
            i, j, far = i[order], j[order], far[order]
            count = np.bincount(i, minlength=len(rows))
            enough = count >= limit
            bound = np.full(len(rows), reach)
            kth = far[(np.cumsum(count) - count)[enough] + limit - 1]
            bound[enough] = kth * slack + extra[rows[enough]]
            settled = (enough & (bound <= radius)) | (radius >= widest)
            kept = settled[i] & (far <= np.minimum(bound, reach)[i])
            found_i.append(rows[i[kept]])
            found_j.append(j[kept])
            unsettled.append(rows[~settled])
            start = end
        todo = np.concatenate(unsettled)
        if radius >= widest or not len(todo):
            return np.concatenate(found_i), np.concatenate(found_j)
        radius = min(radius * 2, widest)
        cells = _Cells(places, radius)


def near_pairs(points: DataFrame, places: DataFrame, point_at: list[Column], place_at: list[Column], reach: float, limit: int,
               slack: float = 1.0 + 1e-9, least_block: float = 5.0, extra: Column | None = None,
               allowed: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows of both frames side by side for the places that may be among the ``limit`` closest of a point.

    ``point_at`` and ``place_at`` are finite coordinates in which distances are straight lines; blocks are as wide as
    ``least_block`` at least, which bounds their number. ``allowed`` tells which of given pairs of rows count at all. The columns of both frames must have different names.
    """
    axes = [f"_b{d}" for d in range(len(point_at))]
    here, there = [f"_u{d}" for d in range(len(point_at))], [f"_v{d}" for d in range(len(point_at))]
    size, reach = max(4.0 * reach, least_block), reach * (1.0 + 1e-9)

    def block(c: Column) -> Column:
        return F.floor(c / size).cast("int")

    asked = points.select("*", *[c.alias(n) for c, n in zip(point_at, here)], (F.lit(0.0) if extra is None else extra).alias("_extra"))
    asked = asked.select("*", *[block(F.col(n)).alias(a) for n, a in zip(here, axes)])
    dealt = places.select("*", *[c.alias(n) for c, n in zip(place_at, there)])
    for n, a in zip(there, axes):
        dealt = dealt.withColumn(a, F.explode(F.sequence(block(F.col(n) - reach), block(F.col(n) + reach))))
    parts = F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")
    # a few thousand blocks at most, whatever the tables hold; written, so that their size is known before the rows meet them
    held = asked.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n")).select(*axes, parts.alias("_np"))
    full = dealt.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n")).select(*axes, parts.alias("_nq"))
    shares = materialise(held.join(full, axes), "shares")
    group = [*axes, "_p", "_q"]

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (asked.join(shares, axes).withColumn("_p", F.pmod(F.xxhash64(*here, *points.columns[:1]), F.col("_np")).cast("int"))
            .withColumn("_q", every("_nq")).select(*group, *points.columns, *here, "_extra"))
    right = (dealt.join(shares, axes).withColumn("_q", F.pmod(F.xxhash64(*there), F.col("_nq")).cast("int"))
             .withColumn("_p", every("_np")).select(*group, *places.columns, *there))
    kept, given = points.columns, places.columns
    schema = T.StructType([*points.schema.fields, *places.schema.fields])

    def grid(table: pa.Table, names: list[str]) -> np.ndarray:
        return np.stack([table[n].to_numpy() for n in names], axis=1)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        counts = (lambda i, j: allowed(a, b, i, j)) if allowed else None
        i, j = closest_pairs(grid(a, here), grid(b, there), limit, reach, slack, a["_extra"].to_numpy(), counts) if a.num_rows and b.num_rows else ([], [])
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table([*a.select(kept).take(i).columns, *b.select(given).take(j).columns], names=[*kept, *given])

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, schema)


def finite(*columns: str) -> Column:
    """No column is null, not a number or infinite."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in columns])


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Unit vector of a place."""
    y, x = F.radians(lat), F.radians(lon)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]
