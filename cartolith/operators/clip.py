"""Keeping or cutting features by a box."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cartolith.operators.shapes import rings_box
from cartolith.params import RINGS


def keep_meeting(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Whole features whose box meets the clip box; a plain predicate that scans can prune on."""
    south, west, north, east = box
    return features.filter((F.col("min_lat") <= north) & (F.col("max_lat") >= south)
                           & (F.col("min_lon") <= east) & (F.col("max_lon") >= west))


def _cut(points: np.ndarray, axis: int, limit: float, keep_below: bool) -> np.ndarray:
    """Sutherland-Hodgman against one half plane."""
    if len(points) == 0:
        return points
    value = points[:, axis]
    inside = value <= limit if keep_below else value >= limit
    out = []
    for i in range(len(points)):
        j = (i + 1) % len(points)
        if inside[i]:
            out.append(points[i])
        if inside[i] != inside[j]:
            t = (limit - value[i]) / (value[j] - value[i])
            crossing = points[i] + t * (points[j] - points[i])
            crossing[axis] = limit
            out.append(crossing)
    return np.array(out).reshape(-1, 2)


def _clip_ring(points: np.ndarray, box) -> np.ndarray | None:
    south, west, north, east = box
    if len(points) > 1 and (points[0] == points[-1]).all():
        points = points[:-1]
    for axis, limit, below in ((0, west, False), (0, east, True), (1, south, False), (1, north, True)):
        points = _cut(points, axis, limit, below)
    if len(points) < 3:
        return None
    return np.vstack([points, points[:1]])


OUTSIDE, CROSSING, INSIDE = -1, 0, 1


def _fates(points: np.ndarray, ends: np.ndarray, box) -> list[int]:
    """For all rings at once: beyond one side of the box, closed and wholly in it (nothing to cut), or anything else."""
    south, west, north, east = box
    fate = np.full(len(ends), CROSSING)
    starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else np.zeros(0, int)
    some = np.flatnonzero(ends > starts)
    if len(some):
        first = starts[some]
        low, high = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
        away = (high[:, 0] < west) | (low[:, 0] > east) | (high[:, 1] < south) | (low[:, 1] > north)
        held = (low[:, 0] >= west) & (high[:, 0] <= east) & (low[:, 1] >= south) & (high[:, 1] <= north)
        last = ends[some].astype(int) - 1
        whole = (points[first] == points[last]).all(axis=1) & (last - first >= 3)
        fate[some] = np.where(away, OUTSIDE, np.where(held & whole, INSIDE, CROSSING))
    return fate.tolist()


def _clip_rings(value: pa.ListArray, box) -> pa.ListArray:
    """All rings of all rows, from and to the buffers of the column."""
    rings = value.flatten()  # of rows that are not null
    spots = rings.flatten()
    points = np.column_stack([spots.field(name).to_numpy(zero_copy_only=False) for name in ("lon", "lat")])
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False))
    per_row = pc.list_value_length(value)
    fate = _fates(points, ends, box)
    kept, sizes, counts, at = [], [], [], 0
    for n in pc.fill_null(per_row, 0).to_pylist():
        own = []
        for i in range(at, at + n):
            if fate[i] != OUTSIDE:
                ring = points[ends[i - 1] if i else 0:ends[i]]
                ring = ring if fate[i] == INSIDE else _clip_ring(ring, box)
                if ring is not None:
                    own.append(ring)
        at += n
        kept += own
        sizes += map(len, own)
        counts.append(len(own))
    flat = np.concatenate(kept) if kept else np.zeros((0, 2))
    made = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], ["lon", "lat"])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), made)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), inner, mask=per_row.is_null())


def clip_rings(rings: Column, box: tuple[float, float, float, float]) -> Column:
    """Rings cut to a box; those outside it go."""
    @F.arrow_udf(RINGS)
    def clip(value: pa.Array) -> pa.Array:
        return _clip_rings(value, box)

    return clip(rings)


def clip_areas(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Cut areas (rings, min_lat..max_lon) to a box; features left without area are dropped."""
    met = keep_meeting(features, box)
    south, west, north, east = box
    inside = (F.col("min_lat") >= south) & (F.col("max_lat") <= north) & (F.col("min_lon") >= west) & (F.col("max_lon") <= east)
    cut = met.filter(~inside).withColumn("rings", clip_rings(F.col("rings"), box)).filter(F.size("rings") > 0)
    a, b, c, d = rings_box(F.col("rings"))
    cut = cut.withColumn("min_lat", a).withColumn("min_lon", b).withColumn("max_lat", c).withColumn("max_lon", d)
    return met.filter(inside).unionByName(cut.filter("max_lat > min_lat AND max_lon > min_lon"))
