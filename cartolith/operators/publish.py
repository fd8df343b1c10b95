"""Markers, marker sets and projected boundaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cartolith.functions.coords import Grid
from cartolith.functions.text import city_detail
from cartolith.operators.gazetteer import select_city_markers
from cartolith.operators.shapes import ring_segments

MARKER = ["id", "label", "type", "lat", "lon", "detail"]
# How far away each marker type stays visible.
VISIBILITY = {"COUNTRY": 10_000_000.0, "CAPITAL": 10_000_000.0, "REGION": 2_000_000.0}
OTHER_VISIBILITY = 500_000.0
MIN_RING_POINTS, MAX_SIMPLIFY_PASSES = 4, 12


def city_markers(cities: DataFrame, countries: DataFrame, namespace: str) -> DataFrame:
    names = countries.select(F.col("id").alias("country_id"), F.col("name").alias("_country"))
    kind = F.when(F.col("capital"), "capital").otherwise("city")
    return cities.join(names, "country_id", "left").select(
        F.concat(F.lit(namespace), kind, F.lit("/"), F.col("id").cast("string")).alias("id"), F.col("name").alias("label"),
        F.upper(kind).alias("type"), "lat", "lon", city_detail(F.col("_country"), F.col("capital"), F.col("population")).alias("detail"))


def _box_center() -> tuple[Column, Column]:
    return (F.col("min_lat") + F.col("max_lat")) / 2.0, (F.col("min_lon") + F.col("max_lon")) / 2.0


def country_markers(countries: DataFrame, namespace: str) -> DataFrame:
    lat, lon = _box_center()
    return countries.select(F.concat(F.lit(namespace + "country/"), F.col("id").cast("string")).alias("id"),
                            F.col("name").alias("label"), F.lit("COUNTRY").alias("type"), lat.alias("lat"), lon.alias("lon"),
                            F.col("iso_code").alias("detail"))


def region_markers(regions: DataFrame, countries: DataFrame, namespace: str) -> DataFrame:
    lat, lon = _box_center()
    names = countries.select(F.col("id").alias("country_id"), F.col("name").alias("_country"))
    return regions.join(names, "country_id", "left").select(
        F.concat(F.lit(namespace + "region/"), F.col("id").cast("string")).alias("id"), F.col("name").alias("label"),
        F.lit("REGION").alias("type"), lat.alias("lat"), lon.alias("lon"), F.coalesce("_country", F.lit("")).alias("detail"))


def build_markers(countries: DataFrame, regions: DataFrame, cities: DataFrame, namespace: str, city_limit: int | None = None,
                  min_population: int = 0, with_cities: bool = True, with_labels: bool = True) -> DataFrame:
    """All markers of one namespace."""
    empty = country_markers(countries.limit(0), namespace)
    parts = []
    if with_labels:
        parts += [country_markers(countries, namespace), region_markers(regions, countries, namespace)]
    if with_cities:
        parts.append(city_markers(select_city_markers(cities, city_limit, min_population), countries, namespace))
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out


def replace_namespace(markers: DataFrame, fresh: DataFrame, namespace: str) -> DataFrame:
    """Drop the markers of a namespace and put fresh ones in their place."""
    return markers.filter(~F.col("id").startswith(namespace)).unionByName(fresh)


def register_markers(markers: DataFrame, added: DataFrame) -> DataFrame:
    """Add markers; an id that exists is replaced."""
    return markers.join(added.select("id"), "id", "left_anti").unionByName(added)


def unregister_markers(markers: DataFrame, ids: DataFrame) -> DataFrame:
    return markers.join(ids.select("id"), "id", "left_anti")


def markers_by_type(markers: DataFrame, kind: str) -> DataFrame:
    return markers.filter(F.col("type") == kind)


def marker_sets(markers: DataFrame, grid: Grid, prefix: str, with_cities: bool = True, with_labels: bool = True) -> DataFrame:
    """Set, style, visibility and grid position of each marker; town markers are dropped."""
    cities = F.when(F.lit(with_cities) & F.col("type").isin("CITY", "CAPITAL"), prefix + "cities")
    target = (cities.when(F.lit(with_labels) & F.col("type").isin("COUNTRY", "REGION"), prefix + "countries")
              .when(F.col("type").isin("POINT_OF_INTEREST", "CUSTOM"), prefix + "poi"))
    reach = F.coalesce(F.create_map(*[F.lit(v) for p in VISIBILITY.items() for v in p])[F.col("type")], F.lit(OTHER_VISIBILITY))
    x, z = grid.to_grid(F.col("lat"), F.col("lon"))
    return (markers.withColumn("marker_set", target).filter("marker_set IS NOT NULL")
            .select("marker_set", "id", "label", "lat", "lon", F.concat(F.lit(prefix), F.lower("type")).alias("style"), reach.alias("max_distance"),
                    x.alias("x"), z.alias("z"), F.nullif(F.trim("detail"), F.lit("")).alias("detail")))


def marker_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("marker_set").agg(F.count("*").alias("markers"))


def dissolve_edges(shapes: DataFrame, group: str) -> DataFrame:
    """Outline segments of each group: segments that two members share cancel out.

    Exact for boundaries that were digitised edge by edge; segments that only nearly match stay.
    ``shapes`` has rank, radius, rings and the group column.
    """
    segments = ring_segments(shapes).join(shapes.select("rank", group), "rank")
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    undirected = segments.filter("x1 <> x2 OR y1 <> y2").select(group, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return (undirected.groupBy(group, "a", "b").agg(F.count("*").alias("n")).filter("n % 2 = 1")
            .select(group, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")))


def open_ends(shapes: DataFrame, group: str) -> DataFrame:
    """Points (group, x, y, edges) where a dissolved outline does not close: an odd number of its segments ends there.

    They show where members were not digitised edge by edge. Chains between open ends belong to no ring.
    """
    outline = dissolve_edges(shapes, group)
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    points = outline.select(group, F.explode(ends).alias("p")).groupBy(group, "p.x", "p.y").agg(F.count("*").alias("edges"))
    return points.filter("edges % 2 = 1")


def _stitch(edges: pd.DataFrame) -> list[list[tuple[float, float]]]:
    """Closed rings from undirected segments; see :func:`open_ends` for chains that do not close."""
    ends: dict[tuple, list[tuple[int, tuple]]] = {}
    for i, (x1, y1, x2, y2) in enumerate(edges.sort_values(["x1", "y1", "x2", "y2"]).itertuples(index=False, name=None)):
        ends.setdefault((x1, y1), []).append((i, (x2, y2)))
        ends.setdefault((x2, y2), []).append((i, (x1, y1)))
    used: set[int] = set()
    rings = []
    for start in sorted(ends):
        while any(i not in used for i, _ in ends[start]):
            ring, at = [start], start
            while True:
                step = next(((i, to) for i, to in ends[at] if i not in used), None)
                if step is None:
                    break
                used.add(step[0])
                at = step[1]
                ring.append(at)
                if at == start:
                    break
            if len(ring) > 3 and ring[0] == ring[-1]:
                rings.append(ring)
    return rings


def _simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open polyline of (x, z) rows."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        first, last = todo.pop()
        if last - first < 2:
            continue
        base, along = points[first], points[last] - points[first]
        inner = points[first + 1:last] - base
        length = float(along @ along)
        t = np.clip(inner @ along / length, 0.0, 1.0)[:, None] if length > 0 else 0.0
        distance = np.hypot(*(inner - t * along).T)
        worst = int(distance.argmax())
        if distance[worst] > tolerance:
            middle = first + 1 + worst
            keep[middle] = True
            todo += [(first, middle), (middle, last)]
    return points[keep]


def _fit_ring(points: np.ndarray, tolerance: float, max_points: int) -> np.ndarray:
    if len(points) <= max_points:
        return points
    best = points
    for step in range(MAX_SIMPLIFY_PASSES):
        best = _simplified(points.astype(float), tolerance * 2 ** step)
        if len(best) <= max_points:
            break
    return np.floor(best + 0.5).astype(np.int64)


def _area(points: np.ndarray) -> float:
    x, z = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(x @ np.roll(z, -1) - np.roll(x, -1) @ z)) / 2.0


def projected_rings(shapes: DataFrame, group: str, grid: Grid, tolerance: float = 1.0, max_points: int = 2000,
                    min_area: float = 0.0) -> DataFrame:
    """Outlines of dissolved groups in whole grid columns, largest first.

    Segments are projected by Spark; each group's outline is then stitched into rings, rings are
    simplified until they are short enough, and small ones dropped. Only exterior rings stay.
    """
    outline = dissolve_edges(shapes, group)

    def stitch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rings = _stitch(pdf[["x1", "y1", "x2", "y2"]])
        rows = []
        for i, ring in enumerate(rings):
            if any(i != j and _inside(ring, other) for j, other in enumerate(rings)):
                continue
            rows += [(key[0], i, n, x, y) for n, (x, y) in enumerate(ring)]
        return pd.DataFrame(rows, columns=[group, "ring", "n", "lon", "lat"])

    key_type = shapes.schema[group].dataType.simpleString()
    vertices = outline.groupBy(group).applyInPandas(stitch, f"{group} {key_type}, ring int, n int, lon double, lat double")
    x, z = grid.to_grid(F.col("lat"), F.col("lon"))
    blocks = vertices.select(group, "ring", "n", F.floor(x).cast("int").alias("x"), F.floor(z).cast("int").alias("z"))

    def shorten(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values("n")[["x", "z"]].to_numpy()
        fresh = np.ones(len(points), dtype=bool)
        fresh[1:] = (points[1:] != points[:-1]).any(axis=1)
        points = _fit_ring(points[fresh], tolerance, max_points)
        area = _area(points)
        if len(points) < MIN_RING_POINTS or area < min_area:
            return pd.DataFrame(columns=[group, "ring", "area", "points"])
        return pd.DataFrame([[key[0], key[1], area, [{"x": int(a), "z": int(b)} for a, b in points]]],
                            columns=[group, "ring", "area", "points"])

    rings = blocks.groupBy(group, "ring").applyInPandas(
        shorten, f"{group} {key_type}, ring int, area double, points array<struct<x:int,z:int>>")
    return rings.orderBy(F.desc("area"), group, "ring")


def _inside(ring, other) -> bool:
    """Does the first vertex of a ring that is not on the other lie inside the other?"""
    corners = set(other)
    probe = next((p for p in ring if p not in corners), None)
    if probe is None:
        return False
    x, y = probe
    inside = False
    for (x1, y1), (x2, y2) in zip(other, other[1:]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def split_antimeridian(lines: DataFrame, key: list[str]) -> DataFrame:
    """Cut paths (array of lon/lat points) where they cross 180 degrees.

    Returns the pieces with their number; the crossing point appears on both sides.
    """
    pairs = lines.select(*key, F.posexplode(F.arrays_zip(
        F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("i", "s"))
    ax, ay, bx, by = (F.col(c) for c in ("s.a.lon", "s.a.lat", "s.b.lon", "s.b.lat"))
    jump = F.abs(bx - ax) > 180.0
    edge = F.when(bx < ax, F.lit(180.0)).otherwise(F.lit(-180.0))
    moved = bx + F.when(bx < ax, 360.0).otherwise(-360.0)
    lat = ay + (edge - ax) / F.when(moved != ax, moved - ax) * (by - ay)

    def seg(x1, y1, x2, y2, after: int):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.lit(after).alias("after"))

    parts = F.when(jump, F.array(seg(ax, ay, edge, lat, 0), seg(-edge, lat, bx, by, 1))).otherwise(F.array(seg(ax, ay, bx, by, 0)))
    from pyspark.sql import Window
    along = Window.partitionBy(*key).orderBy("i", "after")
    rows = pairs.select(*key, "i", F.explode(parts).alias("p")).select(*key, "i", "p.*")
    return rows.withColumn("piece", F.sum("after").over(along).cast("int")).select(
        *key, "piece", F.col("i").alias("segment"), "x1", "y1", "x2", "y2")
