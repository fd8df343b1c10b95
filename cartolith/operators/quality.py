"""Checks of reference data; each yields rows of severity, check, entity, message."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cartolith.operators.gazetteer import boundary_coverage, capitals_per_country
from cartolith.operators.shapes import ShapeIndex, _touched_cells, all_hits, ring_area, ring_segments

OVERLAP_TOLERANCE = 0.01
SMALL_FEATURE = 32


def _finding(df: DataFrame, severity: str, check: str, entity: Column, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"),
                     entity.cast("string").alias("entity"), message.alias("message"))


def cities_outside_coverage(countries: DataFrame, cities: DataFrame) -> DataFrame:
    box = boundary_coverage(countries).select(*[F.col(c).alias(f"_{c}") for c in ("min_lat", "min_lon", "max_lat", "max_lon")])
    # the box is one row by construction
    out = cities.crossJoin(F.broadcast(box)).filter(
        ~(F.col("lat").between(F.col("_min_lat"), F.col("_max_lat")) & F.col("lon").between(F.col("_min_lon"), F.col("_max_lon"))))
    return _finding(out, "warning", "city_outside_coverage", F.col("id"), F.col("name"))


def duplicate_iso(countries: DataFrame) -> DataFrame:
    dup = countries.groupBy(F.upper("iso_code").alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    return _finding(dup, "error", "duplicate_iso", F.col("k"), F.format_string("used by %d countries", F.col("n")))


def duplicate_names(countries: DataFrame) -> DataFrame:
    dup = countries.groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    return _finding(dup, "warning", "duplicate_name", F.col("k"), F.format_string("appears %d times", F.col("n")))


def _crossings(edges: np.ndarray, middle: float) -> np.ndarray:
    """Where the edges (x1, y1, x2, y2), upward, meet a latitude; pairs of them bound the inside."""
    x1, y1, x2, y2 = edges[(edges[:, 1] < middle) & (edges[:, 3] > middle)].T
    return np.sort(x1 + (middle - y1) * (x2 - x1) / (y2 - y1))


def _shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two shapes share, from their edges within one band of latitude.

    Between two neighbouring latitudes at which an edge ends or edges of both shapes cross, the common width changes
    linearly, so its value in the middle times the height is exact.
    """
    levels = [a[:, 1], a[:, 3], b[:, 1], b[:, 3]]
    slope_b, base_b = (b[:, 2] - b[:, 0]) / (b[:, 3] - b[:, 1]), b[:, 0] - b[:, 1] * (b[:, 2] - b[:, 0]) / (b[:, 3] - b[:, 1])
    for x1, y1, x2, y2 in a:
        slope = (x2 - x1) / (y2 - y1)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (base_b - (x1 - y1 * slope)) / (slope - slope_b)
        levels.append(y[(y > y1) & (y < y2) & (y > b[:, 1]) & (y < b[:, 3])])
    levels = np.unique(np.concatenate(levels))
    area = 0.0
    for low, high in zip(levels, levels[1:]):
        p, q = _crossings(a, (low + high) / 2), _crossings(b, (low + high) / 2)
        if len(p) > 1 and len(q) > 1:
            p, q = p[:len(p) // 2 * 2].reshape(-1, 2), q[:len(q) // 2 * 2].reshape(-1, 2)
            width = np.minimum(p[:, None, 1], q[None, :, 1]) - np.maximum(p[:, None, 0], q[None, :, 0])
            area += float(np.maximum(width, 0.0).sum()) * (high - low)
    return area


def overlap_shares(shapes: DataFrame, band_degrees: float = 1.0, reach_degrees: float = 10.0) -> DataFrame:
    """(a, b, share): common area of two shapes as a share of the smaller one's, for all pairs that share any area.

    Areas are exact in square degrees, whatever the size of a shape. Edges are cut into bands of latitude; shapes meet in a
    band and a stretch of longitude, and a task holds the edges of two shapes in one band. Lines have no area.
    """
    segments = ring_segments(shapes).filter(F.col("radius").isNull() & (F.col("y1") != F.col("y2")))
    up = F.col("y1") < F.col("y2")
    oriented = segments.select("rank", *[F.when(up, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])
    size = F.lit(band_degrees)
    banded = oriented.withColumn("band", F.explode(F.sequence(F.floor(F.col("y1") / size), F.floor(F.col("y2") / size))))
    low, high = F.col("band") * size, (F.col("band") + 1) * size

    def at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))

    edges = banded.select("rank", "band", F.when(F.col("y1") < low, at(low)).otherwise(F.col("x1")).alias("x1"), F.greatest("y1", low).alias("y1"),
                          F.when(F.col("y2") > high, at(high)).otherwise(F.col("x2")).alias("x2"), F.least("y2", high).alias("y2")).filter("y1 < y2")
    spans = (edges.groupBy("rank", "band").agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"))
             .withColumn("stretch", F.explode(F.sequence(F.floor(F.col("west") / reach_degrees), F.floor(F.col("east") / reach_degrees)))))
    one, other = (spans.select(F.col("rank").alias(n), "band", "stretch", F.col("west").alias(f"{n}_west"), F.col("east").alias(f"{n}_east")) for n in "ab")
    pairs = one.join(other, ["band", "stretch"]).filter("a < b AND a_west < b_east AND b_west < a_east").select("a", "b", "band").distinct()
    corners = ["x1", "y1", "x2", "y2"]
    sides = [pairs.join(edges.withColumnRenamed("rank", n), [n, "band"]).select("a", "b", "band", F.lit(n).alias("side"), *corners) for n in "ab"]

    def piece(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, q = (rows.loc[rows.side == n, corners].to_numpy() for n in "ab")
        return pd.DataFrame([[key[0], key[1], _shared_area(p, q)]], columns=["a", "b", "area"])

    def own(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[corners].to_numpy()
        return pd.DataFrame([[key[0], _shared_area(p, p)]], columns=["rank", "area"])

    kind = shapes.schema["rank"].dataType.simpleString()
    shared = (sides[0].unionByName(sides[1]).groupBy("a", "b", "band").applyInPandas(piece, f"a {kind}, b {kind}, area double")
              .groupBy("a", "b").agg(F.sum("area").alias("shared")).filter("shared > 0"))
    areas = edges.groupBy("rank", "band").applyInPandas(own, f"rank {kind}, area double").groupBy("rank").agg(F.sum("area").alias("area"))
    return (shared.join(areas.select(F.col("rank").alias("a"), F.col("area").alias("area_a")), "a")
            .join(areas.select(F.col("rank").alias("b"), F.col("area").alias("area_b")), "b")
            .select("a", "b", (F.col("shared") / F.least("area_a", "area_b")).alias("share")))


def overlapping_countries(shapes: DataFrame, tolerance: float = OVERLAP_TOLERANCE) -> DataFrame:
    found = overlap_shares(shapes).filter(F.col("share") > tolerance)
    return _finding(found, "error", "country_overlap", F.concat_ws("/", "a", "b"),
                    F.format_string("overlap by %.1f%% of the smaller one", F.col("share") * 100.0))


def orphan_regions(countries: DataFrame, regions: DataFrame) -> DataFrame:
    ids = countries.select(F.col("id").alias("country_id"))
    return _finding(regions.join(ids, "country_id", "left_anti"), "error", "orphan_region", F.col("id"),
                    F.lit("references a country that is not there"))


def misplaced_regions(countries: DataFrame, regions: DataFrame) -> DataFrame:
    boxes = countries.select(F.col("id").alias("country_id"), *[F.col(c).alias(f"_{c}") for c in
                                                                ("min_lat", "min_lon", "max_lat", "max_lon")])
    apart = ((F.col("min_lat") > F.col("_max_lat")) | (F.col("max_lat") < F.col("_min_lat"))
             | (F.col("min_lon") > F.col("_max_lon")) | (F.col("max_lon") < F.col("_min_lon")))
    return _finding(regions.join(boxes, "country_id").filter(apart), "error", "region_outside_country", F.col("id"),
                    F.lit("lies outside its country"))


def capital_findings(countries: DataFrame, cities: DataFrame) -> DataFrame:
    counts = capitals_per_country(countries, cities)
    none = _finding(counts.filter("capitals = 0"), "warning", "no_capital", F.col("country_id"), F.lit("has no capital"))
    many = _finding(counts.filter("capitals > 1"), "warning", "many_capitals", F.col("country_id"),
                    F.format_string("has %d capitals: %s", F.col("capitals"), F.col("names")))
    lost = _finding(cities.filter(F.col("capital") & F.col("country_id").isNull()), "warning", "unassigned_capital",
                    F.col("id"), F.lit("belongs to no country"))
    return reduce(DataFrame.unionByName, [none, many, lost])


def cities_outside_country(countries: DataFrame, country_index: ShapeIndex, cities: DataFrame) -> DataFrame:
    """Cities whose assigned country does not cover them; ranks of the index are country ids."""
    assigned = cities.join(countries.select(F.col("id").alias("country_id")), "country_id", "left_semi")
    held = all_hits(assigned, country_index, ["id"]).select("id", F.col("rank").alias("country_id"))
    return _finding(assigned.join(held, ["id", "country_id"], "left_anti"), "warning", "city_outside_country",
                    F.col("id"), F.format_string("%s lies outside its country", F.col("name")))


def invalid_geometry(features: DataFrame, cell_degrees: float = 0.25) -> DataFrame:
    """Features (id, rings) with open, short or empty rings, or with crossing segments."""
    ring_ok = F.forall("rings", lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)))
    area = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda acc, v: acc + v)
    state = features.select("id", F.size("rings").alias("n"), ring_ok.alias("closed"), area.alias("area"))
    reason = (F.when(F.coalesce(F.col("n"), F.lit(0)) <= 0, "empty").when(~F.col("closed"), "open ring")
              .when(F.col("area") == 0.0, "zero area"))
    simple = _finding(state.withColumn("r", reason).filter("r IS NOT NULL"), "error", "invalid_geometry", F.col("id"), F.col("r"))

    def segments(part: DataFrame) -> DataFrame:
        return (part.select(F.col("id").alias("rank"), F.lit(None).cast("double").alias("radius"), "rings")
                .transform(ring_segments).filter("x1 <> x2 OR y1 <> y2"))

    # the few segments of a small feature meet in one place; only those of larger ones are listed cell by cell
    small = F.coalesce(F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)) <= SMALL_FEATURE, F.lit(False))
    segment = F.struct("x1", "y1", "x2", "y2").alias("s")
    celled = segments(features.filter(small)).select("rank", F.lit(0).alias("cx"), F.lit(0).alias("cy"), segment).unionByName(
        _touched_cells(segments(features.filter(~small)), cell_degrees, F.lit(1e-9)).select("rank", "cx", "cy", segment))
    a, b = celled.withColumnRenamed("s", "a"), celled.withColumnRenamed("s", "b")
    pairs = a.join(b, ["rank", "cx", "cy"]).filter(F.col("a") < F.col("b"))

    def turn(s: str, x: str, y: str) -> Column:
        return F.signum((F.col(f"{s}.x2") - F.col(f"{s}.x1")) * (F.col(y) - F.col(f"{s}.y1"))
                        - (F.col(f"{s}.y2") - F.col(f"{s}.y1")) * (F.col(x) - F.col(f"{s}.x1")))

    crossing = ((turn("a", "b.x1", "b.y1") * turn("a", "b.x2", "b.y2") < 0)
                & (turn("b", "a.x1", "a.y1") * turn("b", "a.x2", "a.y2") < 0))
    crossed = pairs.filter(crossing).groupBy("rank").agg(F.count("*").alias("n"))
    return simple.unionByName(_finding(crossed, "error", "invalid_geometry", F.col("rank"), F.lit("self-intersection")))


def validate(countries: DataFrame, regions: DataFrame, cities: DataFrame, country_index: ShapeIndex,
             shapes: DataFrame) -> DataFrame:
    """All checks as one frame."""
    empty = countries.agg(F.count("*").alias("n")).filter("n = 0")
    return reduce(DataFrame.unionByName, [
        _finding(empty, "warning", "no_countries", F.lit("countries"), F.lit("lookups will find nothing")),
        cities_outside_coverage(countries, cities), duplicate_iso(countries), duplicate_names(countries),
        overlapping_countries(shapes), orphan_regions(countries, regions),
        misplaced_regions(countries, regions), capital_findings(countries, cities),
        cities_outside_country(countries, country_index, cities)])


def verdict(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings and whether the data passes; strict mode counts warnings too."""
    counts = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"),
                          F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.withColumn("passed", (F.col("errors") == 0) & (F.lit(not strict) | (F.col("warnings") == 0)))
