"""Nearest-place lookups."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.functions.coords import valid_point
from cartolith.functions.geodesy import MEAN_RADIUS, flat_squared_degrees, vincenty_m
from cartolith.operators.near_pairs import finite, near_pairs, on_sphere
from cartolith.session import materialise, spread

BASE_DEGREES = 45.0
LEAF_PLACES = 64
SPLIT_LEVELS = 2
MAX_LEVEL = 22
CROWDED_LISTED = 100_000
_CELL = ["level", "cx", "cy"]


@dataclass(frozen=True)
class NearestIndex:
    """Cells of varying size, each listing every place that is nearest to some point in it."""

    leaves: DataFrame
    levels: tuple[int, ...]


def _wrapped_gap(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def _cell_box() -> dict[str, Column]:
    """Edges of the row's cell and the range of the longitude shrink factor inside it."""
    size = F.lit(BASE_DEGREES) / F.pow(F.lit(2.0), F.col("level"))
    south, west = F.col("cy") * size - 90.0, F.col("cx") * size - 180.0
    north, east = south + size, west + size
    cos_s, cos_n = F.cos(F.radians(south)), F.cos(F.radians(north))
    high = F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(cos_s, cos_n))
    return {"_s": south, "_n": north, "_w": west, "_e": east, "_lo": F.greatest(F.least(cos_s, cos_n), F.lit(0.0)), "_hi": high}


def _distance_range() -> tuple[Column, Column]:
    """Squared flat distance between a place and its cell: least and greatest possible."""
    half, mid = (F.col("_e") - F.col("_w")) / 2.0, (F.col("_e") + F.col("_w")) / 2.0
    lat_lo = F.greatest(F.lit(0.0), F.col("_s") - F.col("p_lat"), F.col("p_lat") - F.col("_n"))
    lat_hi = F.greatest(F.abs(F.col("p_lat") - F.col("_s")), F.abs(F.col("p_lat") - F.col("_n")))
    gap = _wrapped_gap(F.col("p_lon"), mid)
    lon_lo = F.greatest(F.lit(0.0), gap - half) * F.col("_lo")
    lon_hi = F.least(F.lit(180.0), gap + half) * F.col("_hi")
    return lat_lo * lat_lo + lon_lo * lon_lo, lat_hi * lat_hi + lon_hi * lon_hi


def _beside(lon: Column) -> Column:
    """Longitude moved to within half a turn of the middle of the cell."""
    mid = (F.col("_e") + F.col("_w")) / 2.0
    return mid + F.pmod(lon - mid + 180.0, F.lit(360.0)) - 180.0


def _this_way_round(x: Column) -> Column:
    """Is the longitude nearer this way around the globe everywhere in the cell?"""
    half, mid = (F.col("_e") - F.col("_w")) / 2.0, (F.col("_e") + F.col("_w")) / 2.0
    return F.abs(x - mid) + half <= 180.0


def _beaten_by(rival: str) -> Column:
    """Is the rival nearer than the row's place (_x, p_lat) everywhere in the cell?

    The difference of two squared distances is linear in latitude and, but for the shrink
    factor, in longitude, so its least value is found at the edges. Places that could be nearer
    the other way around the globe are left undecided; such rivals have no longitude here.
    """
    yp, yq, xp, xq = F.col("p_lat"), F.col(f"{rival}_lat"), F.col("_x"), F.col(f"{rival}_x")
    in_lat = F.least(*[(yp - yq) * (yp + yq - F.col(edge) * 2.0) for edge in ("_s", "_n")])
    in_lon = F.least(*[(xp - xq) * (xp + xq - F.col(edge) * 2.0) for edge in ("_w", "_e")])
    shrink = F.when(in_lon >= 0, F.col("_lo")).otherwise(F.col("_hi"))
    return F.coalesce(in_lat + in_lon * shrink * shrink > F.col("_high") * 1e-12 + 1e-15, F.lit(False))


def _limits(candidates: DataFrame) -> DataFrame:
    """Per cell: a distance within which every point of it finds a place, and five places that may beat others.

    The rivals are the places nearest to the corners and the middle of the cell, so only places
    whose own region reaches into the cell stay, also when a far crowd lies in one direction.
    """
    boxed = candidates.select("*", *[c.alias(n) for n, c in _cell_box().items()])
    middle = ((F.col("_s") + F.col("_n")) / 2.0, (F.col("_w") + F.col("_e")) / 2.0)
    spots = [middle, *[(F.col(a), F.col(b)) for a in ("_s", "_n") for b in ("_w", "_e")]]
    # plain numbers keep the aggregation hash-based; both halves of a rival come from the same row
    best = []
    for i, (y, x) in enumerate(spots):
        d = flat_squared_degrees(y, x, F.col("p_lat"), F.col("p_lon"))
        best += [F.min_by("p_lat", d).alias(f"_q{i}_lat"), F.min_by("p_lon", d).alias(f"_q{i}_lon")]
    found = boxed.groupBy(*_CELL).agg(F.min(_distance_range()[1]).alias("_limit"), *best)
    # the edges travel along, or every test of a place would spell them out again
    edged = found.select("*", *[c.alias(n) for n, c in _cell_box().items()])
    rivals = [f"_q{i}" for i in range(len(spots))]
    return edged.select(*_CELL, "_limit", "_s", "_n", "_w", "_e", "_lo", "_hi", *[f"{q}_lat" for q in rivals],
                        *[F.when(_this_way_round(x), x).alias(f"{q}_x") for q in rivals for x in [_beside(F.col(f"{q}_lon"))]])


def _narrowed(rows: DataFrame, level: int) -> DataFrame:
    """Candidates of the cells of a level, from those of the cells above (of the whole globe for the first).

    A place that some other place beats everywhere in a cell is dropped there. Only positions are
    aggregated, and the limits of all parts of a cell travel in one row, so places are multiplied
    inside a task and only those that stay leave it.
    """
    cut = 2 ** SPLIT_LEVELS

    def part(cx: Column, cy: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), cx.cast("int").alias("cx"), cy.cast("int").alias("cy"))

    if level == 0:
        parts = [part(F.lit(x), F.lit(y)) for x in range(int(360 / BASE_DEGREES)) for y in range(int(180 / BASE_DEGREES))]
    else:
        parts = [part(F.col("cx") * cut + i, F.col("cy") * cut + j) for i in range(cut) for j in range(cut)]
    limits = _limits(rows.select(F.explode(F.array(*parts)).alias("_c"), "p_lat", "p_lon").select("_c.*", "p_lat", "p_lon"))
    cells = F.collect_list(F.struct(*limits.columns)).alias("_cells")
    if level == 0:
        met = rows.crossJoin(F.broadcast(limits.agg(cells)))
    else:
        above = [F.lit(level - SPLIT_LEVELS).alias("level"), *[F.shiftright(c, SPLIT_LEVELS).alias(c) for c in ("cx", "cy")]]
        met = rows.join(limits.groupBy(*above).agg(cells), _CELL)
    places = ["p_lat", "p_lon", "rank", "value"]
    spread_out = met.select(*places, F.explode("_cells").alias("_c")).select(*places, "_c.*")
    low, high = _distance_range()
    near = spread_out.filter(low <= F.col("_limit") * (1.0 + 1e-9) + 1e-12)
    # a list of one keeps the numbers from being spelled out, and worked out, in each of the tests
    worked = near.select("*", F.explode(F.array(F.struct(_beside(F.col("p_lon")).alias("_x"), high.alias("_high")))).alias("_v")).select("*", "_v.*")
    beaten = reduce(lambda a, b: a | b, [_beaten_by(f"_q{i}") for i in range(5)])
    kept = worked.filter(~(_this_way_round(F.col("_x")) & beaten))
    return kept.select(*_CELL, *places)


def build_nearest_index(places: DataFrame, rank: Column, value: list, lat: str = "lat",
                        lon: str = "lon", leaf_places: int = LEAF_PLACES) -> NearestIndex:
    """Index places for :func:`nearest`. Equal distances go to the lowest ``rank``.

    Cells with too many candidates are split, round by round, until each list is short. Places that share a position collapse to the best-ranked one first, so crowding
    cannot survive splitting.
    """
    named = places.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon"), rank.alias("rank"),
                          F.struct(*value).alias("value"))
    unique = named.groupBy("p_lat", "p_lon").agg(F.min(F.struct("rank", "value")).alias("b")) \
                  .select("p_lat", "p_lon", "b.rank", "b.value")
    rows, done, levels = spread(unique), [], []
    for level in range(0, MAX_LEVEL + 1, SPLIT_LEVELS):
        kept = materialise(_narrowed(rows, level), "candidates")
        crowded = kept.groupBy(*_CELL).count().filter(F.col("count") > leaf_places).select(*_CELL)
        many = 0 if level + SPLIT_LEVELS > MAX_LEVEL else crowded.count()
        # a cell is a few bytes, so that the places need not be shuffled for so few of them
        crowded = F.broadcast(crowded) if many <= CROWDED_LISTED else crowded
        done.append(kept.join(crowded, _CELL, "left_anti") if many else kept)
        levels.append(level)
        if not many:
            break
        rows = kept.join(crowded, _CELL, "left_semi")
    packed = reduce(DataFrame.unionByName, done).groupBy(*_CELL).agg(
        F.collect_list(F.struct("p_lat", "p_lon", "rank", "value")).alias("places"))
    return NearestIndex(materialise(packed, "leaves"), tuple(levels))


def nearest(points: DataFrame, index: NearestIndex, out: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``out``: the value of the nearest place (NULL for invalid points).

    Each point meets one leaf, so the result needs no grouping and keeps every row.
    """
    y, x = F.col(lat), F.col(lon)
    ok = valid_point(y, x)

    def cell_key(level: int) -> Column:
        size = BASE_DEGREES / 2 ** level
        cx = F.least(F.floor((x + 180.0) / size), F.lit(int(360 / size) - 1)).cast("int")
        cy = F.least(F.floor((y + 90.0) / size), F.lit(int(180 / size) - 1)).cast("int")
        return F.struct(F.lit(level).alias("level"), cx.alias("cx"), cy.alias("cy"))

    nowhere = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy")))
    keys = F.when(ok, F.array(*[cell_key(level) for level in index.levels])).otherwise(nowhere)
    probed = points.withColumn("_k", F.explode(keys)).select(*points.columns, "_k.*")
    spark = points.sparkSession
    holder = spark.range(1).select(F.lit(-1).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    leaves = index.leaves.unionByName(holder, allowMissingColumns=True)
    best = F.array_min(F.transform("places", lambda p: F.struct(
        flat_squared_degrees(y, x, p["p_lat"], p["p_lon"]).alias("d2"), p["rank"].alias("rank"),
        p["value"].alias("value"))))
    return probed.join(leaves, _CELL).select(*points.columns, best["value"].alias(out))


# The sphere and the ellipsoid differ by less than 0.6 %, in either direction.
_ELLIPSOID_SLACK = 1.0125
_LEAST_BLOCK_OF_SPHERE = 0.125


def places_within(points: DataFrame, places: DataFrame, key: list[str], radius_km: float, limit: int,
                  rank: Column, value: list, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The ``limit`` closest places within a geodesic radius of each point.

    A search on the sphere picks the few that may be among them, of those that pass a flat test with a 20 % margin; only
    they pay for the ellipsoid. Returns key columns, ``value`` fields, ``meters`` and ``position`` (1 = closest).
    """
    named = places.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon"), rank.alias("_rank"), *value)
    fields = [c for c in named.columns if c not in ("p_lat", "p_lon", "_rank")]
    # of places at one position only the best can be among the closest
    crowd = Window.partitionBy("p_lat", "p_lon").orderBy("_rank")
    named = (named.filter(finite("p_lat", "p_lon")).withColumn("_n", F.row_number().over(crowd)).filter(F.col("_n") <= limit).drop("_n"))
    asked = points.filter(valid_point(F.col(lat), F.col(lon))).select(*key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    cutoff = radius_km / 111.32 * 1.2

    def flat(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        y, x = a["_lat"].to_numpy()[i], a["_lon"].to_numpy()[i]
        east = (b["p_lon"].to_numpy()[j] - x + 180.0) % 360.0 - 180.0
        return (b["p_lat"].to_numpy()[j] - y) ** 2 + (east * np.cos(np.radians(y))) ** 2 <= cutoff * cutoff

    angle = min(radius_km * 1000.0 * _ELLIPSOID_SLACK / MEAN_RADIUS, math.pi)
    near = near_pairs(asked, named, on_sphere(F.col("_lat"), F.col("_lon")), on_sphere(F.col("p_lat"), F.col("p_lon")), 2.0 * math.sin(angle / 2.0),
                      limit, _ELLIPSOID_SLACK, _LEAST_BLOCK_OF_SPHERE, allowed=flat)
    measured = near.withColumn("meters", vincenty_m(F.col("_lat"), F.col("_lon"), F.col("p_lat"), F.col("p_lon")))
    order = Window.partitionBy(*key).orderBy("meters", "_rank")
    return (measured.filter(F.col("meters") <= radius_km * 1000.0)
            .withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
            .select(*key, *fields, "meters", "position"))


def _in_plain_degrees(places: DataFrame, order: Column, value: list, out: str, lat: str, lon: str) -> DataFrame:
    """Positions of places, each with the highest ``order`` (negative, as ``_o``) and the value of that place."""
    named = places.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon"), (-order).alias("_o"), F.struct(*value).alias(out))
    return (named.filter(finite("p_lat", "p_lon")).groupBy("p_lat", "p_lon").agg(F.min(F.struct("_o", out)).alias("b"))
            .select("p_lat", "p_lon", "b._o", f"b.{out}"))


def _squared_gap(y: Column, x: Column, p_lat: Column, p_lon: Column) -> Column:
    d_lat, d_lon = p_lat - y, p_lon - x
    return d_lat * d_lat + d_lon * d_lon


def nearest_within_degrees(points: DataFrame, places: DataFrame, key: list[str], max_degrees: float,
                           order: Column, value: list, out: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``out``: the place closest in plain degrees, at most ``max_degrees`` away, else NULL.

    Equal distances go to the highest ``order``.
    """
    asked = points.filter(valid_point(F.col(lat), F.col(lon))).select(*key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    d2 = _squared_gap(F.col("_lat"), F.col("_lon"), F.col("p_lat"), F.col("p_lon"))
    best = (near_pairs(asked, _in_plain_degrees(places, order, value, out, lat, lon), [F.col("_lat"), F.col("_lon")], [F.col("p_lat"), F.col("p_lon")], max_degrees, 1)
            .filter(d2 <= max_degrees * max_degrees)
            .groupBy(*key).agg(F.min(F.struct(d2.alias("d2"), F.col("_o").alias("o"), out)).alias("b")))
    return points.join(best.select(*key, F.col(f"b.{out}").alias(out)), key, "left")


def list_nearest(boxes: DataFrame, places: DataFrame, key: list[str], max_degrees: float, order: Column, value: list, out: str,
                 lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Lists ``out`` for :func:`nearest_listed`: the places that are the closest, within ``max_degrees``, to some spot of a box.

    ``boxes`` carries min_lat..max_lon, one or more rows per key. Keys without such places are left out.
    """
    half = [(F.col(f"max_{c}") - F.col(f"min_{c}")) / 2.0 for c in ("lat", "lon")]
    asked = boxes.select(*key, "min_lat", "min_lon", "max_lat", "max_lon", F.hypot(*half).alias("_half"))
    middle = [F.col(f"min_{c}") + h for c, h in zip(("lat", "lon"), half)]
    widest = asked.agg(F.max("_half")).first()[0] or 0.0  # a number
    # what is closest to some spot is not farther from the middle than the middle's own place by more than the box is wide
    near = near_pairs(asked, _in_plain_degrees(places, order, value, "_value", lat, lon), middle, [F.col("p_lat"), F.col("p_lon")], max_degrees + widest, 1,
                      extra=F.col("_half") * (2.0 + 1e-9) + 1e-9)
    off = [F.greatest(F.col(f"min_{c}") - F.col(f"p_{c}"), F.col(f"p_{c}") - F.col(f"max_{c}"), F.lit(0.0)) for c in ("lat", "lon")]
    within = near.filter(F.hypot(*off) <= max_degrees * (1.0 + 1e-9))
    return within.groupBy(*key).agg(F.collect_list(F.struct("p_lat", "p_lon", F.col("_o").alias("o"), F.col("_value").alias("value"))).alias(out))


def nearest_listed(listed: str, max_degrees: float, lat: str = "lat", lon: str = "lon") -> Column:
    """Value of the place of a list that :func:`nearest_within_degrees` would give for the row, else NULL."""
    def away(p) -> Column:
        return F.struct(_squared_gap(F.col(lat), F.col(lon), p["p_lat"], p["p_lon"]).alias("d2"), p["o"].alias("o"), p["value"].alias("value"))

    within = F.filter(F.transform(listed, away), lambda v: v["d2"] <= max_degrees * max_degrees)
    return F.when(valid_point(F.col(lat), F.col(lon)), F.array_min(within)["value"])
