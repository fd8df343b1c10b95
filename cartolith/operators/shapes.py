"""Point-in-shape joins.

Every shape is turned into grid cells, so that a lookup is one equi-join on a cell and points are
neither grouped nor shuffled when the cell table is small. A cell that lies wholly inside its
best-ranked shape answers by itself. A cell that borders cross lists its candidates with the few
segments that matter inside it, and each point is tested against those. Cells where such a list
would grow beyond a limit are not listed at all: their points go through a join on single
segments instead, so no row ever holds an unbounded list.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.functions.coords import valid_point
from cartolith.session import materialise

BANDS_PER_CELL = 8
MAX_LISTED = 1024
FAR_EAST = 1e6
_GROW = 1e-9


@dataclass(frozen=True)
class ShapeSet:
    """Areas and lines that compete for a point.

    ``shapes`` has ``rank`` (unique, orderable; the lowest wins), ``value`` (struct handed
    back), ``rings`` (closed rings for areas, open paths for lines) and ``radius`` (degrees
    around a line, NULL for areas).
    """

    shapes: DataFrame
    cell_degrees: float = 1.0


def area_set(polygons: DataFrame, rank: Column, value: list, cell_degrees: float = 1.0) -> ShapeSet:
    """Areas from a frame with a ``rings`` column."""
    return ShapeSet(polygons.select(rank.alias("rank"), F.struct(*value).alias("value"), "rings",
                                    F.lit(None).cast("double").alias("radius")), cell_degrees)


def line_center_lat(paths: Column) -> Column:
    """Latitude of the length-weighted centre of a set of paths; that of the first point if they have no length."""
    def steps(points: Column) -> Column:
        n = F.greatest(F.size(points) - 1, F.lit(0))
        return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.struct(
            F.hypot(b["lon"] - a["lon"], b["lat"] - a["lat"]).alias("length"), ((a["lat"] + b["lat"]) / 2.0).alias("lat")))

    center = F.aggregate(F.flatten(F.transform(paths, steps)), F.struct(F.lit(0.0).alias("length"), F.lit(0.0).alias("moment")),
                         lambda t, s: F.struct((t["length"] + s["length"]).alias("length"), (t["moment"] + s["length"] * s["lat"]).alias("moment")),
                         lambda t: F.when(t["length"] > 0, t["moment"] / t["length"]))
    return F.coalesce(center, F.get(F.transform(F.flatten(paths), lambda p: p["lat"]), F.lit(0)))


def cut_at_antimeridian(paths: Column) -> Column:
    """Paths cut where a step of over 180 degrees of longitude says that they cross 180; both pieces get the crossing."""
    def crossing(path: Column, i: Column, after: bool) -> Column:
        a, b = F.get(path, i - 1), F.get(path, i)
        side = F.when(b["lon"] < a["lon"], 180.0).otherwise(-180.0)
        way = b["lon"] + 2 * side - a["lon"]
        lat = F.when(way == 0, a["lat"]).otherwise(a["lat"] + (side - a["lon"]) / F.when(way != 0, way) * (b["lat"] - a["lat"]))
        return F.array(F.struct((-side if after else side).alias("lon"), lat.alias("lat")))

    def cut(path: Column) -> Column:
        n = F.size(path)
        none = F.slice(path, 1, 0)
        jumps = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.abs(F.get(path, i)["lon"] - F.get(path, i - 1)["lon"]) > 180.0, F.lit(False)))
        # bound once, or every piece would look for the jumps again
        return F.flatten(F.transform(F.array(jumps), lambda j: F.zip_with(F.concat(F.array(F.lit(0)), j), F.concat(j, F.array(n)), lambda s, e: F.concat(
            F.when(s > 0, crossing(path, s, True)).otherwise(none), F.slice(path, s + 1, e - s), F.when(e < n, crossing(path, e, False)).otherwise(none)))))

    return F.flatten(F.transform(paths, cut))


def ring_segments(shapes: DataFrame) -> DataFrame:
    """One row per segment of every ring or path: rank, radius, ring, seq, x1, y1, x2, y2."""
    rings = shapes.select("rank", "radius", F.posexplode("rings").alias("ring", "points")).filter(F.size("points") >= 2)
    steps = rings.select("rank", "radius", "ring", F.posexplode(F.arrays_zip(
        F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b")
    )).alias("seq", "s"))
    return steps.select("rank", "radius", "ring", "seq", F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"),
                        F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2"))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def _touched_cells(segments: DataFrame, size: float, margin: Column) -> DataFrame:
    """Cells met by each segment grown by a margin, column by column so that a long diagonal
    does not mark its whole bounding box."""
    x_lo, x_hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    wide = segments.withColumn("_m", margin).withColumn(
        "cx", F.explode(F.sequence(_cell(x_lo - F.col("_m"), size), _cell(x_hi + F.col("_m"), size))))
    slope = F.when(F.abs(F.col("x2") - F.col("x1")) > 1e-12,
                   (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))

    def y_at(x: Column) -> Column:
        inside = F.least(F.greatest(x, x_lo), x_hi)
        return F.col("y1") + (inside - F.col("x1")) * slope

    left = y_at(F.col("cx") * F.lit(size) - F.col("_m"))
    right = y_at((F.col("cx") + 1) * F.lit(size) + F.col("_m"))
    lo = F.when(slope.isNull(), F.least("y1", "y2")).otherwise(F.least(left, right))
    hi = F.when(slope.isNull(), F.greatest("y1", "y2")).otherwise(F.greatest(left, right))
    return wide.withColumn("cy", F.explode(F.sequence(_cell(lo - F.col("_m"), size), _cell(hi + F.col("_m"), size))))


def _interior_cells(segments: DataFrame, size: float) -> DataFrame:
    """Cells whose centre lies inside an area: fill between the crossings of each centre row."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.ceil(low / size - 0.5).cast("int")
    last = F.ceil(high / size - 0.5).cast("int") - 1
    rows = (segments.filter(first <= last)
            .withColumn("cy", F.explode(F.sequence(first, last))))
    center = (F.col("cy") + 0.5) * size
    crossing = rows.select("rank", "cy", (F.col("x1") + (center - F.col("y1")) * (F.col("x2") - F.col("x1"))
                                          / (F.col("y2") - F.col("y1"))).alias("x"))
    along = Window.partitionBy("rank", "cy").orderBy("x")
    spans = (crossing.withColumn("n", F.row_number().over(along)).withColumn("until", F.lead("x").over(along))
             .filter((F.col("n") % 2 == 1) & F.col("until").isNotNull())
             .withColumn("c0", F.ceil(F.col("x") / size - 0.5).cast("int"))
             .withColumn("c1", F.ceil(F.col("until") / size - 0.5).cast("int") - 1)
             .filter("c0 <= c1"))
    return spans.select("rank", F.explode(F.sequence("c0", "c1")).alias("cx"), "cy")


@dataclass(frozen=True)
class ShapeIndex:
    """Lookup tables of a shape set, written once and used by many lookups.

    ``cells``: per cell the settled ``value``, or the ``listed`` candidates with their segments,
    or neither with ``long`` set where lists would be too long.
    ``covered``: shapes per cell with a flag for cells wholly inside.
    ``segments``: border segments by shape and latitude band, for the exact test by join.
    """

    cells: DataFrame
    covered: DataFrame
    segments: DataFrame
    values: DataFrame
    cell_degrees: float
    has_long: bool


def cover(shape_set: ShapeSet, cells: DataFrame | None = None) -> DataFrame:
    """Cells of every shape: rank, cx, cy and full (wholly inside); of ``cells`` (cx, cy) alone, where given."""
    size = shape_set.cell_degrees
    segments = ring_segments(shape_set.shapes)
    rim = (_touched_cells(segments, size, F.coalesce("radius", F.lit(0.0)) + _GROW)
           .select("rank", "cx", "cy", F.lit(True).alias("rim")))
    inside = (_interior_cells(segments.filter(F.col("radius").isNull()), size)
              .select("rank", "cx", "cy", F.lit(False).alias("rim")))
    met = rim.unionByName(inside)
    if cells is not None:
        met = met.join(cells, ["cx", "cy"], "left_semi")
    marked = met.groupBy("rank", "cx", "cy").agg(F.max("rim").alias("rim"))
    return marked.select("rank", "cx", "cy", (~F.col("rim")).alias("full"))


def _local_segments(pairs: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """Segments that decide whether a point of a border cell lies in an area.

    The test casts a ray to the east, so segments west of the cell do not matter. A run of
    consecutive segments east of the cell is crossed an odd number of times exactly when its two
    ends lie on different sides of the ray, so one far-away segment between its ends stands for
    the run.
    """
    rows = segments.withColumn("cy", F.explode(F.sequence(_cell(F.least("y1", "y2"), size), _cell(F.greatest("y1", "y2"), size))))
    met = pairs.join(rows, ["rank", "cy"]).filter(F.greatest("x1", "x2") >= F.col("cx") * F.lit(size))
    is_east = F.least("x1", "x2") > (F.col("cx") + 1) * F.lit(size)
    near = met.filter(~is_east).select("cx", "cy", "rank", "x1", "y1", "x2", "y2")
    along = Window.partitionBy("rank", "cx", "cy", "ring").orderBy("seq")
    runs = (met.filter(is_east).withColumn("run", F.col("seq") - F.row_number().over(along))
            .groupBy("cx", "cy", "rank", "ring", "run").agg(F.min_by("y1", "seq").alias("y1"), F.max_by("y2", "seq").alias("y2")))
    far = runs.filter("y1 <> y2").select("cx", "cy", "rank", F.lit(FAR_EAST).alias("x1"), "y1", F.lit(FAR_EAST).alias("x2"), "y2")
    return near.unionByName(far)


def build_shape_index(shape_set: ShapeSet, max_listed: int = MAX_LISTED, points: DataFrame | None = None) -> ShapeIndex:
    """Work out the cells of a shape set and write them to the shared folder.

    With ``points`` (lat, lon) only cells that hold some of them are worked out: the index then answers these points alone.
    """
    size = shape_set.cell_degrees
    band = size / BANDS_PER_CELL
    wanted = None
    if points is not None:
        valid = points.filter(valid_point(F.col("lat"), F.col("lon")))
        wanted = materialise(valid.select(_cell(F.col("lon"), size).alias("cx"), _cell(F.col("lat"), size).alias("cy")).distinct(), "wanted")
    covered = materialise(cover(shape_set, wanted), "cover")
    values = shape_set.shapes.select("rank", "value")
    state = covered.groupBy("cx", "cy").agg(
        F.min("rank").alias("_any"), F.min(F.when(F.col("full"), F.col("rank"))).alias("_full"))
    settled = state.filter(F.col("_any") == F.col("_full")).select("cx", "cy", F.col("_any").alias("rank"))
    contested = state.filter(F.col("_full").isNull() | (F.col("_any") != F.col("_full"))).select("cx", "cy", "_full")

    # a shape that fills the cell beats all that rank after it, so lists end with it
    pairs = covered.join(contested, ["cx", "cy"]).filter(F.col("_full").isNull() | (F.col("rank") <= F.col("_full"))).drop("_full")
    segments = ring_segments(shape_set.shapes)
    areas = _local_segments(pairs.filter(~F.col("full")).select("rank", "cx", "cy"), segments.filter(F.col("radius").isNull()), size)
    lines = _touched_cells(segments.filter(F.col("radius").isNotNull()), size, F.col("radius") + _GROW).join(
        pairs.select("rank", "cx", "cy"), ["rank", "cx", "cy"], "left_semi")
    tests = areas.withColumn("radius", F.lit(None).cast("double")).unionByName(
        lines.select("cx", "cy", "rank", "x1", "y1", "x2", "y2", "radius"))
    tests = materialise(tests, "tests")
    counts = (tests.select("cx", "cy").unionByName(pairs.select("cx", "cy")).groupBy("cx", "cy").agg(F.count("*").alias("n")))
    long = counts.filter(F.col("n") > max_listed).select("cx", "cy")
    has_long = not long.isEmpty()
    short_tests = tests.join(long, ["cx", "cy"], "left_anti") if has_long else tests
    short_pairs = pairs.join(long, ["cx", "cy"], "left_anti") if has_long else pairs
    lists = short_tests.groupBy("cx", "cy", "rank").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "radius")).alias("segments"))
    listed = (short_pairs.join(lists, ["cx", "cy", "rank"], "left").filter(F.col("full") | F.col("segments").isNotNull())
              .join(values, "rank").groupBy("cx", "cy")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "full", "segments"))).alias("listed")))
    parts = [settled.join(values, "rank").select("cx", "cy", "value"), listed]
    if has_long:
        parts.append(long.withColumn("long", F.lit(True)))
    cells = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not has_long:
        cells = cells.withColumn("long", F.lit(None).cast("boolean"))
    reach = F.coalesce("radius", F.lit(0.0))
    reach = F.when(reach > 0.0, reach + _GROW).otherwise(0.0)
    banded = segments.withColumn("band", F.explode(F.sequence(
        _cell(F.least("y1", "y2") - reach, band), _cell(F.greatest("y1", "y2") + reach, band))))
    return ShapeIndex(materialise(cells, "cells"), covered, banded.drop("ring", "seq"), values, size, has_long)


def _tests(x: Column, y: Column, s) -> tuple[Column, Column]:
    """Does the eastward ray cross the segment; does the point lie on it or within its radius?"""
    dx, dy = s("x2") - s("x1"), s("y2") - s("y1")
    side = (x - s("x1")) * dy - (y - s("y1")) * dx
    area = s("radius").isNull()
    on_edge = (area & (side == 0.0) & x.between(F.least(s("x1"), s("x2")), F.greatest(s("x1"), s("x2")))
               & y.between(F.least(s("y1"), s("y2")), F.greatest(s("y1"), s("y2"))))
    straddles = (s("y1") <= y) != (s("y2") <= y)
    crosses = area & straddles & F.when(dy > 0, side < 0.0).otherwise(side > 0.0)
    near = segment_squared_distance(x, y, s) <= s("radius") * s("radius")
    return crosses, on_edge | F.coalesce(near, F.lit(False))


def locate(points: DataFrame, index: ShapeIndex, key: list[str], out: str,
           lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``out``: the value of the best-ranked shape covering each point, borders included.

    ``key`` must identify a point. Points outside every shape, and invalid ones, get NULL.
    """
    size = index.cell_degrees
    x, y = F.col(lon), F.col(lat)
    ok = valid_point(y, x)
    placed = points.withColumn("cx", F.when(ok, _cell(x, size))).withColumn("cy", F.when(ok, _cell(y, size)))
    looked = placed.join(index.cells.withColumnRenamed("value", "_value"), ["cx", "cy"], "left")

    def holds(c: Column) -> Column:
        crossing = F.size(F.filter(c["segments"], lambda s: _tests(x, y, lambda f: s[f])[0]))
        return c["full"] | (crossing % 2 == 1) | F.exists(c["segments"], lambda s: _tests(x, y, lambda f: s[f])[1])

    # candidates are sorted by rank, so the first that holds wins
    first = F.get(F.filter("listed", lambda c: F.coalesce(holds(c), F.lit(False))), F.lit(0))
    found = F.when(F.col("listed").isNull(), F.col("_value")).otherwise(first["value"])
    if not index.has_long:
        return looked.select(*points.columns, found.alias(out))

    by_join = F.coalesce("long", F.lit(False))
    easy = looked.filter(~by_join).select(*points.columns, found.alias(out))
    hard = looked.filter(by_join).select("cx", "cy", *points.columns)
    winners = (_exact_hits(hard, index, key, lat, lon).groupBy(*key).agg(F.min("rank").alias("rank"))
               .join(index.values, "rank").select(*key, F.col("value").alias(out)))
    return easy.unionByName(hard.join(winners, key, "left").select(*points.columns, out))


def _exact_hits(placed: DataFrame, index: ShapeIndex, key: list[str], lat: str, lon: str) -> DataFrame:
    """Every (point, rank) pair that holds exactly; points carry their cell in cx, cy."""
    probe = placed.select(*key, "cx", "cy", F.col(lat).alias("_y"), F.col(lon).alias("_x"))
    pairs = probe.join(index.covered, ["cx", "cy"]).select(
        *key, "_x", "_y", "rank", "full", F.when(~F.col("full"), F.col("rank")).alias("_test"),
        _cell(F.col("_y"), index.cell_degrees / BANDS_PER_CELL).alias("band"))
    tested = pairs.join(index.segments.withColumnRenamed("rank", "_test"), ["_test", "band"], "left")
    crosses, sure = _tests(F.col("_x"), F.col("_y"), F.col)
    verdict = tested.groupBy(*key, "rank").agg(
        F.sum(crosses.cast("int")).alias("n"), F.max(F.col("full") | sure).alias("sure"))
    return verdict.filter((F.col("n") % 2 == 1) | F.col("sure")).select(*key, "rank")


def segment_squared_distance(x: Column, y: Column, s) -> Column:
    """Squared planar distance of a point to the segment x1,y1-x2,y2 read through ``s``."""
    dx, dy = s("x2") - s("x1"), s("y2") - s("y1")
    length = dx * dx + dy * dy
    along = ((x - s("x1")) * dx + (y - s("y1")) * dy) / F.when(length > 0.0, length)
    t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    ex, ey = x - (s("x1") + dx * t), y - (s("y1") + dy * t)
    return ex * ex + ey * ey


def within_shapes(points: DataFrame, index: ShapeIndex, key: list[str], lat: str = "lat",
                  lon: str = "lon") -> DataFrame:
    """Semi-join: the points covered by any shape."""
    return locate(points, index, key, "_hit", lat, lon).filter(F.col("_hit").isNotNull()).drop("_hit")


def all_hits(points: DataFrame, index: ShapeIndex, key: list[str], lat: str = "lat",
             lon: str = "lon") -> DataFrame:
    """Every (point, shape) pair, as key columns plus rank."""
    placed = (points.filter(valid_point(F.col(lat), F.col(lon)))
              .withColumn("cx", _cell(F.col(lon), index.cell_degrees))
              .withColumn("cy", _cell(F.col(lat), index.cell_degrees)))
    return _exact_hits(placed, index, key, lat, lon)


def boxes_meeting(boxes: DataFrame, features: DataFrame, box_key: list[str], feature_key: list[str],
                  cell_degrees: float = 1.0) -> DataFrame:
    """Pairs of boxes whose envelopes intersect; both frames carry min_lat..max_lon.

    Both sides are listed under every cell they touch, and a pair is emitted only in the cell
    that holds the south-west corner of the overlap, so no pair appears twice.
    """
    def spread(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return (df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in ("min_lat", "min_lon", "max_lat", "max_lon")])
                .withColumn("cy", F.explode(F.sequence(_cell(F.col(f"{tag}_min_lat"), cell_degrees),
                                                       _cell(F.col(f"{tag}_max_lat"), cell_degrees))))
                .withColumn("cx", F.explode(F.sequence(_cell(F.col(f"{tag}_min_lon"), cell_degrees),
                                                       _cell(F.col(f"{tag}_max_lon"), cell_degrees)))))
    pairs = spread(boxes, box_key, "a").join(spread(features, feature_key, "b"), ["cx", "cy"])
    south, west = F.greatest("a_min_lat", "b_min_lat"), F.greatest("a_min_lon", "b_min_lon")
    meets = (south <= F.least("a_max_lat", "b_max_lat")) & (west <= F.least("a_max_lon", "b_max_lon"))
    owner = (F.col("cy") == _cell(south, cell_degrees)) & (F.col("cx") == _cell(west, cell_degrees))
    return pairs.filter(meets & owner).select(*box_key, *feature_key)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (lon, lat) points."""
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                         F.slice(ring, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    cross = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["a"]["lon"] * p["b"]["lat"]
                        - p["b"]["lon"] * p["a"]["lat"])
    return F.abs(cross) / 2.0


def box_ring(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """Closed ring of a box."""
    corners = [(min_lat, min_lon), (min_lat, max_lon), (max_lat, max_lon), (max_lat, min_lon), (min_lat, min_lon)]
    return F.array(*[F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")) for y, x in corners])


def rings_box(rings: Column) -> tuple[Column, Column, Column, Column]:
    """Bounding box of an array of rings."""
    lats = F.transform(F.flatten(rings), lambda p: p["lat"])
    lons = F.transform(F.flatten(rings), lambda p: p["lon"])
    return F.array_min(lats), F.array_min(lons), F.array_max(lats), F.array_max(lons)
