"""Elevation tiles and land-cover grids as block rows, and lookups over them.

Rasters are stored as blocks of a bounded number of samples rather than whole tiles: a row
stays small whatever the tile resolution, and a popular tile spreads over many join keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.functions.climate import landcover_from_code
from cartolith.functions.coords import clamp_latitude, tile_lat, tile_lon
from cartolith.params import LANDCOVER_CLASSES
from cartolith.session import materialise

BLOCK = 128
# Fixed values of the two lookups.
MIN_DATA_WEIGHT = 0.5
SAMPLES_PER_AXIS = 16
HUGE_GRID_CELLS = 4096
HUGE_CELL_DEGREES = 16
MAX_TURNS = 8

TILE = ["lat_deg", "lon_deg"]
BLOCK_KEY = [*TILE, "block_y", "block_x"]


def _cut(samples: Column, width: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Row-major rectangle of a row-major array."""
    return F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.slice(samples, y * width + x0 + 1, x1 - x0 + 1)))


def dem_blocks(tiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Split tile rows (lat_deg, lon_deg, width, height, samples) into blocks.

    Neighbouring blocks share one row and column of samples, so that interpolation never
    needs two of them.
    """
    x0, y0 = F.col("block_x") * block, F.col("block_y") * block
    x1 = F.least(x0 + block, F.col("width") - 1)
    y1 = F.least(y0 + block, F.col("height") - 1)
    last_x = F.floor((F.col("width") - 2) / block).cast("int")
    last_y = F.floor((F.col("height") - 2) / block).cast("int")
    return (tiles.withColumn("block_y", F.explode(F.sequence(F.lit(0), last_y)))
            .withColumn("block_x", F.explode(F.sequence(F.lit(0), last_x)))
            .select(*BLOCK_KEY, "width", "height", F.lit(block).alias("block"),
                    _cut(F.col("samples"), F.col("width"), x0, x1, y0, y1).alias("samples")))


def dem_catalog(blocks: DataFrame) -> DataFrame:
    """One row per tile with its dimensions, read off the first block of each."""
    return blocks.filter("block_y = 0 AND block_x = 0").select(*TILE, "width", "height", "block")


def _sample(x: Column, y: Column) -> Column:
    """Sample of the row's block at tile coordinates; NULL is no data."""
    bx, by = F.col("block_x") * F.col("block"), F.col("block_y") * F.col("block")
    row = F.least(F.col("block"), F.col("width") - 1 - bx) + 1
    return F.get("samples", ((y - by) * row + (x - bx)).cast("int")).cast("double")


def _grid_position(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Fractional sample coordinates inside the row's tile, clamped to it."""
    gx = (lon - F.col("lon_deg")) / (F.lit(1.0) / (F.col("width") - 1))
    gy = (F.col("lat_deg") + 1.0 - lat) / (F.lit(1.0) / (F.col("height") - 1))
    return (F.least(F.greatest(gx, F.lit(0.0)), (F.col("width") - 1).cast("double")),
            F.least(F.greatest(gy, F.lit(0.0)), (F.col("height") - 1).cast("double")))


def _interpolated(gx: Column, gy: Column) -> Column:
    """Bilinear value; corners without data are left out, and half the weight must remain."""
    x0, y0 = F.floor(gx).cast("int"), F.floor(gy).cast("int")
    x1, y1 = F.least(x0 + 1, F.col("width") - 1), F.least(y0 + 1, F.col("height") - 1)
    fx, fy = gx - x0, gy - y0
    total, weight = F.lit(0.0), F.lit(0.0)
    for x, y, w in ((x0, y0, (1 - fx) * (1 - fy)), (x1, y0, fx * (1 - fy)),
                    (x0, y1, (1 - fx) * fy), (x1, y1, fx * fy)):
        value = _sample(x, y)
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNull(), 0.0).otherwise(w)
    return F.when(weight >= MIN_DATA_WEIGHT, total / weight)


def _block_of(position: Column, dimension: str) -> Column:
    return F.floor(F.least(F.floor(position), F.col(dimension) - 2) / F.col("block")).cast("int")


def elevation_at(points: DataFrame, blocks: DataFrame, out: str = "elevation_m", lat: str = "lat",
                 lon: str = "lon") -> DataFrame:
    """Add the bilinear elevation of each point, NULL where there is no data."""
    keep = points.columns
    y, x = F.col(lat), F.col(lon)
    placed = points.withColumn("lat_deg", tile_lat(y)).withColumn("lon_deg", tile_lon(x))
    sized = placed.join(dem_catalog(blocks), TILE, "left")
    gx, gy = _grid_position(y, x)
    aimed = (sized.withColumn("_gx", gx).withColumn("_gy", gy)
             .withColumn("block_x", _block_of(F.col("_gx"), "width"))
             .withColumn("block_y", _block_of(F.col("_gy"), "height")))
    met = aimed.join(blocks.select(*BLOCK_KEY, "samples"), BLOCK_KEY, "left")
    return met.select(*keep, F.when(F.col("samples").isNotNull(),
                                    _interpolated(F.col("_gx"), F.col("_gy"))).alias(out))


def footprint_mean(points: DataFrame, blocks: DataFrame, key: list[str], out: str = "elevation_m",
                   lat: str = "lat", lon: str = "lon", lat_span: str = "lat_span",
                   lon_span: str = "lon_span") -> DataFrame:
    """Add the mean of the samples inside a box around each point.

    A tile owns its north and west edges only, so shared edges count once; at most about
    sixteen samples per axis and tile are taken. Sums and counts of all tiles meet before the
    division. A box without samples falls back to the bilinear value. ``key`` must identify a point.
    """
    y, x = F.col(lat), F.col(lon)
    has_box = F.coalesce((F.col(lat_span) > 0) & (F.col(lon_span) > 0) & ~F.isnan(y) & ~F.isnan(x), F.lit(False))
    rest = [c for c in points.columns if c not in key]
    boxed = (points.select(*key, F.struct(*rest).alias("_rest"), y.alias("_lat"), x.alias("_lon"), has_box.alias("_box"),
                           clamp_latitude(y - F.col(lat_span) / 2.0).alias("_s"),
                           clamp_latitude(y + F.col(lat_span) / 2.0).alias("_n"),
                           (x - F.col(lon_span) / 2.0).alias("_w"), (x + F.col(lon_span) / 2.0).alias("_e")))
    one_tile = ~F.col("_box") | F.coalesce((tile_lat(F.col("_s")) == tile_lat(F.col("_n"))) & (tile_lon(F.col("_w")) == tile_lon(F.col("_e"))), F.lit(False))

    # a box always reaches the tile of its own centre
    def first_tile(tile, low: str, mid: str) -> Column:
        return F.when(F.col("_box"), tile(F.col(low))).otherwise(tile(F.col(mid)))

    def tiles_of(tile, low: str, high: str) -> Column:
        return F.explode(F.sequence(tile(F.col(low)), tile(F.col(high))))

    gx, gy = _grid_position(F.col("_lat"), F.col("_lon"))
    mid_x, mid_y = _block_of(F.col("_gx"), "width"), _block_of(F.col("_gy"), "height")

    def ranged(tiled: DataFrame) -> DataFrame:
        """The sampled range in the tile of the row, and the blocks that hold it and, at home, the centre."""
        sized = (tiled.withColumn("_home", (F.col("lat_deg") == tile_lat(F.col("_lat"))) & (F.col("lon_deg") == tile_lon(F.col("_lon"))))
                 .join(dem_catalog(blocks), TILE, "left"))
        step_x, step_y = F.lit(1.0) / (F.col("width") - 1), F.lit(1.0) / (F.col("height") - 1)
        north, west = F.col("lat_deg") + 1.0, F.col("lon_deg").cast("double")
        x0 = F.greatest(F.lit(0), F.ceil((F.col("_w") - west) / step_x)).cast("int")
        x1 = F.least(F.col("width") - 2, F.floor((F.col("_e") - west) / step_x)).cast("int")
        y0 = F.greatest(F.lit(0), F.ceil((north - F.col("_n")) / step_y)).cast("int")
        y1 = F.least(F.col("height") - 2, F.floor((north - F.col("_s")) / step_y)).cast("int")
        found = (sized.withColumn("_x0", x0).withColumn("_x1", x1).withColumn("_y0", y0).withColumn("_y1", y1)
                 .withColumn("_gx", gx).withColumn("_gy", gy)
                 .withColumn("_any", F.col("_box") & (F.col("_x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1"))))

        def ends(lo: str, hi: str, mid: Column) -> tuple[Column, Column]:
            first = F.when(F.col("_any"), F.floor(F.col(lo) / F.col("block")).cast("int"))
            last = F.when(F.col("_any"), F.floor(F.col(hi) / F.col("block")).cast("int"))
            centre = F.when(F.col("_home"), mid)
            return F.least(first, centre), F.greatest(last, centre)

        (low_y, high_y), (low_x, high_x) = ends("_y0", "_y1", mid_y), ends("_x0", "_x1", mid_x)
        return found.withColumns({"_low_y": low_y, "_high_y": high_y, "_low_x": low_x, "_high_x": high_x})

    def spread_over(low: str, high: str) -> Column:
        return F.explode_outer(F.when(F.col(low).isNotNull() & F.col(high).isNotNull(), F.sequence(low, high)))

    def axis(lo: str, hi: str, block: str, dimension: str) -> tuple[Column, Column, Column]:
        """First, last and stride of the sampled positions that this block owns."""
        stride = F.floor(F.greatest(F.col(hi) - F.col(lo), F.lit(0)) / SAMPLES_PER_AXIS).cast("int") + 1
        begin = F.col(block) * F.col("block")
        skipped = F.ceil(F.greatest(begin - F.col(lo), F.lit(0)) / stride).cast("int")
        return F.col(lo) + skipped * stride, F.least(F.col(hi), begin + F.col("block") - 1), stride

    fx, lx, sx = axis("_x0", "_x1", "block_x", "width")
    fy, ly, sy = axis("_y0", "_y1", "block_y", "height")
    usable = (F.col("samples").isNotNull() & F.coalesce(F.col("_any"), F.lit(False))
              & (F.col("_fx") <= F.col("_lx")) & (F.col("_fy") <= F.col("_ly")))
    taken = F.flatten(F.transform(
        F.sequence("_fy", "_ly", "_sy"),
        lambda sy_: F.transform(F.sequence("_fx", "_lx", "_sx"), lambda sx_: _sample(sx_, sy_))))
    present = F.when(usable, F.filter(taken, lambda v: v.isNotNull()))

    def partial(aimed: DataFrame) -> DataFrame:
        middle = F.col("_home") & (F.col("block_x") == mid_x) & (F.col("block_y") == mid_y)
        aimed = aimed.withColumns({"_mid": middle, "_fx": fx, "_lx": lx, "_sx": sx, "_fy": fy, "_ly": ly, "_sy": sy}).drop("_low_y", "_high_y", "_low_x", "_high_x")
        # the samples of a block stay out of the rows between the join and their use
        met = aimed.join(blocks.select(*BLOCK_KEY, "samples"), BLOCK_KEY, "left").select(
            *key, "_rest", present.alias("_v"), F.when(F.col("_mid") & F.col("samples").isNotNull(), _interpolated(F.col("_gx"), F.col("_gy"))).alias("_bil"))
        count = F.size("_v")
        return met.select(*key, "_rest", F.aggregate("_v", F.lit(0.0), lambda acc, v: acc + v).alias("_sum"), F.when(count > 0, count).alias("_cnt"), "_bil")

    # boxes inside one block, nearly all of a fine grid, are answered where they are; only the others meet by key
    alone = ranged(boxed.filter(one_tile).withColumn("lat_deg", first_tile(tile_lat, "_s", "_lat")).withColumn("lon_deg", first_tile(tile_lon, "_w", "_lon")))
    narrow = F.coalesce((F.col("_low_y") == F.col("_high_y")) & (F.col("_low_x") == F.col("_high_x")), F.lit(False))
    direct = partial(alone.filter(narrow).withColumn("block_y", F.col("_low_y")).withColumn("block_x", F.col("_low_x")))
    across = ranged(boxed.filter(~one_tile).withColumn("lat_deg", tiles_of(tile_lat, "_s", "_n")).withColumn("lon_deg", tiles_of(tile_lon, "_w", "_e")))
    pieces = partial(across.unionByName(alone.filter(~narrow)).withColumn("block_y", spread_over("_low_y", "_high_y"))
                     .withColumn("block_x", spread_over("_low_x", "_high_x")))
    # the other columns travel in the grouping key, which keeps the aggregation hash-based
    total = pieces.groupBy(*key, "_rest").agg(F.sum("_sum").alias("_sum"), F.sum("_cnt").alias("_cnt"), F.max("_bil").alias("_bil"))
    mean = F.coalesce(F.when(F.col("_cnt") > 0, F.col("_sum") / F.col("_cnt")), F.col("_bil"))
    return direct.unionByName(total).select(*key, "_rest.*", mean.alias(out)).select(*points.columns, out)


def landcover_blocks(grids: DataFrame, block: int = BLOCK) -> DataFrame:
    """Split grid rows (file_name, south, west, north, east, width, height, classes) into blocks."""
    x0, y0 = F.col("block_x") * block, F.col("block_y") * block
    x1 = F.least(x0 + block, F.col("width")) - 1
    y1 = F.least(y0 + block, F.col("height")) - 1
    return (grids.withColumn("block_y", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / block).cast("int"))))
            .withColumn("block_x", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / block).cast("int"))))
            .select("file_name", "south", "west", "north", "east", "width", "height", F.lit(block).alias("block"),
                    "block_y", "block_x", _cut(F.col("classes"), F.col("width"), x0, x1, y0, y1).alias("classes")))


@dataclass(frozen=True)
class LandcoverIndex:
    """Grid blocks with the order in which the grids of a cell are asked.

    ``turns`` counts the grids a point can meet: the most any degree cell lists, and any coarse
    cell. A few are asked one after the other, and points need no grouping over several answers.
    """

    blocks: DataFrame
    listed: DataFrame
    turns: tuple[int, int]

    @property
    def single(self) -> bool:
        """No cell lists two grids and none is huge."""
        return self.turns[0] <= 1 and not self.turns[1]


def build_landcover_index(blocks: DataFrame) -> LandcoverIndex:
    """List grids under the degree cells they cover, in file-name order.

    Grids spanning more than 4096 degree cells are asked last and listed under coarse cells.
    """
    header = blocks.filter("block_y = 0 AND block_x = 0").select(
        "file_name", "south", "west", "north", "east", "width", "height", "block")
    s, w = F.floor("south").cast("int"), F.floor("west").cast("int")
    n, e = F.ceil("north").cast("int") - 1, F.ceil("east").cast("int") - 1
    huge = (n - s + 1) * (e - w + 1) > HUGE_GRID_CELLS
    unit = F.when(huge, HUGE_CELL_DEGREES).otherwise(1)

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / unit).cast("int"), F.floor(high / unit).cast("int")))

    in_cell = Window.partitionBy("_late", "_cy", "_cx").orderBy("file_name")
    listed = materialise(header.withColumn("_late", huge.cast("int")).withColumn("_cy", cells(s, n)).withColumn("_cx", cells(w, e))
                         .withColumn("_turn", F.row_number().over(in_cell)), "grids")
    most = {r["_late"]: r.n for r in listed.groupBy("_late").agg(F.max("_turn").alias("n")).collect()}  # two rows at most
    return LandcoverIndex(blocks, listed, (most.get(0, 0), most.get(1, 0)))


def landcover_at(points: DataFrame, index: LandcoverIndex, key: list[str], out: str = "landcover",
                 lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the land-cover class: the first known one over the grids in their order."""
    y, x = F.col("_lat"), F.col("_lon")

    def point_cell(late) -> Column:
        size = HUGE_CELL_DEGREES if late else 1
        return F.struct(F.lit(late).alias("_late"), F.floor(y / size).cast("int").alias("_cy"), F.floor(x / size).cast("int").alias("_cx"))

    names = F.array(*[F.lit(c) for c in LANDCOVER_CLASSES])
    # numbers of one byte: a block is copied beside every point that meets it
    codes = F.transform("classes", lambda c: (F.array_position(names, c) - 1).cast("tinyint"))
    blocks = index.blocks.select("file_name", "block_x", "block_y", (F.col("classes") if index.single else codes).alias("classes"))

    def asked(met: DataFrame, kept: list) -> DataFrame:
        """What the grid that each point met holds at its spot, as ``_cls``."""
        inside = y.between(F.col("south"), F.col("north")) & x.between(F.col("west"), F.col("east"))
        px = F.least(F.col("width") - 1, ((x - F.col("west")) / (F.col("east") - F.col("west")) * F.col("width")).cast("int"))
        py = F.least(F.col("height") - 1,
                     ((F.col("north") - y) / (F.col("north") - F.col("south")) * F.col("height")).cast("int"))
        at = met.select(*kept, "file_name", "width", "block", F.when(inside, px).alias("_px"), F.when(inside, py).alias("_py"))
        block_x, block_y = F.floor(F.col("_px") / F.col("block")).cast("int"), F.floor(F.col("_py") / F.col("block")).cast("int")
        row = F.least(F.col("block"), F.col("width") - block_x * F.col("block"))
        spot = (F.col("_py") - block_y * F.col("block")) * row + F.col("_px") - block_x * F.col("block")
        aimed = at.select(*kept, "file_name", block_x.alias("block_x"), block_y.alias("block_y"), spot.cast("int").alias("_spot"))
        return aimed.join(blocks, ["file_name", "block_y", "block_x"], "left").select(*kept, F.get("classes", F.col("_spot")).alias("_cls"))

    if sum(index.turns) <= MAX_TURNS:
        whole = F.struct(*[c for c in points.columns if c != out]).alias("_rest")
        known = points.select(whole, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.lit(None).cast("string" if index.single else "tinyint").alias("_known"))
        for late in (0, 1):
            for turn in range(1, index.turns[late] + 1):
                # points that have their class ask no further
                cell = F.when(F.col("_known").isNull(), point_cell(late))
                grids = index.listed.filter((F.col("_late") == late) & (F.col("_turn") == turn)).drop("_late", "_turn")
                met = known.select("*", cell["_cy"].alias("_cy"), cell["_cx"].alias("_cx")).join(grids, ["_cy", "_cx"], "left")
                sure = F.col("_cls") if index.single else F.when(F.col("_cls") > 0, F.col("_cls"))
                known = asked(met, ["_rest", "_lat", "_lon", "_known"]).select("_rest", "_lat", "_lon", F.coalesce("_known", sure).alias("_known"))
        label = F.col("_known") if index.single else F.get(names, F.col("_known").cast("int"))
        return known.select("_rest.*", F.coalesce(label, F.lit("UNKNOWN")).alias(out)).select(*[c for c in points.columns if c != out], out)

    rest = [c for c in points.columns if c not in key]
    probe = points.select(*key, F.struct(*rest).alias("_rest"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    cells = [point_cell(late) for late in (0, 1) if index.turns[late]]
    met = probe.withColumn("_k", F.explode(F.array(*cells))).select(*key, "_rest", "_lat", "_lon", "_k.*").join(index.listed, ["_late", "_cy", "_cx"], "left")
    found = asked(met, [*key, "_rest", "_late", "_turn"])
    number = F.col("_cls")
    # turn and class share one number, so that the first known class is a plain minimum
    code = (F.col("_late").cast("bigint") * (1 << 40)) + F.col("_turn").cast("bigint") * 16 + number
    best = (found.withColumn("_code", F.when(number > 0, code)).groupBy(*key, "_rest").agg(F.min("_code").alias("_best")))
    label = F.coalesce(F.get(names, (F.col("_best") % 16).cast("int")), F.lit("UNKNOWN"))
    return best.select(*key, "_rest.*", label.alias(out)).select(*points.columns, out)


def merge_bathymetry(land: DataFrame, bathymetry: DataFrame) -> DataFrame:
    """Land samples above sea level win, anything else takes the nearest bathymetry sample.

    Tiles known to only one source pass through. ``bathymetry`` is true when the sea floor
    was needed somewhere in the tile.
    """
    a = land.select(*TILE, F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("samples").alias("_land"))
    b = bathymetry.select(*TILE, F.col("width").alias("_bw"), F.col("height").alias("_bh"), F.col("samples").alias("_sea"))
    both = a.join(b, TILE, "full_outer")

    def nearest_index(i: Column, size: Column, other: Column) -> Column:
        spread = F.when(size > 1, i * (other - 1).cast("double") / (size - 1)).otherwise(0.0)
        return F.floor(spread + 0.5).cast("int")

    def merged(v: Column, i: Column) -> Column:
        gx = i % F.col("_w")
        gy = F.floor(i / F.col("_w")).cast("int")
        at = nearest_index(gy, F.col("_h"), F.col("_bh")) * F.col("_bw") + nearest_index(gx, F.col("_w"), F.col("_bw"))
        return F.when(v > 0, v).otherwise(F.get("_sea", at))

    mixed = F.when(F.col("_land").isNull(), F.col("_sea")).when(F.col("_sea").isNull(), F.col("_land")) \
             .otherwise(F.transform("_land", merged))
    return both.select(*TILE, F.coalesce("_w", "_bw").alias("width"), F.coalesce("_h", "_bh").alias("height"),
                       mixed.alias("samples"),
                       F.when(F.col("_sea").isNull(), False).when(F.col("_land").isNull(), True)
                       .otherwise(tile_needs_bathymetry(F.col("_land"))).alias("bathymetry"))


def tile_needs_bathymetry(samples: Column) -> Column:
    """Any sample at or below sea level, or without data."""
    return F.exists(samples, lambda v: v.isNull() | (v <= 0))


def tile_void_stats(tiles: DataFrame) -> DataFrame:
    """Samples, voids and void share of every tile."""
    total = F.size("samples")
    voids = F.size(F.filter("samples", lambda v: v.isNull()))
    return tiles.select(*TILE, total.cast("bigint").alias("samples"), voids.cast("bigint").alias("voids"),
                        (voids * 100.0 / total).alias("void_percent"))


def dem_coverage(tiles: DataFrame) -> DataFrame:
    """One row: box around all tiles, zeros when there are none."""
    zero = F.lit(0)
    return tiles.agg(
        F.coalesce(F.min("lat_deg"), zero).cast("double").alias("min_lat"),
        F.coalesce(F.min("lon_deg"), zero).cast("double").alias("min_lon"),
        F.coalesce(F.max(F.col("lat_deg") + 1), zero).cast("double").alias("max_lat"),
        F.coalesce(F.max(F.col("lon_deg") + 1), zero).cast("double").alias("max_lon"))


def slice_raster_to_cells(rasters: DataFrame, pixels: DataFrame) -> DataFrame:
    """Re-sample geo-referenced rasters onto one-degree cells, nearest pixel first.

    ``rasters`` has raster_id, west, north, pixel_lat, pixel_lon (degrees), width, height;
    ``pixels`` has raster_id, px, py, meters (NULL for none). Every covered cell yields
    samples-per-axis squared rows; positions outside the raster are void.
    """
    finest = F.least("pixel_lat", "pixel_lon")
    per_axis = F.least(F.greatest(F.floor(F.lit(1.0) / finest + 0.5).cast("int") + 1, F.lit(2)), F.lit(3601))
    south = F.col("north") - F.col("pixel_lat") * F.col("height")
    east = F.col("west") + F.col("pixel_lon") * F.col("width")

    def span(low: Column, high: Column, lo: int, hi: int) -> Column:
        a = F.greatest(F.floor(low), F.lit(lo)).cast("int")
        b = F.least(F.ceil(high) - 1, F.lit(hi)).cast("int")
        return F.explode(F.when(a <= b, F.sequence(a, b)))

    cells = (rasters.withColumn("_n", per_axis)
             .withColumn("lat_deg", span(south, F.col("north"), -90, 89))
             .withColumn("lon_deg", span(F.col("west"), east, -180, 179))
             .withColumn("gy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
             .withColumn("gx", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    lat = F.col("lat_deg") + 1.0 - F.col("gy") / (F.col("_n") - 1)
    lon = F.col("lon_deg") + F.col("gx") / (F.col("_n") - 1)

    def pixel_of(offset: Column, pixel: str, limit: str) -> Column:
        at = F.floor(offset / F.col(pixel)).cast("int")
        at = F.when(at == F.col(limit), at - 1).otherwise(at)
        return F.when(at.between(0, F.col(limit) - 1), at)

    aimed = cells.withColumn("px", pixel_of(lon - F.col("west"), "pixel_lon", "width")) \
                 .withColumn("py", pixel_of(F.col("north") - lat, "pixel_lat", "height"))
    return (aimed.join(pixels, ["raster_id", "px", "py"], "left")
            .select("raster_id", *TILE, F.col("_n").alias("width"), F.col("_n").alias("height"), "gx", "gy", "meters"))


def downsample_landcover(rasters: DataFrame, pixels: DataFrame, samples_per_degree: int) -> DataFrame:
    """Take every step-th pixel of land-cover rasters, cell by cell.

    ``rasters`` has raster_id, west, north, pixel (degrees), width, height; ``pixels`` has
    raster_id, px, py, code. Only cells that lie fully inside their raster come out, and
    only rasters whose resolution is a whole multiple of the wanted one.
    """
    n = samples_per_degree
    per_degree = F.floor(F.lit(1.0) / F.col("pixel") + 0.5).cast("int")
    usable = (rasters.withColumn("_ppd", per_degree).filter(F.col("_ppd") % n == 0)
              .withColumn("_step", F.floor(F.col("_ppd") / n).cast("int"))
              .withColumn("_wx", F.floor((F.floor("west") - F.col("west")) / F.col("pixel") + 0.5).cast("int"))
              .withColumn("_wy", F.floor((F.col("north") - F.ceil("north")) / F.col("pixel") + 0.5).cast("int")))
    met = pixels.join(usable, "raster_id").filter((F.col("px") % F.col("_step") == 0) & (F.col("py") % F.col("_step") == 0))

    def along(pixel: str, start: str, limit: str) -> tuple[Column, Column, Column]:
        """Cell number, position in it, and whether its window lies inside the raster."""
        at = F.floor(F.col(pixel) / F.col("_step")) - F.floor(F.col(start) / F.col("_step"))
        k = F.floor(at / n).cast("int")
        begin = F.col(start) + k * F.col("_ppd")
        return k, (at - k * n).cast("int"), (begin >= 0) & (begin + F.col("_ppd") <= F.col(limit))

    kx, gx, fits_x = along("px", "_wx", "width")
    ky, gy, fits_y = along("py", "_wy", "height")
    return met.filter(fits_x & fits_y).select(
        "raster_id", (F.ceil("north") - 1 - ky).cast("int").alias("lat_deg"),
        (F.floor("west") + kx).cast("int").alias("lon_deg"), gx.alias("gx"), gy.alias("gy"),
        landcover_from_code(F.col("code")).alias("landcover"))
