"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Index builds are timed on their own: they depend on the reference data only and are done once,
like loading a database, while the lookups grow with the points.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from cartolith.operators import nearest as near, raster, shapes  # noqa: E402
from cartolith.plans import terrain as tp, worlds  # noqa: E402
from cartolith.plans.derived import LAT, LINE_KEY, LON, Tables  # noqa: E402
from cartolith.session import build_session, materialise  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", cpus), "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, folder)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name: str, work):
        started = time.time()
        result = work()
        times[name] = round(time.time() - started, 3)
        return result

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timed("warm_up", lambda: t.line_points.agg(F.sum("shipments")).collect())
    countries = timed("index_countries", lambda: t.country_shapes)
    regions = timed("index_regions", lambda: t.region_shapes)
    cities = timed("index_cities", lambda: t.city_index)
    dem = timed("index_dem", lambda: materialise(t.dem, "dem"))

    # every order line is a point of its own; lines are numbered so that points have keys
    lines = materialise(t._sql(f"""SELECT l_orderkey, l_linenumber, monotonically_increasing_id() AS id, {LAT.format(k=LINE_KEY)} AS lat,
        {LON.format(k=LINE_KEY)} AS lon FROM {{lineitem}}""", "lineitem"), "lines")
    rows["points"] = lines.count()
    boxed = lines.withColumn("lat_span", F.lit(0.3)).withColumn("lon_span", F.lit(0.3))
    timed("country_at", lambda: drain(shapes.locate(lines, countries, ["id"], "country")))
    timed("nearest_city", lambda: drain(near.nearest(lines, cities, "city")))
    timed("elevation_at", lambda: drain(raster.elevation_at(lines, dem)))
    timed("footprint_mean", lambda: drain(raster.footprint_mean(boxed, dem, ["id"])))
    timed("whereami", lambda: drain(tp.whereami(lines, countries, regions, cities, dem, ["id"])))

    inputs = timed("index_water", lambda: replace(worlds.sources(t, True), dem=dem))
    chunks = materialise(worlds.chunks(t), "chunks")
    rows["columns"] = chunks.count() * 256
    timed("terrain", lambda: drain(tp.build_terrain(chunks, inputs, replace(worlds.PARAMS, detail=1.0))))

    rates = {name: round(rows["points"] / times[name]) for name in ("country_at", "nearest_city", "elevation_at", "footprint_mean", "whereami")}
    rates["terrain_columns"] = round(rows["columns"] / times["terrain"])
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()) - times["warm_up"], 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "rows": rows, "rows_per_sec": rates}))


if __name__ == "__main__":
    main()
