"""Registered queries over boundaries, cities, names and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cartolith.operators import clip, gazetteer as gaz, ordering, publish, quality, shapes
from cartolith.plans.derived import SQL, Tables, with_tables
from cartolith.plans.registry import registered
from cartolith.functions.coords import Grid
from cartolith.params import TerrainParams

NS = "geo:"
NAMES = """
SELECT id * 2 AS id, 'city' AS entity_type, id AS entity_id, concat('alt ', cast(id % 40 AS string)) AS name FROM {cities}
UNION ALL SELECT id * 2 + 1, 'city', id, concat(name, ' town') FROM {cities}"""
QUERIES = """
SELECT c_custkey AS qid, CASE c_custkey % 3 WHEN 0 THEN concat(' SUPPLIER#00000000', cast(c_custkey % 10 AS string))
       WHEN 1 THEN concat('ALT ', cast(c_custkey % 60 AS string)) ELSE 'nowhere' END AS query FROM {customer}"""
PREFIXES = "SELECT DISTINCT lower(substr(p_name, 1, 3)) AS query FROM {part} UNION SELECT concat('ALT ', cast(r_regionkey AS string)) FROM {region}"
COUNTRY_PREFIXES = "SELECT DISTINCT substr(n_name, 1, 8) AS query FROM {nation} UNION SELECT concat('c', lower(substr(n_name, 1, 1))) FROM {nation} UNION SELECT 'Ca' FROM {region}"


def _d(text: str) -> str:
    return text.replace("{cities}", "cities").replace("{customer}", "customer").replace("{part}", "part").replace("{region}", "region") \
               .replace("{nation}", "nation").replace("AS string", "AS varchar")


def names(t: Tables) -> DataFrame:
    return t._sql(NAMES, cities=t.cities)


@registered("city_rank", with_tables("cities") + "SELECT id, row_number() OVER (ORDER BY population DESC, name, id) AS population_rank FROM cities")
def city_rank(t: Tables) -> DataFrame:
    return gaz.rank_by_population(t.cities).select("id", "population_rank")


@registered("cities_to_countries", with_tables("countries", "cities") + """
SELECT c.id, k.id AS country_id FROM (SELECT id, concat('C', CASE id % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'AB' ELSE chr(cast(65 + id % 26 AS int)) END) AS code FROM cities) c
LEFT JOIN countries k ON k.iso_code = c.code""")
def cities_to_countries(t: Tables) -> DataFrame:
    coded = t.cities.select("id", F.expr("concat('C', CASE id % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'AB' ELSE chr(65 + id % 26) END)").alias("iso_code"))
    return gaz.cities_to_countries(coded, t.countries).select("id", "country_id")


def _coded_regions(t: Tables) -> DataFrame:
    return t.regions.drop("country_id").withColumn("country_iso_code", F.expr("concat('C', chr(65 + id % 26))")).withColumn("strict", F.col("id") % 2 == 0)


_REGION_CODES = with_tables("regions") + ", r AS (SELECT id, concat('C', chr(cast(65 + id % 26 AS int))) AS code, id % 2 = 0 AS strict FROM regions)"


@registered("regions_to_countries", _REGION_CODES + " SELECT r.id, c.id AS country_id FROM r JOIN countries c ON c.iso_code = r.code")
def regions_to_countries(t: Tables) -> DataFrame:
    return gaz.regions_to_countries(_coded_regions(t), t.countries)[0].select("id", "country_id")


@registered("regions_without_country", _REGION_CODES + """ SELECT r.id, CASE WHEN strict THEN 'error: unknown country' ELSE 'skipped: unknown country' END AS reject_reason
FROM r WHERE code NOT IN (SELECT iso_code FROM countries)""")
def regions_without_country(t: Tables) -> DataFrame:
    return gaz.regions_to_countries(_coded_regions(t), t.countries)[1].select("id", "reject_reason")


@registered("find_country", with_tables("countries") + """
SELECT q.c_custkey AS qid, min(c.id) AS country_id FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat(' nation_', cast(c_nationkey AS varchar)) WHEN 1 THEN concat('c', chr(cast(97 + c_nationkey AS int)), ' ') ELSE '' END AS query FROM customer) q
LEFT JOIN countries c ON lower(trim(q.query)) <> '' AND (lower(c.name) = lower(trim(q.query)) OR lower(c.iso_code) = lower(trim(q.query))) GROUP BY 1""")
def find_country(t: Tables) -> DataFrame:
    queries = t._sql("""SELECT c_custkey AS qid, CASE c_custkey % 3 WHEN 0 THEN concat(' nation_', cast(c_nationkey AS string))
        WHEN 1 THEN concat('c', chr(97 + c_nationkey), ' ') ELSE '' END AS query FROM {customer}""", "customer")
    return gaz.find_country(queries, t.countries).select("qid", "country_id")


@registered("find_city", with_tables("cities") + f", names AS ({_d(NAMES)}), q AS ({_d(QUERIES)})" + """
, e AS (SELECT lower(trim(name)) AS k, arg_min(id, struct_pack(a := -population, b := name, c := id)) AS id FROM cities GROUP BY 1)
, a AS (SELECT lower(trim(n.name)) AS k, arg_min(n.entity_id, struct_pack(a := -c.population, b := c.id)) AS id FROM names n JOIN cities c ON c.id = n.entity_id GROUP BY 1)
SELECT q.qid, coalesce(e.id, a.id) AS city_id FROM q LEFT JOIN e ON e.k = lower(trim(q.query)) LEFT JOIN a ON a.k = lower(trim(q.query))""")
def find_city(t: Tables) -> DataFrame:
    return gaz.find_city(t._sql(QUERIES, "customer"), t.cities, names(t)).select("qid", "city_id")


@registered("search_cities", with_tables("cities") + f", names AS ({_d(NAMES)}), q AS ({_d(PREFIXES)})" + """
, f AS (SELECT lower(trim(name)) AS k, min(id) AS g FROM names GROUP BY 1)
, hits AS (SELECT q.query, c.id AS city_id, 0 AS ph, 0 AS g, -c.population AS a, c.name AS b, c.id AS c FROM q JOIN cities c ON starts_with(lower(c.name), lower(trim(q.query)))
  UNION ALL SELECT q.query, n.entity_id, 1, f.g, -c.population, '', n.id FROM q JOIN names n ON starts_with(lower(trim(n.name)), lower(trim(q.query)))
  JOIN f ON f.k = lower(trim(n.name)) JOIN cities c ON c.id = n.entity_id)
, one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, city_id ORDER BY ph, g, a, b, c) = 1)
, top AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query ORDER BY ph, g, a, b, c) <= 7)
SELECT t.query, t.city_id, cast(row_number() OVER (PARTITION BY t.query ORDER BY c.population DESC, c.name, c.id) AS int) AS position FROM top t JOIN cities c ON c.id = t.city_id""")
def search_cities(t: Tables) -> DataFrame:
    prefixes = t._sql(PREFIXES, "part", "region")
    return gaz.search_cities(prefixes, t.cities, names(t), 7).select("query", "city_id", "position")


@registered("search_countries", with_tables("countries") + f", q AS ({_d(COUNTRY_PREFIXES)})" + """
SELECT query, country_id, cast(position AS int) AS position FROM (
SELECT q.query, c.id AS country_id, row_number() OVER (PARTITION BY q.query ORDER BY c.name, c.id) AS position FROM q
JOIN countries c ON starts_with(lower(c.name), lower(trim(q.query))) OR starts_with(lower(c.iso_code), lower(trim(q.query)))) WHERE position <= 5""")
def search_countries(t: Tables) -> DataFrame:
    return gaz.search_countries(t._sql(COUNTRY_PREFIXES, "nation", "region"), t.countries, 5).select("query", "country_id", "position")


_FEW_CAPITALS = "SELECT * REPLACE (capital AND country_id % 3 > 0 AS capital) FROM cities"


def _some_capitals(t: Tables) -> DataFrame:
    return t.cities.withColumn("capital", F.col("capital") & (F.col("country_id") % 3 > 0))


@registered("country_anchor", with_tables("countries", "cities") + f", k AS ({_FEW_CAPITALS})" + """
, s AS (SELECT country_id, arg_min(struct_pack(lat := lat, lon := lon), struct_pack(p := -population, n := name, i := id)) AS v FROM k WHERE capital GROUP BY 1)
SELECT c.id, round(coalesce(s.v.lat, (c.min_lat + c.max_lat) / 2), 6) + 0e0 AS lat, round(coalesce(s.v.lon, (c.min_lon + c.max_lon) / 2), 6) + 0e0 AS lon FROM countries c LEFT JOIN s ON s.country_id = c.id""")
def country_anchor(t: Tables) -> DataFrame:
    found = gaz.country_anchor(t.countries, _some_capitals(t))
    return found.select("id", (F.round("lat", 6) + 0.0).alias("lat"), (F.round("lon", 6) + 0.0).alias("lon"))


@registered("alternate_names", """
WITH p AS (SELECT p_partkey AS id, concat_ws(',', p_brand, ' ', p_type, p_name, p_brand, concat(p_type, ' ', cast(p_size AS varchar)), cast(p_size AS varchar), p_name) AS alts, p_name AS ascii FROM part),
u AS (SELECT id, trim(n) AS name, i FROM (SELECT id, unnest(list_concat([ascii], string_split(alts, ','))) AS n, generate_subscripts(list_concat([ascii], string_split(alts, ',')), 1) AS i FROM p)),
d AS (SELECT id, name, min(i) AS i FROM u WHERE name <> '' GROUP BY 1, 2)
SELECT id AS entity_id, cast(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS int) AS position, name FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 12""")
def alternate_names(t: Tables) -> DataFrame:
    cities = t._sql("""SELECT p_partkey AS id, p_name AS ascii_name, concat_ws(',', p_brand, ' ', p_type, p_name, p_brand,
        concat(p_type, ' ', cast(p_size AS string)), cast(p_size AS string), p_name) AS alternate_names FROM {part}""", "part")
    return gaz.alternate_names(cities, most=12).select("entity_id", "position", "name")


_MARKED = ", sel AS (SELECT * FROM cities WHERE capital UNION ALL (SELECT * FROM cities WHERE NOT capital AND population >= 1000 ORDER BY population DESC, name, id LIMIT 50))"
_MARKERS = with_tables("regions", "cities") + _MARKED + """
, m AS (SELECT concat('geo:country/', cast(id AS varchar)) AS id, name AS label, 'COUNTRY' AS type, (min_lat + max_lat) / 2 AS lat, (min_lon + max_lon) / 2 AS lon, iso_code AS detail FROM countries
UNION ALL SELECT concat('geo:region/', cast(r.id AS varchar)), r.name, 'REGION', (r.min_lat + r.max_lat) / 2, (r.min_lon + r.max_lon) / 2, coalesce(c.name, '') FROM regions r LEFT JOIN countries c ON c.id = r.country_id
UNION ALL SELECT concat('geo:', CASE WHEN s.capital THEN 'capital/' ELSE 'city/' END, cast(s.id AS varchar)), s.name, CASE WHEN s.capital THEN 'CAPITAL' ELSE 'CITY' END, s.lat, s.lon,
  concat_ws(' -- ', CASE WHEN s.capital THEN concat('Capital of ', c.name) ELSE c.name END, CASE WHEN s.population > 0 THEN concat('population ', format('{:,}', s.population)) END)
  FROM sel s LEFT JOIN countries c ON c.id = s.country_id)"""


def markers(t: Tables) -> DataFrame:
    return publish.build_markers(t.countries, t.regions, t.cities, NS, city_limit=50, min_population=1000)


@registered("city_marker_selection", with_tables("cities") + _MARKED + " SELECT id FROM sel")
def city_marker_selection(t: Tables) -> DataFrame:
    return gaz.select_city_markers(t.cities, 50, 1000).select("id")


@registered("markers", _MARKERS + " SELECT id, label, type, round(lat, 6) + 0e0 AS lat, round(lon, 6) + 0e0 AS lon, detail FROM m")
def markers_query(t: Tables) -> DataFrame:
    return markers(t).select("id", "label", "type", (F.round("lat", 6) + 0.0).alias("lat"), (F.round("lon", 6) + 0.0).alias("lon"), "detail")


@registered("markers_by_type", _MARKERS + " SELECT id, detail FROM m WHERE type = 'CAPITAL'")
def markers_by_type(t: Tables) -> DataFrame:
    return publish.markers_by_type(markers(t), "CAPITAL").select("id", "detail")


@registered("marker_sets", _MARKERS + """
SELECT CASE WHEN type IN ('CITY', 'CAPITAL') THEN 'map-cities' ELSE 'map-countries' END AS marker_set, id, concat('map-', lower(type)) AS style,
  CASE type WHEN 'COUNTRY' THEN 1e7 WHEN 'CAPITAL' THEN 1e7 WHEN 'REGION' THEN 2e6 ELSE 5e5 END AS max_distance,
  round((radians((((lon + 180) % 360 + 360) % 360 - 180)) - radians(10e0)) * 6378137e0 * cos(radians(51e0)) / 1000, 4) + 0e0 AS x,
  round((radians(51e0) - radians(lat)) * 6378137e0 / 1000, 4) + 0e0 AS z FROM m""")
def marker_sets(t: Tables) -> DataFrame:
    sets = publish.marker_sets(markers(t), Grid(TerrainParams()), "map-")
    return sets.select("marker_set", "id", "style", "max_distance", (F.round("x", 4) + 0.0).alias("x"), (F.round("z", 4) + 0.0).alias("z"))


@registered("marker_counts", _MARKERS + " SELECT CASE WHEN type IN ('CITY', 'CAPITAL') THEN 'map-cities' ELSE 'map-countries' END AS marker_set, count(*) AS markers FROM m GROUP BY 1")
def marker_counts(t: Tables) -> DataFrame:
    return publish.marker_counts(publish.marker_sets(markers(t), Grid(TerrainParams()), "map-"))


@registered("marker_replacement", _MARKERS + """
SELECT concat('town:', cast(c_custkey AS varchar)) AS id, c_name AS label FROM customer UNION ALL SELECT id, label FROM m""")
def marker_replacement(t: Tables) -> DataFrame:
    """Markers of other owners stay; a namespace is replaced as a whole."""
    fresh = markers(t)
    towns = t.points.join(t.base("customer").select(F.col("c_custkey").alias("id"), "c_name"), "id").select(
        F.concat(F.lit("town:"), F.col("id").cast("string")).alias("id"), F.col("c_name").alias("label"), F.lit("TOWN").alias("type"), "lat", "lon", F.lit("").alias("detail"))
    stale = fresh.withColumn("label", F.lit("stale"))
    return publish.replace_namespace(towns.unionByName(stale), fresh, NS).select("id", "label")


@registered("boundary_coverage", with_tables("countries") + "SELECT min(min_lat) AS min_lat, min(min_lon) AS min_lon, max(max_lat) AS max_lat, max(max_lon) AS max_lon FROM countries")
def boundary_coverage(t: Tables) -> DataFrame:
    return gaz.boundary_coverage(t.countries)


_DUP = ", k AS (SELECT *, concat('C', chr(cast(65 + id % 20 AS int))) AS iso2, concat('N', cast(id % 18 AS varchar)) AS name2 FROM countries)"


def _repeating(t: Tables) -> DataFrame:
    return t.countries.withColumn("iso_code", F.expr("concat('C', chr(65 + id % 20))")).withColumn("name", F.expr("concat('N', cast(id % 18 AS string))"))


@registered("duplicate_keys", with_tables("countries") + _DUP + """
SELECT 'error' AS severity, 'duplicate_iso' AS "check", iso2 AS entity, printf('used by %d countries', count(*)) AS message FROM k GROUP BY iso2 HAVING count(*) > 1
UNION ALL SELECT 'warning', 'duplicate_name', lower(name2), printf('appears %d times', count(*)) FROM k GROUP BY lower(name2) HAVING count(*) > 1""")
def duplicate_keys(t: Tables) -> DataFrame:
    rows = _repeating(t)
    return quality.duplicate_iso(rows).unionByName(quality.duplicate_names(rows))


@registered("first_country_per_code", with_tables("countries") + _DUP + " SELECT iso2 AS iso_code, min(id) AS id, arg_min(name2, id) AS name FROM k GROUP BY iso2")
def first_country_per_code(t: Tables) -> DataFrame:
    return ordering.first_per_key(_repeating(t).select("iso_code", "id", "name"), ["iso_code"], [F.col("id")])


@registered("capitals_per_country", with_tables("countries", "cities") + f", k AS ({_FEW_CAPITALS})" + """
SELECT c.id AS country_id, c.name, count(k.id) AS capitals, string_agg(k.name, ', ' ORDER BY k.id) AS names FROM countries c LEFT JOIN k ON k.country_id = c.id AND k.capital GROUP BY ALL""")
def capitals_per_country(t: Tables) -> DataFrame:
    return gaz.capitals_per_country(t.countries, _some_capitals(t))


@registered("capital_findings", with_tables("countries", "cities") + f", k AS ({_FEW_CAPITALS})" + """
SELECT 'warning' AS severity, 'no_capital' AS "check", cast(id AS varchar) AS entity, 'has no capital' AS message FROM countries WHERE id NOT IN (SELECT country_id FROM k WHERE capital)""")
def capital_findings(t: Tables) -> DataFrame:
    return quality.capital_findings(t.countries, _some_capitals(t))


@registered("cities_outside_country", with_tables("edges", "cities") + ", country_hits AS (" + SQL["country_hits"].replace("points p", "cities p") + """)
SELECT 'warning' AS severity, 'city_outside_country' AS "check", cast(c.id AS varchar) AS entity, concat(c.name, ' lies outside its country') AS message
FROM cities c WHERE NOT EXISTS (SELECT 1 FROM country_hits h WHERE h.pid = c.id AND h.cid = c.country_id)""")
def cities_outside_country(t: Tables) -> DataFrame:
    return quality.cities_outside_country(t.countries, t.country_shapes, t.cities)


@registered("cities_outside_coverage", with_tables("countries", "cities") + """
, b AS (SELECT min(min_lat) AS s, min(min_lon) AS w, max(max_lat) AS n, max(max_lon) AS e FROM countries)
SELECT 'warning' AS severity, 'city_outside_coverage' AS "check", cast(id AS varchar) AS entity, name AS message FROM cities, b WHERE NOT (lat * 1.2e0 BETWEEN s AND n AND lon BETWEEN w AND e)""")
def cities_outside_coverage(t: Tables) -> DataFrame:
    """Cities pushed towards the poles, so that some leave the area the boundaries cover."""
    return quality.cities_outside_coverage(t.countries, t.cities.withColumn("lat", F.col("lat") * 1.2))


_TINY = 0.03  # half the width of the small squares, in degrees


@registered("overlapping_countries", with_tables("edges") + f"""
, small AS (SELECT id + 1000 AS id, (min_lon + max_lon) / 2 AS x, (min_lat + max_lat) / 2 AS y FROM countries UNION ALL SELECT id + 2000, (min_lon + max_lon) / 2 + 0.04e0, (min_lat + max_lat) / 2 FROM countries)
, every AS (SELECT id, x1, y1, x2, y2 FROM edges UNION ALL SELECT id, x + u * {_TINY}e0, y + v * {_TINY}e0, x + w * {_TINY}e0, y + z * {_TINY}e0 FROM small, (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) s(u, v, w, z))
, e AS (SELECT id, CASE WHEN y1 < y2 THEN x1 ELSE x2 END AS xa, least(y1, y2) AS ya, CASE WHEN y1 < y2 THEN x2 ELSE x1 END AS xb, greatest(y1, y2) AS yb FROM every WHERE y1 <> y2)
, box AS (SELECT id, min(least(xa, xb)) AS w, max(greatest(xa, xb)) AS e, min(ya) AS s, max(yb) AS n FROM e GROUP BY id)
, pr AS (SELECT a.id AS a, b.id AS b FROM box a JOIN box b ON a.id <= b.id AND a.w < b.e AND b.w < a.e AND a.s < b.n AND b.s < a.n)
, ys AS (SELECT a, b, ya AS y FROM pr JOIN e ON e.id = a OR e.id = b UNION SELECT a, b, yb FROM pr JOIN e ON e.id = a OR e.id = b
  UNION SELECT a, b, y FROM (SELECT a, b, p.ya AS pa, p.yb AS pb, q.ya AS qa, q.yb AS qb, (q.xa - p.xa + p.ya * (p.xb - p.xa) / (p.yb - p.ya) - q.ya * (q.xb - q.xa) / (q.yb - q.ya)) / nullif((p.xb - p.xa) / (p.yb - p.ya) - (q.xb - q.xa) / (q.yb - q.ya), 0) AS y
    FROM pr JOIN e p ON p.id = a JOIN e q ON q.id = b AND a < b) z WHERE y > pa AND y < pb AND y > qa AND y < qb)
, sl AS (SELECT a, b, y AS y0, lead(y) OVER (PARTITION BY a, b ORDER BY y) AS y1 FROM ys)
, cr AS (SELECT sl.a, sl.b, y0, y1, e.id, xa + ((y0 + y1) / 2 - ya) * (xb - xa) / (yb - ya) AS x FROM sl JOIN e ON (e.id = sl.a OR e.id = sl.b) AND ya < (y0 + y1) / 2 AND yb > (y0 + y1) / 2)
, rn AS (SELECT *, row_number() OVER (PARTITION BY a, b, y0, id ORDER BY x) AS k FROM cr)
, iv AS (SELECT p.a, p.b, p.y0, p.y1, p.id, p.x AS lo, q.x AS hi FROM rn p JOIN rn q ON p.a = q.a AND p.b = q.b AND p.y0 = q.y0 AND p.id = q.id AND q.k = p.k + 1 WHERE p.k % 2 = 1)
, ar AS (SELECT p.a, p.b, sum(greatest(0, least(p.hi, q.hi) - greatest(p.lo, q.lo)) * (p.y1 - p.y0)) AS area FROM iv p JOIN iv q ON p.a = q.a AND p.b = q.b AND p.y0 = q.y0 AND p.id = p.a AND q.id = q.b GROUP BY p.a, p.b)
SELECT s.a, s.b, round(s.area / least(x.area, y.area), 6) + 0e0 AS share FROM ar s JOIN ar x ON x.a = s.a AND x.b = s.a JOIN ar y ON y.a = s.b AND y.b = s.b WHERE s.a < s.b AND s.area / least(x.area, y.area) > {quality.OVERLAP_TOLERANCE}""")
def overlapping_countries(t: Tables) -> DataFrame:
    """Countries with two small squares each, 0.06 degrees wide, that overlap each other by a third and their country wholly."""
    def square(number: int, shift: float) -> DataFrame:
        x, y = (F.col("min_lon") + F.col("max_lon")) / 2 + shift, (F.col("min_lat") + F.col("max_lat")) / 2
        ring = F.array(*[F.struct((x + u * _TINY).alias("lon"), (y + v * _TINY).alias("lat")) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
        return t.countries.select((F.col("id") + number).alias("id"), F.array(ring).alias("rings"))

    every = t.countries.select("id", "rings").unionByName(square(1000, 0.0)).unionByName(square(2000, 0.04))
    found = quality.overlap_shares(shapes.area_set(every, F.col("id"), ["id"]).shapes).filter(F.col("share") > quality.OVERLAP_TOLERANCE)
    return found.select("a", "b", (F.round("share", 6) + 0.0).alias("share"))


@registered("orphan_regions", with_tables("regions") + """
SELECT 'error' AS severity, 'orphan_region' AS "check", cast(id AS varchar) AS entity, 'references a country that is not there' AS message FROM regions WHERE country_id + 3 NOT IN (SELECT id FROM countries)""")
def orphan_regions(t: Tables) -> DataFrame:
    return quality.orphan_regions(t.countries, t.regions.withColumn("country_id", F.col("country_id") + 3))


@registered("misplaced_regions", with_tables("regions") + """
SELECT 'error' AS severity, 'region_outside_country' AS "check", cast(r.id AS varchar) AS entity, 'lies outside its country' AS message FROM regions r JOIN countries c ON c.id = (r.country_id + r.id % 2) % 25
WHERE r.min_lat > c.max_lat OR r.max_lat < c.min_lat OR r.min_lon > c.max_lon OR r.max_lon < c.min_lon""")
def misplaced_regions(t: Tables) -> DataFrame:
    return quality.misplaced_regions(t.countries, t.regions.withColumn("country_id", (F.col("country_id") + F.col("id") % 2) % 25))


@registered("invalid_geometry", """
SELECT 'error' AS severity, 'invalid_geometry' AS "check", cast(p_partkey AS varchar) AS entity, ['open ring', 'self-intersection', 'zero area', 'empty'][p_partkey % 5] AS message FROM part WHERE p_partkey % 5 > 0""")
def invalid_geometry(t: Tables) -> DataFrame:
    """One feature per part; four of five are broken in different ways."""
    k, x, y = F.col("p_partkey"), (F.col("p_size") * 3).cast("double"), (F.col("p_size") - 20).cast("double")

    def ring(*offsets):
        return F.array(*[F.struct((x + a).alias("lon"), (y + b).alias("lat")) for a, b in offsets])

    box, open_ring = ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), ((0, 0), (2, 0), (2, 2), (0, 2))
    bow, flat = ((0, 0), (2, 2), (2, 0), (0, 1), (0, 0)), ((0, 0), (1, 0), (2, 0), (0, 0))
    rings = (F.when(k % 5 == 0, F.array(ring(*box))).when(k % 5 == 1, F.array(ring(*open_ring))).when(k % 5 == 2, F.array(ring(*bow)))
             .when(k % 5 == 3, F.array(ring(*flat))).otherwise(F.array().cast("array<array<struct<lon:double,lat:double>>>")))
    return quality.invalid_geometry(t.base("part").select(k.alias("id"), rings.alias("rings")))


@registered("validation_verdict")
def validation_verdict(t: Tables) -> DataFrame:
    """All checks in one frame, counted; each check has its own SQL counterpart above."""
    findings = quality.validate(t.countries, t.regions, t.cities, t.country_shapes, shapes.area_set(t.countries, F.col("id"), ["id"]).shapes)
    return quality.verdict(findings, strict=True)


@registered("ring_areas", with_tables("corners") + """
, r AS (SELECT id, ring, sum(x * y2 - x2 * y) AS v FROM (SELECT id, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM corners WINDOW w AS (PARTITION BY id, ring ORDER BY i)) GROUP BY 1, 2)
SELECT id, cast(ring AS int) AS ring, round(abs(v) / 2, 4) + 0e0 AS area FROM r""")
def ring_areas(t: Tables) -> DataFrame:
    rings = t.countries.select("id", F.posexplode("rings").alias("ring", "points"))
    return rings.select("id", "ring", (F.round(shapes.ring_area(F.col("points")), 4) + 0.0).alias("area"))


_DISSOLVE = with_tables("regions") + """
, e AS (SELECT r.country_id, v.* FROM regions r, LATERAL (SELECT * FROM (VALUES (r.min_lon, r.min_lat, r.max_lon, r.min_lat), (r.max_lon, r.min_lat, r.max_lon, r.max_lat), (r.min_lon, r.max_lat, r.max_lon, r.max_lat), (r.min_lon, r.min_lat, r.min_lon, r.max_lat)) q(x1, y1, x2, y2)) v)"""


_CUT = _DISSOLVE.replace("FROM regions r,", "FROM (SELECT *, row_number() OVER (PARTITION BY country_id ORDER BY id) AS k FROM regions) r,").replace(") v)", ") v WHERE NOT (r.k = 1 AND v.y1 = v.y2 AND v.y1 = r.min_lat))")


@registered("dissolve_open_ends", _CUT + """
, o AS (SELECT country_id, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT country_id, x, y, count(*) AS edges FROM (SELECT country_id, x1 AS x, y1 AS y FROM o UNION ALL SELECT country_id, x2, y2 FROM o) GROUP BY ALL HAVING count(*) % 2 = 1""")
def dissolve_open_ends(t: Tables) -> DataFrame:
    """Regions, of which the first of each country has lost its southern edge and is a path of three edges."""
    first = Window.partitionBy("country_id").orderBy("id")
    ring = F.col("rings")[0]
    west, east = F.col("min_lon"), F.col("max_lon")
    path = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((east, F.col("min_lat")), (east, F.col("max_lat")), (west, F.col("max_lat")), (west, F.col("min_lat")))])
    cut = t.regions.withColumn("k", F.row_number().over(first)).withColumn("rings", F.array(F.when(F.col("k") == 1, path).otherwise(ring)))
    base = shapes.area_set(cut, F.col("id"), ["id"]).shapes.join(t.regions.select(F.col("id").alias("rank"), "country_id"), "rank")
    return publish.open_ends(base, "country_id")


@registered("dissolved_edges", _DISSOLVE + " SELECT country_id, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) % 2 = 1")
def dissolved_edges(t: Tables) -> DataFrame:
    """Outline of each country from its regions."""
    base = shapes.area_set(t.regions, F.col("id"), ["id"]).shapes.join(t.regions.select(F.col("id").alias("rank"), "country_id"), "rank")
    return publish.dissolve_edges(base, "country_id")


@registered("projected_outlines", with_tables("countries") + """
, x AS (SELECT id, cast(floor((radians(min_lon * 0.99e0) - radians(10e0)) * 6378137e0 * cos(radians(51e0)) / 1000) AS int) AS x0, cast(floor((radians(max_lon * 0.99e0) - radians(10e0)) * 6378137e0 * cos(radians(51e0)) / 1000) AS int) AS x1,
  cast(floor((radians(51e0) - radians(max_lat)) * 6378137e0 / 1000) AS int) AS z0, cast(floor((radians(51e0) - radians(min_lat)) * 6378137e0 / 1000) AS int) AS z1 FROM countries)
SELECT id AS country_id, cast(x1 - x0 AS double) * (z1 - z0) AS area FROM x""")
def projected_outlines(t: Tables) -> DataFrame:
    """Outlines in grid columns, drawn one percent narrower so that none touches 180 degrees."""
    narrow = t.regions.withColumn("rings", F.transform("rings", lambda ring: F.transform(
        ring, lambda p: F.struct((p["lon"] * 0.99).alias("lon"), p["lat"].alias("lat")))))
    base = shapes.area_set(narrow, F.col("id"), ["id"]).shapes.join(t.regions.select(F.col("id").alias("rank"), "country_id"), "rank")
    rings = publish.projected_rings(base, "country_id", Grid(TerrainParams()))
    return rings.select("country_id", F.abs("area").alias("area"))


@registered("clip_selection", with_tables("water") + "SELECT id FROM water WHERE min_lat <= 55 AND max_lat >= 40 AND min_lon <= 40 AND max_lon >= -20")
def clip_selection(t: Tables) -> DataFrame:
    return clip.keep_meeting(t.water_bodies, (40.0, -20.0, 55.0, 40.0)).select("id")


@registered("clipped_areas", with_tables("water") + """
SELECT id, round((least(max_lat, 55) - greatest(min_lat, 40)) * (least(max_lon, 40) - greatest(min_lon, -20)), 6) + 0e0 AS area FROM water
WHERE min_lat < 55 AND max_lat > 40 AND min_lon < 40 AND max_lon > -20""")
def clipped_areas(t: Tables) -> DataFrame:
    cut = clip.clip_areas(t.water_bodies.select("id", "min_lat", "min_lon", "max_lat", "max_lon", "rings"), (40.0, -20.0, 55.0, 40.0))
    area = F.aggregate(F.transform("rings", shapes.ring_area), F.lit(0.0), lambda a, v: a + v)
    return cut.select("id", (F.round(area, 6) + 0.0).alias("area")).filter("area > 0")


@registered("antimeridian_split", """
WITH l AS (SELECT c_custkey AS id, 170 + c_custkey % 9 + 0e0 AS x1, (c_custkey % 80) - 40e0 AS y1, CASE WHEN c_custkey % 3 > 0 THEN -175e0 + c_custkey % 5 ELSE 179e0 END AS x2, (c_custkey % 70) - 30e0 AS y2 FROM customer),
c AS (SELECT *, y1 + (180 - x1) / (x2 + 360 - x1) * (y2 - y1) AS yc FROM l)
SELECT id, 0 AS piece, x1, round(y1, 9) + 0e0 AS y1, CASE WHEN abs(x2 - x1) > 180 THEN 180e0 ELSE x2 END AS x2, round(CASE WHEN abs(x2 - x1) > 180 THEN yc ELSE y2 END, 9) + 0e0 AS y2 FROM c
UNION ALL SELECT id, 1, -180e0, round(yc, 9) + 0e0, x2, round(y2, 9) + 0e0 FROM c WHERE abs(x2 - x1) > 180""")
def antimeridian_split(t: Tables) -> DataFrame:
    lines = t._sql("""SELECT c_custkey AS id, array(named_struct('lon', 170 + c_custkey % 9 + 0e0, 'lat', (c_custkey % 80) - 40e0),
        named_struct('lon', CASE WHEN c_custkey % 3 > 0 THEN -175e0 + c_custkey % 5 ELSE 179e0 END, 'lat', (c_custkey % 70) - 30e0)) AS path FROM {customer}""", "customer")
    return publish.split_antimeridian(lines, ["id"]).select("id", "piece", "x1", (F.round("y1", 9) + 0.0).alias("y1"), "x2", (F.round("y2", 9) + 0.0).alias("y2"))
