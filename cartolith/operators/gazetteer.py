"""Countries, regions, cities and their names.

Queries come in batches. Lookup sides are reduced to one row per key before they meet the
queries, so a popular query never gathers its rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartolith.functions.text import blank_to_null, lookup_key
from cartolith.operators.ordering import first_per_key, top_per_key, with_global_row_number



def population_order() -> list[Column]:
    return [F.desc("population"), F.asc("name"), F.asc("id")]


def _population_rank() -> Column:
    return F.struct((-F.col("population")).alias("p"), F.col("name").alias("n"), F.col("id").alias("i"))


def rank_by_population(cities: DataFrame) -> DataFrame:
    """Number all cities by population, largest first, then by name."""
    return with_global_row_number(cities, population_order(), "population_rank")


def cities_to_countries(cities: DataFrame, countries: DataFrame, iso: str = "iso_code") -> DataFrame:
    """Left join of cities to countries by two-letter code; malformed codes find nothing."""
    ids = first_per_key(countries.select("iso_code", "id"), ["iso_code"], [F.col("id")]).select(
        F.col("iso_code").alias("_iso"), F.col("id").alias("country_id"))
    code = F.when(F.col(iso).rlike("^[A-Z]{2}$"), F.col(iso))
    return cities.withColumn("_iso", code).join(ids, "_iso", "left").drop("_iso")


def regions_to_countries(regions: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions with their country id, and the rejected rest with a reason.

    Orphans of published sources are skipped; those of native sources (``strict``) are errors.
    """
    ids = countries.select(F.col("iso_code").alias("country_iso_code"), F.col("id").alias("country_id"))
    kept = regions.join(ids, "country_iso_code", "inner")
    lost = regions.join(ids, "country_iso_code", "left_anti").withColumn(
        "reject_reason", F.when(F.col("strict"), "error: unknown country").otherwise("skipped: unknown country"))
    return kept, lost


def _attach(queries: DataFrame, query: str, table: DataFrame) -> DataFrame:
    return (queries.withColumn("_key", lookup_key(F.col(query))).join(table, "_key", "left").drop("_key"))


def find_country(queries: DataFrame, countries: DataFrame, query: str = "query", by: tuple = ("iso_code", "name"),
                 out: str = "country_id") -> DataFrame:
    """Case-insensitive match on code or name; the lowest id wins."""
    keys = countries.select(F.explode(F.array(*[lookup_key(F.col(c)) for c in by])).alias("_key"), "id")
    return _attach(queries, query, keys.groupBy("_key").agg(F.min("id").alias(out)))


def find_city(queries: DataFrame, cities: DataFrame, names: DataFrame, query: str = "query",
              out: str = "city_id") -> DataFrame:
    """The most populous city of that name, else the most populous one with that alias."""
    exact = cities.groupBy(lookup_key(F.col("name")).alias("_key")).agg(
        F.min_by("id", _population_rank()).alias("_exact"))
    people = cities.select(F.col("id").alias("entity_id"), "population")
    alias = (names.filter("entity_type = 'city'").withColumn("_key", lookup_key(F.col("name")))
             .join(people, "entity_id").groupBy("_key")
             .agg(F.min_by("entity_id", F.struct((-F.col("population")).alias("p"), F.col("id").alias("i"))).alias("_alias")))
    found = _attach(_attach(queries, query, exact), query, alias)
    return found.withColumn(out, F.coalesce("_exact", "_alias")).drop("_exact", "_alias")


def _prefixes(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(name)), lambda i: F.substring(name, F.lit(1), i))


def search_cities(queries: DataFrame, cities: DataFrame, names: DataFrame, limit: int, query: str = "query") -> DataFrame:
    """Up to ``limit`` cities per prefix: names by population first, then aliases in the order listed; returned
    by population and name."""
    wanted = queries.select(query).distinct().withColumn("_key", F.lower(F.trim(query)))
    by_name = cities.select(F.explode(_prefixes(F.lower("name"))).alias("_key"), F.col("id").alias("city_id"),
                            F.lit(0).alias("_phase"), F.lit(0).cast("bigint").alias("_group"),
                            (-F.col("population")).alias("_a"), F.col("name").alias("_b"), F.col("id").alias("_c"))
    aliases = (names.filter("entity_type = 'city'").withColumn("_name", lookup_key(F.col("name")))
               .filter(F.col("_name").isNotNull()))
    first_seen = aliases.groupBy("_name").agg(F.min("id").alias("_group"))
    people = cities.select(F.col("id").alias("entity_id"), "population")
    by_alias = (aliases.select("_name", "entity_id", F.col("id").alias("_c")).join(first_seen, "_name").join(people, "entity_id")
                .select(F.explode(_prefixes(F.col("_name"))).alias("_key"), F.col("entity_id").alias("city_id"),
                        F.lit(1).alias("_phase"), F.col("_group").cast("bigint"), (-F.col("population")).alias("_a"),
                        F.lit("").alias("_b"), "_c"))
    order = F.struct("_phase", "_group", "_a", "_b", "_c")
    hits = (wanted.join(by_name.unionByName(by_alias), "_key").groupBy(query, "city_id").agg(F.min(order).alias("_o")))
    top = top_per_key(hits, [query], [F.col("_o")], limit, "_n").select(query, "city_id")
    named = top.join(cities.select(F.col("id").alias("city_id"), "name", "population"), "city_id")
    return top_per_key(named, [query], [F.desc("population"), F.asc("name"), F.asc("city_id")], limit)


def search_countries(queries: DataFrame, countries: DataFrame, limit: int, query: str = "query") -> DataFrame:
    """Up to ``limit`` countries per prefix of name or code, by name."""
    wanted = queries.select(query).distinct().withColumn("_key", F.lower(F.trim(query)))
    keys = countries.select(F.explode(F.array_union(_prefixes(F.lower("name")), _prefixes(F.lower("iso_code")))).alias("_key"),
                            F.col("id").alias("country_id"), "name")
    return top_per_key(wanted.join(keys, "_key").drop("_key"), [query], [F.asc("name"), F.asc("country_id")], limit)


def country_anchor(countries: DataFrame, cities: DataFrame) -> DataFrame:
    """Position of the most populous capital, else the centre of the country's box; ties go to the first by name and id."""
    seat = (cities.filter("capital").groupBy("country_id")
            .agg(F.min_by(F.struct("lat", "lon"), F.struct(-F.col("population"), "name", "id")).alias("_s")))
    joined = countries.join(seat.withColumnRenamed("country_id", "id"), "id", "left")
    return joined.select("id", F.coalesce("_s.lat", (F.col("min_lat") + F.col("max_lat")) / 2.0).alias("lat"),
                         F.coalesce("_s.lon", (F.col("min_lon") + F.col("max_lon")) / 2.0).alias("lon"))


def alternate_names(cities: DataFrame, alternates: str = "alternate_names", ascii_name: str = "ascii_name", most: int | None = None) -> DataFrame:
    """Names of each city: the plain one first, then the listed ones, distinct; all of them unless ``most`` is given."""
    listed = F.transform(F.split(F.coalesce(F.col(alternates), F.lit("")), ","), blank_to_null)
    names = F.array_distinct(F.array_compact(F.concat(F.array(blank_to_null(F.col(ascii_name))), listed)))
    names = names if most is None else F.slice(names, 1, most)
    return cities.select(F.lit("city").alias("entity_type"), F.col("id").alias("entity_id"),
                         F.posexplode(names).alias("position", "name"))


def select_city_markers(cities: DataFrame, limit: int | None = None, min_population: int = 0) -> DataFrame:
    """All capitals, plus the other cities, only the most populous ones if a limit is given."""
    rest = cities.filter(~F.col("capital") & (F.col("population") >= min_population))
    rest = rest if limit is None else rest.orderBy(*population_order()).limit(limit)
    return cities.filter("capital").unionByName(rest)


def boundary_coverage(countries: DataFrame) -> DataFrame:
    """One row: box around all countries, the world when there are none."""
    return countries.agg(F.coalesce(F.min("min_lat"), F.lit(-90.0)).alias("min_lat"),
                         F.coalesce(F.min("min_lon"), F.lit(-180.0)).alias("min_lon"),
                         F.coalesce(F.max("max_lat"), F.lit(90.0)).alias("max_lat"),
                         F.coalesce(F.max("max_lon"), F.lit(180.0)).alias("max_lon"))


def capitals_per_country(countries: DataFrame, cities: DataFrame, examples: int | None = None) -> DataFrame:
    """Number of capitals of each country with their names, only the first ``examples`` if given."""
    capitals = cities.filter("capital").select("country_id", F.col("name").alias("city"), F.col("id").alias("city_id"))
    counts = capitals.groupBy("country_id").agg(F.count("*").alias("capitals"))
    listed = capitals if examples is None else top_per_key(capitals, ["country_id"], [F.asc("city_id")], examples)
    shown = (listed.groupBy("country_id")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("city_id", "city"))), lambda s: s["city"]),
                               ", ").alias("names")))
    return (countries.select(F.col("id").alias("country_id"), "name").join(counts, "country_id", "left")
            .join(shown, "country_id", "left")
            .select("country_id", "name", F.coalesce("capitals", F.lit(0)).alias("capitals"), "names"))
