"""Text normalisation and human-readable fragments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def lookup_key(value: Column) -> Column:
    """Trimmed lower-case key, NULL when blank."""
    return F.lower(blank_to_null(value))


def iso_code(value: Column) -> Column:
    """Two-letter code in upper case, NULL when it is not one."""
    code = F.upper(F.trim(value))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def distance_text(meters: Column, decimals: int = 1) -> Column:
    return F.when(meters >= 1000.0, F.format_string(f"%.{decimals}f km", meters / 1000.0)).otherwise(
        F.format_string("%.0f m", meters))


def city_detail(country: Column, capital: Column, population: Column) -> Column:
    """'Capital of X -- population 1,234', leaving out what is unknown."""
    seat = F.concat_ws(" of ", F.when(capital, "Capital"), country)
    people = F.when(population > 0, F.concat(F.lit("population "), F.format_number(population, 0)))
    return F.concat_ws(" -- ", F.nullif(seat, F.lit("")), people)
