"""Distances and bearings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

# WGS84 ellipsoid and mean sphere.
WGS84_A = 6_378_137.0
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
MEAN_RADIUS = 6_371_008.8
METERS_PER_DEGREE = 111_320.0

# Compass rose, clockwise from north.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(chord))) * (2.0 * MEAN_RADIUS)


def _haversine_np(lat1, lon1, lat2, lon2):
    a = (np.sin((lat2 - lat1) / 2.0) ** 2
         + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2.0) ** 2)
    return 2.0 * MEAN_RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def vincenty_np(lat1, lon1, lat2, lon2, max_iterations: int = 200, tolerance: float = 1e-12):
    """Inverse geodesic on the WGS84 ellipsoid for whole arrays (Vincenty 1975).

    Pairs that have converged leave the working set; pairs that never do (nearly
    antipodal ones) take the spherical distance.
    """
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(v, dtype=float)) for v in (lat1, lon1, lat2, lon2))
    result = _haversine_np(lat1, lon1, lat2, lon2)
    todo = np.flatnonzero(np.isfinite(result))
    u1, u2 = (np.arctan((1.0 - WGS84_F) * np.tan(v)) for v in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = lon2 - lon1
    lam = span.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(max_iterations):
            if todo.size == 0:
                break
            a1, b1, a2, b2 = s1[todo], c1[todo], s2[todo], c2[todo]
            sin_l, cos_l = np.sin(lam[todo]), np.cos(lam[todo])
            sin_s = np.hypot(b2 * sin_l, b1 * a2 - a1 * b2 * cos_l)
            same = sin_s == 0.0
            cos_s = a1 * a2 + b1 * b2 * cos_l
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(same, 0.0, b1 * b2 * sin_l / sin_s)
            cos2_a = 1.0 - sin_a * sin_a
            mid = np.where(cos2_a == 0.0, 0.0, cos_s - 2.0 * a1 * a2 / cos2_a)
            c = WGS84_F / 16.0 * cos2_a * (4.0 + WGS84_F * (4.0 - 3.0 * cos2_a))
            new = span[todo] + (1.0 - c) * WGS84_F * sin_a * (
                sigma + c * sin_s * (mid + c * cos_s * (2.0 * mid * mid - 1.0)))
            done = np.abs(new - lam[todo]) < tolerance
            lam[todo] = new
            u_sq = cos2_a * (WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2
            big_a = 1.0 + u_sq / 16384.0 * (4096.0 + u_sq * (u_sq * (320.0 - 175.0 * u_sq) - 768.0))
            big_b = u_sq / 1024.0 * (256.0 + u_sq * (u_sq * (74.0 - 47.0 * u_sq) - 128.0))
            delta = big_b * sin_s * (mid + big_b / 4.0 * (
                cos_s * (2.0 * mid * mid - 1.0)
                - big_b / 6.0 * mid * (4.0 * sin_s * sin_s - 3.0) * (4.0 * mid * mid - 3.0)))
            length = np.where(same, 0.0, WGS84_B * big_a * (sigma - delta))
            finished = done | same
            result[todo[finished]] = length[finished]
            todo = todo[~finished]
    return result


@F.pandas_udf(T.DoubleType())
def _vincenty_udf(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    meters = pd.Series(vincenty_np(lat1, lon1, lat2, lon2))
    return meters.where(np.isfinite(meters), None)


def vincenty_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Ellipsoidal distance; feed it only the pairs that survived a cheaper test."""
    return _vincenty_udf(lat1, lon1, lat2, lon2)


def register_geodesy(spark: SparkSession) -> None:
    """Expose the ellipsoidal distance to SQL."""
    spark.udf.register("vincenty_m", _vincenty_udf)


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    phi1, phi2, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(turn)
    return (F.degrees(F.atan2(east, north)) + 360.0) % 360.0


def compass_point(bearing: Column) -> Column:
    """One of sixteen points."""
    sector = F.floor(F.pmod(bearing, F.lit(360.0)) / 22.5 + 0.5) % 16
    return F.element_at(F.array(*[F.lit(p) for p in COMPASS]), (sector + 1).cast("int"))


def flat_squared_degrees(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Cheap comparable distance: squared degrees, longitude shrunk by the first latitude.

    The remainder is taken as SQL does it, step by step: two places on either side of a point tie in the last bit.
    """
    d_lat = other_lat - lat
    d_lon = (((other_lon - lon + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) * F.cos(F.radians(lat))
    return d_lat * d_lat + d_lon * d_lon
