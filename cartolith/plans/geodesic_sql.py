"""The ellipsoidal distance in SQL: the iteration is a recursive table."""

from __future__ import annotations

from cartolith.functions.geodesy import MEAN_RADIUS, WGS84_A, WGS84_B, WGS84_F

_E2 = (WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2


def geodesic_tables(pairs: str) -> str:
    """Tables pairs and geodesic (pid, meters) for a query of (pid, lat1, lon1, lat2, lon2); they need WITH RECURSIVE.

    Every round works out length and next longitude of the pairs that have not settled; those that never do, nearly
    antipodal ones, take the spherical distance.
    """
    return f"""pairs AS ({pairs}),
rounds AS (
 SELECT pid, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, span, span AS lam, 0 AS n, false AS done, 0e0 AS meters FROM (
  SELECT pid, atan((1 - {WGS84_F!r}) * tan(radians(lat1))) AS u1, atan((1 - {WGS84_F!r}) * tan(radians(lat2))) AS u2, radians(lon2) - radians(lon1) AS span FROM pairs)
 UNION ALL
 SELECT pid, s1, c1, s2, c2, span, lam2, n + 1, abs(lam2 - lam) < 1e-12 OR sin_s = 0,
  CASE WHEN sin_s = 0 THEN 0e0 ELSE {WGS84_B!r} * (1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))) * (sigma - big_b * sin_s * (mid + big_b / 4 * (
   cos_s * (2 * mid * mid - 1) - big_b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))) END
 FROM (SELECT *, span + (1 - c) * {WGS84_F!r} * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1))) AS lam2, u / 1024 * (256 + u * (u * (74 - 47 * u) - 128)) AS big_b
  FROM (SELECT *, {WGS84_F!r} / 16 * q * (4 + {WGS84_F!r} * (4 - 3 * q)) AS c, q * {_E2!r} AS u, CASE WHEN q = 0 THEN 0e0 ELSE cos_s - 2 * s1 * s2 / q END AS mid
   FROM (SELECT *, 1 - sin_a * sin_a AS q
    FROM (SELECT *, atan2(sin_s, cos_s) AS sigma, CASE WHEN sin_s = 0 THEN 0e0 ELSE c1 * c2 * sin(lam) / sin_s END AS sin_a
     FROM (SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS sin_s, s1 * s2 + c1 * c2 * cos(lam) AS cos_s
      FROM rounds WHERE NOT done AND n < 200)))))),
geodesic AS (
 SELECT p.pid, coalesce(g.meters, asin(least(1e0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) * {2 * MEAN_RADIUS!r}) AS meters
 FROM pairs p LEFT JOIN (SELECT pid, meters FROM rounds WHERE done) g ON g.pid = p.pid)"""


def recursive(sql: str) -> str:
    """The query with its first WITH made recursive."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
