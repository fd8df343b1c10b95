"""URL filters by dated lists: entries become validity intervals, and captures meet those active at fetch time.

An entry switches a list's key on or off from a moment on; a key is a host, a domain with all below it, or a URL prefix. The
switches of one key become disjoint intervals, cut at the borders of time slices. A capture looks up all its possible
keys in the slice of its fetch time: an equi-join on key and slice, with the interval as a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.session import materialise

_SCOPES = {"domain": 1, "host": 2, "prefix": 3}  # the more specific wins
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host(url: Column | str) -> Column:
    """Lower-case host; empty if there is none."""
    return F.lower(F.regexp_extract(url, _URL, 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(url, _URL, 2)


def _key(scope: str, value: Column) -> Column:
    return F.concat(F.lit(scope + " "), value)


def capture_keys(url: Column | str) -> Column:
    """All keys under which an entry could name a URL: its host, the host and its parents as domains, its path's prefixes.

    Prefixes end behind a slash, or are the whole path.
    """
    labels, steps = F.split(host(url), r"\."), F.split(path(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: _key("prefix", F.concat(
        host(url), F.array_join(F.slice(steps, F.lit(1), i), "/"), F.when(i < F.size(steps), "/").otherwise(""))))
    return F.when(host(url) != "", F.array_distinct(F.concat(F.array(_key("host", host(url))), domains, prefixes)))


def validity(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) of entries (list, scope, value, at, active): when each key is on; until is null if still on.

    Of entries for one key at one moment, off wins. Entries with a null or an unknown scope are left out.
    """
    known = (entries.where(F.col("scope").isin(*_SCOPES) & F.col("list").isin("block", "allow") & F.col("at").isNotNull() & F.col("active").isNotNull()
                           & F.col("value").isNotNull())
             .select("list", F.concat_ws(" ", "scope", F.when(F.col("scope") == "prefix", F.col("value")).otherwise(F.lower("value"))).alias("key"), "at", "active"))
    states = known.groupBy("list", "key", "at").agg(F.min("active").alias("active"))
    order = Window.partitionBy("list", "key").orderBy("at")
    return states.withColumn("until", F.lead("at").over(order)).where("active").select("list", "key", F.col("at").alias("since"), "until")


def url_verdicts(captures: DataFrame, entries: DataFrame, slices: int = 64) -> DataFrame:
    """(page_id, url, fetched, captures, verdict, matched) for captures (page_id, url, fetched).

    verdict is that of the most specific key on at fetch time (prefix before host before domain, longer before shorter,
    allow before block); ``none`` without one. matched is that key.
    * equal captures give one row with their number in ``captures``; null page ids are kept
    * a null url, one without a host, or a null fetch time meets no entry; urls of any length are looked up whole
    * extra columns are ignored; no captures give no rows, no entries give ``none`` everywhere
    """
    own = captures.select("page_id", "url", F.col("fetched").cast("timestamp").alias("fetched"))
    spans = materialise(validity(entries), "validity")
    first, last = own.agg(F.min(F.unix_micros("fetched")), F.max(F.unix_micros("fetched"))).first()
    first, last = first or 0, last or 0
    width = max(1, -(-(last + 1 - first) // slices))

    def slice_of(moment: Column) -> Column:
        return F.floor((moment - F.lit(first)) / F.lit(width)).cast("int")

    ends = F.coalesce(F.unix_micros("until") - 1, F.lit(last))  # no capture is later
    cut = (spans.withColumn("low", F.greatest(slice_of(F.unix_micros("since")), F.lit(0))).withColumn("high", F.least(slice_of(ends), F.lit(slices)))
           .where("low <= high").select("list", "key", "since", "until", F.explode(F.sequence("low", "high")).alias("slice")))
    rows = own.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("captures"))
    asked = (rows.withColumn("slice", slice_of(F.unix_micros("fetched")))
             .select("page_id", "url", "fetched", "captures", "slice", F.explode_outer(capture_keys("url")).alias("key")))
    met = asked.join(cut, ["key", "slice"], "left")
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    scope = F.split("key", " ")[0]
    weight = F.coalesce(*[F.when(scope == s, F.lit(w)) for s, w in _SCOPES.items()])
    best = F.max(F.when(active, F.struct(weight.alias("scope"), F.length("key").alias("length"), (F.col("list") == "allow").alias("allowed"), F.col("key"))))
    return (met.groupBy("page_id", "url", "fetched", "captures").agg(best.alias("best"))
            .select("page_id", "url", "fetched", "captures",
                    F.when(F.col("best").isNull(), "none").when(F.col("best.allowed"), "allow").otherwise("block").alias("verdict"),
                    F.col("best.key").alias("matched")))


# the registered query ---------------------------------------------------------------------------------------------------
# The given tables have neither fetch times nor lists; both follow from the pages by fixed arithmetic.

_DAY = 86_400


def _captures(pages: DataFrame) -> DataFrame:
    seconds = F.pmod(F.col("page_id") * 13, F.lit(30)) * _DAY + F.pmod(F.col("page_id") * 7919, F.lit(_DAY))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("fetched"))


def _entries(pages: DataFrame) -> DataFrame:
    """Blocked hosts that come and go, blocked parent domains, and allowed sections of hosts."""
    hosts = pages.where(host("url") != "").groupBy(host("url").alias("host")).agg(F.min("page_id").alias("n"))
    section = pages.where(host("url") != "").select(host("url").alias("host"), F.regexp_extract(path("url"), "^(/[^/]*/)", 1).alias("part")).where("part <> ''").distinct()

    def entry(frame, list_, scope, value, day, active):
        at = F.timestamp_seconds(F.lit(1_704_067_200) + day * _DAY)
        return frame.select(F.lit(list_).alias("list"), F.lit(scope).alias("scope"), value.alias("value"), at.alias("at"), F.lit(active).alias("active"))

    n, name = F.col("n"), F.col("host")
    parts = [
        entry(hosts.where(n % 3 == 0), "block", "host", name, n * 7 % 20, True),
        entry(hosts.where((n % 3 == 0) & (n % 2 == 0)), "block", "host", name, n * 7 % 20 + 5, False),
        entry(hosts.where(n % 12 == 0), "block", "host", name, n * 7 % 20 + 8, True),
        entry(hosts.where((n % 4 == 1) & (F.size(F.split(name, r"\.")) > 3)), "block", "domain", F.regexp_replace(name, r"^[^.]*\.", ""), n % 15, True),
        entry(section.join(hosts, "host").where(n % 5 == 2), "allow", "prefix", F.concat("host", "part"), n * 3 % 25, True),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(_captures(pages), _entries(pages)).select("page_id", "captures", "verdict", "matched")


_SQL_URL = "'^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)'"
OP1_SQL = f"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, {_SQL_URL}, 1)) AS host, regexp_extract(url, {_SQL_URL}, 2) AS path,
        (page_id * 13 % 30) * 86400 + page_id * 7919 % 86400 AS fetched FROM pages),
h AS (SELECT host, min(page_id) AS n FROM p WHERE host <> '' GROUP BY host),
part AS (SELECT DISTINCT host, regexp_extract(path, '^(/[^/]*/)', 1) AS part FROM p WHERE host <> '' AND regexp_extract(path, '^(/[^/]*/)', 1) <> ''),
e AS (
    SELECT 'block' AS list, 2 AS scope, 'host ' || host AS key, (n * 7 % 20) * 86400 AS moment, true AS active FROM h WHERE n % 3 = 0
    UNION ALL SELECT 'block', 2, 'host ' || host, (n * 7 % 20 + 5) * 86400, false FROM h WHERE n % 3 = 0 AND n % 2 = 0
    UNION ALL SELECT 'block', 2, 'host ' || host, (n * 7 % 20 + 8) * 86400, true FROM h WHERE n % 12 = 0
    UNION ALL SELECT 'block', 1, 'domain ' || regexp_replace(host, '^[^.]*\\.', ''), (n % 15) * 86400, true FROM h
        WHERE n % 4 = 1 AND len(string_split(host, '.')) > 3
    UNION ALL SELECT 'allow', 3, 'prefix ' || h.host || part, (n * 3 % 25) * 86400, true FROM h JOIN part ON h.host = part.host WHERE n % 5 = 2),
s AS (SELECT list, scope, key, moment, bool_and(active) AS active FROM e GROUP BY list, scope, key, moment),
v AS (SELECT *, lead(moment) OVER (PARTITION BY list, key ORDER BY moment) AS until FROM s),
k AS (SELECT page_id, url, fetched, 'host ' || host AS key FROM p WHERE host <> ''
    UNION SELECT page_id, url, fetched, 'domain ' || array_to_string(string_split(host, '.')[i:], '.') FROM p, (SELECT unnest(range(1, 40)) AS i)
        WHERE host <> '' AND i <= len(string_split(host, '.'))
    UNION SELECT page_id, url, fetched, 'prefix ' || host || array_to_string(string_split(path, '/')[1:i], '/')
            || CASE WHEN i < len(string_split(path, '/')) THEN '/' ELSE '' END FROM p, (SELECT unnest(range(1, 40)) AS i)
        WHERE host <> '' AND i <= len(string_split(path, '/'))),
m AS (SELECT k.page_id, k.url, k.fetched, v.list, v.key,
        row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched ORDER BY v.scope DESC, length(v.key) DESC, v.list = 'allow' DESC, v.key DESC) AS n
    FROM k JOIN v ON k.key = v.key AND v.active AND v.moment <= k.fetched AND (v.until IS NULL OR k.fetched < v.until))
SELECT c.page_id, c.captures, coalesce(m.list, 'none') AS verdict, m.key AS matched
FROM (SELECT page_id, url, fetched, count(*) AS captures FROM p GROUP BY page_id, url, fetched) c
LEFT JOIN m ON m.n = 1 AND c.page_id = m.page_id AND c.url = m.url AND c.fetched = m.fetched
"""
