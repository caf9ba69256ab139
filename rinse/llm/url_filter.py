"""Temporal URL filter lists (DataFrame functions only).

A list is a history of dated entries: on some day a host, a domain with its
subdomains, or a URL prefix is added or removed.  The history becomes
validity intervals ``[valid_from, valid_to)``, and every capture is joined as
of its fetch day with the intervals of the keys it could match: its URL's
host, every parent domain, and every path prefix that ends at a slash.

A list may be as large as the corpus, so the join carries no broadcast hint:
adaptive execution broadcasts the intervals if their measured size is small,
else it sort-merges on the key and splits a key with very many captures.
Entries are first reduced to the last action per key and day, so the interval
window holds at most one row per key and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """``key, valid_from, valid_to, list`` from ``key, list, action, day, seq``.

    ``action`` is ``add`` or ``remove``.  Of several entries of one key, list and
    day the one with the largest ``seq`` counts (on a tie ``remove``).  An add
    stays valid until the next entry of its key and list; ``valid_to`` is NULL
    while there is none.  Entries with a NULL key, list, action or day are void.
    """
    e = entries.select("key", "list", "action", "day", "seq").dropna(subset=["key", "list", "action", "day"])
    daily = e.groupBy("key", "list", "day").agg(F.max(F.struct("seq", "action")).alias("last"))
    nxt = F.lead("day").over(Window.partitionBy("key", "list").orderBy("day"))
    return (daily.select("key", "list", "day", F.col("last.action").alias("action"), nxt.alias("valid_to"))
            .filter(F.col("action") == "add").select("key", "list", F.col("day").alias("valid_from"), "valid_to"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-case host (no user, port or final dot) and path of a URL."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def lookup_keys(host: Column, path: Column) -> Column:
    """Every key a capture can match, as an array: ``host:h``, ``domain:d``, ``prefix:h/p/``."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))),
                           lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes))


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: ``page_id, url, fetch_day, n_active, matched, blocked``.

    ``n_active`` counts the entries active on the fetch day that match.  The
    longest matching key decides (``matched``; on a tie the larger string), and
    the capture is blocked if that key is on the ``block`` list and not on the
    ``allow`` list.  A capture with a NULL url or day matches nothing.  Captures
    are told apart by a row number of their own, so repeated ids stay separate
    rows; other columns are ignored.  A URL has a key for every path step, so the
    keys of a very long one take memory by the square of its steps.  No captures give no rows; no entries match nothing.
    """
    cap = captures.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "fetch_day")
    host, path = url_parts(F.col("url"))
    keyed = (cap.withColumn("host", host).withColumn("path", path)
             .withColumn("key", F.explode_outer(lookup_keys(F.col("host"), F.col("path")))).drop("host", "path"))
    active = intervals(entries)
    joined = keyed.join(active, (keyed["key"] == active["key"]) & (keyed["fetch_day"] >= active["valid_from"])
                        & (active["valid_to"].isNull() | (keyed["fetch_day"] < active["valid_to"])), "left")
    hit = F.col("list").isNotNull()
    best = F.max(F.when(hit, F.struct(F.length(keyed["key"]).alias("n"), keyed["key"].alias("key"),
                                      (F.col("list") == "allow").alias("allow"))))
    out = joined.groupBy("row", "page_id", "url", "fetch_day").agg(F.count(F.when(hit, 1)).alias("n_active"), best.alias("best"))
    return out.select("page_id", "url", "fetch_day", "n_active", F.col("best.key").alias("matched"),
                      F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from the pages table: it has no fetch day, so the id gives one."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
                        .alias("fetch_day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list history from the pages table: every page names a host, a domain or a prefix on a dated day.

    A prefix takes its host and, by the page id, none to three path steps (as many as the path has
    before its last slash).  A page without a URL or id names nothing."""
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), F.split(path, "/").alias("steps"))
    kind = F.pmod("page_id", F.lit(7))
    depth = F.greatest(F.least(F.pmod("page_id", F.lit(4)).cast("int") + 1, F.size("steps") - 1), F.lit(1))
    key = (F.when(kind < 2, F.concat(F.lit("host:"), "host"))
            .when(kind < 4, F.concat(F.lit("domain:"), F.regexp_replace("host", r"^[^.]*\.", "")))
            .when(kind < 7, F.concat(F.lit("prefix:"), "host", F.array_join(F.slice("steps", F.lit(1), depth), "/"), F.lit("/"))))
    return (p.select(key.alias("key"), F.when(F.pmod("page_id", F.lit(5)) == 0, "allow").otherwise("block").alias("list"),
                     F.when(F.pmod("page_id", F.lit(3)) == 0, "remove").otherwise("add").alias("action"),
                     F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 11, F.lit(366)).cast("int")).alias("day"),
                     F.col("page_id").alias("seq")).filter("key IS NOT NULL"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
split AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '^.*@', ''), '\.?(:[0-9]*)?$', '') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetch_day FROM parts),
history AS (
  SELECT CASE WHEN page_id % 7 < 2 THEN 'host:' || host
              WHEN page_id % 7 < 4 THEN 'domain:' || regexp_replace(host, '^[^.]*\.', '')
              ELSE 'prefix:' || host || array_to_string(string_split(path, '/')
                   [:greatest(least(page_id % 4 + 1, len(string_split(path, '/')) - 1), 1)], '/') || '/' END AS key,
         CASE WHEN page_id % 5 = 0 THEN 'allow' ELSE 'block' END AS list,
         CASE WHEN page_id % 3 = 0 THEN 'remove' ELSE 'add' END AS action,
         DATE '2024-01-01' + CAST((page_id * 11) % 366 AS INTEGER) AS day, page_id AS seq
  FROM split),
effective AS (
  SELECT h.* FROM history h WHERE NOT EXISTS (
    SELECT 1 FROM history o WHERE o.key = h.key AND o.list = h.list AND o.day = h.day AND o.seq > h.seq)),
keys AS (
  SELECT page_id, 'host:' || host AS key FROM split
  UNION SELECT page_id, 'domain:' || array_to_string(string_split(host, '.')[i:], '.')
        FROM split, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i)
  UNION SELECT page_id, 'prefix:' || host || array_to_string(string_split(path, '/')[:i], '/') || '/'
        FROM split, unnest(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1)) AS t(i)),
past AS (
  SELECT k.page_id, k.key, e.list, e.action,
         row_number() OVER (PARTITION BY k.page_id, k.key, e.list ORDER BY e.day DESC) AS back
  FROM keys k JOIN split s ON s.page_id = k.page_id JOIN effective e ON e.key = k.key AND e.day <= s.fetch_day),
live AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, key DESC, list) AS best,
         count(*) OVER (PARTITION BY page_id) AS n FROM past WHERE back = 1 AND action = 'add')
SELECT s.page_id, s.url, s.fetch_day, CAST(coalesce(l.n, 0) AS BIGINT) AS n_active, l.key AS matched,
       coalesce(l.list = 'block', false) AS blocked
FROM split s LEFT JOIN live l ON l.page_id = s.page_id AND l.best = 1
"""
