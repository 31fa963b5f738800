"""URL filters as a temporal list join.

A list's dated entries become intervals in which they hold: an entry holds from its date until
the next entry of the same key. Keys are hosts' domains and, under a host, path prefixes. Every
capture is held against the entries that are active when it was fetched; of those the one with
the longest key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_intervals(entries: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (exclusive; null: open) from ``entries`` (key, action, listed_at).

    Of entries of one key and one date the greatest action counts ('block' over 'allow').
    Entries with nulls are left out; repeated entries count once.
    """
    once = entries.where("key is not null and action is not null and listed_at is not null").groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    until = F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at"))
    return once.select("key", "action", F.col("listed_at").alias("valid_from"), until.alias("valid_to"))


#: A URL's host, without user, port and closing dots; empty for what is no URL with a host.
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*[^/?#:@.])[.]*(?::[0-9]*)?(?:[/?#]|$)"
#: The same for hosts in brackets (IPv6).
BRACKETED = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\])(?::[0-9]*)?(?:[/?#]|$)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"
#: Addresses have no parent domains.
ADDRESS = "^(?:[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|[^a-z0-9].*)$"


def url_host(url: str = "url") -> Column:
    bracketed = F.regexp_extract(url, BRACKETED, 1)
    return F.lower(F.when(bracketed != "", bracketed).otherwise(F.regexp_extract(url, HOST, 1)))


def url_keys(url: str = "url") -> Column:
    """The keys of a URL: its host's domains of two labels or more (or the bare host or address), and host and path prefixes.

    Users, ports, closing dots of hosts, queries and fragments are no part of keys; null and malformed URLs have none.
    """
    host = url_host(url)
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, "[.]"))
    count = F.size(labels)
    domains = F.when(count < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), count - 1), lambda i: F.array_join(F.slice(labels, i, count), ".")))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    steps = F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(steps, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (capture_id, url, fetched_at) with key and action of the deciding entry, and blocked.

    A null or malformed URL, a null fetch time and a capture without an active entry have
    null key and action and are not blocked. Repeated rows get the same verdict each; other
    columns are ignored. The list is joined on its keys, in whatever way its size allows.
    """
    rows = captures.select("capture_id", "url", "fetched_at")
    asked = rows.distinct().select("capture_id", "url", "fetched_at", F.explode(url_keys()).alias("key"))
    holds = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    active = asked.join(entry_intervals(entries), "key").where(holds)
    verdicts = active.groupBy("capture_id", "url", "fetched_at").agg(F.max(F.struct(F.length("key").alias("length"), "key", "action")).alias("best"))
    verdicts = verdicts.select(F.col("capture_id").alias("__id"), F.col("url").alias("__url"), F.col("fetched_at").alias("__at"), "best.key", "best.action")
    same = rows["capture_id"].eqNullSafe(F.col("__id")) & (rows["url"] == F.col("__url")) & (rows["fetched_at"] == F.col("__at"))
    out = rows.join(verdicts, same, "left").drop("__id", "__url", "__at")
    return out.withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))


#: The list that the query is run with, made from the hosts of pages by a rule: hosts whose md5
#: begins with 0-7 are blocked on a day of January 2024 and, where the third digit is a letter,
#: allowed again some days later; their first path segments are allowed where the second digit
#: is a number; the hosts' parent domain is blocked in May. Days and hours count from 2024-01-01.
LIST_SQL = f"""
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '{HOST}', 1)) AS host FROM pages WHERE url IS NOT NULL),
dated AS (SELECT host, md5(host) AS m FROM hosts WHERE host <> ''),
places AS (SELECT DISTINCT lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment FROM pages WHERE url IS NOT NULL)
SELECT host AS key, 'block' AS action, CAST(ascii(substring(m, 2, 1)) - 48 AS BIGINT) * 24 AS listed_at FROM dated WHERE substring(m, 1, 1) < '8'
UNION ALL SELECT host, 'allow', CAST(ascii(substring(m, 2, 1)) + ascii(substring(m, 4, 1)) - 90 AS BIGINT) * 24 FROM dated WHERE substring(m, 1, 1) < '8' AND substring(m, 3, 1) >= 'a'
UNION ALL SELECT concat(host, '/', segment), 'allow', CAST(ascii(substring(md5(host), 5, 1)) - 40 AS BIGINT) * 24 FROM places WHERE segment <> '' AND substring(md5(host), 2, 1) < 'a'
UNION ALL SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1), 'block', CAST(121 * 24 AS BIGINT) FROM dated WHERE host LIKE '%.%'
"""

#: Captures are fetched at an hour that follows from page_id.
CAPTURE_SQL = "SELECT page_id AS capture_id, url, CAST(page_id * 7919 % 3600 AS BIGINT) AS fetched_at FROM pages"

#: The same in DuckDB: page_id, key, action, blocked.
ORACLE_SQL = f"""
WITH entries AS ({LIST_SQL}), captures AS ({CAPTURE_SQL}),
once AS (SELECT key, listed_at, max(action) AS action FROM entries GROUP BY key, listed_at),
intervals AS (SELECT key, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS valid_to FROM once),
parts AS (
  SELECT *, lower(CASE WHEN regexp_extract(url, '{BRACKETED}', 1) <> '' THEN regexp_extract(url, '{BRACKETED}', 1) ELSE regexp_extract(url, '{HOST}', 1) END) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda s: s <> '') AS segments FROM captures
), keyed AS (
  SELECT capture_id, fetched_at, unnest(list_distinct(list_concat(
    CASE WHEN len(string_split(host, '.')) < 2 OR regexp_matches(host, '{ADDRESS}') THEN [host] ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END,
    list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/'))))) AS key
  FROM parts WHERE host <> ''
), ranked AS (
  SELECT capture_id, k.key, action, row_number() OVER (PARTITION BY capture_id ORDER BY length(k.key) DESC, k.key DESC, action DESC) AS place
  FROM keyed k JOIN intervals i ON k.key = i.key AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
)
SELECT c.capture_id AS page_id, r.key, r.action, coalesce(r.action = 'block', false) AS blocked
FROM captures c LEFT JOIN ranked r ON c.capture_id = r.capture_id AND place = 1
"""
