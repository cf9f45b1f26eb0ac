"""URL filters against dated lists.

List entries are dated events (list, entry, added or removed). Per list and entry they
become validity intervals [from, to) that don't overlap: an addition while the entry
is active and a removal while it isn't change nothing. A capture is held against the
entries that were active when it was fetched: its host and all parent domains are
looked up, and the interval is found as of the fetch time. Intervals are cut at month
bounds, so the lookup is an equi-join on entry and month, however long an entry's
history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Where captures without a recorded time begin, and the hours over which they are spread.
EPOCH, HOURS = "2024-01-01 00:00:00", 8760


#: An absolute URL up to its host.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/:?#@\[\]]+)"
#: A host that is an address: no part of it is a domain.
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and a dot at its end; an IPv6 address in its brackets; null if there is none."""
    found = F.regexp_extract(F.lower(url), HOST, 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def parents(name: Column) -> Column:
    """A host and the domains that it is in: a.b.c, b.c, c; of an address only itself."""
    parts = F.split(name, r"\.")
    return F.when(name.rlike(ADDRESS), F.array(name)).otherwise(_domains(parts))


def _domains(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))


def intervals(events: DataFrame) -> DataFrame:
    """(list, entry, valid_from, valid_to) from events (list, entry, added boolean, at timestamp).

    Of events of one entry at one time a removal counts last. An open interval ends at
    null. Events with a null list, entry, time or kind are void. The window is per
    entry: its size is an entry's history, whatever the number of captures.
    """
    own = Window.partitionBy("list", "entry").orderBy("at", F.col("added").desc())
    real = events.where("list IS NOT NULL AND entry IS NOT NULL AND at IS NOT NULL AND added IS NOT NULL").select("list", F.lower("entry").alias("entry"), "added", "at").distinct()
    changed = real.withColumn("was", F.coalesce(F.lag("added").over(own), F.lit(False))).where("added <> was")
    spans = changed.select("list", "entry", "added", F.col("at").alias("valid_from"), F.lead("at").over(own).alias("valid_to"))
    return spans.where("added AND (valid_to IS NULL OR valid_from < valid_to)").drop("added")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def filtered(captures: DataFrame, events: DataFrame, page_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(page_id, host, fetched_at, hits, blocked): hits are the active "list:entry" pairs, sorted; one row per capture.

    A capture is blocked if a list whose name begins with "block" hits it and none that
    begins with "allow" does. Without host or time nothing hits. Captures that repeat
    each keep a row. Distinct hosts and hours are looked up once each.
    """
    rows = captures.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), F.col(fetched).alias("fetched_at"))
    asked = rows.where("host IS NOT NULL AND fetched_at IS NOT NULL").select("host", "fetched_at").distinct()
    bounds = asked.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).first()
    if bounds["a"] is None:
        return rows.select("*", F.array().cast("array<string>").alias("hits"), F.lit(False).alias("blocked"))
    first, last = F.lit(bounds["a"]), F.lit(bounds["b"])
    live = intervals(events).where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    months = F.sequence(_month(F.greatest("valid_from", first)), _month(F.least(F.coalesce("valid_to", last), last)))
    cut = live.withColumn("month", F.explode(months))
    names = asked.select("host", "fetched_at", F.explode(parents(F.col("host"))).alias("name"), _month(F.col("fetched_at")).alias("month"))
    on = (names["name"] == cut["entry"]) & (names["month"] == cut["month"]) & (names["fetched_at"] >= cut["valid_from"]) & (cut["valid_to"].isNull() | (names["fetched_at"] < cut["valid_to"]))
    hits = names.join(cut, on).select("host", "fetched_at", F.concat_ws(":", "list", "entry").alias("hit"))
    per = stored(hits.groupBy("host", "fetched_at").agg(F.sort_array(F.collect_set("hit")).alias("hits")), "hits")
    of = lambda kind: F.exists("hits", lambda h: h.startswith(kind))
    joined = rows.join(per, ["host", "fetched_at"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    return joined.select("page_id", "host", "fetched_at", "hits", (of("block") & ~of("allow")).alias("blocked"))


def crawl_time(page_id: Column) -> Column:
    """The pages table records no fetch time; this spreads captures over a year by their ids."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.pmod(page_id * 7919, F.lit(HOURS)) * 3600)


def list_events(captures: DataFrame, url: str = "url") -> DataFrame:
    """Dated entries made from the hosts of ``captures`` by rules on the host's CRC, as snapshots of public lists would give.

    A quarter of the hosts is added to block-a and removed again, an eighth of these
    comes back; a sixteenth is on allow-a for a while; example.org is on block-b for
    April.
    """
    h = captures.select(host(F.col(url)).alias("entry")).where("entry IS NOT NULL").distinct().withColumn("c", F.crc32("entry"))
    at = lambda days: F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + days * 86400)
    day = F.pmod(F.col("c"), F.lit(200))
    event = lambda name, added, when, cond: F.when(cond, F.struct(F.lit(name).alias("list"), F.lit(added).alias("added"), at(when).alias("at")))
    quarter, again, allow = F.col("c") % 4 == 0, F.col("c") % 32 == 0, F.col("c") % 16 == 4
    all_ = F.array(event("block-a", True, day, quarter), event("block-a", False, day + 60, quarter), event("block-a", True, day + 120, again), event("allow-a", True, day + 20, allow), event("allow-a", False, day + 50, allow))
    made = h.select("entry", F.explode(F.filter(all_, lambda e: e.isNotNull())).alias("e")).select("e.list", "entry", "e.added", "e.at")
    fixed = captures.sparkSession.sql("SELECT 'block-b' AS list, 'example.org' AS entry, added, CAST(at AS TIMESTAMP) AS at FROM VALUES (true, '2024-04-01 00:00:00'), (false, '2024-05-01 00:00:00') AS t(added, at)")
    return made.unionByName(fixed)


def op8(spark, sf_dir: str) -> DataFrame:
    """Every page against the list entries of its fetch time."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").withColumn("fetched_at", crawl_time(F.col("page_id")))
    found = filtered(pages, list_events(pages))
    return found.select("page_id", "host", F.unix_timestamp("fetched_at").alias("fetched_s"), F.array_join("hits", ",").alias("hits"), "blocked")


OP8_SQL = f"""
WITH rows AS (
  SELECT page_id, 1704067200 + (page_id * 7919) % 8760 * 3600 AS fetched_s,
         nullif(rtrim(regexp_extract(lower(url), '{HOST}', 1), '.'), '') AS host
  FROM pages
), hosts AS (SELECT DISTINCT host AS entry FROM rows WHERE host IS NOT NULL),
bits AS (  -- CRC-32 by its bitwise definition
  SELECT entry, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(strlen(entry)), lambda k: [ord(entry[k + 1])::BIGINT + 4294967296, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x - 4294967296) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r
  FROM hosts
), c AS (SELECT entry, xor(r, 4294967295) AS c FROM bits),
spans AS (
  SELECT 'block-a' AS list, entry, c % 200 AS a, c % 200 + 60 AS b FROM c WHERE c % 4 = 0
  UNION ALL SELECT 'block-a', entry, c % 200 + 120, 1000000 FROM c WHERE c % 32 = 0
  UNION ALL SELECT 'allow-a', entry, c % 200 + 20, c % 200 + 50 FROM c WHERE c % 16 = 4
  UNION ALL SELECT 'block-b', 'example.org', 91, 121
), hit AS (
  SELECT DISTINCT page_id, host, fetched_s, list || ':' || entry AS hit, list FROM rows JOIN spans
  ON (host = entry OR ends_with(host, '.' || entry) AND NOT regexp_matches(host, '{ADDRESS}')) AND fetched_s >= 1704067200 + a * 86400 AND fetched_s < 1704067200 + b * 86400
), per AS (SELECT page_id, host, fetched_s, string_agg(hit, ',' ORDER BY hit) AS hits, bool_or(list LIKE 'block%') AND NOT bool_or(list LIKE 'allow%') AS blocked FROM hit GROUP BY ALL)
SELECT r.page_id, r.host, r.fetched_s, coalesce(p.hits, '') AS hits, coalesce(p.blocked, false) AS blocked
FROM rows r LEFT JOIN per p ON r.page_id = p.page_id
"""
