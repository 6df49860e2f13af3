"""URL filters over time: dated list entries become validity intervals, and each capture is held against the entries that
were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Intervals and captures meet by key and by period of so many seconds.
PERIOD = 7 * 86_400
ALLOW = "allow"
#: Bytes of the lists' keys up to which they are broadcast, so that captures' other keys go no further.
MOST_KEY_BYTES = 8 << 20


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dots; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.*(?::[0-9]*)?(?:[/?#]|$)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column) -> Column:
    """All keys that a list entry for this URL may have: its host, each parent domain, and host with each path prefix."""
    labels = F.split(host(url), r"\.")
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    return F.when(host(url) != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(log: DataFrame) -> DataFrame:
    """(list, key, start, stop) from dated entries (list, key, at, added): an addition holds until the next removal, and
    forever (stop is null) without one. Of entries of one second the removal counts, and nulls count for nothing.
    Entries of a key are followed within periods and then from period to period, so that no key's whole log is sorted
    in one task. Intervals of a key don't overlap."""
    second = log.select("list", "key", F.unix_seconds(F.col("at").cast("timestamp")).alias("at"), "added").where("list IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL AND added IS NOT NULL")
    entries = second.groupBy("list", "key", "at").agg(F.bool_and("added").alias("added")).withColumn("period", F.floor(F.col("at") / PERIOD))
    by = ["list", "key"]
    # what held at a period's start, and when the next removal after its end comes
    sums = entries.groupBy(*by, "period").agg(F.max_by("added", "at").alias("last"), F.min(F.when(~F.col("added"), F.col("at"))).alias("removal"))
    order = Window.partitionBy(*by).orderBy("period")
    sums = sums.select(*by, "period", F.coalesce(F.lag("last").over(order), F.lit(False)).alias("before"), F.min("removal").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    inside = Window.partitionBy(*by, "period").orderBy("at")
    held = entries.join(sums, [*by, "period"]).withColumns({"was": F.coalesce(F.lag("added").over(inside), "before"), "next": F.coalesce(F.min(F.when(~F.col("added"), F.col("at"))).over(inside.rowsBetween(1, Window.unboundedFollowing)), "later")})
    return held.where("added AND NOT was").select(*by, F.col("at").alias("start"), F.col("next").alias("stop"))


def listed(captures: DataFrame, log: DataFrame) -> DataFrame:
    """captures (url and fetched_at; any other columns stay) with lists (sorted names of the lists that held the URL when
    it was fetched, '' for none), n_lists and blocked (on a list, and not on the one named allow).

    A null or malformed URL and a null time match nothing. Repeated captures each keep their row. Columns named lists,
    n_lists or blocked are replaced. Empty tables give no rows, or no lists.
    """
    names = [c for c in captures.columns if c not in ("lists", "n_lists", "blocked")]
    rows = common.stored(captures.select(F.struct(*names).alias("capture"), "url", F.unix_seconds(F.col("fetched_at").cast("timestamp")).alias("t")).withColumn("row", F.monotonically_increasing_id()), "captures")
    last = rows.agg(F.max("t")).first()[0]
    wanted = rows.where("t IS NOT NULL").select("row", "t", F.floor(F.col("t") / PERIOD).alias("period"), F.explode(keys(F.col("url"))).alias("key"))
    held = common.stored(intervals(log).where(F.col("start") <= F.lit(last)), "intervals")
    # a top-level domain or a host that no list names is most of what captures ask for
    known = held.select("key").distinct()
    size = known.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    wanted = wanted.join(F.broadcast(known) if size <= MOST_KEY_BYTES else known, "key", "left_semi")
    span = held.withColumn("end", F.least(F.coalesce(F.col("stop") - 1, F.lit(last)), F.lit(last)))
    span = span.select("list", "key", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / PERIOD), F.floor(F.col("end") / PERIOD))).alias("period"))
    hit = wanted.join(span, ["key", "period"]).where("start <= t AND (stop IS NULL OR t < stop)").groupBy("row").agg(F.array_sort(F.collect_set("list")).alias("found"))
    out = rows.join(hit, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return out.select("capture.*", F.array_join("found", ",").alias("lists"), F.size("found").cast("long").alias("n_lists"), ((F.size("found") > 0) & ~F.array_contains("found", ALLOW)).alias("blocked"))


def captures(pages: DataFrame) -> DataFrame:
    """Each page with the minute of January 2024 at which it counts as fetched, by its page_id."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(43_200))
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minute.cast("int"))).alias("fetched_at"))


def list_log(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Events as entries of lists: the page whose id is the event's user names the host, domain or first directory that
    is listed; views allow and other kinds block; every fourth event removes."""
    url = F.col("url")
    domain = F.array_join(F.slice(F.split(host(url), r"\."), -2, 2), ".")
    directory = F.concat(host(url), F.lit("/"), F.element_at(F.filter(F.split(path(url), "/"), lambda x: x != ""), 1))
    key = F.when(F.pmod("event_id", F.lit(3)) == 0, host(url)).when(F.pmod("event_id", F.lit(3)) == 1, domain).otherwise(directory)
    joined = events.join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id")
    return joined.select(F.when(F.col("event_type") == "view", ALLOW).otherwise(F.col("event_type")).alias("list"), key.alias("key"), F.col("ts").alias("at"), (F.pmod("event_id", F.lit(4)) != 0).alias("added"))


def op8_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    out = listed(captures(pages), list_log(common.table(spark, sf_dir, "events"), pages))
    return out.select("page_id", F.unix_seconds("fetched_at").alias("fetched_s"), "lists", "n_lists", "blocked")


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.*(?::[0-9]*)?(?:[/?#]|$)', 1))"
_SEGMENTS = r"list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '')"
OP8_SQL = rf"""
WITH p AS (SELECT page_id, url, row_number() OVER () AS rid, {_HOST} AS host, {_SEGMENTS} AS segs, epoch(TIMESTAMP '2024-01-01')::BIGINT + 60 * (page_id * 7919 % 43200) AS t FROM pages),
log AS (SELECT CASE WHEN event_type = 'view' THEN '{ALLOW}' ELSE event_type END AS list,
  CASE event_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE host || '/' || segs[1] END AS key,
  floor(epoch(ts))::BIGINT AS sec, event_id % 4 <> 0 AS added FROM events JOIN p ON user_id = page_id),
one AS (SELECT list, key, sec AS ts, bool_and(added) AS added FROM log WHERE key IS NOT NULL GROUP BY ALL),
cap AS (SELECT rid, t, host AS key FROM p WHERE host <> ''
  UNION SELECT rid, t, array_to_string(string_split(host, '.')[i:], '.') FROM p, range(1, 10) r(i) WHERE host <> '' AND i <= len(string_split(host, '.'))
  UNION SELECT rid, t, host || '/' || array_to_string(segs[1:i], '/') FROM p, range(1, 10) r(i) WHERE host <> '' AND i <= len(segs)),
state AS (SELECT cap.rid, one.list, arg_max(one.added, one.ts) AS added FROM cap JOIN one USING (key) WHERE one.ts <= cap.t GROUP BY cap.rid, one.list, cap.key),
found AS (SELECT rid, list_sort(list(DISTINCT list)) AS ls FROM state WHERE added GROUP BY rid)
SELECT page_id, t AS fetched_s, coalesce(array_to_string(ls, ','), '') AS lists, coalesce(len(ls), 0)::BIGINT AS n_lists, ls IS NOT NULL AND NOT list_contains(ls, '{ALLOW}') AS blocked FROM p LEFT JOIN found USING (rid)
"""

QUERIES = {"op8_temporal_list_join": op8_temporal_list_join}
ORACLES = {"op8_temporal_list_join": OP8_SQL}
