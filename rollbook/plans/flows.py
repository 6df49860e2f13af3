"""Queries of file sources and sinks, and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources import files
from ..streaming import leads
from .common import table


def a1_layer(spark, sf_dir):
    return files.load_layer(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")


def a2_flattened(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing.value"), F.lit("")).alias("missing"))


def a3_csv_snapshot(spark, sf_dir):
    """Customers, written as CSV and read again with their schema."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows.write.csv(path := files.scratch(spark, "csv"), header=True)
    return files.read_csv(spark, path, rows.schema)


def a4_json_lines(spark, sf_dir):
    """Properties of which every tenth is cut off: good and bad lines by kind of event."""
    lines = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("line"))
    out = files.json_lines(lines, "line", T.StructType([T.StructField("k", T.IntegerType())]))
    return out.groupBy("event_type").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.sum("value.k").alias("total"))


def a5_json_directory(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    rows.write.json(path := files.scratch(spark, "json"))
    return files.read_json_directory(spark, path, rows.schema).drop("snapshot_at")


def a6_submissions(spark, sf_dir):
    """Names and brands of parts in one TSV line each, split again by position."""
    p = table(spark, sf_dir, "part")
    lines = p.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat("p_name", F.lit("／"), "p_type"), F.concat("p_brand", F.lit("／"), F.concat(F.lit("x:"), F.col("p_partkey").cast("string")))).alias("line"))
    cells = F.split("line", "\t")
    zipped = F.arrays_zip(F.split(cells[1], "／").alias("name"), F.split(cells[2], "／").alias("ref"))
    return lines.select(cells[0].cast("bigint").alias("p_partkey"), F.posexplode(zipped).alias("place", "x")).select("p_partkey", "place", "x.name", F.regexp_replace("x.ref", "^x:", "https://x.com/").alias("ref"))


def a7_reviewed_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    withdrawn = table(spark, sf_dir, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("id"))
    return c.unionByName(s, allowMissingColumns=True).join(withdrawn, "id", "left_anti")


def a8_paged_feed(spark, sf_dir):
    """Conversations as feeds with a page for each turn, whose cursor is its length: whether the cursor always grows from
    page to page, whether the bounds of pages and rows hold, and the first row of each text."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.char_length("text").alias("cursor"), "role", "text")
    feeds = files.paged_feed(t, "conv_id", "page", "cursor")
    firsts = t.groupBy("conv_id", "text").agg(F.min_by("role", "page").alias("role")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("role") == "user").alias("n_asked"))
    return feeds.join(firsts, "conv_id")


def a9_saved_leads(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring("html", 1, 500).alias("snippet"), F.lit("pending").alias("status"))


def a10_overwrite(spark, sf_dir):
    """Two writes of one table: the second finds it unchanged."""
    rows = table(spark, sf_dir, "nation")
    path = files.scratch(spark, "layer")
    first, second = files.overwrite_if_changed(rows, path), files.overwrite_if_changed(rows.orderBy(F.desc("n_nationkey")), path)
    return spark.read.schema(rows.schema).parquet(path).select("n_nationkey", "n_name", F.lit(first).alias("written"), F.lit(second).alias("written_again"))


def a11_csv_export(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_acctbal") < 0, "=").otherwise(""), "c_name").alias("name"))
    files.export_csv(rows, path := files.scratch(spark, "export"))
    return spark.read.csv(path, header=True, schema="c_custkey string, name string", escape='"')


def a12_version(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(F.sha2(F.col("n_name").cast("binary"), 256), 1, 16).alias("version"))


def _events(spark, sf_dir):
    return leads.stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def j1_first_seen(spark, sf_dir):
    return leads.drained(leads.first_seen(_events(spark, sf_dir), "user_id", "ts", "60 days").select("user_id"))


def j2_cooldowns(spark, sf_dir):
    failures = _events(spark, sf_dir).where("event_type = 'error'").withColumn("seconds", F.when(F.col("value") > 50, 86400).otherwise(3600))
    return leads.drained(leads.cooldowns(failures, "user_id", "ts", "seconds"), "update").groupBy("host").agg(F.max("until").alias("until"))


def j2_cooldowns_batch(spark, sf_dir):
    """Events of a user that fall into a cooldown from earlier errors."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    until = F.max(F.when(F.col("event_type") == "error", F.col("at") + 3_600_000_000)).over(Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return e.select("event_id", F.coalesce(F.col("at") < until, F.lit(False)).alias("deferred"))


def j3_recovered(spark, sf_dir):
    """Stream of leads (errors by users): those that were turned down in the batch in which their user was throttled, the day of
    the user's first error, wait again."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    batches = errors.groupBy(F.col("user_id").alias("host")).agg(F.min(F.to_date("ts")).alias("batch"))
    status = F.when(F.col("value") > 66, "unavailable:HTTP429").when(F.col("value") > 33, "unavailable:ValueError").otherwise("rejected")
    rows = _events(spark, sf_dir).where("event_type = 'error'").select("event_id", F.col("user_id").alias("host"), status.alias("status"), F.to_date("ts").alias("verified_on"))
    return leads.drained(leads.recovered(rows, batches)).select("event_id", "status")


def j4_daily_counts(spark, sf_dir):
    out = leads.drained(leads.daily_counts(_events(spark, sf_dir), "ts", "event_type", "1 day"), "update")
    out = out.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))  # counts only grow
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def j5_single_flight(spark, sf_dir):
    """One look-up for each distinct key, joined back to all who asked."""
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    found = asked.select("l_partkey").distinct().join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return asked.join(found, "l_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_parts"))


ORACLES = {
    "a1_layer": "SELECT c_custkey, c_name FROM customer",
    "a2_flattened": "SELECT event_id, coalesce((props->>'$.k')::INT, -1) AS k, '' AS missing FROM events",
    "a3_csv_snapshot": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
    "a4_json_lines": "SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS valid, count(*) FILTER (event_id % 10 = 0) AS invalid, (sum((props->>'$.k')::INT) FILTER (event_id % 10 <> 0))::BIGINT AS total FROM events GROUP BY 1",
    "a5_json_directory": "SELECT * FROM supplier",
    "a6_submissions": "SELECT p_partkey, 0 AS place, p_name AS name, p_brand AS ref FROM part UNION ALL SELECT p_partkey, 1, p_type, 'https://x.com/' || p_partkey FROM part",
    "a7_reviewed_union": "SELECT id, name, nation FROM (SELECT c_custkey AS id, c_name AS name, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey FROM supplier) WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)",
    "a8_paged_feed": "WITH p AS (SELECT conv_id, turn, max(length(text)) AS cursor, count(*) AS n FROM conversations GROUP BY 1, 2), f AS (SELECT conv_id, bool_and(coalesce(g, true)) AS monotonic, count(*) AS n_pages, count(*) <= 100 AND max(n) <= 1000 AS within FROM (SELECT *, cursor > lag(cursor) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p) GROUP BY 1), t AS (SELECT conv_id, count(*) AS n_texts, count(*) FILTER (role = 'user') AS n_asked FROM (SELECT conv_id, text, arg_min(role, turn) AS role FROM conversations GROUP BY 1, 2) GROUP BY 1) SELECT * FROM f JOIN t USING (conv_id)",
    "a9_saved_leads": "SELECT page_id, html[1:500] AS snippet, 'pending' AS status FROM pages",
    "a10_overwrite": "SELECT n_nationkey, n_name, true AS written, false AS written_again FROM nation",
    "a11_csv_export": "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_acctbal < 0 THEN '''=' ELSE '' END || c_name AS name FROM customer",
    "a12_version": "SELECT n_nationkey, substr(sha256(n_name), 1, 16) AS version FROM nation",
    "j1_first_seen": "SELECT DISTINCT user_id FROM events",
    "j2_cooldowns": "SELECT user_id::VARCHAR AS host, max(floor(epoch(ts))::BIGINT + CASE WHEN value > 50 THEN 86400 ELSE 3600 END) AS until FROM events WHERE event_type = 'error' GROUP BY 1",
    "j2_cooldowns_batch": "SELECT event_id, coalesce(epoch_us(ts) < max(CASE WHEN event_type = 'error' THEN epoch_us(ts) + 3600000000 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS deferred FROM events",
    "j3_recovered": "SELECT event_id, CASE WHEN value > 33 AND ts::DATE = min(ts::DATE) OVER (PARTITION BY user_id) THEN 'deferred_host_backoff' WHEN value > 66 THEN 'unavailable:HTTP429' WHEN value > 33 THEN 'unavailable:ValueError' ELSE 'rejected' END AS status FROM events WHERE event_type = 'error'",
    "j4_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "j5_single_flight": "SELECT p_brand, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
