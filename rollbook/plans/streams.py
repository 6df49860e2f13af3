"""Queries of versioned layers, of gates that are measured while writing, and of streams into layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as u
from ..sources import versions
from ..sources.files import scratch
from ..streaming import cooldown, leads, queue
from .common import table


def a10_versions(spark, sf_dir):
    """Customers in three versions, of which one is what was there already; a reader that began with the first stays with it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    layer = versions.Layer(spark, scratch(spark, "layer"))
    numbers = [layer.commit(c)]
    pinned = layer.read()
    numbers.append(layer.commit(c.repartition(3)))
    numbers.append(layer.commit(c.where("c_custkey % 3 <> 0").withColumn("c_name", F.upper("c_name"))))
    rows = pinned.select("c_custkey", F.col("c_name").alias("was")).join(layer.read(), "c_custkey", "left")
    return rows.select("c_custkey", "was", F.col("c_name").alias("now"), F.lit(",".join(str(n) for n in numbers)).alias("versions"))


def i_observed_gates(spark, sf_dir):
    """Orders by year, each a version over the one before: what was measured while it was written, and which gates of count,
    share, bytes and growth it didn't pass. A second year may well double the rows, so that bytes are held against them."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    layer = versions.Layer(spark, scratch(spark, "layer"))
    least, most = (o.agg(f("year").alias("y")).first()["y"] for f in (F.min, F.max))
    gates = (versions.rows_within(1, 10**9), versions.share("urgent", F.col("o_orderpriority") == "1-URGENT", 0.1), versions.size_within(10**12, by_row=True), versions.rows_added(5 * 10**8), versions.counters("o_orderstatus", ("F", "O", "P")))
    out = []
    for year in range(least, most + 1):
        layer.commit(o.where(F.col("year") <= year), gates)
        facts = layer.manifest()
        out.append((year, facts["version"], facts["rows"], facts["urgent"], *(facts[f"o_orderstatus={s}"] for s in "FOP"), facts["bytes"] > 0))
    stopped = ""
    try:
        layer.commit(o.where(F.col("year") < most), gates)
    except versions.GateError as e:
        stopped = str(e).split(": ")[-1]
    kind = "year int, version int, n long, urgent long, n_f long, n_o long, n_p long, has_bytes boolean"
    return spark.createDataFrame(out, kind).withColumn("stopped", F.lit(stopped)).withColumn("still", F.lit(layer.read().count()))


def f20_observed_counters(spark, sf_dir):
    """Rows of each kind of event that were accepted or not, counted while the accepted ones and the others are written."""
    e = table(spark, sf_dir, "events").withColumn("state", F.when(F.col("value") > 50, "accepted").otherwise("rejected"))
    e = e.withColumn("of", F.concat_ws("/", "event_type", "state"))
    kinds = tuple(f"{k}/{s}" for k in ("click", "error", "purchase", "signup", "view") for s in ("accepted", "rejected"))
    layer = versions.Layer(spark, scratch(spark, "layer"))
    layer.commit(e.select("event_id", "of"), (versions.counters("of", kinds),))
    facts = layer.manifest()
    return spark.createDataFrame([(*k.split("/"), facts[f"of={k}"]) for k in kinds if facts[f"of={k}"]], "event_type string, state string, n long")


def _queue_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 50, F.col("event_type")).alias("author"))


def j1_queue_upsert(spark, sf_dir):
    """The queue of d22 from a stream of events in batches, of which all run a second time, after the checkpoint was lost."""
    rows = _queue_rows(spark, sf_dir)
    source, layer = scratch(spark, "events"), versions.Layer(spark, scratch(spark, "queue"))
    rows.repartition(20, F.xxhash64("event_id")).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        queue.upserted(stream, layer, "events", scratch(spark, "checkpoint"), "user_id", "event_id", "author").awaitTermination()
    return queue.queued(layer, "user_id", "event_id", "author").select("user_id", "event_id", "event_type", "author")


def _paced_rows(events, time="ts"):
    """Errors of a user are its host's refusals, with a status, some with a time to wait in seconds or as a date, or with
    nonsense; other events are leads. Users come under one of three aliases."""
    e = events.withColumn("ts", F.col(time).cast("timestamp"))
    host = F.concat(F.element_at(F.array(F.lit("https://www."), F.lit("https://m."), F.lit("https://")), (F.col("event_id") % 3 + 1).cast("int")), F.lit("h"), F.col("user_id"), F.lit(".example/a"))
    code = F.when(F.col("value") > 50, 503).otherwise(429)
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 3 HOURS"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    said = F.when(F.col("event_id") % 5 == 0, "7200").when(F.col("event_id") % 5 == 1, later).when(F.col("event_id") % 5 == 2, "soon").when(F.col("event_id") % 5 == 3, "0")
    until = F.when(F.col("event_type") == "error", cooldown.pause_until(F.unix_micros("ts"), code, said))
    return e.select(F.col("event_id").alias("lead"), u.host_key(host).alias("host"), "ts", until.alias("until"))


def j2_paced_stream(spark, sf_dir):
    """Leads that wait for their hosts, by keyed state with timers."""
    rows = _paced_rows(leads.stream(spark, sf_dir, "events"))
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = leads.drained(cooldown.paced(rows, "ts"))
    finally:
        spark.conf.set(key, was)
    return out.groupBy("lead", "host").agg(F.bool_or(F.col("state") != "passed").alias("deferred"), F.max(F.when(F.col("state") == "released", F.col("at"))).alias("released_at"))


def j2_paced_batch(spark, sf_dir):
    """The same from the table."""
    return cooldown.paced_batch(_paced_rows(table(spark, sf_dir, "events")), "ts")


_PACED = """WITH e AS (SELECT event_id AS lead, 'h' || user_id || '.example' AS host, epoch_us(ts) AS mus, event_type = 'error' AS refused, CASE WHEN value > 50 THEN 86400 ELSE 3600 END AS usual FROM events),
r AS (SELECT *, CASE WHEN refused THEN mus + 1000000::BIGINT * CASE lead % 5 WHEN 0 THEN 7200 WHEN 3 THEN 1 ELSE usual END END AS u FROM e),
d AS (SELECT lead, host, mus, refused, CASE WHEN refused AND lead % 5 = 1 THEN (mus // 1000000 + 10800) * 1000000 ELSE u END AS until FROM r),
h AS (SELECT *, coalesce(mus < max(until) OVER (PARTITION BY host ORDER BY mus, NOT refused, lead ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM d),
s AS (SELECT *, sum((NOT held)::INT) OVER (PARTITION BY host ORDER BY mus, NOT refused, lead ROWS UNBOUNDED PRECEDING) AS stretch FROM h),
w AS (SELECT *, max(until) OVER (PARTITION BY host, stretch) AS fin, max(mus) OVER () AS last FROM s)
SELECT lead, host, held AS deferred, CASE WHEN held AND fin <= last THEN fin END AS released_at FROM w WHERE NOT refused"""
ORACLES = {
    "a10_versions": "SELECT c_custkey, c_name AS was, CASE WHEN c_custkey % 3 <> 0 THEN upper(c_name) END AS now, '1,None,2' AS versions FROM customer",
    "i_observed_gates": """WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders), t AS (SELECT y.year, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p
FROM y JOIN orders ON year(o_orderdate) <= y.year GROUP BY 1) SELECT year, row_number() OVER (ORDER BY year)::INT AS version, n, urgent, n_f, n_o, n_p, true AS has_bytes, 'rows added' AS stopped, max(n) OVER () AS still FROM t""",
    "f20_observed_counters": "SELECT event_type, CASE WHEN value > 50 THEN 'accepted' ELSE 'rejected' END AS state, count(*) AS n FROM events GROUP BY ALL",
    "j1_queue_upsert": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(event_type, event_id) FILTER (value > 50) AS author FROM events GROUP BY user_id",
    "j2_paced_stream": _PACED,
    "j2_paced_batch": _PACED,
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
