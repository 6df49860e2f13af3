"""Queries of merges with presence: JSON with free keys, maps, and nulls that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging, overlay
from .common import table


def _when(cond, then, other):
    return F.expr(f"CASE WHEN {cond} THEN {then} ELSE {other} END")


def d10_json_merge(spark, sf_dir):
    """Properties of events as objects with free keys: the base has a number, an object and a list; `collected` counts up,
    corrects and adds; `current` blanks, removes and empties. Either has some events alone."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("e", F.col("event_id"))
    text = lambda k, add, n, src, tags: F.concat(
        F.lit("{ "), F.concat_ws(" ,", k, F.concat(F.lit('"meta": {'), F.concat_ws(",", add, n, F.concat(F.lit('"src":"'), src, F.lit('"'))), F.lit("}")), F.concat(F.lit('"tags": '), tags)), F.lit("}")
    )
    k, null_k, none = F.concat(F.lit('"k": '), "k"), F.lit('"k": null'), F.lit(None).cast("string")
    base = F.when(F.expr("e % 11 <> 0"), text(k, none, F.lit('"n":null'), F.lit("s"), F.lit('["t"]')))
    counted = F.concat(F.lit('"k":'), _when("e % 2 = 0", "k + 1", "k"))
    collected = F.when(F.expr("e % 13 <> 0"), text(counted, F.when(F.expr("e % 3 = 0"), '"add":1'), F.lit('"n":null'), _when("e % 5 = 0", "'new'", "'s'"), F.lit('["t", "n"]')))
    blanked = F.when(F.expr("e % 7 = 0"), null_k).when(F.expr("e % 4 <> 1"), k)
    current = F.when(F.expr("e % 17 <> 0"), text(blanked, none, F.when(F.expr("e % 6 <> 0"), '"n":null'), F.lit("s"), F.when(F.expr("e % 8 = 0"), "[]").otherwise('["t"]')))
    return e.select("event_id", merging.merged_json(base, collected, current).alias("merged"))


def d10_map_merge(spark, sf_dir):
    """Orders as records with a map of facts and the names of the fields that they have. Every seventh order isn't in the
    base, every eleventh not collected and every thirteenth not current."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority").withColumn("i", F.col("id"))

    def side(gone, status, facts, present):
        return o.where(f"i % {gone} <> 0").select("id", status.alias("status"), F.expr(facts).alias("facts"), F.expr(present).alias("present"))

    both = "array('status', 'facts')"
    status = F.col("o_orderstatus")
    base = side(7, status, "map('priority', o_orderpriority, 'old', 'x')", both)
    collected = side(11, status, "map_concat(map('priority', o_orderpriority, 'old', 'x'), CASE WHEN i % 2 = 0 THEN map('seen', 'y') ELSE map() END)", both)
    current = side(13, F.when(F.expr("i % 3 <> 0"), status), "map('priority', CASE WHEN i % 5 = 0 THEN NULL ELSE o_orderpriority END)", f"CASE WHEN i % 4 = 0 THEN array('facts') ELSE {both} END")
    out = overlay.three_way(base, collected, current, "id", present="present")
    entries = F.transform(F.array_sort(F.map_entries("facts")), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null"))))
    return out.select("id", "status", F.array_join(entries, ",").alias("facts"), F.array_join("present", ",").alias("present"))


def d2_presence_overlay(spark, sf_dir):
    """Customers under a layer in which a name may be blanked: it is there and null for every sixth."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    base = c.withColumn("present", F.array(F.lit("name"), F.lit("segment")))
    over = c.where("id % 2 = 0").select("id", F.expr("CASE WHEN id % 6 <> 0 THEN upper(name) END").alias("name"), F.lit(None).cast("string").alias("segment"), F.array(F.lit("name")).alias("present"))
    return overlay.latest_fields([base, over], "id", present="present").select("id", "name", "segment", F.array_join("present", ",").alias("present"))


_EVENTS = """WITH e AS (SELECT event_id, event_id AS e, (props->>'$.k')::INT AS k FROM events),
t AS (SELECT *, '{"k":' || CASE WHEN e % 2 = 0 THEN k + 1 ELSE k END || ',"meta":{' || CASE WHEN e % 3 = 0 THEN '"add":1,' ELSE '' END || '"n":null,"src":"' || CASE WHEN e % 5 = 0 THEN 'new' ELSE 's' END || '"},"tags":["t","n"]}' AS n,
  '{' || CASE WHEN e % 7 = 0 THEN '"k":null,' WHEN e % 4 <> 1 THEN '"k":' || k || ',' ELSE '' END || '"meta":{' || CASE WHEN e % 6 <> 0 THEN '"n":null,' ELSE '' END || '"src":"s"},"tags":' || CASE WHEN e % 8 = 0 THEN '[]' ELSE '["t"]' END || '}' AS c,
  '{' || CASE WHEN e % 7 = 0 THEN '"k":null,' WHEN e % 2 = 0 THEN '"k":' || (k + 1) || ',' WHEN e % 4 <> 1 THEN '"k":' || k || ',' ELSE '' END || '"meta":{' || CASE WHEN e % 3 = 0 THEN '"add":1,' ELSE '' END || CASE WHEN e % 6 <> 0 THEN '"n":null,' ELSE '' END
    || '"src":"' || CASE WHEN e % 5 = 0 THEN 'new' ELSE 's' END || '"},"tags":' || CASE WHEN e % 8 = 0 THEN '["n"]' ELSE '["t","n"]' END || '}' AS m,
  e % 7 <> 0 AND e % 4 <> 1 AND e % 6 <> 0 AND e % 8 <> 0 AS kept FROM e)"""
ORACLES = {
    "d10_json_merge": _EVENTS
    + " SELECT event_id, CASE WHEN e % 17 = 0 THEN CASE WHEN e % 11 = 0 AND e % 13 <> 0 THEN n END WHEN e % 11 = 0 THEN c WHEN e % 13 = 0 THEN CASE WHEN NOT kept THEN c END ELSE m END AS merged FROM t",
    "d10_map_merge": """WITH t AS (SELECT o_orderkey AS i, o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE o_orderpriority END AS cp, o_orderkey % 7 <> 0 AS b, o_orderkey % 11 <> 0 AS n, o_orderkey % 13 <> 0 AS c FROM orders)
SELECT i AS id, CASE WHEN NOT c OR (i % 3 <> 0 AND (i % 4 <> 0 OR NOT b OR NOT n)) THEN s END AS status,
  CASE WHEN NOT c THEN 'old=x,priority=' || p || CASE WHEN i % 2 = 0 THEN ',seen=y' ELSE '' END ELSE 'priority=' || cp || CASE WHEN b AND n AND i % 2 = 0 THEN ',seen=y' ELSE '' END END AS facts,
  CASE WHEN NOT c OR i % 4 <> 0 THEN 'status,facts' ELSE 'facts' END AS present FROM t WHERE c OR (n AND NOT b)""",
    "d2_presence_overlay": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 <> 0 THEN c_name WHEN c_custkey % 6 <> 0 THEN upper(c_name) END AS name, c_mktsegment AS segment, 'name,segment' AS present FROM customer",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
