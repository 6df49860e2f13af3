"""Queries of search, ranks, sets, gates and model replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import urls as u
from ..operators import gates, replies, search
from ..operators import ordering as o
from .common import table


def _keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", t.search_key("p_name", composed=True).alias("k0"), t.search_key("p_brand", composed=True).alias("k1"), t.search_key("p_type", composed=True).alias("k2"))
    return search.search_keys(p, "p_partkey", ["k0", "k1", "k2"])


def _wanted(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 20 = 0")
    return p.select(t.search_key("p_name", composed=True).alias("q")).union(p.select(t.search_key(F.split("p_name", " ")[1], composed=True))).union(p.select(t.search_key("p_brand", composed=True))).distinct()


def d25_search(spark, sf_dir):
    return search.search(_wanted(spark, sf_dir), _keys(spark, sf_dir))


def d26_collisions(spark, sf_dir):
    return search.collisions(_wanted(spark, sf_dir), _keys(spark, sf_dir))


def g2_name_order(spark, sf_dir):
    reading = F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.lower("c_name")).alias("reading")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", reading, "c_name")
    return o.places(c, "c_mktsegment", ["reading", "c_name", "c_custkey"]).select("c_custkey", "place")


def g2_japanese_order(spark, sf_dir):
    """Customers of each segment by reading, which some have in capitals and some lack, else by name, in Japanese order."""
    k = F.col("c_custkey")
    reading = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.lower(F.concat("c_mktsegment", "c_name"))).otherwise("")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", reading.alias("reading"))
    return o.named(c, "c_mktsegment", "reading", "c_name", "c_custkey").select("c_custkey", "place")


def g3_ranked_hits(spark, sf_dir):
    hits = search.search(_wanted(spark, sf_dir), _keys(spark, sf_dir))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("type", "id"))).where("place <= 5")


def g4_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(60).limit(30).select("o_orderkey", "o_totalprice")


def g5_stable_shuffle(spark, sf_dir):
    return o.shuffled(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)


def g6_work_queue(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    rows = table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti")
    return rows.orderBy(F.col("o_orderpriority") == "1-URGENT", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def g7_diversity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("author", F.when(F.col("user_id") % 17 == 0, "").otherwise(F.col("user_id").cast("string")))
    return o.diverse_first(e, ["event_type", "author"], "event_id").select("event_id", "leads")


def g8_rotating_slice(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") - 1).alias("place"))
    total = c.count()
    retries = c.where("place < 2").withColumn("ord", F.lit(0))
    batch = o.rotated(c, "place", total - 20, 60, total).withColumn("ord", F.lit(1))
    return retries.union(batch).groupBy("c_custkey").agg(F.min("ord").alias("ord"))


def g9_interleaved(spark, sf_dir):
    """The documents of all sources in turn: all firsts, then all seconds, each text once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    turn = o.places(d, "source", ["doc_id"]).withColumnRenamed("place", "turn")
    return turn.groupBy("h").agg(F.min(F.struct("turn", "source", "doc_id")).alias("x")).select("x.turn", "x.source", "x.doc_id")


def g10_contiguous(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("step", F.col("l_linenumber") - F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    return li.groupBy("l_orderkey").agg(F.bool_and(F.coalesce(F.col("step") == 1, F.lit(True))).alias("contiguous"))


def g11_latest(spark, sf_dir):
    return o.latest(table(spark, sf_dir, "orders").where("o_orderdate < '1998-01-01'"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]).select("o_custkey", "o_orderkey", "o_totalprice")


def g12_oldest_first(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("checked"))
    return table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.asc_nulls_first("checked"), "c_custkey").limit(50).select("c_custkey", F.col("checked").isNull().alias("never"))


def g13_stopping(spark, sf_dir):
    """Days as runs of a campaign, each with the first reason to stop that holds on it."""
    log = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "signup").alias("signups"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    out = o.streaks(log.withColumn("grew", F.col("signups") % 3 == 0), "day", "grew").withColumn("status", F.when(F.col("errors") % 11 == 0, "cancelled").when(F.col("errors") % 13 == 0, "query_budget_reached").otherwise("running"))
    over = Window.orderBy("day")  # one row a day
    out = out.withColumns({"spent": F.sum("n").over(over), "done": F.sum("signups").over(over)})
    config = o.Campaign(target=1500, budget=9000, patience=4, terminal=("cancelled", "query_budget_reached"))
    reason = o.stopping_reason(config, F.col("signups") % 7 != 0, F.col("done"), F.col("status"), F.col("spent"), F.col("day") >= "2024-01-27", F.col("streak"))
    return out.select("day", "streak", "spent", reason.alias("reason"))


def g14_catalogue_id(spark, sf_dir):
    """Brands as catalogues of part names in their order. Some have a cursor of their own, some one of the first half of
    the catalogue, some none."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("place"), F.col("p_name").alias("query"))
    half = p.groupBy("name").agg(F.floor((F.min("place") + F.max("place")) / 2).alias("middle"))
    before = p.join(half, "name").where("place <= middle").select("name", "place", "query")
    own, old = o.catalogues(p), o.catalogues(before)
    known = own.where("name LIKE 'Brand#1%'").select("catalogue", (F.col("n") + 3).alias("cursor")).union(old.where("name LIKE 'Brand#2%'").select("catalogue", (F.col("n") - 1).alias("cursor")))
    return o.resumed(own, old, known.distinct()).select(F.col("name").alias("p_brand"), "catalogue", "n", "cursor", "migrated_from")


def g15_query_plan(spark, sf_dir):
    """Query texts from all nations, segments and templates: no templates of streets for short names, none of two for the
    first segment."""
    segments = table(spark, sf_dir, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))  # a handful of segments, one row
    templates = F.array(F.lit("%s in %s"), F.lit("%s %s street"), F.lit('"%s" "%s"'))
    n = table(spark, sf_dir, "nation").join(F.broadcast(segments), F.lit(True)).select("n_name", F.explode("segments").alias("segment")).select("n_name", "segment", F.posexplode(templates).alias("kind", "template"))
    kept = n.where("NOT (kind = 1 AND length(n_name) < 6) AND NOT (kind = 2 AND segment = 'AUTOMOBILE')")
    return kept.select(F.replace(F.regexp_replace("template", "%s(.*)%s", "{0}$1{1}"), F.lit("{0}"), F.lower("segment")).alias("q"), "n_name").select(F.replace("q", F.lit("{1}"), F.col("n_name")).alias("query")).distinct()


def h1_ordered_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    both = c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("ord")).union(c.select((F.col("c_nationkey") + 5).alias("k"), (F.col("c_custkey") + 100000).alias("ord")))
    return both.groupBy("k").agg(F.min("ord").alias("first"))


def h2_id_sets(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    parts = {"both": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a), "either": a.union(b).distinct()}
    return reduce(lambda x, y: x.union(y), (df.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).withColumn("part", F.lit(name)) for name, df in parts.items()))


def h3_protected_prune(spark, sf_dir):
    """Customers in three layers. Six sets protect ids; rows of the base layer outside of them go, rows of the others if they
    are orphaned (their id has no protected base row and isn't their own) or risky."""
    c = table(spark, sf_dir, "customer")
    keys = lambda df, name: df.select(F.col(name).cast("long").alias("c_custkey"))
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    protected = [keys(c.where("c_acctbal > 9000"), "c_custkey"), keys(orders.where("o_totalprice > 400000"), "o_custkey"), keys(c.where("c_nationkey = 3"), "c_custkey"), keys(table(spark, sf_dir, "supplier").where("s_acctbal > 5000"), "s_suppkey"), keys(events.where("event_type = 'purchase' AND value > 99"), "user_id"), keys(c.where("c_name LIKE '%77'"), "c_custkey")]
    base = c.select("c_custkey", "c_mktsegment", F.lit("base").alias("layer"))
    extra = c.where("c_custkey % 3 = 0").select("c_custkey", "c_mktsegment", F.lit("extra").alias("layer"))
    own = c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_mktsegment", F.lit("platform").alias("layer"))
    platform = c.where("c_custkey % 5 = 0").select("c_custkey", "c_mktsegment", F.lit("platform").alias("layer")).union(own)
    return gates.pruned(base, [extra, platform], protected, "c_custkey", F.col("c_mktsegment") == "BUILDING")


def h4_net_new(spark, sf_dir):
    before = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select(F.md5(F.col("text").cast("binary")).alias("h"))
    after = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("h"))
    return after.subtract(before).agg(F.count(F.lit(1)).alias("net_new"))


def i_gates(spark, sf_dir):
    """All gates over the given tables, a row each."""
    c, od, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    out = [gates.unique(c, "c_custkey"), gates.unique(li, "l_orderkey"), gates.count_within(od, 1000, 100_000_000), gates.unique_ratio(c, "c_name", 0.97), gates.unique_ratio(od, "o_custkey", 0.97), gates.survives(c.where("c_acctbal > 0"), od.select(F.col("o_custkey").alias("c_custkey")), "c_custkey"), gates.growth(c, od, 2.0, 100)]
    return reduce(lambda a, b: a.union(b), out)


def i3_declared_totals(spark, sf_dir):
    declared = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("declared"))
    return declared.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("n") == F.col("declared")).alias("equal"))


def i7_identity_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.contains("html", u.host_key("url")).alias("own_page"), (F.regexp_extract("html", r"track\((\d+)\)", 1) == F.col("page_id").cast("string")).alias("same_id"))


def i8_marker_present(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.count_if(F.contains("html", F.lit("<footer>"))).alias("with_footer"), F.count_if(~F.contains("html", F.lit("<footer>"))).alias("without"))


def i9_circuit_breaker(spark, sf_dir):
    """Batches of 50 events in order: whether each was run, as one with too many failures (all but views) stops the rest."""
    e = table(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 50))
    g = e.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "view").alias("failed"))
    return gates.circuit_breaker(g, "batch", "failed", "n")


def k1_parsed_reply(spark, sf_dir):
    """Replies: the JSON object in them, or else their whole prose; incomplete ones begin an object that has no end."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    cut = F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    props = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), cut.alias("text"))
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    rows = props.union(talk).withColumn("clean", clean).withColumn("whole", F.try_parse_json("clean").isNotNull())
    value = F.when(F.col("whole"), F.get_json_object("clean", "$.k"))
    incomplete = F.col("clean").startswith("{") & ~F.col("whole")
    return rows.select("id", (~F.col("clean").isin("", "null", "undefined", "[]") & ~incomplete).alias("valid"), value.isNotNull().alias("structured"), incomplete.alias("incomplete"), F.when(~incomplete, F.coalesce(value, "clean")).alias("reply"))


def k2_partial_array(spark, sf_dir):
    """Arrays of a customer's order keys, cut off after 40 characters."""
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    text = F.concat(F.lit('{"names": ['), F.array_join(F.transform("ks", lambda k: F.concat(F.lit('"'), k.cast("string"), F.lit('"'))), ", "), F.lit("]}"))
    return keys.select("o_custkey", F.array_join(replies.closed_items(F.substring(text, 1, 40)), "|").alias("items"))


def k3_suggestions(spark, sf_dir):
    """Up to five distinct names of a part's brand: trimmed, at most 40 characters, no control characters."""
    items = table(spark, sf_dir, "part").select("p_brand", F.trim("p_name").alias("name"), F.col("p_partkey").alias("place"))
    good = items.where((F.char_length("name").between(1, 40)) & ~F.col("name").rlike(r"[\x00-\x1f]")).groupBy("p_brand", "name").agg(F.min("place").alias("place"))
    return good.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("place"))).where("k <= 5")


def k4_repair_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^(?:[-*]\s+|\d+[.)]\s*)", ""), r"\|"), lambda x: F.trim(x))
    return lines.select("doc_id", "place", cells.alias("cells")).where((F.size("cells") == 3) & (F.col("cells")[0] != "") & (F.col("cells")[2] != "")).select("doc_id", "place", F.col("cells")[0].alias("name"), F.col("cells")[2].alias("reason"))


def k5_intent(spark, sf_dir):
    negative, positive = r"(?i)\b(?:no|without)\s+\w+", r"(?i)\b(?:the|and)\b.{0,25}\bth"
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).isNotNull()
    return turns.select("conv_id", "turn", F.when(F.col("text").rlike(negative), False).otherwise(F.col("text").rlike(positive) | (before & ~F.col("text").rlike(r"(?i)why|analysis"))).alias("wants"))


#: What is put before messages, and whether that asks for names: yes, no, never, or only if it follows an answer.
ASKED = (("候補を 考えて ", "yes"), ("Name ideas, no name suggestions ", "never"), ("傾向の分析 だけ ", "never"), ("Please suggest\nsome NAMES ", "yes"), ("Why so? ", "no"), ("More ", "follows"), ("이름을 추천 ", "yes"), ("名前は いらない ", "never"))


def k5_wants_names(spark, sf_dir):
    """Which messages of conversations ask for names, by the rules in their order."""
    turns = table(spark, sf_dir, "conversations")
    said = F.element_at(F.array(*(F.lit(a) for a, _ in ASKED)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ASKED))) + 1).cast("int"))
    follows = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).isNotNull()
    return turns.select("conv_id", "turn", replies.wants_names(F.concat(said, "text"), follows).alias("wants"))


def k6_decisions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("m"))
    k = F.col("m")["k"].cast("int")
    exact = F.array_join(F.array_sort(F.map_keys("m")), ",") == "k"
    return e.select("event_id", F.when(~exact | ~k.between(0, 99), "invalid").when(F.col("event_type") == "error", "needs_review").when(k >= 50, "approve").otherwise("reject").alias("decision"))


def k7_batches(spark, sf_dir):
    """Orders as batches of names to read, a line each, and the readings that came back: some wrong, some missing."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("k"))
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("k") % 3 + 1).cast("int"))
    names = li.select("batch", "idx", pick("灰島リウ", "ミライ アカリ", "未知名").alias("name"))
    reading = F.when(F.col("k") % 37 == 0, "abc").when(F.col("k") % 37 == 1, "はいしまりゅう").otherwise(pick("はいしま りう", "みらい・あかり", "みちな"))
    items = li.where("k % 31 <> 0").select("batch", "idx", reading.alias("reading"))
    return replies.accepted_readings(names, items, composed=True)


_KEYSQL = r"(SELECT p_partkey AS id, unnest([0, 1, 2]) AS place, unnest([regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g'), regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '', 'g'), regexp_replace(lower(p_type), '[^\p{L}\p{N}]', '', 'g')]) AS key FROM part)"
_WANT = r"(SELECT DISTINCT regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') AS q FROM (SELECT unnest([p_name, string_split(p_name, ' ')[2], p_brand]) AS x FROM part WHERE p_partkey % 20 = 0) WHERE x IS NOT NULL)"
_HITS = f"(SELECT q, id, min(CASE WHEN key = q AND place = 0 THEN 0 WHEN key = q THEN 1 ELSE 2 END)::INT AS type FROM {_WANT}, {_KEYSQL} WHERE q <> '' AND contains(key, q) GROUP BY 1, 2)"
ORACLES = {
    "d25_search": f"SELECT q, id, type FROM {_HITS}",
    "d26_collisions": f"SELECT q, count(DISTINCT id) AS n FROM {_WANT} LEFT JOIN {_KEYSQL} ON key = q GROUP BY 1",
    "g2_name_order": "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_acctbal > 0 THEN c_name ELSE lower(c_name) END, c_name, c_custkey) AS place FROM customer",
    "g2_japanese_order": "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE c_custkey % 3 WHEN 1 THEN lower(c_mktsegment || c_name) ELSE lower(c_name) END, c_custkey) AS place FROM customer",
    "g3_ranked_hits": f"SELECT * FROM (SELECT q, id, type, row_number() OVER (PARTITION BY q ORDER BY type, id)::INT AS place FROM {_HITS}) WHERE place <= 5",
    "g4_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 60",
    "g5_stable_shuffle": "SELECT c_custkey FROM customer",
    "g6_work_queue": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderpriority = '1-URGENT', o_totalprice DESC, o_orderkey LIMIT 100",
    "g7_diversity": "SELECT event_id, user_id % 17 = 0 OR row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 AS leads FROM events",
    "g8_rotating_slice": "SELECT c_custkey, min(ord) AS ord FROM (SELECT c_custkey, 0 AS ord FROM customer WHERE c_custkey - 1 < 2 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey - 1 >= (SELECT count(*) FROM customer) - 20 OR c_custkey - 1 < 40) GROUP BY 1",
    "g9_interleaved": "WITH d AS (SELECT doc_id, source, md5(text) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT turn, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY turn, source, doc_id) AS c FROM d) WHERE c = 1",
    "g10_contiguous": "SELECT l_orderkey, bool_and(coalesce(s = 1, true)) AS contiguous FROM (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS s FROM lineitem) GROUP BY 1",
    "g11_latest": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1",
    "g12_oldest_first": "SELECT c_custkey, checked IS NULL AS never FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS checked FROM orders GROUP BY 1) ON c_custkey = o_custkey ORDER BY checked NULLS FIRST, c_custkey LIMIT 50",
    "g13_stopping": "WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM events GROUP BY 1), g AS (SELECT *, s % 3 = 0 AS grew, sum((s % 3 = 0)::INT) OVER (ORDER BY day) AS grp, sum(n) OVER (ORDER BY day)::BIGINT AS spent, sum(s) OVER (ORDER BY day) AS done FROM l), k AS (SELECT *, sum((NOT grew)::INT) OVER (PARTITION BY grp ORDER BY day)::BIGINT AS streak FROM g) SELECT day, streak, spent, CASE WHEN s % 7 = 0 THEN 'disabled' WHEN done >= 1500 THEN 'target_reached' WHEN e % 11 = 0 THEN 'cancelled' WHEN spent >= 9000 THEN 'query_budget_reached' WHEN day >= '2024-01-27' THEN 'deadline_reached' WHEN streak >= 4 THEN 'paused_no_growth' END AS reason FROM k",
    "g14_catalogue_id": """WITH p AS (SELECT *, (min(p_partkey) OVER b + max(p_partkey) OVER b) // 2 AS middle FROM part WINDOW b AS (PARTITION BY p_brand)),
c AS (SELECT p_brand, substr(sha256(string_agg(p_name, chr(10) ORDER BY p_partkey)), 1, 16) AS own, count(*) AS n, substr(sha256(string_agg(p_name, chr(10) ORDER BY p_partkey) FILTER (p_partkey <= middle)), 1, 16) AS old, count(*) FILTER (p_partkey <= middle) AS m FROM p GROUP BY 1)
SELECT p_brand, own AS catalogue, n, CASE WHEN p_brand LIKE 'Brand#1%' THEN (n + 3) % n WHEN p_brand LIKE 'Brand#2%' THEN (m - 1) % m ELSE 0 END AS cursor, CASE WHEN p_brand LIKE 'Brand#2%' THEN old END AS migrated_from FROM c""",
    "g15_query_plan": "SELECT DISTINCT CASE kind WHEN 0 THEN s || ' in ' || n_name WHEN 1 THEN s || ' ' || n_name || ' street' ELSE '\"' || s || '\" \"' || n_name || '\"' END AS query FROM nation, (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer), (VALUES (0), (1), (2)) k(kind) WHERE NOT (kind = 1 AND length(n_name) < 6) AND NOT (kind = 2 AND s = 'automobile')",
    "h1_ordered_union": "SELECT k, min(ord) AS first FROM (SELECT c_nationkey AS k, c_custkey AS ord FROM customer UNION ALL SELECT c_nationkey + 5, c_custkey + 100000 FROM customer) GROUP BY 1",
    "h2_id_sets": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT count(*) AS n, sum(k)::BIGINT AS total, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT count(*), sum(k)::BIGINT, 'only_a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT count(*), sum(k)::BIGINT, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT count(*), sum(k)::BIGINT, 'either' FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "h3_protected_prune": """WITH p AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 OR c_nationkey = 3 OR c_name LIKE '%77' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 99),
l AS (SELECT c_custkey, c_mktsegment, 'base' AS layer FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'extra' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_mktsegment, 'platform' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 10000000, c_mktsegment, 'platform' FROM customer WHERE c_custkey % 50 = 0)
SELECT c_custkey, c_mktsegment, layer, CASE WHEN c_custkey IN (SELECT id FROM p) THEN 'kept' WHEN layer = 'base' THEN 'pruned' WHEN c_custkey < 10000000 THEN 'orphaned' WHEN c_mktsegment = 'BUILDING' THEN 'risky' ELSE 'kept' END AS state FROM l""",
    "h4_net_new": "SELECT count(*) AS net_new FROM (SELECT md5(text) FROM documents EXCEPT SELECT md5(text) FROM documents WHERE doc_id % 10 <> 0)",
    "i_gates": """SELECT 'unique c_custkey' AS gate, 0.0::DOUBLE AS value, true AS ok
 UNION ALL SELECT 'unique l_orderkey', count(*)::DOUBLE, count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
 UNION ALL SELECT 'row count', count(*)::DOUBLE, count(*) BETWEEN 1000 AND 100000000 FROM orders
 UNION ALL SELECT 'unique ratio c_name', round(count(DISTINCT c_name) / count(*), 6), count(DISTINCT c_name) / count(*) >= 0.97 FROM customer
 UNION ALL SELECT 'unique ratio o_custkey', round(count(DISTINCT o_custkey) / count(*), 6), count(DISTINCT o_custkey) / count(*) >= 0.97 FROM orders
 UNION ALL SELECT 'protected c_custkey', count(*)::DOUBLE, count(*) = 0 FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT 'growth', a::DOUBLE, a >= b AND a <= greatest(b * 2, b + 100) FROM (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM customer) AS b)""",
    "i3_declared_totals": "SELECT count(*) AS orders, count(*) FILTER (n = d) AS equal FROM (SELECT count(*) AS n, max(l_linenumber) AS d FROM lineitem GROUP BY l_orderkey)",
    "i7_identity_match": r"SELECT page_id, contains(html, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^(?:www|m)[.]', '')) AS own_page, regexp_extract(html, 'track\((\d+)\)', 1) = page_id::VARCHAR AS same_id FROM pages",
    "i8_marker_present": "SELECT count(*) FILTER (contains(html, '<footer>')) AS with_footer, count(*) FILTER (NOT contains(html, '<footer>')) AS without FROM pages",
    "i9_circuit_breaker": "WITH g AS (SELECT event_id // 50 AS batch, count(*) AS n, count(*) FILTER (event_type <> 'view') AS failed FROM events GROUP BY 1) SELECT batch, n, failed, failed >= greatest(3, ceil(n * 0.75)) AS stop, batch <= coalesce((SELECT min(batch) FROM g WHERE failed >= greatest(3, ceil(n * 0.75))), batch) AS ran FROM g",
    "k1_parsed_reply": "SELECT id, text NOT IN ('', 'null', 'undefined', '[]') AND NOT cut AS valid, s AND NOT cut AS structured, cut AS incomplete, CASE WHEN cut THEN NULL WHEN s THEN text->>'$.k' ELSE text END AS reply FROM (SELECT event_id AS id, trim(props) AS text, true AS s, event_id % 10 = 0 AS cut FROM events UNION ALL SELECT conv_id * 1000 + turn, trim(text), false, false FROM conversations)",
    "k2_partial_array": """WITH k AS (SELECT o_custkey, list_transform(list(o_orderkey ORDER BY o_orderkey), lambda x: '"' || x || '"') AS ks FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter(ks, lambda x, i: 11 + length(array_to_string(ks[1:i], ', ')) <= 40), '|') AS items FROM k""",
    "k3_suggestions": "SELECT p_brand, name, place, k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY place)::INT AS k FROM (SELECT p_brand, trim(p_name) AS name, min(p_partkey) AS place FROM part WHERE length(trim(p_name)) BETWEEN 1 AND 40 GROUP BY 1, 2)) WHERE k <= 5",
    "k4_repair_lines": r"SELECT doc_id, place::INT AS place, cells[1] AS name, cells[3] AS reason FROM (SELECT doc_id, place, list_transform(string_split(regexp_replace(trim(line), '^(?:[-*]\s+|\d+[.)]\s*)', ''), '|'), lambda x: trim(x)) AS cells FROM (SELECT doc_id, unnest(range(0, len(ls))) AS place, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE len(cells) = 3 AND cells[1] <> '' AND cells[3] <> ''",
    "k5_intent": r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(?:no|without)\s+\w+') THEN false ELSE regexp_matches(text, '(?i)\b(?:the|and)\b.{0,25}\bth') OR (lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AND NOT regexp_matches(text, '(?i)why|analysis')) END AS wants FROM conversations",
    "k5_wants_names": "SELECT conv_id, turn, CASE ['" + "', '".join(a for _, a in ASKED) + f"'][(conv_id + turn) % {len(ASKED)} + 1] WHEN 'yes' THEN true WHEN 'follows' THEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AND NOT regexp_matches(text, '(?i)why|analysis|statistics') ELSE false END AS wants FROM conversations",
    "k6_decisions": "SELECT event_id, CASE WHEN k NOT BETWEEN 0 AND 99 THEN 'invalid' WHEN event_type = 'error' THEN 'needs_review' WHEN k >= 50 THEN 'approve' ELSE 'reject' END AS decision FROM (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events)",
    "k7_batches": "WITH g AS (SELECT l_orderkey AS batch, l_linenumber AS idx, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2), v AS (SELECT *, k % 31 <> 0 AND k % 37 <> 0 AND NOT (k % 37 = 1 AND k % 3 <> 2) AS ok FROM g) SELECT batch, idx, CASE WHEN k % 37 = 1 THEN 'はいしまりゅう' ELSE ['はいしま りう', 'みらい・あかり', 'みちな'][k % 3 + 1] END AS reading FROM v WHERE batch NOT IN (SELECT batch FROM v WHERE NOT ok)",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
ORACLES = {name: sql for name, sql in ORACLES.items() if sql}
