"""Queries of overlays, merges and identity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..operators import assignment, identity, overlay
from .common import table


def _layers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.array("c_mktsegment").alias("tags"))
    extra = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).alias("name"), F.array(F.lower("c_mktsegment"), "c_mktsegment").alias("tags"))
    last = c.where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.lit("PAYING")).alias("segment"), F.array(F.lit("x")).alias("tags"))
    return base, extra, last


def d1_layer_overlay_lists(spark, sf_dir):
    out = overlay.latest_fields(list(_layers(spark, sf_dir)), "c_custkey", lists=("tags",))
    return out.select("c_custkey", "name", "segment", F.array_join("tags", ",").alias("tags"))


def d2_layer_overlay(spark, sf_dir):
    out = overlay.latest_fields(list(_layers(spark, sf_dir)), "c_custkey")
    return out.select("c_custkey", "name", "segment", F.array_join("tags", ",").alias("tags"))


def d3_verified_overlay(spark, sf_dir):
    base, _, _ = _layers(spark, sf_dir)
    patch = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select((F.col("c_custkey") + 4).alias("c_custkey"), F.concat(F.lit("Verified "), F.col("c_name")).alias("name"))
    return overlay.patched(base.drop("tags"), patch, "c_custkey")


def d4_correction_by_name(spark, sf_dir):
    """Corrections are keyed by the normalised name and skip rows that have a checked value of their own."""
    corrections = table(spark, sf_dir, "nation").select(t.match_key(F.concat("n_name", F.lit("!")), composed=True).alias("name_key"), F.col("n_regionkey").alias("corrected"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.withColumn("name_key", t.match_key("n_name", composed=True)).join(corrections, "name_key", "left")
    return out.select("c_custkey", F.when(F.col("c_acctbal") > 5000, -1).otherwise(F.col("corrected")).alias("value"))


def _records(spark, sf_dir):
    """Customers as records with accounts in lists, fields, a login, a handle and a channel."""
    k = F.col("c_custkey").cast("string")
    channel = F.concat(F.lit("UC"), F.substring(F.md5(k.cast("binary")), 1, 22))
    when = lambda m, r, value: F.when(F.col("c_custkey") % m == r, value)
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", F.array(F.concat(F.lit("https://x.com/User"), k), F.lit("https://example.com/no")).alias("platform_accounts"), F.concat(F.lit("https://twitter.com/user"), k, F.lit("?s=1")).alias("twitter_url"),
        when(2, 0, F.concat(F.lit("https://www.twitch.tv/T"), k)).alias("twitch_url"), F.lit("https://x.com/home").alias("source_url"), when(5, 0, F.concat(F.lit("https://kick.com/K"), k)).alias("broadcast_url"),
        when(7, 0, F.concat(F.lit("https://www.youtube.com/channel/UC"), F.substring(F.md5(channel.cast("binary")), 1, 22))).alias("youtube_url"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("t"), k)).otherwise("no login").alias("twitch_login"),
        F.concat(F.lit("@Name"), k).alias("youtube_handle"), F.when(F.col("c_custkey") % 4 == 0, channel).otherwise("").alias("youtube_channel_id"),
    )


def d5_exploded_accounts(spark, sf_dir):
    """The accounts of each record, each once, whatever evidence it has for them."""
    return u.record_accounts(_records(spark, sf_dir), "c_custkey", u.rule_table(spark)).select("c_custkey", "platform", "account_id")


def d6_paired_handle(spark, sf_dir):
    """Accounts without handles that a record pairs with its one channel."""
    return u.record_accounts(_records(spark, sf_dir), "c_custkey", u.rule_table(spark)).where("NOT paired").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_accounts"), F.count_if(F.col("platform") == "youtube").alias("n_youtube"))


def d7_primary_platform(spark, sf_dir):
    """A kind of event is a user's primary one only with both a source (a value) and evidence (properties with k > 50)."""
    e = table(spark, sf_dir, "events")
    known = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("known"), F.array_join(F.array_sort(F.collect_set(F.when((F.col("value") > 90) & (F.get_json_object("props", "$.k").cast("int") > 50), F.col("event_type")))), ",").alias("primary"))
    return known.select("user_id", "known", F.coalesce("primary", F.lit("")).alias("primary"))


def _accounts():
    return F.concat("p_brand", F.lit(":"), "p_size", F.lit(":"), "p_type")


def _existing(spark, sf_dir):
    """Parts with even keys are the registry, all others come in."""
    return table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), _accounts().alias("account"), t.match_key("p_name", composed=True).alias("name_key"))


def _incoming(spark, sf_dir):
    other = F.when(F.col("p_size") == 50, F.lit("?")).otherwise("")
    return table(spark, sf_dir, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("in_id"), F.concat(_accounts(), other).alias("account"), t.match_key("p_name", composed=True).alias("name_key"))


def d8_resolve_skip(spark, sf_dir):
    return identity.resolve(_existing(spark, sf_dir), _incoming(spark, sf_dir), identity.Policy())


def d8_resolve_all(spark, sf_dir):
    return identity.resolve(_existing(spark, sf_dir), _incoming(spark, sf_dir), identity.Policy("all"))


def d8_resolve_named(spark, sf_dir):
    return identity.resolve(_existing(spark, sf_dir), _incoming(spark, sf_dir), identity.Policy("skip", require_name=True))


def d8_resolve_guarded(spark, sf_dir):
    """Rows that share an account with other names only aren't new; those whose id is known are themselves."""
    known = _incoming(spark, sf_dir).withColumn("in_id", F.when(F.col("in_id") % 9 == 0, F.col("in_id") - 1).otherwise(F.col("in_id")))
    return identity.resolve(_existing(spark, sf_dir), known, identity.Policy("skip", require_name=True, own_id_first=True, guard=True))


def d8_resolve_first_writer(spark, sf_dir):
    return identity.resolve(_existing(spark, sf_dir), _incoming(spark, sf_dir), identity.Policy("first", allow_new=False))


def d8_resolve_last_writer(spark, sf_dir):
    return identity.resolve(_existing(spark, sf_dir), _incoming(spark, sf_dir), identity.Policy("last", require_name=True, allow_new=False))


def d8_resolve_enrich(spark, sf_dir):
    """Rows that only ever enrich: known ids are themselves, others their accounts' one record, and nothing is new."""
    known = _incoming(spark, sf_dir).withColumn("in_id", F.when(F.col("in_id") % 9 == 0, F.col("in_id") - 1).otherwise(F.col("in_id")))
    return identity.resolve(_existing(spark, sf_dir), known, identity.Policy("skip", allow_new=False, own_id_first=True))


def d8_resolve_some_named(spark, sf_dir):
    """Records with ids divisible by four are met by account and name, others by account alone."""
    existing = _existing(spark, sf_dir).withColumn("named", F.col("id") % 4 == 0)
    return identity.resolve(existing, _incoming(spark, sf_dir), identity.Policy("skip", guard=True, named_need_name=True))


def d8_rechecked(spark, sf_dir):
    """The registry after a check: names as found, readings only where the name is the same."""
    p = table(spark, sf_dir, "part")
    registry = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("reading"), F.lit("").alias("seen"))
    found = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    rows = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("in_id"), found.alias("name"), F.concat(F.lit("s"), "p_partkey").alias("seen"))
    return identity.rechecked(registry, rows, d8_resolve_skip(spark, sf_dir), "id")


def d8_applied(spark, sf_dir):
    """The registry after the batch: blank sizes are filled, names are gathered, new parts are appended."""
    p = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")).otherwise("")
    registry = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), size.alias("size"), F.array("p_name").alias("names"))
    rows = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("in_id"), F.concat(F.lit("in"), "p_size").alias("size"), F.array("p_name").alias("names"))
    return identity.applied(registry, rows, d8_resolve_skip(spark, sf_dir), "id", lists=("names",)).select("id", "size", F.array_join("names", ",").alias("names"))


def d9_consolidated_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("channel"), F.sha2(F.col("text").cast("binary"), 256).alias("name_key"), (F.col("doc_id") % 50 == 0).alias("protected"))
    return identity.consolidated(rows)


def _snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.array("o_orderstatus").alias("tags"))
    collected = o.where("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "N").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority", F.concat("tags", F.array(F.lit("new"))).alias("tags"))
    current = o.where("o_orderkey % 13 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "C").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.lower("o_orderpriority").alias("o_orderpriority"), F.concat("tags", F.array(F.lit("mine"))).alias("tags"))
    base = o.where("o_orderkey % 7 <> 0")
    return base, collected, current


def d10_three_way_merge(spark, sf_dir):
    out = overlay.three_way(*_snapshots(spark, sf_dir), "o_orderkey", lists=("tags",))
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.array_join("tags", ",").alias("tags"))


def _submitted(spark, sf_dir):
    """Every part is a submission and a record: as the record after it, by name and brand, or by account."""
    name = F.concat(t.match_key("p_name", composed=True), t.match_key("p_brand", composed=True)).alias("name_key")
    account = F.concat("p_brand", F.lit(":"), "p_size", F.lit(":"), "p_type").alias("account")
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name, account)
    submissions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sub_id"), (F.col("p_partkey") + 1).alias("ref_id"), name, account, (F.col("p_partkey") % 4 == 1).alias("by_id_only"), "p_size")
    return records, submissions


def d11_submission_match(spark, sf_dir):
    return identity.matched_submissions(*_submitted(spark, sf_dir))


def d11_submission_overlay(spark, sf_dir):
    """Parts with even keys with the size of the submissions (all others) that mean them, the largest of several; what
    means no record is appended."""
    p = table(spark, sf_dir, "part")
    records, submissions = _submitted(spark, sf_dir)
    records, submissions = records.where("id % 2 = 0"), submissions.where("sub_id % 2 = 1")
    sizes = p.select(F.col("p_partkey").alias("sub_id"), "p_brand", "p_size").where("sub_id % 2 = 1")
    patch = identity.greatest_said(records, submissions, "p_size").withColumnsRenamed({"id": "p_partkey", "p_size": "size"})
    base = overlay.patched(p.where("p_partkey % 2 = 0").select("p_partkey", "p_brand", F.lit(-1).alias("size")), patch.hint("merge"), "p_partkey")
    fresh = sizes.hint("merge").join(identity.meaning_none(records, submissions), "sub_id", "left_semi")
    return base.union(fresh.select("sub_id", "p_brand", "p_size"))


def d12_ranked_application(spark, sf_dir):
    """Order to customer: by id first, where it names one that has money; else by account; by name only where one customer
    alone has it. A second pass changes nothing."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 40).alias("nation"))
    by_id = o.join(c.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", F.lit(0).alias("match_rank"))
    by_account = o.join(c.where("c_acctbal <= -900"), F.col("o_orderkey") == F.col("c_custkey") * 7).select("o_orderkey", "c_custkey", F.lit(1).alias("match_rank"))
    alone = c.groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"), F.count(F.lit(1)).alias("n")).where("n < 12")
    by_name = o.join(alone, "nation").select("o_orderkey", "c_custkey", F.lit(2).alias("match_rank"))
    return identity.ranked_match(by_id.union(by_account).union(by_name), "o_orderkey", "c_custkey", "match_rank")


def d13_rename_override(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("Customer of "), "n_name").alias("new_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", F.array(F.lower("c_name")).alias("aliases")).join(names, "c_nationkey", "left")
    aliases = F.when(F.col("new_name").isNotNull(), F.array_union("aliases", F.array("c_name"))).otherwise(F.col("aliases"))
    return rows.select("c_custkey", F.coalesce("new_name", "c_name").alias("name"), F.array_join(aliases, ",").alias("aliases"))


def d14_superseding_overlay(spark, sf_dir):
    base, extra, last = _layers(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 7").select("c_custkey")
    return overlay.superseding(overlay.latest_fields([base, extra], "c_custkey"), last, gone, "c_custkey").select("c_custkey", "name", "segment")


def _entities(spark, sf_dir):
    """Parts with odd keys as submissions, with even ones as the registry: some of the registry have no account, some are of
    another kind, and some have the names of two parts."""
    p = table(spark, sf_dir, "part")
    key = lambda c: t.match_key(c, composed=True)
    account = F.lower("p_brand")
    brand = F.concat(F.lit(" "), "p_brand")
    subs = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("sub_id"), key(F.concat("p_name", brand)).alias("name_key"), F.array(key(F.concat("p_name", brand)), key(F.concat(F.lit("the "), "p_name"))).alias("keys"), F.array(account).alias("accounts"))
    subs = subs.withColumn("name_key", F.when(F.col("sub_id") % 3 == 0, F.col("keys")[1]).otherwise(F.col("name_key")))
    last = F.element_at(F.split("p_name", " "), 2)
    name = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("The "), "p_name", F.lit("/the red "), last)).when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("The "), "p_name")).otherwise(F.concat("p_name", brand))
    none = F.array().cast("array<string>")
    reg = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), key(name).alias("name_key"), F.array(key(name)).alias("keys"), F.when(F.col("p_partkey") % 10 == 0, none).otherwise(F.array(account)).alias("accounts"), (F.col("p_type") != "PROMO").alias("ours"), name.contains("/").alias("joint"))
    return subs, reg


def d15_assignment(spark, sf_dir):
    """Submissions to records of the registry, each used once."""
    subs, reg = _entities(spark, sf_dir)
    return assignment.assigned(*assignment.candidates(subs, reg, assignment.composites(subs, reg)))


def d16_composites(spark, sf_dir):
    return assignment.composites(*_entities(spark, sf_dir))


def d17_sibling_aliases(spark, sf_dir):
    """Each submission's aliases: its own names and those of a joint record, without names of its siblings."""
    subs, _ = _entities(spark, sf_dir)
    p = table(spark, sf_dir, "part").where("p_partkey % 2 = 1")
    named = F.array("p_name", F.concat(F.lit("the "), "p_name"), F.concat("p_name", F.lit(" of "), "p_brand"), "p_brand")
    aliases = p.select(F.col("p_partkey").alias("sub_id"), F.explode(named).alias("alias")).withColumn("alias_key", t.match_key("alias", composed=True))
    return assignment.without_sibling_names(aliases, subs).groupBy("sub_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"))


def d18_baseline_export(spark, sf_dir):
    """Layers merged by field, then one row for each account that its records share, with distinct tags."""
    out = overlay.latest_fields(list(_layers(spark, sf_dir)), "c_custkey", lists=("tags",))
    return out.select("segment", F.explode("tags").alias("tag")).groupBy("segment").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"), F.count(F.lit(1)).alias("n"))


#: Names of six kinds with a reading that is given for them, and the reading that a display should show without others.
NAMES = (("ミライ アカリ", "誤り", "みらいあかり"), ("山田はな", "やまだはな", "やまだはな"), ("音紡いま", "音ぼういま", ""), ("Natsumi Moe", "なつみほうめぐみ", ""), ("灰島リウ", "", "はいしまりう"), ("未知名", "", ""))


def b19_reading(spark, sf_dir):
    """Customers under names of six kinds: some readings are verified, some names have an estimate, made for this name or for
    another one, that keeps the kana at the name's end or doesn't."""
    k = F.col("c_custkey") % 6
    pick = lambda i: F.array(*(F.lit(n[i]) for n in NAMES))[k]
    c = table(spark, sf_dir, "customer").select("c_custkey", pick(0).alias("name"), pick(1).alias("reading"), F.when(F.col("c_acctbal") > 5000, "https://a.example/").otherwise("").alias("source"), F.when(F.col("c_nationkey") < 20, "manual").otherwise("guessed").alias("kind"))
    n = F.col("s_suppkey")
    estimates = table(spark, sf_dir, "supplier").select(n.alias("c_custkey"), F.when(n % 2 == 0, "はいしまりう").otherwise("はいしまりゅう").alias("guess"), F.when(n % 3 == 0, "Other").otherwise("灰島リウ").alias("made_for"))
    rows = c.join(estimates, "c_custkey", "left")
    best = t.resolved_reading(F.col("reading"), F.col("source"), F.col("kind"), F.col("name"), F.col("guess"), F.col("made_for"), F.lit(True), composed=True)
    return rows.select("c_custkey", best.alias("x")).select("c_custkey", "x.*")


def d19_reviewed_merge(spark, sf_dir):
    base, _, _ = _layers(spark, sf_dir)
    reviewed = table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.upper("c_name")).alias("name"), F.lit("").alias("segment"))
    return overlay.patched(base.drop("tags"), reviewed, "c_custkey", keep_if_blank=("name",))


def d20_restored_family(spark, sf_dir):
    base, extra, _ = _layers(spark, sf_dir)
    family = extra.select((F.col("c_custkey") + 1000).alias("c_custkey"), "name", F.lit("CC0").alias("segment")).where("name IS NOT NULL")
    return overlay.appended_unseen(base.drop("tags"), family, "c_custkey", "name")


def d21_append_unseen(spark, sf_dir):
    """Customers with even keys, and of all customers, under ids that are there for every third, those that are new in id and
    in account."""
    c = table(spark, sf_dir, "customer")
    base = c.where("c_custkey % 2 = 0").select("c_custkey", "c_nationkey", F.concat("c_mktsegment", (F.col("c_custkey") % 1000).cast("string")).alias("account"))
    moved = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 10_000_000)
    rows = c.select(moved.alias("c_custkey"), "c_nationkey", F.concat("c_mktsegment", ((F.col("c_custkey") + 1) % 1000).cast("string")).alias("account"))
    return overlay.appended_unseen(base, rows, "c_custkey", "account")


def d22_queue_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 50, F.col("event_type")).alias("author"))
    return overlay.first_wins(e, "user_id", "event_id", "author").select("user_id", "event_id", "event_type", "author")


def d23_attached_metrics(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest_price"), F.count(F.lit(1)).alias("n_orders"))
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest_price", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def d24_same_name_screen(spark, sf_dir):
    existing, incoming = _existing(spark, sf_dir), _incoming(spark, sf_dir)
    named = incoming.join(existing.select("name_key"), "name_key", "left_semi")
    return named.join(existing.select("account"), "account", "left_anti").groupBy("name_key").agg(F.count(F.lit(1)).alias("n_pending"))


def d27_localised_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("label"))
    return table(spark, sf_dir, "nation").join(F.broadcast(labels).where("n_regionkey < 3"), "n_regionkey", "left").select("n_nationkey", F.coalesce("label", "n_name").alias("label"))


_LAYERS = """
base AS (SELECT c_custkey, c_name AS name, c_mktsegment AS segment, [c_mktsegment] AS tags FROM customer),
extra AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) END AS name, [lower(c_mktsegment), c_mktsegment] AS tags FROM customer WHERE c_custkey % 3 = 0),
last AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'PAYING' END AS segment, ['x'] AS tags FROM customer WHERE c_custkey % 5 = 0)"""
_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_NAME = _KEY.format("p_name")
_RESOLVE = rf"""
WITH e AS (SELECT p_partkey AS id, p_brand || ':' || p_size || ':' || p_type AS account, {_NAME} AS k FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey AS in_id, p_brand || ':' || p_size || ':' || p_type || CASE WHEN p_size = 50 THEN '?' ELSE '' END AS account, {_NAME} AS k FROM part WHERE p_partkey % 2 = 1),
pairs AS (SELECT DISTINCT in_id, id, n.k = e.k AS same FROM n JOIN e USING (account)), """
_SUBMITTED = rf"""
WITH s AS (SELECT p_partkey AS sub_id, p_brand, p_size, {_NAME} || {_KEY.format("p_brand")} AS k, p_brand || ':' || p_size || ':' || p_type AS a FROM part),
m AS (SELECT sub_id, sub_id + 1 AS id FROM s WHERE sub_id + 1 IN (SELECT sub_id FROM s) UNION SELECT s.sub_id, r.sub_id FROM s JOIN s r USING (k) WHERE s.sub_id % 4 <> 1 UNION SELECT s.sub_id, r.sub_id FROM s JOIN s r USING (a))"""
_ENTITIES = rf"""
WITH RECURSIVE p AS (SELECT *, {_KEY.format("p_name || ' ' || p_brand")} AS k1, {_KEY.format("'the ' || p_name")} AS k2, lower(p_brand) AS a FROM part),
s AS (SELECT p_partkey AS sub_id, CASE WHEN p_partkey % 3 = 0 THEN k2 ELSE k1 END AS name, k1, k2, a FROM p WHERE p_partkey % 2 = 1),
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN k2 || {_KEY.format("'the red ' || string_split(p_name, ' ')[2]")} WHEN p_partkey % 4 = 0 THEN k2 ELSE k1 END AS name, CASE WHEN p_partkey % 10 <> 0 THEN a END AS a, p_type <> 'PROMO' AS ours, p_partkey % 6 = 0 AS joint FROM p WHERE p_partkey % 2 = 0),
comp AS (SELECT id, count(*) AS children FROM (SELECT DISTINCT r.id, r.name AS whole, s.sub_id, s.name FROM r JOIN s USING (a) WHERE ours AND joint AND contains(r.name, s.name)) GROUP BY id HAVING count(*) > 1 AND NOT bool_or(whole = name))"""

ORACLES = {
    "d1_layer_overlay_lists": f"WITH {_LAYERS} SELECT c_custkey, coalesce(e.name, b.name) AS name, coalesce(l.segment, b.segment) AS segment, array_to_string([b.tags[1]] || CASE WHEN e.tags IS NULL OR e.tags[1] = b.tags[1] THEN [] ELSE [e.tags[1]] END || coalesce(l.tags, []), ',') AS tags FROM base b LEFT JOIN extra e USING (c_custkey) LEFT JOIN last l USING (c_custkey)",
    "d2_layer_overlay": f"WITH {_LAYERS} SELECT c_custkey, coalesce(e.name, b.name) AS name, coalesce(l.segment, b.segment) AS segment, array_to_string(coalesce(l.tags, e.tags, b.tags), ',') AS tags FROM base b LEFT JOIN extra e USING (c_custkey) LEFT JOIN last l USING (c_custkey)",
    "d3_verified_overlay": f"WITH {_LAYERS}, p AS (SELECT c_custkey + 4 AS c_custkey, 'Verified ' || c_name AS v FROM customer WHERE c_custkey % 4 = 0) SELECT c_custkey, coalesce(v, name) AS name, segment FROM base LEFT JOIN p USING (c_custkey)",
    "d4_correction_by_name": "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN -1 ELSE n_regionkey END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "d5_exploded_accounts": None,
    "d6_paired_handle": None,
    "d7_primary_platform": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS known, coalesce(string_agg(DISTINCT CASE WHEN value > 90 AND (props->>'$.k')::INT > 50 THEN event_type END, ',' ORDER BY CASE WHEN value > 90 AND (props->>'$.k')::INT > 50 THEN event_type END), '') AS primary FROM events GROUP BY user_id",
    "d8_resolve_skip": _RESOLVE + "f AS (SELECT in_id, min(id) AS first, count(DISTINCT id) AS n FROM pairs GROUP BY 1) SELECT i.in_id, CASE WHEN f.n = 1 THEN first END AS target, CASE WHEN f.n IS NULL THEN 'new' WHEN f.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (SELECT DISTINCT in_id FROM n) i LEFT JOIN f USING (in_id)",
    "d8_resolve_all": _RESOLVE + "i AS (SELECT DISTINCT in_id FROM n), u AS (SELECT DISTINCT in_id, id FROM pairs) SELECT in_id, id AS target, CASE WHEN id IS NULL THEN 'new' ELSE 'matched' END AS status FROM i LEFT JOIN u USING (in_id)",
    "d8_resolve_named": _RESOLVE + "f AS (SELECT in_id, min(id) AS first, count(DISTINCT id) AS n FROM pairs WHERE same GROUP BY 1) SELECT i.in_id, CASE WHEN f.n = 1 THEN first END AS target, CASE WHEN f.n IS NULL THEN 'new' WHEN f.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (SELECT DISTINCT in_id FROM n) i LEFT JOIN f USING (in_id)",
    "d8_resolve_first_writer": _RESOLVE + "f AS (SELECT in_id, min(id) AS first FROM pairs GROUP BY 1) SELECT i.in_id, first AS target, CASE WHEN first IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM (SELECT DISTINCT in_id FROM n) i LEFT JOIN f USING (in_id)",
    "d8_resolve_last_writer": _RESOLVE + "f AS (SELECT in_id, max(id) AS last FROM pairs WHERE same GROUP BY 1) SELECT i.in_id, last AS target, CASE WHEN last IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM (SELECT DISTINCT in_id FROM n) i LEFT JOIN f USING (in_id)",
    "d9_consolidated_duplicates": "WITH g AS (SELECT source, md5(text) AS k, min(doc_id) AS kept, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL) SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 OR kept IS NULL THEN doc_id ELSE kept END AS kept_id, CASE WHEN doc_id % 50 = 0 OR kept IS NULL THEN 1 ELSE n END AS n_merged FROM documents d LEFT JOIN g ON d.source = g.source AND md5(d.text) = k",
    "d10_three_way_merge": None,
    "d11_submission_match": None,
    "d11_submission_overlay": None,
    "d12_ranked_application": None,
    "d13_rename_override": "SELECT c_custkey, coalesce('Customer of ' || n_name, c_name) AS name, lower(c_name) || CASE WHEN n_name IS NULL THEN '' ELSE ',' || c_name END AS aliases FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0",
    "d14_superseding_overlay": f"WITH {_LAYERS} SELECT c_custkey, coalesce(e.name, b.name) AS name, coalesce(l.segment, b.segment) AS segment FROM base b LEFT JOIN extra e USING (c_custkey) LEFT JOIN last l USING (c_custkey) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "d15_assignment": None,
    "d16_composites": None,
    "d17_sibling_aliases": None,
    "d18_baseline_export": f"WITH {_LAYERS}, m AS (SELECT coalesce(l.segment, b.segment) AS segment, list_distinct(b.tags || coalesce(e.tags, []) || coalesce(l.tags, [])) AS tags FROM base b LEFT JOIN extra e USING (c_custkey) LEFT JOIN last l USING (c_custkey)) SELECT segment, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, count(*) AS n FROM (SELECT segment, unnest(tags) AS tag FROM m) GROUP BY 1",
    "b19_reading": None,
    "d19_reviewed_merge": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 AND c_custkey % 4 <> 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer",
    "d20_restored_family": f"WITH {_LAYERS}, f AS (SELECT c_custkey + 1000 AS c_custkey, name, 'CC0' AS segment FROM extra WHERE name IS NOT NULL) SELECT c_custkey, name, segment FROM base UNION ALL SELECT * FROM f WHERE c_custkey NOT IN (SELECT c_custkey FROM base) AND name NOT IN (SELECT name FROM base)",
    "d21_append_unseen": None,
    "d22_queue_upsert": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(event_type, event_id) FILTER (value > 50) AS author FROM events GROUP BY user_id",
    "d23_attached_metrics": "SELECT c_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest_price, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "d24_same_name_screen": _RESOLVE + "x AS (SELECT 1) SELECT k AS name_key, count(*) AS n_pending FROM n WHERE k IN (SELECT k FROM e) AND account NOT IN (SELECT account FROM e) GROUP BY 1",
    "d27_localised_labels": "SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN lower(r_name) ELSE n_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey",
}
_PAIR = _RESOLVE + "f AS (SELECT in_id, min(id) AS first, count(DISTINCT id) AS n FROM pairs GROUP BY 1), res AS (SELECT i.in_id, CASE WHEN f.n = 1 THEN first END AS target, CASE WHEN f.n IS NULL THEN 'new' WHEN f.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (SELECT DISTINCT in_id FROM n) i LEFT JOIN f USING (in_id))"
_ACCOUNTS = """
SELECT c_custkey, 'x' AS platform, 'user' || c_custkey AS account_id FROM customer UNION SELECT c_custkey, 'twitch', 't' || c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 UNION SELECT c_custkey, 'kick', 'k' || c_custkey FROM customer WHERE c_custkey % 5 = 0
UNION SELECT c_custkey, 'youtube', '@name' || c_custkey FROM customer UNION SELECT c_custkey, 'youtube', 'channel/UC' || md5(c_custkey::VARCHAR)[1:22] FROM customer WHERE c_custkey % 4 = 0
UNION SELECT c_custkey, 'youtube', 'channel/UC' || md5('UC' || md5(c_custkey::VARCHAR)[1:22])[1:22] FROM customer WHERE c_custkey % 7 = 0"""
ORACLES |= {
    "d5_exploded_accounts": _ACCOUNTS,
    "d6_paired_handle": f"SELECT c_custkey, count(*) - drop AS n_accounts, count(*) FILTER (platform = 'youtube') - drop AS n_youtube FROM (SELECT *, (c_custkey % 4 = 0 AND c_custkey % 7 <> 0)::INT AS drop FROM ({_ACCOUNTS})) GROUP BY c_custkey, drop",
    "d8_resolve_guarded": _RESOLVE + "m AS (SELECT *, CASE WHEN in_id % 9 = 0 THEN in_id - 1 ELSE in_id END AS nid FROM n), own AS (SELECT id FROM e), f AS (SELECT nid, min(e.id) AS first, count(DISTINCT e.id) AS c FROM m JOIN e USING (account, k) GROUP BY 1) SELECT nid AS in_id, CASE WHEN nid IN (SELECT id FROM own) THEN nid WHEN c = 1 THEN first END AS target, CASE WHEN nid IN (SELECT id FROM own) THEN 'matched' WHEN c = 1 THEN 'matched' WHEN c > 1 THEN 'ambiguous' WHEN nid IN (SELECT nid FROM m WHERE account IN (SELECT account FROM e)) THEN 'guarded' ELSE 'new' END AS status FROM (SELECT DISTINCT nid FROM m) LEFT JOIN f USING (nid)",
    "d8_resolve_enrich": _RESOLVE + "m AS (SELECT *, CASE WHEN in_id % 9 = 0 THEN in_id - 1 ELSE in_id END AS nid FROM n), f AS (SELECT nid, min(e.id) AS first, count(DISTINCT e.id) AS c FROM m JOIN e USING (account) GROUP BY 1) SELECT nid AS in_id, CASE WHEN nid IN (SELECT id FROM e) THEN nid WHEN c = 1 THEN first END AS target, CASE WHEN nid IN (SELECT id FROM e) OR c = 1 THEN 'matched' WHEN c > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM (SELECT DISTINCT nid FROM m) LEFT JOIN f USING (nid)",
    "d8_resolve_some_named": _RESOLVE + "f AS (SELECT in_id, min(id) FILTER (same OR id % 4 <> 0) AS first, count(DISTINCT id) FILTER (same OR id % 4 <> 0) AS c FROM pairs GROUP BY 1) SELECT i.in_id, CASE WHEN c = 1 THEN first END AS target, CASE WHEN c IS NULL THEN 'new' WHEN c = 0 THEN 'guarded' WHEN c > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (SELECT DISTINCT in_id FROM n) i LEFT JOIN f USING (in_id)",
    "d8_rechecked": _PAIR + ", w AS (SELECT target AS id, arg_max(p_name, in_id) FILTER (in_id % 3 <> 0) AS name, max(in_id) AS seen FROM res JOIN part ON p_partkey = in_id WHERE status = 'matched' GROUP BY 1) SELECT p_partkey AS id, coalesce(name, p_name) AS name, CASE WHEN coalesce(name, p_name) = p_name THEN p_type END AS reading, coalesce('s' || seen, '') AS seen FROM part LEFT JOIN w ON id = p_partkey WHERE p_partkey % 2 = 0",
    "d8_applied": _PAIR + """,
w AS (SELECT coalesce(target, in_id) AS id, in_id, p_size, p_name FROM res JOIN part ON p_partkey = in_id WHERE status <> 'ambiguous'),
g AS (SELECT id, list(p_name ORDER BY in_id) AS names, arg_min('in' || p_size, in_id) AS size FROM w GROUP BY id),
r AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR ELSE '' END AS size, [p_name] AS names FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT id, coalesce(nullif(r.size, ''), g.size, r.size) AS size, list_concat(coalesce(r.names, []), coalesce(g.names, [])) AS names FROM r FULL JOIN g USING (id))
SELECT id, size, array_to_string(list_transform(list_sort(list_transform(list_distinct(names), lambda x: {'p': list_position(names, x), 'x': x})), lambda y: y.x), ',') AS names FROM b""",
    "d10_three_way_merge": "SELECT o_orderkey, CASE WHEN NOT c THEN CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END WHEN NOT b OR NOT n THEN cs WHEN ns = o_orderstatus OR ns = cs THEN cs WHEN cs = o_orderstatus THEN ns ELSE cs END AS o_orderstatus, CASE WHEN c THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority, o_orderstatus || CASE WHEN c THEN ',mine' ELSE '' END || CASE WHEN n AND (b OR NOT c) THEN ',new' ELSE '' END AS tags FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END AS ns, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE o_orderstatus END AS cs, o_orderkey % 7 <> 0 AS b, o_orderkey % 11 <> 0 AS n, o_orderkey % 13 <> 0 AS c FROM orders) WHERE c OR (n AND NOT b)",
    "d11_submission_match": _SUBMITTED + " SELECT sub_id, id FROM m",
    "d11_submission_overlay": _SUBMITTED + ", h AS (SELECT * FROM m WHERE sub_id % 2 = 1 AND id % 2 = 0), z AS (SELECT h.id, max(p_size) AS size FROM h JOIN s USING (sub_id) GROUP BY 1) SELECT p_partkey, p_brand, coalesce(size, -1) AS size FROM part LEFT JOIN z ON id = p_partkey WHERE p_partkey % 2 = 0 UNION ALL SELECT sub_id, p_brand, p_size FROM s WHERE sub_id % 2 = 1 AND sub_id NOT IN (SELECT sub_id FROM h)",
    "d12_ranked_application": "WITH a AS (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) < 12), m AS (SELECT o_orderkey, c_custkey, 0 AS match_rank FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 UNION ALL SELECT o_orderkey, c_custkey, 1 FROM orders JOIN customer ON o_orderkey = c_custkey * 7 WHERE c_acctbal <= -900 UNION ALL SELECT o_orderkey, c_custkey, 2 FROM orders JOIN a ON o_orderkey % 40 = c_nationkey), b AS (SELECT o_orderkey, match_rank, min(c_custkey) AS c_custkey, count(DISTINCT c_custkey) AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY match_rank) AS k FROM m GROUP BY 1, 2) SELECT o_orderkey, match_rank, c_custkey FROM b WHERE n = 1 AND k = 1",
    "d15_assignment": _ENTITIES + """,
one AS (SELECT DISTINCT sub_id, id, 1 AS stage FROM s JOIN r USING (a) WHERE r.name IN (k1, k2)),
two AS (SELECT DISTINCT sub_id, id, 2 FROM s JOIN r ON r.name IN (k1, k2) WHERE r.ours AND r.a IS NULL AND (SELECT count(*) FROM s x WHERE x.name = s.name) = 1),
three AS (SELECT DISTINCT sub_id, id, 3 FROM s JOIN r USING (a) WHERE r.ours AND length(s.name) >= 4 AND contains(r.name, s.name)),
c AS (SELECT * FROM (SELECT *, min(stage) OVER (PARTITION BY sub_id) AS least FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) WHERE id NOT IN (SELECT id FROM comp)) WHERE stage = least),
o AS (SELECT sub_id, list(c.id ORDER BY NOT ours, r.name <> s.name, c.id) AS ids, row_number() OVER (ORDER BY sub_id) AS i FROM c JOIN r USING (id) JOIN s USING (sub_id) GROUP BY sub_id),
run AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS sub_id, NULL::BIGINT AS id, []::BIGINT[] AS used UNION ALL
  SELECT o.i, o.sub_id, list_filter(ids, lambda x: NOT list_contains(used, x))[1], list_concat(used, list_filter(ids, lambda x: NOT list_contains(used, x))[1:1]) FROM run JOIN o ON o.i = run.i + 1)
SELECT sub_id, id FROM run WHERE id IS NOT NULL""",
    "d16_composites": _ENTITIES + " SELECT * FROM comp",
    "d17_sibling_aliases": _ENTITIES + rf""", al AS (SELECT sub_id, a, alias, {_KEY.format("alias")} AS k FROM (SELECT p_partkey AS sub_id, a, unnest([p_name, 'the ' || p_name, p_name || ' of ' || p_brand, p_brand]) AS alias FROM p WHERE p_partkey % 2 = 1))
SELECT sub_id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM al WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.a = al.a AND s.sub_id <> al.sub_id AND (s.name = al.k OR (length(s.name) >= 3 AND contains(al.k, s.name)))) GROUP BY 1""",
    "d21_append_unseen": "WITH b AS (SELECT c_custkey, c_nationkey, c_mktsegment || c_custkey % 1000 AS account FROM customer WHERE c_custkey % 2 = 0) SELECT * FROM b UNION ALL SELECT * FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 10000000 END AS c_custkey, c_nationkey, c_mktsegment || (c_custkey + 1) % 1000 AS account FROM customer) x WHERE c_custkey NOT IN (SELECT c_custkey FROM b) AND account NOT IN (SELECT account FROM b)",
    "b19_reading": "SELECT c_custkey, CASE WHEN v THEN given WHEN g THEN 'はいしまりう' ELSE plain END AS reading, NOT v AND (g OR plain <> '') AS inferred FROM (SELECT c_custkey, ['" + "', '".join(n[1] for n in NAMES) + "'][c_custkey % 6 + 1] AS given, ['" + "', '".join(n[2] if i < 4 else "" for i, n in enumerate(NAMES)) + "'][c_custkey % 6 + 1] AS plain, c_acctbal > 5000 AND c_nationkey < 20 AND c_custkey % 6 < 4 AS v, c_custkey % 6 = 4 AND c_custkey IN (SELECT s_suppkey FROM supplier) AND c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AS g FROM customer)",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
ORACLES = {name: sql for name, sql in ORACLES.items() if sql}
