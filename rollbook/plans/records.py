"""Queries of whole records: merges with lists, overrides, submissions, metrics and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..operators import identity, overlay, screening
from ..sources import files
from .common import table
from .filters import _CLEAN

#: Beginnings of URLs that a submission may shorten.
SHORT = {"x:": "https://x.com/", "t:": "https://www.tiktok.com/@", "w:": "https://www.twitch.tv/"}


def _text(n: str):
    return F.col(n).cast("string")


def a2_bindings(spark, sf_dir):
    """Customers' fields as nested bindings in JSON, some of which aren't there, flat again."""
    value = lambda c: F.struct(c.alias("value"))
    row = F.struct(F.when(F.col("c_custkey") % 3 > 0, value(F.concat(F.lit(" "), "c_name"))).alias("label"), F.when(F.col("c_acctbal") > 0, value(F.col("c_mktsegment"))).alias("kana"), value(_text("c_nationkey")).alias("channel"))
    return files.bindings(table(spark, sf_dir, "customer").select("c_custkey", F.to_json(row).alias("row")), "row", ["label", "kana", "channel"]).drop("row")


def a6_submission_file(spark, sf_dir):
    """Parts as lines of a TSV file: some with two names and readings, some with two names and one reading."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit("-"), k)
    names = F.when(k % 3 > 0, F.concat(name, F.lit("／"), "p_brand")).otherwise(name)
    readings = F.when(k % 3 == 1, F.concat(F.lit("r／"), "p_type")).otherwise(F.col("p_type"))
    urls = F.concat(F.lit("x:u"), k, F.when(k % 2 == 0, F.concat(F.lit("  w:T"), k)).otherwise(""), F.lit(" https://a.example/q:1 z:"))
    path = files.scratch(spark, "submissions")
    table(spark, sf_dir, "part").select(F.concat_ws("\t", names, readings, urls)).write.text(path)
    return files.read_submissions(spark, path, SHORT).select("name", "reading", F.array_join("urls", " ").alias("urls"))


def d1_record_overlay(spark, sf_dir):
    """Two layers of customers: the later one's fields win, aliases are a union, accounts all stay, sources are one map."""
    c = table(spark, sf_dir, "customer")
    account = F.concat(F.lit("x:"), F.col("c_custkey") % 7)
    base = c.select("c_custkey", F.col("c_name").alias("name"), F.array("c_name").alias("aliases"), F.array(account).alias("accounts"), F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), "c_mktsegment").alias("sources"))
    extra = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.upper("c_name")).alias("name"), F.array("c_name", F.upper("c_name")).alias("aliases"), F.array(account, F.lit("y")).alias("accounts"), F.create_map(F.lit("a"), F.lit("extra"), F.lit("c"), F.lit("new")).alias("sources"))
    out = overlay.latest_fields([base, extra], "c_custkey", lists=("aliases",), joined=("accounts",), maps=("sources",))
    pairs = F.array_sort(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("c_custkey", "name", *(F.array_join(x, ",").alias(x) for x in ("aliases", "accounts")), F.array_join(pairs, ",").alias("sources"))


def _named_parts(spark, sf_dir):
    """Parts under names and types as keys, on the channel of their brand and size; every seventh has two channels."""
    k, channel = F.col("p_partkey"), F.concat_ws("-", "p_brand", "p_size")
    keys = F.array(t.match_key("p_name", composed=True), t.match_key("p_type", composed=True))
    channels = F.when(k % 7 == 0, F.array(channel, F.lit("other"))).otherwise(F.array(channel))
    return table(spark, sf_dir, "part").select(k.alias("id"), k.alias("ord"), channels.alias("channels"), keys.alias("keys"), (k % 5 == 0).alias("fixed"), (k % 11 == 0).alias("protected"), "p_name", "p_type")


def d7_platform_details(spark, sf_dir):
    """Customers' platforms: by accounts, named with and without a source, primary with and without evidence."""
    k = F.col("c_custkey")
    source = F.when(k % 3 == 0, "https://a.example/").when(k % 3 == 1, "http://a.example/")
    records = table(spark, sf_dir, "customer").select(k, F.array(F.lit("twitch"), F.lit("radio")).alias("platforms"), F.create_map(F.lit("twitch"), source, F.lit("radio"), F.lit("https://a.example/")).alias("platform_sources"), F.array(F.lit("kick"), F.lit("radio")).alias("primary_platforms"), F.when(k % 2 == 0, "https://b.example/").alias("primary_source"), F.when(k % 5 > 0, "said so").otherwise("").alias("primary_evidence"))
    accounts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("fax").alias("platform"))
    return u.platform_details(records, accounts, "c_custkey", ("x", "twitch", "kick")).select("c_custkey", *(F.array_join(c, ",").alias(c) for c in ("known", "primary")))


def d9_one_candidate(spark, sf_dir):
    """Parts that are the one earlier part of their channel with a key in common."""
    return identity.one_candidate(_named_parts(spark, sf_dir))


def d9_merged_records(spark, sf_dir):
    """Those parts merged: blank types filled, names of merged parts as aliases."""
    parts = _named_parts(spark, sf_dir)
    records = parts.select("id", F.concat("p_name", F.lit("#"), F.col("id") % 3).alias("name"), F.when(F.col("id") % 2 == 0, F.col("p_type")).alias("kind"), F.array(F.col("id").cast("string")).alias("profiles"), F.array("p_name").alias("aliases"))
    out = identity.merged_duplicates(records, identity.one_candidate(parts), "id", "name", "aliases", lists=("profiles",))
    return out.select("id", "name", "kind", *(F.array_join(F.array_sort(x), ",").alias(x) for x in ("aliases", "profiles")))


def d12_applications(spark, sf_dir):
    """Customers under suppliers' applications, which mean them by id, by account, by name, or mean none."""
    key, n = F.col("c_custkey"), F.col("s_suppkey")
    account = F.when(key % 4 == 1, F.concat(F.lit("x:"), F.floor(key / 4))).otherwise(F.concat(F.lit("c:"), key))
    records = table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_name").alias("name"), t.match_key("c_name", composed=True).alias("name_key"), F.array(F.lower("c_name")).alias("aliases"), F.array(account).alias("accounts"))
    name = F.when(n % 3 == 2, F.concat(F.lit("Customer#"), F.lpad((n * 4 + 2).cast("string"), 9, "0"))).otherwise(F.concat("s_name", F.lit("!")))
    said = F.concat(F.when((n % 3 == 1) & (n % 2 == 0), "x:").otherwise("z:"), n)
    apps = table(spark, sf_dir, "supplier").select(n.alias("app_id"), F.when(n % 3 == 0, n * 4).otherwise(n + 100_000_000).alias("id"), name.alias("name"), t.match_key(name, composed=True).alias("name_key"), F.array(F.concat(F.lit("a"), n)).alias("aliases"), F.array(said).alias("accounts"))
    return identity.with_applications(records, apps).select("id", "name", *(F.array_join(F.array_sort(x), ",").alias(x) for x in ("aliases", "accounts")))


def d13_renamed(spark, sf_dir):
    """Customers under overrides from nations, which mean them by a former name, an id or an account."""
    n = F.col("n_nationkey")
    padded = F.concat(F.lit("Customer#"), F.lpad((n * 5).cast("string"), 9, "0"))
    overrides = table(spark, sf_dir, "nation").select(n.alias("place"), (n * 3).cast("long").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("reading"), F.array(F.concat(F.lit("x:"), n * 2)).alias("accounts"), F.array(padded).alias("old_names"), F.array(t.match_key(padded, composed=True)).alias("old_keys"))
    c = table(spark, sf_dir, "customer")
    records = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), t.match_key("c_name", composed=True).alias("name_key"), F.lit("").alias("reading"), F.lit(True).alias("inferred"), F.array(F.lower("c_name")).alias("aliases"), F.array(F.concat(F.lit("x:"), F.col("c_custkey") % 500)).alias("accounts"))
    return overlay.renamed(records, overrides).select("id", "name", "reading", "inferred", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


def d18_submission_baseline(spark, sf_dir):
    """Customers in two layers under suppliers' submissions, which mean them by id, by name or by account."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key, n = F.col("c_custkey"), F.col("s_suppkey")
    layer = c.select(key.alias("id"), F.col("c_name").alias("name"), t.match_key("c_name", composed=True).alias("name_key"), F.lit("old").alias("reading"), F.array(F.lower("c_name")).alias("aliases"), F.array(F.concat(F.lit("x:"), key % 400)).alias("accounts"))
    extra = layer.where("id % 3 = 0").withColumns({"reading": F.lit(None).cast("string"), "accounts": F.array(F.lit("y"))})
    name = F.when(n % 2 == 0, F.concat(F.lit("Customer#"), F.lpad((n + 7).cast("string"), 9, "0"))).otherwise(F.col("s_name"))
    subs = s.select(n.alias("sub_id"), (F.when(n % 5 == 0, n * 2).otherwise(n + 100_000_000)).alias("id"), name.alias("name"), t.match_key(name, composed=True).alias("name_key"), F.concat(F.lit("r"), n).alias("reading"), F.array(F.concat(F.lit("alias"), n % 9)).alias("aliases"), F.array(F.when(n % 3 == 0, F.concat(F.lit("x:"), n)).otherwise(F.concat(F.lit("s:"), n))).alias("accounts"), (n % 4 == 0).alias("by_id_only"))
    out = identity.with_submissions([layer, extra], subs)
    return out.select("id", "name", "reading", *(F.array_join(F.array_sort(x), ",").alias(x) for x in ("aliases", "accounts")))


def d20_restored(spark, sf_dir):
    """Customers with even keys, and a family (of nations below ten), of which those with negative balance are missing."""
    c = table(spark, sf_dir, "customer")
    licence = F.lit(None).cast("string").alias("licence")
    base = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), licence)
    family = c.where("c_nationkey < 10").select("c_custkey", F.lower("c_name").alias("name"), F.lit("Unlicense").alias("licence"))
    present = c.where("c_nationkey < 10 AND c_acctbal >= 0 AND c_custkey % 2 = 0")
    return overlay.restored(base, present, family, "c_custkey", ("licence",), family.count())


def d23_account_metrics(spark, sf_dir):
    """Customers' metrics by account, under counts from orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key, n = F.col("c_custkey"), F.col("o_orderkey")
    account = lambda m: F.concat(F.lit("a"), key % m)
    accounts = c.select(key.alias("id"), F.lit("youtube").alias("platform"), account(300).alias("account_id")).union(c.where("c_custkey % 2 = 0").select(key, F.lit("twitch"), account(200)))
    old = accounts.where("id % 3 = 0").select("*", F.lit(1).cast("long").alias("count"), F.lit("https://old.example").alias("source"))
    platform = F.element_at(F.array(F.lit("youtube"), F.lit("twitch"), F.lit("kick")), (n % 3 + 1).cast("int"))
    count = F.when(n % 10 == 0, -1).otherwise(F.col("o_totalprice").cast("long"))
    rows = o.select(platform.alias("platform"), F.concat(F.lit("a"), F.col("o_custkey") % 400).alias("account_id"), count.alias("count"), F.concat(F.when(n % 7 == 0, "http").otherwise("https"), F.lit("://new.example")).alias("source"), n.alias("ord"))
    out = identity.attached_metrics(accounts, old, rows, ("youtube", "twitch"))
    return out.select("id", F.array_join(F.transform("metrics", lambda m: F.concat_ws(" ", m["platform"], m["account_id"], m["count"].cast("string"), m["source"])), ",").alias("metrics"))


def c4_selected(spark, sf_dir):
    """Parts on a platform (of their size), of a tag (their type), with a word, a reading that is estimated and Latin script."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.when(F.col("p_size") < 40, F.array(F.lit("x"), F.lit("twitch"))).otherwise(F.array(F.lit("x"))).alias("platforms"), F.col("p_type").alias("tag"), F.when(k % 5 == 0, "リング").otherwise(F.col("p_name")).alias("name"), t.match_key("p_name", composed=True).alias("name_key"), F.when(k % 3 > 0, "r").alias("reading"), (k % 3 == 1).alias("inferred"))
    return screening.selected(rows, "twitch", "ECONOMY", "r", "estimated", "latin").select("p_partkey").union(screening.selected(rows, reading="missing", script="kana").select("p_partkey"))


def c13_sanitised_lists(spark, sf_dir):
    """Pages' lists of sources without those on hosts that aren't clear, but for marked ones."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.array(F.concat(F.lit("https://bad.example/"), F.when(F.col("page_id") % 2 == 0, "Free").otherwise("own")), F.when(F.col("page_id") % 3 == 0, F.lit("https://bad.example/x")).otherwise(F.col("url"))).alias("name_sources"))
    return screening.sanitised_lists(rows, ["name_sources"], ("bad.example",), ("free",)).select("page_id", F.array_join("name_sources", " ").alias("name_sources"))


def c6_fan_operated(spark, sf_dir):
    """Pages by words of their title, and by other words of their text."""
    title = t.clean_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", screening.fan_operated(title, F.col("html"), r"(?i)^[a-f]", r"(?i)\b(?:fans?|clips?) channel\b|Apache").alias("fan"))


def _profile_pages(spark, sf_dir):
    """Pages with a profile in front: a name, accounts (one of them twice, one beside the profile) and a day of debut."""
    k = F.col("page_id")
    link = lambda start: F.concat(F.lit(f'<a class="l" href="{start}'), k, F.lit('">a</a>'))
    debut = F.when(k % 4 == 0, "2030-01-02").when(k % 4 == 1, "2024年5月6日").when(k % 4 == 2, "soon").otherwise("2023-02-03")
    scope = F.concat(F.lit("<main>"), F.when(k % 3 > 0, F.concat(link("https://x.com/User"), link("https://www.twitch.tv/T"), link("https://twitter.com/user"))).otherwise(""), F.lit("</main>"), link("https://kick.com/K"))
    head = F.concat(F.lit("<h2>"), F.when(k % 7 > 0, F.concat(F.lit("N &amp; <b>"), k, F.lit("</b>"))).otherwise(" "), F.lit("</h2><i>"), debut, F.lit("</i>"), scope)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, "html").alias("html"))


def e2_fragment_accounts(spark, sf_dir):
    """The accounts that pages link to, with the place of the first link."""
    return u.fragment_accounts(_profile_pages(spark, sf_dir), "page_id", "html", u.rule_table(spark))


def e10_profile_rows(spark, sf_dir):
    patterns = {"name": "(?s)<h2>(.*?)</h2>", "scope": "(?s)<main>(.*?)</main>", "debut": "<i>(.*?)</i>", "badge": r'<html lang="(\w+)"'}
    out = screening.profiles(_profile_pages(spark, sf_dir), "page_id", "html", patterns, u.rule_table(spark), F.lit("2025-01-01").cast("date"))
    return out.select("page_id", "name", "badge", F.col("debut").cast("string").alias("debut"), F.array_join("accounts", ",").alias("accounts"))


def e11_owned_items(spark, sf_dir):
    """Orders that suppliers link to (by their line items) and whose channel is the supplier's own."""
    channel = lambda c: F.concat(F.lit("c"), F.col(c) % 7).alias("channel")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("record"), F.col("l_orderkey").alias("item"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), channel("o_custkey"), F.col("o_orderdate").cast("date").alias("published"), (F.col("o_totalprice") - 5000).alias("views"), (F.col("o_orderstatus") == "O").alias("upcoming"))
    return screening.owned_items(links, items, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record"), channel("s_suppkey")), F.lit("1996-01-01").cast("date"))


def e4_text_with_metas(spark, sf_dir):
    """Pages' visible text under metadata, of which some counts."""
    head = F.concat(F.lit('<meta property="og:title" content="T'), "page_id", F.lit("\"><META content='D' name='description'><meta name=\"robots\" content=\"no\"><noscript>n</script></noscript>"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.visible_text(F.concat(head, "html")).cast("binary"), 256).alias("text"))


def e5_json_block(spark, sf_dir):
    """Members in a JSON block of each page, which every fifth page lacks and every seventh has broken."""
    k = F.col("page_id")
    body = F.concat(F.lit('{"total": '), k, F.lit(', "members": [{"name": "m'), k, F.lit('"}, {"name": "'), F.md5("url"), F.lit('"}]'), F.when(k % 7 > 0, "}").otherwise(""))
    block = F.concat(F.lit('<script type="application/json" id="'), F.when(k % 5 > 0, "roster").otherwise("roster2"), F.lit('">'), body, F.lit("</script>"))
    value = t.embedded_json(F.concat("html", block), "roster", "total int, members array<struct<name:string>>")
    pages = table(spark, sf_dir, "pages").select("page_id", value.alias("v"))
    return pages.where("v.members IS NOT NULL").select("page_id", F.col("v.total").alias("total"), F.posexplode("v.members").alias("place", "m")).select("page_id", "total", "place", "m.name")


def k6_contract(spark, sf_dir):
    """Replies about events: whole, with a key too many, of other kinds, in conflict or cut off."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda m, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % m + 1).cast("int"))
    reply = F.concat(F.lit('{"decision": "'), pick(3, "approve", "needs_review", "reject"), F.lit('", "reason": "'), pick(2, "ok", "unclear"), F.when(k % 10 == 9, F.lit('", "x": 1}')).when(k % 10 == 8, F.lit("")).otherwise('"}'))
    said = screening.decision(reply, ("ok", "unclear", "insufficient_evidence"), F.col("event_type") != "error")
    return table(spark, sf_dir, "events").select("event_id", said.alias("d")).select("event_id", "d.*")


_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_ONE = rf"""
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand || '-' || p_size AS ch, [{_KEY.format("p_name")}, {_KEY.format("p_type")}] AS ks, p_partkey % 5 = 0 AS fixed FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY id) AS i FROM p WHERE id % 11 <> 0 AND id % 7 <> 0),
run AS (SELECT ch, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS kept, []::STRUCT(k VARCHAR, o BIGINT)[] AS own FROM (SELECT DISTINCT ch FROM o) UNION ALL
  SELECT ch, i, id, kept, list_concat(own, list_transform(ks, lambda x: {{'k': x, 'o': kept}})) FROM (SELECT *, CASE WHEN NOT fixed AND len(c) = 1 THEN c[1] ELSE id END AS kept
    FROM (SELECT o.*, own, list_distinct(list_transform(list_filter(own, lambda x: list_contains(ks, x.k)), lambda x: x.o)) AS c FROM run JOIN o ON o.ch = run.ch AND o.i = run.i + 1))),
m AS (SELECT p.id, coalesce(kept, p.id) AS kept_id FROM p LEFT JOIN run ON run.id = p.id)"""

ORACLES = {
    "a2_bindings": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS label, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS kana, c_nationkey::VARCHAR AS channel FROM customer",
    "a6_submission_file": "WITH k AS (SELECT *, 'https://x.com/u' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' https://www.twitch.tv/T' || p_partkey ELSE '' END || ' https://a.example/q:1 z:' AS urls, p_name || '-' || p_partkey AS n FROM part) SELECT n || CASE WHEN p_partkey % 3 = 2 THEN '／' || p_brand ELSE '' END AS name, CASE WHEN p_partkey % 3 = 1 THEN 'r' ELSE p_type END AS reading, urls FROM k UNION ALL SELECT p_brand, p_type, urls FROM k WHERE p_partkey % 3 = 1",
    "d1_record_overlay": "SELECT c_custkey, CASE WHEN e AND c_acctbal > 0 THEN upper(c_name) ELSE c_name END AS name, c_name || CASE WHEN e AND upper(c_name) <> c_name THEN ',' || upper(c_name) ELSE '' END AS aliases, 'x:' || c_custkey % 7 || CASE WHEN e THEN ',x:' || c_custkey % 7 || ',y' ELSE '' END AS accounts, CASE WHEN e THEN 'a=extra,b=' || c_mktsegment || ',c=new' ELSE 'a=base,b=' || c_mktsegment END AS sources FROM (SELECT *, c_custkey % 3 = 0 AS e FROM customer)",
    "d9_one_candidate": _ONE + " SELECT * FROM m",
    "d9_merged_records": _ONE + """,
r AS (SELECT m.id, kept_id, p_name || '#' || m.id % 3 AS name, p_name, CASE WHEN m.id % 2 = 0 THEN p_type END AS kind FROM m JOIN part ON m.id = p_partkey),
g AS (SELECT kept_id, arg_min(name, id) AS own, coalesce(arg_min(kind, id) FILTER (id = kept_id), arg_min(kind, id)) AS kind, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS profiles FROM r GROUP BY 1),
a AS (SELECT kept_id, p_name AS v FROM r UNION SELECT kept_id, name FROM r WHERE id <> kept_id)
SELECT g.kept_id AS id, own AS name, kind, string_agg(v, ',' ORDER BY v) AS aliases, profiles FROM g JOIN a USING (kept_id) WHERE v <> own GROUP BY ALL""",
    "d12_applications": """WITH a AS (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 4 WHEN 2 THEN s_suppkey * 4 + 2 ELSE CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 4 + 1 END END AS c_custkey, CASE WHEN s_suppkey % 3 = 2 THEN 'Customer#' || lpad((s_suppkey * 4 + 2)::VARCHAR, 9, '0') ELSE s_name || '!' END AS name, CASE WHEN s_suppkey % 3 = 1 AND s_suppkey % 2 = 0 THEN 'x:' ELSE 'z:' END || s_suppkey AS account FROM supplier),
c AS (SELECT *, CASE WHEN c_custkey % 4 = 1 THEN 'x:' || c_custkey // 4 ELSE 'c:' || c_custkey END AS mine FROM customer)
SELECT c_custkey AS id, coalesce(name, c_name) AS name, array_to_string(list_sort([lower(c_name)] || CASE WHEN name IS NULL THEN [] WHEN name = c_name THEN ['a' || s_suppkey] ELSE ['a' || s_suppkey, c_name] END), ',') AS aliases, CASE WHEN account IS NULL OR account = mine THEN mine ELSE array_to_string(list_sort([mine, account]), ',') END AS accounts FROM c LEFT JOIN a USING (c_custkey)
UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 4 ELSE s_suppkey + 100000000 END, name, 'a' || s_suppkey, account FROM a WHERE c_custkey IS NULL OR c_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "d13_renamed": """WITH n AS (SELECT *, 'Customer#' || lpad((n_nationkey * 5)::VARCHAR, 9, '0') AS old FROM nation),
h AS (SELECT c_custkey, min(n_nationkey) AS n_nationkey FROM (SELECT c_custkey, n_nationkey FROM customer JOIN n ON c_name = old UNION ALL SELECT c_custkey, n_nationkey FROM customer JOIN n ON c_custkey = n_nationkey * 3 UNION ALL SELECT c_custkey, n_nationkey FROM customer JOIN n ON c_custkey % 500 = n_nationkey * 2) GROUP BY 1)
SELECT c_custkey AS id, coalesce(n_name, c_name) AS name, coalesce(lower(n_name), '') AS reading, n_name IS NULL AS inferred, array_to_string(list_sort(list_distinct([lower(c_name)] || CASE WHEN n_name IS NULL THEN [] ELSE [c_name, old] END)), ',') AS aliases FROM customer LEFT JOIN h USING (c_custkey) LEFT JOIN n USING (n_nationkey)""",
    "d18_submission_baseline": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey * 2 ELSE s_suppkey + 100000000 END AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad((s_suppkey + 7)::VARCHAR, 9, '0') ELSE s_name END AS name, 'alias' || s_suppkey % 9 AS alias, CASE WHEN s_suppkey % 3 = 0 THEN 'x:' ELSE 's:' END || s_suppkey AS account FROM supplier),
m AS (SELECT k, c_custkey FROM s JOIN customer ON id = c_custkey UNION SELECT k, c_custkey FROM s JOIN customer ON name = c_name WHERE k % 4 <> 0 UNION SELECT k, c_custkey FROM s JOIN customer ON account = 'x:' || c_custkey % 400),
g AS (SELECT c_custkey, max(k) AS k, list(name) || list(alias) AS al, list(DISTINCT account) AS acc FROM m JOIN s USING (k) GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, coalesce('r' || k, 'old') AS reading, array_to_string(list_sort(list_distinct([lower(c_name)] || coalesce(al, []))), ',') AS aliases, array_to_string(list_sort(list_distinct(['x:' || c_custkey % 400] || coalesce(acc, [])) || CASE WHEN c_custkey % 3 = 0 THEN list_distinct(['y'] || coalesce(acc, [])) ELSE [] END), ',') AS accounts FROM customer LEFT JOIN g USING (c_custkey)
UNION ALL SELECT id, name, 'r' || k, alias, account FROM s WHERE k NOT IN (SELECT k FROM m)""",
    "d20_restored": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN c_name WHEN lost THEN lower(c_name) END AS name, CASE WHEN lost THEN 'Unlicense' END AS licence FROM (SELECT *, c_nationkey < 10 AND NOT (c_acctbal >= 0 AND c_custkey % 2 = 0) AS lost FROM customer) WHERE lost OR c_custkey % 2 = 0",
    "d23_account_metrics": """WITH a AS (SELECT c_custkey AS id, 'youtube' AS platform, 'a' || c_custkey % 300 AS account FROM customer UNION ALL SELECT c_custkey, 'twitch', 'a' || c_custkey % 200 FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'youtube' ELSE 'twitch' END AS platform, 'a' || o_custkey % 400 AS account, arg_max(trunc(o_totalprice)::BIGINT, o_orderkey) AS n FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 GROUP BY 1, 2)
SELECT id, string_agg(platform || ' ' || account || ' ' || coalesce(n || ' https://new.example', '1 https://old.example'), ',' ORDER BY platform, account) AS metrics FROM a LEFT JOIN r USING (platform, account) WHERE n IS NOT NULL OR id % 3 = 0 GROUP BY id""",
    "c4_selected": rf"SELECT p_partkey FROM part WHERE p_size < 40 AND p_type = 'ECONOMY' AND contains({_KEY.format('p_name')}, 'r') AND p_partkey % 3 = 1 AND p_partkey % 5 <> 0 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 = 0",
    "d7_platform_details": "SELECT c_custkey, array_to_string(list_sort(list_distinct(CASE WHEN p THEN ['kick'] ELSE [] END || CASE WHEN c_custkey % 3 = 0 THEN ['twitch'] ELSE [] END || CASE WHEN x THEN ['x'] ELSE [] END)), ',') AS known, CASE WHEN p THEN 'kick' ELSE '' END AS primary FROM (SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 5 > 0 AS p, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) AS x FROM customer)",
    "e2_fragment_accounts": "SELECT page_id, 'x' AS platform, 'user' || page_id AS account_id, 0 AS place FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 'twitch', 't' || page_id, 1 FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 'kick', 'k' || page_id, CASE WHEN page_id % 3 > 0 THEN 3 ELSE 0 END FROM pages",
    "e10_profile_rows": r"""SELECT page_id, 'N & ' || page_id AS name, regexp_extract(html, '<html lang="(\w+)"', 1) AS badge, CASE page_id % 4 WHEN 1 THEN '2024-05-06' WHEN 3 THEN '2023-02-03' END AS debut, 'x:user' || page_id || ',twitch:t' || page_id AS accounts FROM pages WHERE page_id % 3 > 0 AND page_id % 7 > 0""",
    "e11_owned_items": "SELECT DISTINCT l_suppkey AS record, l_orderkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_custkey % 7 = s_suppkey % 7 AND o_orderdate::DATE <= DATE '1996-01-01' AND o_totalprice > 5000 AND o_orderstatus <> 'O'",
    "c6_fan_operated": rf"SELECT page_id, regexp_matches({_CLEAN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '(?i)^[a-f]') OR regexp_matches(html, '(?i)\b(?:fans?|clips?) channel\b|Apache') AS fan FROM pages",
    "e4_text_with_metas": f"SELECT page_id, sha256('T' || page_id || ' D' || CASE WHEN v <> '' THEN ' ' || v ELSE '' END) AS text FROM (SELECT page_id, {_CLEAN.format(chr(39).join(['regexp_replace(html, ', '(?is)<(?:script|style|noscript)[ >].*?</(?:script|style|noscript)>', ', ', ' ', ', ', 'g', ')']))} AS v FROM pages)",
    "e5_json_block": "SELECT page_id, page_id::INT AS total, i::INT AS place, CASE i WHEN 0 THEN 'm' || page_id ELSE md5(url) END AS name FROM pages, (SELECT unnest([0, 1]) AS i) WHERE page_id % 5 > 0 AND page_id % 7 > 0",
    "k6_contract": "SELECT event_id, CASE WHEN ok THEN CASE WHEN event_type = 'error' THEN 'needs_review' ELSE d END END AS decision, CASE WHEN ok THEN CASE WHEN event_type = 'error' THEN 'insufficient_evidence' ELSE r END END AS reason FROM (SELECT *, k % 10 < 8 AND d <> 'reject' AND (d = 'approve') = (r = 'ok') AS ok FROM (SELECT *, ['approve', 'needs_review', 'reject'][k % 3 + 1] AS d, ['ok', 'unclear'][k % 2 + 1] AS r FROM (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events)))",
    "c13_sanitised_lists": "SELECT page_id, nullif(concat_ws(' ', CASE WHEN page_id % 2 = 0 THEN 'https://bad.example/Free' END, CASE WHEN page_id % 3 <> 0 THEN url END), '') AS name_sources FROM pages",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
