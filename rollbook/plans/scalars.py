"""Queries of the scalar normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from .common import table


def b1_search_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.search_key("text").cast("binary"), 256).alias("key"))


def b2_match_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.match_key("p_name").alias("key"))


def b3_space_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", t.space_key("c_name").alias("key"), t.space_key("c_mktsegment").alias("segment_key"))


def b4_casefold_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.casefold("text").cast("binary"), 256).alias("key"))


def b5_kana_reading(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.kana_reading("p_name").alias("reading"))


def b5_kana_readings(spark, sf_dir):
    """Readings of names in kana of either kind, with separators, some of them wide, and of names with something else."""
    k = F.col("p_partkey")
    name = F.concat(F.translate(k.cast("string"), "0123456789", "アいウえオかキくケこ"), F.when(k % 3 == 0, "・").when(k % 3 == 1, "　").otherwise("ー"), F.when(k % 7 == 0, "x").when(k % 5 == 0, "ﾈｺ").otherwise("ヴ"))
    return table(spark, sf_dir, "part").select("p_partkey", t.kana_reading(name).alias("reading"))


def b6_safe_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.safe_url("url").alias("url"))


def b7_host_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.host_key("url").alias("host"))


def b8_canonical_account(spark, sf_dir):
    rules = u.rule_table(spark, TEST_RULES)
    pages = table(spark, sf_dir, "pages").withColumn("url", F.regexp_replace("url", r"://(?:blog|m)\.", "://www."))
    return u.with_account(pages, "url", rules).select("page_id", "platform", "account_id")


#: Rules for the hosts of the given pages, tried in this order.
TEST_RULES = (
    ("organisation", tuple(f"{w}.example.org" for w in ("therhe", "theres", "theran", "thering", "therst")), r"/(?:[a-z]{2})/(\d+)", False),
    ("commerce", ("casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com"), r"/[a-z]{2}/(\d+)(?:\.html)?", False),
    ("network", tuple(f"{w}.example.net" for w in ("ththth", "tiontion", "theron", "ththre", "ththha")), r"/([a-z]{2}/\d+)", True),
)


def _linked(spark, sf_dir):
    """A link to an account for each customer, in twelve forms by its key."""
    k = F.col("c_custkey").cast("string")
    uuid = F.regexp_replace(F.md5(k.cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    forms = (
        ("https://www.youtube.com/@Name", k, "?x=1"), ("https://twitter.com/Example", k, ""), ("https://x.com/i/user/", k, "/"), ("https://whowatch.tv/profile/w%3Aab", k, ""), ("https://mirrativ.page.link/?link=https%3A%2F%2Fwww.mirrativ.com%2Fuser%2F", k, "&a=1"),
        ("https://web.colorsing.com/share/user?user_id=", uuid, "&amp;utm=t"), ("https://www.tiktok.com/@EX", k, "/live"), ("https://www.spooncast.net/jp/channel/", k, "/tab/home"), ("https://twitch.tv/directory", F.lit(""), ""), ("http://web.iriam.app/s/user?id=AB", k, ""),
        ("https://sp.nicovideo.jp/user/", k, "/"), ("https://tiktok.com.evil.test/@x", k, ""),
    )
    link = F.lit(None).cast("string")
    for i, (head, middle, tail) in enumerate(forms):
        link = F.when(F.col("c_custkey") % 12 == i, F.concat(F.lit(head), middle, F.lit(tail))).otherwise(link)
    return table(spark, sf_dir, "customer").select("c_custkey", link.alias("url"))


def b8_platform_accounts(spark, sf_dir):
    return u.with_account(_linked(spark, sf_dir), "url", u.rule_table(spark)).select("c_custkey", "platform", "account_id", "account_url")


def b9_url_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(u.url_key("url").alias("url_key")).agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


def b10_candidate_url(spark, sf_dir):
    """Links of suppliers to videos in five forms, and those of customers to accounts."""
    video = F.substring(F.md5(F.col("s_name").cast("binary")), 1, 11)
    heads = ("https://youtu.be/", "https://m.youtube.com/watch?t=1&v=", "https://www.youtube.com/shorts/", "https://youtube.com/live/", "http://youtu.be/")
    link = F.lit("https://www.youtube.com/watch?v=short")
    for i, head in enumerate(heads):
        link = F.when(F.col("s_suppkey") % 6 == i, F.concat(F.lit(head), video)).otherwise(link)
    links = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), link.alias("url")).union(_linked(spark, sf_dir))
    return u.with_candidate(links, "url", u.rule_table(spark)).select("id", "candidate")


def b11_own_id(spark, sf_dir):
    """Customers' channels: a field, an id that names a channel, or a link, by what there is."""
    k = F.concat(F.lit("UC"), F.substring(F.md5(F.col("c_name").cast("binary")), 1, 22))
    c = table(spark, sf_dir, "customer")
    field = F.when(F.col("c_custkey") % 3 == 0, k).otherwise(F.lit("UCshort"))
    source = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("youtube:"), F.reverse(k))).when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("youtube:"), F.lit("UC"), F.substring(F.md5(k.cast("binary")), 1, 22))).otherwise("other")
    links = F.array(F.lit("https://x.com/a"), F.concat(F.lit("https://www.youtube.com/channel/UC"), F.substring(F.md5(F.reverse("c_name").cast("binary")), 1, 22), F.lit("/videos")))
    return c.select("c_custkey", u.own_channel(field, source, links).alias("own_id"))


def b12_title_clean(spark, sf_dir):
    """Customers' names as titles of pages: with the endings of eleven platforms, some with another platform's, some tagged."""
    ends = {"youtube": " - YouTube", "twitch": " | twitch ", "tiktok": " (@some.one) | TikTok", "iriam": "-IRIAM", "reality": " - REALITY", "avvy": " | Avvy", "showroom": " - SHOWROOM live", "17live": " | 17LIVE - more", "mirrativ": " - Mirrativ", "niconico": " - ニコニコ動画", "kick": " - Kick"}
    k = F.col("c_custkey")
    names, tails = F.array(*map(F.lit, ends)), F.array(*map(F.lit, ends.values()))
    head = F.when(k % 5 == 0, "[ VTuber ] ").when(k % 5 == 1, "<b>").otherwise("")
    title = F.concat(head, "c_name", F.when(k % 7 == 0, F.repeat(F.lit("x"), 120)).otherwise(""), F.get(tails, (k % 11).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", t.clean_title(title, F.get(names, ((k + F.when(k % 13 == 0, 1).otherwise(0)) % 11).cast("int"))).alias("title"))


def b13_text_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.clean_text("html", every=True).cast("binary"), 256).alias("clean"))


def b14_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.slug("p_name").alias("slug"), t.stable_id("p_name", F.col("p_partkey").cast("string")).alias("id"))


def b15_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy年M月d日"))
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.lit("1995-13-45")).otherwise(written)
    d = o.select("o_orderkey", broken.alias("written"))
    return d.select("o_orderkey", t.iso_date("written").cast("string").alias("date"), t.past_date("written", F.lit("1996-01-01").cast("date")).cast("string").alias("past"))


def b15_timestamps(spark, sf_dir):
    """Orders' moments, written with a zone, without one, in milliseconds or not at all."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(key == 0, F.concat(day, F.lit("T10:20:30Z"))).when(key == 1, F.concat(day, F.lit("T10:20:30+0900"))).when(key == 2, F.concat(day, F.lit(" 10:20:30.5"))).when(key == 3, F.concat(day, F.lit("T25:00:00Z"))).otherwise((F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string"))
    moment = F.coalesce(t.iso_timestamp(written), F.when(key == 4, t.epoch_ms(written)))
    return o.select("o_orderkey", F.unix_seconds(moment).alias("second"))


def b16_valid_name(spark, sf_dir):
    """How many of a document's lines could be names, by two bounds of length."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(t.valid_name("line")).alias("n_valid"), F.count_if(t.valid_name("line", 120)).alias("n_short"))


def b17_id_prefix(spark, sf_dir):
    ids = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit(":"), F.col("c_custkey"))).when(F.col("c_custkey") % 3 == 1, F.regexp_replace(F.md5(F.col("c_name").cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").groupBy(t.id_prefix(ids).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def b18_name_keys(spark, sf_dir):
    names = F.array(F.concat("p_name", F.lit(" ("), F.col("p_brand"), F.lit(")")), F.concat("p_type", F.lit("/"), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(t.name_keys(names), ",").alias("keys"))


def b20_category(spark, sf_dir):
    c = t.category(F.col("c_mktsegment"), F.when(F.col("c_nationkey") < 5, F.lit("https://a.example/")).otherwise(""), ("BUILDING", "MACHINERY"), "OTHER")
    return table(spark, sf_dir, "customer").groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def b21_bounded(spark, sf_dir):
    money = F.format_number("o_totalprice", 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", t.bounded("o_orderpriority", 4).alias("priority"), t.number(F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(money)).alias("total"))


_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)"
_HOST = f"regexp_replace(lower(regexp_extract(url, '{_PARTS}', 3)), '^(?:www|m)[.]', '')"
HOST_KEY = f"CASE {_HOST} WHEN 'youtu.be' THEN 'youtube.com' WHEN 'twitter.com' THEN 'x.com' ELSE {_HOST} END"
PATH = f"rtrim(regexp_extract(url, '{_PARTS}', 5), '/')"
_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
#: All references that the given pages have; one of & may lack its semicolon.
_EVERY = _CLEAN.format("html").replace("replace(regexp_replace(html", "replace(replace(replace(regexp_replace(html").replace("'&lt;', '<')", "'&copy;', '©'), '&middot;', '·'), '&lt;', '<')").replace("'&amp;', '&')", "'&amp;?', '&', 'g')").replace("trim(regexp_replace(replace(", "trim(regexp_replace(regexp_replace(")
_RULE_HOST = f"regexp_replace(regexp_replace(lower(regexp_extract(url, '{_PARTS}', 3)), '^(?:blog|m)[.]', 'www.'), '^www[.]', '')"
_RULES = "\n    ".join(f"WHEN h IN ({', '.join(repr(h) for h in hosts)}) AND regexp_extract(p, '^{pattern}$', 1) <> '' THEN {{'platform': '{name}', 'id': {'lower' if low else ''}(regexp_extract(p, '^{pattern}$', 1))}}" for name, hosts, pattern, low in TEST_RULES)
_LINE = "line"
_PREPARING = t.PREPARING.replace("(?<!再)", "")  # no lookbehind there, and no such names here
_VALID = f"(length(trim({_LINE})) > 0 AND length({_LINE}) <= {{0}} AND NOT regexp_matches({_LINE}, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches({_LINE}, '{_PREPARING}'))"

ORACLES = {
    "b1_search_key": f"SELECT doc_id, sha256({_KEY.format('text')}) AS key FROM documents",
    "b2_match_key": f"SELECT p_partkey, {_KEY.format('p_name')} AS key FROM part",
    "b3_space_key": r"SELECT c_custkey, regexp_replace(lower(c_name), '\s', '', 'g') AS key, regexp_replace(lower(c_mktsegment), '\s', '', 'g') AS segment_key FROM customer",
    "b4_casefold_key": f"SELECT doc_id, sha256({_KEY.format("replace(text, 'ß', 'ss')")}) AS key FROM documents",
    "b5_kana_reading": "SELECT p_partkey, '' AS reading FROM part",
    "b5_kana_readings": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE translate(p_partkey::VARCHAR, '0123456789', 'あいうえおかきくけこ') || CASE WHEN p_partkey % 3 = 2 THEN 'ー' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'ねこ' ELSE 'ゔ' END END AS reading FROM part",
    "b6_safe_url": f"SELECT page_id, CASE WHEN regexp_extract(url, '{_PARTS}', 1) = 'https' AND regexp_extract(url, '{_PARTS}', 2) = '' AND regexp_extract(url, '{_PARTS}', 4) = '' AND regexp_extract(url, '{_PARTS}', 3) <> '' THEN url END AS url FROM pages",
    "b7_host_key": f"SELECT page_id, {HOST_KEY} AS host FROM pages",
    "b8_canonical_account": f"SELECT page_id, a.platform AS platform, a.id AS account_id FROM (SELECT page_id, CASE {_RULES} END AS a FROM (SELECT page_id, {_RULE_HOST} AS h, {PATH} AS p FROM pages))",
    "b9_url_key": f"SELECT {HOST_KEY} || {PATH} AS url_key, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1",
    "b13_text_clean": f"SELECT page_id, sha256({_EVERY}) AS clean FROM pages",
    "b14_slug": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(sha256(p_name || chr(10) || p_partkey), 1, 24) AS id FROM part",
    "b15_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE::VARCHAR END AS date, CASE WHEN o_orderkey % 10 <> 0 AND o_orderdate::DATE <= DATE '1996-01-01' THEN o_orderdate::DATE::VARCHAR END AS past FROM orders",
    "b16_valid_name": f"SELECT doc_id, count(*) FILTER {_VALID.format(300)} AS n_valid, count(*) FILTER {_VALID.format(120)} AS n_short FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
    "b17_id_prefix": "SELECT CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'uuid' ELSE 'other' END AS prefix, count(*) AS n FROM customer GROUP BY 1",
    "b20_category": "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' WHEN c_mktsegment = 'MACHINERY' OR c_nationkey < 5 THEN 'MACHINERY' ELSE 'OTHER' END AS category, count(*) AS n FROM customer GROUP BY 1",
    "b21_bounded": "SELECT o_orderkey, o_orderpriority[:4] AS priority, CASE WHEN o_orderkey % 7 <> 0 THEN round_even(o_totalprice, 0)::BIGINT END AS total FROM orders",
}
_UUID = "regexp_replace(md5(k), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
ORACLES["b8_platform_accounts"] = f"""
SELECT c_custkey, a[1] AS platform, a[2] AS account_id, a[3] AS account_url FROM (SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN ['youtube', '@name' || k, 'https://youtube.com/@Name' || k] WHEN 1 THEN ['x', 'example' || k, 'https://x.com/example' || k]
  WHEN 2 THEN ['x', 'uid:' || k, 'https://x.com/i/user/' || k] WHEN 3 THEN ['whowatch', 'w:ab' || k, 'https://whowatch.tv/profile/w:ab' || k] WHEN 4 THEN ['mirrativ', k, 'https://mirrativ.com/user/' || k]
  WHEN 5 THEN ['colorsing', {_UUID}, 'https://web.colorsing.com/share/user?user_id=' || {_UUID}] WHEN 6 THEN ['tiktok', '@ex' || k, 'https://www.tiktok.com/@ex' || k] WHEN 7 THEN ['spoon', k, 'https://spooncast.net/jp/channel/' || k || '/tab/home']
  WHEN 9 THEN ['iriam', 'AB' || k, 'https://web.iriam.app/s/user?id=AB' || k] WHEN 10 THEN ['niconico', k, 'https://www.nicovideo.jp/user/' || k] END AS a FROM (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer))"""
ORACLES["b10_candidate_url"] = f"""
SELECT -s_suppkey - 1 AS id, CASE WHEN s_suppkey % 6 IN (0, 1, 3) THEN 'https://www.youtube.com/watch?v=' || md5(s_name)[1:11] WHEN s_suppkey % 6 = 2 THEN 'https://www.youtube.com/shorts/' || md5(s_name)[1:11] END AS candidate FROM supplier
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 12 NOT IN (1, 2, 9) THEN account_url END FROM ({ORACLES["b8_platform_accounts"]})"""
ORACLES["b11_own_id"] = """
SELECT c_custkey, 'UC' || CASE WHEN c_custkey % 3 = 0 THEN md5(c_name)[1:22] WHEN c_custkey % 2 <> 0 AND c_custkey % 5 = 0 THEN md5('UC' || md5(c_name)[1:22])[1:22] ELSE md5(reverse(c_name))[1:22] END AS own_id FROM customer"""
ORACLES["b15_timestamps"] = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN day + 37230 WHEN 1 THEN day + 37230 - 32400 WHEN 2 THEN day + 37230 WHEN 4 THEN epoch(o_orderdate)::BIGINT END AS second
FROM (SELECT *, epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT AS day FROM orders)"""
ORACLES["b12_title_clean"] = """
WITH e AS (SELECT [' - YouTube', ' | twitch', ' (@some.one) | TikTok', '-IRIAM', ' - REALITY', ' | Avvy', ' - SHOWROOM live', ' | 17LIVE - more', ' - Mirrativ', ' - ニコニコ動画', ' - Kick'] AS ends)
SELECT c_custkey, CASE WHEN length(x) <= 120 THEN x ELSE '' END AS title FROM (SELECT c_custkey, c_name || CASE WHEN c_custkey % 7 = 0 THEN repeat('x', 120) ELSE '' END || CASE WHEN c_custkey % 13 = 0 THEN ends[c_custkey % 11 + 1] ELSE '' END AS x FROM customer, e)"""
ORACLES["b18_name_keys"] = r"""
WITH k AS (SELECT p_partkey, i, regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') AS key FROM (SELECT p_partkey, unnest([1, 2, 3]) AS i, unnest([p_name, p_type, p_name]) AS x FROM part))
SELECT p_partkey, string_agg(key, ',' ORDER BY i) AS keys FROM (SELECT p_partkey, key, min(i) AS i FROM k WHERE key <> '' GROUP BY ALL) GROUP BY p_partkey"""
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
