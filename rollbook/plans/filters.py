"""Queries of predicates, screening and extraction from pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import urls as u
from ..operators import screening as s
from .common import table


def c1_preparing(spark, sf_dir):
    n = F.concat("p_name", F.when(F.col("p_size") == 1, " pre-debut").when(F.col("p_size") == 2, "デビュー準備中").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", t.preparing(n).alias("preparing"))


def c2_listed(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.when(F.col("p_size") == 1, " pre-debut").otherwise("")))
    return p.where((F.col("name") != "") & (F.col("p_brand") != "Brand#12") & ~t.preparing("name")).select("p_partkey", "name")


def c3_browse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("platforms", F.array("source", "lang"))
    return d.where((F.col("lang") == "fr") & F.array_contains("platforms", "src3") & F.contains(F.lower("text"), F.lit("les"))).select("doc_id", "source")


def c4_trend(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(t.match_key("p_name", composed=True).contains("o") & (F.col("p_type") != "PROMO") & F.col("p_name").rlike(r"\p{IsLatin}")).select("p_partkey")


def c5_screening(spark, sf_dir):
    """Pages by the first of ordered rules on title, host and text; excluded hosts come from a table."""
    pages = table(spark, sf_dir, "pages").withColumns({"host": u.host_key("url"), "title": t.clean_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))})
    excluded = pages.where("host LIKE 'ads-%'").select("host").distinct().withColumn("excluded", F.lit(True))
    rows = pages.join(excluded, "host", "left")
    rules = [
        ("predebut", F.col("title").contains("pre-debut")), ("fan_page", F.col("title").rlike("(?i)(?:clips|fan) page")), ("excluded", F.col("excluded")), ("organisation", F.col("host").endswith(".org")),
        ("no_evidence", ~F.col("html").contains("<article>")), ("activity_unconfirmed", F.length("html") < 1500), ("no_name", F.col("title") == ""), ("no_id", ~F.col("url").rlike(r"/\d+")),
    ]
    return rows.select("page_id", s.cascade(rules).alias("status"))


def c6_classifiers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").rlike(r"(?i)\b(?:clips?|highlights?|fan)\b").alias("fan"), F.col("text").rlike(r"(?i)\bI am\b|\bmy name\b").alias("self"))


def c7_evidence(spark, sf_dir):
    rules = [("uploads", F.col("html").contains("</b><br>")), ("video_count", F.col("html").rlike(r"[1-9][0-9,]* videos")), ("started", F.col("html").contains("<b>")), ("past", F.col("html").contains("&copy;"))]
    return table(spark, sf_dir, "pages").select("page_id", s.first_label(rules).alias("evidence"))


def c8_eligibility(spark, sf_dir):
    rules = [("returned", F.col("l_returnflag") == "R"), ("future", F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp")), ("no_views", F.col("l_quantity") < 3), ("free", F.col("l_discount") >= 0.09)]
    return s.reason_counts(table(spark, sf_dir, "lineitem"), "l_linestatus", rules)


def c9_host_policy(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = pages.where("url LIKE '%casino%' OR url LIKE '%cheap%'").select(F.regexp_extract(u.host_key("url"), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("host")).distinct()
    return s.by_host(pages, u.host_key("url"), hosts, allow=False).select("page_id", "url")


def c10_contract(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    checks = {"id": F.col("c_custkey").cast("string").rlike(r"^\d{1,4}$"), "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "name": F.char_length("c_name").between(3, 40) & ~F.col("c_name").rlike(r"[\x00-\x1f<>]"), "balance": F.col("c_acctbal") >= 0}
    return s.split_by_contract(c, checks).select("c_custkey", F.array_join("violations", ",").alias("violations"), "ok")


def _page_records(spark, sf_dir):
    """Pages as records: of an agency, of a platform or of neither, with evidence and URLs."""
    k = F.col("page_id")
    links = F.transform(F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), 1), lambda x: F.concat(F.lit("https://"), u.host_key("url"), x))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.element_at(F.array(*map(F.lit, ("agency-a", "x:", "twitch:", "other:"))), (k % 4 + 1).cast("int")), k.cast("string")).alias("source_id"), F.element_at(F.array(*map(F.lit, ("An Official page", "individual", "a LIST of names"))), (k % 3 + 1).cast("int")).alias("evidence"),
        F.when(k % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("primary"), F.concat(F.array("url"), links).alias("urls"), F.col("html").contains("Apache License").alias("free"),
    )


#: Hosts of the given pages that stand for official and for risky ones.
OFFICIAL, RISKY = tuple(f"{w}.example.{d}" for w in ("therhe", "theran", "thering", "ththed", "tiontion") for d in ("org", "com", "net")), ("casino-win.example.com", "free-bets.example.com", "ads-track.example.com", "cheap-pills.example.com")


def c11_official(spark, sf_dir):
    own = s.person_scoped(F.col("source_id"), F.col("evidence"), F.col("primary"), F.col("urls"), ("x", "twitch"), OFFICIAL, RISKY)
    return _page_records(spark, sf_dir).select("page_id", own.alias("official"))


def c12_risky(spark, sf_dir):
    risky = s.risky_record(F.col("free"), F.col("source_id"), F.col("evidence"), F.col("urls"), ("twitch:1", "other:2"), ("a list",), RISKY)
    return _page_records(spark, sf_dir).select("page_id", risky.alias("risky"))


def c13_sanitised(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url"), F.concat(F.lit("https://ads-track.example.com/"), "page_id").alias("name_source"))
    out = s.sanitised(p, ["source_url", "name_source"], u.host_key("__value").rlike("^(?:ads-track|free-bets)"))
    return out.withColumn("licence", F.when(F.col("source_url").isNotNull(), "CC0"))


def c14_minimised(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")


def e1_titles(spark, sf_dir):
    meta = lambda key: t.clean_text(F.regexp_extract("html", rf'(?i)<meta\b[^>]*(?:property|name)=["\']{key}["\'][^>]*content=["\']([^"\']*)["\']', 1))
    title = t.clean_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(meta("og:title"), F.lit("")), F.nullif(meta("twitter:title"), F.lit("")), title).alias("title"))


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref=["\']([^"\']+)'), 1)).alias("place", "link"))


def e2_links(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("link").alias("n_distinct"), F.min_by("link", "place").alias("first_link"))


def e3_profile_links(spark, sf_dir):
    """Profiles and further pages that pages link to on their own hosts; each page also links to itself by pages, and to others."""
    own = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?page=2")), F.lit("https://elsewhere.example/The"), F.lit("//elsewhere.example/The"))).alias("link"))
    found = s.discovered(_links(spark, sf_dir).select("page_id", "url", "link").union(own), "url", "link", r"^/[A-Za-z]+\.?$", r"[?&]page=\d+")
    return found.where("kind IS NOT NULL").select("target", "kind").distinct()


def e4_visible_text(spark, sf_dir):
    shown = F.regexp_replace("html", r"(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>", " ")
    text = t.clean_text(shown)
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.cast("binary"), 256).alias("text"), (F.char_length(text) >= 30).alias("available"))


def e5_embedded(spark, sf_dir):
    """The variables that a page's script sets, as far as they are quoted."""
    block = F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1)
    value = F.regexp_extract(block, r'var t="([^"]*)"', 1)
    return table(spark, sf_dir, "pages").select("page_id", value.alias("value"), F.get_json_object(F.concat(F.lit('{"n": ['), F.regexp_extract(block, r"track\((\d+)\)", 1), F.lit("]}")), "$.n[0]").cast("bigint").alias("n"))


def e6_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)">'), 1).alias("hrefs"), F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a>'), 1).alias("names"))
    return rows.select("page_id", F.posexplode(F.arrays_zip("hrefs", "names")).alias("place", "x")).select("page_id", "place", "x.hrefs", "x.names")


def e7_first_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.first_of("html", [r"itemprop=\"id\" content=\"(\d+)\"", r"track\((\d+)\)", r"<!-- ad (\d+) -->"]).alias("id"))


def e8_unambiguous(spark, sf_dir):
    """The language that a page states, if all its statements agree."""
    said = F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit(r'lang="(\w+)"'), 1), F.regexp_extract_all("url", F.lit(r"/(en|fr|de|es)/"), 1)))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.size(said) == 1, said[0]).alias("lang"))


def e9_scoped_links(spark, sf_dir):
    """The words in capitals of each entry (a line that ends in a full stop) of a document's section, from its first line with a
    comma to the next with a digit."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return s.scoped_links(lines, "doc_id", "place", "line", ",", "[0-9]", r"\.$", r"\b([A-Z][a-z]+)")


def e10_profiles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("name"), u.url_key("url").alias("account"), F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("badge"))
    return rows.where("name <> ''").groupBy("badge").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("account").alias("n_accounts"), F.max(F.char_length("name")).alias("longest"))


def e11_owner_check(spark, sf_dir):
    """Line items that their order's customer owns: shipped, of an order that is done, after the order's date."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' AND l_quantity > 0")
    return li.join(o, "l_orderkey").where("l_shipdate > o_orderdate").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_verified"))


_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_TITLE = _CLEAN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_P = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)"
_H = f"regexp_replace(lower(regexp_extract(url, '{_P}', 3)), '^(?:www|m)[.]', '')"
_LINKS = r"""(SELECT page_id, url, unnest(range(0, len(l))) AS place, unnest(l) AS link FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a [^>]*href=["'']([^"'']+)', 1) AS l FROM pages))"""
ORACLES = {
    "c1_preparing": "SELECT p_partkey, p_size IN (1, 2) AS preparing FROM part",
    "c2_listed": "SELECT p_partkey, p_name AS name FROM part WHERE p_brand <> 'Brand#12' AND p_size <> 1",
    "c3_browse": "SELECT doc_id, source FROM documents WHERE lang = 'fr' AND source = 'src3' AND contains(lower(text), 'les')",
    "c4_trend": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'o') AND p_type <> 'PROMO'",
    "c5_screening": rf"SELECT page_id, CASE WHEN contains(ti, 'pre-debut') THEN 'predebut' WHEN regexp_matches(ti, '(?i)(?:clips|fan) page') THEN 'fan_page' WHEN h LIKE 'ads-%' THEN 'excluded' WHEN ends_with(h, '.org') THEN 'organisation' WHEN NOT contains(html, '<article>') THEN 'no_evidence' WHEN length(html) < 1500 THEN 'activity_unconfirmed' WHEN ti = '' THEN 'no_name' WHEN NOT regexp_matches(url, '/\d+') THEN 'no_id' ELSE 'verified' END AS status FROM (SELECT *, {_TITLE} AS ti, {_H} AS h FROM pages)",
    "c6_classifiers": r"SELECT conv_id, turn, regexp_matches(text, '(?i)\b(?:clips?|highlights?|fan)\b') AS fan, regexp_matches(text, '(?i)\bI am\b|\bmy name\b') AS self FROM conversations",
    "c7_evidence": "SELECT page_id, CASE WHEN contains(html, '</b><br>') THEN 'uploads' WHEN regexp_matches(html, '[1-9][0-9,]* videos') THEN 'video_count' WHEN contains(html, '<b>') THEN 'started' WHEN contains(html, '&copy;') THEN 'past' END AS evidence FROM pages",
    "c8_eligibility": "SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_shipdate > TIMESTAMP '1998-06-01' THEN 'future' WHEN l_quantity < 3 THEN 'no_views' WHEN l_discount >= 0.09::DOUBLE THEN 'free' ELSE 'accepted' END AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "c9_host_policy": f"SELECT page_id, url FROM pages WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract({_H}, '([^.]+[.][^.]+[.][^.]+)$', 1) AS d FROM pages WHERE url LIKE '%casino%' OR url LIKE '%cheap%') WHERE {_H} = d OR ends_with({_H}, '.' || d))",
    "c10_contract": "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey > 9999 THEN 'id' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'segment' END, CASE WHEN length(c_name) NOT BETWEEN 3 AND 40 THEN 'name' END, CASE WHEN c_acctbal < 0 THEN 'balance' END) AS violations, c_custkey <= 9999 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND length(c_name) BETWEEN 3 AND 40 AND c_acctbal >= 0 AS ok FROM customer",
    "c11_official": f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id % 3 = 1 OR page_id % 5 = 0 WHEN 3 THEN false ELSE {_H} IN {OFFICIAL} AND {_H} NOT IN {RISKY} END AS official FROM pages",
    "c12_risky": f"SELECT page_id, NOT contains(html, 'Apache License') AND ((page_id % 4 = 2 AND left(page_id::VARCHAR, 1) = '1') OR (page_id % 4 = 3 AND left(page_id::VARCHAR, 1) = '2') OR page_id % 3 = 2 OR {_H} IN {RISKY}) AS risky FROM pages",
    "c13_sanitised": f"SELECT page_id, CASE WHEN NOT regexp_matches({_H}, '^(?:ads-track|free-bets)') THEN url END AS source_url, NULL::VARCHAR AS name_source, CASE WHEN NOT regexp_matches({_H}, '^(?:ads-track|free-bets)') THEN 'CC0' END AS licence FROM pages",
    "c14_minimised": "SELECT c_custkey, c_nationkey FROM customer",
    "e1_titles": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "e2_links": f"SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct, arg_min(link, place) AS first_link FROM {_LINKS} GROUP BY 1",
    "e3_profile_links": rf"""SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]*)', 1) || link AS target, 'profile' AS kind FROM {_LINKS} WHERE regexp_matches(link, '^/[A-Za-z]+\.?$') UNION SELECT regexp_replace(url, '[?#].*$', '') || '?page=2', CASE WHEN regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/[A-Za-z]+\.?$') THEN 'profile' ELSE 'page' END FROM pages
UNION SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) || link, 'page' FROM {_LINKS} WHERE NOT regexp_matches(link, '^/[A-Za-z]+\.?$') AND starts_with(link, '/') AND NOT starts_with(link, '//') AND NOT regexp_matches(regexp_extract(link, '^([^?#]*)', 1), '^/[A-Za-z]+\.?$') AND regexp_matches(link, '[?&]page=[0-9]+')""",
    "e4_visible_text": f"SELECT page_id, sha256(v) AS text, length(v) >= 30 AS available FROM (SELECT page_id, {_CLEAN.format(chr(39).join(['regexp_replace(html, ', '(?is)<(?:script|style|noscript)[ >].*?</(?:script|style|noscript)>', ', ', ' ', ', ', 'g', ')']))} AS v FROM pages)",
    "e5_embedded": r"""SELECT page_id, regexp_extract(html, 'var t="([^"]*)"', 1) AS value, regexp_extract(html, 'track\((\d+)\)', 1)::BIGINT AS n FROM pages""",
    "e6_rows": """SELECT page_id, unnest(range(0, len(h)))::INT AS place, unnest(h) AS hrefs, unnest(n) AS names FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS n FROM pages)""",
    "e7_first_id": r"SELECT page_id, coalesce(nullif(regexp_extract(html, 'track\((\d+)\)', 1), ''), nullif(regexp_extract(html, '<!-- ad (\d+) -->', 1), '')) AS id FROM pages",
    "e8_unambiguous": r"""SELECT page_id, CASE WHEN len(l) = 1 THEN l[1] END AS lang FROM (SELECT page_id, list_distinct(regexp_extract_all(html, 'lang="(\w+)"', 1) || regexp_extract_all(url, '/(en|fr|de|es)/', 1)) AS l FROM pages)""",
    "e9_scoped_links": r"""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS place, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
f AS (SELECT *, min(place) FILTER (contains(line, ',')) OVER (PARTITION BY doc_id) AS a FROM l), g AS (SELECT *, min(place) FILTER (regexp_matches(line, '[0-9]') AND place > a) OVER (PARTITION BY doc_id) AS b FROM f),
e AS (SELECT *, max(CASE WHEN ends_with(line, '.') THEN place END) OVER (PARTITION BY doc_id ORDER BY place) AS entry FROM g WHERE place >= a AND place < b)
SELECT doc_id, entry::INT AS entry, sum(CASE WHEN entry <> place THEN len(regexp_extract_all(line, '\b([A-Z][a-z]+)', 1)) ELSE 0 END)::BIGINT AS links FROM e WHERE entry IS NOT NULL GROUP BY 1, 2""",
    "e10_profiles": f"SELECT badge, count(*) AS n, count(DISTINCT a) AS n_accounts, max(length(name))::INT AS longest FROM (SELECT regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS name, {_H} || rtrim(regexp_extract(url, '{_P}', 5), '/') AS a, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS badge FROM pages) WHERE name <> '' GROUP BY 1",
    "e11_owner_check": "SELECT o_custkey, count(*) AS n_verified FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linestatus = 'F' AND l_quantity > 0 AND l_shipdate > o_orderdate GROUP BY 1",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
