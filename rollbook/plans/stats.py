"""Queries of name statistics and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import statistics as s
from .common import table


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("name", s.squeezed("p_name"))


def f1_lengths(spark, sf_dir):
    size = F.char_length("name")
    return _part(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_brand") != "Brand#11").alias("readable"), F.sum(size).alias("total_length"), F.round(F.sum(size) / F.count(F.lit(1)), 1).alias("average_length"), F.median(size).alias("median_length"))


def f2_length_buckets(spark, sf_dir):
    labels = spark.createDataFrame([(b[0],) for b in s.BUCKETS], "bucket string")
    counted = _part(spark, sf_dir).groupBy(s.bucket(F.char_length("name")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def f3_common_lengths(spark, sf_dir):
    return _part(spark, sf_dir).groupBy(F.char_length("name").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(5)


def f4_scripts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(s.script(F.col("text")).alias("script"))
    return d.groupBy("script").agg(F.count(F.lit(1)).alias("n"))


def f5_characters(spark, sf_dir):
    return s.presence(_part(spark, sf_dir), F.array_distinct(F.filter(F.split("name", ""), lambda c: c.rlike(r"\p{L}"))), 10)


def f6_pairs(spark, sf_dir):
    return s.presence(_part(spark, sf_dir), s.ngrams(F.col("name"), 2, r"\p{L}"), 10)


def f7_ngrams(spark, sf_dir):
    rows = _part(spark, sf_dir)
    out = [s.presence(rows, s.ngrams(F.col("name"), w, r"[\p{L}\p{N}]"), 20).withColumn("width", F.lit(w)) for w in (2, 3)]
    return out[0].union(out[1])


def f7_document_trigrams(spark, sf_dir):
    return s.presence(table(spark, sf_dir, "documents"), s.ngrams(F.regexp_replace("text", r"\s", ""), 3, r"[\p{L}\p{N}]"))


def f8_kana(spark, sf_dir):
    return s.presence(_part(spark, sf_dir), F.array_distinct(F.filter(F.split("name", ""), lambda c: c.rlike("[ぁ-ゖァ-ヶ]"))), 20)


def f9_affixes(spark, sf_dir):
    rows = _part(spark, sf_dir).where(F.char_length("name") >= 2)
    ends = {"prefix": F.substring("name", 1, 2), "suffix": F.substring(F.col("name"), -2, 2)}
    out = [s.presence(rows, F.filter(F.array(e), lambda x: x.rlike(r"^[\p{L}\p{N}]{2}$")), 10).where("n > 1").withColumn("kind", F.lit(k)) for k, e in ends.items()]
    return out[0].union(out[1])


def f10_duplicate_names(spark, sf_dir):
    """Names in several records with the label seen first."""
    rows = _part(spark, sf_dir)
    return rows.groupBy(F.lower("name").alias("identity")).agg(F.count(F.lit(1)).alias("n"), F.min_by("p_name", "p_partkey").alias("label")).where("n > 1")


def f10_duplicate_totals(spark, sf_dir):
    g = _part(spark, sf_dir).groupBy(F.lower("name").alias("identity")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("unique_names"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_records"))


def f11_reading_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_acctbal") > 5000, "verified").when(F.col("c_acctbal") > 0, "inferred").otherwise("none")
    return c.groupBy(status.alias("status"), s.bucket(F.char_length(s.squeezed("c_mktsegment"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def f12_group_comparison(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("groups", F.array("p_brand", F.substring("p_brand", 1, 7), "p_brand"))
    return s.compared(rows, "groups", "p_name")


def f13_shares(spark, sf_dir):
    n = F.count(F.lit(1))
    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(n.alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2))


def f14_slices(spark, sf_dir):
    """The same statistics for all, each segment, each nation and both."""
    c = table(spark, sf_dir, "customer")
    return c.groupingSets([[], ["c_mktsegment"], ["c_nationkey"], ["c_mktsegment", "c_nationkey"]], "c_mktsegment", "c_nationkey").agg(F.grouping_id().cast("int").alias("slice"), F.count(F.lit(1)).alias("n"), F.sum(F.char_length("c_name")).alias("total_length"))


def _slices(brand, kind):
    """A row's slices: all, its platform, its tag, and both."""
    return F.array(F.lit("all/all"), F.concat(brand, F.lit("/all")), F.concat(F.lit("all/"), kind), F.concat_ws("/", brand, kind))


def f14_all_slices(spark, sf_dir):
    """All name statistics of parts for every brand (as a platform), type (as a tag), both and all, in one pass."""
    p = _part(spark, sf_dir)
    status = F.when(F.col("p_size") > 25, "verified").when(F.col("p_size") > 10, "inferred").otherwise("none")
    labels = s.statistic_labels(F.col("name"), F.col("p_size") != 11, status, F.col("p_type"))
    return s.sliced(p, _slices(F.col("p_brand"), F.col("p_type")), labels, "p_partkey", "p_name", like=("name", "p_size", "p_type", "p_brand"))


#: Digits and the kana that stand for them in made-up names.
DIGITS, KANA = "0123456789", "ゼいニさヨごロなハく"
MARKERS = (("lists", "and", 0), ("archive", "utm_source", 1), ("registry", "example.org", 2), ("secure", "https://", 3))


def _families(spark, sf_dir):
    return s.families(table(spark, sf_dir, "pages"), "url", spark.createDataFrame(MARKERS, "family string, marker string, rank int"))


def f15_provenance_audit(spark, sf_dir):
    """Families of pages in three files (by page_id): ids, ids that end in a slash (anchored), and the three least ids of each
    family and file; pages of no family are one of their own."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 3).alias("file"))
    found = _families(spark, sf_dir).select("page_id", "family").distinct()
    rows = pages.join(found, "page_id", "left").withColumn("family", F.coalesce("family", F.lit("(none)")))
    counts = rows.groupBy("family", "file").agg(F.countDistinct("page_id").alias("n_ids"), F.countDistinct(F.when(F.col("url").endswith("/"), F.col("page_id"))).alias("n_anchored"))
    place = F.row_number().over(Window.partitionBy("family", "file").orderBy("page_id"))  # each task passes on three rows a group
    least = rows.select("family", "file", "page_id").withColumn("place", place).where("place <= 3").groupBy("family", "file").agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("samples"))
    return counts.join(least, ["family", "file"])


def f15_audit(spark, sf_dir):
    """Ids of pages, documents, parts and customers, most of them with one of some forty prefixes: the most common prefixes,
    families of markers with samples, ids without sources, and those of families that orders vouch for."""
    pages = table(spark, sf_dir, "pages").select(F.concat_ws(":", F.regexp_extract("url", r"([a-z]+)$|/(\d)", 2), "page_id").alias("id"), F.col("page_id").alias("ord"), F.col("url").alias("source"), (F.col("page_id") % 2 == 0).alias("anchored"))
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "doc_id").alias("id"), F.col("doc_id") + 10**6, F.col("lang"), F.lit(False))
    parts = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(":"), "p_partkey").alias("id"), F.col("p_partkey") + 2 * 10**7, F.when(F.col("p_size") > 25, F.lit("https://parts.example.org/and")), F.col("p_size") > 40)
    customers = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.md5(F.col("c_custkey").cast("string").cast("binary"))).otherwise(F.col("c_name")).alias("id"), F.col("c_custkey") + 3 * 10**8, F.lit(None).cast("string"), F.lit(True))
    ids = pages.union(docs).union(parts).union(customers)
    found = s.families(ids, "source", spark.createDataFrame(MARKERS, "family string, marker string, rank int"))
    return s.audited(ids.withColumn("sourced", F.col("source").isNotNull()), found)


def f8_kana_names(spark, sf_dir):
    """Kana of parts by record presence: names are their numbers, said in kana."""
    p = table(spark, sf_dir, "part").select(F.translate(F.concat("p_partkey", F.lit("x"), "p_size"), DIGITS, KANA).alias("name"))
    return s.presence(p, F.array_distinct(F.filter(F.split("name", ""), lambda c: c.rlike("[ぁ-ゖァ-ヶ]"))), 20)


def f16_first_family(spark, sf_dir):
    first = _families(spark, sf_dir).groupBy("page_id").agg(F.min_by("family", "rank").alias("family"))
    return first.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def f17_recount(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("o_orderstatus") != "P").alias("listed"), F.count_if(F.col("o_orderstatus") == "P").alias("excluded"), F.count_if(F.col("o_totalprice") > 200000).alias("with_activity"))


def f18_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def f19_cumulative(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return daily.select("day", F.sum("n").over(w).alias("total"), F.sum("signups").over(w).alias("total_signups"))


def f20_source_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "rejected").otherwise("accepted")
    return d.groupBy("source", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("n_langs"))


def f21_facets(spark, sf_dir):
    known = spark.createDataFrame([("click", 0), ("view", 1), ("signup", 2), ("refund", 3), ("error", 4)], "event_type string, place int")
    return known.join(table(spark, sf_dir, "events").select("event_type").distinct(), "event_type", "left_semi")


def g1_top_per_group(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("word", F.split("p_name", " ")[0])
    return s.top_per(p, "p_brand", "word", 3)


_N = r"regexp_replace(p_name, '\s', '', 'g')"
_B = lambda x: f"CASE WHEN {x} <= 4 THEN '1-4' WHEN {x} <= 8 THEN '5-8' WHEN {x} <= 12 THEN '9-12' ELSE '13+' END"
_GRAMS = lambda w, name, src: f"(SELECT DISTINCT id, substr(n, i::INT, {w}) AS label FROM (SELECT id, n, unnest(range(1, length(n) - {w} + 2)) AS i FROM (SELECT {name[0]} AS id, {name[1]} AS n FROM {src})))"
_PG = lambda w: _GRAMS(w, ("p_partkey", _N), "part")
_FAM = "(SELECT page_id, url, family, rank FROM pages, (VALUES " + ", ".join(f"('{f}', '{m}', {r})" for f, m, r in MARKERS) + ") m(family, marker, rank) WHERE contains(url, marker))"
ORACLES = {
    "f1_lengths": f"SELECT count(*) AS total, count(*) FILTER (p_brand <> 'Brand#11') AS readable, sum(length({_N}))::BIGINT AS total_length, round(sum(length({_N})) / count(*), 1) AS average_length, median(length({_N})) AS median_length FROM part",
    "f2_length_buckets": f"SELECT b AS bucket, count(k) AS n FROM (VALUES ('1-4'), ('5-8'), ('9-12'), ('13+')) v(b) LEFT JOIN (SELECT p_partkey AS k, {_B(f'length({_N})')} AS bb FROM part) ON b = bb GROUP BY 1",
    "f3_common_lengths": f"SELECT length({_N})::INT AS length, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, length LIMIT 5",
    "f4_scripts": r"SELECT CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script, count(*) AS n FROM documents GROUP BY 1",
    "f5_characters": rf"SELECT label, count(*) AS n FROM {_PG(1)} WHERE regexp_matches(label, '\p{{L}}') GROUP BY 1 ORDER BY n DESC, label LIMIT 10",
    "f6_pairs": rf"SELECT label, count(*) AS n FROM {_PG(2)} WHERE regexp_matches(label, '^\p{{L}}{{2}}$') GROUP BY 1 ORDER BY n DESC, label LIMIT 10",
    "f7_ngrams": " UNION ALL ".join(rf"(SELECT label, count(*) AS n, {w} AS width FROM {_PG(w)} WHERE regexp_matches(label, '^[\p{{L}}\p{{N}}]+$') GROUP BY 1 ORDER BY n DESC, label LIMIT 20)" for w in (2, 3)),
    "f7_document_trigrams": rf"SELECT label, count(*) AS n FROM {_GRAMS(3, ('doc_id', 'regexp_replace(text, chr(92) || chr(115), chr(39) || chr(39), chr(103))'.replace('chr(39) || chr(39)', repr(''))), 'documents')} WHERE regexp_matches(label, '^[\p{{L}}\p{{N}}]+$') GROUP BY 1",
    "f8_kana": "SELECT '' AS label, 0::BIGINT AS n WHERE false",
    "f9_affixes": " UNION ALL ".join(rf"SELECT * FROM (SELECT {e} AS label, count(*) AS n, '{k}' AS kind FROM part WHERE length({_N}) >= 2 AND regexp_matches({e}, '^[\p{{L}}\p{{N}}]{{2}}$') GROUP BY 1 ORDER BY n DESC, label LIMIT 10) WHERE n > 1" for k, e in (("prefix", f"{_N}[1:2]"), ("suffix", f"{_N}[-2:]"))),
    "f10_duplicate_names": f"SELECT lower({_N}) AS identity, count(*) AS n, arg_min(p_name, p_partkey) AS label FROM part GROUP BY 1 HAVING count(*) > 1",
    "f10_duplicate_totals": f"SELECT count(*) AS unique_names, count(*) FILTER (n > 1) AS duplicate_groups, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS duplicate_records FROM (SELECT count(*) AS n FROM part GROUP BY lower({_N}))",
    "f11_reading_status": f"SELECT CASE WHEN c_acctbal > 5000 THEN 'verified' WHEN c_acctbal > 0 THEN 'inferred' ELSE 'none' END AS status, {_B('length(c_mktsegment)')} AS bucket, count(*) AS n FROM customer GROUP BY 1, 2",
    "f12_group_comparison": f"SELECT label, count(*) AS n, sum(z)::BIGINT AS total_length, round(sum(z) / count(*), 1) AS average_length, 0.0::DOUBLE AS kana_percent FROM (SELECT unnest(list_distinct([p_brand, p_brand[1:7]])) AS label, length({_N}) AS z FROM part) GROUP BY 1",
    "f13_shares": "SELECT c_mktsegment, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM customer GROUP BY 1",
    "f14_slices": "SELECT c_mktsegment, c_nationkey, grouping_id(c_mktsegment, c_nationkey)::INT AS slice, count(*) AS n, sum(length(c_name))::BIGINT AS total_length FROM customer GROUP BY GROUPING SETS ((), (c_mktsegment), (c_nationkey), (c_mktsegment, c_nationkey))",
    "f15_audit": """WITH i AS (SELECT regexp_extract(url, '([a-z]+)$|/(\\d)', 2) || ':' || page_id AS id, page_id AS ord, url AS source, page_id % 2 = 0 AS anchored FROM pages UNION ALL SELECT concat_ws(':', source, doc_id), doc_id + 1000000, lang, false FROM documents
  UNION ALL SELECT p_brand || ':' || p_partkey, p_partkey + 20000000, CASE WHEN p_size > 25 THEN 'https://parts.example.org/and' END, p_size > 40 FROM part UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN md5(c_custkey::VARCHAR) ELSE c_name END, c_custkey + 300000000, NULL, true FROM customer),
f AS (SELECT i.*, family FROM i JOIN (VALUES ('lists', 'and'), ('archive', 'utm_source'), ('registry', 'example.org'), ('secure', 'https://')) m(family, marker) ON contains(source, marker)),
p AS (SELECT CASE WHEN contains(id, ':') THEN split_part(id, ':', 1) WHEN regexp_matches(id, '(?i)^[0-9a-f-]{32,36}$') THEN 'uuid-like' ELSE 'other' END AS label, count(*) AS n, min(ord) AS first FROM i GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 30),
t AS (SELECT count(*) AS a, count(*) FILTER (source IS NULL) AS w, count(*) FILTER (ord IN (SELECT ord FROM f)) AS l, count(*) FILTER (anchored AND ord IN (SELECT ord FROM f)) AS la FROM i)
SELECT 'prefix' AS part, label, n, NULL AS samples FROM p UNION ALL SELECT 'family', family, count(*), array_to_string(list(id ORDER BY ord)[:3], ',') FROM f GROUP BY family
UNION ALL SELECT 'ids', unnest(['all', 'without source', 'legacy', 'legacy, anchored']), unnest([a, w, l, la]), NULL FROM t""",
    "f8_kana_names": f"SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(translate(p_partkey || 'x' || p_size, '{DIGITS}', '{KANA}'), ''), lambda c: c <> 'x'))) AS label FROM part) GROUP BY 1",
    "f15_provenance_audit": f"SELECT coalesce(f.family, '(none)') AS family, p.page_id % 3 AS file, count(DISTINCT p.page_id) AS n_ids, count(DISTINCT CASE WHEN ends_with(p.url, '/') THEN p.page_id END) AS n_anchored, array_to_string(list_sort(list(p.page_id))[:3], ',') AS samples FROM pages p LEFT JOIN (SELECT DISTINCT page_id, family FROM {_FAM}) f USING (page_id) GROUP BY 1, 2",
    "f16_first_family": f"SELECT family, count(*) AS n FROM (SELECT page_id, arg_min(family, rank) AS family FROM {_FAM} GROUP BY 1) GROUP BY 1",
    "f17_recount": "SELECT o_orderpriority, count(*) AS stored, count(*) FILTER (o_orderstatus <> 'P') AS listed, count(*) FILTER (o_orderstatus = 'P') AS excluded, count(*) FILTER (o_totalprice > 200000) AS with_activity FROM orders GROUP BY 1",
    "f18_status_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "f19_cumulative": "SELECT day, sum(n) OVER (ORDER BY day)::BIGINT AS total, sum(s) OVER (ORDER BY day)::BIGINT AS total_signups FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1)",
    "f14_all_slices": r"""WITH p AS (SELECT *, regexp_replace(p_name, '\s', '', 'g') AS name FROM part),
s AS (SELECT p.*, unnest(['all/all', p_brand || '/all', 'all/' || p_type, p_brand || '/' || p_type]) AS slice, length(name) AS size, CASE WHEN p_size > 25 THEN 'verified' WHEN p_size > 10 THEN 'inferred' ELSE 'none' END AS status FROM p),
b AS (SELECT *, CASE WHEN size <= 4 THEN '1-4' WHEN size <= 8 THEN '5-8' WHEN size <= 12 THEN '9-12' ELSE '13+' END AS bucket, CASE WHEN length(p_type) <= 4 THEN '1-4' WHEN length(p_type) <= 8 THEN '5-8' WHEN length(p_type) <= 12 THEN '9-12' ELSE '13+' END AS rb FROM s),
x AS (SELECT slice, p_partkey, p_name, size, 'total' AS statistic, '' AS label FROM b UNION ALL SELECT slice, p_partkey, p_name, size, 'readable', '' FROM b WHERE p_size <> 11 UNION ALL SELECT slice, p_partkey, p_name, size, 'length', size::VARCHAR FROM b
  UNION ALL SELECT slice, p_partkey, p_name, size, 'bucket', bucket FROM b UNION ALL SELECT slice, p_partkey, p_name, size, 'script', 'latin' FROM b UNION ALL SELECT slice, p_partkey, p_name, size, 'character', unnest(list_distinct(string_split(name, ''))) FROM b
  UNION ALL SELECT slice, p_partkey, p_name, size, k, unnest(list_distinct(list_transform(range(1, size - w + 2), lambda i: name[i:i + w - 1]))) FROM b, (VALUES ('pair', 2), ('gram2', 2), ('gram3', 3)) t(k, w)
  UNION ALL SELECT slice, p_partkey, p_name, size, 'prefix', name[1:2] FROM b UNION ALL SELECT slice, p_partkey, p_name, size, 'suffix', name[-2:] FROM b UNION ALL SELECT slice, p_partkey, p_name, size, 'duplicate', lower(name) FROM b UNION ALL SELECT slice, p_partkey, p_name, size, 'reading', status || ' ' || rb FROM b),
c AS (SELECT slice, statistic, label, count(*) AS n, arg_min(p_name, p_partkey) AS shown FROM x GROUP BY 1, 2, 3),
t AS (SELECT c.*, most, row_number() OVER (PARTITION BY slice, statistic ORDER BY n DESC, CASE WHEN statistic = 'length' THEN label::INT END, label)::INT AS rank FROM c JOIN (VALUES ('length', 5), ('character', 10), ('pair', 10), ('gram2', 20), ('gram3', 20), ('prefix', 10), ('suffix', 10), ('duplicate', 20)) m(statistic, most) USING (statistic))
SELECT slice, statistic, label, n, NULL::DOUBLE AS value, CASE WHEN statistic = 'duplicate' THEN shown END AS shown, rank FROM t WHERE rank <= most AND (n > 1 OR statistic NOT IN ('prefix', 'suffix', 'duplicate'))
UNION ALL SELECT slice, statistic, label, n, NULL, NULL, NULL FROM c WHERE statistic IN ('total', 'readable', 'bucket', 'script', 'reading')
UNION ALL SELECT slice, 'size', '', sum(size)::BIGINT, median(size), NULL, NULL FROM b GROUP BY 1
UNION ALL SELECT slice, 'duplicates', unnest(['names', 'groups', 'records']), unnest([count(*), count(*) FILTER (n > 1), coalesce(sum(n) FILTER (n > 1), 0)::BIGINT]), NULL, NULL, NULL FROM c WHERE statistic = 'duplicate' GROUP BY slice""",
    "f20_source_counters": "SELECT source, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'rejected' ELSE 'accepted' END AS status, count(*) AS n, count(DISTINCT lang) AS n_langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "f21_facets": "SELECT event_type, place FROM (VALUES ('click', 0), ('view', 1), ('signup', 2), ('refund', 3), ('error', 4)) v(event_type, place) WHERE event_type IN (SELECT event_type FROM events)",
    "g1_top_per_group": "SELECT p_brand, word, n, rank FROM (SELECT p_brand, word, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, word)::INT AS rank FROM (SELECT p_brand, string_split(p_name, ' ')[1] AS word, count(*) AS n FROM part GROUP BY 1, 2)) WHERE rank <= 3",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
