"""Quality rules: each document's histograms of character classes and of common words are compared with its language's
by Jensen-Shannon distance; documents that are too short for a histogram are left to the base rules."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The most frequent function words of the languages that have a word histogram.
COMMON_WORDS = {
    "de": ("der", "die", "und", "das", "den", "von", "mit", "sich", "des", "ein", "ist", "nicht", "auf", "für", "eine", "dem"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "on", "with", "as", "be", "by", "this", "are"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "las", "un", "por", "con", "no", "una", "para", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
CHAR_CLASSES = ("lower", "upper", "digit", "symbol", "mark", "other", "space")
#: A histogram decides only if it counts this many: characters, and words.
MIN_CHARS, MIN_WORDS = 200, 100
#: Largest distance (0 to 1) at which a document is kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.28
BASE_MIN_WORDS, BASE_MAX_REPEATED_PERCENT = 50, 50


def _removed(text: str, pattern: str) -> Column:
    return F.regexp_replace(F.col(text), pattern, "")


def _counted(joined: Column, word: str) -> Column:
    """How often a word stands in words that are joined as ' a  b ' (two spaces between any two)."""
    framed = f" {word} "
    return (F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(framed), F.lit("")))) / F.lit(len(framed.encode()))


def features(documents: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars and common (histograms), each
    from one row alone: nothing is shuffled. Null texts are empty; a null language is ''."""
    rows = documents.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumns({"words": F.array_remove(F.split("text", common.SPACE + "+"), ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "rest1": _removed("text", "[a-z]+")})
    known = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    triple = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "rest2": _removed("rest1", common.SPACE + "+"),
            "triples": F.sort_array(F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), triple)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "joined": F.concat(F.lit(" "), F.array_join(F.filter(F.transform("words", F.lower), lambda x: x.isin(known)), "  "), F.lit(" ")),
        }
    )
    same = lambda k, x: F.get("triples", k)["h"].eqNullSafe(x["h"])
    rows = rows.withColumns({"again": F.sort_array(F.transform(F.filter("triples", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])), "rest3": _removed("rest2", "[A-Z]+")})
    rows = rows.withColumns({"rest4": _removed("rest3", "[0-9]+")})
    rows = rows.withColumns({"rest5": _removed("rest4", r"[#*$%&|<>]+")})
    rows = rows.withColumns({"rest6": _removed("rest5", r"""[.,;:!?'"()\-]+""")})
    length = lambda name: F.char_length(F.col(name)).cast("long")
    covered = F.aggregate("again", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")))["n"]
    n_lower = length("text") - length("rest1")
    chars = F.array(n_lower, length("rest2") - length("rest3"), length("rest3") - length("rest4"), length("rest4") - length("rest5"), length("rest5") - length("rest6"), length("rest6"), length("rest1") - length("rest2"))
    counts = F.array().cast("array<bigint>")
    for lang, known in COMMON_WORDS.items():
        counts = F.when(F.col("lang") == lang, F.array(*(_counted(F.col("joined"), w).cast("long") for w in known))).otherwise(counts)
    rows = rows.select(
        "doc_id", "lang", "n_words", (n_lower + length("rest2")).alias("word_chars"), (length("rest4") - length("rest5")).alias("n_symbols"), "n_dup_lines", covered.cast("long").alias("n_repeat_words"),
        chars.alias("chars"), counts.alias("counts"),
    )
    named = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("common", F.concat("counts", F.array(F.col("n_words") - named))).drop("counts")


def base_failed() -> Column:
    return (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEATED_PERCENT * F.col("n_words"))


def _total(name: str) -> Column:
    return F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)


def references(rows: DataFrame) -> DataFrame:
    """For each language the summed histograms of all its documents that pass the base rules and are long enough."""
    good = rows.where(~base_failed() & (F.col("n_words") >= MIN_WORDS))
    sizes = {"chars": len(CHAR_CLASSES), "common": max(map(len, COMMON_WORDS.values())) + 1}
    sums = [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)]
    kept = good.groupBy("lang").agg(*sums)
    return kept.select("lang", *(F.filter(F.array(*(F.col(f"{name}{i}") for i in range(n))), lambda x: x.isNotNull()).alias(f"{name}_reference") for name, n in sizes.items()))


def distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance (base 2; 0 to 1) of two histograms whose sums, over 0, are in __n and __m."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    terms = F.zip_with(own, reference, lambda a, b: part(a / F.col("__n"), b / F.col("__m")) + part(b / F.col("__m"), a / F.col("__n")))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judged(rows: DataFrame) -> DataFrame:
    """rows with char_distance, word_distance, base_failed and kept. A language without any reference judges nothing."""
    out = rows.join(references(rows), "lang", "left")
    for name in ("chars", "common"):
        out = out.withColumns({"__n": _total(name).cast("double"), "__m": _total(f"{name}_reference").cast("double")})
        usable = (F.col("__n") > 0) & (F.col("__m") > 0)
        out = out.withColumn({"chars": "char_distance", "common": "word_distance"}[name], F.when(usable, distance(name, f"{name}_reference"))).drop("__n", "__m")
    off = ((_total("chars") >= MIN_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE))
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~off})


def quality_rules(documents: DataFrame) -> DataFrame:
    """One row for each document: its counts, whether the base rules fail it and whether it is kept.

    References come from all documents. Null and empty texts have no words, fail the base rules and are not kept. Long
    texts are read whole; repeated rows are judged alike, each in its own row. Documents of a language without a list of
    common words, or of none, have one bin of words and are judged by their characters alone. An empty table gives an
    empty table; columns beyond doc_id, lang and text are ignored.
    """
    return judged(common.stored(features(documents), "quality"))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def js_distance(own: list[int], reference: list[int]) -> float:
    """The same distance in plain Python, for tests."""
    n, m = sum(own), sum(reference)
    if not n or not m:
        return 0.0
    total = 0.0
    for a, b in zip(own, reference, strict=True):
        p, q = a / n, b / m
        total += (p * math.log2(2 * p / (p + q)) if p else 0) + (q * math.log2(2 * q / (p + q)) if q else 0)
    return math.sqrt(max(total / 2, 0))


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that stand twice or more, in plain Python, for tests."""
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for k in range(3)})


_LISTS = "\n".join(f"    WHEN lang = '{lang}' THEN [{', '.join(f'''len(list_filter(lw, lambda x: x = '{w}'))''' for w in known)}]" for lang, known in COMMON_WORDS.items())
_REMOVED = lambda name, pattern: f"regexp_replace({name}, '{pattern}', '', 'g')"
_JS = lambda a, b: f"""sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i:
    CASE WHEN {a}[i] > 0 THEN {a}[i] / list_sum({a}) * log2(2 * {a}[i] / list_sum({a}) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END
  + CASE WHEN {b}[i] > 0 THEN {b}[i] / list_sum({b}) * log2(2 * {b}[i] / list_sum({b}) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END)) / 2, 0))"""  # noqa: E731
OP3_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
wins AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM wins) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM hit) GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(text) - length({_REMOVED("text", "[#*$%&|<>]")}) AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    [length(text) - length({_REMOVED("text", "[a-z]")}), length(text) - length({_REMOVED("text", "[A-Z]")}), length(text) - length({_REMOVED("text", "[0-9]")}),
     length(text) - length({_REMOVED("text", "[#*$%&|<>]")}), length(text) - length({_REMOVED("text", "[.,;:!?''" + '"' + "()-]")}),
     length({_REMOVED("text", "[a-zA-Z0-9#*$%&|<>.,;:!?''" + '"' + "()" + chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D-]")}), length(text) - length(array_to_string(ws, ''))] AS chars,
    list_transform(ws, lambda x: lower(x)) AS lw
  FROM w LEFT JOIN rep USING (rid)
), c AS (SELECT * EXCLUDE (lw), CASE
{_LISTS}
    ELSE [] END AS counts FROM f),
h AS (SELECT *, list_append(counts, n_words - coalesce(list_sum(counts), 0)) AS common, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c),
ref AS (SELECT lang, list(s ORDER BY i) AS rc FROM (SELECT lang, i, sum(chars[i]) AS s FROM h, range(1, {len(CHAR_CLASSES) + 1}) r(i) WHERE NOT base_failed AND n_words >= {MIN_WORDS} GROUP BY ALL) GROUP BY lang),
refw AS (SELECT lang, list(s ORDER BY i) AS rw FROM (SELECT lang, i, sum(common[i]) AS s FROM h, range(1, 18) r(i) WHERE i <= len(common) AND NOT base_failed AND n_words >= {MIN_WORDS} GROUP BY ALL) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (list_sum(chars) >= {MIN_CHARS} AND coalesce({_JS("chars", "rc")}, 0) > {MAX_CHAR_DISTANCE})
  AND NOT (n_words >= {MIN_WORDS} AND coalesce({_JS("common", "rw")}, 0) > {MAX_WORD_DISTANCE}) AS kept
FROM h LEFT JOIN ref USING (lang) LEFT JOIN refw USING (lang)
"""

QUERIES = {"op3_distribution_divergence": op3_distribution_divergence}
ORACLES = {"op3_distribution_divergence": OP3_SQL}
