"""Licence scan by a positional index of rare words: the words of each licence template with the highest IDF are its
postings, a document's words are looked up in them and nominate places of templates by relative position; at a nominated
place where all of the template's mandatory phrases stand, every licence word whose position agrees votes.

A template has as many postings as any place with enough votes must hit at least once, so that no place is missed."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Phrases that always count, and their labels.
BASE_PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
#: Notices and opening words of well-known licences (label, notice, mandatory phrases).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance", "apache org licenses")),
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license version 2 0", "terms and conditions")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "distribute this software for any purpose")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ("express or implied warranty", "held liable")),
    ("boost", "any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining", "accompanying documentation covered")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "free software foundation", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "free software foundation", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license", "free software foundation")),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc", "4 0")),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa", "4 0")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "neighboring rights")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Words of templates that are never looked up and never vote.
FUNCTION_WORDS = frozenset("a and any are as at be by for has in into is it no of on or out the this to under use v will with without you".split())
#: A template counts from this share of its own words on.
LEAST_SHARE = 0.6


def _words(text: str) -> list[str]:
    return text.split()


def postings() -> list[tuple[str, int, int]]:
    """(word, template, position), for all words of templates that vote."""
    return [(w, t, i) for t, (_, notice, _) in enumerate(TEMPLATES) for i, w in enumerate(_words(notice)) if w not in FUNCTION_WORDS]


def mandatory() -> list[tuple[str, int, int]]:
    """(phrase, template, position) of the mandatory phrases, which are parts of their templates' notices."""
    return [(p, t, len(_words(notice[: f" {notice} ".index(f" {p} ")]))) for t, (_, notice, must) in enumerate(TEMPLATES) for p in must]


def rare_postings(idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """Those postings of each template that are looked up: its words with the highest IDF (words that no document has come
    first), as many as a place with LEAST_SHARE of all words can't do without."""
    out = []
    for t in range(len(TEMPLATES)):
        own = sorted((p for p in postings() if p[1] == t), key=lambda p: (-idf.get(p[0], math.inf), p))
        out += own[: len(own) - math.ceil(LEAST_SHARE * len(own)) + 1]
    return out


def _lowered(word: Column) -> Column:
    """A-Z in lower case. lower() also turns a few other letters into ASCII ones, which are fewer bytes: such words stay."""
    low = F.lower(word)
    return F.when(F.octet_length(low) == F.octet_length(word), low).otherwise(word)


def _at(i: Column, phrase: tuple[str, ...], offset: int = 0) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(_lowered(F.get("words", i + (offset + k))) == w, F.lit(False)) for k, w in enumerate(phrase)))


def scanned(documents: DataFrame) -> DataFrame:
    """A narrow row for each document: row, doc_id, n_words, base (places and labels of base phrases), found (position
    and word of its licence words) and phrases (places of mandatory phrases)."""
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), common.NON_WORD + "+"), "").alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    anchors = sorted({w for w, _, _ in postings()} | {p[0] for p in BASE_PHRASES})
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("places", F.filter(places, lambda i: _lowered(F.get("words", i)).isin(anchors)))
    label = lambda i: reduce(lambda rest, x: F.when(_at(i, x[0]), x[1]).otherwise(rest), BASE_PHRASES.items(), F.lit(None).cast("string"))
    must = sorted({p for _, _, ps in TEMPLATES for p in ps})
    none = F.array().cast("array<string>")

    def stands(x: Column) -> Column:
        """The mandatory phrases that begin at a place, told by its word first."""
        by_word = lambda w: F.filter(F.array(*(F.when(_at(x["i"], tuple(_words(p)[1:]), 1), F.lit(p)) for p in must if _words(p)[0] == w)), lambda p: p.isNotNull())
        return reduce(lambda rest, w: F.when(x["w"] == w, by_word(w)).otherwise(rest), sorted({_words(p)[0] for p in must}), none)

    rows = rows.withColumns(
        {
            "base": F.filter(F.transform("places", lambda i: F.struct(i.alias("i"), label(i).alias("label"))), lambda x: x["label"].isNotNull()),
            "found": F.transform("places", lambda i: F.struct(i.alias("i"), _lowered(F.get("words", i)).alias("w"))),
        }
    )
    rows = rows.withColumn("phrases", F.filter(F.transform("found", lambda x: F.struct(x["i"].alias("i"), stands(x).alias("ps"))), lambda x: F.size(x["ps"]) > 0))
    return rows.select("row", "doc_id", F.col("n").cast("long").alias("n_words"), "base", "found", "phrases")


def template_matches(scan: DataFrame) -> DataFrame:
    """row, label, start (where the template begins) and share (of its key words that stand in place)."""
    spark = scan.sparkSession
    index = spark.createDataFrame(postings(), "w string, template int, position int")
    # idf over all documents: each has a word once; the table has as many rows as there are licence words
    n = scan.count()
    idf = scan.select(F.explode(F.array_distinct(F.transform("found", lambda x: x["w"]))).alias("w")).groupBy("w").agg(F.ln(F.lit(float(n + 1)) / F.count(F.lit(1))).alias("idf"))
    idf = {r["w"]: r["idf"] for r in idf.collect()}  # as many rows as the templates have words, at most
    rare = rare_postings(idf)
    keys = sorted({w for w, _, _ in rare})
    hits = scan.select("row", F.explode(F.filter("found", lambda x: x["w"].isin(keys))).alias("x")).select("row", "x.i", "x.w")
    start = (F.col("i") - F.col("position")).alias("start")
    nominated = hits.join(F.broadcast(spark.createDataFrame(rare, "w string, template int, position int")), "w").select("row", "template", start)
    facts = [(t, label, sum(1 for _, t2, _ in postings() if t2 == t), len(must)) for t, (label, _, must) in enumerate(TEMPLATES)]
    known = spark.createDataFrame(facts, "template int, label string, keys int, phrases int")
    musts = spark.createDataFrame(mandatory(), "p string, template int, position int")
    stands = scan.where(F.size("phrases") > 0).select("row", F.explode("phrases").alias("x")).select("row", "x.i", F.explode("x.ps").alias("p"))
    held = stands.join(musts, "p").groupBy("row", "template", start).agg(F.count(F.lit(1)).alias("held"))
    held = held.join(known, "template").where(F.col("held") == F.col("phrases"))
    places = nominated.distinct().join(held, ["row", "template", "start"])
    # all licence words of the few rows with such a place vote, not only the rare ones
    words = scan.join(places.select("row").distinct(), "row", "left_semi").select("row", F.explode("found").alias("x")).select("row", "x.i", "x.w")
    votes = words.join(index, "w").groupBy("row", "template", start).agg(F.count(F.lit(1)).alias("votes"))
    share = F.col("votes") / F.col("keys")
    return votes.join(places, ["row", "template", "start"]).where(share >= LEAST_SHARE).select("row", "label", "start", share.alias("share"))


def licence_scan(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is the largest share of a verified template's key words that stand in place; 1 for a base phrase alone, 0 for
    none. Null and empty texts have no words and no labels ('' in both columns, score 0). Repeated rows are scanned
    alike, each in its own row; several equal matches in a text count once in labels and each in n_base. Texts are read
    whole, and a row's places never leave its row but for the rare licence words, and all licence words of texts with a
    template's mandatory phrases. A text may hold any number of notices: each is looked for by words of its own.
    An empty table gives an empty table; columns other than doc_id and text are ignored.
    """
    scan = common.stored(scanned(documents), "licences")
    best = template_matches(scan).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))  # a set of labels: as many as there are templates
    empty = F.array().cast("array<string>")
    out = scan.join(best, "row", "left").withColumn("base_set", F.array_distinct(F.transform("base", lambda x: x["label"])))
    places = F.transform("base", lambda x: x["i"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base_set", F.coalesce("more", empty))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)), 4).alias("score"),
    )


def op7_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    phrases = sorted({p for _, _, ps in TEMPLATES for p in ps})
    base = " UNION ALL ".join(f"SELECT rid, i, '{label}' AS label FROM tok WHERE w = '{p[0]}' AND " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p) if k) for p, label in BASE_PHRASES.items())
    stands = " UNION ALL ".join(f"SELECT rid, i, '{p}' AS p FROM tok WHERE " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(_words(p))) for p in phrases)
    index = ", ".join(f"('{w}', {t}, {i})" for w, t, i in postings())
    known = ", ".join(f"({t}, '{label}', {sum(1 for _, t2, _ in postings() if t2 == t)}, {len(must)})" for t, (label, _, must) in enumerate(TEMPLATES))
    musts = ", ".join(f"('{p}', {t}, {i})" for p, t, i in mandatory())
    anchors = ", ".join(f"'{w}'" for w in sorted({w for w, _, _ in postings()} | {p[0] for p in BASE_PHRASES}))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tok AS (SELECT rid, i - 1 AS i, ws[i] AS w, ws FROM (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, ws FROM d) WHERE ws[i] IN ({anchors})),
base AS ({base}),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS bl FROM base GROUP BY rid),
stands AS ({stands}),
idx AS (SELECT * FROM (VALUES {index}) t(w, template, position)),
known AS (SELECT * FROM (VALUES {known}) t(template, label, keys, n_must)),
musts AS (SELECT * FROM (VALUES {musts}) t(p, template, position)),
votes AS (SELECT rid, template, i - position AS start, count(*) AS votes FROM tok JOIN idx USING (w) GROUP BY ALL),
held AS (SELECT rid, template, i - position AS start, count(*) AS held FROM stands JOIN musts USING (p) GROUP BY ALL),
good AS (SELECT rid, votes / keys AS share, label FROM votes JOIN held USING (rid, template, start) JOIN known USING (template) WHERE votes / keys >= {LEAST_SHARE} AND held = n_must),
best AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS share FROM good GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(bl, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(more, [])))), ','), '') AS labels, round(greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 4) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN best USING (rid)
"""


QUERIES = {"op7_rare_token_index": op7_rare_token_index}
ORACLES = {"op7_rare_token_index": _sql()}
