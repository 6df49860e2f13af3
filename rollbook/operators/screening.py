"""Ordered screening, eligibility with reasons, contracts and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.urls import fragment_accounts, host_key


def cascade(rules: list[tuple[str, Column]], otherwise: str = "verified") -> Column:
    """The name of the first rule that holds. A null condition doesn't hold."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def first_label(rules: list[tuple[str, Column]]) -> Column:
    """The label of the first rule that holds, else null."""
    return F.coalesce(*(F.when(condition, name) for name, condition in rules))


def reason_counts(rows: DataFrame, source: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """How many rows of each source are accepted, and rejected for which first reason."""
    return rows.groupBy(source, cascade(rules, "accepted").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def split_by_contract(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with violations (names of the checks that fail or can't be decided) and ok."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
    return rows.withColumns({"violations": failed, "ok": F.size(failed) == 0})


def by_host(rows: DataFrame, host: Column, hosts: DataFrame, allow: bool) -> DataFrame:
    """rows whose host, or a domain above it, is in hosts (allow) or is not (deny). hosts: host, without repetition."""
    known = rows.select(host.alias("__host")).distinct()  # hosts are far fewer than rows
    hit = known.select("__host", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("__host", r"\."))), lambda i: F.array_join(F.slice(F.split("__host", r"\."), i, F.size(F.split("__host", r"\."))), "."))).alias("host"))
    hit = hit.join(hosts, "host", "left_semi").select("__host").distinct()
    return rows.withColumn("__host", host).join(hit, "__host", "left_semi" if allow else "left_anti").drop("__host")


def sanitised(rows: DataFrame, fields: list[str], denied: Column, clear: str | None = None) -> DataFrame:
    """rows with the given fields set to null where `denied` holds (a condition on the column named __value)."""
    out = rows
    for f in fields:
        out = out.withColumn("__value", F.col(f)).withColumn(f, F.when(~F.coalesce(denied, F.lit(False)), F.col(f)).otherwise(F.lit(clear))).drop("__value")
    return out


def sanitised_lists(rows: DataFrame, fields: list[str], hosts: tuple[str, ...], markers: tuple[str, ...]) -> DataFrame:
    """rows with only those sources left in the given lists that aren't on one of the hosts, or have a marker of a free
    source; a list of which nothing is left is null."""
    free = lambda x: reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(m)) for m in markers), F.lit(False))
    left = lambda f: F.filter(f, lambda x: x.isNotNull() & (free(x) | ~host_key(x).isin(*hosts)))
    return rows.withColumns({f: F.when(F.size(left(f)) > 0, left(f)) for f in fields})


#: Fixed value(s): scripts that names can be asked for.
SCRIPTS = {"kana": r"[\p{IsHiragana}\p{IsKatakana}]", "han": r"\p{IsHan}", "latin": "[A-Za-z]"}


def selected(rows: DataFrame, platform: str = "all", tag: str = "all", word: str = "", reading: str = "all", script: str = "all") -> DataFrame:
    """rows on a platform, of a tag, with a word (a key) in their name key, whose reading is verified, estimated or missing
    and whose name has a script. rows: platforms (a list), tag, name, name_key, reading, inferred."""
    missing = F.coalesce(F.col("reading"), F.lit("")) == ""
    inferred = F.coalesce("inferred", F.lit(False))
    states = {"verified": ~missing & ~inferred, "estimated": inferred, "missing": missing}
    wanted = [F.array_contains("platforms", platform)] if platform != "all" else []
    wanted += [F.col("tag") == tag] if tag != "all" else []
    wanted += [F.contains("name_key", F.lit(word))] if word else []
    wanted += [states[reading]] if reading != "all" else []
    wanted += [F.col("name").rlike(SCRIPTS[script])] if script in SCRIPTS else []
    return rows.where(reduce(lambda a, b: a & b, wanted, F.lit(True)))


def fan_operated(title: Column, description: Column, in_titles: str, in_descriptions: str) -> Column:
    """Whether a title says so, or a description does in the terms that only fans' channels use of themselves: a creator's
    own page may well speak of clips."""
    said = lambda c, pattern: F.coalesce(c, F.lit("")).rlike(pattern)
    return said(title, in_titles) | said(description, in_descriptions)


def decision(reply: Column, reasons: tuple[str, ...], readable: Column) -> Column:
    """A struct of decision and reason: what a reply says if it is an object of just these two, with decision `approve` or
    `needs_review`, one of the reasons, and the reason `ok` exactly if it approves; else null. Evidence that can't be read
    makes any valid reply a review."""
    said = F.from_json(reply, "decision string, reason string")
    shape = F.array_sort(F.json_object_keys(reply)) == F.array(F.lit("decision"), F.lit("reason"))
    kinds = said["decision"].isin("approve", "needs_review") & said["reason"].isin(*reasons)
    valid = F.coalesce(shape & kinds & ((said["decision"] == "approve") == (said["reason"] == "ok")), F.lit(False))
    unread = F.struct(F.lit("needs_review").alias("decision"), F.lit("insufficient_evidence").alias("reason"))
    return F.when(valid & ~F.coalesce(readable, F.lit(False)), unread).when(valid, said)


def profiles(pages: DataFrame, key: str, html: str, patterns: dict[str, str], rules: DataFrame, today: Column) -> DataFrame:
    """One row for each page that has a valid name and links to accounts within its profile: key, name, badge, debut (null
    if it is to come or isn't a date) and accounts. patterns: `name`, `scope` (the part with the profile), `debut` and
    `badge`, each with one group."""
    found = pages.select(key, *(F.regexp_extract(html, p, 1).alias(f"__{n}") for n, p in patterns.items()))
    rows = found.withColumn("name", t.clean_text("__name")).where(t.valid_name("name"))
    accounts = fragment_accounts(rows, key, "__scope", rules).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "platform", "account_id"))).alias("accounts"))
    return rows.join(accounts, key).select(key, "name", F.col("__badge").alias("badge"), t.past_date("__debut", today).alias("debut"), F.transform("accounts", lambda a: F.concat_ws(":", a["platform"], a["account_id"])).alias("accounts"))


def owned_items(links: DataFrame, items: DataFrame, identities: DataFrame, now: Column) -> DataFrame:
    """(record, item): items that a record links to and that are its own: the item's channel is one of the record's
    identities, it is published, has been seen and isn't to come. links: record, item; items: item, channel, published,
    views, upcoming; identities: record, channel."""
    live = items.where((F.col("published") <= now) & (F.col("views") > 0) & ~F.coalesce("upcoming", F.lit(True)))
    return links.select("record", "item").distinct().join(live.select("item", "channel"), "item").join(identities.select("record", "channel").distinct(), ["record", "channel"]).select("record", "item")


def on_hosts(urls: Column, hosts: tuple[str, ...]) -> Column:
    """Whether any URL of a list is on one of the hosts."""
    return F.exists(urls, lambda x: host_key(x).isin(*hosts))


def person_scoped(source_id: Column, evidence: Column, primary: Column, urls: Column, prefixes: tuple[str, ...], official: tuple[str, ...], risky: tuple[str, ...]) -> Column:
    """Whether a record has an official source for its person: a record of an agency with evidence that says so or with a
    primary platform, or one of a platform (by its id's prefix) with a URL on an official host and none on a risky one."""
    agency = source_id.startswith("agency-") & (evidence.rlike("official|individual") | (F.size(primary) > 0))
    of_platform = F.substring_index(source_id, ":", 1).isin(*prefixes) & source_id.contains(":")
    return F.coalesce(agency | (of_platform & on_hosts(urls, official) & ~on_hosts(urls, risky)), F.lit(False))


def risky_record(free: Column, source_id: Column, evidence: Column, urls: Column, prefixes: tuple[str, ...], markers: tuple[str, ...], hosts: tuple[str, ...]) -> Column:
    """Whether a record must go: never one whose source is free to use; else by its id's beginning, by a marker in its
    evidence, or by a URL on a risky host."""
    begins = reduce(lambda a, b: a | b, (source_id.startswith(p) for p in prefixes), F.lit(False))
    marked = reduce(lambda a, b: a | b, (F.lower(F.coalesce(evidence, F.lit(""))).contains(m) for m in markers), F.lit(False))
    return ~F.coalesce(free, F.lit(False)) & F.coalesce(begins | marked | on_hosts(urls, hosts), F.lit(False))


def scoped_links(lines: DataFrame, by: str, order: str, line: str, first: str, last: str, entry: str, link: str) -> DataFrame:
    """(by, entry, links): the links of each entry of a section. The section runs from the first line that fits `first` to
    the next that fits `last`; without both there is none. A line that fits `entry` begins an entry, and each link belongs
    to the entry before it. A document's lines are sorted together."""
    c, before = F.col(line), Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("__first", F.min(F.when(c.rlike(first), F.col(order))).over(Window.partitionBy(by)))
    rows = rows.withColumn("__last", F.min(F.when(c.rlike(last) & (F.col(order) > F.col("__first")), F.col(order))).over(Window.partitionBy(by)))
    rows = rows.where(f"`{order}` >= __first AND `{order}` < __last").withColumn("entry", F.last(F.when(c.rlike(entry), F.col(order)), ignorenulls=True).over(before))
    found = rows.where("entry IS NOT NULL").select(by, "entry", order, F.explode_outer(F.when(F.col("entry") != F.col(order), F.regexp_extract_all(c, F.lit(link), 1))).alias("__link"))
    return found.groupBy(by, "entry").agg(F.count("__link").alias("links"))


def discovered(df: DataFrame, url: str, link: str, profile: str, pages: str) -> DataFrame:
    """df with target (the link in full) and kind: `profile` if its path fits that pattern, `page` if the link fits the one of
    further pages of a list; null for anything else and for links that lead to another host."""
    c, at = F.coalesce(F.col(link), F.lit("")), r"^(https?://[^/?#]*)"
    target = F.when(c.rlike(r"^/(?!/)"), F.concat(F.regexp_extract(url, at, 1), c)).when(c.rlike(r"^https?://"), c)
    own = F.lower(F.regexp_extract(target, r"^https?://([^/?#]*)", 1)) == F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    path = F.regexp_extract(target, r"^https?://[^/?#]*([^?#]*)", 1)
    return df.withColumns({"target": target, "kind": F.when(own & path.rlike(profile), "profile").when(own & target.rlike(pages), "page")})
