"""Extraction from pages by a table of rules: pages become elements with their paths, rules meet them by host, and what they find
is values, single or many, and entries with what follows them.

A rule is a row: host (the host key it is for, '' for all), field, kind, scope (a pattern that ends at an element of a path
such as /html/body/div#roster.list/h3), attr (an attribute; null: the element's text), named (the value of the element's
name, property or itemprop that it needs; null: any), pattern (null, or one with a group) and rank. Kinds are `one` (of
several values the first by rank, then place), `many`, `entry` (begins an entry), `part` (belongs to the entry before it),
`begin` and `end` (bounds of the section that entries must be in)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RULE = "host string, field string, kind string, scope string, attr string, named string, pattern string, rank int"
_TOKEN = "place int, element boolean, path string, ids array<int>, attrs map<string,string>, text string"
_ARROW = (pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.map_(pa.string(), pa.string()), pa.string())
#: Elements and texts that a worker holds at once, and those of one page.
MOST_HELD = 8192
#: Rules that are broadcast; more are joined by host.
MOST_BROADCAST = 50_000
#: A path names so many of the innermost elements; pages that nest deeper keep all their texts.
DEPTH = 64
#: Elements without an end, and those that an element ends before it begins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements inside of which such ends are looked for.
CONTAINERS = frozenset("html body main article section aside header footer nav div ul ol dl table tbody thead select form".split())


class _Elements(HTMLParser):
    """Elements and texts of a page in their order, each with its path and the places of the elements on it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.open: list[tuple[str, str, int]] = []  # name, path, place

    def _add(self, element: bool, path: str, ids: list[int], attrs: dict | None, text: str | None) -> None:
        self.out.append((len(self.out), element, path, ids, attrs, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended, outermost = ENDS.get(tag, ()), None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ended:
                outermost = i
            elif self.open[i][0] in CONTAINERS:
                break
        if outermost is not None:
            del self.open[outermost:]
        said = {k: v or "" for k, v in reversed(attrs)}  # the first of a name counts
        mark = (f"#{said['id']}" if said.get("id") else "") + "".join(f".{c}" for c in said.get("class", "").split())
        above = self.open[-1][1] if self.open else ""
        path = (above if len(self.open) < DEPTH else above[above.index("/", 1) :]) + "/" + tag + mark.replace("/", "_")
        place = len(self.out)
        self._add(True, path, [*self._ids(), place][-DEPTH:], said, None)
        if tag not in VOID:
            self.open.append((tag, path, place))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        ids = self._ids()
        if self.out and not self.out[-1][1] and self.out[-1][3] == ids:  # a text that comes in pieces
            self.out[-1] = (*self.out[-1][:5], self.out[-1][5] + data)
        elif data.strip():
            self._add(False, self.open[-1][1] if self.open else "", ids, None, data)

    def _ids(self) -> list[int]:
        return [p for _, _, p in self.open[-DEPTH:]]


def _tokens(html: str | None) -> list[tuple]:
    page = _Elements()
    page.feed(html or "")
    page.close()
    return page.out


def ended_references(html: Column) -> Column:
    """html in which only what ends in a semicolon is a reference, so that a text that was cut amid one keeps what it has."""
    return F.regexp_replace(html, r"&(?=#?[A-Za-z0-9]++(?!;))", "&amp;")


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the last column's pages, in batches that are given out as soon as they have MOST_HELD elements and texts."""

    def piece(batch: pa.RecordBatch, of: list[int], out: list[tuple]) -> pa.RecordBatch:
        at = pa.array(of, pa.int32())
        own = [c.take(at) for c in batch.columns[:-1]]
        columns = [[t[i] for t in out] for i in range(len(_ARROW))]
        columns[4] = [None if a is None else list(a.items()) for a in columns[4]]
        names = [*batch.schema.names[:-1], *(f.split(" ")[0] for f in _TOKEN.split(", "))]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, kind) for c, kind in zip(columns, _ARROW))], names=names)

    for batch in batches:
        of: list[int] = []
        out: list[tuple] = []
        for i, page in enumerate(batch.columns[-1]):
            tokens = _tokens(page.as_py())
            of += [i] * len(tokens)
            out += tokens
            if len(out) >= MOST_HELD:
                yield piece(batch, of, out)
                of, out = [], []
        if out:
            yield piece(batch, of, out)


def elements(pages: DataFrame, key: str, html: str, *more: str) -> DataFrame:
    """key, `more`, place, element (else it is a text), path, ids (places of the elements on the path), attrs and text, a row
    for each element and text of a page. Elements that aren't ended end with what is around them; a null page has none."""
    rows = pages.select(key, *more, html)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_in_pieces, f"{own}, {_TOKEN}")


def found(pages: DataFrame, key: str, html: str, host: Column, rules: DataFrame) -> DataFrame:
    """key, field, kind, rank, place and value (blank ones left out) of all that the rules find. The text of an element is all
    that is in it, with single blanks. Each page is read once, whatever the number of rules."""
    tokens = elements(pages.withColumn("__host", host), key, html, "__host")
    rows = rules.select(F.col("host").alias("__for"), "field", "kind", "scope", "attr", "named", "pattern", "rank")
    rows = F.broadcast(rows) if rules.count() <= MOST_BROADCAST else rows
    # a text belongs to elements above it, a value of an attribute to the element itself
    fits = F.rlike("path", F.concat(F.lit("(?:"), "scope", F.lit(")"), F.when(F.col("element"), "$").otherwise("(?:/|$)")))
    kind = F.col("element") == (F.col("attr").isNotNull() | F.col("kind").isin("begin", "end"))
    names = [F.lower(F.try_element_at("attrs", F.lit(n))) == F.lower("named") for n in ("name", "property", "itemprop")]
    named = F.col("named").isNull() | F.coalesce(names[0], F.lit(False)) | F.coalesce(names[1], F.lit(False)) | F.coalesce(names[2], F.lit(False))
    own = tokens.join(rows.where("__for != ''"), (F.col("__host") == F.col("__for")) & kind & fits & named)
    # rules for all hosts are few: one row a rule is what each token meets
    common = tokens.join(F.broadcast(rows.where("__for = ''")), kind & fits & named)
    met = own.union(common)
    prefix = F.call_function("regexp_extract", "path", F.concat(F.lit("^(.*?(?:"), "scope", F.lit("))(?:/|$)")), F.lit(1))
    at = F.when(F.col("element"), F.col("place")).otherwise(F.try_element_at("ids", (F.size(F.split(prefix, "/")) - 1).cast("int")))
    rule = ["field", "kind", "rank", "scope", "attr", "named", "pattern"]
    pieces = met.withColumn("at", at).groupBy(key, *rule, "at").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("element"), F.try_element_at("attrs", "attr")).otherwise(F.col("text")).alias("text")))).alias("texts"))
    whole = F.trim(F.regexp_replace(F.array_join(F.transform("texts", lambda x: x["text"]), " "), r"\s+", " "))
    value = F.when(F.col("pattern").isNull(), whole).otherwise(F.call_function("regexp_extract", whole, F.col("pattern"), F.lit(1)))
    out = pieces.select(key, "field", "kind", "rank", F.col("at").alias("place"), F.when(F.col("kind").isin("begin", "end"), "").otherwise(value).alias("value"))
    return out.where("value != '' OR kind IN ('begin', 'end')")


def fields(values: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """One row for each page with a value: of each of the names the first by rank, then place, and a map `many` with the distinct
    values of each field of that kind in the order of the page."""
    first = [F.min(F.when((F.col("field") == n) & (F.col("kind") == "one"), F.struct("rank", "place", "value")))["value"].alias(n) for n in names]
    rows = values.where((F.col("kind") == "many") | ((F.col("kind") == "one") & F.col("field").isin(*names)))
    lists = rows.where("kind = 'many'").groupBy(key, "field").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank", "value"))), lambda x: x["value"])).alias("values"))
    many = lists.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("many"))
    return rows.groupBy(key).agg(*first).join(many, key, "left")


def entries(values: DataFrame, key: str, entry: str, parts: tuple[str, ...], bound: str | None = None) -> DataFrame:
    """(key, entry, place, parts): each entry of a field with what belongs to it, a list of (field, value) of the given fields
    in the order of the page: all between it and the next entry. With `bound`, the section runs from that field's first
    `begin` to its first `end` after it, and a page without both has no entries."""
    page, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("place", F.col("kind") != "entry", "rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = values.where(((F.col("kind") == "entry") & (F.col("field") == entry)) | ((F.col("kind") == "part") & F.col("field").isin(*parts)) | (F.col("kind").isin("begin", "end") & (F.col("field") == F.lit(bound))))
    if bound:
        rows = rows.withColumn("__begin", F.min(F.when(F.col("kind") == "begin", F.col("place"))).over(page))
        rows = rows.withColumn("__end", F.min(F.when((F.col("kind") == "end") & (F.col("place") > F.col("__begin")), F.col("place"))).over(page))
        rows = rows.where("place > __begin AND place < __end")
    rows = rows.where("kind IN ('entry', 'part')").withColumn("__entry", F.last(F.when(F.col("kind") == "entry", F.struct("place", "value")), ignorenulls=True).over(before)).where("__entry IS NOT NULL")
    out = rows.groupBy(key, "__entry").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "part", F.struct("place", "rank", "field", "value")))).alias("p"))
    return out.select(key, F.col("__entry.value").alias("entry"), F.col("__entry.place").alias("place"), F.transform("p", lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"))).alias("parts"))
