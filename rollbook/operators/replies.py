"""Replies of language models: what can be read of text that should have been JSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

#: Patterns of messages that ask for names, that ask for none, and that ask for something else about names.
NO_NAMES = r"(?i)(?:分析|傾向|統計|説明|analysis|statistics|趋势|분석).{0,12}(?:だけ|のみ|only|就好|만)|(?:名前|候補).{0,8}(?:不要|いらない)|(?:no|without)\s+(?:name\s+)?suggestions"
WANTED = (
    r"(?is)(?:名前|候補|活動名|名付け|命名|ネーミング).{0,35}(?:欲|ほし|考|案|作|出|探|お願い)|(?:考|提案|作|出).{0,20}(?:名前|候補)|(?:name|naming).{0,25}(?:idea|suggest|creat|want)"
    r"|(?:suggest|creat|want|give).{0,25}names?|起名|取名|名字.{0,10}(?:想|建议)|이름.{0,15}(?:추천|지어|만들|생각)"
)
ASIDE = r"(?i)傾向|分析|統計|説明|why|analysis|statistics|趋势|분석"

_LIST = re.compile(r'"(?:suggestions|candidates|names)"\s*:\s*\[')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}"]', re.S)
_SCALAR = re.compile(r"[^\s,\]}]+[^,\]}]*,")


def _closing(text: str, at: int) -> int:
    """Where the bracket at a place is closed again; -1 if it isn't."""
    depth = 0
    for m in _MARK.finditer(text, at):
        if m[0] == '"':
            return -1
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return -1


def _items(text: str | None) -> list[str]:
    import json

    found = _LIST.search(text or "")
    at, out = found.end() if found else len(text or ""), []
    while at < len(text or "") and text[at] not in "]}":
        if text[at] in ", \t\r\n":
            at += 1
            continue
        if text[at] == '"':
            m = _STRING.match(text, at)
            end = m.end() if m else -1
        elif text[at] in "[{":
            end = _closing(text, at)
        else:  # a number or word is whole only if a comma follows
            m = _SCALAR.match(text, at)
            end = m.end() - 1 if m else -1
        if end < 0:
            break
        try:
            json.loads(text[at:end])
            out.append(text[at:end].rstrip())
        except ValueError:  # closed, but no JSON
            pass
        at = end
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def closed_items(texts: pd.Series) -> pd.Series:
    """The closed items of the array under `suggestions`, `candidates` or `names` in a text of JSON that was cut off."""
    return texts.map(_items)


def wants_names(text: Column, follows: Column, none: str = NO_NAMES, wanted: str = WANTED, aside: str = ASIDE) -> Column:
    """Whether a message asks for names: never if it says that it wants none; else if it asks for them, or if it follows an
    answer and doesn't turn to something else. A null message asks for nothing of its own."""
    said = lambda pattern: F.coalesce(text, F.lit("")).rlike(pattern)
    return ~said(none) & (said(wanted) | (F.coalesce(follows, F.lit(False)) & ~said(aside)))


def accepted_readings(names: DataFrame, items: DataFrame, most: int = 160, composed: bool = False) -> DataFrame:
    """(batch, idx, reading) of the batches that are accepted as a whole: each index of the batch has exactly one reading and
    there are no others, readings are kana (or empty), and they keep the kana that a name begins or ends with.

    names: batch, idx, name; items: batch, idx, reading. A batch is what a model was asked at once, a few dozen rows."""
    plain = t.fold_kana(F.col("name") if composed else t.nfkc(F.coalesce("name", F.lit(""))))
    start, end = F.regexp_extract(plain, "^([ぁ-ゖー]+)", 1), F.regexp_extract(plain, "([ぁ-ゖー]+)$", 1)
    compact = F.regexp_replace("reading", r"(?U)[\s・]", "")
    good = F.col("reading").rlike("^[ぁ-ゖー ・]*$") & (F.char_length("reading") <= most) & compact.startswith(start) & compact.endswith(end)
    told = items.groupBy("batch", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("reading").alias("reading"))
    both = names.join(told, ["batch", "idx"], "full_outer").withColumn("ok", F.coalesce((F.col("n") == 1) & F.col("name").isNotNull() & good, F.lit(False)))
    whole = both.groupBy("batch").agg(F.bool_and("ok").alias("ok")).where("ok").select("batch")
    return both.join(whole, "batch", "left_semi").select("batch", "idx", F.trim("reading").alias("reading"))
