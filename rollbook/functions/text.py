"""Name and text normalisers: built-in expressions, but for texts beyond ASCII or with references, of which Python composes, folds
and decodes the characters."""

from __future__ import annotations

import unicodedata
from html import unescape as _unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Katakana U+30A1 to U+30F6 and the hiragana 96 code points below.
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 96) for c in KATAKANA)
#: Kinds of reading sources that count as verified.
VERIFIED_KINDS = ("manual", "official", "profile_explicit", "directory_explicit")
#: Fixed value: names that say their bearer hasn't started yet.
PREPARING = (
    r"(?i)(?:[a-z]*v(?:irtual)?[\s-]*tuber\s*準備中|準備中\s*(?:個人勢)?\s*[a-z]*vtuber|(?<!再)デビュー準備中|(?<!再)デビュー前"
    r"|(?:Vライバー|IRIAM|Avvy|REALITY)\s*準備中|準備中\s*Vライバー|未デビュー|\bpre[\s-]?debut\b)"
)


#: What titles of platforms' pages end in, by platform, in the order in which it is removed.
TITLE_ENDS = {
    "youtube": (r"\s*[-|]\s*YouTube\s*$", r"\s*YouTube\s*$"), "twitch": (r"\s*[-|]\s*Twitch\s*$",), "tiktok": (r"\s*[-|]\s*TikTok\s*$", r"\s+on\s+TikTok\s*$", r"\s*\(@[\w.\-]+\)\s*$"),
    "iriam": (r"\s*[-|]\s*IRIAM\s*$",), "reality": (r"\s*[-|]\s*REALITY\s*$",), "avvy": (r"\s*[-|]\s*Avvy\s*$",), "showroom": (r"\s*[-|]\s*SHOWROOM.*$",), "17live": (r"\s*[-|]\s*17LIVE.*$",),
    "mirrativ": (r"\s*[-|]\s*Mirrativ.*$",), "niconico": (r"\s*[-|]\s*ニコニコ.*$",), "kick": (r"\s*[-|]\s*Kick\s*$",),
}
#: Fixed value: the tag that titles may begin with.
TITLE_TAG = r"^[【\[]\s*(?:VTuber|Vライバー)\s*[】\]]\s*"


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def _decoded(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None else _unescape(s))


def _where(needed: Column, through, c: Column, else_: Column) -> Column:
    """through(c) where it is needed; only those texts go to Python."""
    return F.when(needed, through(F.when(needed, c))).otherwise(else_)


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.char_length(c)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; null stays null. ASCII is composed."""
    return _where(_beyond_ascii(c), _composed, c, c)


def casefold(c) -> Column:
    """NFKC and full case folding (ß becomes ss), letters and digits only; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(_where(_beyond_ascii(c), _folded, c, F.lower(c)), r"[^\p{L}\p{N}]", "")


def unescape(c: Column) -> Column:
    """HTML character references decoded."""
    return _where(F.contains(c, F.lit("&")), _decoded, c, c)


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold_kana(c) -> Column:
    return F.translate(_text(c), KATAKANA, HIRAGANA)


def search_key(c, composed: bool = False) -> Column:
    """Key of searches: NFKC, lower case, katakana as hiragana, letters and digits only. composed: the text is NFKC."""
    return F.regexp_replace(fold_kana(F.lower(_text(c) if composed else nfkc(_text(c)))), r"[^\p{L}\p{N}]", "")


def match_key(c, composed: bool = False) -> Column:
    """Key of matches between sources: as the search key, but kana stay apart."""
    return F.regexp_replace(F.lower(_text(c) if composed else nfkc(_text(c))), r"[^\p{L}\p{N}]", "")


def space_key(c, composed: bool = False) -> Column:
    """NFKC and lower case without white space."""
    return F.regexp_replace(F.lower(_text(c) if composed else nfkc(_text(c))), r"(?U)\s", "")


def kana_reading(c, composed: bool = False) -> Column:
    """The text as hiragana if it has nothing but kana and separators, else ''."""
    folded = F.regexp_replace(fold_kana(_text(c) if composed else nfkc(_text(c))), r"(?U)[\s・･]", "")
    return F.when(folded.rlike(r"^[\x{3041}-\x{3096}ー]+$"), folded).otherwise("")


def clean_text(c, every: bool = False) -> Column:
    """Tags removed, white space collapsed; character references of markup decoded in SQL, or every one by a UDF."""
    text = F.regexp_replace(_text(c), r"<[^>]+>", " ")
    if every:
        return F.trim(F.regexp_replace(unescape(text), r"\s+", " "))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_title(title, platform: Column, most: int = 120) -> Column:
    """A page's title as a name: without what its platform appends and without a leading tag; '' if nothing, too much or a
    line break is left."""
    text = clean_text(title)

    def cut(value: Column, patterns: tuple[str, ...]) -> Column:
        for p in patterns:
            value = F.trim(F.regexp_replace(value, f"(?iU){p}", ""))
        return value

    out = text
    for name, patterns in TITLE_ENDS.items():
        out = F.when(platform == name, cut(text, patterns)).otherwise(out)
    out = cut(out, (TITLE_TAG,))
    return F.when((F.char_length(out) <= most) & ~out.rlike(r"[\r\n\t]"), out).otherwise("")


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def stable_id(*cs) -> Column:
    """24 hex digits of the SHA-256 of the parts, joined by line feeds."""
    return F.substring(F.sha2(F.concat_ws("\n", *cs).cast("binary"), 256), 1, 24)


def iso_date(c) -> Column:
    """The date that a text begins with, if it is one; else null."""
    text = _text(c)
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ])"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")),
        F.when(text.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), F.try_to_date(text, "MMMM d, yyyy")),
        F.when(text.rlike(r"^\d{4}年\d{1,2}月\d{1,2}日$"), F.try_to_date(text, "yyyy年M月d日")),
    )


def iso_timestamp(c) -> Column:
    """The moment of an ISO text, with a zone (Z or an offset) or else in UTC; null for anything else. The session's time
    zone must be UTC for texts without a zone."""
    text = _text(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"(\d{2}[+-]\d{2})(\d{2})$", "$1:$2"), r"^(.{16})(Z|[+-]|$)", "$1:00$2")))


def epoch_ms(c) -> Column:
    """The moment of a count of milliseconds since 1970."""
    return F.timestamp_millis(_text(c).try_cast("bigint"))


def past_date(c, today: Column) -> Column:
    date = iso_date(c)
    return F.when(date <= today, date)


def valid_name(c, most: int = 300) -> Column:
    name = _text(c)
    return (F.char_length(F.trim(name)) > 0) & (F.char_length(name) <= most) & ~name.rlike(r"[\x00-\x1f\x7f]") & ~preparing(name)


def preparing(c) -> Column:
    return _text(c).rlike(PREPARING)


def id_prefix(c) -> Column:
    """The namespace of an id: what stands before the first colon, 'uuid' for a UUID, 'other' else."""
    text = _text(c)
    return F.when(text.contains(":"), F.substring_index(text, ":", 1)).when(text.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid").otherwise("other")


def resolved_reading(reading: Column, source: Column, kind: Column, name: Column, guess: Column, guess_is_for: Column, usable: Column, composed: bool = False) -> Column:
    """(reading, inferred): the verified reading; else an estimate that was made for this very name by a usable model, is all
    kana and keeps the kana that the name begins or ends with; else the name, if it is kana; else, for a name in Japanese
    script, an unverified reading that is all kana; else ''. composed: name, reading and guess are NFKC."""
    plain = lambda c: fold_kana(_text(c) if composed else nfkc(_text(c)))
    kana = lambda c: kana_reading(c, composed)
    spelled, guessed = plain(name), kana(guess)
    start, end = F.regexp_extract(spelled, "^([ぁ-ゖー]+)", 1), F.regexp_extract(spelled, "([ぁ-ゖー]+)$", 1)
    fits = (guess_is_for == name) & usable & (guessed != "") & guessed.startswith(start) & guessed.endswith(end)
    japanese = (_text(name) if composed else nfkc(_text(name))).rlike(r"(?U)^[\p{IsHan}ぁ-ゖァ-ヶー\s・･]+$")
    inferred = F.coalesce(F.when(fits, guessed), F.nullif(kana(name), F.lit("")), F.when(japanese, F.nullif(kana(reading), F.lit(""))))
    verified = (_text(source) != "") & _text(kind).isin(*VERIFIED_KINDS) & (_text(reading) != "")
    return F.struct(F.when(verified, reading).otherwise(F.coalesce(inferred, F.lit(""))).alias("reading"), (~verified & inferred.isNotNull()).alias("inferred"))


def name_keys(names: Column, roles: tuple[str, ...] = ()) -> Column:
    """Distinct match keys of names and their parts: without bracketed remarks and role words, split at slashes and bars.
    The names are NFKC."""
    parts = F.flatten(F.transform(names, lambda n: F.split(F.regexp_replace(n, r"[（(【\[][^）)】\]]*[）)】\]]", ""), r"[/／|｜]")))
    dropped = parts if not roles else F.transform(parts, lambda p: F.regexp_replace(p, "(?i)" + "|".join(rf"\b{r}\b" for r in roles), ""))
    return F.array_remove(F.array_distinct(F.transform(dropped, lambda p: F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]", ""))), "")


def bounded(c, most: int) -> Column:
    return F.substring(_text(c), 1, most)


def number(c) -> Column:
    """A whole number with thousands separators; null for anything else."""
    return F.regexp_replace(_text(c), r"[,\s]", "").try_cast("bigint")


def category(category: Column, source: Column, special: tuple[str, ...], default: str) -> Column:
    """The record's category if it is one of the special ones; the second also for records with an https source."""
    first, second = special
    return F.when(category == first, first).when((category == second) | source.startswith("https://"), second).otherwise(default)


#: Fixed value(s): metadata whose content counts as visible text.
KEY_METAS = ("og:title", "og:description", "description", "datePublished", "uploadDate", "name")


def visible_text(html, metas: tuple[str, ...] = KEY_METAS) -> Column:
    """The text of a page without scripts and styles, with the content of the given metadata where it stands."""
    names = "|".join(metas)
    shown = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    told = F.regexp_replace(shown, rf"""(?i)<meta\b(?=[^>]*\b(?:property|name|itemprop)=["'](?:{names})["'])[^>]*\bcontent=(?:"([^"]*)"|'([^']*)')[^>]*>""", " $1$2 ")
    return clean_text(told)


def embedded_json(html, element: str, schema: str) -> Column:
    """The JSON of the script with that id, as a value of the schema; null where there is none or it can't be read."""
    block = F.regexp_extract(html, rf"""(?is)<script\b[^>]*\bid=["']{element}["'][^>]*>(.*?)</script>""", 1)
    return F.from_json(F.nullif(block, F.lit("")), schema)
