"""URL normalisers and account identities. An account is (platform, id), read from a URL by ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values: (platform, hosts, path pattern, whether ids are in lower case), in the order in which they are tried.
ACCOUNT_RULES = (
    ("youtube", ("youtube.com", "m.youtube.com"), r"/(channel/UC[\w-]{22})", False),
    ("youtube", ("youtube.com", "m.youtube.com"), r"/(@[\w.\-]+)", True),
    ("tiktok", ("tiktok.com",), r"/(@[\w.\-]+)(?:/live)?", True),
    ("twitch", ("twitch.tv", "m.twitch.tv"), r"/(\w+)", True),
    ("avvy", ("s.avvy.live",), r"/u/([0-9a-hjkmnp-tv-z]{26})", False),
    ("iriam", ("web.iriam.app",), r"/s/user/([\w-]+)", False),
    ("reality", ("reality.app",), r"/profile/([\w-]+)", False),
    ("17live", ("17.live",), r"/s/u/([\w-]+)", False),
    ("17live", ("17.live",), r"/(?:[a-z]{2}/)?profile/(?:[ur]/)?([\w-]+)", False),
    ("showroom", ("showroom-live.com",), r"/(?:r/)?([\w-]+)", False),
    ("twitcasting", ("twitcasting.tv",), r"/([\w:.-]+)", True),
    ("niconico", ("nicovideo.jp", "sp.nicovideo.jp", "cas.nicovideo.jp"), r"/user/(\d+)", False),
    ("niconico", ("com.nicovideo.jp",), r"/community/(co\d+)", False),
    ("mirrativ", ("mirrativ.com",), r"/user/(\d+)", False),
    ("acfun", ("acfun.cn",), r"/u/(\d+)", False),
    ("bilibili", ("space.bilibili.com",), r"/(\d+)", False),
    ("spoon", ("spooncast.net",), r"/(?:[a-z]{2}/)?profile/([\w-]+)", False),
    ("spoon", ("spooncast.net",), r"/(?:[a-z]{2}/)?channel/(\d+)(?:/tab/home)?", False),
    ("whowatch", ("whowatch.tv",), r"/profile/(w:[\w.-]+)", False),
    ("pococha", ("pococha.com",), r"/app/users/([\w-]+)", False),
    ("pikapika", ("pikapika.live",), r"/index/roomuser/uid/(\d+)", False),
    ("standfm", ("stand.fm",), r"/channels/([a-f0-9]{24})", False),
    ("radiotalk", ("radiotalk.jp",), r"/program/(\d+)", False),
    ("openrec", ("openrec.tv", "mellow-fan.com"), r"/(?:m/)?user/([\w-]+)", False),
    ("pokekara", ("u.pokekara.com",), r"/user/(\d+)", False),
    ("instagram", ("instagram.com",), r"/([\w.]+)", False),
    ("facebook", ("facebook.com",), r"/([\w.]+)", False),
    ("topia", ("topia.tv",), r"/p/([\w-]+)", False),
    ("topia", ("user.topia.tv",), r"/([\w-]+)", False),
    ("palmu", ("palmu.me", "app.palmu.jp"), r"/users/([\w-]+)", False),
    ("mixch", ("mixch.tv",), r"/u/(\d+)", False),
    ("bigo", ("bigo.tv",), r"/([\w-]+)", False),
    ("kick", ("kick.com",), r"/([\w-]+)", True),
    ("soop", ("ch.sooplive.co.kr", "bj.afreecatv.com"), r"/([\w-]+)", True),
    ("chzzk", ("chzzk.naver.com", "m.chzzk.naver.com"), r"/([a-f0-9]{32})", False),
    ("rplay", ("rplay.live",), r"/(c/[\w.-]+|creatorhome/[a-f0-9]{24})", False),
    ("x", ("x.com", "twitter.com"), r"/@?(\w+)", True),
)
#: Fixed values: (platform, host, path, parameter, pattern) of platforms that have the id in the query.
QUERY_RULES = (
    ("colorsing", "web.colorsing.com", "/share/user", "user_id", r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    ("iriam", "web.iriam.app", "/s/user", "id", r"[\w-]+"),
)
#: A host whose `link` parameter is the real URL, if that is on one of these hosts.
WRAPPER, WRAPPED = "mirrativ.page.link", ("mirrativ.com", "www.mirrativ.com")
#: Platforms whose accounts have one URL, whatever the link was.
ACCOUNT_URLS = {"x": "https://x.com/", "tiktok": "https://www.tiktok.com/", "whowatch": "https://whowatch.tv/profile/"}
#: Hosts whose paths don't tell upper and lower case.
CASELESS_HOSTS = ("youtube.com", "twitch.tv", "tiktok.com", "kick.com", "x.com")
#: Platforms that are no leads, as their public pages seldom can be read.
WEAK_PLATFORMS = ("x", "instagram", "facebook", "bilibili", "acfun")
#: Names that are pages of a platform, not accounts.
RESERVED = ("home", "explore", "directory", "search", "login", "signup", "i", "intent")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)"


def _part(url, i: int) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), _PARTS, i)


def safe_url(url) -> Column:
    """The URL if it is https without user and port, else null."""
    c = F.col(url) if isinstance(url, str) else url
    return F.when((F.lower(_part(c, 1)) == "https") & (_part(c, 2) == "") & (_part(c, 4) == "") & (_part(c, 3) != ""), c)


def host_key(url) -> Column:
    """Host in lower case without www. or m., with short-link hosts as the hosts they stand for."""
    host = F.regexp_replace(F.lower(_part(url, 3)), r"^(?:www|m)\.", "")
    return F.when(host == "youtu.be", "youtube.com").when(host == "twitter.com", "x.com").otherwise(host)


def path(url) -> Column:
    return F.regexp_replace(_part(url, 5), r"/+$", "")


def decoded(c: Column) -> Column:
    """Percent-encoding undone, a plus kept; text that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def parameter(url, name: str) -> Column:
    """The first value of a parameter of the query, decoded; '' without it."""
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.try_url_decode(F.regexp_extract(F.coalesce(c, F.lit("")), rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)), F.lit(""))


def url_key(url) -> Column:
    """Host key and decoded path without final slash: URLs with equal keys are the same page. Paths of hosts that don't tell
    case are in lower case."""
    host, at = host_key(url), F.regexp_replace(decoded(_part(url, 5)), r"/+$", "")
    at = F.when(host.isin(*CASELESS_HOSTS), F.lower(at)).when(host == "whowatch.tv", F.regexp_replace(at, "^/sp", "")).otherwise(at)
    return F.concat(host, at)


def rule_table(spark: SparkSession, rules=ACCOUNT_RULES) -> DataFrame:
    return spark.createDataFrame([(i, p, h, f"(?U)^{pattern}$", low) for i, (p, hosts, pattern, low) in enumerate(rules) for h in hosts], "rank int, platform string, rule_host string, pattern string, lowered boolean")


def with_account(df: DataFrame, url: str, rules: DataFrame, reserved: tuple[str, ...] = RESERVED) -> DataFrame:
    """df with platform, account_id and account_url, null where no rule fits: rules meet URLs by host, and the first in rank
    wins. Wrapped links count as what they wrap; some ids are in the query; x users may be named by number. The rules are a
    small table of known size, which is broadcast."""
    c = F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("&amp;"), F.lit("&"))
    bare = lambda x: F.regexp_replace(F.lower(_part(x, 3)), r"^www\.", "")
    target = parameter(c, "link")
    at = df.withColumn("__url", F.when(bare(c) != WRAPPER, c).when(F.lower(_part(target, 3)).isin(*WRAPPED), target).otherwise(""))
    c = F.col("__url")
    at = at.withColumns({"__host": bare(c), "__raw": path(c), "__path": F.regexp_replace(decoded(_part(c, 5)), r"/+$", ""), "__ok": F.lower(_part(c, 1)).isin("http", "https") & (_part(c, 2) == "") & (_part(c, 4) == "")})
    by_host = rules.groupBy("rule_host").agg(F.sort_array(F.collect_list(F.struct("rank", "platform", "pattern", "lowered"))).alias("__rules"))
    joined = at.join(F.broadcast(by_host), F.col("__host") == F.col("rule_host"), "left")
    found = F.filter(
        F.transform("__rules", lambda r: F.struct(r["platform"].alias("platform"), F.call_function("regexp_extract", F.col("__path"), r["pattern"], F.lit(1)).alias("id"), r["lowered"].alias("lowered"))),
        lambda x: x["id"] != "",
    )
    first = F.get(found, F.lit(0))
    ident = F.when(first["lowered"], F.lower(first["id"])).otherwise(first["id"])
    own = F.create_map(*(F.lit(x) for pair in ACCOUNT_URLS.items() for x in pair))
    plain = F.concat(F.lit("https://"), F.col("__host"), F.col("__raw"))
    clean = F.coalesce(F.concat(own[first["platform"]], ident), F.when((first["platform"] == "niconico") & ident.rlike(r"^\d+$"), F.concat(F.lit("https://www.nicovideo.jp/user/"), ident)), plain)

    def account(platform, ident, link):
        return F.struct(F.lit(platform).alias("platform") if isinstance(platform, str) else platform.alias("platform"), ident.alias("id"), link.alias("url"))

    number = F.regexp_extract("__path", r"^/i/user/(\d+)$", 1)
    special = [F.when((F.col("__host").isin("x.com", "twitter.com")) & (number != ""), account("x", F.concat(F.lit("uid:"), number), F.concat(F.lit("https://x.com"), F.col("__path"))))]
    for platform, host, at_path, name, pattern in QUERY_RULES:
        value = parameter(c, name)
        special.append(F.when((F.col("__host") == host) & (F.col("__path") == at_path) & value.rlike(f"(?U)^{pattern}$"), account(platform, value, F.concat(F.lit(f"https://{host}{at_path}?{name}="), value))))
    uid = F.lower(parameter(c, "uid"))
    deep = F.when((F.lower(_part(c, 1)) == "iriam") & (_part(c, 3) == "p") & F.col("__path").isin("", "/") & (parameter(c, "applicationModel") == "profile") & uid.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$"), account("iriam", uid, F.concat(F.lit("iriam://p?applicationModel=profile&uid="), uid)))
    by_rule = F.when(first.isNotNull() & ~F.lower(first["id"]).isin(*reserved), account(first["platform"], ident, clean))
    out = joined.withColumn("__account", F.coalesce(deep, F.when(F.col("__ok"), F.coalesce(*special, by_rule))))
    out = out.withColumns({"platform": F.col("__account.platform"), "account_id": F.col("__account.id"), "account_url": F.col("__account.url")})
    return out.drop("__url", "__host", "__raw", "__path", "__ok", "__rules", "rule_host", "__account")


def with_candidate(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """df with candidate: a video's link in one form, or an account's URL if its platform's pages can be read; else null."""
    c = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_replace(F.lower(_part(c, 3)), r"^(?:www\.)?(?:m\.)?", "")
    at = F.regexp_replace(decoded(_part(c, 5)), r"/+$", "")
    video = F.when(host == "youtu.be", F.regexp_extract(at, r"^/*([\w-]{11})$", 1)).when((host == "youtube.com") & (at == "/watch"), F.regexp_extract(parameter(c, "v"), r"^([\w-]{11})$", 1))
    kind, of_path = F.regexp_extract(at, r"^/(shorts|live)/[\w-]{11}$", 1), F.regexp_extract(at, r"^/(?:shorts|live)/([\w-]{11})$", 1)
    moving = F.when((host == "youtube.com") & (kind != ""), F.concat(F.when(kind == "shorts", "https://www.youtube.com/shorts/").otherwise("https://www.youtube.com/watch?v="), of_path))
    known = F.when(video.isNotNull(), F.when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video)))
    safe = (F.lower(_part(c, 1)) == "https") & (_part(c, 2) == "")
    accounts = with_account(df, url, rules)
    account = F.when(~F.col("platform").isin(*WEAK_PLATFORMS), F.col("account_url"))
    return accounts.withColumn("candidate", F.when(safe, F.when(video.isNotNull(), known).otherwise(F.coalesce(moving, account)))).drop("platform", "account_id", "account_url")


def own_channel(channel: Column, source_id: Column, links: Column) -> Column:
    """A record's own channel id: from its field, else its source_id, else the first of its links to a channel."""
    valid = lambda c: F.when(c.rlike(r"^UC[\w-]{22}$"), c)
    linked = F.filter(F.transform(links, lambda x: F.regexp_extract(x, r"^https://(?:www\.|m\.)?youtube\.com/channel/(UC[\w-]{22})(?:[/?#]|$)", 1)), lambda x: x != "")
    return F.coalesce(valid(channel), valid(F.regexp_extract(source_id, "^youtube:(.*)$", 1)), F.get(linked, F.lit(0)))


def record_accounts(records: DataFrame, key: str, rules: DataFrame, links: tuple[str, ...] = ("platform_accounts",), fields: tuple[str, ...] = ("twitter_url", "twitch_url", "source_url", "broadcast_url", "youtube_url")) -> DataFrame:
    """(key, platform, account_id, account_url, paired): the accounts of each record, each once, from its lists of links, its
    fields with URLs, its twitch_login, youtube_handle and youtube_channel_id (or a source id that names a channel).

    paired: the handle that the record gives beside its one channel, so that both are one account.
    """
    login = F.when(F.col("twitch_login").rlike(r"^\w+$"), F.concat(F.lit("https://www.twitch.tv/"), "twitch_login"))
    handle = F.when(F.col("youtube_handle").rlike(r"(?U)^@[\w.\-]+$"), F.concat(F.lit("https://www.youtube.com/"), "youtube_handle"))
    channel = own_channel(F.col("youtube_channel_id"), F.col(key).cast("string"), F.array().cast("array<string>"))
    every = F.array_compact(F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in links), F.array(*fields, login, handle, F.concat(F.lit("https://www.youtube.com/channel/"), channel)))))
    # a small file of many records is one task's; dealt by key, they need no other shuffle
    each = records.repartition(F.col(key)).select(F.col(key), F.lower("youtube_handle").alias("__handle"), channel.isNotNull().alias("__own"), F.explode(F.array_distinct(every)).alias("__link"))
    found = with_account(each, "__link", rules).where("platform IS NOT NULL")
    found = found.groupBy(key, "platform", "account_id").agg(F.min("account_url").alias("account_url"), F.first("__handle").alias("__handle"), F.first("__own").alias("__own"))
    found = found.withColumn("__channels", F.count_if((F.col("platform") == "youtube") & F.col("account_id").startswith("channel/")).over(Window.partitionBy(key)))
    paired = (F.col("platform") == "youtube") & F.col("account_id").eqNullSafe(F.col("__handle")) & F.col("__own") & (F.col("__channels") == 1)
    return found.where(F.col(key).isNotNull()).withColumn("paired", F.coalesce(paired, F.lit(False))).drop("__handle", "__own", "__channels")


def fragment_accounts(df: DataFrame, key: str, html: str, rules: DataFrame) -> DataFrame:
    """(key, platform, account_id, place): the accounts that a fragment links to, each once, with its first link's place."""
    links = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref=["']([^"']+)"""), 1)).alias("place", "link"))
    return with_account(links, "link", rules).where("account_id IS NOT NULL").groupBy(key, "platform", "account_id").agg(F.min("place").alias("place"))


def platform_details(records: DataFrame, accounts: DataFrame, key: str, labels: tuple[str, ...]) -> DataFrame:
    """(key, known, primary): platforms of a record. Known ones are those of its accounts, those that it names with a safe
    source, and the primary ones; these count only if the record has both a safe source and evidence for them. Links alone
    never make a platform primary.

    records: key, platforms, platform_sources (a map), primary_platforms, primary_source, primary_evidence; accounts: key,
    platform.
    """
    linked = accounts.where(F.col("platform").isin(*labels)).groupBy(key).agg(F.collect_set("platform").alias("__linked"))  # labels are few
    none = F.array().cast("array<string>")
    labelled = lambda c: F.array_intersect(F.coalesce(c, none), F.array(*map(F.lit, labels)))
    told = F.filter(labelled("platforms"), lambda x: safe_url(F.try_element_at("platform_sources", x)).isNotNull())
    backed = safe_url("primary_source").isNotNull() & (F.coalesce("primary_evidence", F.lit("")) != "")
    primary = F.when(backed, labelled("primary_platforms")).otherwise(none)
    known = F.array_sort(F.array_union(F.array_union(F.coalesce("__linked", none), told), primary))
    return records.join(linked, key, "left").select(key, known.alias("known"), F.array_sort(primary).alias("primary"))


def first_of(text, patterns: list[str]) -> Column:
    """The first pattern's group 1 that isn't empty, else null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
