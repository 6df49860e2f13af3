"""Queries of batches: new entities as components, and batches in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, identity, replay
from .common import table

#: Two kinds of accounts that parts share: those of one brand, size and type, and those of one name and size, on one shelf.
_SHELF = "CAST(floor(p_partkey / 2000) AS BIGINT)"
_FIRST = f"concat_ws(':', p_brand, p_size, p_type, {_SHELF})"
_SECOND = f"concat_ws(':', p_name, p_size, {_SHELF})"


def _accounts(parts, key):
    return parts.select(F.col("p_partkey").alias(key), F.explode(F.array(F.expr(_FIRST), F.expr(_SECOND))).alias("account"))


def _batch(spark, sf_dir):
    """Parts with even keys are the registry, the others a batch in the order of their keys, of which every ninth has an id
    that is known."""
    p = table(spark, sf_dir, "part")
    existing = _accounts(p.where("p_partkey % 2 = 0"), "id")
    incoming = _accounts(p.where("p_partkey % 2 = 1"), "ord").withColumn("in_id", F.expr("CASE WHEN ord % 9 = 0 THEN ord - 1 ELSE ord END"))
    return existing, incoming


def d8_batch_entities(spark, sf_dir):
    """Rows of a batch that share unseen accounts are one new entity."""
    existing, incoming = _batch(spark, sf_dir)
    rows = incoming.select(F.col("ord").alias("in_id"), "account")
    return components.batch_entities(rows, identity.resolve(existing, rows))


def d8_replayed(spark, sf_dir):
    """Each row against the registry as the rows before it left it."""
    return replay.replayed(*_batch(spark, sf_dir))


def _directory(spark, sf_dir):
    """Parts with odd keys as a directory's rows; of those with even keys every tenth is a stub of the directory's for the
    next part, and every seventh lists the next one's id."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stub = k % 10 == 4
    none = F.array().cast("array<string>")
    listed = F.when(stub | (k % 7 == 0), F.array((k + 1).cast("string"))).otherwise(none)
    ident = F.when(stub, F.concat(F.lit("stub:"), k + 1)).otherwise(F.concat(F.lit("r"), k))
    accounts = F.when(k % 3 == 0, F.array(F.expr(_FIRST), F.expr(_SECOND))).otherwise(F.array(F.expr(_SECOND)))
    names = F.array("p_brand", F.concat("p_brand", "p_type"))
    existing = p.where(k % 2 == 0).select(ident.alias("id"), stub.alias("stub"), accounts.alias("accounts"), names.alias("names"), listed.alias("listed"))
    account = F.when(k % 5 != 0, F.expr(_SECOND))
    incoming = p.where(k % 2 == 1).select(
        k.alias("ord"), k.cast("string").alias("in_id"), F.concat(F.lit("stub:"), k).alias("stub_id"), account.alias("account"), F.concat(F.lit("c:"), account).alias("account_id"),
        F.array("p_brand", "p_type").alias("names"), (k % 11 != 0).alias("active"),
    )
    return existing, incoming


def d8_replayed_by_name(spark, sf_dir):
    return replay.replayed_by_name(*_directory(spark, sf_dir))


def d8_without_stubs(spark, sf_dir):
    """The registry's ids after the directory's stubs that found their records are retired."""
    existing, incoming = _directory(spark, sf_dir)
    return replay.without_retired(existing.select("id", "stub"), replay.replayed_by_name(existing, incoming), "id")


_BATCH = f"""WITH RECURSIVE a AS (SELECT p_partkey AS k, unnest([{_FIRST}, {_SECOND}]) AS account FROM part),
e AS (SELECT k AS id, account FROM a WHERE k % 2 = 0), n AS (SELECT k AS ord, account FROM a WHERE k % 2 = 1), """.replace("CAST(floor(p_partkey / 2000) AS BIGINT)", "p_partkey // 2000")
_REPLAY = (
    _BATCH
    + """rows AS (SELECT ord, CASE WHEN ord % 9 = 0 THEN ord - 1 ELSE ord END AS in_id, list(account) AS accs, row_number() OVER (ORDER BY ord) AS i FROM n GROUP BY ord),
run AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::BIGINT AS in_id, NULL::BIGINT AS target, NULL::VARCHAR AS status,
    (SELECT list({'a': account, 't': id}) FROM e WHERE account IN (SELECT account FROM n)) AS held, (SELECT list(DISTINCT id) FROM e) AS ids
  UNION ALL SELECT i, ord, in_id, target, status, CASE WHEN status = 'ambiguous' THEN held ELSE list_concat(held, list_transform(accs, lambda x: {'a': x, 't': target})) END, CASE WHEN status = 'new' THEN list_append(ids, in_id) ELSE ids END
  FROM (SELECT *, CASE status WHEN 'ambiguous' THEN NULL WHEN 'matched' THEN m[1] ELSE in_id END AS target
    FROM (SELECT *, CASE WHEN list_contains(ids, in_id) THEN 'own' WHEN len(m) > 1 THEN 'ambiguous' WHEN len(m) = 1 THEN 'matched' ELSE 'new' END AS status
      FROM (SELECT rows.*, run.held, run.ids, list_distinct(list_transform(list_filter(run.held, lambda x: list_contains(rows.accs, x.a)), lambda x: x.t)) AS m FROM run JOIN rows ON rows.i = run.i + 1))))
SELECT ord, in_id, target, status FROM run WHERE i > 0"""
)
_BY_NAME = """WITH RECURSIVE q AS (SELECT *, p_partkey AS k, concat_ws(':', p_brand, p_size, p_type, p_partkey // 2000) AS f1, concat_ws(':', p_name, p_size, p_partkey // 2000) AS f2, p_partkey % 10 = 4 AS stub FROM part),
e AS (SELECT CASE WHEN stub THEN 'stub:' || (k + 1) ELSE 'r' || k END AS id, stub, CASE WHEN k % 3 = 0 THEN [f1, f2] ELSE [f2] END AS accounts, [p_brand, p_brand || p_type] AS names, CASE WHEN stub OR k % 7 = 0 THEN (k + 1)::VARCHAR END AS listed FROM q WHERE k % 2 = 0),
prev AS (SELECT listed, list(id ORDER BY id) AS prev FROM e WHERE listed IS NOT NULL GROUP BY 1),
rows AS (SELECT k AS ord, k::VARCHAR AS in_id, 'stub:' || k AS stub_id, CASE WHEN k % 5 <> 0 THEN f2 END AS account, [p_brand, p_type] AS names, k % 11 <> 0 AS active, coalesce(prev, []) AS prev, row_number() OVER (ORDER BY k) AS i FROM q LEFT JOIN prev ON listed = k::VARCHAR WHERE k % 2 = 1),
run AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::VARCHAR AS in_id, NULL::VARCHAR AS stub_id, []::VARCHAR[] AS targets, NULL::VARCHAR AS status, NULL::VARCHAR AS retired,
    (SELECT list({'o': id, 's': stub, 'a': account}) FROM (SELECT id, stub, unnest(accounts) AS account FROM e)) AS held, (SELECT list({'o': id, 'n': name}) FROM (SELECT id, unnest(names) AS name FROM e WHERE NOT stub)) AS named
  UNION ALL SELECT i, ord, in_id, stub_id, targets, status, CASE WHEN status = 'matched' AND list_contains(prev, stub_id) THEN stub_id END,
    CASE WHEN status = 'new' AND account IS NOT NULL THEN list_append(held, {'o': targets[1], 's': targets[1] = stub_id, 'a': account}) ELSE held END,
    list_concat(named, flatten(list_transform(targets, lambda t: list_transform(names, lambda x: {'o': t, 'n': x}))))
  FROM (SELECT *, CASE status WHEN 'matched' THEN c WHEN 'listed' THEN prev WHEN 'new' THEN [CASE WHEN account IS NOT NULL AND NOT seen THEN 'c:' || account ELSE stub_id END] ELSE [] END AS targets
    FROM (SELECT *, CASE WHEN len(c) = 1 AND len(list_filter(prev, lambda x: x <> c[1] AND x <> stub_id)) = 0 THEN 'matched' WHEN len(prev) > 0 THEN 'listed' WHEN active THEN 'new' ELSE 'inactive' END AS status
      FROM (SELECT *, list_filter(w, lambda o: len(list_filter(named, lambda z: z.o = o AND list_contains(names, z.n))) > 0) AS c
        FROM (SELECT rows.*, run.held, run.named, list_distinct(list_transform(list_filter(run.held, lambda x: x.a = rows.account AND NOT x.s), lambda x: x.o)) AS w,
          len(list_filter(run.held, lambda x: x.a = rows.account)) > 0 AS seen FROM run JOIN rows ON rows.i = run.i + 1)))))"""

ORACLES = {
    "d8_batch_entities": _BATCH
    + """p AS (SELECT ord AS in_id, min(id) AS lo, max(id) AS hi FROM n LEFT JOIN e USING (account) GROUP BY 1),
r AS (SELECT in_id, CASE WHEN lo = hi THEN lo END AS target, CASE WHEN lo IS NULL THEN 'new' WHEN lo < hi THEN 'ambiguous' ELSE 'matched' END AS status FROM p),
f AS (SELECT ord AS x, min(ord) OVER (PARTITION BY account) AS y FROM n WHERE ord IN (SELECT in_id FROM r WHERE status = 'new')),
l AS (SELECT x, y FROM f UNION SELECT y, x FROM f),
reach AS (SELECT x, x AS y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y)
SELECT r.*, CASE status WHEN 'new' THEN (SELECT min(y) FROM reach WHERE x = in_id) WHEN 'matched' THEN target END AS entity FROM r""",
    "d8_replayed": _REPLAY,
    "d8_replayed_by_name": _BY_NAME + " SELECT ord, in_id, unnest(CASE WHEN len(targets) = 0 THEN [NULL] ELSE targets END) AS target, status, retired FROM run WHERE i > 0",
    "d8_without_stubs": _BY_NAME + " SELECT id, stub FROM e WHERE id NOT IN (SELECT retired FROM run WHERE retired IS NOT NULL)",
}
QUERIES = {name: f for name, f in globals().items() if name in ORACLES}
