"""Layers in versions: readers during writes, a crash at each step, conflicts, gates and streams into them."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from rollbook.operators import overlay
from rollbook.plans import streams as plans
from rollbook.sources import versions
from rollbook.streaming import cooldown, queue


@pytest.fixture
def layer(spark, tmp_path):
    return versions.Layer(spark, f"{tmp_path}/layer")


def _rows(spark, name, n=3):
    return spark.range(n).select("id", F.lit(name).alias("name"))


def _names(df):
    return sorted({r["name"] for r in df.collect()})


def test_a_reader_during_a_write_has_one_version(spark, layer):
    assert layer.versions() == [] and layer.manifest() == {}
    with pytest.raises(FileNotFoundError):
        layer.read()
    assert layer.commit(_rows(spark, "a")) == 1
    reader = layer.read()
    assert layer.commit(_rows(spark, "b", 5)) == 2
    assert (_names(reader), reader.count(), _names(layer.read()), layer.read(1).count()) == (["a"], 3, ["b"], 3)


def test_what_is_there_already_makes_no_version(spark, layer):
    layer.commit(_rows(spark, "a", 9))
    assert layer.commit(_rows(spark, "a", 9).repartition(4)) is None
    assert layer.versions() == [1] and len(os.listdir(f"{layer.path}/data")) == 1
    assert layer.commit(_rows(spark, "a", 9).withColumn("more", F.lit(1))) == 2
    assert layer.commit(_rows(spark, "a", 0)) == 3 and layer.read().count() == 0
    with_map = _rows(spark, "a").withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    assert layer.commit(with_map) == 4 and layer.commit(with_map) is None


class _CrashError(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "size", "create", "draft", "rename"])
def test_a_crash_at_each_step_leaves_a_readable_layer(spark, layer, monkeypatch, step):
    layer.commit(_rows(spark, "a"))

    def crash(*_):
        raise _CrashError

    if step == "write":
        broken = _rows(spark, "b").withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
        with pytest.raises(Exception, match="lost"):
            layer.commit(broken)
    elif step == "size":
        with pytest.raises(_CrashError):
            layer.commit(_rows(spark, "b"), (versions.Gate("crash", crash),))
    elif step == "create":
        monkeypatch.setattr(layer, "_put", crash)
    elif step == "draft":
        monkeypatch.setattr(layer, "_placed", crash)
    else:
        real = layer._placed
        monkeypatch.setattr(layer, "_placed", lambda *a: crash(real(*a)))
    if step in ("create", "draft", "rename"):
        with pytest.raises(_CrashError):
            layer.commit(_rows(spark, "b"))
    fresh = versions.Layer(spark, layer.path)
    # after the rename the version is whole, before it the old one is
    assert _names(fresh.read()) == (["b"] if step == "rename" else ["a"])
    assert fresh.commit(_rows(spark, "c")) == (3 if step == "rename" else 2)
    assert _names(fresh.read()) == ["c"]
    fresh.clean(keep=1, grace=0)
    assert len(os.listdir(f"{layer.path}/data")) == 1 and fresh.versions() == [3 if step == "rename" else 2] and _names(fresh.read()) == ["c"]


def test_of_two_writers_one_is_told(spark, layer, monkeypatch):
    layer.commit(_rows(spark, "a"))
    base = layer.manifest()["version"]
    layer.commit(_rows(spark, "b"))
    with pytest.raises(versions.ConflictError):
        layer.commit(_rows(spark, "c"), base=base)
    # another one comes between this one's look and its rename
    real = layer._put
    monkeypatch.setattr(layer, "_put", lambda facts: (versions.Layer(spark, layer.path).commit(_rows(spark, "d")), real(facts)))
    with pytest.raises(versions.ConflictError):
        layer.commit(_rows(spark, "e"))
    assert _names(layer.read()) == ["d"]


def test_clean_leaves_writers_and_shared_folders_alone(spark, layer):
    layer.commit(_rows(spark, "a"))
    layer.commit(_rows(spark, "b"), append=True)
    os.makedirs(f"{layer.path}/data/of-a-writer")
    assert layer.clean(keep=1) == ["manifests/000000000001.json"]
    assert _names(layer.read()) == ["a", "b"] and os.path.exists(f"{layer.path}/data/of-a-writer")
    assert "data/of-a-writer" in layer.clean(keep=1, grace=0) and _names(layer.read()) == ["a", "b"]


def test_gates_see_what_is_written(spark, layer):
    gates = (versions.rows_within(1, 10), versions.share("even", F.col("id") % 2 == 0, 0.5), versions.rows_added(4), versions.counters("name", ("a", "b")))
    layer.commit(_rows(spark, "a"), gates)
    facts = layer.manifest()
    assert (facts["rows"], facts["even"], facts["name=a"], facts["name=b"]) == (3, 2, 3, 0)
    assert facts["bytes"] == sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{layer.path}/data/{facts['data'][0]}") for f in files if not f.endswith(".crc"))
    for rows in (_rows(spark, "b", 11), _rows(spark, "b", 2), _rows(spark, "b", 8), _rows(spark, "b").where("id = 1")):
        with pytest.raises(versions.GateError):
            layer.commit(rows, gates)
    assert _names(layer.read()) == ["a"] and len(os.listdir(f"{layer.path}/data")) == 1


def test_bytes_have_a_cap(spark, layer):
    size = lambda n: spark.range(n).select(F.expr("uuid()").alias("name"))
    layer.commit(size(100))
    bytes_ = layer.manifest()["bytes"]
    with pytest.raises(versions.GateError, match="size"):
        layer.commit(size(1000), (versions.size_within(10**9, factor=2.0, least=100),))
    with pytest.raises(versions.GateError, match="size"):
        layer.commit(size(1000), (versions.size_within(bytes_),))
    assert layer.commit(size(1000), (versions.size_within(10**9, factor=2.0, least=1 << 20),)) == 2


def test_gates_take_no_pass_of_their_own(spark, layer):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    layer.commit(spark.range(50).select(counted("id").alias("id")), (versions.rows_within(1, 99), versions.share("small", F.col("id") < 40, 0.5)))
    assert seen.value == 50


QUEUE = "url string, ord long, kind string, author string"


def _files(spark, path, *parts):
    for rows in parts:
        spark.createDataFrame(rows, QUEUE).coalesce(1).write.mode("append").parquet(path)


def _ran(spark, source, layer, checkpoint, gates=()):
    stream = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", 1).parquet(source)
    queue.upserted(stream, layer, "leads", checkpoint, "url", "ord", "author", gates).awaitTermination()


def test_a_stream_into_the_queue_is_the_batch(spark, layer, tmp_path, monkeypatch):
    monkeypatch.setattr(queue, "MOST_PARTS", 2)
    rows = [("u", 5, "a", None), ("v", 1, "b", "x"), ("u", 9, "c", "late"), ("u", 7, "d", "early"), ("v", 0, "e", None), ("w", 3, "f", None), ("w", 3, "f", None), (None, 4, "g", "n")]
    _files(spark, f"{tmp_path}/in", rows[:3], rows[3:5], rows[5:])
    _ran(spark, f"{tmp_path}/in", layer, f"{tmp_path}/check")
    want = sorted(map(str, overlay.first_wins(spark.createDataFrame(rows, QUEUE), "url", "ord", "author").collect()))
    now = lambda: sorted(map(str, queue.queued(layer, "url", "ord", "author").collect()))
    assert now() == want and len(layer.manifest()["data"]) <= 2
    before = layer.versions()
    _ran(spark, f"{tmp_path}/in", layer, f"{tmp_path}/another")  # all batches once more
    assert now() == want and layer.versions() == before
    _files(spark, f"{tmp_path}/in", [("new", 0, "h", None)])
    _ran(spark, f"{tmp_path}/in", layer, f"{tmp_path}/check")
    assert "new" in str(now()) and len(now()) == len(want) + 1


def test_a_gate_stops_the_stream(spark, layer, tmp_path):
    _files(spark, f"{tmp_path}/in", [("u", 5, "a", None)])
    _ran(spark, f"{tmp_path}/in", layer, f"{tmp_path}/check")
    _files(spark, f"{tmp_path}/in", [(f"u{i}", i, "a", None) for i in range(9)])
    with pytest.raises(Exception, match="rows added"):
        _ran(spark, f"{tmp_path}/in", layer, f"{tmp_path}/check", (versions.rows_added(3),))
    assert queue.queued(layer, "url", "ord", "author").count() == 1
    _ran(spark, f"{tmp_path}/in", layer, f"{tmp_path}/check")
    assert queue.queued(layer, "url", "ord", "author").count() == 10


DAY = datetime.datetime(2026, 9, 9, 7)


def _at(hours, seconds=0):
    return DAY + datetime.timedelta(hours=hours, seconds=seconds)


@pytest.mark.parametrize(
    ("code", "said", "seconds"),
    [(429, "7200", 7200), (429, None, 3600), (503, None, 86_400), (429, "0", 1), (429, "soon", 3600), (429, "-5", 3600), (429, "", 3600), (503, "Wed, 09 Sep 2026 09:00:00 GMT", 7200), (503, "Wed, 09 Sep 2020 09:00:00 GMT", 86_400), (429, "99999999999999999999", 3600)],
)
def test_when_a_pause_ends(spark, code, said, seconds):
    row = spark.createDataFrame([(DAY, code, said)], "at timestamp, code int, said string")
    assert row.select(cooldown.pause_until(F.unix_micros("at"), F.col("code"), F.col("said")) - F.unix_micros("at")).first()[0] == seconds * 1_000_000


def test_hosts_that_pause(spark, tmp_path, monkeypatch):
    from rollbook.functions import urls

    kind = "lead long, url string, ts timestamp, code int, said string"
    batches = [
        [(1, "https://youtube.com/@a", _at(-1), None, None), (2, "https://www.youtube.com/@a", _at(0), 429, "7200"), (3, "https://m.youtube.com/@b", _at(1), None, None), (4, "https://twitch.tv/c", _at(1), None, None)],
        [(5, "https://youtu.be/abc", _at(1, 60), None, None), (6, "https://twitch.tv/c", _at(1, 90), 500, None)],
        [(7, "https://twitch.tv/c", _at(1, 95), None, None), (8, "https://youtube.com/@z", _at(2, 1), None, None)],
        [(9, "https://else.example/", _at(40), None, None)],
    ]

    def prepared(df):
        until = F.when(F.col("code").isNotNull(), cooldown.pause_until(F.unix_micros("ts"), F.col("code"), F.col("said")))
        return df.select("lead", urls.host_key("url").alias("host"), "ts", until.alias("until"))

    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:  # each by a query of its own that goes on from the checkpoint
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = prepared(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
            query = cooldown.paced(stream, "ts").writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = sorted((r["lead"], r["state"], r["at"]) for r in spark.read.schema(cooldown.OUT).parquet(f"{tmp_path}/out").collect())
    micros = lambda t: int(t.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
    want = [(1, "passed", _at(-1)), (3, "deferred", _at(1)), (3, "released", _at(2)), (4, "passed", _at(1)), (5, "deferred", _at(1, 60)), (5, "released", _at(2)), (7, "deferred", _at(1, 95)), (7, "released", _at(25, 90)), (8, "passed", _at(2, 1)), (9, "passed", _at(40))]
    assert got == [(i, s, micros(t)) for i, s, t in want]
    twin = cooldown.paced_batch(prepared(spark.createDataFrame([r for b in batches for r in b], kind)), "ts")
    released = {i: micros(t) for i, s, t in want if s == "released"}
    assert {r["lead"]: (r["deferred"], r["released_at"]) for r in twin.collect()} == {i: (i in released, released.get(i)) for i in (1, 3, 4, 5, 7, 8, 9)}


def test_bytes_by_row_hold_for_tables_that_double(spark, tmp_path):
    made = lambda n, hashes: spark.range(n).selectExpr(f"array_join(transform(sequence(1, {hashes}), i -> sha2(cast(id * 100 + i AS string), 256)), '') AS x")
    layer = versions.Layer(spark, f"{tmp_path}/layer")
    gates = (versions.size_within(10**9, least=0, by_row=True),)
    assert layer.commit(made(1000, 1), gates) == 1
    with pytest.raises(versions.GateError, match="size"):
        layer.commit(made(2500, 1), (versions.size_within(10**9, least=0),))
    assert layer.commit(made(2500, 1), gates) == 2
    with pytest.raises(versions.GateError, match="size"):
        layer.commit(made(2600, 7), gates)
    assert layer.commit(made(0, 1)) == 3 and layer.commit(made(10, 1), (versions.size_within(10**9, by_row=True),)) == 4


def test_years_of_orders_pass_the_gate_of_size_whatever_they_come_to(spark, tmp_path, monkeypatch):
    ours = versions.size_within
    monkeypatch.setattr(versions, "size_within", lambda most, **more: ours(most, least=0, **more))
    rows = spark.range(3000).selectExpr("id AS o_orderkey", "sha2(cast(id AS string), 256) AS x", "IF(id % 3 = 0, timestamp'1995-02-03', timestamp'1996-02-03') AS o_orderdate", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, plans.i_observed_gates(spark, str(tmp_path)).collect()))
    assert got == [(1995, 1, 1000, 1000, 1000, 0, 0, True, "rows added", 3000), (1996, 2, 3000, 3000, 3000, 0, 0, True, "rows added", 3000)]
