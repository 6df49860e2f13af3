"""Hosts that asked for a pause: leads to them wait, and are released when the pause is over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a pause by status, if the host doesn't say how long.
LIMITED, PAUSES, OTHER_PAUSE = 429, {429: 3600}, 86_400

OUT = "lead long, host string, state string, at long"
_out = Row("lead", "host", "state", "at")


def pause_until(at: Column, code: Column, retry_after: Column) -> Column:
    """Microseconds at which a pause ends that began at `at`: after the seconds, or at the date, that the host gave, if that is
    later than now; else an hour after status 429 and a day after others."""
    said = F.trim(retry_after.cast("string"))
    second = F.lit(1_000_000).cast("long")
    digits = said.rlike(r"^[0-9]{1,9}$")
    date = F.unix_micros(F.try_to_timestamp(F.regexp_replace(said, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    given = F.when(digits, at + F.greatest(F.lit(1), F.when(digits, said).cast("long")) * second).otherwise(F.when(date > at, date))
    usual = F.when(code == LIMITED, PAUSES[LIMITED]).otherwise(OTHER_PAUSE)
    return F.coalesce(given, at + usual * second)


class _Host(StatefulProcessor):
    """Of a host: the time until which it is left alone, and the leads that wait for it. Both are read and written once for
    all of a host's rows of a batch, as each access goes to another process and back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")
        self.waiting = handle.getListState("waiting", "lead long")

    def _end(self) -> int | None:
        return self.until.get()[0] if self.until.exists() else None

    def _released(self, host: str, end: int) -> Iterator[Row]:
        """The leads that waited before this batch; the pause is over."""
        for (lead,) in self.waiting.get():
            yield _out(lead, host, "released", end)
        self.waiting.clear()
        self.until.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (host,) = key
        end = before = self._end()
        kept, waiting = before is not None, []  # whether the state still has what it had, and who else waits
        for at, no_refusal, lead, until in sorted((r["at"], r["until"] is None, r["lead"], r["until"]) for r in rows):
            if end is not None and at >= end:
                if kept:
                    yield from self._released(host, end)
                for x in waiting:
                    yield _out(x, host, "released", end)
                end, kept, waiting = None, False, []
            if not no_refusal:
                end = until if end is None else max(end, until)
            elif end is not None and at < end:
                waiting.append(lead)
                yield _out(lead, host, "deferred", at)
            else:
                yield _out(lead, host, "passed", at)
        if waiting:
            self.waiting.appendList([(x,) for x in waiting])
        if end != before:
            self.until.clear() if end is None else self.until.update((end,))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if end is not None:
                self.handle.registerTimer(-(-end // 1000))
        elif end is not None and not kept:
            self.until.update((end,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = self._end()
        if end is not None and end <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            yield from self._released(key[0], end)

    def close(self) -> None:
        pass


def paced(rows: DataFrame, time: str, delay: str = "0 seconds") -> DataFrame:
    """A stream of (lead, host, state, at): of each lead whether it passed or is deferred, and, once its host's pause is over,
    that it is released and when (microseconds).

    rows: a stream of lead (an id), host (one key for all its aliases), `time` and until: null for a lead, the end of the
    pause (pause_until) for a host's refusal, which then counts for leads from its own time on; of a moment, refusals come
    first. Pauses that overlap are one; its end comes with the next row of the host, or by a timer when the watermark has
    passed it. A host's rows of one batch are taken in the order of their time, and so must batches be, but for `delay`;
    what is later is dropped by the watermark. The state of a host without a pause is nothing, so that state doesn't grow
    with the hosts that were ever seen. A batch should be of a size (maxFilesPerTrigger) that a host's rows of it fit in a
    worker. Needs the RocksDB state store.
    """
    at = rows.withWatermark(time, delay).select("lead", "host", F.unix_micros(F.col(time)).alias("at"), "until", time)
    out = T.StructType([T.StructField("lead", T.LongType()), T.StructField("host", T.StringType()), T.StructField("state", T.StringType()), T.StructField("at", T.LongType())])
    return at.groupBy("host").transformWithState(statefulProcessor=_Host(), outputStructType=out, outputMode="Append", timeMode="EventTime")


def paced_batch(rows: DataFrame, time: str) -> DataFrame:
    """What paced() gives in the end, from a table: lead, host, deferred, and released_at (microseconds; null where the host's
    pause is longer than the rows)."""
    from pyspark.sql.window import Window

    r = rows.select("lead", "host", F.unix_micros(F.col(time)).alias("at"), "until")
    order = Window.partitionBy("host").orderBy("at", F.col("until").isNull(), "lead")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("held", F.coalesce(F.col("at") < before, F.lit(False)))
    # a row that no pause holds begins a stretch of its host
    r = r.withColumn("stretch", F.count_if(~F.col("held")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = r.groupBy("host", "stretch").agg(F.max("until").alias("end"))
    last = rows.agg(F.max(F.unix_micros(F.col(time))).alias("last"))
    out = r.join(end, ["host", "stretch"]).where("until IS NULL").join(F.broadcast(last), F.lit(True))
    return out.select("lead", "host", F.col("held").alias("deferred"), F.when(F.col("held") & (F.col("end") <= F.col("last")), F.col("end")).alias("released_at"))
