"""Layers in versions: data that is never changed, and a manifest for each version that is put in place by one rename.

A version is written to a folder of its own and named by a manifest beside it; readers take the last manifest and stay
with its folders, whatever is written meanwhile. Whatever ends a writer, the layer is as it was, or has the new version
whole; clean() takes away what it left. Gates are measured on the rows as they are written, in the same pass, and a
version whose gates fail gets no manifest. The rename must fail where its target exists, as on HDFS; of two writers that
began with one version the second has a Conflict, and begins anew."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merging import comparable

#: Seconds for which clean() leaves alone what no manifest names: a writer may be at work.
GRACE = 86_400


class ConflictError(RuntimeError):
    """Another writer has put a version in place since this one began."""


class GateError(ValueError):
    """Gates of a version that failed; the layer is as it was."""


@dataclass(frozen=True)
class Gate:
    """A measure of the rows that are written, and whether it holds, told from the new version's facts and from the one's
    before (empty for a first version). Facts are rows, bytes and all measures by name."""

    name: str
    holds: Callable[[dict, dict], bool]
    measures: dict[str, Column] = field(default_factory=dict)


def rows_within(least: int, most: int) -> Gate:
    return Gate(f"{least} to {most} rows", lambda now, _: least <= now["rows"] <= most)


def size_within(most: int, factor: float = 2.0, least: int = 16 << 20, by_row: bool = False) -> Gate:
    """At most so many bytes, and no more than factor times those of the version before, or `least` more. by_row: than
    factor times what as many rows had in the version before, for tables whose growth in rows has a gate of its own."""

    def holds(now: dict, was: dict) -> bool:
        grown = now["rows"] / max(was["rows"], 1) if by_row and was else 1
        return now["bytes"] <= most and (not was or now["bytes"] <= max(factor * grown * was["bytes"], was["bytes"] + least))

    return Gate("size", holds)


def rows_added(most: int) -> Gate:
    """No fewer rows than before, and at most so many more."""
    return Gate("rows added", lambda now, was: not was or 0 <= now["rows"] - was["rows"] <= most)


def share(name: str, condition: Column, least: float) -> Gate:
    """At least this share of the rows meets the condition."""
    return Gate(name, lambda now, _: now[name] >= least * now["rows"], {name: F.count_if(condition)})


def counters(column: str, values: tuple[str, ...]) -> Gate:
    """No gate, but counts of rows by these values of a column, as facts."""
    return Gate(f"counts of {column}", lambda now, _: True, {f"{column}={v}": F.count_if(F.col(column) == v) for v in values})


class Layer:
    """A table in versions under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join(parts))

    def _names(self, folder: str) -> dict[str, float]:
        """What a folder holds, with the seconds since each was changed."""
        at = self._at(self.path, folder)
        if not self._fs.exists(at):
            return {}
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in self._fs.listStatus(at)}

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """The facts of a version, or of the last one; {} if there is none."""
        versions = self.versions()
        if not versions:
            return {}
        stream = self._fs.open(self._at(self.path, "manifests", f"{versions[-1] if version is None else version:012}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one. What is written later doesn't change them."""
        facts = self.manifest(version)
        if not facts:
            raise FileNotFoundError(f"{self.path}: no version")
        return self.spark.read.schema(StructType.fromJson(facts["schema"])).parquet(*(f"{self.path}/data/{d}" for d in facts["data"]))

    def commit(self, rows: DataFrame, gates: tuple[Gate, ...] = (), append: bool = False, marks: dict[str, int] | None = None, base: int | None = None) -> int | None:
        """Puts rows in place as the next version and gives its number; None if they are what is there already.

        append: rows come under those of the version before. marks: names with the number of the batch that rows are; a
        number that isn't greater than the one before writes nothing, so that a batch can be run again. base: the version
        that rows were made from, if not the last one. All measures come from the one pass that writes.
        """
        before = self.manifest()
        version = before.get("version", 0)
        if base is not None and base != version:
            raise ConflictError(f"{self.path}: version {version}, not {base}")
        marks = marks or {}
        if marks and all(before.get("marks", {}).get(k, -1) >= v for k, v in marks.items()):
            return None
        data, seen = uuid.uuid4().hex, Observation()
        row = F.xxhash64(*(comparable(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema))
        measures = {k: m for g in gates for k, m in g.measures.items()}
        watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"), *(m.alias(k) for k, m in measures.items()))
        watched.write.parquet(f"{self.path}/data/{data}")
        facts = dict(seen.get)
        facts["bytes"] = self._fs.getContentSummary(self._at(self.path, "data", data)).getLength()
        folders = [data]
        if append and before:
            facts["rows"] += before["rows"]
            facts["bytes"] += before["bytes"]
            facts["content"] = str(int(facts["content"]) + int(before["content"]))
            folders = [*before["data"], data]
        failed = [g.name for g in gates if not g.holds(facts, before)]
        schema = json.loads(rows.schema.json())
        unchanged = before and all(facts[k] == before[k] for k in ("rows", "content")) and schema == before["schema"]
        if failed or unchanged:
            self._fs.delete(self._at(self.path, "data", data), True)
        if failed:
            raise GateError(f"{self.path}: " + ", ".join(failed))
        if unchanged:
            if not marks:
                return None
            folders, facts["bytes"] = before["data"], before["bytes"]
        facts |= {"version": version + 1, "data": folders, "schema": schema, "marks": before.get("marks", {}) | marks}
        self._put(facts)
        return version + 1

    def _put(self, facts: dict) -> None:
        """The one step that counts: a rename that fails if the version is there already."""
        draft = self._at(self.path, "manifests", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(facts, ensure_ascii=False).encode()))
        out.close()
        self._placed(draft, self._at(self.path, "manifests", f"{facts['version']:012}.json"))

    def _placed(self, draft, target) -> None:
        kind = getattr(self._hadoop, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf).rename(draft, target, never_over)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise ConflictError(f"{target} is there already") from e
            raise

    def clean(self, keep: int = 2, grace: float = GRACE) -> list[str]:
        """Takes away all but the last `keep` versions, and what writers left that never put theirs in place. Things that were
        changed within `grace` seconds stay, as do folders that a version that is kept has in common with older ones."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {d for v in kept for d in self.manifest(v)["data"]}
        gone = [f"manifests/{v:012}.json" for v in versions if v not in kept]
        gone += [f"manifests/{n}" for n, age in self._names("manifests").items() if n[0] == "." and not n.endswith(".crc") and age >= grace]
        gone += [f"data/{n}" for n, age in self._names("data").items() if n not in named and age >= grace]
        # manifests first: no reader finds one whose data are gone
        for name in gone:
            self._fs.delete(self._at(self.path, name), True)
        return gone
