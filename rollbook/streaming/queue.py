"""The queue of leads as a layer in versions that a stream adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import Gate, Layer

#: Folders of a version from which on they are made one.
MOST_PARTS = 16


def merged(rows: DataFrame, key: str, order: str, fill: str) -> DataFrame:
    """One row for each key: the earliest by order; a later one may only give what is missing in `fill`, which comes with its
    place (filled_at). rows may be of that form already, so that parts are merged in any order."""
    at = F.col("filled_at") if "filled_at" in rows.columns else F.when(F.col(fill).isNotNull(), F.col(order))
    rest = [c for c in rows.columns if c not in (key, fill, "filled_at")]
    out = rows.withColumn("filled_at", at).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("first"), F.min_by(fill, "filled_at").alias(fill), F.min("filled_at").alias("filled_at"))
    return out.select(key, "first.*", fill, "filled_at")


def queued(layer: Layer, key: str, order: str, fill: str) -> DataFrame:
    """The queue as it is now."""
    return merged(layer.read(), key, order, fill).drop("filled_at")


def upserted(leads: DataFrame, layer: Layer, name: str, checkpoint: str, key: str, order: str, fill: str, gates: tuple[Gate, ...] = ()) -> StreamingQuery:
    """A query that merges the stream into the layer, for all that is there now. A batch is merged in itself and comes as a
    folder of its own under the others; readers merge folders, and when there are more than MOST_PARTS they are made one, so
    that a batch costs what it has and not what the queue has. The manifest has the batch's number under `name`: a batch that
    is run again, after a failure or a lost checkpoint, writes nothing. A gate that fails stops the stream, and the layer is
    as it was."""

    def put(batch: DataFrame, number: int) -> None:
        layer.commit(merged(batch, key, order, fill), gates, append=True, marks={name: number})
        facts = layer.manifest()
        if len(facts.get("data", [])) > MOST_PARTS:
            layer.commit(merged(layer.read(facts["version"]), key, order, fill), base=facts["version"])

    return leads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
