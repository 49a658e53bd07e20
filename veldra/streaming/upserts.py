"""Streams of changes into a document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import DocStore


def apply_changes(store: DocStore, changes: DataFrame) -> None:
    """A micro-batch of changes (``_id`` STRING, ``text`` STRING, ``at`` orderable): the latest change of an _id counts.

    ``text`` is the whole new document as JSON; NULL takes the document out.
    """
    latest = changes.groupBy("_id").agg(F.max_by(F.struct("text"), "at").alias("last")).select("_id", "last.text")
    store.apply(latest.where("text is not null"), latest.where("text is null").select("_id"))


def follow(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the store at ``path`` up to date with a stream of changes; a batch that is run again changes nothing."""
    store = DocStore(spark, path, create=True)
    return stream.writeStream.foreachBatch(lambda batch, _: apply_changes(store, batch)).option("checkpointLocation", checkpoint).start()
