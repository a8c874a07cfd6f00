"""Streams into collections: each micro-batch is one mutation batch, and its epoch makes a repeat harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..collection import Collection


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True):
    """Start a query that upserts every micro-batch of ``stream`` (id, embedding, metadata?, document?).

    The epoch is committed with its batch, in the collection's log if it has one and in its snapshots: a collection that
    was recovered or loaded skips an epoch that it already holds. ``checkpoint`` names the stream's source of epochs.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        if epoch > collection.epochs.get(checkpoint, -1):
            collection.apply("upsert", collection.frame_batch("upsert", batch), note={"source": checkpoint, "epoch": epoch})

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
