"""Publishing the batches of a stream to several subscribers."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Subscriber = Callable[[DataFrame, int], None]


def publish(events: DataFrame, subscribers: dict[str, Subscriber], checkpoint: str, **trigger) -> StreamingQuery:
    """Hands each micro-batch, with its number, to all subscribers in turn. One that fails is logged and doesn't keep the others from theirs, nor the stream from going on."""

    def deliver(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for name, subscriber in subscribers.items():
                try:
                    subscriber(held, number)
                except Exception:
                    logging.getLogger(__name__).exception("subscriber %s failed on batch %d", name, number)
        finally:
            held.unpersist()

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
