"""Documents that keep arriving: each micro-batch is ingested whole, in one flip of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def ingest_stream(engine: Engine, corpus: str, documents: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that creates or replaces (document_id, text, seq) as they come.

    Within a batch the largest seq of an id stands. A batch that is run again after a failure replaces its
    documents with themselves, so each takes effect once.
    """

    def store(batch: DataFrame, _: int) -> None:
        last = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("seq")))
        newest = batch.withColumn("_last", last).where("_last = 1").select("document_id", "text")
        if newest.limit(1).count():
            engine.ingest(corpus, newest)

    writer = documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
