"""An extension: songs that arrive as a stream of files, kept in a versioned table. One commit per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stanzaflow.operators.changes import VersionedTable


def upsert_batches(stream: DataFrame, table: VersionedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Replace rows of ``table`` by those of a stream with the same key, micro-batch by micro-batch.

    The number of the batch is part of the commit, so a batch that is delivered again after a failure changes nothing.
    Of several rows of a key in a batch any one is kept if they are equal. Rows without a key are left out.
    """

    def take(batch: DataFrame, number: int) -> None:
        done = table.properties().get("batch", -1)
        if number <= done:
            return
        rows = batch.where(f"{table.key} is not null").dropDuplicates([table.key])
        table.commit(added=rows, replace=True, properties={"batch": number})

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)
