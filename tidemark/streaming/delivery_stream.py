"""Deliveries as a stream: each micro-batch goes through the delivery index, and into the archive only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.delivery import DeliveryIndex


def archive_stream(stream: DataFrame, index: DeliveryIndex, archive: str, checkpoint: str, merge_every: int = 16) -> StreamingQuery:
    """Appends each batch to archive (one folder a batch) and the rows that became surplus, of this batch or of earlier ones, to archive-surplus.

    A batch that is repeated after a failure overwrites its own folders and its own run of the index, so every identifier is left once.
    The current rows are those of archive without those of archive-surplus.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        # The archive comes first: an index that knew rows which the archive lacks would lose them.
        batch.write.mode("overwrite").parquet(f"{archive}/batch={epoch}")
        index.ingest(batch.sparkSession.read.schema(batch.schema).parquet(f"{archive}/batch={epoch}"), epoch).write.mode("overwrite").parquet(f"{archive}-surplus/batch={epoch}")
        if epoch and epoch % merge_every == 0:
            index.merge(epoch - 1)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark, archive: str, row_col: str = "row_id") -> DataFrame:
    """The rows of the archive that are not surplus."""
    return spark.read.parquet(archive).join(spark.read.parquet(f"{archive}-surplus").select(row_col).distinct(), row_col, "left_anti")
