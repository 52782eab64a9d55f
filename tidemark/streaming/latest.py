"""Latest-wins dedup of a stream of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_stream(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Running latest time of each key; for update or complete output."""
    return stream.groupBy(*keys).agg(F.max(ts).alias(ts))


def upsert_latest(stream: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every batch's latest rows, merged with the last version, as the next version under
    `path`; a batch that is run again writes its version again, so each counts once."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = batch.select(*keys, ts)
        if epoch:
            now = now.unionByName(spark.read.parquet(f"{path}/version={epoch - 1}"))
        now.groupBy(*keys).agg(F.max(ts).alias(ts)).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
