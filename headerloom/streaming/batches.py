"""The analysis over a stream of messages, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from headerloom.config import EngineConfig
from headerloom.plans.pipeline import analyze, reports


def stream_reports(messages: DataFrame, out: str, checkpoint: str, config: EngineConfig | None = None, tables: dict[str, DataFrame] | None = None) -> StreamingQuery:
    """Reports of every micro-batch as Parquet under ``out``; a batch that is repeated after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        reports(analyze(batch, config, tables)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
