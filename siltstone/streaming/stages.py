"""Stateless stages over streams: the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import stages


def gated(stream: DataFrame, scripts: dict[str, str]) -> DataFrame:
    """Normalised documents with the first reason of gate and quality rules."""
    d = stages.langid(stages.normalize(stream), scripts).scored.withColumnRenamed("reason", "gate")
    return stages.quality(d).scored


def run(stream: DataFrame, scripts: dict[str, str], out: str, checkpoint: str) -> StreamingQuery:
    """Writes kept documents as they come; what is there now, then ends."""
    kept = gated(stream, scripts).where("gate IS NULL AND reason IS NULL")
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
