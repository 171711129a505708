"""Payload files as a stream: an extension, so that new and changed scenes are analysed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.changes import content_hash
from tesserae.plans.model import SceneTables
from tesserae.sources import payload
from tesserae.sources.cache import INDEX


def payload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(scene_id, payload, source_hash) of every JSON file that is put into ``folder``; the cache's own index is not a scene."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    named = files.select(F.col("_metadata.file_path").alias("scene_id"), F.regexp_replace("value", "^﻿", "").alias("payload"))
    return named.where(~F.col("scene_id").endswith(f"/{INDEX}")).withColumn("source_hash", content_hash(F.col("payload")))


def analyze_arrivals(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[SceneTables, int], None]) -> StreamingQuery:
    """Each batch of new files through the normalizer into ``handle``; stops when there are no more."""

    def each(batch: DataFrame, number: int) -> None:
        handle(payload.normalize(batch.select("scene_id", "payload"), strict=False), number)

    stream = payload_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
