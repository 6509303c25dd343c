"""Structured Streaming jobs over the feed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import write_partitions
from ..operators.sketches import Dgim


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly_counts(events: DataFrame, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """hour, event_type, events by tumbling hours of event time. In append and update mode rows later than `late` are dropped by the watermark; complete mode keeps all hours."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", "1 hour"), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("hour"), "event_type", "events")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """First copy of each id among copies at most `late` apart."""
    return events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def dgim_counts(bits: DataFrame, key: str, width: int) -> DataFrame:
    """key, arrivals, estimate after each batch; bits has key, seq and bit, read in order of seq within a batch."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, buckets = state.get if state.exists else (0, "[]")
        sketch = Dgim(width, clock, json.loads(buckets))
        for bit in pd.concat(list(parts)).sort_values("seq")["bit"].tolist():
            sketch.update(int(bit))
        state.update((sketch.clock, json.dumps(sketch.state())))
        yield pd.DataFrame({key: [name[0]], "arrivals": [sketch.clock], "estimate": [sketch.count()]})

    return bits.groupBy(key).applyInPandasWithState(step, f"{key} string, arrivals long, estimate long", "clock long, buckets string", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop. Appends go to Parquet; complete results overwrite it."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def load_silver(stream: DataFrame, build, path: str, checkpoint: str) -> None:
    """Incremental load: each batch is built and overwrites the (dt, hr) partitions it touches, so that re-runs are idempotent."""
    query = stream.writeStream.foreachBatch(lambda df, _: write_partitions(build(df), path, "dt", "hr")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
