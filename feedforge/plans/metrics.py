"""What follows the daily run: sketches over a replay, the recommender and the graph, each exported as small tab-separated tables.

A step takes (spark, lake), reads silver events and overwrites its exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, ingest, recommend, sketches
from ..sources.staging import staged

EVERY, WIDTH = 10_000, 10_000


def sketch_frames(events: DataFrame, every: int = EVERY, width: int = WIDTH, most: int | None = None) -> dict[str, DataFrame]:
    """Bloom filter, distinct counts, ones in the last arrivals, and sampling over one replay of the events, of the first `most` if given."""
    ev = staged(sketches.replay(events, most).select("event_id", "created_at", "dt", "event_type", "actor_login", F.concat("actor_login", F.lit("@"), "repo").alias("item")), "replay")
    trained = F.pmod(F.crc32(F.col("item").cast("binary")), F.lit(2)) == 0
    items = staged(ev.select("item").where("item IS NOT NULL").distinct().select("item", trained.alias("trained")), "replay-items")
    users = sketches.sampled(ev, "actor_login").agg(F.count("*").alias("events_kept"), F.count_distinct("actor_login").alias("users_kept"))
    return {
        "bloom_filter": sketches.bloom_fpr(items.where("trained"), items.where("NOT trained"), "item"),
        "distinct_counts": sketches.fm_checkpoints(ev, "item", every),
        "recent_stars": sketches.dgim_checkpoints(ev, F.col("event_type") == "WatchEvent", width),
        "user_sample": users,
    }


def _export(lake: str, frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        ingest.write_export(df, f"{lake}/exports/{name}")


def _events(spark: SparkSession, lake: str) -> DataFrame:
    return spark.read.parquet(f"{lake}/silver/events")


def sketch_step(spark: SparkSession, lake: str) -> None:
    _export(lake, sketch_frames(_events(spark, lake)))


def recommender_step(spark: SparkSession, lake: str) -> None:
    pairs = recommend.interactions(_events(spark, lake).where("event_type = 'WatchEvent' AND NOT is_bot"))
    _export(lake, {"recommender": recommend.hit_rates(staged(recommend.holdout(pairs), "split"))})


def graph_step(spark: SparkSession, lake: str) -> None:
    edge = staged(graph.edges(_events(spark, lake)), "edges")
    parts = graph.components(edge).groupBy("component").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "component").limit(5)
    _export(lake, {"network_edges": graph.plot_edges(edge), "network_nodes": graph.plot_nodes(edge), "network_parts": parts})


STEPS = (sketch_step, recommender_step, graph_step)
