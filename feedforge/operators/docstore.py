"""Document-store operations on the nested feed: pipelines, finds, and rewrites for single-document changes.

Parquet has no indexes; a point query is a pushed-down filter, and an update or delete is a
rewrite of the rows of the partitions it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOT = r"(?i)\[bot\]$"


def event_share(docs: DataFrame) -> DataFrame:
    per = docs.groupBy(F.col("type").alias("event_type")).agg(F.count("*").alias("count"))
    whole = per.agg(F.sum("count").alias("_whole"))
    return per.crossJoin(F.broadcast(whole)).select("event_type", "count", F.bround(F.col("count") / F.col("_whole") * 100, 2).alias("percentage")).orderBy(F.desc("count"), "event_type")


def top_starred(docs: DataFrame, most: int = 10) -> DataFrame:
    """Most distinct users first, ties by repository."""
    per = docs.where("type = 'WatchEvent'").groupBy(F.col("repo.name").alias("repo")).agg(F.count("*").alias("total_stars"), F.count_distinct("actor.login").alias("unique_users"))
    return per.orderBy(F.desc("unique_users"), "repo").limit(most)


def commit_stats(docs: DataFrame, most: int = 10, slice_rows: int | None = None) -> DataFrame:
    """Repositories by commits, with the mean length of messages in code points (null message: 0). slice_rows looks at so many pushes only."""
    pushes = docs.where((F.col("type") == "PushEvent") & F.col("payload.commits").isNotNull() & (F.size("payload.commits") > 0))
    if slice_rows is not None:
        pushes = pushes.limit(slice_rows)
    each = pushes.select(F.col("repo.name").alias("repo"), F.explode("payload.commits").alias("c"))
    per = each.groupBy("repo").agg(F.count("*").alias("commits"), F.bround(F.avg(F.length(F.coalesce("c.message", F.lit("")))), 1).alias("avg_msg_len"))
    return per.orderBy(F.desc("commits"), "repo").limit(most)


def stats(docs: DataFrame) -> DataFrame:
    """One row: documents, and the span of their times."""
    return docs.agg(F.count("*").alias("documents"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def bot_human(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("actor.login").rlike(BOT), "BOT").otherwise("HUMAN")
    return docs.groupBy(F.col("type").alias("event_type"), kind.alias("actor_category")).agg(F.count("*").alias("count")).orderBy("event_type", F.desc("count"))


def issue_lifecycle(docs: DataFrame) -> DataFrame:
    """A missing action is a group of its own."""
    return docs.where("type = 'IssuesEvent'").groupBy(F.col("payload.action").alias("action")).agg(F.count("*").alias("total_actions")).orderBy(F.desc("total_actions"), "action")


def find(docs: DataFrame, where: Column, *fields: str) -> DataFrame:
    return docs.where(where).select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


def insert(docs: DataFrame, new: DataFrame) -> DataFrame:
    return docs.unionByName(new)


def update(docs: DataFrame, where: Column, path: str, value: Column, stamp: str | None = None) -> DataFrame:
    """Set one field, nested ones by dotted path, where the condition holds; stamp names a column that then gets the current time."""
    if stamp is not None:
        before = F.col(stamp) if stamp in docs.columns else F.lit(None).cast("timestamp")
        docs = docs.withColumn(stamp, F.when(where, F.current_timestamp()).otherwise(before))
    top, _, rest = path.partition(".")
    changed = F.col(top).withField(rest, value) if rest else value
    return docs.withColumn(top, F.when(where, changed).otherwise(F.col(top)))


def delete_one(docs: DataFrame, where: Column, *keys: str) -> DataFrame:
    """Without the matching document that comes first by the keys, which must tell documents apart."""
    first = docs.where(where).agg(F.min(F.struct(*keys)).alias("_gone"))
    return docs.join(F.broadcast(first), where & (F.struct(*keys) == F.col("_gone")), "left_anti")


def distinct_logins(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("actor.login").rlike(BOT)).select(F.col("actor.login").alias("login")).distinct().orderBy("login")
