"""Hour addressing, feed validation, the ingest log, and writing partitions."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PERSON = T.StructType().add("id", T.LongType()).add("login", T.StringType())
_REPO = T.StructType().add("id", T.LongType()).add("name", T.StringType())
_COMMIT = T.StructType().add("sha", T.StringType()).add("message", T.StringType())
_ISSUE = T.StructType().add("number", T.IntegerType()).add("title", T.StringType())
_PAYLOAD = T.StructType().add("action", T.StringType()).add("commits", T.ArrayType(_COMMIT)).add("issue", _ISSUE).add("comment", T.StructType().add("body", T.StringType()))
#: The feed's fixed schema; fields that aren't named are ignored, missing ones are null.
BRONZE = T.StructType().add("id", T.StringType()).add("type", T.StringType()).add("actor", _PERSON).add("repo", _REPO).add("payload", _PAYLOAD).add("created_at", T.StringType())
MIN_LINES, MAX_BAD_RATIO = 1000, 0.001


def hour_key(at: datetime) -> str:
    """YYYY-MM-DD-H; the hour isn't padded."""
    at = at.astimezone(UTC) if at.tzinfo else at
    return f"{at:%Y-%m-%d}-{at.hour}"


def parse_hour(text: str) -> datetime:
    """From YYYY-MM-DD-H, an ISO time, or YYYY-MM-DD HH; UTC, on the hour."""
    if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})[- T](\d{1,2})", text.strip()):
        return datetime.fromisoformat(m[1]).replace(hour=int(m[2]), tzinfo=UTC)
    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return (at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)).replace(minute=0, second=0, microsecond=0)


def hour_range(first: datetime, last: datetime) -> list[datetime]:
    """All hours from first to last, both included."""
    if last < first:
        raise ValueError("the last hour is before the first")
    return [first + timedelta(hours=i) for i in range(int((last - first).total_seconds() // 3600) + 1)]


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fixed-schema parse; a line that isn't JSON keeps its text in _corrupt and nulls elsewhere."""
    schema = T.StructType([*BRONZE.fields, T.StructField("_corrupt", T.StringType())])
    return lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")


def read_hours(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Hourly JSON-line files, gzip or plain, with _corrupt for lines that can't be read."""
    schema = T.StructType([*BRONZE.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def profile(rows: DataFrame) -> DataFrame:
    """One row: lines, bad_lines, pushes, pushes_with_commits, era, first_event_at, last_event_at."""
    push = F.col("type") == "PushEvent"
    carries = push & (F.coalesce(F.size("payload.commits"), F.lit(0)) > 0)
    out = rows.agg(
        F.count("*").alias("lines"), F.count_if(F.col("_corrupt").isNotNull()).alias("bad_lines"), F.count_if(push).alias("pushes"), F.count_if(carries).alias("pushes_with_commits"),
        F.min("created_at").alias("first_event_at"), F.max("created_at").alias("last_event_at"),
    )
    return out.withColumn("era", F.when(F.col("pushes") == 0, "unknown").when(F.col("pushes_with_commits") > 0, "v2024").otherwise("v2026"))


def type_mix(rows: DataFrame) -> DataFrame:
    """type, events of the lines that can be read, most frequent first."""
    return good(rows).groupBy("type").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "type")


def gate(profiled: DataFrame, min_lines: int = MIN_LINES, max_bad: float = MAX_BAD_RATIO) -> dict:
    """The profile as a dict; raises if lines are too few or too many are bad."""
    row = profiled.first().asDict()
    if row["lines"] < min_lines:
        raise ValueError(f"only {row['lines']} lines; at least {min_lines} are expected")
    if row["bad_lines"] > max_bad * row["lines"]:
        raise ValueError(f"{row['bad_lines']} of {row['lines']} lines can't be read")
    return row


def upsert_log(records: DataFrame, key: str = "hour", at: str = "ingested_at") -> DataFrame:
    """One row for each key: of every field the latest value that was given. Absent fields don't erase earlier ones."""
    fields = [c for c in records.columns if c not in (key, at)]
    return records.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in fields], F.max(at).alias(at))


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that df has rows for; a partition without rows stays as it was."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load(rows: DataFrame, path: str, *by: str, drop: bool = False) -> dict:
    """Add the lines that can be read to a table, or replace it: inserted, failed, seconds and rows a second. Counted while written, in one pass."""
    seen, started = Observation(), time.monotonic()
    counted = rows.observe(seen, F.count("*").alias("lines"), F.count_if(F.col("_corrupt").isNotNull()).alias("failed"))
    good(counted).write.mode("overwrite" if drop else "append").partitionBy(*by).parquet(path)
    seconds, got = time.monotonic() - started, seen.get
    return {"inserted": got["lines"] - got["failed"], "failed": got["failed"], "seconds": seconds, "rate": (got["lines"] - got["failed"]) / seconds}


def write_tsv(df: DataFrame, path: str, *by: str) -> None:
    """Tab-separated without a header, a folder for each partition: the exchange format of text-table engines."""
    df.write.mode("overwrite").option("sep", "\t").partitionBy(*by).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", header).csv(path)


LOG = "hour string, status string, lines long, bad_lines long, pushes long, pushes_with_commits long, era string, first_event_at string, last_event_at string, error string, ingested_at timestamp"


def write_log(spark: SparkSession, record: dict, path: str) -> None:
    """Add one record; absent fields are null, and upsert_log lets them keep earlier values."""
    names = [x.split()[0] for x in LOG.split(", ")]
    row = {**record, "ingested_at": datetime.now(UTC)}
    spark.createDataFrame([tuple(row.get(n) for n in names)], LOG).coalesce(1).write.mode("append").parquet(path)


def write_export(df: DataFrame, path: str) -> None:
    """One tab-separated file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_known_bots(spark: SparkSession, path: str) -> DataFrame:
    """All text files in the folder are the list."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.trim("value").alias("login")).where("login != ''").distinct()


def write_known_bots(logins: DataFrame, path: str) -> None:
    logins.orderBy("login").coalesce(1).write.mode("overwrite").text(path)
