"""Layout and inspection of stored tables: what takes the place of secondary indexes and of plan statistics."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def register_partitions(spark: SparkSession, table: str) -> None:
    """Make all partition folders of a catalog table known."""
    spark.catalog.recoverPartitions(table)


def write_clustered(df: DataFrame, path: str, *keys: str, bloom: str | None = None) -> None:
    """Parquet whose row groups hold narrow ranges of the keys, so that point and range filters skip most of
    them; with a Bloom filter on one column for equality."""
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    if bloom is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    writer.parquet(path)


def plan_of(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def plan_summary(df: DataFrame) -> dict:
    """Pushed filters, columns read, and numbers of exchanges and joins of the plan."""
    plan = plan_of(df)
    tree = plan.split("\n\n\n")[0]
    return {
        "pushed_filters": re.findall(r"PushedFilters: \[(.*?)\]\n", plan),
        "read_schema": re.findall(r"ReadSchema: struct<(.*?)>\n", plan),
        "exchanges": len(re.findall(r"(?m)^[^(]*\bExchange\b", tree)),
        "broadcasts": tree.count("BroadcastExchange"),
        "joins": len(re.findall(r"\w+Join\b", tree)),
    }


def keys_of(spark: SparkSession, table: str) -> dict[str, str]:
    """Columns that a catalog table is laid out by: partition or bucket."""
    return {c.name: "partition" if c.isPartition else "bucket" for c in spark.catalog.listColumns(table) if c.isPartition or c.isBucket}


def executed(df: DataFrame) -> dict:
    """Run a query without exchanges (a find) and say what it took: rows examined by its scans, rows returned, seconds, and its plan's summary."""
    started, run = time.monotonic(), df._jdf.queryExecution()
    returned, leaves = run.toRdd().count(), run.executedPlan().collectLeaves()
    seconds, read = time.monotonic() - started, 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        read += metric.get().value() if metric.isDefined() else 0
    return {**plan_summary(df), "rows_examined": read, "rows_returned": returned, "seconds": seconds}


def melt(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each value column, as double."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "variable", "value")
