"""The daily and hourly runs as ordered steps over DataFrames; each step overwrites what it owns, so runs can be repeated."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import botscore, gold, ingest, silver
from ..sources import files
from . import metrics


def ingest_hour(spark: SparkSession, path: str, lake: str, at: datetime, min_lines: int = ingest.MIN_LINES, max_bad: float = ingest.MAX_BAD_RATIO, landing: str | None = None) -> dict:
    """Validate one hourly file, put it in its (dt, hr) partition and log it; the log's record. A file that fails the gate leaves a failure record and no partition.
    landing names a folder to which a good file is copied whole."""
    hour = ingest.hour_key(at)
    rows = ingest.read_hours(spark, path)
    try:
        profile = ingest.gate(ingest.profile(rows), min_lines, max_bad)
    except ValueError as e:
        record = {"hour": hour, "status": "failed", "error": str(e)[:500]}
        ingest.write_log(spark, record, f"{lake}/ingest_log")
        return record
    if landing is not None:
        files.put(spark, path, f"{landing}/{at:%Y/%m/%d}/{path.rsplit('/', 1)[-1]}")
    ingest.write_partitions(ingest.good(rows).withColumn("dt", F.lit(f"{at:%Y-%m-%d}")).withColumn("hr", F.lit(at.hour)), f"{lake}/bronze", "dt", "hr")
    record = {"hour": hour, "status": "ok", **profile}
    ingest.write_log(spark, record, f"{lake}/ingest_log")
    return record


def build_silver(spark: SparkSession, lake: str, where: str = "true") -> None:
    """All silver tables of the partitions that `where` names, from one base that is computed once."""
    raw = spark.read.parquet(f"{lake}/bronze").where(where)
    known = ingest.read_known_bots(spark, f"{lake}/known_bots")
    base = silver.base(raw, known).persist()
    try:
        for name, make in (("events", silver.events), ("stars", silver.stars), ("issues", silver.issues), ("comments", silver.comments)):
            ingest.write_partitions(make(base), f"{lake}/silver/{name}", "dt", "hr")
    finally:
        base.unpersist()
    ingest.write_partitions(silver.commits(raw), f"{lake}/silver/commits", "dt", "hr")


def gold_tables(events: DataFrame, stars: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    return {
        "hourly_activity": gold.hourly_activity(events), "event_mix": gold.event_mix(events), "bot_share": gold.bot_share(events), "top_starred": gold.top_starred(stars),
        "issue_activity": gold.issue_activity(issues), "top_contributors": gold.top_contributors(events), "repo_collaboration": gold.repo_collaboration(events), "trending_daily": gold.trending(events, stars),
    }


def score_bots(spark: SparkSession, lake: str, limits: botscore.Limits = botscore.Limits(), where: str = "true") -> None:
    """Score accounts (of the partitions that `where` names) and add the flagged ones to the reference list, in a folder of their own; the next full silver build uses them.
    Scores, their evaluation and the farmed repositories are stored and exported."""
    cell = botscore.cells(spark.read.parquet(f"{lake}/silver/events").where(where)).persist()
    scored = botscore.scored(cell, limits).persist()
    farmed = botscore.farmed_repos(cell).orderBy("era", F.desc("farm_starrers"), "repo")
    try:
        for name, df in (("bot_scores", botscore.bot_scores(scored)), ("bot_rule_eval", botscore.rule_eval(scored)), ("farmed_repos", farmed)):
            df.write.mode("overwrite").parquet(f"{lake}/gold/{name}")
            ingest.write_export(spark.read.schema(df.schema).parquet(f"{lake}/gold/{name}"), f"{lake}/exports/{name}")
        ingest.write_known_bots(botscore.new_known_bots(scored), f"{lake}/known_bots/source=rules")
    finally:
        scored.unpersist()
        cell.unpersist()


def run_daily(spark: SparkSession, lake: str, limits: botscore.Limits = botscore.Limits(), after: tuple[Callable[[SparkSession, str], None], ...] = ()) -> None:
    """Bot scoring, full silver rebuild, gold with its exports, then whatever follows (metrics.STEPS: sketches, recommender, graph)."""
    build_silver(spark, lake)
    score_bots(spark, lake, limits)
    build_silver(spark, lake)
    read = lambda name: spark.read.parquet(f"{lake}/silver/{name}")
    for name, df in gold_tables(read("events"), read("stars"), read("issues")).items():
        df.write.mode("overwrite").parquet(f"{lake}/gold/{name}")
        ingest.write_export(spark.read.schema(df.schema).parquet(f"{lake}/gold/{name}"), f"{lake}/exports/{name}")
    for step in after:
        step(spark, lake)


def main(args: list[str] | None = None) -> None:
    """python -m feedforge.plans.daily LAKE [--hours FIRST LAST --landing DIR]"""
    parser = argparse.ArgumentParser()
    parser.add_argument("lake")
    parser.add_argument("--hours", nargs=2)
    parser.add_argument("--landing")
    parser.add_argument("--settings", default=".env")
    given = parser.parse_args(args)
    files.load_settings(given.settings)
    spark = SparkSession.builder.appName("feedforge-daily").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.hours:
        for at in ingest.hour_range(*map(ingest.parse_hour, given.hours)):
            path = files.resolve(spark, given.landing, at)
            print(f"{ingest.hour_key(at)}: no file" if path is None else ingest_hour(spark, path, given.lake, at))
    run_daily(spark, given.lake, after=metrics.STEPS)


if __name__ == "__main__":
    main()
