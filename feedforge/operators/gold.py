"""Gold aggregates over the silver tables. All rankings break ties by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLLABORATION = ("PushEvent", "PullRequestEvent", "PullRequestReviewEvent", "PullRequestReviewCommentEvent", "IssuesEvent", "IssueCommentEvent")


def full_name() -> Column:
    return F.concat("repo_owner", F.lit("/"), "repo")


def _rank(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("rank_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank_no") <= most)


def hourly_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("dt", "hr", "era", "event_type").agg(F.count("*").alias("events"), F.sum(F.when(F.col("is_bot"), 1).otherwise(0)).alias("bot_events"))


def event_mix(events: DataFrame) -> DataFrame:
    per = events.groupBy("era", "event_type").agg(F.count("*").alias("events"))
    return per.withColumn("pct", F.round(100 * F.col("events") / F.sum("events").over(Window.partitionBy("era")), 2))


def bot_share(events: DataFrame) -> DataFrame:
    bot = F.when(F.col("is_bot"), 1).otherwise(0)
    return events.groupBy("era", "event_type").agg(F.count("*").alias("events"), F.sum(bot).alias("bot_events"), F.round(100 * F.avg(bot), 2).alias("bot_pct"))


def daily_stars(stars: DataFrame) -> DataFrame:
    return stars.where(~F.col("is_bot")).groupBy("dt", "repo_owner", "repo").agg(F.count_distinct("actor_login").alias("stars"))


def top_starred(stars: DataFrame, most: int = 20) -> DataFrame:
    ranked = _rank(daily_stars(stars), ["dt"], [F.desc("stars"), "repo_owner", "repo"], most)
    return ranked.select("dt", "rank_no", full_name().alias("repo"), "stars")


def issue_activity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("dt", "action").agg(F.count("*").alias("events"))


def top_contributors(events: DataFrame, most: int = 50) -> DataFrame:
    per = events.where(~F.col("is_bot")).groupBy("era", "actor_login").agg(
        F.count("*").alias("events"), F.count_distinct(full_name()).alias("distinct_repos"), F.count_distinct(F.concat("dt", F.lit("-"), F.col("hr").cast("string"))).alias("active_hours")
    )
    return _rank(per, ["era"], [F.desc("events"), "actor_login"], most).select("era", "rank_no", "actor_login", "events", "distinct_repos", "active_hours")


def repo_collaboration(events: DataFrame, most: int = 50) -> DataFrame:
    per = events.where(~F.col("is_bot") & F.col("event_type").isin(*COLLABORATION)).groupBy("era", full_name().alias("repo")).agg(F.count_distinct("actor_login").alias("contributors"), F.count("*").alias("events"))
    return _rank(per, ["era"], [F.desc("contributors"), "repo"], most).select("era", "rank_no", "repo", "contributors", "events")


def weekday_grid(events: DataFrame) -> DataFrame:
    """events for every weekday and hour, 0 where there are none: 168 rows."""
    days, hours = F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), F.sequence(F.lit(0), F.lit(23))
    grid = events.sparkSession.range(1).select(F.explode(days).alias("weekday")).select("weekday", F.explode(hours).alias("hr"))
    per = events.groupBy(F.date_format("created_at", "EEE").alias("weekday"), "hr").agg(F.count("*").alias("events"))
    return grid.join(per, ["weekday", "hr"], "left").select("weekday", "hr", F.coalesce("events", F.lit(0)).alias("events"))


def complete_days(events: DataFrame, hours: int = 24) -> DataFrame:
    return events.groupBy("dt").agg(F.count_distinct("hr").alias("hours")).where(F.col("hours") == hours)


def trending(events: DataFrame, stars: DataFrame, least: int = 20, days: int = 7, most: int = 20) -> DataFrame:
    """Stars of a day against the mean of the complete days among the `days` before.

    Both look-backs are range frames over day numbers: linear in the rows, where a self-join would
    make a row for each pair of days of a repository.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    complete = complete_days(events).select("dt").withColumn("_day", day("dt"))
    # one row for each day of the data
    complete = complete.withColumn("baseline_days", F.count("*").over(Window.orderBy("_day").rangeBetween(-days, -1)))
    daily = daily_stars(stars).join(complete, "dt")
    back = Window.partitionBy("repo_owner", "repo").orderBy("_day").rangeBetween(-days, -1)
    rows = daily.withColumn("_before", F.coalesce(F.sum("stars").over(back), F.lit(0))).where((F.col("baseline_days") > 0) & (F.col("stars") >= least))
    rows = rows.withColumn("_baseline", F.col("_before") / F.col("baseline_days")).withColumn("_score", (F.col("stars") - F.col("_baseline")) / F.sqrt(F.col("_baseline") + 1)).withColumn("repo", full_name())
    ranked = _rank(rows, ["dt"], [F.desc("_score"), "repo"], most)
    return ranked.select("dt", "rank_no", "repo", "stars", F.round("_baseline", 2).alias("baseline"), "baseline_days", F.round("_score", 2).alias("trend_score"))
