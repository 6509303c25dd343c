"""Behaviour rules for accounts, and repositories whose stars come from star-only accounts.

All features of an account come from one pre-aggregate by (era, actor, hour, type, repo); what is
left of the joins is the one with the farmed repositories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAR = "WatchEvent"
FLAG_AT = 4


@dataclass(frozen=True)
class Limits:
    peak_events: int = 200
    peak_repos: int = 50
    day_hours: int = 24
    peak_stars: int = 100
    many_events: int = 200
    one_type_share: float = 0.95
    same_repo_stars: int = 5
    farmed_repos: int = 3
    star_only_stars: int = 5
    farm_starrers: int = 20
    farm_share: float = 0.6


#: (rule, weight) in the order in which they are named.
WEIGHTS = {"R2": 3, "R3": 3, "R4": 2, "R5": 4, "R6": 1, "R7": 4, "R8": 4}


def cells(events: DataFrame) -> DataFrame:
    """era, actor, hour (as text), type, repo, n, labelled."""
    return events.groupBy(
        "era", F.col("actor_login").alias("actor"), F.substring(F.date_format("created_at", "yyyy-MM-dd HH"), 1, 13).alias("hour"), F.col("event_type").alias("type"), F.concat("repo_owner", F.lit("/"), "repo").alias("repo")
    ).agg(F.count("*").alias("n"), F.max(F.col("actor_login").rlike(r"^.*\[bot\]$").cast("int")).alias("labelled"))


def account_totals(cell: DataFrame) -> DataFrame:
    star = F.when(F.col("type") == STAR, F.col("n")).otherwise(0)
    return cell.groupBy("era", "actor").agg(F.sum("n").alias("events"), F.count_distinct("repo").alias("distinct_repos"), F.count_distinct("hour").alias("active_hours"), F.sum(star).alias("stars"), F.max("labelled").alias("labelled"))


def hourly(cell: DataFrame) -> DataFrame:
    star = F.when(F.col("type") == STAR, F.col("n")).otherwise(0)
    return cell.groupBy("era", "actor", "hour").agg(F.sum("n").alias("n_events"), F.count_distinct("repo").alias("n_repos"), F.sum(star).alias("n_stars"))


def hourly_peaks(cell: DataFrame) -> DataFrame:
    return hourly(cell).groupBy("era", "actor").agg(F.max("n_events").alias("peak_events_hour"), F.max("n_repos").alias("peak_repos_hour"), F.max("n_stars").alias("peak_stars_hour"))


def max_day_hours(cell: DataFrame) -> DataFrame:
    per = cell.select("era", "actor", F.substring("hour", 1, 10).alias("day"), "hour").distinct().groupBy("era", "actor", "day").agg(F.count("*").alias("h"))
    return per.groupBy("era", "actor").agg(F.max("h").alias("max_hours_in_day"))


def dominant_type(cell: DataFrame) -> DataFrame:
    return cell.groupBy("era", "actor", "type").agg(F.sum("n").alias("n")).groupBy("era", "actor").agg(F.max("n").alias("top_type_events"))


def repo_stars(cell: DataFrame) -> DataFrame:
    """era, actor, repo, n: stars of an account on a repository, repeats counted."""
    return cell.where(F.col("type") == STAR).groupBy("era", "actor", "repo").agg(F.sum("n").alias("n"))


def repeat_stars(cell: DataFrame) -> DataFrame:
    return repo_stars(cell).groupBy("era", "actor").agg(F.max("n").alias("max_same_repo_stars"))


def star_only(cell: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return account_totals(cell).where((F.col("stars") == F.col("events")) & (F.col("stars") >= limits.star_only_stars)).select("era", "actor", "events", "stars")


def farm_links(cell: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return repo_stars(cell).join(star_only(cell, limits).select("era", "actor"), ["era", "actor"], "left_semi").select("era", "actor", "repo")


def farmed_repos(cell: DataFrame, limits: Limits = Limits()) -> DataFrame:
    starrers = repo_stars(cell).groupBy("era", "repo").agg(F.count("*").alias("starrers"))
    farm = farm_links(cell, limits).groupBy("era", "repo").agg(F.count("*").alias("farm_starrers"))
    both = starrers.join(farm, ["era", "repo"]).withColumn("farm_pct", F.col("farm_starrers").cast("double") / F.col("starrers").cast("double"))
    return both.where((F.col("starrers") >= limits.farm_starrers) & (F.col("farm_pct") >= limits.farm_share))


def features(cell: DataFrame, limits: Limits = Limits()) -> DataFrame:
    hits = farm_links(cell, limits).join(farmed_repos(cell, limits).select("era", "repo"), ["era", "repo"], "left_semi").groupBy("era", "actor").agg(F.count("*").alias("_hits"))
    keys = ["era", "actor"]
    out = account_totals(cell)
    for part in (hourly_peaks(cell), max_day_hours(cell), dominant_type(cell), repeat_stars(cell), hits):
        out = out.join(part, keys, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        *keys, "events", "distinct_repos", "active_hours", "stars", "peak_events_hour", "peak_repos_hour", "peak_stars_hour", "max_hours_in_day",
        (F.col("top_type_events").cast("double") / F.col("events").cast("double")).alias("top_type_share"),
        F.coalesce("max_same_repo_stars", zero).alias("max_same_repo_stars"), F.coalesce("_hits", zero).alias("farmed_repos_starred"), "labelled",
    )


def scored(cell: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every account with rules_fired (blanks kept after all rules but the last) and bot_score."""
    fired = {
        "R2": F.col("peak_events_hour") > limits.peak_events,
        "R3": F.col("peak_repos_hour") > limits.peak_repos,
        "R4": F.col("max_hours_in_day") >= limits.day_hours,
        "R5": F.col("peak_stars_hour") > limits.peak_stars,
        "R6": (F.col("events") >= limits.many_events) & (F.col("top_type_share") > limits.one_type_share),
        "R7": F.col("max_same_repo_stars") >= limits.same_repo_stars,
        "R8": F.col("farmed_repos_starred") >= limits.farmed_repos,
    }
    names = F.concat(*[F.when(on, F.lit(rule if rule == "R8" else rule + " ")).otherwise(F.lit("")) for rule, on in fired.items()])
    score = sum((F.when(on, WEIGHTS[rule]).otherwise(0) for rule, on in fired.items()), F.lit(0))
    return features(cell, limits).withColumns({"rules_fired": names, "bot_score": score, "is_labelled_bot": F.col("labelled")}).drop("labelled").withColumnRenamed("actor", "actor_login")


def bot_scores(score: DataFrame) -> DataFrame:
    return score.where((F.col("bot_score") > 0) | (F.col("is_labelled_bot") == 1)).orderBy(F.desc("bot_score"), F.desc("events"), "actor_login", "era")


def rule_eval(score: DataFrame) -> DataFrame:
    return score.groupBy("era", "is_labelled_bot").agg(F.count("*").alias("accounts"), F.sum(F.when(F.col("bot_score") >= FLAG_AT, 1).otherwise(0)).alias("flagged"))


def new_known_bots(score: DataFrame) -> DataFrame:
    return score.where((F.col("bot_score") >= FLAG_AT) & (F.col("is_labelled_bot") == 0)).select(F.col("actor_login").alias("login")).distinct()


def histogram(score: DataFrame) -> DataFrame:
    return score.groupBy("bot_score").agg(F.count("*").alias("accounts"), F.max((F.col("bot_score") >= FLAG_AT).cast("int")).alias("flagged"))
