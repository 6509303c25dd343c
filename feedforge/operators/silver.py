"""Bronze feed to typed silver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOT_SUFFIX = "[bot]"
TEXT_LIMIT = 1000
#: Event types with a table of their own.
ROUTES = {"stars": "WatchEvent", "issues": "IssuesEvent", "comments": "IssueCommentEvent"}


def instant(text: Column) -> Column:
    """An ISO time with Z as a zone-less timestamp; null if it can't be read."""
    return F.regexp_replace(F.regexp_replace(text, "T", " "), "Z", "").try_cast("timestamp_ntz")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t\n\r]+", " ")


def name_part(name: Column, i: int) -> Column:
    return F.get(F.split(F.lower(name), "/"), i)


def flag_bots(df: DataFrame, login: str, known: DataFrame) -> DataFrame:
    """is_bot: suffix of the login, or membership of the reference list. A null login has a null flag."""
    marks = known.select(F.col("login").alias("_bot")).distinct()
    return df.join(marks, F.col(login) == F.col("_bot"), "left").withColumn("is_bot", F.col(login).endswith(BOT_SUFFIX) | F.when(F.col("_bot").isNotNull(), True).otherwise(F.when(F.col(login).isNotNull(), False))).drop("_bot")


def hour_era(bronze: DataFrame) -> DataFrame:
    """(dt, hr, era): v2024 for hours in which any push carries commits. A small table, joined instead of a window over wide rows."""
    carries = (F.col("type") == "PushEvent") & (F.coalesce(F.size("payload.commits"), F.lit(0)) > 0)
    return bronze.groupBy("dt", "hr").agg(F.when(F.max(carries), "v2024").otherwise("v2026").alias("era"))


def base(bronze: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each event id (the first by created_at, dt, hr) with all silver columns and the payload."""
    first = Window.partitionBy("id").orderBy("created_at", "dt", "hr")
    rows = bronze.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    rows = rows.join(hour_era(bronze), ["dt", "hr"], "left").select(
        F.col("id").try_cast("bigint").alias("event_id"),
        F.col("type").alias("event_type"),
        F.lower("actor.login").alias("actor_login"),
        name_part(F.col("repo.name"), 0).alias("repo_owner"),
        name_part(F.col("repo.name"), 1).alias("repo"),
        instant(F.col("created_at")).alias("created_at"),
        "era", "dt", "hr", "payload",
    )
    return flag_bots(rows, "actor_login", known)


def events(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "event_type", "actor_login", "is_bot", "repo_owner", "repo", "created_at", F.date_format("created_at", "EEE").alias("weekday"), "era", "dt", "hr")


def stars(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("event_type") == ROUTES["stars"]).select("actor_login", "is_bot", "repo_owner", "repo", "created_at", "dt", "hr")


def issues(rows: DataFrame) -> DataFrame:
    p = "payload."
    return rows.where(F.col("event_type") == ROUTES["issues"]).select(
        "repo_owner", "repo", "actor_login", "is_bot", F.col(p + "action").alias("action"), F.col(p + "issue.number").cast("int").alias("issue_number"), one_line(F.col(p + "issue.title")).alias("title"), "created_at", "dt", "hr"
    )


def comments(rows: DataFrame) -> DataFrame:
    """The length is of the raw body; the body is cleaned, then cut."""
    body = F.col("payload.comment.body")
    return rows.where(F.col("event_type") == ROUTES["comments"]).select(
        "repo_owner", "repo", "actor_login", "is_bot", F.col("payload.issue.number").cast("int").alias("issue_number"), F.length(body).alias("body_length"), F.substring(one_line(body), 1, TEXT_LIMIT).alias("body"), "created_at", "dt", "hr"
    )


def commits(bronze: DataFrame) -> DataFrame:
    """A row for each commit of each delivered push; not de-duplicated, and flagged by suffix only."""
    rows = bronze.where(F.col("type") == "PushEvent").select("actor", "repo", "created_at", "dt", "hr", F.explode("payload.commits").alias("c"))
    login = F.lower("actor.login")
    return rows.select(
        name_part(F.col("repo.name"), 0).alias("repo_owner"), name_part(F.col("repo.name"), 1).alias("repo"), login.alias("actor_login"), login.endswith(BOT_SUFFIX).alias("is_bot"),
        F.col("c.sha").alias("sha"), F.substring(one_line(F.col("c.message")), 1, TEXT_LIMIT).alias("message"), instant(F.col("created_at")).alias("created_at"), "dt", "hr",
    )
