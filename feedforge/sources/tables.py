"""Reading the driver's tables, and shaping them into the domain's bronze feed.

The activity feed itself isn't at hand; `events` is shaped into it by one projection, which has
its SQL twin below so that every query on it can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERA_CHANGE = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, created_at, user_id, k, event_type, actor_login, is_bot, repo_owner, repo, dt, hr, era."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    farm = F.col("user_id") % 7 == 3
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return (
        table(spark, sf_dir, "events")
        .select("event_id", F.col("ts").alias("created_at"), "user_id", F.when(farm, k % 10).otherwise(k).alias("k"), F.when(farm, F.lit("WatchEvent")).otherwise(kinds[F.col("event_type")]).alias("event_type"))
        .select(
            "*",
            F.concat(F.lit("user"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 10 == 0, F.lit("[bot]")).otherwise(F.lit(""))).alias("actor_login"),
            (F.col("user_id") % 10 == 0).alias("is_bot"),
            F.concat(F.lit("org"), (F.col("k") % 10).cast("string")).alias("repo_owner"),
            F.concat(F.lit("repo"), F.col("k").cast("string")).alias("repo"),
            F.date_format("created_at", "yyyy-MM-dd").alias("dt"),
            F.hour("created_at").alias("hr"),
            F.when(F.col("created_at") < F.lit(ERA_CHANGE).cast("timestamp_ntz"), F.lit("v2024")).otherwise(F.lit("v2026")).alias("era"),
        )
    )


KINDS = {"click": "WatchEvent", "view": "PushEvent", "purchase": "IssuesEvent", "signup": "PullRequestEvent", "error": "IssueCommentEvent"}


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested feed as delivered: string ids and times, mixed case names, a tenth of events delivered again an hour later."""
    ev = activity(spark, sf_dir)
    again = ev.where(F.col("event_id") % 10 == 0).withColumn("created_at", F.expr("created_at + interval 1 hour"))
    ev = ev.unionByName(again)
    is_type = lambda *names: F.col("event_type").isin(*names)
    commits = F.when(
        is_type("PushEvent") & (F.col("era") == "v2024"),
        F.expr("transform(filter(sequence(0, 2), i -> i < k % 3), i -> named_struct('sha', md5(concat(event_id, ':', i)), 'message', concat('Fix\\tbug ', k, ' part ', i)))"),
    )
    action = F.when(is_type("IssuesEvent"), F.element_at(F.array(*map(F.lit, ("opened", "closed", "reopened"))), F.col("k") % 3 + 1)).when(is_type("WatchEvent"), F.lit("started")).when(is_type("IssueCommentEvent"), F.lit("created"))
    issue = F.when(is_type("IssuesEvent", "IssueCommentEvent"), F.struct(F.col("k").alias("number"), F.concat(F.lit("Crash\t\tin module "), F.col("k").cast("string")).alias("title")))
    comment = F.when(is_type("IssueCommentEvent"), F.struct(F.concat(F.lit("Looks good\nto me "), F.col("k").cast("string")).alias("body")))
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("type"),
        F.struct(F.col("user_id").alias("id"), F.concat(F.lit("User"), F.substring("actor_login", 5, 100)).alias("login")).alias("actor"),
        F.struct(F.col("k").cast("long").alias("id"), F.concat(F.lit("Org"), (F.col("k") % 10).cast("string"), F.lit("/Repo"), F.col("k").cast("string")).alias("name")).alias("repo"),
        F.struct(action.alias("action"), commits.alias("commits"), issue.alias("issue"), comment.alias("comment")).alias("payload"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.date_format("created_at", "yyyy-MM-dd").alias("dt"),
        F.hour("created_at").alias("hr"),
    )


def known_bots(spark: SparkSession) -> DataFrame:
    """A reference list with a login named twice."""
    return spark.sql("SELECT * FROM VALUES ('user7'), ('user7'), ('user21'), ('user58') AS known_bots(login)")


#: SQL twin of `activity`, as the first table expression of a query.
ACTIVITY_SQL = f"""
ev AS (
  SELECT *, 'user' || user_id || CASE WHEN user_id % 10 = 0 THEN '[bot]' ELSE '' END AS actor_login, user_id % 10 = 0 AS is_bot,
    'org' || (k % 10) AS repo_owner, 'repo' || k AS repo, strftime(created_at, '%Y-%m-%d') AS dt, hour(created_at)::INT AS hr,
    CASE WHEN created_at < TIMESTAMP '{ERA_CHANGE}' THEN 'v2024' ELSE 'v2026' END AS era
  FROM (SELECT event_id, ts AS created_at, user_id,
      CASE WHEN user_id % 7 = 3 THEN regexp_extract(props, '([0-9]+)', 1)::INT % 10 ELSE regexp_extract(props, '([0-9]+)', 1)::INT END AS k,
      CASE WHEN user_id % 7 = 3 THEN 'WatchEvent' ELSE CASE event_type WHEN 'click' THEN 'WatchEvent' WHEN 'view' THEN 'PushEvent'
        WHEN 'purchase' THEN 'IssuesEvent' WHEN 'signup' THEN 'PullRequestEvent' WHEN 'error' THEN 'IssueCommentEvent' END END AS event_type
    FROM events))
"""

#: SQL twin of `bronze`, flat; follows ACTIVITY_SQL.
BRONZE_SQL = """
bronze AS (
  SELECT event_id, event_type, 'User' || substr(actor_login, 5) AS login, 'Org' || (k % 10) AS owner_name, 'Repo' || k AS repo_name, k,
    date_trunc('second', created_at) AS created_at, strftime(created_at, '%Y-%m-%d') AS dt, hour(created_at)::INT AS hr,
    CASE WHEN event_type = 'PushEvent' AND era = 'v2024' THEN k % 3 END AS n_commits
  FROM (SELECT * FROM ev UNION ALL SELECT * REPLACE (created_at + INTERVAL 1 HOUR AS created_at) FROM ev WHERE event_id % 10 = 0)),
bots AS (SELECT * FROM (VALUES ('user7'), ('user21'), ('user58')) t(bot)),
silver AS (
  SELECT event_id, event_type, lower(login) AS actor_login, (lower(login) LIKE '%[bot]' OR bot IS NOT NULL) AS is_bot,
    lower(owner_name) AS repo_owner, lower(repo_name) AS repo, created_at, strftime(created_at, '%a') AS weekday,
    CASE WHEN max(CASE WHEN event_type = 'PushEvent' AND n_commits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dt, hr) = 1 THEN 'v2024' ELSE 'v2026' END AS era,
    dt, hr, k, row_number() OVER (PARTITION BY event_id ORDER BY created_at, dt, hr) AS rn
  FROM bronze LEFT JOIN bots ON lower(login) = bot)
"""
