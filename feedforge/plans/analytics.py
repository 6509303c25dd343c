"""Word count, document pipelines, sketches, recommender, graph, ingest and plot queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import docstore, gold, graph, ingest, recommend, sketches, storage, wordcount
from ..sources.staging import shared_path, staged
from ..sources.tables import activity, bronze, table
from ..streaming import jobs
from .lake import _ev, _silver

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# word count

_STOP = ", ".join(f"'{w}'" for w in wordcount.STOP_WORDS)
_TOKENS = "WITH tokens AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)"
_WORDS = _TOKENS + f", counted AS (SELECT word, count(*) AS count FROM tokens WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY word)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("text")


@query("word_count", _WORDS + " SELECT * FROM counted")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.word_count(_messages(spark, d), "text")


@query("top_words", _WORDS + " SELECT * FROM counted ORDER BY count DESC, word LIMIT 50")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.top_words(wordcount.word_count(_messages(spark, d), "text"))


@query("word_counters", _TOKENS + f""" SELECT (SELECT count(*) FROM documents) AS records, 0::BIGINT AS bot_records_skipped,
  count(*) FILTER (length(word) BETWEEN 1 AND 2) AS short_tokens_skipped, count(*) FILTER (length(word) >= 3 AND word IN ({_STOP})) AS stopwords_skipped,
  count(*) FILTER (length(word) >= 3 AND word NOT IN ({_STOP})) AS words_emitted FROM tokens""")
def word_counters(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.counters(_messages(spark, d), "text")


# document store

@query("doc_event_share", _silver("SELECT event_type, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM bronze) * 100, 2) AS percentage FROM bronze GROUP BY ALL"))
def doc_event_share(spark: SparkSession, d: str) -> DataFrame:
    return docstore.event_share(bronze(spark, d))


@query("doc_top_starred", _silver("SELECT owner_name || '/' || repo_name AS repo, count(*) AS total_stars, count(DISTINCT login) AS unique_users FROM bronze WHERE event_type = 'WatchEvent' GROUP BY ALL ORDER BY unique_users DESC, repo LIMIT 10"))
def doc_top_starred(spark: SparkSession, d: str) -> DataFrame:
    return docstore.top_starred(bronze(spark, d))


@query("doc_commit_stats", _silver("""SELECT owner_name || '/' || repo_name AS repo, count(*) AS commits, round_even(avg(length('Fix' || chr(9) || 'bug ' || k || ' part ' || i)), 1) AS avg_msg_len
  FROM bronze, unnest(range(n_commits)) t(i) WHERE n_commits > 0 GROUP BY ALL ORDER BY commits DESC, repo LIMIT 10"""))
def doc_commit_stats(spark: SparkSession, d: str) -> DataFrame:
    return docstore.commit_stats(bronze(spark, d))


@query("doc_bot_human", _silver("SELECT event_type, CASE WHEN lower(login) LIKE '%[bot]' THEN 'BOT' ELSE 'HUMAN' END AS actor_category, count(*) AS count FROM bronze GROUP BY ALL"))
def doc_bot_human(spark: SparkSession, d: str) -> DataFrame:
    return docstore.bot_human(bronze(spark, d))


@query("doc_issue_lifecycle", _silver("SELECT ['opened', 'closed', 'reopened'][k % 3 + 1] AS action, count(*) AS total_actions FROM bronze WHERE event_type = 'IssuesEvent' GROUP BY ALL"))
def doc_issue_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return docstore.issue_lifecycle(bronze(spark, d))


@query("doc_find", _silver("SELECT event_id::VARCHAR AS id, event_type AS type, login AS actor_login FROM bronze WHERE owner_name || '/' || repo_name = 'Org7/Repo7'"))
def doc_find(spark: SparkSession, d: str) -> DataFrame:
    return docstore.find(bronze(spark, d), F.col("repo.name") == "Org7/Repo7", "id", "type", "actor.login")


_FLAT = "SELECT event_id::VARCHAR AS id, event_type AS type, login, CASE event_type WHEN 'WatchEvent' THEN 'started' WHEN 'IssuesEvent' THEN ['opened', 'closed', 'reopened'][k % 3 + 1] WHEN 'IssueCommentEvent' THEN 'created' END AS action FROM bronze"


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select("id", "type", F.col("actor.login").alias("login"), F.col("payload.action").alias("action"))


@query("doc_insert", _silver(_FLAT + " UNION ALL SELECT 'crud-1', 'WatchEvent', 'Tester', 'started'"))
def doc_insert(spark: SparkSession, d: str) -> DataFrame:
    docs = bronze(spark, d)
    new = spark.sql("SELECT 'crud-1' id, 'WatchEvent' type, named_struct('id', 0L, 'login', 'Tester') actor, named_struct('action', 'started') payload")
    return docstore.insert(_flat(docs), _flat(new))


@query("doc_update", _silver(f"SELECT * REPLACE (CASE WHEN type = 'IssuesEvent' AND action = 'opened' THEN 'triaged' ELSE action END AS action) FROM ({_FLAT})"))
def doc_update(spark: SparkSession, d: str) -> DataFrame:
    return _flat(docstore.update(bronze(spark, d), (F.col("type") == "IssuesEvent") & (F.col("payload.action") == "opened"), "payload.action", F.lit("triaged")))


@query("doc_delete", _silver(f"SELECT id, type, login, action FROM (SELECT *, row_number() OVER (PARTITION BY type = 'PushEvent' ORDER BY id, created_at) AS r FROM ({_FLAT.replace(' FROM bronze', ', created_at FROM bronze')})) WHERE type <> 'PushEvent' OR r > 1"))
def doc_delete(spark: SparkSession, d: str) -> DataFrame:
    return _flat(docstore.delete_one(bronze(spark, d), F.col("type") == "PushEvent", "id", "created_at"))


@query("distinct_logins", _silver("SELECT DISTINCT login FROM bronze WHERE lower(login) LIKE '%[bot]'"))
def distinct_logins(spark: SparkSession, d: str) -> DataFrame:
    return docstore.distinct_logins(bronze(spark, d))


# ingest

def _lines(spark: SparkSession, d: str) -> DataFrame:
    whole = bronze(spark, d).drop("dt", "hr")
    broken = F.when(F.col("id").try_cast("bigint") % 500 == 3, F.lit("{not json"))
    return whole.select(F.coalesce(broken, F.to_json(F.struct(*whole.columns))).alias("value"))


@query("validate_profile", _silver("""SELECT count(*) AS lines, count(*) FILTER (event_id % 500 = 3) AS bad_lines, count(*) FILTER (event_type = 'PushEvent' AND event_id % 500 <> 3) AS pushes,
  count(*) FILTER (n_commits > 0 AND event_id % 500 <> 3) AS pushes_with_commits, 'v2024' AS era,
  strftime(min(created_at) FILTER (event_id % 500 <> 3), '%Y-%m-%dT%H:%M:%SZ') AS first_event_at, strftime(max(created_at) FILTER (event_id % 500 <> 3), '%Y-%m-%dT%H:%M:%SZ') AS last_event_at FROM bronze"""))
def validate_profile(spark: SparkSession, d: str) -> DataFrame:
    return ingest.profile(ingest.parse_lines(_lines(spark, d)))


@query("ingest_log_upsert", _silver("""SELECT dt || '-' || hr AS hour, CASE WHEN hr % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS lines, CASE WHEN hr % 5 = 0 THEN 'timeout' END AS error,
  CASE WHEN hr % 5 = 0 THEN 2 ELSE 1 END AS ingested_at FROM bronze GROUP BY dt, hr"""))
def ingest_log_upsert(spark: SparkSession, d: str) -> DataFrame:
    done = bronze(spark, d).groupBy("dt", "hr").agg(F.count("*").alias("lines"))
    hour = F.concat("dt", F.lit("-"), F.col("hr").cast("string")).alias("hour")
    success = done.select(hour, F.lit("ok").alias("status"), "lines", F.lit(None).cast("string").alias("error"), F.lit(1).alias("ingested_at"))
    failure = done.where("hr % 5 = 0").select(hour, F.lit("failed").alias("status"), F.lit(None).cast("long").alias("lines"), F.lit("timeout").alias("error"), F.lit(2).alias("ingested_at"))
    return ingest.upsert_log(success.unionByName(failure))


# sketches

_HASH = "('0x' || substr(md5({seed} || ':' || {item}), 1, 8))::BIGINT"
_ZEROS = "CASE WHEN h = 0 THEN 32 ELSE bit_count((h & -h) - 1) END"
_EVERY = 1000


def _items(spark: SparkSession, d: str) -> DataFrame:
    return activity(spark, d).select("event_id", "created_at", "dt", F.concat("actor_login", F.lit("@"), "repo").alias("item"))


@query("bloom_params", """SELECT r AS target_fpr, m, k, round(power(1 - exp(-k * n / m), k), 5) AS theoretical_fpr FROM (
  SELECT *, greatest(1, floor(m / n * ln(2)))::BIGINT AS k FROM (SELECT *, greatest(1, floor(-n * ln(r) / (ln(2) * ln(2))))::BIGINT AS m FROM (SELECT unnest([0.10, 0.05, 0.01, 0.001]::DOUBLE[]) AS r, 516 AS n)))""")
def bloom_params(spark: SparkSession, d: str) -> DataFrame:
    return sketches.rates_table(spark, 516)


_BLOOM = _ev(""", items AS (SELECT DISTINCT actor_login || '@' || repo AS item, user_id % 2 = 0 AS trained FROM ev),
sized AS (SELECT *, greatest(1, floor(m / n * ln(2)))::BIGINT AS k FROM (SELECT *, greatest(1, floor(-n * ln(r) / (ln(2) * ln(2))))::BIGINT AS m
  FROM (SELECT unnest([0.10, 0.05, 0.01, 0.001]::DOUBLE[]) AS r, (SELECT count(*) FROM items WHERE trained) AS n))),
places AS (SELECT r, item, trained, (h1 + i * h2) % m AS bit FROM (SELECT item, trained, """ + _HASH.format(seed="1", item="item") + " AS h1, " + _HASH.format(seed="2", item="item") + """ AS h2 FROM items), sized, unnest(range(k)) t(i)),
bits AS (SELECT DISTINCT r, bit FROM places WHERE trained),
maybe AS (SELECT p.r, item, bool_and(b.bit IS NOT NULL) AS maybe FROM places p LEFT JOIN bits b ON p.r = b.r AND p.bit = b.bit WHERE NOT trained GROUP BY ALL)
SELECT r AS target_fpr, m, k, round(avg(maybe::INT), 6) AS actual_fpr, round(power(1 - exp(-k * n / m), k), 5) AS theoretical_fpr FROM maybe JOIN sized USING (r) GROUP BY ALL""")


@query("bloom_fpr", _BLOOM)
def bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    items = staged(activity(spark, d).select("user_id", F.concat("actor_login", F.lit("@"), "repo").alias("item")).distinct(), "items")
    return sketches.bloom_fpr(items.where("user_id % 2 = 0"), items.where("user_id % 2 = 1"), "item")


_FM = ", hashed AS (SELECT seed, " + _HASH.format(seed="seed", item="item") + " AS h FROM (SELECT DISTINCT actor_login || '@' || repo AS item FROM ev), unnest(range(64)) t(seed)), registers AS (SELECT seed::INT AS seed, max(" + _ZEROS + ")::INT AS zeros FROM hashed GROUP BY seed)"


@query("fm_registers", _ev(_FM + " SELECT * FROM registers"))
def fm_registers(spark: SparkSession, d: str) -> DataFrame:
    return sketches.fm_registers(_items(spark, d), "item")


@query("fm_estimate", _ev(_FM + " SELECT round(median(e), 6) AS estimate FROM (SELECT 0.77351::DOUBLE * power(2.0, avg(zeros)) AS e FROM registers GROUP BY seed // 8)"))
def fm_estimate(spark: SparkSession, d: str) -> DataFrame:
    return sketches.fm_estimate(sketches.fm_registers(_items(spark, d), "item"))


_SEQ = ", seq AS (SELECT *, actor_login || '@' || repo AS item, row_number() OVER (ORDER BY created_at, event_id) AS seq FROM ev)"
_MARKS = f", marks AS (SELECT unnest(range(1, (SELECT max(seq) // {_EVERY} FROM seq) + 1)) * {_EVERY} AS c), firsts AS (SELECT item, min(seq) AS seq FROM seq GROUP BY item), exact AS (SELECT c, count(*) AS exact FROM marks JOIN firsts ON seq <= c GROUP BY c)"


@query("exact_distinct_running", _ev(_SEQ + _MARKS + " SELECT c AS events_processed, exact FROM exact"))
def exact_distinct_running(spark: SparkSession, d: str) -> DataFrame:
    return sketches.running_distinct(_items(spark, d), "item", _EVERY)


@query("fm_checkpoints", _ev(_SEQ + _MARKS + ", hashed AS (SELECT seq, seed, " + _HASH.format(seed="seed", item="item") + " AS h FROM firsts, unnest(range(64)) t(seed)), first_zeros AS (SELECT seed, " + _ZEROS + f""" AS z, ceil(seq / {_EVERY}) * {_EVERY} AS c0 FROM hashed),
cells AS (SELECT seed, c0, max(z) AS z FROM first_zeros GROUP BY ALL), registers AS (SELECT c, seed, max(z) AS zeros FROM marks JOIN cells ON c0 <= c GROUP BY ALL),
est AS (SELECT c, round(median(e), 6) AS estimate FROM (SELECT c, 0.77351::DOUBLE * power(2.0, avg(zeros)) AS e FROM registers GROUP BY c, seed // 8) GROUP BY c)
SELECT c AS events_processed, estimate, exact, round(abs(estimate - exact) / exact * 100, 4) AS error_pct FROM est JOIN exact USING (c)"""))
def fm_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return sketches.fm_checkpoints(_items(spark, d), "item", _EVERY)


@query("sliding_ones_exact", _ev(_SEQ + " SELECT event_id, seq, sum((event_type = 'WatchEvent')::INT) OVER (ORDER BY seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)::BIGINT AS ones FROM seq"))
def sliding_ones_exact(spark: SparkSession, d: str) -> DataFrame:
    return sketches.sliding_ones(activity(spark, d), F.col("event_type") == "WatchEvent", 1000)


@query("user_sample", _ev(", kept AS (SELECT actor_login, " + _HASH.format(seed="0", item="actor_login") + " % 10 = 0 AS kept FROM ev) SELECT count(*) FILTER (kept) AS events_kept, count(DISTINCT actor_login) FILTER (kept) AS users_kept, count(DISTINCT actor_login) AS users, round(count(DISTINCT actor_login) FILTER (kept) / count(DISTINCT actor_login), 6) AS rate FROM kept"))
def user_sample(spark: SparkSession, d: str) -> DataFrame:
    ev = activity(spark, d).select("actor_login")
    kept = sketches.sampled(ev, "actor_login").agg(F.count("*").alias("events_kept"), F.count_distinct("actor_login").alias("users_kept"))
    return kept.crossJoin(ev.agg(F.count_distinct("actor_login").alias("users"))).withColumn("rate", F.round(F.col("users_kept") / F.col("users"), 6))


@query("dgim_estimate")
def dgim_estimate(spark: SparkSession, d: str) -> DataFrame:
    return sketches.dgim_by_key(activity(spark, d), "repo", F.col("event_type") == "WatchEvent", 64)


# recommender

_CF = _ev(""", pairs AS (SELECT DISTINCT actor_login AS user, repo_owner || '/' || repo AS repo FROM ev WHERE event_type = 'WatchEvent' AND NOT is_bot),
split AS (SELECT user, repo, row_number() OVER (PARTITION BY user ORDER BY md5(user || ':' || repo), repo) = 1 AND count(*) OVER (PARTITION BY user) >= 2 AS held FROM pairs),
train AS (SELECT user, repo FROM split WHERE NOT held), test AS (SELECT user, repo FROM split WHERE held),
popular AS (SELECT repo, count(*) AS users FROM train GROUP BY repo),
sims AS (SELECT a.repo AS repo_a, b.repo AS repo_b, count(*) / sqrt(any_value(x.users) * any_value(y.users)) AS sim FROM train a JOIN train b USING (user) JOIN popular x ON x.repo = a.repo JOIN popular y ON y.repo = b.repo WHERE a.repo <> b.repo GROUP BY ALL),
scores AS (SELECT user, repo_b AS repo, round(sum(sim), 9) AS score FROM train JOIN sims ON repo = repo_a GROUP BY ALL),
cand AS (SELECT * FROM scores ANTI JOIN train USING (user, repo)),
pop AS (SELECT user, popular.repo, users::DOUBLE AS score FROM (SELECT user FROM test) CROSS JOIN popular ANTI JOIN train USING (user, repo)),
cf AS (SELECT * FROM cand SEMI JOIN test USING (user) UNION ALL SELECT * FROM pop ANTI JOIN cand USING (user)),
hits AS (SELECT test.user, (SELECT r FROM (SELECT user, repo, row_number() OVER (PARTITION BY user ORDER BY score DESC, repo) AS r FROM pop) p WHERE p.user = test.user AND p.repo = test.repo) AS p,
  (SELECT r FROM (SELECT user, repo, row_number() OVER (PARTITION BY user ORDER BY score DESC, repo) AS r FROM cf) c WHERE c.user = test.user AND c.repo = test.repo) AS c FROM test)
""")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return staged(recommend.holdout(recommend.interactions(activity(spark, d).where("event_type = 'WatchEvent'"))), "split")


@query("cf_interactions", _CF + "SELECT * FROM pairs")
def cf_interactions(spark: SparkSession, d: str) -> DataFrame:
    return recommend.interactions(activity(spark, d).where("event_type = 'WatchEvent'"))


@query("cf_holdout", _CF + "SELECT * FROM split")
def cf_holdout(spark: SparkSession, d: str) -> DataFrame:
    return recommend.holdout(cf_interactions(spark, d))


@query("cf_popularity", _CF + "SELECT * FROM popular")
def cf_popularity(spark: SparkSession, d: str) -> DataFrame:
    return recommend.popularity(_split(spark, d).where("not held"))


@query("cf_similarity", _CF + "SELECT repo_a, repo_b, round(sim, 6) AS sim FROM sims")
def cf_similarity(spark: SparkSession, d: str) -> DataFrame:
    return recommend.similarity(_split(spark, d).where("not held").select("user", "repo")).withColumn("sim", F.round("sim", 6))


@query("cf_scores", _CF + "SELECT user, repo, round(score, 6) AS score FROM cand")
def cf_scores(spark: SparkSession, d: str) -> DataFrame:
    train = _split(spark, d).where("not held").select("user", "repo")
    return recommend.scores(train, staged(recommend.similarity(train), "similarity")).withColumn("score", F.round("score", 6))


@query("cf_hit_rate", _CF + """SELECT k, round(p, 6) AS popularity_hit_rate, round(c, 6) AS cf_hit_rate, round(CASE WHEN p > 0 THEN (c - p) / p * 100 ELSE 0.0 END, 4) AS gain_pct
FROM (SELECT k::INT AS k, avg(CASE WHEN hits.p <= k THEN 1 ELSE 0 END) AS p, avg(CASE WHEN hits.c <= k THEN 1 ELSE 0 END) AS c FROM hits, unnest([5, 10, 20]) t(k) GROUP BY k)""")
def cf_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return recommend.hit_rates(_split(spark, d))


# graph

MIN_WEIGHT = 2
_EDGES = _ev(f""", repos AS (SELECT DISTINCT actor_login AS actor, repo_owner || '/' || repo AS repo FROM ev WHERE NOT is_bot AND event_type IN ('PushEvent', 'PullRequestEvent', 'IssuesEvent')),
fit AS (SELECT * FROM repos SEMI JOIN (SELECT actor FROM repos GROUP BY actor HAVING count(*) BETWEEN 2 AND 50) USING (actor)),
edges AS (SELECT a.repo AS src, b.repo AS dst, count(*) AS weight FROM fit a JOIN fit b ON a.actor = b.actor AND a.repo < b.repo GROUP BY ALL HAVING count(*) >= {MIN_WEIGHT}),
ends AS (SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
degrees AS (SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM ends GROUP BY node)
""")
_REACH = _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + ", reach(node, other) AS (SELECT node, node FROM degrees UNION SELECT r.node, e.other FROM reach r JOIN ends e ON r.other = e.node), parts AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return staged(graph.edges(activity(spark, d), MIN_WEIGHT), "edges")


@query("graph_edges", _EDGES + "SELECT * FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(activity(spark, d), MIN_WEIGHT)


@query("graph_degree", _EDGES + "SELECT * FROM degrees")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query("graph_components", _REACH + " SELECT * FROM parts")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d))


@query("graph_modularity", _EDGES + """, label AS (SELECT node, split_part(node, '/', 1) AS owner FROM degrees), whole AS (SELECT sum(weight) AS m FROM edges),
inside AS (SELECT a.owner, sum(weight) AS w FROM edges JOIN label a ON src = a.node JOIN label b ON dst = b.node WHERE a.owner = b.owner GROUP BY ALL),
outside AS (SELECT owner, sum(strength) AS s FROM degrees JOIN label USING (node) GROUP BY ALL)
SELECT count(*) AS groups, round(sum(coalesce(w, 0) / m - power(s / (2 * m), 2.0)), 6) AS modularity FROM outside LEFT JOIN inside USING (owner) CROSS JOIN whole""")
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    edge = _edges(spark, d)
    return graph.modularity(edge, graph.degrees(edge).select("node", F.split("node", "/")[0].alias("owner")), "owner")


@query("top_subgraph_edges", _EDGES + ", top AS (SELECT node FROM degrees ORDER BY degree DESC, node LIMIT 30) SELECT src, dst, weight FROM edges WHERE src IN (FROM top) AND dst IN (FROM top)")
def top_subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_subgraph(_edges(spark, d))


@query("graph_louvain")
def graph_louvain(spark: SparkSession, d: str) -> DataFrame:
    return graph.louvain(_edges(spark, d))


@query("graph_girvan_newman")
def graph_girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    return graph.girvan_newman_top(_edges(spark, d))


# plot-ready frames

@query("weekday_heatmap", _ev(" SELECT strftime(created_at, '%a') AS weekday, hr, count(*) AS events, (hr * 60 + 330) // 60 % 24 AS hr_kolkata FROM ev GROUP BY ALL"))
def weekday_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return activity(spark, d).groupBy(F.date_format("created_at", "EEE").alias("weekday"), "hr").agg(F.count("*").alias("events")).withColumn("hr_kolkata", F.expr("cast((hr * 60 + 330) div 60 % 24 as int)"))


@query("hourly_stacked", _ev(" SELECT hr, event_type, count(*) AS events FROM ev GROUP BY ALL"))
def hourly_stacked(spark: SparkSession, d: str) -> DataFrame:
    return activity(spark, d).groupBy("hr", "event_type").agg(F.count("*").alias("events"))


@query("share_within_type", _ev(" SELECT event_type, is_bot, count(*) AS events, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY event_type), 2) AS pct FROM ev GROUP BY event_type, is_bot"))
def share_within_type(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    per = activity(spark, d).groupBy("event_type", "is_bot").agg(F.count("*").alias("events"))
    return per.withColumn("pct", F.round(100 * F.col("events") / F.sum("events").over(Window.partitionBy("event_type")), 2))


@query("mix_with_other", _ev(""", per AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM ev GROUP BY event_type)
SELECT CASE WHEN r <= 3 THEN event_type ELSE 'Other' END AS event_type, sum(n)::BIGINT AS events, round(100 * sum(n) / (SELECT sum(n) FROM per), 2) AS pct FROM per GROUP BY 1"""))
def mix_with_other(spark: SparkSession, d: str) -> DataFrame:
    per = activity(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), "event_type").limit(3).select(F.col("event_type").alias("top"))
    named = per.join(F.broadcast(top), per["event_type"] == F.col("top"), "left").groupBy(F.coalesce("top", F.lit("Other")).alias("event_type")).agg(F.sum("n").alias("events"))
    return named.crossJoin(F.broadcast(per.agg(F.sum("n").alias("_n")))).select("event_type", "events", F.round(100 * F.col("events") / F.col("_n"), 2).alias("pct"))


@query("melt_fpr", "SELECT target_fpr, variable, value FROM (UNPIVOT (" + SQL["bloom_params"].replace("m, k, round", "m::DOUBLE AS m, k::DOUBLE AS k, round") + ") ON m, k, theoretical_fpr INTO NAME variable VALUE value)")
def melt_fpr(spark: SparkSession, d: str) -> DataFrame:
    wide = sketches.rates_table(spark, 516).withColumns({"m": F.col("m").cast("double"), "k": F.col("k").cast("double")})
    return wide.unpivot("target_fpr", ["m", "k", "theoretical_fpr"], "variable", "value")


# streaming

@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling-window job over the table as a file stream, run until nothing is left."""
    schema = table(spark, d, "events").schema
    path = shared_path(spark, "hourly-counts")
    jobs.run_available(jobs.hourly_counts(jobs.source(spark, f"{d}/events.parquet*", schema)), path, path + "-checkpoint", "complete")
    return spark.read.parquet(path).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("melt_fm", "SELECT events_processed, variable, value FROM (UNPIVOT (SELECT events_processed, estimate::DOUBLE AS estimate, exact::DOUBLE AS exact FROM (" + SQL["fm_checkpoints"] + ")) ON estimate, exact INTO NAME variable VALUE value)")
def melt_fm(spark: SparkSession, d: str) -> DataFrame:
    return storage.melt(fm_checkpoints(spark, d), ["events_processed"], ["estimate", "exact"])


@query("melt_hit_rate", "SELECT k, variable, value FROM (UNPIVOT (SELECT k, popularity_hit_rate::DOUBLE AS popularity_hit_rate, cf_hit_rate::DOUBLE AS cf_hit_rate FROM (" + SQL["cf_hit_rate"] + ")) ON popularity_hit_rate, cf_hit_rate INTO NAME variable VALUE value)")
def melt_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return storage.melt(cf_hit_rate(spark, d), ["k"], ["popularity_hit_rate", "cf_hit_rate"])


@query("top_degree_nodes", _EDGES + "SELECT node, degree, strength FROM degrees ORDER BY degree DESC, node LIMIT 50")
def top_degree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(50)


@query("component_sizes", _REACH + " SELECT component, count(*) AS nodes FROM parts GROUP BY component ORDER BY nodes DESC, component LIMIT 5")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d)).groupBy("component").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "component").limit(5)


# raw feed, replay, grids and plots beyond the above

@query("word_counters_raw", _silver(f""", raw AS (SELECT *, event_id % 500 = 3 AS bad, login LIKE '%[bot]' AS bot FROM bronze),
pushed AS (SELECT bot, 'Fix' || chr(9) || 'bug ' || k || ' part ' || i AS message FROM raw, unnest(range(n_commits)) t(i) WHERE NOT bad AND n_commits > 0),
tokens AS (SELECT unnest(regexp_split_to_array(lower(message), '[^a-z]+')) AS word FROM pushed WHERE NOT bot)
SELECT (SELECT count(*) FROM raw) AS records, (SELECT count(*) FROM raw WHERE bad) AS bad_records, (SELECT count(*) FROM pushed) AS commits, (SELECT count(*) FROM pushed WHERE bot) AS bot_commits_skipped,
  count(*) FILTER (length(word) BETWEEN 1 AND 2) AS short_tokens_skipped, count(*) FILTER (length(word) >= 3 AND word IN ({_STOP})) AS stopwords_skipped,
  count(*) FILTER (length(word) >= 3 AND word NOT IN ({_STOP})) AS words_emitted FROM tokens"""))
def word_counters_raw(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.raw_counters(ingest.parse_lines(_lines(spark, d)))


@query("validate_type_mix", _silver("SELECT event_type AS type, count(*) AS events FROM bronze WHERE event_id % 500 <> 3 GROUP BY ALL"))
def validate_type_mix(spark: SparkSession, d: str) -> DataFrame:
    return ingest.type_mix(ingest.parse_lines(_lines(spark, d)))


@query("doc_stats", _silver("SELECT count(*) AS documents, strftime(min(created_at), '%Y-%m-%dT%H:%M:%SZ') AS first_at, strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') AS last_at FROM bronze"))
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return docstore.stats(bronze(spark, d))


@query("weekday_grid", _ev(""", per AS (SELECT strftime(created_at, '%a') AS weekday, hr, count(*) AS events FROM ev GROUP BY ALL)
SELECT g.weekday, g.hr, coalesce(events, 0) AS events FROM (SELECT weekday, hr::INT AS hr FROM unnest(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']) a(weekday), range(24) b(hr)) g LEFT JOIN per USING (weekday, hr)"""))
def weekday_grid(spark: SparkSession, d: str) -> DataFrame:
    return gold.weekday_grid(activity(spark, d))


@query("replay_first", _ev(" SELECT event_id, created_at, event_type, actor_login FROM ev ORDER BY created_at, event_id LIMIT 1000"))
def replay_first(spark: SparkSession, d: str) -> DataFrame:
    return sketches.replay(activity(spark, d), 1000).select("event_id", "created_at", "event_type", "actor_login")


@query("dgim_guarantee", _ev(_SEQ + """ SELECT max(seq) AS events_processed, count(*) FILTER (event_type = 'WatchEvent') AS exact, true AS within_half FROM seq GROUP BY ceil(seq / 500) HAVING count(*) = 500"""))
def dgim_guarantee(spark: SparkSession, d: str) -> DataFrame:
    """The sketch is held to its guarantee: no estimate is off by over half of the exact count."""
    found = sketches.dgim_checkpoints(activity(spark, d), F.col("event_type") == "WatchEvent", 500)
    return found.select("events_processed", "exact", (F.abs(F.col("estimate") - F.col("exact")) * 2 <= F.col("exact")).alias("within_half"))


@query("network_edges", _EDGES + """, top AS (SELECT node FROM degrees ORDER BY degree DESC, node LIMIT 50), plot AS (SELECT src, dst, weight FROM edges WHERE src IN (FROM top) AND dst IN (FROM top))
SELECT * FROM plot UNION ALL SELECT * FROM (SELECT src, dst, weight FROM edges ORDER BY weight DESC, src, dst LIMIT 50) WHERE NOT EXISTS (FROM plot)""")
def network_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.plot_edges(_edges(spark, d))


@query("network_nodes", _EDGES + "SELECT node, degree, round(ln(1 + degree), 6) AS size, node || ' (' || degree || ')' AS label FROM degrees ORDER BY degree DESC, node LIMIT 50")
def network_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.plot_nodes(_edges(spark, d))


@query("louvain_quality", _EDGES + "SELECT count(*) AS nodes, true AS beats_owners FROM degrees")
def louvain_quality(spark: SparkSession, d: str) -> DataFrame:
    """Communities are held to a bound: a modularity no lower than that of grouping repositories by owner."""
    edge = _edges(spark, d)
    found = staged(graph.louvain(edge), "communities")
    ours = graph.modularity(edge, found, "community").select(F.col("modularity").alias("_q"))
    owners = graph.modularity(edge, found.select("node", F.split("node", "/")[0].alias("owner")), "owner").select(F.col("modularity").alias("_o"))
    both = ours.crossJoin(F.broadcast(owners)).crossJoin(F.broadcast(found.agg(F.count("*").alias("nodes"))))  # one row each
    return both.select("nodes", F.coalesce(F.col("_q") >= F.col("_o"), F.lit(True)).alias("beats_owners"))
