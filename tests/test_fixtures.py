"""Hand-checked cases: semantics traps of the feed, the rules, the sketches and the graph."""

import math
import re
from collections import Counter, defaultdict
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from feedforge.operators import botscore, docstore, gold, graph, ingest, recommend, silver, sketches, wordcount

HOUR0 = [
    '{"id":"1","type":"PushEvent","actor":{"id":1,"login":"Alice"},"repo":{"id":9,"name":"Org/Repo"},"payload":{"commits":[{"sha":"a1","message":"Fix\\tbug\\nnow"},{"sha":"a2","message":"add test"}]},"created_at":"2024-09-28T00:00:01Z"}',
    '{"id":"1","type":"PushEvent","actor":{"id":1,"login":"Alice"},"repo":{"id":9,"name":"Org/Repo"},"payload":{"commits":[{"sha":"a1","message":"Fix\\tbug\\nnow"},{"sha":"a2","message":"add test"}]},"created_at":"2024-09-28T00:00:02Z"}',
    '{"id":"2","type":"WatchEvent","actor":{"id":2,"login":"Dep[bot]"},"repo":{"id":9,"name":"Org/Repo"},"payload":{"action":"started"},"created_at":"2024-09-28T00:10:00Z"}',
    '{"id":"3","type":"IssuesEvent","actor":{"id":3,"login":"farm1"},"repo":{"id":9,"name":"Org/Repo"},"payload":{"action":"opened","issue":{"number":7,"title":"a\\t\\tb"}},"created_at":"2024-09-28T00:20:00Z"}',
]
HOUR1 = [
    '{"id":"4","type":"PushEvent","actor":{"id":1,"login":"Alice"},"repo":{"id":8,"name":"noslash"},"payload":{"commits":[]},"created_at":"2024-09-28T01:00:00Z"}',
    '{"id":"5","type":"IssueCommentEvent","actor":{"id":3,"login":"farm1"},"repo":{"id":9,"name":"Org/Repo"},"payload":{"issue":{"number":7},"comment":{"body":"x\\ny"}},"created_at":"2024-09-28T01:05:00Z"}',
    "{not json",
]


@pytest.fixture(scope="module")
def feed(spark):
    lines = spark.createDataFrame([(x,) for x in HOUR0 + HOUR1], "value string")
    rows = ingest.parse_lines(lines)
    return rows.withColumn("dt", F.lit("2024-09-28")).withColumn("hr", F.when(F.col("created_at") >= "2024-09-28T01", 1).otherwise(0))


@pytest.fixture(scope="module")
def base(spark, feed):
    known = spark.createDataFrame([("farm1",), ("farm1",)], "login string")
    return silver.base(ingest.good(feed), known).persist()


def test_silver(feed, base):
    ev = {r.event_id: r for r in silver.events(base).collect()}
    assert sorted(ev) == [1, 2, 3, 4, 5]
    assert ev[1].created_at.second == 1 and {r.weekday for r in ev.values()} == {"Sat"}
    assert {k: r.era for k, r in ev.items()} == {1: "v2024", 2: "v2024", 3: "v2024", 4: "v2026", 5: "v2026"}
    assert [ev[k].is_bot for k in range(1, 6)] == [False, True, True, False, True]
    assert (ev[4].repo_owner, ev[4].repo) == ("noslash", None)
    assert [f(base).count() for f in (silver.stars, silver.issues, silver.comments)] == [1, 1, 1]
    assert silver.issues(base).first().title == "a b"
    comment = silver.comments(base).first()
    assert (comment.body, comment.body_length) == ("x y", 3)
    commits = silver.commits(ingest.good(feed)).collect()
    assert len(commits) == 4 and not any(c.is_bot for c in commits)
    assert [c.message for c in commits].count("Fix bug now") == 2


def test_null_login_has_null_flag(spark):
    df = spark.createDataFrame([(None,), ("x[bot]",), ("y",)], "login string")
    got = {r.login: r.is_bot for r in silver.flag_bots(df, "login", spark.createDataFrame([("z",)], "login string")).collect()}
    assert got == {None: None, "x[bot]": True, "y": False}


def test_profile_and_gate(spark):
    rows = ingest.parse_lines(spark.createDataFrame([(x,) for x in HOUR1], "value string"))
    got = ingest.profile(rows).first()
    assert (got.lines, got.bad_lines, got.pushes_with_commits, got.era) == (3, 1, 0, "v2026")
    with pytest.raises(ValueError):
        ingest.gate(ingest.profile(rows))
    with pytest.raises(ValueError):
        ingest.gate(ingest.profile(rows), min_lines=1)
    assert ingest.gate(ingest.profile(rows), min_lines=1, max_bad=0.5)["lines"] == 3


def test_hours():
    at = datetime(2024, 9, 28, 5, tzinfo=UTC)
    assert ingest.hour_key(at) == "2024-09-28-5"
    assert all(ingest.parse_hour(x) == at for x in ("2024-09-28-5", "2024-09-28 05", "2024-09-28T05:30:00Z"))
    assert len(ingest.hour_range(at, at.replace(hour=7))) == 3
    with pytest.raises(ValueError):
        ingest.hour_range(at, at.replace(hour=4))


def test_upsert_merges(spark):
    rows = spark.createDataFrame([("h", "ok", 5, 1), ("h", "failed", None, 2)], "hour string, status string, lines int, ingested_at int")
    got = ingest.upsert_log(rows).first()
    assert (got.status, got.lines, got.ingested_at) == ("failed", 5, 2)


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.write_partitions(spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "dt string, hr int, x int"), path, "dt", "hr")
    ingest.write_partitions(spark.createDataFrame([("a", 1, 9)], "dt string, hr int, x int"), path, "dt", "hr")
    assert sorted((r.hr, r.x) for r in spark.read.parquet(path).collect()) == [(0, 1), (1, 9)]


def test_json_files_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/h.json").write_text("\n".join(HOUR1))
    rows = ingest.read_hours(spark, str(tmp_path / "in")).cache()
    assert rows.count() == 3 and ingest.good(rows).count() == 2
    ingest.write_export(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part*")).read_text() == "n\ts\n1\ta\n"
    ingest.write_known_bots(spark.createDataFrame([("b",), ("a",)], "login string"), str(tmp_path / "bots"))
    assert {r.login for r in ingest.read_known_bots(spark, str(tmp_path / "bots")).collect()} == {"a", "b"}


def test_word_count(spark):
    lines = spark.createDataFrame([("hadoop pig hive",), ("pig hive",), ("pig",)], "text string")
    assert {r.word: r["count"] for r in wordcount.word_count(lines, "text").collect()} == {"pig": 3, "hive": 2, "hadoop": 1}
    one = spark.createDataFrame([("  Fix: the bug-12 in API",)], "text string")
    assert {r.word for r in wordcount.word_count(one, "text").collect()} == {"fix", "bug", "api"}
    assert wordcount.counters(one, "text").first().asDict() == {"records": 1, "bot_records_skipped": 0, "short_tokens_skipped": 1, "stopwords_skipped": 1, "words_emitted": 3}
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3)], "word string, count long")
    assert [r.word for r in wordcount.top_words(counts, 2).collect()] == ["c", "a"]
    assert wordcount.parse_stop_words("# x\n\n The \n") == {"the"} and len(wordcount.STOP_WORDS) == 83


def events(spark, rows):
    df = spark.createDataFrame(rows, "actor_login string, event_type string, repo string, created_at string")
    return df.select("actor_login", "event_type", F.lit("o").alias("repo_owner"), "repo", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.lit("v2024").alias("era"))


def test_bot_rules(spark):
    hour = "2024-09-28 05:00:00"
    rows = [("busy", "PushEvent", "r", hour)] * 201 + [("strict", "PushEvent", "r", hour)] * 200
    rows += [("wide", "PushEvent" if i % 2 else "IssuesEvent", f"r{i}", hour) for i in range(51)]
    rows += [("awake", "PushEvent" if h % 2 else "IssuesEvent", "r", f"2024-09-28 {h:02d}:00:00") for h in range(24)]
    rows += [("fan", "WatchEvent", "s", f"2024-09-28 0{i}:00:00") for i in range(5)] + [("fan", "PushEvent", "s", hour)] + [("x[bot]", "PushEvent", "r", hour)]
    score = botscore.scored(botscore.cells(events(spark, rows)))
    got = {r.actor_login: (r.rules_fired, r.bot_score) for r in botscore.bot_scores(score).collect()}
    assert got == {"busy": ("R2 R6 ", 4), "strict": ("R6 ", 1), "wide": ("R3 ", 3), "awake": ("R4 ", 2), "fan": ("R7 ", 4), "x[bot]": ("", 0)}
    assert {r.login for r in botscore.new_known_bots(score).collect()} == {"busy", "fan"}


@pytest.mark.parametrize("people, farm, farmed", [(20, 12, True), (19, 12, False), (20, 11, False)])
def test_farmed_boundary(spark, people, farm, farmed):
    hour = "2024-09-28 05:00:00"
    rows = [(f"f{i}", "WatchEvent", r, hour) for i in range(farm) for r in ("z", *(f"own{i}-{j}" for j in range(4)))]
    rows += [(f"p{i}", "WatchEvent", "z", hour) for i in range(people - farm)]
    assert (botscore.farmed_repos(botscore.cells(events(spark, rows))).count() == 1) == farmed


def test_trending(spark):
    days = [f"2024-09-{d:02d}" for d in range(1, 10)]
    every = spark.createDataFrame([(d, h) for d in days for h in range(24)], "dt string, hr int")
    stars = spark.createDataFrame([(d, False, "o", "r", f"u{d}-{i}") for d, n in ((days[0], 7), (days[1], 5), (days[3], 5), (days[8], 30)) for i in range(n)], "dt string, is_bot boolean, repo_owner string, repo string, actor_login string")
    got = gold.trending(every, stars).first()
    assert (got.dt, got.stars, got.baseline_days, got.baseline, got.trend_score) == (days[8], 30, 7, 1.43, 18.33)


def test_dgim():
    def run(width, bits):
        sketch, out = sketches.Dgim(width), []
        for b in bits:
            sketch.update(b)
            out.append(sketch.count())
        return out

    assert run(10, [1] * 12) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]
    assert run(8, [1, 0] * 8) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4, 3, 3]
    assert run(3, [1, 0, 0, 0]) == [0, 0, 0, 0]


def test_bloom_and_fm(spark):
    assert [sketches.bloom_size(516, p) for p in sketches.RATES] == [(2472, 3), (3217, 4), (4945, 6), (7418, 9)]
    items = spark.createDataFrame([(f"i{n}",) for n in range(300)], "item string")
    m, k = sketches.bloom_size(300, 0.01)
    assert sketches.bloom_contains(items, "item", sketches.bloom_bits(items, "item", m, k), m, k).where("not maybe").count() == 0
    zeros = lambda z: spark.createDataFrame([(s, z) for s in range(64)], "seed int, zeros int")
    assert sketches.fm_estimate(zeros(0)).first()[0] == 0.77351 and sketches.fm_estimate(zeros(3)).first()[0] == 6.18808
    got = spark.createDataFrame([(8,), (1,), (0,)], "x long").select(sketches.trailing_zeros(F.col("x"))).collect()
    assert [r[0] for r in got] == [3, 0, 32]
    assert spark.range(1).select(sketches.seeded(F.lit(3), F.lit("abc"))).first()[0] == 3894671244


def test_recommender(spark):
    train = spark.createDataFrame([("u1", "A"), ("u1", "B"), ("u2", "A"), ("u2", "B"), ("u3", "A"), ("u3", "C"), ("u4", "A")], "user string, repo string")
    sims = {(r.repo_a, r.repo_b): round(r.sim, 5) for r in recommend.similarity(train.where("user != 'u4'")).collect()}
    assert sims == {("A", "B"): 0.8165, ("B", "A"): 0.8165, ("A", "C"): 0.57735, ("C", "A"): 0.57735}
    got = {r.repo: round(r.score, 5) for r in recommend.scores(train, recommend.similarity(train.where("user != 'u4'"))).where("user = 'u4'").collect()}
    assert got == {"B": 0.8165, "C": 0.57735}


def _stars(spark, monkeypatch):
    """Stars of 400 users, one of whom has most items; cells of 2,000 steps and blocks of 300 similarities. With them the scores by plain sums."""
    monkeypatch.setattr(recommend, "STEPS", 2000, raising=False)
    monkeypatch.setattr(recommend, "BLOCK", 300, raising=False)
    items = {f"u{i}": {f"r{(i * i + j * (7 + i % 5)) % 40}" for j in range(1 + i % 6)} for i in range(400)} | {"many": {f"r{i}" for i in range(38)}, "alone": {"none else's"}}
    train = spark.createDataFrame([(u, r) for u, own in items.items() for r in own], "user string, repo string")
    users, common = Counter(r for own in items.values() for r in own), Counter((a, b) for own in items.values() for a in own for b in own if a != b)
    want = defaultdict(float)
    for u, own in items.items():
        for (a, b), n in common.items():
            if a in own and b not in own:
                want[u, b] += n / math.sqrt(users[a] * users[b])
    return train, want, sum(n for (a, _), n in Counter((a, u) for u, own in items.items() for a, b in common if a in own).items())


def test_scores_are_dealt_by_the_rows_they_make(spark, monkeypatch):
    train, want, steps = _stars(spark, monkeypatch)
    got = recommend.scores(train, recommend.similarity(train))
    assert {(r.user, r.repo): r.score for r in got.collect()} == pytest.approx(dict(want), abs=1e-8)
    assert got.rdd.getNumPartitions() >= steps / 2000  # however few bytes the tables have
    most = max(got.groupBy(F.spark_partition_id()).count().toPandas()["count"])
    assert most < 2000
    assert recommend.scores(train.limit(0), recommend.similarity(train)).count() == recommend.scores(train, recommend.similarity(train.limit(0))).count() == 0


def test_hit_rates_rank_where_scores_are_made(spark, monkeypatch):
    stars, _, _ = _stars(spark, monkeypatch)
    split = [tuple(r) for r in recommend.holdout(stars).collect()]
    train, held = defaultdict(set), {u: r for u, r, h in split if h}
    for u, r, h in split:
        if not h:
            train[u].add(r)
    users, common = Counter(r for own in train.values() for r in own), Counter((a, b) for own in train.values() for a in own for b in own if a != b)
    ranks = []
    for u, item in held.items():
        score = defaultdict(float)
        for (a, b), n in common.items():
            if a in train[u] and b not in train[u]:
                score[b] += n / math.sqrt(users[a] * users[b])
        popular = sorted(users.keys() - train[u], key=lambda r: (-users[r], r))
        found = sorted(score, key=lambda r: (-round(score[r], 9), r)) or popular
        ranks.append([x.index(item) if item in x else 99 for x in (popular, found)])
    got = recommend.hit_rates(spark.createDataFrame(split, "user string, repo string, held boolean"))
    assert {r.k: (r.popularity_hit_rate, r.cf_hit_rate) for r in got.collect()} == {k: tuple(round(sum(r[i] < k for r in ranks) / len(ranks), 6) for i in (0, 1)) for k in (5, 10, 20)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[.*windowspecdefinition\(user#", plan)  # that would sort all candidates


def test_similarity_broadcasts_no_stars(spark):
    plan = recommend.similarity(spark.range(9).selectExpr("concat('u', id % 3) AS user", "concat('r', id) AS repo"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [user#" in plan and "BroadcastHashJoin [user#" not in plan


def test_graph(spark):
    rows = [("a1", "r1"), ("a1", "r2"), ("a2", "r1"), ("a2", "r2"), ("a3", "r2"), ("a3", "r3"), ("a4", "r4")] + [("many", f"x{i}") for i in range(51)]
    df = spark.createDataFrame([(a, r, False, "PushEvent", "o") for a, r in rows], "actor_login string, repo string, is_bot boolean, event_type string, repo_owner string")
    assert [tuple(r) for r in graph.edges(df).collect()] == [("o/r1", "o/r2", 2)]
    two = spark.createDataFrame([("1", "2", 1), ("2", "3", 1), ("1", "3", 1), ("4", "5", 1), ("5", "6", 1), ("4", "6", 1)], "src string, dst string, weight long")
    parts = graph.components(two)
    assert {r.node: r.component for r in parts.collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "4"}
    assert graph.modularity(two, parts).first().modularity == 0.5
    assert graph.modularity(two, parts.withColumn("component", F.lit("x"))).first().modularity == 0
    bridged = two.unionByName(spark.createDataFrame([("3", "4", 1)], "src string, dst string, weight long"))
    assert {r.node: r.community for r in graph.louvain(bridged).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "4"}
    first = [r for r in graph.girvan_newman_top(bridged).collect() if r.split == 1]
    assert {r.node: r.part for r in first} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "4"}


def test_documents(spark):
    docs = spark.sql("""SELECT * FROM VALUES
      ('1', 'PushEvent', named_struct('login', 'A'), named_struct('name', 'o/r'), named_struct('action', 'x', 'commits', array(named_struct('message', CAST(NULL AS STRING)), named_struct('message', 'abcd')))),
      ('2', 'PushEvent', named_struct('login', 'B[BOT]'), named_struct('name', 'o/r'), named_struct('action', 'x', 'commits', array(named_struct('message', 'ab')))),
      ('3', 'IssuesEvent', named_struct('login', 'B[BOT]'), named_struct('name', 'o/r'), named_struct('action', CAST(NULL AS STRING), 'commits', NULL))
      AS t(id, type, actor, repo, payload)""")
    assert tuple(docstore.commit_stats(docs).first()) == ("o/r", 3, 2.0)
    assert docstore.issue_lifecycle(docs).first().action is None
    assert docstore.distinct_logins(docs).count() == 1
    assert docstore.delete_one(docs, F.col("type") == "PushEvent", "id").count() == 2
    assert docstore.update(docs, F.col("id") == "1", "payload.action", F.lit("y")).where("payload.action = 'y'").count() == 1
