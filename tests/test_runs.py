"""Whole runs on a small lake, and the plans that the design relies on."""

import gzip
import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from feedforge.operators import docstore, gold, graph, ingest, storage
from feedforge.plans import daily, metrics
from feedforge.sources import files
from feedforge.sources.tables import activity

from test_fixtures import HOUR0, HOUR1


def test_daily_run(spark, tmp_path):
    lake = str(tmp_path / "lake")
    ingest.write_known_bots(spark.createDataFrame([("farm1",)], "login string"), lake + "/known_bots/source=config")
    for hr, lines in ((0, HOUR0), (1, HOUR1)):
        with gzip.open(tmp_path / f"2024-09-28-{hr}.json.gz", "wt") as f:
            f.write("\n".join(lines))
        record = daily.ingest_hour(spark, str(tmp_path / f"2024-09-28-{hr}.json.gz"), lake, datetime(2024, 9, 28, hr, tzinfo=UTC), min_lines=1, max_bad=0.5)
        assert record["status"] == "ok" and record["lines"] == len(lines), json.dumps(record)
    assert daily.ingest_hour(spark, str(tmp_path / "2024-09-28-1.json.gz"), lake, datetime(2024, 9, 28, 2, tzinfo=UTC))["status"] == "failed"
    for _ in range(2):  # a second run changes nothing
        daily.run_daily(spark, lake)
        count = lambda name: spark.read.parquet(f"{lake}/{name}").count()
        assert [count(f"silver/{t}") for t in ("events", "stars", "issues", "comments", "commits")] == [5, 1, 1, 1, 4]
        assert count("gold/event_mix") == 5 and count("gold/bot_scores") == 1 and count("gold/farmed_repos") == 0
        assert ingest.read_tsv(spark, f"{lake}/exports/event_mix", "era string, event_type string, events long, pct double", header=True).count() == 5
    log = {r["hour"]: r for r in ingest.upsert_log(spark.read.parquet(f"{lake}/ingest_log")).collect()}
    assert {h: r["status"] for h, r in log.items()} == {"2024-09-28-0": "ok", "2024-09-28-1": "ok", "2024-09-28-2": "failed"} and "lines" in log["2024-09-28-2"]["error"]


def test_clustered_table_and_plan(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.write_clustered(spark.range(1000).select("id", F.concat(F.lit("r"), (F.col("id") % 10).cast("string")).alias("repo"), F.lit(1).alias("other")), path, "repo", bloom="repo")
    found = spark.read.parquet(path).where("repo = 'r3'").select("id")
    summary = storage.plan_summary(found)
    assert found.count() == 100 and "EqualTo(repo,r3)" in summary["pushed_filters"][0] and "other" not in summary["read_schema"][0] and summary["exchanges"] == 0


def test_gold_plans_prune_and_shuffle_once(spark):
    summary = storage.plan_summary(gold.hourly_activity(activity(spark, "/root/testdata/sf0.001")))
    assert summary["exchanges"] == 1 and summary["joins"] == 0 and "value" not in summary["read_schema"][0]


def test_database(spark):
    storage.create_database(spark, "feed_test")
    assert spark.catalog.databaseExists("feed_test")
    spark.sql("DROP DATABASE feed_test")


def test_steps_after_the_daily_run(spark, tmp_path):
    lake = str(tmp_path / "lake")
    activity(spark, "/root/testdata/sf0.01").drop("user_id", "k").write.parquet(f"{lake}/silver/events")
    for step in metrics.STEPS:
        step(spark, lake)
    lines = lambda name: spark.read.option("sep", "\t").option("header", True).csv(f"{lake}/exports/{name}").count()
    assert lines("bloom_filter") == 4 and lines("user_sample") == 1 and lines("recommender") == 3 and lines("network_nodes") == 50 and lines("network_edges") > 0
    small = metrics.sketch_frames(spark.read.parquet(f"{lake}/silver/events"), every=500, width=500, most=1200)
    assert [r["events_processed"] for r in small["recent_stars"].orderBy("events_processed").collect()] == [500, 1000] and small["distinct_counts"].count() == 2


def test_landing_files(spark, tmp_path):
    at, key = datetime(2024, 9, 28, 1, tzinfo=UTC), "2024-09-28-1.json.gz"
    (tmp_path / key).write_bytes(b"x" * 1000)
    landing = str(tmp_path / "landing")
    assert files.resolve(spark, landing, at) is None
    for odd in ("2024-09-28-11.json.gz", "copy-2024-09-28-1.json.gz"):
        files.put(spark, str(tmp_path / key), f"{landing}/2024/09/28/{odd}")
    assert files.resolve(spark, landing, at).endswith("copy-2024-09-28-1.json.gz")
    assert files.put(spark, str(tmp_path / key), f"{landing}/2024-09-28/1/{key}") == files.resolve(spark, landing, at)
    assert not files.exists(spark, f"{landing}/2024-09-28/1/{key}.part")
    answers = iter([False, OSError(), True])

    def ready():
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    slept = []
    assert files.wait_until(ready, 300, 7200, slept.append) and slept == [300, 300]
    assert not files.wait_until(lambda: False, 300, 600, slept.append)


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("FF_KEPT", "old")
    monkeypatch.delenv("FF_NEW", raising=False)
    (tmp_path / ".env").write_text("# FF_NO=1\n\nFF_KEPT=new\n FF_NEW = a=b \n")
    assert files.load_settings(str(tmp_path / ".env")) == {"FF_KEPT": "old", "FF_NEW": "a=b"} and files.load_settings(str(tmp_path / "none")) == {}


def test_bulk_load_counts_failures(spark, tmp_path):
    rows = ingest.parse_lines(spark.createDataFrame([(x,) for x in HOUR0 + HOUR1], "value string"))
    path = str(tmp_path / "t")
    for drop, total in ((False, 6), (False, 12), (True, 6)):
        got = ingest.load(rows, path, drop=drop)
        assert (got["inserted"], got["failed"]) == (6, 1) and got["rate"] > 0 and spark.read.parquet(path).count() == total


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1, "2024-09-28"), (None, 2, "2024-09-29")], "login string, n int, dt string")
    ingest.write_tsv(df, str(tmp_path / "t"), "dt")
    assert sorted(ingest.read_tsv(spark, str(tmp_path / "t"), df.schema).collect(), key=lambda r: r["n"]) == df.collect()


def test_execution_before_and_after_clustering(spark, tmp_path):
    rows = spark.range(200000).select("id", F.concat(F.lit("r"), (F.col("id") % 1000).cast("string")).alias("repo"))
    rows.write.parquet(str(tmp_path / "plain"))
    storage.write_clustered(rows, str(tmp_path / "clustered"), "repo", bloom="repo")
    took = [storage.executed(spark.read.parquet(str(tmp_path / p)).where("repo = 'r500'")) for p in ("plain", "clustered")]
    assert [t["rows_returned"] for t in took] == [200, 200] and took[0]["rows_examined"] >= took[1]["rows_examined"] > 0


def test_limits_and_stamps(spark):
    ev = activity(spark, "/root/testdata/sf0.001")
    assert graph.edges(ev, 1, most_events=10).count() <= graph.edges(ev, 1).count()
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, action string")
    got = docstore.update(docs, F.col("id") == 1, "action", F.lit("c"), stamp="changed_at").orderBy("id").collect()
    assert got[0]["action"] == "c" and got[0]["changed_at"] is not None and got[1]["action"] == "b" and got[1]["changed_at"] is None
