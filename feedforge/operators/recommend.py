"""Item-based collaborative filtering with leave-one-out evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

KS = (5, 10, 20)
#: Steps (a user's item with one of its neighbours) in one cell of scores(), and similarities in one block of repositories.
STEPS, BLOCK = 500_000, 100_000


def interactions(stars: DataFrame) -> DataFrame:
    """Distinct (user, repo) of people; missing logins are left out."""
    return stars.where(F.col("actor_login").isNotNull() & ~F.col("actor_login").rlike(r"(?i)\[bot\]$")).select(F.col("actor_login").alias("user"), F.concat("repo_owner", F.lit("/"), "repo").alias("repo")).distinct()


def holdout(pairs: DataFrame, least: int = 2) -> DataFrame:
    """pairs with held: the one item of each user with `least` or more that comes first by md5."""
    w = Window.partitionBy("user")
    first = F.row_number().over(w.orderBy(F.md5(F.concat("user", F.lit(":"), "repo").cast("binary")), "repo")) == 1
    return pairs.select("user", "repo", (first & (F.count("*").over(w) >= least)).alias("held"))


def popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("repo").agg(F.count("*").alias("users"))


def similarity(train: DataFrame) -> DataFrame:
    """(repo_a, repo_b, sim) for ordered pairs with a common user: common / sqrt(users_a * users_b). Pairs are made once, a < b, and mirrored after counting."""
    # both sides grow with the users, but take so few bytes in a file that Spark would broadcast millions of rows
    a, b = train.select("user", F.col("repo").alias("repo_a")), train.select("user", F.col("repo").alias("repo_b"))
    both = a.hint("merge").join(b, "user").where("repo_a < repo_b").groupBy("repo_a", "repo_b").agg(F.count("*").alias("n"))
    size = popularity(train)
    both = both.join(size.select(F.col("repo").alias("repo_a"), F.col("users").alias("_a")), "repo_a").join(size.select(F.col("repo").alias("repo_b"), F.col("users").alias("_b")), "repo_b")
    half = both.select("repo_a", "repo_b", (F.col("n") / F.sqrt(F.col("_a") * F.col("_b"))).alias("sim"))
    return half.unionByName(half.select(F.col("repo_b").alias("repo_a"), F.col("repo_a").alias("repo_b"), "sim"))


def scores(train: DataFrame, sims: DataFrame) -> DataFrame:
    """(user, repo, score): summed similarity to the user's items, for items not among them.

    The sum has a row for each item of a user and each of its neighbours, many times the rows of
    either table; Spark sizes partitions by the bytes of those. So they are dealt by the number of rows to
    come: cells of a group of users and a block of candidates, of STEPS rows on average. A cell gets
    its users' items and its block's similarities, and all its sums are made there. sims is read
    more than once, so it should be staged; a user may be of any type that can be grouped.
    """
    degrees = sims.groupBy("repo_a").agg(F.count("*").alias("n")).join(popularity(train).withColumnRenamed("repo", "repo_a"), "repo_a")
    links, steps = degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("users")), F.lit(0))).first()
    blocks = -(-links // BLOCK) or 1
    groups = -(-steps // (blocks * STEPS)) or 1
    block = lambda repo: F.pmod(F.xxhash64(repo), F.lit(blocks))
    cell = (F.col("_group") * blocks + F.col("_block")).cast("int").alias("_cell")
    near = sims.withColumn("_block", block("repo_b"))
    # an item goes to the blocks of its neighbours, and to its own, where it is struck out
    reach = near.groupBy(F.col("repo_a").alias("repo")).agg(F.collect_set("_block").alias("_blocks"))
    own = F.array(block("repo"))
    items = train.join(reach, "repo", "left").withColumn("_group", F.pmod(F.xxhash64("user"), F.lit(groups)))
    items = items.withColumn("_block", F.explode(F.coalesce(F.array_union("_blocks", own), own)))
    items = items.select(cell, "repo", "user", F.lit(None).cast("struct<repo: string, sim: double>").alias("_near"))
    every = near.sparkSession.range(0, groups, 1, -(-groups // 16)).withColumnRenamed("id", "_group")
    near = near.hint("shuffle_replicate_nl").crossJoin(every)  # in tasks of 16 groups; a broadcast would leave all copies to the few tasks that read sims
    near = near.select(cell, F.col("repo_a").alias("repo"), F.lit(None).cast(train.schema["user"].dataType).alias("user"), F.struct(F.col("repo_b").alias("repo"), "sim").alias("_near"))
    cells = items.unionByName(near).repartitionById(groups * blocks, "_cell")
    met = cells.groupBy("_cell", "repo").agg(F.collect_list("user").alias("_users"), F.collect_list("_near").alias("_near"))
    met = met.withColumn("_near", F.concat("_near", F.array(F.struct("repo", F.lit(None).cast("double").alias("sim")))))
    steps = met.select("_cell", "repo", "_near", F.explode("_users").alias("user")).select("_cell", "user", F.col("repo").alias("_own"), F.inline("_near"))
    raw = steps.groupBy("_cell", "user", "repo").agg(F.round(F.sum("sim"), 9).alias("score"), F.max(F.col("repo") == F.col("_own")).alias("_known"))
    return raw.where("not _known").select("user", "repo", "score")


def hit_rates(split: DataFrame, ks=KS) -> DataFrame:
    """k, popularity_hit_rate, cf_hit_rate, gain_pct over users with a held-out item. Users without any candidate get the popular items.

    Only the rank of the held-out item is needed. Among popular items it is its rank among all less
    the user's own items before it; an item below the first max(ks) plus the longest history can't
    be a hit, so that many are ranked. Among candidates it is the number of those before it, which
    are counted where their scores are made: the held-out item's own score goes there with the user.
    """
    train, test = split.where("not held").select("user", "repo"), split.where("held").select("user", "repo")
    longest = train.groupBy("user").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    top = popularity(train).orderBy(F.desc("users"), "repo").limit(max(ks) + longest)
    top = top.select("repo", F.row_number().over(Window.orderBy(F.desc("users"), "repo")).alias("_at"))
    at = test.join(top, "repo")
    own = train.join(top.select("repo", F.col("_at").alias("_own")), "repo").select("user", "_own")
    popular = at.join(own, "user", "left").groupBy("user", "_at").agg(F.count_if(F.col("_own") < F.col("_at")).alias("_n")).select("user", (F.col("_at") - F.col("_n")).alias("p"))
    sims = staged(similarity(train), "similarity")
    held = test.withColumnRenamed("repo", "_held")
    asked = train.join(held, "user")
    mine = asked.join(sims, (F.col("repo") == F.col("repo_a")) & (F.col("_held") == F.col("repo_b"))).groupBy("user").agg(F.round(F.sum("sim"), 9).alias("_mine"))
    asked = asked.join(mine, "user", "left").select(F.struct("user", "_held", "_mine").alias("user"), "repo")
    before = (F.col("score") > F.col("_mine")) | ((F.col("score") == F.col("_mine")) & (F.col("repo") < F.col("_held")))
    found = scores(asked, sims).select("user.*", "repo", "score")
    ranked = found.groupBy("user").agg((F.count_if(before & (F.col("repo") != F.col("_held"))) + 1).alias("_c"), F.max("_mine").alias("_mine"))
    both = test.join(popular, "user", "left").join(ranked, "user", "left")
    both = both.select("p", F.when(F.col("_c").isNull(), F.col("p")).when(F.col("_mine").isNotNull(), F.col("_c")).alias("c"))
    hit = lambda c, k: F.avg(F.when(F.col(c) <= k, 1).otherwise(0))
    rates = both.agg(*[hit(c, k).alias(f"{c}{k}") for c in "pc" for k in ks])
    rows = rates.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("_p"), F.col(f"c{k}").alias("_c")) for k in ks])).alias("r")).select("r.*")
    gain = F.when(F.col("_p") > 0, (F.col("_c") - F.col("_p")) / F.col("_p") * 100).otherwise(0.0)
    return rows.select("k", F.round("_p", 6).alias("popularity_hit_rate"), F.round("_c", 6).alias("cf_hit_rate"), F.round(gain, 4).alias("gain_pct"))
