"""Word count over messages: letters only, no short words, no stop-words, most frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 3

# Words that don't count.
STOP_WORDS = """
the and for with from this that these those into onto when then than not are was were been being has have had but also only can
will all any some its our out you your use using used now via per too very just more most such other each there their them they
which what who how why where while after before about should would could does did into over under between
signed off authored reviewed http https www com org html
""".split()


def parse_stop_words(text: str) -> set[str]:
    """One word a line; blank lines and lines that begin with # don't count."""
    return {x.lower() for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")}


def tokens(messages: DataFrame, text: str, *kept: str) -> DataFrame:
    """kept columns and word: every non-empty run of letters a-z of the lower-case text."""
    words = messages.select(*kept, F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word"))
    return words.where("word != ''")


def _counts(word: Column, stop: list[str]) -> Column:
    return (F.length(word) >= MIN_LENGTH) & ~word.isin(stop)


def word_count(messages: DataFrame, text: str, stop: list[str] = STOP_WORDS) -> DataFrame:
    return tokens(messages, text).where(_counts(F.col("word"), stop)).groupBy("word").agg(F.count("*").alias("count"))


def top_words(counts: DataFrame, most: int = 50) -> DataFrame:
    return counts.orderBy(F.desc("count"), "word").limit(most)


def raw_counters(rows: DataFrame, skip_bots: bool = True, stop: list[str] = STOP_WORDS) -> DataFrame:
    """One row over the parsed feed (ingest.parse_lines): records, bad_records, commits, bot_commits_skipped and the fates of tokens.

    Words are counted within their row, so there is one scan and one aggregate. A missing message has no words; a missing login isn't a bot's.
    """
    commits = F.coalesce(F.when(F.col("type") == "PushEvent", F.col("payload.commits")), F.array().cast("array<struct<sha:string,message:string>>"))
    bot = F.coalesce(F.col("actor.login").endswith("[bot]"), F.lit(False)) & F.lit(skip_bots)
    read = rows.select(F.col("_corrupt").isNotNull().alias("bad"), bot.alias("bot"), commits.alias("commits"))
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(c["message"], F.lit(""))), "[^a-z]+"), lambda w: w != "")
    each = read.select("bad", "bot", F.size("commits").cast("long").alias("n"), F.when(F.col("bot"), F.array().cast("array<string>")).otherwise(F.flatten(F.transform("commits", split))).alias("words"))
    size = lambda test: F.size(F.filter("words", test)).cast("long")
    long = lambda w: F.length(w) >= MIN_LENGTH
    return each.agg(
        F.count("*").alias("records"), F.count_if("bad").alias("bad_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("commits"),
        F.coalesce(F.sum(F.when(F.col("bot"), F.col("n")).otherwise(0)), F.lit(0)).alias("bot_commits_skipped"),
        F.coalesce(F.sum(size(lambda w: ~long(w))), F.lit(0)).alias("short_tokens_skipped"),
        F.coalesce(F.sum(size(lambda w: long(w) & w.isin(stop))), F.lit(0)).alias("stopwords_skipped"),
        F.coalesce(F.sum(size(lambda w: _counts(w, stop))), F.lit(0)).alias("words_emitted"),
    )


def counters(messages: DataFrame, text: str, bot: str | None = None, stop: list[str] = STOP_WORDS) -> DataFrame:
    """What was read, emitted and skipped, and why, in one row."""
    rows = messages if bot is None else messages.where(~F.col(bot))
    words = tokens(rows, text)
    short = F.length("word") < MIN_LENGTH
    stopped = ~short & F.col("word").isin(stop)
    per_word = words.agg(F.count_if(short).alias("short_tokens_skipped"), F.count_if(stopped).alias("stopwords_skipped"), F.count_if(~short & ~stopped).alias("words_emitted"))
    per_row = messages.agg(F.count("*").alias("records"), (F.count_if(F.col(bot)) if bot else F.lit(0).cast("long")).alias("bot_records_skipped"))
    return per_row.crossJoin(per_word)
