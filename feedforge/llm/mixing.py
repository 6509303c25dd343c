"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the size of the whole
corpus; a target stops at MOST times its source's size, and the excess goes to the others by
weight until none is above. That is the level L at which the sum of min(cap, L * weight) is the
whole size, found in one pass over sources sorted by cap / weight.

Each source's weight over training time runs linearly between given levels at given times. Its
integral is the source's cumulative demand of tokens; a document's place in the source's token
sequence, put through the inverse of that integral, is its position in training, 0 to 1.
Documents stand in their source in order of an md5 of id and text, and the sequence repeats until
the target is met: a document is taken once for every full pass, and once more if its middle lies
within the rest. Documents are range-sorted by position.

Token offsets are prefix sums in two levels: within (source, bucket of the hash), and over the
buckets of a source. Buckets split a source that holds most rows over many tasks.

Null texts have size 0 and are never taken when their source has nothing to repeat; a null source
is one source, named last. Repeated rows are placed one after another; which of several identical
rows comes first can't be seen. Empty tables give no rows. `curriculum` keeps all columns; columns
that it adds replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import staged

WEIGHTS = (1, 2, 3)
MOST = 3
#: Times at which weights are given, and the relative level of a source of each weight at them.
TIMES = (0.0, 1.0)
LEVELS = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}
#: Buckets of a source: the top bits of a 60-bit hash.
BUCKET_BITS = 12


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place, bucket[, _row]): the place is a hash that orders a source's documents."""
    text = F.coalesce("text", F.lit(""))
    place = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")), 1, 15), 16, 10).cast("long")
    kept = ["_row"] if "_row" in docs.columns else []
    out = docs.select("doc_id", "source", F.regexp_count(text, F.lit(common.WORD_PATTERN)).cast("long").alias("size"), place.alias("place"), *kept)
    return out.withColumn("bucket", F.shiftrightunsigned("place", 60 - BUCKET_BITS).cast("int")).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))


def targets(totals: DataFrame) -> DataFrame:
    """(_key, source_size, weight, target) from (_key, size); one row for each source."""
    ordered = Window.orderBy(F.col("_key") == "", "_key")
    per = totals.groupBy("_key").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("nth", F.row_number().over(ordered))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("nth") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.lit(MOST) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    per = per.withColumns({
        "whole": F.sum("source_size").over(Window.partitionBy()),
        "capped": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    per = per.withColumn("level", (F.col("whole") - F.col("capped")).cast("double") / F.col("open"))
    per = per.withColumn("level", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    per = per.withColumn("level", F.max("level").over(Window.partitionBy()))
    cap = F.col("cap").cast("double")
    return per.select("_key", "source_size", "weight", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def position(share: Column, weight: Column, times: Sequence[float] = TIMES, levels: dict[int, Sequence[float]] = LEVELS) -> Column:
    """Training time at which the given share of a source's demand is met.

    Between two times the demand is quadratic; its inverse is 2r / (a + sqrt(a^2 + 2cr)) for the
    demand r still open, the level a at the earlier time and the slope c.
    """
    out = None
    for w, level in levels.items():
        areas = [(a + b) / 2 * (v - u) for a, b, u, v in zip(level, level[1:], times, times[1:], strict=False)]
        whole, met, found = sum(areas), 0.0, F.lit(float(times[-1]))
        steps = []
        for i, area in enumerate(areas):
            r = share * F.lit(whole) - F.lit(met)
            slope = (level[i + 1] - level[i]) / (times[i + 1] - times[i])
            steps.append((share * F.lit(whole) < F.lit(met + area), F.lit(float(times[i])) + F.lit(2.0) * r / (F.lit(float(level[i])) + F.sqrt(F.lit(float(level[i]) ** 2) + F.lit(2.0 * slope) * r))))
            met += area
        for when, at in reversed(steps):
            found = F.when(when, at).otherwise(found)
        out = F.when(weight == w, found) if out is None else out.when(weight == w, found)
    return out


def placements(sized: DataFrame) -> DataFrame:
    """sized with source_size, target, before (tokens of the source before the document), copies and taken."""
    totals = sized.groupBy("_key", "bucket").agg(F.sum("size").alias("size"))
    earlier = F.coalesce(F.sum("size").over(Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = totals.select("_key", "bucket", earlier.alias("_earlier")).join(targets(totals), "_key")
    within = Window.partitionBy("_key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.withColumn("_within", F.sum("size").over(within) - F.col("size")).join(buckets, ["_key", "bucket"])
    out = out.withColumn("before", F.col("_earlier") + F.col("_within"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST).cast("long"))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("_passes", passes)
    rest = F.col("target") - (F.col("_passes") * F.col("source_size")).cast("double")
    again = (F.col("before").cast("double") + F.col("size") / F.lit(2.0)) < rest
    return out.withColumn("copies", (F.col("_passes") + F.when(again, 1).otherwise(0)).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))


def _share(copy: Column) -> Column:
    """Of the source's demand, the part before the middle of the document's copy."""
    offset = (copy * F.col("source_size") + F.col("before")).cast("double") + F.col("size") / F.lit(2.0)
    return F.when(F.col("target") > 0, F.least(F.lit(1.0), offset / F.col("target"))).otherwise(F.lit(0.0))


def curriculum(docs: DataFrame) -> DataFrame:
    """The columns of docs with copy (from 0) and position: a row for each copy taken, range-sorted by position."""
    docs = docs.drop("copy", "position")
    row = common.free_name(docs, "_row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed = placements(staged(sizes(numbered.select("doc_id", "source", "text", F.col(row).alias("_row"))), "sizes")).where("copies > 0")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.select(F.col("_row").alias(row), "copy", position(_share(F.col("copy")), F.col("weight")).alias("position"))
    return numbered.join(placed, row).orderBy("position", row, "copy").drop(row)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placements(staged(sizes(common.documents(spark, sf_dir)), "sizes"))
    first = F.when(F.col("copies") > 0, position(_share(F.lit(0)), F.col("weight")))
    out = placed.select("doc_id", "size", "source_size", "target", "taken", F.round(first, 6).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents
), per AS (
  SELECT *, [1, 2, 3][((nth - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM (
    SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k = '', k) AS nth FROM sized GROUP BY k)
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM per
), mixed AS (
  SELECT k, source_size, weight, least(cap::DOUBLE, coalesce(max(CASE WHEN lv * weight < cap THEN lv END) OVER () * weight, cap::DOUBLE)) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, weight, target,
    (sum(size) OVER (PARTITION BY k ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes
  FROM sized JOIN mixed USING (k)
), counted AS (
  SELECT *, passes + CASE WHEN before::DOUBLE + size / 2.0 < target - (passes * source_size)::DOUBLE THEN 1 ELSE 0 END AS copies,
    CASE WHEN target > 0 THEN least(1.0::DOUBLE, (before::DOUBLE + size / 2.0) / target) ELSE 0.0 END AS share
  FROM placed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN share >= 1 THEN 1.0 WHEN weight = 1 THEN 2.0 * share / (1.5 + sqrt(2.25 - 2.0 * share))
    WHEN weight = 2 THEN 2.0 * share / (1.0 + sqrt(1.0 + 0.0 * share)) ELSE 2.0 * share / (0.5 + sqrt(0.25 + 2.0 * share)) END, 6) END AS position
FROM counted
"""
