"""Stream sketches as aggregates: Bloom filter, Flajolet-Martin, DGIM, sampling, with their exact counterparts.

A total order of arrivals is (created_at, event_id). Sequence numbers are prefix sums in two
levels (within a day, and over the days), so no window holds the whole stream.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded, trailing_zeros

#: The estimator's constant; it multiplies.
ALPHA = 0.77351
HASHES, PER_BUCKET = 64, 8
RATES = (0.10, 0.05, 0.01, 0.001)


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for n items at a false positive rate; one of each at least."""
    m = max(1, int(-n * math.log(rate) / math.log(2) ** 2))
    return m, max(1, int(m / max(1, n) * math.log(2)))


def bloom_places(item: Column, m: Column | int, k: int) -> Column:
    """Bit places by double hashing."""
    h1, h2 = seeded(F.lit(1), item), seeded(F.lit(2), item)
    m = F.lit(m) if isinstance(m, int) else m
    return F.array(*[F.pmod(h1 + F.lit(i) * h2, m) for i in range(k)])


def bloom_bits(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The filter as the distinct places of set bits."""
    return items.select(F.explode(bloom_places(F.col(column), m, k)).alias("bit")).distinct()


def bloom_contains(probes: DataFrame, column: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """probes with maybe: whether all places of the item are set. Repeated probes stay."""
    each = probes.select(column).distinct().select(column, F.explode(F.array_distinct(bloom_places(F.col(column), m, k))).alias("bit"))
    hits = each.join(bits.withColumn("_set", F.lit(True)), "bit", "left").groupBy(column).agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("maybe"))
    return probes.join(hits, column)


def bloom_fpr(trained: DataFrame, probes: DataFrame, column: str, rates=RATES) -> DataFrame:
    """A row for each target rate: m, k, actual and theoretical rate of false positives."""
    n = trained.select(column).distinct().count()
    out = None
    for rate in rates:
        m, k = bloom_size(n, rate)
        row = bloom_contains(probes, column, bloom_bits(trained, column, m, k), m, k).agg(F.avg(F.col("maybe").cast("int")).alias("actual_fpr"))
        row = row.select(F.lit(rate).alias("target_fpr"), F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"), F.round(F.coalesce("actual_fpr", F.lit(0.0)), 6).alias("actual_fpr"), F.round(F.lit((1 - math.exp(-k * n / m)) ** k), 5).alias("theoretical_fpr"))
        out = row if out is None else out.unionByName(row)
    return out


def fm_registers(items: DataFrame, column: str, hashes: int = HASHES, *by: str) -> DataFrame:
    """Most trailing zeros of each seed's hashes over the distinct items (of each group)."""
    each = items.select(*by, F.col(column).alias("_item")).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("seed"))
    return each.groupBy(*by, "seed").agg(F.max(trailing_zeros(seeded(F.col("seed"), F.col("_item")))).alias("zeros"))


def fm_estimate(registers: DataFrame, *by: str) -> DataFrame:
    """Median over buckets of registers of ALPHA * 2^mean."""
    buckets = registers.groupBy(*by, F.floor(F.col("seed") / PER_BUCKET).alias("_b")).agg((F.lit(ALPHA) * F.pow(F.lit(2.0), F.avg("zeros"))).alias("_e"))
    return buckets.groupBy(*by).agg(F.round(F.median("_e"), 6).alias("estimate"))


def replay(events: DataFrame, most: int | None = None) -> DataFrame:
    """Events in order of arrival, the first `most` of them if given; without a limit the order is left to `sequenced`, which needs no global sort."""
    return events if most is None else events.orderBy("created_at", "event_id").limit(most)


def sequenced(events: DataFrame) -> DataFrame:
    """events with seq, from 1 in order of arrival."""
    per = events.groupBy("dt").agg(F.count("*").alias("_n"))
    per = per.select("dt", (F.sum("_n").over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return events.withColumn("_in", F.row_number().over(Window.partitionBy("dt").orderBy("created_at", "event_id"))).join(F.broadcast(per), "dt").withColumn("seq", F.col("_in") + F.col("_before")).drop("_in", "_before")


def running_distinct(events: DataFrame, column: str, every: int) -> DataFrame:
    """events_processed, exact: distinct values among the arrivals up to each checkpoint that is reached."""
    seq = sequenced(events)
    first = seq.groupBy(column).agg(F.min("seq").alias("seq")).groupBy(F.ceil(F.col("seq") / every).alias("c")).agg(F.count("*").alias("new"))
    marks = seq.agg(F.max("seq").alias("n")).select(F.explode(F.expr(f"CASE WHEN n >= {every} THEN sequence(1L, n div {every}) ELSE array() END")).alias("c"))
    return marks.join(first, "c", "left").select((F.col("c") * every).alias("events_processed"), F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)).alias("exact"))


def fm_checkpoints(events: DataFrame, column: str, every: int, hashes: int = HASHES) -> DataFrame:
    """events_processed, estimate, exact, error_pct at each checkpoint, from prefix maxima of the registers."""
    first = sequenced(events).groupBy(column).agg(F.min("seq").alias("seq")).select(F.ceil(F.col("seq") / every).alias("c"), F.col(column).alias("_item"))
    each = first.select("c", "_item", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("seed"))
    zeros = each.groupBy("c", "seed").agg(F.max(trailing_zeros(seeded(F.col("seed"), F.col("_item")))).alias("zeros"))
    exact = running_distinct(events, column, every).withColumn("c", (F.col("events_processed") / every).cast("long"))
    grid = exact.select("c").crossJoin(events.sparkSession.range(hashes).select(F.col("id").cast("int").alias("seed")))
    running = F.max("zeros").over(Window.partitionBy("seed").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    registers = grid.join(zeros, ["c", "seed"], "left").select("c", "seed", F.coalesce(running, F.lit(0)).alias("zeros"))
    est = fm_estimate(registers, "c")
    return exact.join(est, "c").select("events_processed", "estimate", "exact", F.round(F.abs(F.col("estimate") - F.col("exact")) / F.col("exact") * 100, 4).alias("error_pct"))


def sliding_ones(events: DataFrame, bit: Column, width: int) -> DataFrame:
    """event_id, seq, ones: set bits among the last `width` arrivals, as a difference of prefix sums."""
    seq = sequenced(events.withColumn("_bit", bit.cast("long")))
    per = seq.groupBy("dt").agg(F.sum("_bit").alias("_n"))
    per = per.select("dt", (F.sum("_n").over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    prefix = seq.withColumn("_p", F.sum("_bit").over(Window.partitionBy("dt").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(per), "dt")
    prefix = prefix.select("event_id", "seq", (F.col("_p") + F.col("_before")).alias("p"))
    old = prefix.select((F.col("seq") + width).alias("seq"), F.col("p").alias("q"))
    return prefix.join(old, "seq", "left").select("event_id", "seq", (F.col("p") - F.coalesce("q", F.lit(0))).alias("ones"))


def sampled(events: DataFrame, column: str, one_in: int = 10) -> DataFrame:
    """All events of the users whose hash falls in one of `one_in` buckets."""
    return events.where(F.pmod(seeded(F.lit(0), F.col(column)), F.lit(one_in)) == 0)


class Dgim:
    """Approximate ones among the last `width` bits. levels[i] holds, newest first, the times at which
    groups of 2^i ones ended, two at most; the oldest group counts by half."""

    def __init__(self, width: int, clock: int = 0, levels: list[list[int]] | None = None):
        self.width, self.clock, self.levels = width, clock, [deque(x) for x in levels or []]

    def update(self, bit: int) -> None:
        self.clock += 1
        if self.levels and self.levels[-1][-1] <= self.clock - self.width:
            self.levels[-1].pop()
            if not self.levels[-1]:
                self.levels.pop()
        ended = self.clock if bit else None
        for level in self.levels:
            if ended is None:
                return
            level.appendleft(ended)
            ended = None
            if len(level) > 2:
                level.pop()
                ended = level.pop()
        if ended is not None:
            self.levels.append(deque([ended]))

    def count(self) -> int:
        if not self.levels:
            return 0
        oldest = 1 << len(self.levels) - 1
        return sum(len(level) << i for i, level in enumerate(self.levels)) - oldest + oldest // 2

    def state(self) -> list[list[int]]:
        return [list(level) for level in self.levels]


def dgim_by_key(events: DataFrame, key: str, bit: Column, width: int) -> DataFrame:
    """key, arrivals, estimate, exact of the last `width` arrivals of each key; a key's arrivals are read in order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bits = group.sort_values(["created_at", "event_id"])["bit"].tolist()
        sketch = Dgim(width)
        for b in bits:
            sketch.update(b)
        return pd.DataFrame({key: [group[key].iloc[0]], "arrivals": [len(bits)], "estimate": [sketch.count()], "exact": [int(sum(bits[-width:]))]})

    rows = events.select(key, "created_at", "event_id", bit.cast("int").alias("bit"))
    return rows.groupBy(key).applyInPandas(run, f"{key} string, arrivals long, estimate long, exact long")


def dgim_checkpoints(events: DataFrame, bit: Column, width: int) -> DataFrame:
    """events_processed, estimate, exact, error_pct of the last `width` arrivals of the whole stream, after every `width` arrivals.

    What lies before the window never counts, so each window is a group of its own, `width` rows long: no task reads the whole stream.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bits, sketch = group.sort_values("seq")["bit"].tolist(), Dgim(width)
        for b in bits:
            sketch.update(b)
        return pd.DataFrame({"events_processed": [int(group["seq"].max())], "estimate": [sketch.count()], "exact": [int(sum(bits))]})

    seq = sequenced(events.select("dt", "created_at", "event_id", F.coalesce(bit, F.lit(False)).cast("int").alias("bit")))
    rows = seq.select("seq", "bit", F.ceil(F.col("seq") / width).alias("c"))
    each = rows.groupBy("c").applyInPandas(run, "events_processed long, estimate long, exact long").where(F.col("events_processed") % width == 0)
    return each.withColumn("error_pct", F.round(F.try_divide(F.abs(F.col("estimate") - F.col("exact")), F.col("exact")) * 100, 4))


def rates_table(spark: SparkSession, n: int) -> DataFrame:
    rows = [(r, *bloom_size(n, r)) for r in RATES]
    return spark.createDataFrame([(r, m, k, round((1 - math.exp(-k * n / m)) ** k, 5)) for r, m, k in rows], "target_fpr double, m long, k long, theoretical_fpr double")
