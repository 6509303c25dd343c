"""Document fingerprints: digests of improbable features in chained Bloom filters.

Each window of WIDTH bytes has an entropy, in steps of 1/40 bit. How rare that entropy is in the
whole corpus ranks the window: the histogram of entropies over all windows of all documents is one
small aggregate, and rarer entropies rank first. A window that ranks first in at least POPULAR of
the WIDTH sliding neighbourhoods it stands in is a feature. Features go, in text order and each
once, into Bloom filters of 2,048 bits with 5 bits per feature; after 160 features the chain
continues with a new filter.

Two digests are compared filter by filter. The overlap of two filters is the number of common
bits above what chance gives filters with so many bits, over the most it could be; each filter of
the digest with fewer filters takes its best partner, and the mean weighted by features is the
likeness, 0 to 1.

A text shorter than a window is one feature as a whole, and so is a text without any eligible
feature, so equal texts have equal, and different ones different fingerprints. Null texts count
as empty: the empty digest "0:" is like itself (1.0) and unlike any other (0.0). Extra columns
pass through `digest`; a column named like an output is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit, common

WIDTH = 32
POPULAR = 8
PER_FILTER = 160
FILTER_BITS, BITS_PER_FEATURE = 2048, 5
STEPS = 201
#: Windows of under so many steps of entropy (1 bit) say too little to be features.
LEAST_STEP = 40
#: Share of the possible overlap that counts as noise.
NOISE = 0.1

_F = np.array([0.0, *(k * np.log2(k) for k in range(1, WIDTH + 1))])
#: Gain in the sum of count * log2(count) as a count goes from k - 1 to k, in integers so that sums are exact.
_GAIN = np.concatenate(([0], np.round(np.diff(_F) * (1 << 20)))).astype(np.int64)


def entropy_steps(buf: np.ndarray) -> np.ndarray:
    """Entropy of each window of WIDTH bytes in steps of 1/40 bit; empty for a shorter buffer."""
    n = len(buf) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    behind, ahead = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for k in range(1, WIDTH):
        same = (buf[k:] == buf[:-k]).view(np.uint8)
        behind[k:] += same
        ahead[:-k] += same
    # counts include the byte itself; the first window's sum goes by prefix counts
    first = sum(int(_GAIN[1 + int(np.count_nonzero(buf[:j] == buf[j]))]) for j in range(WIDTH))
    moved = np.zeros(n, np.int64)
    if n > 1:
        np.cumsum(_GAIN[behind[WIDTH:].astype(np.intp) + 1] - _GAIN[ahead[: n - 1].astype(np.intp) + 1], out=moved[1:])
    total = (first + moved) / float(1 << 20)
    return np.clip(np.round((np.log2(WIDTH) - total / WIDTH) * 40), 0, STEPS - 1).astype(np.int16)


def _window_hashes(buf: np.ndarray) -> np.ndarray:
    return bytekit.windows(bytekit._BYTE_VALUES[buf], WIDTH)


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step by its frequency over all windows of all texts; rarest first, unseen ones before.

    The result has STEPS entries whatever the input; executors add up their windows, the driver
    gets one row of STEPS counts per task.
    """

    def counts(batches):
        total = np.zeros(STEPS, np.int64)
        for _, texts in bytekit.batches_of_texts(batches):
            steps = entropy_steps(texts.buf)
            at = _within(texts, WIDTH, len(steps))
            total += np.bincount(steps[at], minlength=STEPS)
        yield pa.RecordBatch.from_pydict({"step": pa.array(range(STEPS), pa.int32()), "n": pa.array(total)})

    got = docs.select("text").mapInArrow(counts, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(STEPS, np.int64)
    for r in got:
        n[r.step] = r.n
    rank = np.empty(STEPS, np.int32)
    rank[np.lexsort((np.arange(STEPS), n))] = np.arange(STEPS)
    return rank


def _within(texts: bytekit.Texts, reach: int, n: int) -> np.ndarray:
    """Which of the first n places begin `reach` bytes of one text."""
    edge = np.zeros(n + 1, np.int32)
    full = texts.end - texts.start >= reach
    np.add.at(edge, texts.start[full], 1)
    np.add.at(edge, texts.end[full] - reach + 1, -1)
    return np.cumsum(edge[:-1]) > 0


class Digest:
    """Bloom filters as rows of 64-bit words, the number of features in each, and their text form."""

    __slots__ = ("filters", "counts")

    def __init__(self, filters: np.ndarray, counts: np.ndarray):
        self.filters, self.counts = filters, counts

    def text(self) -> str:
        return f"{int(self.counts.sum())}:" + base64.b64encode(self.filters.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Digest:
        total, _, data = text.partition(":")
        filters = np.frombuffer(base64.b64decode(data), "<u8").reshape(-1, FILTER_BITS // 64)
        counts = np.full(len(filters), PER_FILTER)
        if len(filters):
            counts[-1] = int(total) - PER_FILTER * (len(filters) - 1)
        return cls(filters, counts)


def digests(texts: bytekit.Texts, rank: np.ndarray) -> list[Digest]:
    buf, n_texts = texts.buf, len(texts.blobs)
    steps = entropy_steps(buf)
    n = len(steps)
    owner, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n:
        inside = _within(texts, WIDTH, n)
        key = rank[steps].astype(np.int64)
        key[(steps < LEAST_STEP) | ~inside] = STEPS
        # neighbourhoods of WIDTH windows; the lowest rank wins, of equal ones the first
        place = np.arange(n, dtype=np.int64)
        low = (key << 40) | place
        span = 1
        while span < WIDTH and len(low) > span:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        neighbourhoods = low[_within(texts, 2 * WIDTH - 1, len(low))] if span == WIDTH else low[:0]
        winners = neighbourhoods[(neighbourhoods >> 40) < STEPS] & ((1 << 40) - 1)
        popular = np.bincount(winners, minlength=n)
        chosen = np.flatnonzero(popular >= POPULAR)
        hashes = _window_hashes(buf)[chosen]
        owner = np.searchsorted(texts.start, chosen, side="right") - 1
        # each feature once per text, at its first place
        keep = ~bytekit.seen_before(bytekit.mix64(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        hashes, owner = hashes[keep], owner[keep]
    bare = np.setdiff1d(np.flatnonzero(texts.end > texts.start), owner)
    if len(bare):
        hashes = np.concatenate([hashes, texts.span_hashes(texts.start[bare], texts.end[bare])])
        owner = np.concatenate([owner, bare])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    counts = np.bincount(owner, minlength=n_texts)
    of_text = -(-counts // PER_FILTER)
    base = np.concatenate(([0], np.cumsum(of_text)))
    rank_in = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(counts)))[owner]
    slot = base[owner] + rank_in // PER_FILTER
    bits = np.zeros((base[-1], FILTER_BITS), bool)
    for k in range(BITS_PER_FEATURE):
        bits[slot, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    filled = np.bincount(slot, minlength=base[-1])
    return [Digest(packed[a:b], filled[a:b]) for a, b in zip(base[:-1], base[1:], strict=True)]


def likeness(a: Digest, b: Digest) -> float:
    if not len(a.filters) or not len(b.filters):
        return float(len(a.filters) == len(b.filters))
    if len(a.filters) > len(b.filters) or (len(a.filters) == len(b.filters) and a.counts.sum() > b.counts.sum()):
        a, b = b, a
    ones_a, ones_b = np.bitwise_count(a.filters).sum(1, dtype=np.int64), np.bitwise_count(b.filters).sum(1, dtype=np.int64)
    total = 0.0
    for row, ones, count in zip(a.filters, ones_a, a.counts, strict=True):
        common_bits = np.bitwise_count(b.filters & row).sum(1, dtype=np.int64)
        most = np.minimum(ones, ones_b)
        chance = ones * ones_b / FILTER_BITS
        floor = chance + NOISE * (most - chance)
        best = float(np.max((common_bits - floor) / np.maximum(most - floor, 1e-9)))
        total += min(1.0, max(0.0, best)) * int(count)
    return total / int(a.counts.sum())


def digest(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """docs with fingerprint, the text form of the digest of the whole text."""
    docs = docs.drop("fingerprint")
    names = docs.columns

    def made(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([d.text() for d in digests(texts, rank)])], names=[*names, "fingerprint"])

    return docs.mapInArrow(made, common.widened(docs.schema, "fingerprint string"))


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with the last half of its code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(texts: list[str], at: list[int], rank: np.ndarray) -> list[tuple]:
    """The _FIELDS of the texts at the given places, each against the text after it."""
    own = digests(bytekit.Texts([x.encode() for x in texts]), rank)
    blobs = [edited(texts[i], texts[i + 1]).encode() for i in at]
    other = digests(bytekit.Texts(blobs), rank)
    return [
        (len(texts[i]), hashlib.sha256(blob).hexdigest(), own[i].text(), changed.text(), likeness(own[i], changed), likeness(own[i], own[i + 1]))
        for i, blob, changed in zip(at, blobs, other, strict=True)
    ]


class Order:
    """Where documents stand: in descending order of id (null ids last), of equal ids by hash of the text.

    Quantiles of the ids cut the order into buckets of about BUCKET_ROWS; the driver keeps one
    number for each. An id that fills several buckets has them split by hash, and so have null ids.
    """

    def __init__(self, quantiles: list[int], nulls: int):
        self.bounds, parts = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.parts = np.append(parts, 1)  # of ids above the last bound
        widths = np.where(self.parts > 1, self.parts + 1, 1)
        self.base = np.cumsum(widths[::-1])[::-1] - widths
        self.null_base, self.null_parts = int(widths.sum()), max(1, -(-nulls // BUCKET_ROWS))

    def bucket(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        x = ids.fill_null(0).to_numpy()
        group = np.searchsorted(self.bounds, x, side="left")
        part = lambda n: np.minimum(((hashes.astype(float) + 2.0**63) / 2.0**64 * n).astype(np.int64), n - 1)
        parts = self.parts[group]
        at_bound = (group < len(self.bounds)) & (np.append(self.bounds, 0)[group] == x)
        inner = np.where(parts > 1, np.where(at_bound, part(parts), parts), 0)
        return np.where(none, self.null_base + part(self.null_parts), self.base[group] + inner)


#: Rows of a bucket.
BUCKET_ROWS = 1000


def _order(docs: DataFrame) -> Order:
    n = docs.count()
    k = -(-n // BUCKET_ROWS)
    found = docs.agg(
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
        F.percentile_approx("doc_id", [i / max(2, k) for i in range(1, max(2, k))], max(10000, 20 * k)).alias("cuts"),
    ).first()
    return Order(found.cuts if k > 1 and found.cuts else [], found.nulls)


def with_next(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id with _FIELDS: each document's digest beside those of its edited text and of the next document.

    The next document is the one after it in the Order; the first follows the last. One shuffle
    brings the documents of a bucket together, and with them the first document of the next bucket
    that has any. These first ones are found from ids and hashes before; the driver holds one for
    each bucket.
    """
    order = _order(docs)
    text = F.coalesce("text", F.lit(""))

    def placed(batches):
        for batch in batches:
            bucket = order.bucket(batch.column(0), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=["doc_id", "hash", "bucket"])

    narrow = docs.select("doc_id", F.xxhash64(text).alias("hash")).mapInArrow(placed, "doc_id long, hash long, bucket long")
    heads = narrow.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("hash").alias("mirror"))).alias("head")).collect()
    heads = sorted((r.bucket, r["head"].doc_id, ~r["head"].mirror) for r in heads)
    extra: dict[tuple, int] = {(heads[(i + 1) % len(heads)][1:]): bucket for i, (bucket, *_) in enumerate(heads)}

    def dealt(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2).to_numpy()
            bucket = order.bucket(ids, hashes)
            again = [(i, to) for i, key in enumerate(zip(ids.to_pylist(), hashes.tolist(), strict=True)) if (to := extra.get(key)) is not None]
            rows = pa.array(np.concatenate([np.arange(len(bucket)), np.array([i for i, _ in again], np.int64)]))
            columns = [c.take(rows) for c in batch.columns]
            buckets = np.concatenate([bucket, np.array([to for _, to in again], np.int64)])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(buckets), pa.array(np.arange(len(buckets)) >= len(bucket))], names=["doc_id", "text", "hash", "bucket", "next"])

    spread = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(dealt, "doc_id long, text string, hash long, bucket long, next boolean")
    spread = spread.repartition("bucket").sortWithinPartitions("bucket", "next", F.col("doc_id").desc_nulls_last(), "hash")

    def paired(batches):
        held: list[tuple] = []
        for part, texts in bytekit.batches_of_texts(batches):
            rows = held + list(zip(part.column(0).to_pylist(), [b.decode() for b in texts.blobs], part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True))
            held = rows[-1:]
            at = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            compared = _compare([r[1] for r in rows], at, rank)
            columns = [[rows[i][0] for i in at], *([c[k] for c in compared] for k in range(len(_NAMES)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *_TYPES], strict=True)], names=["doc_id", *_NAMES])

    return spread.mapInArrow(paired, f"doc_id long, {_FIELDS}")


_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return with_next(docs, rarity(docs))
