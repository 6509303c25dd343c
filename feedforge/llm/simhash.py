"""SimHash near-duplicates: Hamming links found with BK-trees, components over the links.

A document's words (ASCII letters in lower case) give shingles; a fingerprint bit is 1 if it is
set in over half the shingles' XXH64. Two fingerprints link at RADIUS or fewer differing bits.

Links are found among distinct fingerprints, so exact copies cost nothing after one aggregate.
With radius 3, two linked fingerprints agree on two at least of five blocks of 13 bits. Each
fingerprint therefore goes to ten shards, named by the 25 or 26 bits that must agree, and every
link lies in one shard at least: exact, without any cap. A shard of more than DENSE members isn't
searched but dealt again by further bits in the same way, so that no task holds a whole hot key.

In every shard, from two members on, a BK-tree (children keyed by their Hamming distance to the
parent) is built and searched for every fingerprint, following only the edges within the radius.
The trees of many shards are built and searched side by side, level by level, in arrays. They stay
in the task that owns their shard instead of being broadcast: together they hold the fingerprints
of all documents, which have no size bound and must not pass through the driver. Subtrees that
already belong to the query's component are skipped, and a shard emits a spanning forest of its
links, never all pairs.

Components are found by alternating large-star and small-star contraction of the links in staged
tables until nothing changes; group minima are aggregates joined back, so that a hub is never
collected and skewed joins are split.

`keep_first` drops near-duplicates: SimHash brings texts together, five-word shingles decide. A pair
that lies in several shards is taken from the first of them, and sketches of the shingles, which bound
the difference of two texts from below, decide which pairs need the texts themselves. Texts are moved
only if a bit field of fixed size says that they may be needed.

Null texts count as empty; texts without words have fingerprint zero and link like any other.
Null ids never name a component: a component of null ids only has a null component_id. Repeated
rows and equal ids share fingerprint classes by text. Extra columns don't reach `components`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit, common
from .common import discard, staged

RADIUS, SHINGLE, SEED = 3, 3, 42
#: What brings texts together: fingerprints of distinct words and of distinct word pairs, either one at so many
#: differing bits and both together at so many.
KEEP_RADIUS, KEEP_TOGETHER, KEEP_WIDTHS = 6, 18, (1, 2)
#: What then makes them near-duplicates.
KEEP_WORDS, KEEP_SIMILARITY = 5, 0.8
#: Members from which a shard is dealt again by further bits.
DENSE = 20_000
#: Members of the small shards that are searched together, and of a large one that are searched before its components are joined.
TOGETHER, BLOCK = 1 << 15, 256
#: Bits of the field, 4 KB a row, that says which rows may be among others.
FIELD = 1 << 24

_U = np.uint64


def fingerprint_of(blobs: list[bytes], width: int = SHINGLE, distinct: bool = False) -> np.ndarray:
    """64-bit SimHash of each UTF-8 text, over its shingles with repeats or over the distinct ones."""
    hashes, sizes, digest, seed = [], [], xxhash.xxh64_intdigest, SEED
    for blob in blobs:
        words = blob.lower().split()
        n = len(words)
        if n <= width or width == 1:
            found = [b" ".join(words)] * (n > 0) if width > 1 else words
        else:
            joined = b" ".join(words)
            starts = [0]
            for w in words:
                starts.append(starts[-1] + len(w) + 1)
            found = [joined[a : b - 1] for a, b in zip(starts, starts[width:], strict=False)]
        if distinct:
            found = set(found)
        hashes.extend([digest(x, seed) for x in found])
        sizes.append(len(found))
    counts = np.array(sizes, np.int64)
    out = np.zeros(len(blobs), _U)
    if hashes:
        bits = np.unpackbits(np.array(hashes, _U).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(counts)
        ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little").view(_U).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""
    docs = docs.drop(name)
    names = docs.columns

    def made(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprint_of(texts.blobs, width).view(np.int64))], names=[*names, name])

    return docs.mapInArrow(made, common.widened(docs.schema, f"{name} long"))


# trees

class Trees:
    """BK-trees of many shards, side by side.

    Nodes are numbered level by level, so that a node's children follow each other in order of
    their distance to it. `values` holds distinct fingerprints, shard after shard.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        n = len(values)
        self.values, self.roots = values, len(starts)
        self.place, parent, edge, levels = np.empty(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), [0]
        left, group = np.arange(n), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        above, key = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        self.tree = group
        while len(left):
            heads = _starts(group)
            at = levels[-1]
            self.place[at : at + len(heads)] = left[heads]
            parent[at : at + len(heads)], edge[at : at + len(heads)] = above, key
            levels.append(at + len(heads))
            own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(left))))
            rest = np.ones(len(left), bool)
            rest[heads] = False
            left, own = left[rest], own[rest]
            distance = np.bitwise_count(values[left] ^ values[self.place[at + own]]).astype(np.int64)
            order = np.lexsort((distance, own))
            left, own, distance = left[order], own[order], distance[order]
            group = own * 128 + distance
            first = _starts(group)
            above, key = at + own[first], distance[first]
        self.levels, self.parent = levels, parent
        self.keys = parent[self.roots :] * 128 + edge[self.roots :]
        self.node_values = values[self.place]

    def spans(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest label below each node, from those of the values."""
        low, high = low[self.place], high[self.place]
        for a, b in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            np.minimum.at(low, self.parent[a:b], low[a:b])
            np.maximum.at(high, self.parent[a:b], high[a:b])
        return low, high

    def near(self, queries: np.ndarray, radius: int, label: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None):
        """(query, value, distance) within the radius and in the same shard, the query's place above the value's or equal to it; without subtrees whose labels are all the query's."""
        q, at = queries, self.tree[queries]
        out = []
        while len(q):
            if label is not None:
                go = ~((low[at] == high[at]) & (low[at] == label[q]))
                q, at = q[go], at[go]
            distance = np.bitwise_count(self.values[q] ^ self.node_values[at]).astype(np.int64)
            hit = np.flatnonzero((distance <= radius) & (self.place[at] <= q))
            out.append((q[hit], self.place[at[hit]], distance[hit]))
            a, b = np.searchsorted(self.keys, at * 128 + np.maximum(distance - radius, 0)), np.searchsorted(self.keys, at * 128 + np.minimum(distance + radius, 127), side="right")
            size = b - a
            q = np.repeat(q, size)
            at = self.roots + np.repeat(a, size) + _counting(size)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the components that the edges (a, b) link, cheapest edges first; the edges used. `label` names each one by its least member."""
    left, right = [], []
    while True:
        x, y = label[a], label[b]
        some = np.flatnonzero(x != y)
        if not len(some):
            break
        a, b, cost, x, y = a[some], b[some], cost[some], x[some], y[some]
        ends, others, edge = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(np.arange(len(a)), 2)
        order = np.lexsort((edge, np.tile(cost, 2), ends))
        first = order[_starts(ends[order])]
        used = np.unique(edge[first])
        left.append(a[used])
        right.append(b[used])
        to = np.arange(len(label))
        to[ends[first]] = others[first]
        back = to[to]
        lower = (back == np.arange(len(to))) & (np.arange(len(to)) < to)  # two that chose each other: the lower one stays
        to[lower] = np.flatnonzero(lower)
        while (to[to] != to).any():
            to = to[to]
        least = np.arange(len(label))
        np.minimum.at(least, to, np.arange(len(label)))
        label[:] = least[to[label]]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


class Members:
    """Rows of complete shards, sorted by shard and fingerprint: trees over distinct fingerprints, and the rows at each."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray, own: np.ndarray, other: np.ndarray | None = None, marks: np.ndarray | None = None, size: np.ndarray | None = None):
        heads = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1]))))
        self.first, self.count = heads, np.diff(np.append(heads, len(fp)))
        self.trees = Trees(fp[heads], _starts(shard[heads]))
        self.own, self.other, self.marks, self.size = own, other, marks, size
        self.node = np.repeat(np.arange(len(heads)), self.count)

    def pairs(self, queries: np.ndarray, radius: int, similarity: float, label: np.ndarray, skip: bool):
        """(row, row, cost) whose labels differ, whose fingerprints are near and whose shingle sets can be similar enough."""
        if skip:
            low, high = label.copy(), label.copy()
            low, high = np.minimum.reduceat(low, self.first), np.maximum.reduceat(high, self.first)
            uniform = low == high
            q, v, d = self.trees.near(queries, radius, np.where(uniform, low, -1), *self.trees.spans(low, high))
        else:
            q, v, d = self.trees.near(queries, radius)
        sizes = self.count[q] * self.count[v]
        for at in _chunks(sizes, 1 << 18):
            part, n = slice(*at), sizes[slice(*at)]
            k, one = _counting(n), np.repeat(np.arange(len(n)), n)
            width = self.count[v[part]][one]
            a, b = self.first[q[part]][one] + k // width, self.first[v[part]][one] + k % width
            keep = (a > b) & (label[a] != label[b])
            a, b, cost = a[keep], b[keep], d[part][one][keep]
            if self.marks is not None:
                both = cost + np.bitwise_count(self.other[a] ^ self.other[b]) <= KEEP_TOGETHER
                a, b = a[both], b[both]
                # each shingle that only one has flips one bit of the mark, so this is a lower bound of the difference
                cost = np.bitwise_count(self.marks[a] ^ self.marks[b]).sum(1, dtype=np.int64)
                total = self.size[a] + self.size[b]
                can = cost <= total * ((1 - similarity) / (1 + similarity)) + 1e-9
                a, b, cost = a[can], b[can], (cost[can] << 20) // np.maximum(total[can], 1)
            yield a, b, cost


def _chunks(sizes: np.ndarray, most: int):
    """Runs of places whose sizes add up to about `most`."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        yield at, to
        at = to


def forest(members: Members, radius: int, similarity: float, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of near rows, cheapest first within each block of queries."""
    label, left, right = np.arange(len(members.node)), [], []
    n = len(members.first)
    step = BLOCK if large else n
    for at in range(0, n, step):
        found = list(members.pairs(np.arange(at, min(n, at + step)), radius, similarity, label, large))
        a, b = join(label, *(np.concatenate(x) for x in zip(*found, strict=True))) if found else ([], [])
        left.append(a)
        right.append(b)
    return np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)


_SHARD = "key int, shard long, fp long"
_MARKS = ("mark0", "mark1", "mark2", "mark3")
_FULL = _SHARD + ", vertex long, class long, other long, " + "".join(f"{m} long, " for m in _MARKS) + "size long"


def _linked(batches, radius: int, similarity: float, across: bool, dense: int, ddl: str):
    """Links of each shard: a spanning forest, or, across, all that join two classes. Rows come sorted by shard and fp.

    A row of a shard with more than `dense` members passes through with null links, to be dealt again.
    """
    names = [x.split()[0] for x in ddl.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in ddl.split(", ")]
    rest, batches, ended, passing = None, iter(batches), False, None

    def put(low, high, rows=None):
        if rows is None:
            rows = [pa.nulls(len(low), t) for t in kinds]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(low, high), pa.int64()), pa.array(np.maximum(low, high), pa.int64()), *rows], names=["low", "high", *names])
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows[0]), pa.int64())] * 2 + [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["low", "high", *names])

    def links(rows, large):
        own = rows[3] if len(rows) > 3 else rows[2]
        more = (rows[5].view(_U), np.stack([x.view(_U) for x in rows[6:10]], 1), rows[10]) if len(rows) > 3 else ()
        members = Members(rows[1], rows[2].view(_U), own, *more)
        if not across:
            a, b = forest(members, radius, similarity, large)
            if len(a):
                yield put(own[a], own[b])
            return
        n = len(members.first)
        for at in range(0, n, BLOCK if large else n):
            for a, b, _ in members.pairs(np.arange(at, min(n, at + (BLOCK if large else n))), radius, similarity, rows[4], large):
                own_here = _first_shard(rows[0], members, a, b, radius)
                a, b = a[own_here], b[own_here]
                if len(a):
                    yield put(own[a], own[b])

    while not ended:
        batch = next(batches, None)
        ended = batch is None
        if not ended:
            rows = [batch.column(i).to_numpy() for i in range(len(names))]
            if passing is not None:
                to = int(np.searchsorted(rows[1] != passing, True))
                if to:
                    yield put(None, None, [c[:to] for c in rows])
                    rows = [c[to:] for c in rows]
                if len(rows[0]):
                    passing = None
            rest = rows if rest is None else [np.concatenate([a, b]) for a, b in zip(rest, rows, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        heads = _starts(rest[1])
        sizes = np.diff(np.append(heads, len(rest[1])))
        done = len(heads) if ended else len(heads) - 1
        many = sizes[:done] > dense
        for i in np.flatnonzero(many):
            yield put(None, None, [c[heads[i] : heads[i] + sizes[i]] for c in rest])
        for i in np.flatnonzero((sizes[:done] > BLOCK) & ~many):
            yield from links([c[heads[i] : heads[i] + sizes[i]] for c in rest], True)
        small = np.flatnonzero((sizes[:done] > 1) & (sizes[:done] <= BLOCK))
        for a, b in _chunks(sizes[small], TOGETHER):
            at = np.repeat(heads[small[a:b]], sizes[small[a:b]]) + _counting(sizes[small[a:b]])
            yield from links([c[at] for c in rest], False)
        if not ended:
            rest = [c[heads[-1] :] for c in rest]
            if sizes[-1] > dense:
                passing = int(rest[1][0])
                yield put(None, None, rest)
                rest = None


# shards

def _blocks(bits: list[int], radius: int, agree: int) -> list[int]:
    """Masks of the choices of `agree` of radius + agree blocks of the given bits."""
    n = radius + agree
    edges = [round(len(bits) * i / n) for i in range(n + 1)]
    each = [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(n)]
    return [sum(chosen) for chosen in itertools.combinations(each, agree)]


def _first_shard(key: np.ndarray, members: Members, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether the shards of this key are the first ones that the rows a and b share within the radius."""
    masks = [_U(x) for x in _blocks(list(range(64)), radius, 2)]
    second = key[a] >= len(masks)
    fp = members.trees.values[members.node]
    here, there = fp[a] ^ fp[b], members.other[a] ^ members.other[b]
    earlier = second & (np.bitwise_count(there) <= radius)  # then they share a shard of the first fingerprint
    first = np.zeros(len(a), np.int64)
    for k in reversed(range(len(masks))):
        first[here & masks[k] == 0] = k
    return (key[a] == key[b]) & ~earlier & (first == key[a] % len(masks))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(distinct: DataFrame, radius: int = RADIUS, agree: int = 2, kept: tuple[str, ...] = (), tables: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(key, shard, fp, *kept): each fingerprint in all shards that its links may share.

    Of radius + agree blocks of bits, two fingerprints within the radius agree on `agree` at least;
    a shard is a choice of so many blocks and their bits. Of two fingerprints of a row, shards are made
    of either one, with the other one beside it.
    """
    masks, rows = _blocks(list(range(64)), radius, agree), []
    for t, name in enumerate(tables):
        for k, mask in enumerate(masks):
            key = t * len(masks) + k
            rows.append(F.struct(F.lit(key).alias("key"), F.xxhash64(F.lit(key), F.col(name).bitwiseAND(F.lit(_signed(mask)).cast("long"))).alias("shard"), F.col(name).alias("fp"), *(F.col(x).alias("other") for x in tables if x != name)))
    return distinct.select(F.explode(F.array(*rows)).alias("_at"), *(x for x in kept if x != "other")).select("_at.key", "_at.shard", "_at.fp", *(x if x != "other" else "_at.other" for x in kept))


def gathered(distinct: DataFrame, radius: int, kept: tuple[str, ...], tables: tuple[str, ...]) -> DataFrame:
    """The rows of `shards` for two agreeing blocks, dealt out with each shard whole in a partition.

    All shards whose first block is the same one with the same bits lie in one partition, so that a row
    is moved once for each first block and becomes the rows of its shards only there.
    """
    n, masks = radius + 2, _blocks(list(range(64)), radius, 2)
    ones, at = _blocks(list(range(64)), radius + 1, 1), list(itertools.combinations(range(n), 2))
    rows = []
    for t, name in enumerate(tables):
        for i in range(n - 1):
            rows.append(F.struct(F.lit(t * n + i).alias("first"), F.xxhash64(F.lit(t * n + i), F.col(name).bitwiseAND(F.lit(_signed(ones[i])).cast("long"))).alias("group"), F.col(name).alias("fp"), *(F.col(x).alias("other") for x in tables if x != name)))
    moved = distinct.select(F.explode(F.array(*rows)).alias("_at"), *(x for x in kept if x != "other")).select("_at.first", "_at.group", "_at.fp", *(x if x != "other" else "_at.other" for x in kept)).repartition("group")
    found = None
    for t in range(len(tables)):
        for i in range(n - 1):
            own = [(t * len(masks) + k, mask) for k, mask in enumerate(masks) if at[k][0] == i]
            here = F.array(*(F.struct(F.lit(key).alias("key"), F.xxhash64(F.lit(key), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))).alias("shard")) for key, mask in own))
            found = F.when(F.col("first") == t * n + i, here) if found is None else found.when(F.col("first") == t * n + i, here)
    return moved.select(F.explode(found).alias("_at"), "fp", *kept).select("_at.key", "_at.shard", "fp", *kept)


def further(dense: DataFrame, radius: int, agree: int = 2) -> DataFrame:
    """Rows of dense shards, dealt again by the bits that their key leaves open."""
    names = dense.columns
    masks = _blocks(list(range(64)), radius, agree)
    inner = [_blocks([b for b in range(64) if not mask >> b & 1], radius, agree) for mask in masks]

    def dealt(batches):
        for batch in batches:
            key, shard, fp = (batch.column(i).to_numpy() for i in range(3))
            for j in range(len(masks)):
                mask = np.array([x[j] for x in inner], _U)[key % len(masks)]
                fresh = bytekit.mix64((fp.view(_U) & mask) ^ bytekit.mix64(shard.view(_U) + _U(j + 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fresh.view(np.int64)), *batch.columns[2:]], names=names)

    return dense.mapInArrow(dealt, dense.schema)


def linked(dealt: DataFrame, radius: int, similarity: float = 0.0, across: bool = False, whole: bool = False) -> DataFrame:
    """(low, high), staged: links found in the shards; dense shards are dealt once more. whole: each shard already lies in one partition."""
    ddl = _FULL if "vertex" in dealt.columns else _SHARD
    run = lambda df, dense: staged(df.sortWithinPartitions("shard", "fp").mapInArrow(lambda batches: _linked(batches, radius, similarity, across, dense, ddl), "low long, high long, " + ddl), "links")
    first = run(dealt if whole else dealt.repartition("shard"), DENSE)
    dense = first.where("low IS NULL").drop("low", "high")
    found = first.where("low IS NOT NULL").select("low", "high")
    if not dense.isEmpty():
        second = run(further(dense, radius).repartition("shard"), 1 << 62)
        found = found.unionByName(second.where("low IS NOT NULL").select("low", "high"))
        out = staged(found.distinct(), "links")
        discard(first, second)
        return out
    out = staged(found.distinct(), "links")
    discard(first)
    return out


# components

def contract(edges: DataFrame) -> DataFrame:
    """(node, root), staged: for each node with a link but the least of its component, that least one."""
    edges = staged(edges.select(F.greatest("low", "high").alias("node"), F.least("low", "high").alias("root")), "stars")
    mark = None
    while True:
        both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.col("m").alias("root")), F.struct(F.col("u").alias("node"), F.col("m").alias("root")))).alias("e")).select("e.*")
        fresh = staged(small.where("node != root").distinct(), "small-star")
        discard(edges, large)
        edges = fresh
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("s")).first()
        if mark == (row.n, row.s):
            return edges
        mark = (row.n, row.s)


def components(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp, ...) with class (least fingerprint of the component, signed) and component_id."""
    prints = prints.drop("class", "component_id")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    found = linked(shards(distinct.select("fp")), RADIUS)
    rooted = contract(found)
    discard(found)
    distinct = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("class"))
    named = distinct.groupBy("class").agg(F.min("least").alias("component_id"))
    return prints.join(distinct.join(named, "class").select("fp", "class", "component_id"), "fp")


# near-duplicates

def _shingles(text: str, words: int) -> set[bytes]:
    own = text.encode().lower().split()
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def sketches_of(blobs: list[bytes], words: int = KEEP_WORDS) -> tuple[list[bytes], np.ndarray]:
    """(sketch, number) of the distinct shingles of each text: each shingle flips one bit.

    A sketch has a power of two of bits, 256 and two for each shingle at least. Folded, it is the sketch of fewer bits.
    """
    sketches, sizes, digest = [], np.zeros(len(blobs), np.int64), xxhash.xxh64_intdigest
    for i, blob in enumerate(blobs):
        own = blob.lower().split()
        found = {b" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))}
        width = max(64 * len(_MARKS), 1 << (2 * len(found) - 1).bit_length())
        bits = np.bincount((np.array([digest(x) for x in found], _U) & _U(width - 1)).astype(np.int64), minlength=width) & 1
        sketches.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
        sizes[i] = len(found)
    return sketches, sizes


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch in so many bytes, as words of 64 bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, _U).reshape(-1, size // 8), axis=0)


def marks_of(blobs: list[bytes], words: int = KEEP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(four words of bits, number) of the distinct shingles of each text: each shingle flips one of 256 bits."""
    sketches, sizes = sketches_of(blobs, words)
    return _marks(sketches), sizes


def _marks(sketches: list[bytes]) -> np.ndarray:
    return np.array([folded(x, 8 * len(_MARKS)) for x in sketches], _U).reshape(-1, len(_MARKS))


def _printed(docs: DataFrame, words: int) -> DataFrame:
    """docs, without their texts, with both fingerprints, marks, number of shingles and sketch."""
    names = [x for x in docs.columns if x != "text"]

    def made(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            prints = [fingerprint_of(texts.blobs, w, distinct=True).view(np.int64) for w in KEEP_WIDTHS]
            sketches, sizes = sketches_of(texts.blobs, words)
            marks = _marks(sketches).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in names), *map(pa.array, (*prints, *(np.ascontiguousarray(m) for m in marks.T), sizes)), pa.array(sketches, pa.binary())], names=[*names, "fp0", "fp1", *_MARKS, "size", "sketch"]
            )
        bytekit.give_back()

    return docs.mapInArrow(made, common.widened(docs.drop("text").schema, ", ".join(f"{x} long" for x in ("fp0", "fp1", *_MARKS, "size")) + ", sketch binary"))


def among(table: DataFrame, name: str, rows: DataFrame, out: str) -> DataFrame:
    """table with a boolean: false only for rows whose number (column `name`) isn't in `rows`, a table of that column.

    A field of FIELD bits, of which each number sets one, is broadcast; its size doesn't depend on the tables.
    """
    part, place, bits = (common.free_name(table, x) for x in ("_part", "_place", "_bits"))
    at = F.pmod(F.xxhash64(name), F.lit(FIELD))
    dealt = lambda df: df.withColumns({part: F.shiftright(at, 15), place: at.bitwiseAND(F.lit(32767))})
    field = dealt(rows.select(name)).groupBy(part).agg(F.bitmap_construct_agg(place).alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, F.col(place).bitwiseAND(F.lit(7)).cast("int")) == 1
    return dealt(table).join(F.broadcast(field), part, "left").withColumn(out, F.coalesce(found, F.lit(False))).drop(part, place, bits)


def _sides(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(low, high, both) of pairs of rows, with the two values. values: row, value.

    Only values that may be in a pair are moved: once to their pairs and once with them.
    """
    ends = pairs.select("low", "high", F.explode(F.array("low", "high")).alias("row"))
    needed = among(values, "row", ends.select("row"), "needed").where("needed").select("row", "value")
    return needed.join(ends, "row").groupBy("low", "high").agg(F.collect_list("value").alias("both"))


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (low, high) of rows whose shingle sets can be that similar. sketches: row, size, sketch.

    Each shingle that only one text has flips one bit, so that the bits that differ bound the difference from below,
    as the difference of the sizes does.
    """

    def compared(batches):
        for batch in batches:
            low, high, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (a, b) in enumerate(batch.column(2).to_pylist()):
                width = min(len(a["sketch"]), len(b["sketch"]))
                apart = max(int(np.bitwise_count(folded(a["sketch"], width) ^ folded(b["sketch"], width)).sum()), abs(a["size"] - b["size"]))
                if apart <= (a["size"] + b["size"]) * ((1 - similarity) / (1 + similarity)) + 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"low": pa.array([low[i] for i in keep], pa.int64()), "high": pa.array([high[i] for i in keep], pa.int64())})
        bytekit.give_back()

    return _sides(pairs, sketches.select("row", F.struct("size", "sketch").alias("value"))).mapInArrow(compared, "low long, high long")


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (low, high) of rows whose texts' shingle sets have that Jaccard similarity at least. texts: row, text."""

    def compared(batches):
        for batch in batches:
            low, high, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (a, b) in enumerate(batch.column(2).to_pylist()):
                x, y = _shingles(a, words), _shingles(b, words)
                if len(x & y) >= similarity * len(x | y):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"low": pa.array([low[i] for i in keep], pa.int64()), "high": pa.array([high[i] for i in keep], pa.int64())})
        bytekit.give_back()

    return _sides(pairs, texts.select("row", F.col("text").alias("value"))).mapInArrow(compared, "low long, high long")


def keep_first(docs: DataFrame, radius: int = KEEP_RADIUS, words: int = KEEP_WORDS, similarity: float = KEEP_SIMILARITY) -> DataFrame:
    """docs without the near-duplicates: of each group the row with the smallest id stays (null ids last, then the first row).

    Groups are connected by pairs of texts that SimHash brings together (radius differing bits at
    most in either of two fingerprints, KEEP_TOGETHER in both) and whose shingles of `words` words are similar enough.
    Equal texts are one vertex. In each shard a spanning forest of what SimHash brings together,
    with the pairs first whose marks differ least, is compared first, which joins most near copies;
    then every pair within the radius that still spans two classes. Pairs whose marks prove them too
    different to be similar are left out of both, as are those that sketches prove so: no similar
    pair within the radius is lost. Rows that can't be among the dropped ones are never moved.
    """
    row, maybe = common.free_name(docs, "_row"), common.free_name(docs, "_maybe")
    text = F.coalesce("text", F.lit(""))
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), text.alias("text"))
    prints = staged(_printed(numbered.select("doc_id", F.col(row).alias("row"), F.xxhash64(text).alias("same"), "text"), words), "prints")
    narrow, sketches = prints.drop("sketch"), prints.select("row", "size", "sketch")
    alone = ("fp0", "fp1", "same")
    vertices = staged(narrow.groupBy(*alone).agg(F.min("row").alias("vertex"), *(F.first(x).alias(x) for x in (*_MARKS, "size"))), "vertices")
    kept = ("vertex", "class", "other", *_MARKS, "size")
    pairs = linked(gathered(vertices.withColumn("class", F.col("vertex")), radius, kept, ("fp0", "fp1")), radius, similarity, whole=True)
    close = staged(possible(pairs, sketches, similarity), "possible")
    good = staged(alike(close, texts, words, similarity), "alike")
    discard(close)
    rooted = contract(good)
    classes = staged(vertices.join(rooted.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("class", F.coalesce("root", "vertex")).drop("root"), "classes")
    apart = linked(gathered(classes, radius, kept, ("fp0", "fp1")), radius, similarity, across=True, whole=True)
    fresh = staged(apart.join(pairs, ["low", "high"], "left_anti"), "apart")
    close = staged(possible(fresh, sketches, similarity), "possible")
    more = staged(alike(close, texts, words, similarity), "alike")
    if not more.isEmpty():
        again = contract(good.unionByName(more))
        discard(rooted)
        rooted = again
    classed = vertices.join(rooted.withColumnRenamed("node", "vertex"), "vertex", "left").select(*alone, F.coalesce("root", "vertex").alias("class"))
    first = narrow.join(classed, list(alone)).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.row")
    dropped = staged(narrow.select("row").join(first, "row", "left_anti").withColumnRenamed("row", row), "dropped")
    discard(pairs, good, classes, apart, fresh, close, more, prints, vertices, rooted)
    found = among(numbered, row, dropped, maybe)
    return found.where(~F.col(maybe)).unionByName(found.where(maybe).join(dropped, row, "left_anti")).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = staged(fingerprints(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
