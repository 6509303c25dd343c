"""LM scoring: a hierarchical Pitman-Yor bigram model, seated by Gibbs sampling, over the whole corpus.

Each word that precedes another has a restaurant whose customers are the words that follow it;
all these restaurants share one parent, whose customers are their tables and whose base is uniform
over the training words and one unknown word. Seatings are sampled in sweeps (`seating`): the
parent is seated given all restaurants' tables, then every restaurant given the parent. After the
first sweeps each one gives a predictive probability, from the parent and the restaurant of that
sweep; scores are made from the mean of these. All draws depend on words and sweep alone, so the
result is the same however the corpus is cut.

Nothing of vocabulary size reaches the driver or a broadcast. Documents are cut into blocks of
tokens. Words and distinct bigrams of blocks go, packed, to shards named by hashes:

* Shards of words count each word, and seat the parent's dishes in each sweep.
* Shards of contexts hold the restaurants. In each sweep they get the parent's masses for their
  followers and give back their tables; at the end they give blocks the mean probabilities of
  their bigrams.

A context with more tokens than half a shard is split over several shards by its followers. Their
number is bounded by the corpus over half a shard's tokens; this list and sums are all that the
driver holds. Shards grow in number with the corpus. Words are named by 64-bit hashes.

Null texts count as empty: one end token. Null ids count as the empty text for the split. Repeated
rows are scored alike, and each counts in training. Without training tokens every word is unknown
and the base is uniform over it alone: scores are 0. Extra columns don't reach the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit, common
from .common import crc_bucket_py, discard, staged
from .seating import draw_tables, gamma

MODULUS, HELD = 7, 2
#: Text of a block, and tokens of a shard on average.
BLOCK_BYTES, SHARD_TOKENS = 6 << 20, 2_000_000
#: Concentrations of context restaurants and of their parent.
CONTEXT_STRENGTH, PARENT_STRENGTH = 1.0, 1.0
SWEEPS, KEPT = 5, 3
SEED = 20

_U = np.uint64
BEGIN, END = _U(0x1B873593CC9E2D51), _U(0x85EBCA6BC2B2AE35)
_PHI = 0x9E3779B97F4A7C15


# arrays as bytes

def _planes(a: np.ndarray) -> bytes:
    """Values by byte planes, compressed: small and repeated values take little."""
    width = a.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _spread(value: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(value), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _steps(a: np.ndarray) -> bytes:
    """Ascending 64-bit values by their differences."""
    return _planes(np.diff(a, prepend=_U(0)))


def _climb(value: bytes) -> np.ndarray:
    return np.cumsum(_spread(value, _U), dtype=_U)


def _small(a: np.ndarray) -> bytes:
    return _planes(a.astype(np.uint32))


def _un(value: bytes, kind) -> np.ndarray:
    return np.frombuffer(value, kind)


# blocks

_BLOCK = "block long, doc_ids binary, nulls binary, held binary, sizes binary, words binary, counts binary, tokens binary, n_train long, n_tokens long"


def _block_row(block: int, ids: list, sizes: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """One block: its documents, its distinct words (ascending) with their training counts, and its tokens as places among these."""
    size = np.concatenate(sizes).astype(np.int32)
    words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
    held = np.array([crc_bucket_py(i, MODULUS) == HELD for i in ids])
    counts = np.bincount(tokens, weights=np.repeat(~held, size), minlength=len(words)).astype(np.uint32)
    none = np.array([i is None for i in ids])
    columns = {
        "block": pa.array([block], pa.int64()),
        **{
            name: pa.array([a if isinstance(a, bytes) else a.tobytes()], pa.binary())
            for name, a in (
                ("doc_ids", np.array([i or 0 for i in ids], np.int64)), ("nulls", none), ("held", held), ("sizes", size), ("words", _steps(words)), ("counts", _small(counts)), ("tokens", _small(tokens)),
            )
        },
        "n_train": pa.array([int(counts.sum())], pa.int64()),
        "n_tokens": pa.array([len(tokens)], pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def made(batches):
        task, n, full = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for part, texts in bytekit.batches_of_texts(batches):
            low = texts.lowered()
            first, last, bounds = low.words()
            count = np.diff(bounds)
            places = np.arange(len(first)) + bytekit.owners(bounds)
            out = np.full(len(first) + len(count), END, _U)
            out[places] = low.span_hashes(first, last)
            ids += part.column(0).to_pylist()
            sizes.append(count + 1)
            hashes.append(out)
            full += len(texts.raw)
            if full >= block_bytes:
                yield _block_row((task << 24) + n, ids, sizes, hashes)
                ids, sizes, hashes, full, n = [], [], [], 0, n + 1
                bytekit.give_back()
        if ids:
            yield _block_row((task << 24) + n, ids, sizes, hashes)

    return docs.select("doc_id", "text").mapInArrow(made, _BLOCK)


#: Training tokens after each split context, and over how many shards its followers are dealt.
Hot = dict[int, tuple[int, int]]


class Block:
    def __init__(self, row: dict):
        self.words, self.counts, self.tokens = _climb(row["words"]), _spread(row["counts"], np.uint32), _spread(row["tokens"], np.uint32).astype(np.int64)
        self.sizes, self.held = _un(row["sizes"], np.int32), _un(row["held"], bool)
        self.ends = np.cumsum(self.sizes)
        n = len(self.words)
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.ends - self.sizes] = n
        #: Distinct (context, word) in order, and each token's place among them.
        self.pairs, self.pair_of = np.unique(context * (n + 1) + self.tokens, return_inverse=True)
        self.context, self.follower = self.pairs // (n + 1), self.pairs % (n + 1)
        self.context_hash = np.append(self.words, BEGIN)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of, weights=np.repeat(~self.held, self.sizes), minlength=len(self.pairs)).astype(np.uint32)

    def by_shard(self, n: int, hot: Hot):
        """(shard, its pairs in order of the hashes of context and word)."""
        shard = shard_of(self.context_hash, n)[self.context]
        if hot:
            keys = np.array(sorted(hot), _U)
            parts = np.array([hot[int(k)][1] for k in keys], _U)
            at = np.minimum(np.searchsorted(keys, self.context_hash), len(keys) - 1)
            mine = np.flatnonzero((keys[at] == self.context_hash)[self.context])
            context = self.context[mine]
            part = bytekit.mix64(self.words)[self.follower[mine]] % parts[at[context]]
            shard[mine] = shard_of(self.context_hash[context] + part * _U(_PHI), n)
        # words ascend with their hashes and pairs with their words; only those of the beginning, the last ones, move to the place of its hash
        begin = int(np.searchsorted(self.context, len(self.words)))
        to = int(np.searchsorted(self.context, np.searchsorted(self.words, BEGIN)))
        order = np.concatenate([np.arange(to), np.arange(begin, len(shard)), np.arange(to, begin)])
        order = order[_grouping(shard[order], n)]
        cuts = np.searchsorted(shard[order], np.arange(n + 1))
        return [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def _grouping(shard: np.ndarray, n: int) -> np.ndarray:
    """Places by shard, in order within each one. Narrow numbers are sorted by their bytes."""
    return np.argsort(shard.astype(np.min_scalar_type(n)), kind="stable")


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (bytekit.mix64(hashes) % _U(n)).astype(np.int64)


#: All that moves between shards: what it is, the shard it goes to, where it is from, arrays, sums.
_ROW = "kind string, shard long, other long, a binary, b binary, c binary, d binary, e binary, s0 double, s1 double, s2 double, s3 double"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _record(rows: list[dict]) -> pa.RecordBatch:
    fields = [x.split() for x in _ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in fields], names=[n for n, _ in fields])


def _rows(df: DataFrame, make) -> DataFrame:
    """make(row) gives rows for each row of df."""

    def run(batches):
        bytekit.give_back()
        for batch in batches:
            for row in batch.to_pylist():
                yield _record(list(make(row)))
        bytekit.give_back()

    return df.mapInArrow(run, _ROW)


def _per_shard(df: DataFrame, make) -> DataFrame:
    """make(rows by kind, shard) gives rows for all rows of a shard. Its draws and sums don't depend on the order of the rows."""

    def run(table: pa.Table) -> pa.Table:
        rows: dict[str, list] = {}
        for r in table.to_pylist():
            rows.setdefault(r["kind"], []).append(r)
        for own in rows.values():
            own.sort(key=lambda r: -1 if r["other"] is None else r["other"])
        out = pa.Table.from_batches([_record(list(make(rows, table["shard"][0].as_py())))])
        rows.clear()
        bytekit.give_back()
        return out

    return df.groupBy("shard").applyInArrow(run, _ROW)


# words

def count_words(made: DataFrame, shards: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Of each shard: its words ("vocabulary"), counts for blocks ("counts", to the block in `other`), words that are frequent enough to split their restaurant ("hot"), and N and V ("sums")."""

    def asked(row):
        words, counts = _climb(row["words"]), _spread(row["counts"], np.uint32)
        shard = shard_of(words, shards)
        order = _grouping(shard, shards)
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            at = order[a:b]
            if len(at):
                yield {"kind": "words", "shard": s, "other": row["block"], "a": _steps(words[at]), "b": _small(counts[at])}

    def counted(rows, shard):
        own = [_climb(r["a"]) for r in rows["words"]]
        words, place = np.unique(np.concatenate(own), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([_spread(r["b"], np.uint32) for r in rows["words"]]), minlength=len(words)).astype(np.int64)
        at = 0
        for r, h in zip(rows["words"], own, strict=True):
            yield {"kind": "counts", "shard": shard, "other": r["other"], "a": _planes(count[place[at : at + len(h)]])}
            at += len(h)
        known = count > 0
        yield {"kind": "vocabulary", "shard": shard, "a": _steps(words[known])}
        much = count > shard_tokens // 2
        if much.any():
            yield {"kind": "hot", "shard": shard, "a": words[much].tobytes(), "b": count[much].tobytes()}
        yield {"kind": "sums", "shard": shard, "s0": float(count.sum()), "s1": float(known.sum())}

    return _per_shard(_rows(made.select("block", "words", "counts"), asked), counted)


# restaurants

class Restaurants:
    """Contexts, followers (both ascending hashes) and pairs of a shard, in order of both."""

    def __init__(self, row: dict, words: int):
        self.contexts, self.followers = _climb(row["a"]), _climb(row["c"])
        self.context = np.repeat(np.arange(len(self.contexts)), _spread(row["b"], np.uint32))
        self.follower, self.customers = _spread(row["d"], np.uint32).astype(np.int64), _spread(row["e"], np.uint32).astype(np.int64)
        shard = shard_of(self.followers, words)
        #: Followers by the shard of words that they belong to.
        self.order = _grouping(shard, words)
        self.cuts = np.searchsorted(shard[self.order], np.arange(words + 1))


def seat_blocks(made: DataFrame, shards: int, hot: Hot) -> DataFrame:
    """Of each shard its restaurants, with every pair that any block has; for each block the places of its pairs; and followers for the shards of words ("follow")."""

    def asked(row):
        block = Block(row)
        counts = block.pair_counts()
        for s, at in block.by_shard(shards, hot):
            context = block.context[at]
            heads = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            followers, place = np.unique(block.follower[at], return_inverse=True)
            yield {"kind": "pairs", "shard": s, "other": row["block"], "a": _steps(block.context_hash[context[heads]]), "b": _small(np.diff(np.append(heads, len(at)))), "c": _steps(block.words[followers]), "d": _small(place), "e": _small(counts[at])}

    def seated(rows, shard):
        contexts = np.unique(np.concatenate([_climb(r["a"]) for r in rows["pairs"]]))
        followers = np.unique(np.concatenate([_climb(r["c"]) for r in rows["pairs"]]))
        keys, counts = [], []
        for r in rows["pairs"]:
            context = np.repeat(np.searchsorted(contexts, _climb(r["a"])), _spread(r["b"], np.uint32))
            keys.append(context * len(followers) + np.searchsorted(followers, _climb(r["c"]))[_spread(r["d"], np.uint32)])
            counts.append(_spread(r["e"], np.uint32))
        pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
        customers = np.bincount(place, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        context = pairs // len(followers)
        row = {"a": _steps(contexts), "b": _small(np.bincount(context, minlength=len(contexts))), "c": _steps(followers), "d": _small(pairs % len(followers)), "e": _small(customers)}
        at = 0
        for r, k in zip(rows["pairs"], keys, strict=True):
            yield {"kind": "places", "shard": shard, "other": r["other"], "a": _small(np.diff(place[at : at + len(k)], prepend=0))}
            at += len(k)
        yield {"kind": "restaurants", "shard": shard, **row}
        own = Restaurants(row, shards)
        for w in range(shards):
            mine = own.order[own.cuts[w] : own.cuts[w + 1]]
            if len(mine):
                yield {"kind": "follow", "shard": w, "other": shard, "a": _steps(own.followers[mine])}
        yield from _tables(own, np.minimum(customers, 1), shard, shards)
        yield {"kind": "sums", "shard": shard, "s0": float((customers == 1).sum()), "s1": float((customers == 2).sum())}
        yield from _hot_tables(own, np.minimum(customers, 1), shard, hot)

    return _per_shard(_rows(made.select("block", "held", "sizes", "words", "counts", "tokens"), asked), seated)


def _tables(own: Restaurants, tables: np.ndarray, shard: int, shards: int):
    """Tables of each follower, to the shards of words."""
    of_word = np.bincount(own.follower, weights=tables, minlength=len(own.followers)).astype(np.int64)
    for w in range(shards):
        mine = own.order[own.cuts[w] : own.cuts[w + 1]]
        if len(mine):
            yield {"kind": "tables", "shard": w, "other": shard, "a": _planes(of_word[mine])}


def _hot_tables(own: Restaurants, tables: np.ndarray, shard: int, hot: Hot):
    """Tables of the parts of split restaurants, for the driver."""
    mine = np.flatnonzero(np.isin(own.contexts, np.array(sorted(hot), _U))) if hot else []
    if len(mine):
        total = np.bincount(own.context, weights=tables, minlength=len(own.contexts))
        yield {"kind": "hot", "shard": shard, "a": own.contexts[mine].tobytes(), "b": total[mine].tobytes()}


def seat_parent(words: DataFrame, follow: DataFrame, tables: DataFrame, sweep: int, discount: float, rate: float) -> DataFrame:
    """The parent's dishes given all tables: for the shards of contexts, customers less discounted tables ("masses"); sums of customers, tables, and dishes of one and two customers."""

    def seated(rows, shard):
        vocabulary = _climb(rows["vocabulary"][0]["a"]) if "vocabulary" in rows else np.zeros(0, _U)
        given, total = {r["other"]: _spread(r["a"], np.int64) for r in rows.get("tables", ())}, np.zeros(len(vocabulary) + 1)
        places = []
        for r in rows.get("follow", ()):
            asked = _climb(r["a"])
            at = np.searchsorted(vocabulary, asked)
            known = at < len(vocabulary)
            known[known] = vocabulary[at[known]] == asked[known]
            at[~known] = len(vocabulary)
            places.append((r["other"], at))
            np.add.at(total, at, given[r["other"]])
        customers = total[:-1].astype(np.int64)
        key = bytekit.mix64(vocabulary + _U((SEED + 1000 * sweep) * _PHI & 0xFFFFFFFFFFFFFFFF))
        own = draw_tables(customers, np.full(len(customers), rate), discount, key)
        mass = np.append(customers - discount * own, 0.0).astype(np.float32)
        for other, at in places:
            yield {"kind": "masses", "shard": other, "other": shard, "a": _planes(mass[at])}
        yield {"kind": "sums", "shard": shard, "s0": float(customers.sum()), "s1": float(own.sum()), "s2": float((customers == 1).sum()), "s3": float((customers == 2).sum())}

    return _per_shard(words.where("kind = 'vocabulary'").unionByName(follow).unionByName(tables), seated)


class Parent:
    """What turns masses into probabilities: customers and tables of all dishes, discount, and words."""

    def __init__(self, customers: float, tables: float, discount: float, words: float):
        self.whole = PARENT_STRENGTH + customers
        self.back = (PARENT_STRENGTH + discount * tables) / (words + 1)

    def probability(self, mass: np.ndarray) -> np.ndarray:
        return (mass + self.back) / self.whole


def sweep_restaurants(seats: DataFrame, state: DataFrame | None, masses: DataFrame, shards: int, sweep: int, discount: float, parent: Parent, hot: Hot, hot_tables: dict[int, float]) -> DataFrame:
    """New tables of all restaurants given the parent; from the first kept sweep on, what their predictive probabilities are made of.

    A row "state" has tables, their sum over kept sweeps, and for each kept sweep the tables of each
    context and the parent's probability of each follower. After the last sweep there are "answers"
    for blocks instead: the logarithm of the mean probability of each of their pairs.
    """
    last = sweep == SWEEPS - 1

    def swept(rows, shard):
        own = Restaurants(rows["restaurants"][0], shards)
        n, k = len(own.contexts), max(0, sweep - (SWEEPS - KEPT))
        p = np.zeros(len(own.followers))
        for r in rows["masses"]:
            p[own.order[own.cuts[r["other"]] : own.cuts[r["other"] + 1]]] = parent.probability(_spread(r["a"], np.float32).astype(float))
        if "state" in rows:
            r = rows["state"][0]
            tables, summed = _spread(r["a"], np.uint32).astype(np.int64), _spread(r["b"], np.uint32).astype(np.int64)
            of_context, of_follower = _spread(r["c"], np.float32).reshape(k, n).astype(float), _spread(r["d"], np.float32).reshape(k, len(p)).astype(float)
        else:
            tables, summed = np.minimum(own.customers, 1), np.zeros(len(own.customers), np.int64)
            of_context, of_follower = np.zeros((0, n)), np.zeros((0, len(p)))
        split = np.flatnonzero(np.isin(own.contexts, np.array(sorted(hot), _U))) if hot else []
        total = np.bincount(own.context, weights=tables, minlength=n)
        for i in split:
            total[i] = hot_tables[int(own.contexts[i])]
        turn = _U((SEED + 7 + 1000 * sweep) * _PHI & 0xFFFFFFFFFFFFFFFF)
        u = gamma(CONTEXT_STRENGTH / discount + total, bytekit.mix64(own.contexts + turn))
        # none or one customer has as many tables: only the others are drawn
        tables, several = np.minimum(own.customers, 1), np.flatnonzero(own.customers > 1)
        context, follower = own.context[several], own.follower[several]
        key = bytekit.mix64(bytekit.mix64(own.contexts + turn)[context] ^ own.followers[follower])
        tables[several] = draw_tables(own.customers[several], discount * u[context] * p[follower], discount, key)
        yield from _hot_tables(own, tables, shard, hot)
        if not last:
            yield from _tables(own, tables, shard, shards)
        if sweep >= SWEEPS - KEPT:
            summed = summed + tables
            of_context = np.concatenate([of_context, [np.bincount(own.context, weights=tables, minlength=n)]])
            of_follower = np.concatenate([of_follower, [p]])
        yield {"kind": "state", "shard": shard, "a": _small(tables), "b": _small(summed), "c": _planes(of_context.astype(np.float32).ravel()), "d": _planes(of_follower.astype(np.float32).ravel())}

    parts = [seats.where("kind = 'restaurants'"), masses.where("kind = 'masses'")] + ([state.where("kind = 'state'")] if state is not None else [])
    whole = parts[0]
    for df in parts[1:]:
        whole = whole.unionByName(df)
    return _per_shard(whole, swept)


def answers(seats: DataFrame, state: DataFrame, shards: int, discount: float, hot: Hot, hot_kept: list[dict[int, float]]) -> DataFrame:
    """For each block and shard the base-10 logarithm of its pairs' mean predictive probability."""

    def answered(rows, shard):
        own, r = Restaurants(rows["restaurants"][0], shards), rows["state"][0]
        n, m = len(own.contexts), len(own.followers)
        summed = _spread(r["b"], np.uint32).astype(float)
        of_context, of_follower = _spread(r["c"], np.float32).reshape(KEPT, n).astype(float), _spread(r["d"], np.float32).reshape(KEPT, m).astype(float)
        total = np.bincount(own.context, weights=own.customers, minlength=n)
        for i in np.flatnonzero(np.isin(own.contexts, np.array(sorted(hot), _U))) if hot else []:
            word = int(own.contexts[i])
            total[i] = hot[word][0]
            of_context[:, i] = [kept[word] for kept in hot_kept]
        back = np.zeros(len(own.context))
        for tables, p in zip(of_context, of_follower, strict=True):
            back += (CONTEXT_STRENGTH + discount * tables)[own.context] * p[own.follower]
        p = (own.customers - discount * summed / KEPT + back / KEPT) / (CONTEXT_STRENGTH + total)[own.context]
        logs = np.log10(p).astype(np.float32)
        for r in rows["places"]:
            yield {"kind": "answers", "shard": shard, "other": r["other"], "a": _planes(logs[np.cumsum(_spread(r["a"], np.int32), dtype=np.int64)])}

    return _per_shard(seats.where("kind in ('restaurants', 'places')").unionByName(state.where("kind = 'state'")), answered)


# scores

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(made: DataFrame, given: DataFrame, words: DataFrame, shards: int, hot: Hot, n: int, v: int) -> DataFrame:
    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block, got = Block(row), right.to_pylist()
        count, logs = np.zeros(len(block.words), np.int64), np.zeros(len(block.pairs))
        w_shard, mine = shard_of(block.words, shards), dict(block.by_shard(shards, hot))
        w_order = _grouping(w_shard, shards)
        w_cuts = np.searchsorted(w_shard[w_order], np.arange(shards + 1))
        for r in got:
            if r["kind"] == "counts":
                count[w_order[w_cuts[r["shard"]] : w_cuts[r["shard"] + 1]]] = _spread(r["a"], np.int64)
            else:
                logs[mine[r["shard"]]] = _spread(r["a"], np.float32)
        by_token = np.concatenate(([0.0], np.cumsum(logs[block.pair_of])))
        base = np.concatenate(([0.0], np.cumsum(np.log10((count + 1) / (n + v + 1))[block.tokens])))
        known = np.concatenate(([0], np.cumsum((count > 0)[block.tokens])))
        begin = block.ends - block.sizes
        ids = pa.array(_un(row["doc_ids"], np.int64), mask=_un(row["nulls"], bool))
        columns = [ids, pa.array(block.held), pa.array(block.sizes.astype(np.int64)), pa.array(known[block.ends] - known[begin]), pa.array(base[block.ends] - base[begin]), pa.array(by_token[block.ends] - by_token[begin])]
        del block, got, logs, by_token, base
        bytekit.give_back()
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _SCORES.split(", ")])

    both = given.where("kind = 'answers'").unionByName(words.where("kind = 'counts'")).select("kind", "shard", F.col("other").alias("block"), "a")
    out = made.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(scored, _SCORES)
    return out.withColumn("train_tokens", F.lit(n).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def discount_of(one: float, two: float) -> float:
    """From the numbers of dishes with one and two customers, to two decimals."""
    return round(min(0.95, max(0.05, one / (one + 2 * two))), 2) if one else 0.5


def _summed(df: DataFrame) -> list[float]:
    row = df.where("kind = 'sums'").agg(*[F.sum(F.col(f"s{i}")) for i in range(4)]).first()
    return [float(x or 0) for x in row]


def _hot_sums(df: DataFrame) -> dict[int, float]:
    out: dict[int, float] = {}
    for r in df.where("kind = 'hot'").select("a", "b").collect():
        for word, t in zip(_un(r.a, _U).tolist(), _un(r.b, float).tolist(), strict=True):
            out[word] = out.get(word, 0.0) + t
    return out


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    made = staged(blocks(docs, block_bytes), "blocks")
    shards = max(1, -(-int(made.agg(F.sum("n_tokens").alias("n")).first().n or 0) // shard_tokens))
    words = staged(count_words(made, shards, shard_tokens), "words")
    n, v, *_ = _summed(words)
    hot: Hot = {w: (c, -(-2 * c // shard_tokens)) for r in words.where("kind = 'hot'").collect() for w, c in zip(_un(r.a, _U).tolist(), _un(r.b, np.int64).tolist(), strict=True)}
    if int(END) in hot:  # texts begin as often as they end
        hot[int(BEGIN)] = hot[int(END)]
    seats = staged(seat_blocks(made, shards, hot), "restaurants")
    discount = discount_of(*_summed(seats)[:2])
    follow, tables, state, hot_tables, kept = seats.where("kind = 'follow'"), seats, None, _hot_sums(seats), []
    parent_discount, parent_tables, rate = 0.5, v, 0.0
    for sweep in range(SWEEPS):
        u = float(np.random.default_rng([SEED, sweep]).gamma(PARENT_STRENGTH / parent_discount + parent_tables))
        rate = parent_discount * u / (v + 1)
        masses = staged(seat_parent(words, follow, tables.where("kind = 'tables'"), sweep, parent_discount, rate), "masses")
        customers, parent_tables, one, two = _summed(masses)
        parent = Parent(customers, parent_tables, parent_discount, v)
        fresh = staged(sweep_restaurants(seats, state, masses, shards, sweep, discount, parent, hot, hot_tables), "state")
        discard(masses, *([state] if state is not None else []))
        state = tables = fresh
        parent_discount, hot_tables = discount_of(one, two), _hot_sums(state)
        if sweep >= SWEEPS - KEPT:
            kept.append(hot_tables)
    given = staged(answers(seats, state, shards, discount, hot, kept), "answers")
    discard(seats, state)
    return scores(made, given, words, shards, hot, int(n), int(v))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
