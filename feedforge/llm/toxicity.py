"""Toxicity: a linear-chain conditional random field that tags toxic tokens.

Labels mark whole documents, so the labels of tokens are latent: the field is fitted by the marginal
likelihood that a toxic document has a toxic token at least and a clean one has none. Its features
are lexical (how far a word, or the first letters of a word, is associated with toxic documents of
the sample), of shape (length, characters beside letters) and of context (the same of the two
neighbours), all over whole texts. Forward-backward gives each token's probability of being toxic.
The document's score is the calibrated chance that any of its tokens is, and the spans whose
probability reaches a half are reported by code point offsets.

Tokens without any association all look alike, so a run of them is shortened to the length after
which forward and backward messages stand still in double precision, and its middle counts for what
is left out; results are those of the full chain, at the cost of the tokens that matter. In fitting,
runs are shortened to TRAIN_RUN on either side.

Null texts count as empty; a text without tokens has the raw score of no toxic token. Repeated
rows get equal scores. Without usable labels every score is 0. Extra columns pass through; a
column named like an output is replaced by it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit, common
from .fitting import ChainField, platt, sigmoid

#: Bound of the sample of labelled documents; each is used whole.
SAMPLE_ROWS = 6000
THRESHOLD = 0.5
MODULUS, HELD = 5, 0
#: A feature counts from so many toxic documents and so high a log odds ratio.
LEAST_DOCUMENTS, LEAST_ODDS = 3, 1.5
PREFIXES = (6, 5, 4)
#: Positions that are left of a run without associations on either side in fitting.
TRAIN_RUN = 12
#: Words whose class a worker remembers.
MEMO = 500_000

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|#*$%&-_"


def forms(word: str) -> tuple[str, ...]:
    """What a token is looked up by: the bare word, and its first letters."""
    bare = word.strip(_EDGE)
    return ("=" + bare, *("^" + bare[:k] if len(bare) > k else "" for k in PREFIXES))


class ToxicTokens:
    def __init__(self, strength: dict[str, float], field: ChainField, scale: tuple[float, float]):
        self.strength, self.field, self.scale = strength, field, scale
        self._prepare()

    def _prepare(self):
        move = self.field.move
        self.base = float(_features(*[np.zeros((1, _WIDTH))] * 3)[0] @ self.field.weights)
        step = np.exp(move) * np.exp([0.0, self.base])[None, :]
        eigen = np.sort(np.abs(np.linalg.eigvals(step)))
        ratio = float(eigen[0] / eigen[1])
        self.still = 4 + (0 if ratio <= 0 else math.ceil(math.log(1e-17) / math.log(min(ratio, 1 - 1e-12))))
        self._memo: dict[str, tuple] = {}

    def __getstate__(self):
        return self.strength, self.field, self.scale

    def __setstate__(self, state):
        self.strength, self.field, self.scale = state
        self._prepare()

    def look_up(self, word: str):
        """The token's strengths by form and its shape, or None where it has no strength."""
        found = tuple(self.strength.get(x, 0.0) for x in forms(word))
        return (*found, *shape(word)) if any(found) else None

    def _classes(self, words: list[str]) -> list:
        memo, out = self._memo, []
        for w in words:
            try:
                out.append(memo[w])
            except KeyError:
                got = self.look_up(w)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = got
                out.append(got)
        return out

    def hits(self, words: list[str]) -> dict[int, tuple]:
        return {i: c for i, c in enumerate(self._classes(words)) if c is not None}

    def chains(self, hits: list[dict[int, tuple]], sizes: list[int], still: int):
        """(features, count of each position, its token or -1, bounds) of texts with runs shortened to `still` on either side."""
        blank = [0.0] * _WIDTH
        own, before, after, each, token, bounds = [], [], [], [], [], [0]
        for found, n in zip(hits, sizes, strict=True):
            near = sorted({j for i in found for j in (i - 1, i, i + 1) if 0 <= j < n})
            last = -1
            for j in (*near, n):
                gap = j - last - 1
                kept = min(gap, 2 * still + 1)
                if kept:
                    weights = [1.0] * kept
                    weights[kept // 2] += gap - kept
                    each.extend(weights)
                    token.extend([-1] * kept)
                    for side in (own, before, after):
                        side.extend([blank] * kept)
                if j < n:
                    for side, i in ((own, j), (before, j - 1), (after, j + 1)):
                        side.append(found.get(i, blank))
                    each.append(1.0)
                    token.append(j)
                last = j
            bounds.append(len(each))
        table = lambda x: np.array(x, np.float32).reshape(-1, _WIDTH)
        return _features(table(own), table(before), table(after)), np.array(each), np.array(token, np.int64), np.array(bounds)

    def tag(self, hits: list[dict[int, tuple]], sizes: list[int]) -> list[tuple[dict[int, float], float]]:
        """For each text: probability of the tokens at or beside a hit, and the log chance that no token is toxic."""
        out: list = [None] * len(hits)
        plain: dict[int, list[int]] = {}
        for k, (found, n) in enumerate(zip(hits, sizes, strict=True)):
            if not found:  # texts without a hit differ in length alone
                plain.setdefault(n, []).append(k)
        some = [k for k, found in enumerate(hits) if found] + [own[0] for own in plain.values()]
        x, each, token, bounds = self.chains([hits[k] for k in some], [sizes[k] for k in some], self.still)
        p, none = self.field.none(x @ self.field.weights, bounds, each)
        for i, k in enumerate(some):
            a, b = bounds[i], bounds[i + 1]
            at = np.flatnonzero(token[a:b] >= 0) + a
            out[k] = (dict(zip(token[at].tolist(), p[at].tolist(), strict=True)), float(none[i]))
        for own in plain.values():
            for k in own[1:]:
                out[k] = out[own[0]]
        return out

    def raw(self, none: np.ndarray) -> np.ndarray:
        """Log odds of some token being toxic."""
        none = np.minimum(none, -1e-12)
        return np.log(-np.expm1(none)) - none

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(score, toxic spans as code point offsets) of each text."""
        words = [_split(x) for x in texts]
        hits = [self.hits(w) for w in words]
        tags = self.tag(hits, [len(w) for w in words])
        spans = []
        for text, (near, _) in zip(texts, tags, strict=True):
            wanted = {j for j, q in near.items() if q >= 0.5}
            spans.append([m.span() for i, m in enumerate(_TOKEN.finditer(text)) if i in wanted] if wanted else [])
        return sigmoid(self.scale[0] * self.raw(np.array([t[1] for t in tags])) + self.scale[1]), spans


def _split(text: str) -> list[str]:
    """Words of the lower-case text. Letters that change their length still belong to the same word."""
    return [w.decode() for w in text.lower().encode().split()] if not text.isascii() else text.lower().translate(_ODD).split()


#: str.split() also splits at these ASCII characters, which belong to words.
_ODD = {0x1C: "�", 0x1D: "�", 0x1E: "�", 0x1F: "�"}
_STRENGTHS = 1 + len(PREFIXES)
_WIDTH = _STRENGTHS + 2


def shape(word: str) -> tuple[float, float]:
    """Length, and share of characters that aren't letters."""
    return min(len(word), 20) / 20, sum(not c.isalpha() for c in word) / max(1, len(word))


def _features(own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    hit = lambda x: (x[:, :_STRENGTHS] > 0).any(1, keepdims=True).astype(float)
    top = lambda x: x[:, :_STRENGTHS].max(1, keepdims=True) / 5
    return np.concatenate([own[:, :_STRENGTHS] / 5, own[:, _STRENGTHS:], hit(own), top(before), top(after), hit(before) * hit(own), hit(after) * hit(own), np.ones((len(own), 1))], 1)


def _strengths(sample: DataFrame) -> tuple[dict[str, float], int]:
    """Forms that are associated with toxic documents of the sample, and the number of its labels: counted on executors, over whole texts."""

    def counted(batches):
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total[label].update({f for w in set(_split(text)) for f in forms(w) if len(f) > 3})
                total[label][""] += 1
        for label, counts in total.items():
            yield pa.RecordBatch.from_pydict({"form": pa.array(list(counts), pa.string()), "toxic": pa.array([n * label for n in counts.values()], pa.int64()), "clean": pa.array([n * (1 - label) for n in counts.values()], pa.int64())})

    per = sample.mapInArrow(counted, "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = {r.form: (r.toxic, r.clean) for r in per.where((F.col("form") == "") | (F.col("toxic") >= LEAST_DOCUMENTS)).collect()}
    toxic, clean = got.pop("", (0, 0))
    odds = {f: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for f, (a, b) in got.items()}
    return {f: x for f, x in odds.items() if x >= LEAST_ODDS}, (toxic > 0) + (clean > 0)


def fit(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held: int = HELD) -> ToxicTokens | None:
    """Fit on at most `rows` labelled documents that aren't held out, each of them whole; None without both labels."""
    sample = common.labelled_sample(docs, marks, "toxic", modulus, held, rows)
    strength, labels = _strengths(sample)
    if labels < 2:
        return None
    width = _features(*[np.zeros((1, _WIDTH))] * 3).shape[1]
    start = np.zeros(width + 6)
    start[:_STRENGTHS], start[width - 1] = 1.0, -6.0  # no token is toxic at first, but for strong associations
    model = ToxicTokens(strength, ChainField(start[:width], np.zeros((2, 2)), np.zeros(2)), (1.0, 0.0))

    def found(batches):
        for batch in batches:
            words = [_split(x) for x in batch.column(1).to_pylist()]
            hits = [model.hits(w) for w in words]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "label": batch.column(2), "n": pa.array([len(w) for w in words], pa.int64()),
                "at": pa.array([np.array(list(h), np.int32).tobytes() for h in hits]), "what": pa.array([np.array(list(h.values()), np.float32).tobytes() for h in hits]),
            })

    got = sample.mapInArrow(found, "doc_id long, label int, n long, at binary, what binary").collect()
    got.sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).digest(), r.n, bytes(r.at), bytes(r.what)))
    label, sizes = np.array([r.label for r in got]), [r.n for r in got]
    hits = [dict(zip(np.frombuffer(r.at, np.int32).tolist(), map(tuple, np.frombuffer(r.what, np.float32).reshape(-1, _WIDTH).tolist()), strict=True)) for r in got]
    x, each, _, bounds = model.chains(hits, sizes, TRAIN_RUN)
    model.field = ChainField.fit_any(x, label, bounds, each, start)
    model._prepare()
    model.scale = platt(model.raw(np.array([t[1] for t in model.tag(hits, sizes)])), label)
    return model


def score(docs: DataFrame, model: ToxicTokens | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score, predicted (1 if score >= threshold) and spans (toxic tokens as [start, end) code points)."""
    docs = docs.drop("score", "predicted", "spans")
    names = docs.columns

    def scored(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            texts = [b.decode() for b in texts.blobs]
            s, spans = model.score(texts) if model else (np.zeros(len(texts)), [[] for _ in texts])
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), spans], names=[*names, "score", "predicted", "spans"])

    return docs.mapInArrow(scored, common.widened(docs.schema, "score double, predicted int, spans array<struct<start: bigint, end: bigint>>"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = score(docs.select("doc_id", "text"), fit(docs, common.labels(spark, sf_dir)))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", (common.crc_bucket(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", "predicted", spans.alias("spans"))
