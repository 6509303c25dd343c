"""Quality rules: counts with fixed limits, and a hashed n-gram logistic regression beside them.

The regression sees hashed word uni- and bigrams and character 3-, 4- and 5-grams (over bytes,
within words and across single separators). Its margin is the mean weight of a text's features,
by kind, so that long and short texts are on one scale. It is fitted on labelled quality rows,
calibrated on a part of them kept apart, and scored in Arrow batches against a fixed threshold.

Null texts count as texts without words: all counts are 0 and base_failed is true. Repeated rows
get equal results. Without usable labels the verdict of the regression is to keep. Extra columns
pass through; a column named like an output is replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit, common
from .fitting import adam, platt, sigmoid

#: Fixed limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Least calibrated probability of label 1 that keeps a document.
KEEP_AT = 0.5
#: Bounds of the sample that the regression is fitted on: labelled documents, each of them whole, and their bytes together.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 6 << 20
#: Bytes of text hashed at once; a longer text is handled alone.
SCORED_BYTES = 1 << 18
#: Features of the sample that the driver sums at once; the sums are those of the whole sample.
FITTED_AT_ONCE = 1 << 21
BITS = 18
KINDS = 5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def base_counts(texts: bytekit.Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, by text."""
    first, last, bounds = texts.words()
    n_texts, n_words = len(texts.blobs), np.diff(bounds)
    in_word = ~bytekit.IS_SPACE[texts.buf] & ((texts.buf & 0xC0) != 0x80)
    hashes = texts.span_hashes(first, last)
    l_first, l_last, l_bounds = texts.lines()
    of_line = np.searchsorted(l_first, first, side="right") - 1
    full = np.zeros(len(l_first), bool)
    full[of_line] = True
    owner = bytekit.owners(l_bounds)
    key = bytekit.mix64(texts.span_hashes(l_first[full], l_last[full]) + owner[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    dup_lines = np.bincount(owner[full][bytekit.seen_before(key)], minlength=n_texts)
    repeat_words = np.zeros(n_texts, np.int64)
    if len(hashes) >= WINDOW:
        word_owner = bytekit.owners(bounds)
        rolled = bytekit.windows(hashes, WINDOW)
        inside = word_owner[: len(rolled)] == word_owner[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        again = at[bytekit.repeated(bytekit.mix64(rolled[at] + word_owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
        cover = np.zeros(len(hashes) + 1, np.int64)
        cover[again] += 1
        cover[again + WINDOW] -= 1
        repeat_words = np.bincount(word_owner[np.cumsum(cover[:-1]) > 0], minlength=n_texts)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": texts.per_text(in_word),
        "n_symbols": texts.per_text(_IS_SYMBOL[texts.buf]),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": repeat_words.astype(np.int64),
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words),
    }


def _grams(texts: bytekit.Texts):
    """(text of each feature's start or bounds, slots) for each of the KINDS."""
    mask = np.uint32((1 << BITS) - 1)
    first, last, bounds = texts.words()
    words = texts.span_hashes(first, last)
    yield bounds, (words & np.uint64(mask)).astype(np.int32)
    owner = bytekit.owners(bounds)
    pairs = bytekit.windows(words, 2)
    if len(pairs):
        same = owner[:-1] == owner[1:]
        yield np.searchsorted(owner[:-1][same], np.arange(len(bounds))), (pairs[same] & np.uint64(mask)).astype(np.int32)
    else:
        yield np.zeros(len(bounds), np.int64), np.zeros(0, np.int32)
    wide = texts.buf.astype(np.uint32)
    for n in (3, 4, 5):
        code = np.zeros(max(0, len(wide) - n + 1), np.uint32)
        with np.errstate(over="ignore"):
            for k in range(n):
                code *= np.uint32(0x01000193)
                code ^= wide[k : k + len(code)]
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x2C1B3C6D + 2 * n)
            code ^= code >> np.uint32(13)
        yield (texts.start, np.maximum(texts.start, texts.end - n + 1)), (code & mask).astype(np.int32)


def _means(bounds, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the features of each text; 0 without features."""
    low, high = bounds if isinstance(bounds, tuple) else (bounds[:-1], bounds[1:])
    total = np.concatenate(([0.0], np.cumsum(weights[slots], dtype=np.float64)))
    low, high = np.minimum(low, len(slots)), np.minimum(high, len(slots))
    return (total[high] - total[low]) / np.maximum(high - low, 1)


class GramQuality:
    def __init__(self, weights: np.ndarray, bias: float, scale: tuple[float, float]):
        self.weights, self.bias, self.scale = weights, bias, scale

    def score(self, texts: bytekit.Texts) -> np.ndarray:
        margin = np.full(len(texts.blobs), self.bias)
        for kind, (bounds, slots) in enumerate(_grams(texts)):
            margin += _means(bounds, slots, self.weights[kind])
        return sigmoid(self.scale[0] * margin + self.scale[1])


def sparse_rows(texts: bytekit.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots of all kinds, their share of the kind's features) of each whole text."""
    out: list[tuple[list, list]] = [([], []) for _ in texts.blobs]
    for kind, (bounds, slots) in enumerate(_grams(texts)):
        low, high = bounds if isinstance(bounds, tuple) else (bounds[:-1], bounds[1:])
        for (at, share), a, b in zip(out, low, high, strict=True):
            slot, count = np.unique(slots[a:b], return_counts=True)
            at.append(slot + np.int32(kind << BITS))
            share.append((count / max(1, b - a)).astype(np.float32))
    return [(np.concatenate(at).astype(np.int32), np.concatenate(share)) for at, share in out]


def fit(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = 1, held: int = -1) -> GramQuality | None:
    """Fit on at most `rows` whole labelled documents of at most SAMPLE_BYTES bytes together; None without both labels.

    Executors hash the documents to sparse rows; the driver gets eight bytes for each distinct feature of a document.
    """

    def hashed(batches):
        bytekit.give_back()
        for part, texts in bytekit.batches_of_texts(batches, limit=SCORED_BYTES):
            found = sparse_rows(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "label": part.column(2), "slots": pa.array([a.tobytes() for a, _ in found], pa.binary()), "shares": pa.array([b.tobytes() for _, b in found], pa.binary())})

    sample = common.whole_within(common.labelled_sample(docs, marks, "quality", modulus, held, rows), F.octet_length("text"), SAMPLE_BYTES)
    got = sample.mapInArrow(hashed, "doc_id long, label int, slots binary, shares binary").collect()
    got.sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).digest(), bytes(r.slots)))
    label = np.array([r.label for r in got])
    if len(set(label.tolist())) < 2:
        return None
    n, size = len(got), KINDS << BITS
    rows_ = np.repeat(np.arange(n, dtype=np.int32), [len(r.slots) // 4 for r in got])
    slots_, values = np.frombuffer(b"".join(r.slots for r in got), np.int32), np.frombuffer(b"".join(r.shares for r in got), np.float32)
    del got
    apart = np.arange(n) % 5 == 4
    fitted = ~apart
    gain = np.float32(20.0)
    parts = [slice(at, at + FITTED_AT_ONCE) for at in range(0, len(slots_), FITTED_AT_ONCE)]

    def margins(w):
        out = np.zeros(n)
        for part in parts:
            at = rows_[part.start]
            sums = np.bincount(rows_[part] - at, weights=values[part] * w[slots_[part]])
            out[at : at + len(sums)] += sums
        return out * gain + w[-1]

    def gradient(w):
        error = (np.where(fitted, sigmoid(margins(w)) - label, 0) / fitted.sum()).astype(np.float32)
        out = np.empty_like(w)
        sums = np.zeros(size)
        for part in parts:
            sums += np.bincount(slots_[part], weights=error[rows_[part]] * values[part], minlength=size)
        out[:-1] = sums * gain + 1e-7 * w[:-1]
        out[-1] = error.sum()
        return out

    w = adam(gradient, np.zeros(size + 1, np.float32), 60, 0.3)
    return GramQuality((w[:-1] * gain).reshape(KINDS, -1), float(w[-1]), platt(margins(w)[apart], label[apart]))


def judge(docs: DataFrame, model: GramQuality | None, keep_at: float = KEEP_AT) -> DataFrame:
    """docs with the base counts, base_failed, probability (null without a model) and kept."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")
    docs = docs.drop(*added)
    names = docs.columns

    def judged(batches):
        bytekit.give_back()
        for part, texts in bytekit.batches_of_texts(batches, limit=SCORED_BYTES):
            counts = base_counts(texts)
            p = model.score(texts) if model else np.full(len(texts.blobs), np.nan)
            kept = ~counts["base_failed"] & ((p >= keep_at) | np.isnan(p))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in counts.values()), pa.array(p, from_pandas=True), pa.array(kept)], names=[*names, *added])
        bytekit.give_back()

    ddl = ", ".join(f"{x} long" for x in added[:5]) + ", base_failed boolean, probability double, kept boolean"
    return docs.mapInArrow(judged, common.widened(docs.schema, ddl))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return judge(docs.select("doc_id", "text"), fit(docs, common.labels(spark, sf_dir))).drop("text")
