"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of the lines before and after.
Forward-backward gives each line's probability of being good; the mean of these, weighted by line
length, is the document's raw quality, which a logistic map fitted on the same sample calibrates.

Null texts count as empty; an empty text is one empty line and is scored like any other. Repeated
rows get equal scores. A table without usable labels gives a field without weights: every score
is then 0.5. Extra columns pass through; a column named like an output is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit, common
from .fitting import ChainField, platt, sigmoid

#: Bounds of the sample that the field is fitted on: labelled documents, each of them whole, and their lines together.
SAMPLE_ROWS, SAMPLE_LINES = 6000, 250_000
THRESHOLD = 0.7
MODULUS, HELD = 4, 2


def _table(members: str) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(members.encode("latin-1"))] = 1
    return out


_CLASSES = [
    _table("abcdefghijklmnopqrstuvwxyz"),
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _table("0123456789"),
    _table(" \t\x0b\x0c\r"),
    _table("#*$%&|<>"),
    _table(".,;:'\"-"),
    _table("!?"),
    _table("{}[]()=/\\_@~^`+"),
]
_HIGH = np.zeros(256, np.int8)
_HIGH[0xC0:] = 1


def line_features(texts: bytekit.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, length by line in bytes, bounds of each text's lines)."""
    first, last, bounds = texts.lines()
    size = (last - first).astype(float)
    over = np.maximum(size, 1.0)
    columns = []
    for table in (*_CLASSES, _HIGH):
        total = np.concatenate(([0], np.cumsum(table[texts.buf], dtype=np.int64)))
        columns.append((total[last] - total[first]) / over)
    w_first, w_last, _ = texts.words()
    w_hash = texts.span_hashes(w_first, w_last)
    of_line = np.searchsorted(first, w_first, side="right") - 1
    n_words = np.bincount(of_line, minlength=len(first)).astype(float)
    again = np.concatenate(([0], (w_hash[1:] == w_hash[:-1]) & (of_line[1:] == of_line[:-1]))) if len(w_hash) else np.zeros(0)
    key = bytekit.mix64(w_hash + of_line.astype(np.uint64))
    within = bytekit.seen_before(key) if len(key) else np.zeros(0, bool)
    in_text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    earlier = bytekit.seen_before(bytekit.mix64(texts.span_hashes(first, last) + in_text.astype(np.uint64)))
    some = np.maximum(n_words, 1)
    columns += [
        np.bincount(of_line, weights=again, minlength=len(first)) / some,
        np.bincount(of_line, weights=within, minlength=len(first)) / some,
        np.minimum(size / some / 20, 3.0),
        np.log1p(n_words) / 5,
        (n_words < 3).astype(float),
        earlier.astype(float) * (n_words > 0),
        (size == 0).astype(float),
    ]
    own = np.stack(columns, 1)
    own = np.concatenate([own, np.sqrt(np.abs(own[:, [4, 1, 2, 10]]))], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        joined = in_text[1:] == in_text[:-1]
        before[1:][joined] = own[:-1][joined]
        after[:-1][joined] = own[1:][joined]
    edges = np.zeros((len(own), 2))
    edges[bounds[:-1], 0] = 1
    edges[bounds[1:] - 1, 1] = 1
    return np.concatenate([own, before, after, edges, np.ones((len(own), 1))], 1), size, bounds


class LineQuality:
    def __init__(self, field: ChainField, scale: tuple[float, float]):
        self.field, self.scale = field, scale

    def lines(self, texts: bytekit.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability that the line is good, length, bounds)."""
        features, size, bounds = line_features(texts)
        return self.field.marginals(features @ self.field.weights, bounds), size, bounds

    def raw(self, texts: bytekit.Texts) -> np.ndarray:
        p, size, bounds = self.lines(texts)
        return _weighted(p, size, bounds)

    def score(self, texts: bytekit.Texts) -> np.ndarray:
        raw = np.clip(self.raw(texts), 1e-9, 1 - 1e-9)
        return sigmoid(self.scale[0] * np.log(raw / (1 - raw)) + self.scale[1])


def _weighted(p: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    own, weight = bytekit.owners(bounds), size + 1
    n = len(bounds) - 1
    return np.bincount(own, weights=p * weight, minlength=n) / np.maximum(np.bincount(own, weights=weight, minlength=n), 1)


def fit(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held: int = HELD) -> LineQuality:
    """Fit on at most `rows` whole labelled documents that aren't held out, of at most SAMPLE_LINES lines together.

    Executors turn the sample into features, so that the driver gets numbers of bounded size
    (252 bytes a line).
    """

    def features(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            x, size, bounds = line_features(texts)
            label = part.column(part.schema.get_field_index("_label")).to_pylist()
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            out = [(x[a:b], size[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "label": pa.array(label, pa.int32()), "lines": pa.array([len(s) for _, s in out], pa.int32()),
                "x": pa.array([f.astype(np.float32).tobytes() for f, _ in out], pa.binary()), "size": pa.array([s.astype(np.float32).tobytes() for _, s in out], pa.binary()),
            })

    sample = common.labelled_sample(docs, marks, "quality", modulus, held, rows)
    sample = common.whole_within(sample, F.regexp_count("text", F.lit("\n")) + 1, SAMPLE_LINES)
    got = sorted(sample.mapInArrow(features, "doc_id long, label int, lines int, x binary, size binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    width = line_features(bytekit.Texts([b""]))[0].shape[1]
    if len({r.label for r in got}) < 2:
        return LineQuality(ChainField(np.zeros(width), np.zeros((2, 2)), np.zeros(2)), (1.0, 0.0))
    lines = np.array([r.lines for r in got])
    bounds = np.concatenate(([0], np.cumsum(lines)))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, width) for r in got])
    size = np.concatenate([np.frombuffer(r.size, np.float32) for r in got]).astype(float)
    label = np.array([r.label for r in got])
    del got
    field = ChainField.fit(x, np.repeat(label, lines), bounds)
    raw = np.clip(_weighted(field.marginals(x @ field.weights, bounds), size, bounds), 1e-9, 1 - 1e-9)
    return LineQuality(field, platt(np.log(raw / (1 - raw)), label))


def score(docs: DataFrame, model: LineQuality, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (probability of label 1) and predicted (1 if score >= threshold)."""
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def scored(batches):
        for part, texts in bytekit.batches_of_texts(batches):
            s = model.score(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(scored, common.widened(docs.schema, "score double, predicted int"))


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.labels(spark, sf_dir))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (common.crc_bucket(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", "predicted")
