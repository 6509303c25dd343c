"""Fitted operators: forward-backward against enumeration, counts against brute force, held-out accuracy."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from feedforge.llm import bytekit, fitting, quality_lines, quality_rules, toxicity
from feedforge.llm.fitting import ChainField, platt

SF = "/root/testdata/sf0.01"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    unary, bounds = rng.normal(size=11), np.array([0, 4, 4, 5, 11])
    move, begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    got = ChainField(np.zeros(1), move, begin).marginals(unary, bounds)
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        weights, ones = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(begin[y[0]] + sum(move[p, q] for p, q in zip(y, y[1:])) + np.dot(unary[a:b], y))
            weights, ones = weights + w, ones + w * np.array(y)
        assert np.allclose(got[a:b], ones / weights)


def test_fit_recovers_separable_chains():
    rng = np.random.default_rng(1)
    bounds = np.arange(0, 401, 10)
    label = np.repeat(rng.integers(0, 2, 40), 10)
    x = np.stack([label * 2.0 - 1 + rng.normal(size=400), np.ones(400)], 1)
    field = ChainField.fit(x, label, bounds, steps=200)
    assert np.mean((field.marginals(x @ field.weights, bounds) > 0.5) == label) > 0.98
    a, b = platt(x[:, 0], label)
    assert a > 0 and abs(b) < 1
    assert platt(x[:, 0], np.ones(400)) == (1.0, 0.0)


def accuracy(scored, marks, target):
    rows = scored.where("held_out").join(marks.select("doc_id", target), "doc_id").collect()
    return len(rows), np.mean([r.predicted == r[target] for r in rows])


def test_quality_lines_held_out(spark, docs, marks):
    n, share = accuracy(quality_lines.op8_quality_lines(spark, SF), marks, "quality")
    assert n > 50 and share > 0.95


def test_toxicity_held_out(spark, docs):
    """Of held-out toxic documents most are caught, and few clean ones are."""
    at = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, at).where("held_out").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert sum(r.toxic for r in rows) > 50
    assert caught >= 0.85 * sum(r.toxic for r in rows) and caught >= 0.9 * sum(r.predicted for r in rows)
    assert sum(r.spans != "" for r in rows if r.predicted) > 0.8 * sum(r.predicted for r in rows)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, found, lines = Counter(runs), set(), set()
    for i, run in enumerate(runs):
        if seen[run] > 1:
            found.update(range(i, i + 8))
    dup = 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(found) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(found), failed


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rule_counts_by_brute_force(request, which):
    df = request.getfixturevalue(which)
    got = quality_rules.judge(df.select("doc_id", "text"), None).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(r.text or "")
        assert r.kept == (not r.base_failed) and r.probability is None


def test_rules_keep_good_documents(spark, docs, marks):
    full = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality_rules.judge(full, quality_rules.fit(full, marks, rows=300)).join(marks, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert np.mean(good) > 0.95 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.5


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows(request, spark, which, marks):
    df = request.getfixturevalue(which)
    n = df.count()
    model = quality_lines.fit(df, marks.limit(0))
    assert [r.score for r in quality_lines.score(df, model).collect()] == [0.5] * n
    assert toxicity.fit(df, marks.limit(0)) is None
    tox = toxicity.score(df, None).collect()
    assert len(tox) == n and all(r.score == 0 and r.spans == [] and r.lang in (None, "en") for r in tox)
    assert quality_rules.fit(df, marks.limit(0)) is None
    nulls = marks.limit(3).selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic").unionByName(marks.limit(1).selectExpr("cast(null as long) doc_id", "quality", "toxic"))
    assert toxicity.fit(df, nulls) is None and quality_rules.fit(df, nulls) is None


def test_fitted_models_take_odd_rows(spark, docs, odd, marks):
    full = spark.read.parquet(f"{SF}/documents.parquet")
    lines, rules, tox = quality_lines.fit(full, marks), quality_rules.fit(full, marks, rows=300), toxicity.fit(full, marks)
    for df in (odd, odd.limit(0)):
        n = df.count()
        for out in (quality_lines.score(df, lines), toxicity.score(df, tox)):
            rows = out.collect()
            assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        rows = quality_rules.judge(df, rules).collect()
        assert len(rows) == n and all(0 <= r.probability <= 1 and r.kept <= (not r.base_failed) for r in rows)
    same = quality_lines.score(odd, lines).where("doc_id = 1").collect()
    assert same[0].score == same[1].score


def test_none_and_its_gradient_by_enumeration():
    rng = np.random.default_rng(9)
    x, bounds, any_one, each = rng.normal(size=(9, 2)), np.array([0, 3, 5, 9]), np.array([1, 0, 1]), np.ones(9)
    w, move, begin = rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=2)

    def logs(w, move, begin):
        out = []
        for a, b in zip(bounds, bounds[1:]):
            score = {y: begin[y[0]] + sum(move[p, q] for p, q in zip(y, y[1:])) + np.dot(x[a:b] @ w, y) for y in itertools.product((0, 1), repeat=int(b - a))}
            out.append(score[(0,) * int(b - a)] - np.log(np.sum(np.exp(list(score.values())))))
        return np.array(out)

    assert np.allclose(ChainField(w, move, begin).none(x @ w, bounds)[1], logs(w, move, begin))
    theta = np.concatenate([w, move.ravel(), begin])
    loss = lambda t: np.mean(np.where(any_one > 0, -np.log(-np.expm1(logs(t[:2], t[2:6].reshape(2, 2), t[6:]))), -logs(t[:2], t[2:6].reshape(2, 2), t[6:])))
    want = np.array([(loss(theta + e) - loss(theta - e)) / 2e-6 for e in np.eye(8) * 1e-6])
    found = []
    real, fitting.adam = fitting.adam, lambda gradient, x, steps, rate: (found.append(gradient(x)), x)[1]
    try:
        ChainField.fit_any(x, any_one, bounds, each, theta)
    finally:
        fitting.adam = real
    assert np.allclose(found[0], want, atol=1e-5)


def test_latent_tags_find_the_cause():
    """Only whole chains are labelled; the field still tags the positions that make the difference."""
    rng = np.random.default_rng(2)
    bounds = np.arange(0, 4001, 20)
    any_one = np.arange(200) % 2
    cause = np.zeros(4000)
    for i in np.flatnonzero(any_one):
        cause[bounds[i] + rng.integers(0, 17) + np.arange(3)] = 1
    x = np.stack([cause, (rng.random(4000) < 0.1).astype(float), np.ones(4000)], 1)
    start = np.zeros(9)
    start[:3] = (1, 1, -3)
    field = ChainField.fit_any(x, any_one, bounds, np.ones(4000), start)
    tags = field.marginals(x @ field.weights, bounds) > 0.5
    assert tags[cause == 1].mean() > 0.9 and tags[cause == 0].mean() < 0.02


def test_toxic_spans_are_found_beside_clean_words():
    field = ChainField(np.array([5.0, 4, 4, 4, 0, 0, 5, -2, -2, -1, 0, -2.0]), np.array([[2.0, -2], [-2, -2]]), np.array([0.0, -2]))
    model = toxicity.ToxicTokens({"=bad": 9.0}, field, (1.0, 0.0))
    texts = ["", "fine " * 500, "fine " * 300 + "Bad! " + "fine " * 300]
    score, spans = model.score(texts)
    assert spans == [[], [], [(1500, 1504)]] and score[2] > score[1] and score[0] <= score[1] + 1e-9
    whole, whole_none = field.none(*chain(model, texts[2]))
    near, none = model.tag([model.hits(toxicity._split(texts[2]))], [601])[0]
    assert np.allclose([near[299], near[300], near[301]], whole[299:302])
    assert none == pytest.approx(whole_none[0], rel=1e-6)


def chain(model, text):
    words = toxicity._split(text)
    table = np.zeros((len(words) + 2, toxicity._WIDTH))
    for i, c in model.hits(words).items():
        table[i + 1] = c
    return toxicity._features(table[1:-1], table[:-2], table[2:]) @ model.field.weights, np.array([0, len(words)])


def test_span_hashes_and_lines():
    texts = bytekit.Texts([b"ab cd\nab", b"", b"cd"])
    first, last, bounds = texts.words()
    h = texts.span_hashes(first, last)
    assert bounds.tolist() == [0, 3, 3, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert texts.lines()[2].tolist() == [0, 2, 3, 4]
