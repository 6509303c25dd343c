"""Each stage of the pipeline on what the one before kept, against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from feedforge.llm import bytekit, common, packing, quality_lines, secrets, simhash
from test_texts import WORDS, both_prints, brute_targets, within

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.staged(stage(spark, out[-1], SF), "test"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "secret scans", "source mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality(stages, spark):
    model = quality_lines.fit(stages[0], common.labels(spark, SF))
    all_ = texts(stages[0])
    score = model.score(bytekit.Texts([t.encode() for t in all_.values()]))
    assert set(texts(stages[1])) == {i for i, s in zip(all_, score, strict=True) if s >= quality_lines.THRESHOLD}
    good = {r.doc_id for r in common.labels(spark, SF).where("quality = 1").collect()} & set(all_)
    assert len(good & set(texts(stages[1]))) > 0.97 * len(good)


def test_near_duplicates(stages):
    before, kept = texts(stages[1]), set(texts(stages[2]))
    ids = sorted(before)
    prints = {i: both_prints(before[i]) for i in ids}
    sets = {i: simhash._shingles(before[i], 5) for i in ids}
    root = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if within(prints[a], prints[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    assert kept == {i for i in ids if root[i] == i}
    first = {}
    assert all(i not in kept for i in ids if first.setdefault(before[i], i) != i)


def test_secrets(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    for i, text in after.items():
        found = secrets.base_spans(before[i])
        assert not secrets.base_spans(text) and (text == before[i]) == (not found)
    assert all(r.n_chars == len(r.text) for r in stages[3].collect() if r.text != before[r.doc_id])


def test_mixing(stages):
    rows = stages[3].collect()
    size = {r.doc_id: len(WORDS.findall(r.text)) for r in rows}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append((int(hashlib.md5(f"{r.doc_id}:{r.text}".encode()).hexdigest()[:15], 16), r.doc_id))
    target = brute_targets({s: sum(size[i] for _, i in own) for s, own in by_source.items()})
    want = Counter()
    for s, own in by_source.items():
        whole = sum(size[i] for _, i in own)
        passes = min(3, int(target[s] // whole)) if whole else 0
        at = 0
        for _, i in sorted(own):
            want[i] += passes + (at + size[i] / 2 < target[s] - passes * whole)
            at += size[i]
    assert Counter(r.doc_id for r in stages[4].collect()) == +want


def test_packing(stages):
    import public_tokenizers

    model = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json")).model
    copies = Counter(r.doc_id for r in stages[4].collect())
    length = {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(stages[4]).items()}
    pieces = stages[5].collect()
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
    assert got == {i: n * length[i] for i, n in copies.items()}
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and np.mean(list(fill.values())) > 0.95 * 4096


def test_run_gives_the_last_stage(spark, stages):
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages[5].collect())


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows(request, spark, which):
    """Every stage takes nulls, empty and long texts, repeated rows, clashing columns and empty tables."""
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        assert out.count() >= 0, name
        docs_of_stage = out
    assert (docs_of_stage.count() > 0) == (which == "odd")


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_near_copies_by_exhaustive_similarity(spark, sf):
    """Of all unequal pairs of good texts at 0.8 or more of shared five-word shingles, nine in ten at least lose one; nothing else goes."""
    full = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    marks = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet").where("quality = 0")
    docs = full.join(marks, "doc_id", "left_anti").dropDuplicates(["text"])
    before = texts(docs)
    kept = set(texts(simhash.keep_first(docs)))
    sets = {i: simhash._shingles(t, 5) for i, t in before.items()}
    holders = defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    # what two texts share beyond the most frequent shingles shows in a rarer one
    near = {(a, b) for ids in holders.values() if len(ids) <= 60 for k, a in enumerate(ids) for b in ids[k + 1 :]}
    near = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    met = sum(a not in kept or b not in kept for a, b in near)
    assert near and met >= 0.9 * len(near), (met, len(near))
    partners = {i for pair in near for i in pair}
    assert set(before) - kept <= partners
    print(f"recall at sf{sf}: {met} of {len(near)}")
