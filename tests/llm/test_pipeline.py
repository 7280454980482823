"""The pipeline's stages, each on what its predecessor kept, against brute-force versions."""

import os
import re

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def runs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    import corpus_pipeline
    from veriloom.llm._base import written

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, docs, SF), "test")
        out.append((name, docs, kept))
        docs = kept
    return out


def _rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_and_columns(spark, runs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _, _ in runs] == ["quality classifier", "exact dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    assert all(kept.columns == columns for _, _, kept in runs[:-1])


def test_quality_stage(spark, runs):
    from veriloom.llm.quality import THRESHOLD, features, fit_texts

    _, docs, kept = runs[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_texts(docs, labels)
    rows = _rows(docs)
    scores = {k: float(model.score(features((r["text"] or "").encode())[None, :])[0]) for k, r in rows.items()}
    sure = {k for k, s in scores.items() if abs(s - THRESHOLD) > 1e-3}
    assert {k for k in _rows(kept)} & sure == {k for k, s in scores.items() if s >= THRESHOLD} & sure
    good = [r["doc_id"] for r in labels.where("quality = 1").collect() if r["doc_id"] in rows]
    assert np.mean([k in _rows(kept) for k in good]) > 0.9


def test_exact_stage(runs):
    _, docs, kept = runs[1]
    groups = {}
    for k, r in _rows(docs).items():
        groups.setdefault(re.sub(r"[ \t-\r]+", "", r["text"] or ""), []).append((-len(r["text"] or ""), k))
    assert set(_rows(kept)) == {min(g)[1] for g in groups.values()}


def test_near_stage(runs):
    """Chains of five-word Jaccard similarities of 0.8 and more, from the words themselves."""
    _, docs, kept = runs[2]
    rows = _rows(docs)
    ids = np.array(sorted(rows))
    sets = []
    for k in ids:
        words = (rows[k]["text"] or "").encode().lower().split()
        sets.append({tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))})
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(ids))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            break
        label = new
    assert set(_rows(kept)) == set(ids[np.unique(label)].tolist())


def test_suffix_stage(runs):
    from veriloom.llm.suffix import cut_text

    _, docs, kept = runs[3]
    rows, seen = _rows(docs), {}
    for k in sorted(rows):
        b = (rows[k]["text"] or "").encode()
        for s in range(len(b) - 99):
            seen.setdefault(b[s : s + 100], (k, s))
    want = {}
    for k, r in rows.items():
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b) + 2, dtype=bool)
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] < (k, s):
                gone[s + 1 : s + 101] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        text = cut_text(r["text"] or "", [{"a": int(a), "b": int(z)} for a, z in edge.reshape(-1, 2)])
        if text or not r["text"]:
            want[k] = text
    got = _rows(kept)
    assert {k: r["text"] or "" for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def test_packing_stage(runs):
    _, docs, packed = runs[4]
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == set(_rows(docs))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_run_sweeps_behind_itself(spark, runs):
    import corpus_pipeline
    from veriloom.llm._base import _PATHS, mark

    before = mark()
    out = corpus_pipeline.run(spark, SF)
    assert len(_PATHS) == before + 1 and out.count() == runs[-1][2].count()
