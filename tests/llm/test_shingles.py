"""Near copies by exact five-word Jaccard similarity, against brute force."""

import random
import re

import pytest


def _set(text):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {b" ".join(w)}


def _kept(rows):
    """Brute force: (id, text) rows without those that a chain of 0.8 and more links to a smaller id."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if 5 * x >= 4 * (len(sets[i]) + len(sets[j]) - x):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {rows[k][0] for k in range(len(rows)) if top(k) == k}


def _planted(seed, groups, copies, size, edits):
    rnd, out = random.Random(seed), []
    words = [f"w{k}" for k in range(3000)]
    for _ in range(groups):
        base = rnd.choices(words, k=rnd.randint(*size))
        out.append(base)
        for _ in range(copies):
            new = list(base)
            for _ in range(rnd.randint(1, edits)):
                new[rnd.randrange(len(new))] = rnd.choice(words)
            out.append(new)
    return [(k, " ".join(x)) for k, x in enumerate(out)]


@pytest.mark.parametrize("rows", [_planted(1, 60, 3, (60, 200), 5), _planted(2, 2, 150, (100, 140), 6)], ids=["small groups", "crowded cells"])
def test_near_copies(docs, rows):
    import corpus_pipeline

    given = docs(rows)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(given.sparkSession, given, "").collect()}
    assert got == _kept(rows) and len(got) < len(rows) - 50


def test_odd_rows(odd):
    from veriloom.llm.shingles import drop_near_copies

    got = sorted(((r["doc_id"], (r["text"] or "")[:16]) for r in drop_near_copies(odd).collect()), key=str)
    assert [x for x in got if x[0] is None] == [(None, ""), (None, "only text")]
    assert {(5, "a b c d"), (5, "other words here"), (1, ""), (8, "abc")} <= set(got) and not {2, 3} & {x[0] for x in got}


def test_stage_on_documents(spark):
    """The stage's input of test_pipeline, by the rule of 0.8."""
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data here")
    seen = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        seen.setdefault(re.sub(r"[ \t-\r]+", "", r["text"] or ""), (r["doc_id"], r["text"] or ""))
    rows = sorted(seen.values())
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, given, sf).collect()}
    assert got == _kept(rows) and len(got) < len(rows)


def test_repeated_ids(docs):
    from veriloom.llm.shingles import drop_near_copies

    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:-1], "other"])
    alone = " ".join(f"v{k}" for k in range(100))
    twice = [" ".join(f"{x}{k}" if k == 99 else f"u{k}" for k in range(100)) for x in "st"]
    given = docs([(1, " ".join(base)), (2, near), (2, alone), (3, twice[0]), (3, twice[1])])
    left = [(r["doc_id"], r["text"]) for r in drop_near_copies(given).collect()]
    assert (1, " ".join(base)) in left and (2, alone) in left and (2, near) not in left
    assert sum(k == 3 for k, _ in left) == 1 and len(left) == 3


def test_fingerprints_give_candidates(docs, monkeypatch):
    """The SimHash range join links what it finds, and pairs that it has linked don't come from the prefix join again."""
    from veriloom.llm import shingles, simhash

    given, asked, verify, prints = docs([(k, " ".join(f"w{j}" for j in range(400) if j != 390 + k)) for k in range(8)]), [], shingles._verify, []
    monkeypatch.setattr(shingles, "_verify", lambda pairs, *x: asked.append(pairs.distinct().count()) or verify(pairs, *x))
    join = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes: prints.append(nodes.count()) or join(nodes))
    assert {r["doc_id"] for r in shingles.drop_near_copies(given).collect()} == {0}
    assert prints and asked[0] > 0 and len(asked) == 2 and asked[1] < 28


def test_parities_of_large_sets():
    """Whatever the sizes, the bits rule out no similar pair, and do rule out sets that share nothing."""
    import numpy as np

    from veriloom.llm.shingles import _differing, needed, parities

    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for n in (50, 600, 700, 3000, 12_000, 40_000):
        x, other = draw(n), draw(n)
        near = np.unique(np.r_[x[: n - n // 9], draw(n // 9)])
        smaller = x[: -(-4 * len(x) // 5)]
        for y in (near, smaller):
            most = len(x) + len(y) - 2 * needed(len(x), len(y))
            assert _differing(parities(x)[None], parities(y)[None])[0] <= np.setxor1d(x, y).size <= most + 2
        assert _differing(parities(x)[None], parities(other)[None])[0] > 2 * n - 2 * needed(n, n)


def test_large_sets_that_only_meet(docs, monkeypatch):
    """Long texts that share a passage are no candidates for whole sets, and near copies of different widths of parities are found."""
    from veriloom.llm import shingles

    rnd, asked = random.Random(9), []
    words = [f"w{k}" for k in range(5000)]
    passage = rnd.choices(words, k=60)
    rows = [passage + rnd.choices(words, k=4000) for _ in range(12)]
    base = rnd.choices(words, k=700)
    rows += [base, base[:650], rows[3] + rnd.choices(words, k=300)]
    rows = [(k, " ".join(x)) for k, x in enumerate(rows)]
    similar = shingles._similar
    monkeypatch.setattr(shingles, "_similar", lambda pairs, sets: asked.append(pairs.count()) or similar(pairs, sets))
    got = {r["doc_id"] for r in shingles.drop_near_copies(docs(rows)).collect()}
    assert got == _kept(rows) == set(range(13))
    assert sum(asked) <= 4


def test_copies_take_their_sets_along_once(docs, monkeypatch):
    """Of a group of copies not every pair gets whole sets: each is held against one, the rest only where that links nothing."""
    from veriloom.llm import shingles

    rows, asked = _planted(4, 1, 40, (200, 200), 2), []
    similar = shingles._similar
    monkeypatch.setattr(shingles, "_similar", lambda pairs, sets: asked.append(pairs.count()) or similar(pairs, sets))
    assert {r["doc_id"] for r in shingles.drop_near_copies(docs(rows)).collect()} == _kept(rows) == {0}
    assert sum(asked) < 4 * len(rows)


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    from veriloom.llm.graph import components

    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rnd.randrange(400, 700), rnd.randrange(400, 700)) for _ in range(120)] + [(7, 7), (None, 3), (9, 2), (2, 9)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {(x, top(x)) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), small=small).isEmpty()
