import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import ODD
from veriloom.llm import lsm, simhash, suffix
from veriloom.llm.graph import components


def _exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", "", t or ""), []).append((d, t))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1] or ""), m[0] is not None, m[0] or 0))
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(d, keep[0], len(members), (d, len(t or "")) == (keep[0], len(keep[1] or "")), sha) for d, t in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_duplicates(docs, bits):
    """Also with a digest of eight bits, where byte verification has to tell texts apart."""
    rows = [*ODD, *((100 + k, f"text {k % 40}" + " " * (k % 3)) for k in range(300))]
    got = [tuple(r) for r in lsm.exact_duplicates(docs(rows), digest_bits=bits).collect()]
    assert sorted(got, key=str) == _exact(rows)


def test_exact_empty(docs):
    assert lsm.exact_duplicates(docs([])).count() == 0 and lsm.drop_exact_duplicates(docs([])).count() == 0


def test_drop_exact_keeps_one_of_each(docs, odd):
    kept = lsm.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [re.sub(r"[ \t-\r]+", "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[ \t-\r]+", "", t or "") for _, t in ODD})


def test_lsm_levels(spark):
    index = lsm.DigestIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "digest binary, rank int, doc_id long")
    index.flush(frame([(b"a", -3, 7), (b"b", -1, 2)]))
    index.flush(frame([(b"a", -3, 5)]))
    index.compact()
    index.flush(frame([(b"a", -4, 9), (b"c", 0, 1)]))
    index.compact()
    assert sorted((bytes(r["digest"]), r["doc_id"], r["copies"]) for r in index.entries().collect()) == [(b"a", 9, 3), (b"b", 2, 1), (b"c", 1, 1)]


def test_lsm_filters_spare_lookups(spark, monkeypatch):
    """Several runs, merged by tiers; what a filter rules out is not looked up; a digest of most rows is looked up like any other."""
    monkeypatch.setattr(lsm, "FANOUT", 2)
    rng = random.Random(2)
    rows = [(bytes([rng.randrange(60)]) if k % 3 else b"hot", -rng.randrange(3), k) for k in range(400)] + [(b"alone", 0, 1000)]
    index = lsm.DigestIndex(spark)
    digests = spark.createDataFrame(rows, "digest binary, rank int, doc_id long").repartition(7).cache()
    index.flush(digests)
    assert index.runs == 7 and index.filters().count() == len(rows)
    doubts = index.repeated()
    shorts = {r[0] for r in doubts.collect()}
    one = digests.where("digest = cast('alone' as binary)").select(lsm.short_hash(digests["digest"])).first()[0]
    assert one not in shorts and len(shorts) == sum(n > 1 for n in Counter(d for d, _, _ in rows).values())
    got = {(bytes(r["digest"]), r["doc_id"]): (r["keep_rank"], r["keep_id"], r["copies"]) for r in index.probe(digests, doubts).collect()}
    groups = {}
    for d, rank, k in rows[:-1]:
        groups.setdefault(d, []).append((rank, k))
    assert got == {(d, k): (*min(groups[d]), len(groups[d])) for d, _, k in rows if len(groups.get(d, ())) > 1}
    strange = spark.createDataFrame([(b"never", 0, 1), (b"hot", 0, 2)], "digest binary, rank int, doc_id long")
    assert [bytes(r["digest"]) for r in index.probe(strange).collect()] == [b"hot"]


def test_exact_with_clashing_columns(spark):
    rows = [(1, "a b", "x", "y"), (2, "ab", "x", "y"), (2, "ab", "z", "y"), (None, None, None, None), (3, "", "q", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, copies string")
    kept = lsm.drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "a b"]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(101)} == {0} and got[202] == 200 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _reach(fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


def test_unary_counts_bound_the_distance():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(1 << 63), 1 << 63, (2, 500))
    counts = lambda x: np.array([[bin(int(v) % (1 << 64) >> k & 3).count("1") for k in range(0, 64, 2)] for v in x])
    bound = np.bitwise_count(simhash.unary_counts(a) ^ simhash.unary_counts(b))
    assert (bound == np.abs(counts(a) - counts(b)).sum(axis=1)).all() and (bound <= np.bitwise_count((a ^ b).view(np.uint64))).all()


@pytest.mark.parametrize("crowded", [4096, 6])
def test_simhash_links_lose_nothing(spark, crowded):
    rng = np.random.default_rng(1)
    fps = list(rng.integers(0, 1 << 63, size=60, dtype=np.uint64) * 2 + 1)
    for _ in range(400):
        x = int(fps[rng.integers(0, len(fps))] if rng.random() < 0.6 else fps[0])
        for b in rng.choice(64, size=rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    nodes = spark.createDataFrame([(3 * k, int(f)) for k, f in enumerate(fps.view(np.int64))], "node long, fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes, crowded=crowded)).collect()}
    assert [got.get(3 * k, 3 * k) for k in range(len(fps))] == [3 * x for x in _reach(fps)]


def test_fingerprints_by_definition():
    import xxhash

    for text in ("", "one", "One two", "one two THREE", "a b c d a b c", "x y z w"):
        words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, odd):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[1, "0" * 16] == got[2, "0" * 16] == got[3, "0" * 16] == 1
    assert simhash.near_duplicates(odd).count() == len(ODD)
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {None, 1, 4, 6, 7, 8} and left.where("doc_id in (2, 3)").count() == 0
    assert simhash.near_duplicates(docs([])).count() == 0


def _repeats(rows, length=100):
    seen = {}
    key = lambda d: -(1 << 63) if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            seen[w] = min(seen.get(w, (1 << 62, 0)), (key(d), s))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < (key(d), s):
                gone[s + 1 : s + 1 + length] = True
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(x for x, y in zip(b, gone[1:], strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(docs, seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(60, 400))) for _ in range(10)]
    rows = [(d, "".join(rnd.choice(parts)[rnd.randint(0, 50) : rnd.randint(100, 400)] for _ in range(rnd.randint(0, 6)))) for d in range(60)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "a" * 120), (204, "ab" * 300), (205, rows[5][1]), (205, rows[5][1]), (None, rows[7][1]), (206, rows[8][1] + "z")]
    rnd.shuffle(rows)
    assert sorted((tuple(r) for r in suffix.repeat_report(docs(rows)).collect()), key=str) == _repeats(rows)


def test_clashing_hashes_are_made_again(monkeypatch):
    """A polynomial hash that takes nearly all strings for equal is replaced by the next."""
    rng = np.random.default_rng(3)
    contexts = [bytes(rng.choice(list(b"ab"), 110)) for _ in range(30)] * 2
    n = len(contexts)
    columns = (np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, 11), np.full(n, 40))
    right = [x.tolist() for x in suffix.repeats_in_classes(*columns, contexts, 100)]
    assert right[0] == list(range(30, 60))
    monkeypatch.setattr(suffix, "BASES", (np.uint64(0), *suffix.BASES))
    assert [x.tolist() for x in suffix.repeats_in_classes(*columns, contexts, 100)] == right
    monkeypatch.setattr(suffix, "BASES", (np.uint64(0),))
    with pytest.raises(ArithmeticError):
        suffix.repeats_in_classes(*columns, contexts, 100)


def test_crowded_anchors_are_split(docs, monkeypatch):
    """Anchor strings that are split at once, in many small parts."""
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    line, passage = text(70), text(160)
    rows = [(d, text(rnd.randrange(90)) + line + text(rnd.randrange(90)) + (passage if d % 3 else passage[: rnd.randrange(160)]) + text(rnd.randrange(60))) for d in range(60)]
    rows += [(70, None), (71, ""), (72, "z" * 400), (73, "z" * 150), (74, rows[3][1]), (74, rows[3][1]), (None, rows[5][1])]
    rnd.shuffle(rows)
    monkeypatch.setattr(suffix, "CROWDED", 3)
    assert sorted((tuple(r) for r in suffix.repeat_report(docs(rows)).collect()), key=str) == _repeats(rows)


def test_suffix_odd(docs, odd):
    rows = [r for r in ODD if len(r[1] or "") < 1000]
    assert sorted((tuple(r) for r in suffix.repeat_report(docs(rows)).collect()), key=str) == _repeats(rows)
    left = suffix.remove_repeats(odd)
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert suffix.repeat_report(docs([])).count() == 0


def test_cut_text_stays_valid():
    text = "é" * 80
    assert suffix.cut_text(text, [{"a": 1, "b": 101}]) == "é" * (80 - 49)
    assert suffix.cut_bytes(text.encode(), [{"a": 1, "b": 101}]) == text.encode()[:1] + text.encode()[101:]


def test_results_don_t_depend_on_broadcasts(docs, monkeypatch):
    """With nothing small enough to broadcast, every join shuffles."""
    rnd = random.Random(9)
    parts = ["".join(rnd.choice("ab ") for _ in range(250)) for _ in range(4)]
    rows = [(d, rnd.choice(parts) + rnd.choice(parts)) for d in range(40)] + [(50, None), (51, "")]
    monkeypatch.setattr(suffix, "_small", lambda df, rows=0: df)
    monkeypatch.setattr(lsm, "BROADCAST_IDS", 0)
    assert sorted((tuple(r) for r in suffix.repeat_report(docs(rows)).collect()), key=str) == _repeats(rows)
    assert sorted((tuple(r) for r in lsm.exact_duplicates(docs(rows)).collect()), key=str) == _exact(rows)


def test_contexts_of_repeated_anchors_are_not_joined(spark, docs, monkeypatch):
    """However many anchor strings repeat, contexts of the others are neither made nor shuffled."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(40)]
    rows = [*enumerate(texts), (40, texts[0][50:300] + texts[1]), (41, texts[2])]
    monkeypatch.setattr(suffix, "BROADCAST_KEYS", 0)
    made = []
    monkeypatch.setattr(suffix, "written", lambda df, name, f=suffix.written: (made.append((name, df._jdf.queryExecution().optimizedPlan().toString())), f(df, name))[1])
    assert sorted((tuple(r) for r in suffix.repeat_report(docs(rows)).collect()), key=str) == _repeats(rows)
    assert "LeftSemi" not in dict(made)["contexts"]


@pytest.mark.parametrize("most", [28, 12])
def test_key_filter_takes_every_key(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "FILTER_MOST", most)
    keys = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 20_000)
    found = suffix.key_filter(spark.createDataFrame(pd.DataFrame({"kh": keys[:10_000]})))
    assert suffix.passes(found, keys[:10_000]).all()
    assert most < 28 or suffix.passes(found, keys[10_000:]).mean() < 0.05
