"""Near copies by SimHash and the exact Jaccard similarity of their word shingles, 4/5 at least.

SimHash fingerprints of the shingle sets give the first candidates: those within 3 bits, by the range join of simhash.py.
What whole sets verify is linked. Fingerprints of similar sets can differ in more bits, and no link may be lost; so a
prefix join follows, which gives the pairs whose ends the fingerprints have not linked.

In any one order of all shingles, two sets of sizes n and m with similarity 4/5 have the first shingle that they share among
the first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1 of each. So rows meet in the cell of every shingle of these prefixes, and
no pair is missed. The order puts shingles that are common in a sample last, most common at the very end: it decides how many
rows meet, never which pairs are found. Pairs that sizes, places or the parities of hashed shingles rule out go; the others
are verified on the whole sets, which are made again from the texts of their rows alone.

A crowded cell gives the pairs of its first members with all others; after these are verified and linked, it gives every pair
whose ends are still in different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm._base import importable, partitions, release, text_of, written
from veriloom.llm.graph import components
from veriloom.llm import simhash
from veriloom.llm.simhash import SEED

WIDTH = 5
#: Cells of more rows are crowded; so many first members of them meet all others at once.
CROWD, HUBS = 64, 2
#: Documents and shingles of the sample that orders shingles.
SAMPLE, COMMON = 4_000, 100_000
#: Links whose components one task finds (16 MB); more take rounds of joins.
ONE_TASK = 500_000
#: Words of 64 bits that hold the parities, at least and at most; a power of two, with three bits for two shingles where that is enough.
PARITY, MOST_PARITY = 16, 1 << 12


def shingle_set(body: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of shingles: words between ASCII white space, A-Z lowered; fewer words than `width` (none too) are one shingle."""
    import xxhash

    words, digest = body.lower().split(), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    glue = b" ".join([b"%b"] * width)
    return np.unique(np.fromiter((digest(glue % x, SEED) for x in zip(*(words[k:] for k in range(width)), strict=False)), dtype=np.uint64, count=len(words) - width + 1))


def needed(n, m):
    """Shared shingles of two sets with similarity 4/5, at least."""
    return -(-4 * (n + m) // 9)


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all shingles; `common` is sorted and `count` its counts."""
    often = np.zeros(len(found), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        often = np.where(common[at] == found, count[at], 0)
    return found[np.lexsort((found, often))[: len(found) - -(-4 * len(found) // 5) + 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """A bit for each residue of the hashes: whether an odd number of them has it. Sets that differ in d shingles differ in d bits at most.

    In a fixed number of bits, those of large sets differ by chance in no more bits than similar sets may.
    """
    words = PARITY
    while words < MOST_PARITY and 128 * words < 3 * len(found):
        words *= 2
    odd = np.bincount((found % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _folded(odd: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities as rows of fewer words."""
    while odd.shape[1] > words:
        odd = odd[:, : odd.shape[1] // 2] ^ odd[:, odd.shape[1] // 2 :]
    return odd


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of parities (y: as many, or one) differ."""
    words = min(x.shape[1], y.shape[1])
    return np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(axis=1, dtype=np.int64)


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of hashed shingles, as a signed number: a bit is 1 if set in over half of them."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        votes += np.unpackbits(found[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view("<i8")[0])


def _described(shared, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, count = shared.value
        for batch in batches:
            node, size, keys, odd, fp = [], [], [], [], []
            for x in batch.column(2):
                found = shingle_set(x.as_py(), width)
                node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                size.append(len(found))
                keys.append(prefix(found, common, count).tobytes())
                odd.append(parities(found).tobytes())
                fp.append(set_fingerprint(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(odd, pa.binary()), pa.array(fp, pa.int64())], names=["doc_id", "th", "node", "size", "keys", "odd", "fp"])
        release()

    return scan


def _each(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), width).view(np.int64))], names=["key"])
        release()

    return scan


def _sets(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), width).tobytes() for x in batch.column(1)], pa.binary())], names=["node", "shingles"])
        release()

    return scan


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch.column(2)]
        if keys:
            n = [len(x) for x in keys]
            node, size = (np.repeat(np.asarray(batch.column(k)), n) for k in (0, 1))
            place = np.concatenate([np.arange(x) for x in n])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], names=["key", "node", "size", "place"])
    release()


def _may(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m can be similar whose first shared shingles have places p and q."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (1 + np.minimum(n - p, m - q) - 1 >= needed(n, m))


def _whole_cells(batches: Iterator[pa.RecordBatch], f: Callable[[list[np.ndarray]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f over the columns of whole cells, rows sorted by the first column."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
        last = np.flatnonzero(kept[0][1:] != kept[0][:-1])
        if len(last):
            cut = int(last[-1]) + 1
            yield f([x[:cut] for x in kept])
            kept = [x[cut:].copy() for x in kept]
    if kept is not None and len(kept[0]):
        yield f(kept)
    release()


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return new, np.diff(np.r_[new, len(key)])


def _first(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs (a, b), and the rows of crowded cells (b null), of cells whose rows are sorted by (key, node)."""
    key, node, size, place = columns
    once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    key, node, size, place = key[once], node[once], size[once].astype(np.int64), place[once].astype(np.int64)
    new, many = _bounds(key)
    rank = np.arange(len(key)) - np.repeat(new, many)
    many = np.repeat(many, many)
    left, right = [], []

    def put(i: np.ndarray, j: np.ndarray) -> None:
        good = _may(size[i], place[i], size[j], place[j])
        left.append(node[i[good]])
        right.append(node[j[good]])

    for lag in range(1, CROWD):
        rows = np.flatnonzero((many <= CROWD) & (rank + lag < many))
        if not len(rows):
            break
        put(rows, rows + lag)
    crowded = np.flatnonzero(many > CROWD)
    for hub in range(HUBS):
        rows = crowded[rank[crowded] > hub]
        put(rows - rank[rows] + hub, rows)
    a, b = np.concatenate(left), np.concatenate(right)
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[a, node[crowded]]), pa.concat_arrays([pa.array(b), pa.nulls(len(crowded), pa.int64())]), pa.concat_arrays([none, pa.array(key[crowded])]), pa.concat_arrays([none, pa.array(size[crowded])]), pa.concat_arrays([none, pa.array(place[crowded])])],
        names=["a", "b", "key", "size", "place"],
    )


def _second(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs between components of crowded cells."""
    key, node, size, place, component, odd = columns
    left, right = [node[:0]], [node[:0]]
    for begin, many in zip(*_bounds(key), strict=True):
        s = slice(begin, begin + many)
        kind, which, count = np.unique(component[s], return_inverse=True, return_counts=True)
        if len(kind) == 1:
            continue
        n, p, own = size[s], place[s], node[s]
        wide = np.array([len(x) // 8 for x in odd[s]])
        rows = {w: np.flatnonzero(wide == w) for w in np.unique(wide).tolist()}
        bits = {w: np.frombuffer(b"".join(odd[s][at]), dtype="<u8").reshape(-1, w) for w, at in rows.items()}
        todo = np.flatnonzero(which != count.argmax())
        apart = np.ones(many, dtype=bool)
        for i in todo:
            apart[i] = False  # its pairs are all seen now
            j = np.flatnonzero(apart & (which != which[i]))
            j = j[_may(n[i], p[i], n[j], p[j])]
            one = bits[wide[i]][np.searchsorted(rows[wide[i]], i)][None]
            for w in np.unique(wide[j]).tolist():
                k = j[wide[j] == w]
                k = k[_differing(bits[w][np.searchsorted(rows[w], k)], one) <= n[i] + n[k] - 2 * needed(n[i], n[k])]
                left.append(np.full(len(k), own[i]))
                right.append(own[k])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n, m, x, y) that sizes n, m and parities x, y don't rule out."""
    for batch in batches:
        n, m = (np.asarray(batch.column(k)) for k in (2, 3))
        x, y = (np.array(batch.column(k).to_pylist(), dtype=object) for k in (4, 5))
        wide = np.array([(len(u) // 8, len(v) // 8) for u, v in zip(x, y, strict=True)]).reshape(-1, 2)
        good = np.zeros(batch.num_rows, dtype=bool)
        for u, v in np.unique(wide, axis=0).tolist():
            at = np.flatnonzero((wide == (u, v)).all(axis=1))
            differ = _differing(*(np.frombuffer(b"".join(z[at]), dtype="<u8").reshape(-1, w) for z, w in ((x, u), (y, v))))
            good[at] = differ <= n[at] + m[at] - 2 * needed(n[at], m[at])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            u, v = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (x, y))
            good.append(np.intersect1d(u, v, assume_unique=True).size >= needed(len(u), len(v)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
    release()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= 1_000_000 else df


def _common(bodies: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two documents of a sample share, sorted, and their counts."""
    n = bodies.count()
    some = bodies if n <= SAMPLE else bodies.where(F.pmod("th", F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    counted = some.select("body").mapInArrow(_each(width), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "key").limit(COMMON).collect()  # COMMON rows
    key = np.array([r["key"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.array([r["n"] for r in found], dtype=np.int64)[order]


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs of nodes whose whole sets are similar; sets (node, shingles) go once to every pair."""
    found = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return written(found.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "near-links")


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends are in different components of known (node, component; written)."""
    known = _small(known)
    end = lambda node, name: known.select(F.col("node").alias(node), F.col("component").alias(name))
    both = pairs.select("a", "b").join(end("a", "u"), "a", "left").join(end("b", "v"), "b", "left")
    return both.where(F.coalesce("u", "a") != F.coalesce("v", "b")).select("a", "b")


def _verify(pairs: DataFrame, rows: DataFrame, odd: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """Similar pairs of nodes that span the components of all those of the pairs whose sets are similar.

    A pair takes a whole set along, and of a group of copies nearly all pairs are similar; so each node is held first against the
    smallest that it may be similar to, and of the others those pairs whose ends that has not linked.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    end = lambda node, size, bits: odd.select(F.col("node").alias(node), F.col("size").alias(size), F.col("odd").alias(bits))
    both = pairs.join(end("a", "n", "x"), "a").join(end("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    pairs = written(both.mapInArrow(_possible, "a long, b long"), "near-pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    where = written(rows.join(asked, "node").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("node", "r.doc_id", "r.th"), "near-nodes")
    sets = bodies.join(_small(where), ["doc_id", "th"]).select("node", "body").mapInArrow(_sets(width), "node long, shingles binary")
    sets = written(sets, "near-sets").dropDuplicates(["node"])
    found = _similar(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
    left = written(_apart(pairs.join(found, ["a", "b"], "left_anti"), written(components(found, small=ONE_TASK), "near-known")), "near-left")
    return found if left.isEmpty() else found.unionByName(_similar(left, sets))


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) node pairs that span what fingerprints within 3 bits link, of rows (node, fp)."""
    prints = rows.select("node", "fp").distinct()
    first = written(prints.groupBy("fp").agg(F.min("node").alias("node")), "near-prints")
    same = prints.withColumnRenamed("node", "b").join(first.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    return same.unionByName(simhash.links(first.select("node", "fp")))


def links(rows: DataFrame, bodies: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b) node pairs that span every component of rows (doc_id, th, node, size, keys, odd, fp) under the similarity; bodies (doc_id, th, body) are their texts."""
    spark = rows.sparkSession
    cells = rows.select("node", "size", "keys").mapInArrow(_prefixes, "key long, node long, size int, place int")
    dealt = cells.repartition(partitions(spark), "key").sortWithinPartitions("key", "node")
    met = written(dealt.mapInArrow(lambda x: _whole_cells(x, _first), "a long, b long, key long, size long, place long"), "near-cells")
    odd = written(rows.select("node", "size", "odd").distinct(), "near-parities")
    by_print = _verify(fingerprint_pairs(rows), rows, odd, bodies, width)
    open_ = _apart(met.where("b is not null"), written(components(by_print, small=ONE_TASK), "near-known"))
    found = by_print.unionByName(_verify(open_, rows, odd, bodies, width))
    crowded = met.where("b is null").select("key", F.col("a").alias("node"), "size", "place")
    if crowded.isEmpty():
        return found
    label = components(found, small=ONE_TASK)
    full = crowded.join(label, "node", "left").join(odd.drop("size"), "node").select("key", "node", "size", "place", F.coalesce("component", "node").alias("component"), "odd")
    split = full.groupBy("key").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u <> v").select("key")
    again = full.join(split, "key", "left_semi").repartition(partitions(spark), "key").sortWithinPartitions("key")
    more = again.mapInArrow(lambda x: _whole_cells(x, _second), "a long, b long")
    return found.unionByName(_verify(more, rows, odd, bodies, width))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs without the rows that a chain of similarities of 4/5 and more links to a row of smaller id (of equal ids, smaller hash of the text).

    Rows without an id stay and link nothing; rows of equal id and text stay or go together.
    """
    importable(docs.sparkSession)
    body = F.encode(text_of(text_col), "UTF-8")
    bodies = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(bodies, width))
    rows = written(bodies.mapInArrow(_described(shared, width), "doc_id long, th long, node long, size long, keys binary, odd binary, fp long"), "shingles")
    label = components(links(rows, bodies, width), small=ONE_TASK)
    known = rows.select("doc_id", "th", "node").join(label, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("component"))
    known = written(known, "near-components")
    best = known.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best")
    gone = known.join(best, "component").where(F.struct("doc_id", "th") != F.col("best")).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"))
    gone = written(gone.distinct(), "near-copies")
    return docs.join(_small(gone), (F.col(id_col) == F.col("gone_id")) & (F.xxhash64(body) == F.col("gone_th")), "left_anti")
