"""SimHash near-duplicates: popcount vectors of fingerprint segments, range-joined on a grid under Manhattan distance.

A fingerprint's 64 bits fall into 32 segments of two bits; a segment's bit count is 0, 1 or 2. Moving one bit moves
one count by one, so the Manhattan distance of two count vectors never exceeds the Hamming distance of the
fingerprints. Counts are written in unary (00, 01, 11), so that their Manhattan distance is the number of differing bits. Of two
vectors within distance 3, one half of 16 segments is within distance 1: the grid has a cell for every value of a
half, a fingerprint lives in its two cells and visits those whose one count is one lower. A pair at distance 1 in a
half meets where the lower one lives, a pair at distance 0 where both do. Pairs that meet are tested by the Manhattan distance of
their whole vectors, and those that are left by their Hamming distance. The rows of crowded cells meet again on the
other half, where one quarter must be within distance 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm._base import importable, partitions, release, text_of, written
from veriloom.llm.graph import components

SEED = 42
#: Cells of at most so many fingerprints compare all pairs; larger ones give a spanning forest of their links.
SMALL_CELL = 24
#: Cells where more fingerprints live are split by a quarter of the other half.
CROWDED = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits of one text: words between ASCII white space, A-Z lowered, shingles of `width` words with repeats.

    No words (null and empty texts too): 0. Fewer words than `width`: one shingle of them all.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    glue = b" ".join([b"%b"] * width)
    hashes = np.fromiter((digest(glue % x, SEED) for x in zip(*(words[k:] for k in range(width)), strict=False)), dtype="<u8", count=len(words) - width + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with `fp`, the 64 bits as a signed long."""
    importable(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def bits(texts: pd.Series) -> pd.Series:
        found = pd.Series(np.array([fingerprint(x, width) for x in texts], dtype=np.uint64).view(np.int64))
        release()
        return found

    return docs.withColumn("fp", bits(text_of(text_col)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row."""
    return fingerprinted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", width).drop("text")


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The count vector: two bits a segment, 00, 01 or 11."""
    f = fp.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    odd, even = (f >> np.uint64(1)) & low, f & low
    return odd | even | ((odd & even) << np.uint64(1))


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """A key of numbers; two cells with one key only meet in vain."""
    out = np.uint64(0)
    for x in parts:
        out = (out ^ np.asarray(x, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _lower(vector: np.ndarray, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which vectors, the vectors with one count lower), for each segment."""
    for k in range(segments):
        field = (vector >> np.uint64(2 * k)) & np.uint64(3)
        at = np.flatnonzero(field)
        yield at, vector[at] ^ (np.where(field[at] == 3, np.uint64(2), np.uint64(1)) << np.uint64(2 * k))


CELLS = "key long, half int, visits boolean, fp long, node long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells where fingerprints live and which they visit."""
    for batch in batches:
        node, fp = (np.asarray(batch.column(k)) for k in (0, 1))
        every = np.arange(len(fp))
        for half in (0, 1):
            vector = (unary_counts(fp) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            for k, (at, cell) in enumerate([(every, vector), *_lower(vector, 16)]):
                yield pa.RecordBatch.from_arrays([pa.array(_mix(half + 1, cell).view(np.int64)), pa.array(np.full(len(at), half, dtype=np.int32)), pa.array(np.full(len(at), k > 0)), pa.array(fp[at]), pa.array(node[at])], names=[x.split()[0] for x in CELLS.split(", ")])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of crowded cells to the quarters of the other half: where they live and which they visit there."""
    for batch in batches:
        key, half, fp, node = (np.asarray(batch.column(k)) for k in (0, 1, 3, 4))
        other = unary_counts(fp) >> np.where(half == 0, np.uint64(32), np.uint64(0))
        every = np.arange(len(fp))
        for quarter in (0, 1):
            vector = (other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
            for k, (at, cell) in enumerate([(every, vector), *_lower(vector, 8)]):
                yield pa.RecordBatch.from_arrays([pa.array(_mix(quarter + 3, key.view(np.uint64)[at], cell).view(np.int64)), pa.array(half[at]), pa.array(np.full(len(at), k > 0)), pa.array(fp[at]), pa.array(node[at])], names=[x.split()[0] for x in CELLS.split(", ")])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number, numpy counts the magnitude's bits


def _near(fp: np.ndarray, vector: np.ndarray, a, b, distance: int) -> np.ndarray:
    """Whether rows a and b link: first by their count vectors, then, where these allow it, by the bits."""
    near = np.bitwise_count(vector[a] ^ vector[b]) <= distance
    left = np.flatnonzero(near)
    x, y = (k[left] if np.ndim(k) else k for k in (a, b))
    near[left] = _popcount(fp[x] ^ fp[y]) <= distance
    return near


def _cell_links(fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one cell's fingerprints."""
    left, right = [], []
    vector = unary_counts(fp)
    todo = np.arange(len(fp))
    while len(todo):
        edge = [todo[0]]
        todo = todo[1:]
        while edge and len(todo):
            at = edge.pop()
            near = _near(fp, vector, todo, at, distance)
            if near.any():
                hit = todo[near]
                left.append(np.full(len(hit), node[at]))
                right.append(node[hit])
                edge.extend(hit.tolist())
                todo = todo[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (node[:0], node[:0])


def _links(key: np.ndarray, visits: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> pa.RecordBatch:
    """Verified links of whole cells, rows sorted by (key, visits); visitors need not meet each other."""
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[new, len(key)])
    rank = np.arange(len(key)) - np.repeat(new, size)
    left = np.repeat(size, size) - rank - 1  # rows of the cell that follow
    vector = unary_counts(fp)
    a, b = [], []
    lag = 1
    rows = np.flatnonzero(np.repeat(size <= SMALL_CELL, size) & (left >= 1) & ~visits)
    while len(rows):
        near = rows[_near(fp, vector, rows, rows + lag, distance)]
        a.append(node[near])
        b.append(node[near + lag])
        lag += 1
        rows = rows[left[rows] >= lag]
    for at in np.flatnonzero(size > SMALL_CELL):
        s = slice(new[at], new[at] + size[at])
        homes = int((~visits[s]).sum())
        if homes <= SMALL_CELL:
            for k in range(new[at], new[at] + homes):
                hit = k + 1 + np.flatnonzero(_near(fp, vector, np.arange(k + 1, s.stop), k, distance))
                a.append(np.full(len(hit), node[k]))
                b.append(node[hit])
            continue
        x, y = _cell_links(fp[s], node[s], distance)
        a.append(x)
        b.append(y)
    x, y = (np.concatenate(v) if v else node[:0] for v in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def links(nodes: DataFrame, distance: int = 3, crowded: int = CROWDED) -> DataFrame:
    """(a, b) node pairs that span every component of `nodes` (node long, fp long, distinct fps; written) under a distance of 3 at most.

    One shuffle of cell keys; a cell is sorted by the engine and streamed, and one with many rows emits its spanning links instead
    of all its pairs, so the output stays within the number of cell rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the grid finds pairs of 3 differing bits at most")
    spark = nodes.sparkSession
    importable(spark)
    cells = nodes.select("node", "fp").mapInArrow(_cells, CELLS)
    homes = cells.where("not visits").groupBy("key").agg(F.count("*").alias("n"))
    full = written(homes.where(F.col("n") > crowded).select("key"), "crowded")
    if not full.isEmpty():
        many = F.broadcast(full) if full.count() <= 500_000 else full
        cells = cells.join(many, "key", "left_anti").select(*cells.columns).unionByName(cells.join(many, "key", "left_semi").select(*cells.columns).mapInArrow(_split, CELLS))
    dealt = cells.select("key", "visits", "fp", "node").repartition(partitions(spark), "key").sortWithinPartitions("key", "visits", "fp")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero(now[0][1:] != now[0][:-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = [x[cut:].copy() for x in now]
            if cut:
                yield _links(*(x[:cut] for x in now), distance)
        if kept is not None and len(kept[0]):
            yield _links(*kept, distance)
        release()

    return dealt.mapInArrow(scan, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints link at `distance` bits or fewer, transitively.

    component_id is the smallest doc_id reachable. Null and empty texts have fingerprint 0 and link like any other.
    Rows that repeat come back once each; a null doc_id takes part only through other rows of its fingerprint and
    has their component (null if there is none). An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    found = components(links(nodes, distance))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows without an id stay, rows that repeat an id go by their own fingerprint."""
    found = near_duplicates(docs, id_col, text_col, width, distance)
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"), F.col("fingerprint").alias("gone_fp")).distinct(), "near-copies")
    small = F.broadcast(gone.select("gone_id").distinct()) if gone.count() <= 1_000_000 else gone.select("gone_id").distinct()
    suspect = docs.join(small, docs[id_col] == small["gone_id"], "left_semi")
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # free of clashes
    keyed = suspect.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()])
    prints = fingerprinted(keyed, names[text_col], width).withColumn("own", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    left = prints.join(gone, (F.col(names[id_col]) == F.col("gone_id")) & (F.col("own") == F.col("gone_fp")), "left_anti")
    return docs.join(small, docs[id_col] == small["gone_id"], "left_anti").unionByName(left.select(*[F.col(k).alias(c) for c, k in names.items()]))
