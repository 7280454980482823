"""Exact nearest binary codes by multi-index hashing, with radii that grow until the answer is provably complete.

A 64-bit code is cut into m segments; an index maps (segment, value) to the codes that have it. If two codes differ in at
most m * (r + 1) - 1 bits, then some segment differs in at most r. So after all segment values within radius r of a query's
have been looked up, every code up to that distance has been verified; a query is done once its kth verified distance
is within it. Until then its radius grows by one, and only values at exactly the new radius are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.llm._base import importable, written

BITS = 64
K = 10
SEGMENTS = 6
#: Codes in a block of an index bucket, on average at most.
BLOCK = 1024
#: Candidates that a task holds before it prunes them to the best of each query.
HELD = 1 << 20


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code long): bit i is set if component i is above zero, for the first 64 components. Rows without an id or a vector are left out; missing, null and undefined components count as zero. Rows that repeat come back once each, other columns are left out; an empty table gives an empty result."""
    importable(vectors.sparkSession)

    @F.pandas_udf("long")
    def pack(batch: pd.Series) -> pd.Series:
        out = np.zeros((len(batch), BITS), dtype=bool)
        for k, v in enumerate(batch):
            first = np.asarray(v, dtype=float)[:BITS]
            out[k, : len(first)] = np.nan_to_num(first) > 0
        return pd.Series(np.packbits(out, axis=1, bitorder="little").view("<i8").ravel())

    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), pack(vector_col).alias("code"))


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    cuts = [round(BITS * k / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(codes: np.ndarray, first: int, bits: int) -> np.ndarray:
    return ((codes.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int32)


def _best(q: np.ndarray, code: np.ndarray, dist: np.ndarray, first_id: np.ndarray, copies: np.ndarray, keep: int) -> list[np.ndarray]:
    """Each query's `keep` best distinct codes by (distance, smallest id)."""
    order = np.lexsort((code, first_id, dist, q))
    columns = [x[order] for x in (q, code, dist, first_id, copies)]
    q, code = columns[:2]
    fresh = np.r_[True, (q[1:] != q[:-1]) | (code[1:] != code[:-1])] if len(q) else np.zeros(0, dtype=bool)
    columns = [x[fresh] for x in columns]
    q = columns[0]
    new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(new, np.diff(np.r_[new, len(q)]))
    return [x[rank < keep] for x in columns]


NAMES = ["qid", "code", "distance", "first_id", "copies"]
STATE = "qid long, code long, distance int, first_id long, copies int"


def _verify(keep: int):
    """Joined probes and buckets to the best verified codes of each query, as far as this task sees them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def prune() -> list[np.ndarray]:
            return _best(*(np.concatenate(x) for x in zip(*held, strict=True)), keep)

        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            lists = at["codes"]
            count = np.diff(np.asarray(lists.offsets))
            flat = [np.asarray(at[n].flatten()) for n in ("codes", "first_ids", "copies")]
            q, qcode = (np.repeat(np.asarray(at[n]), count) for n in ("qid", "qcode"))
            held.append([q, flat[0], np.bitwise_count((flat[0] ^ qcode).view(np.uint64)).astype(np.int32), flat[1], flat[2].astype(np.int32)])
            size += len(q)
            if size > HELD:
                held = [prune()]
                size = len(held[0][0])
                if size > HELD // 2:  # that many queries: hand on what there is
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=NAMES)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in prune()], names=NAMES)

    return scan


def _probes(radius: int, segments: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array([sum(1 << i for i in pick) for pick in combinations(range(bits), radius)], dtype=np.int32) for _, bits in segment_bounds(segments)]
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                qid, qcode = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for s, (first, bits) in enumerate(segment_bounds(segments)):
                    m = masks[s]
                    if len(m):
                        value = (_value(qcode, first, bits)[:, None] ^ m[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, len(m))), pa.array(np.repeat(qcode, len(m))), pa.array(np.full(len(value), s, dtype=np.int32)), pa.array(value)], names=["qid", "qcode", "segment", "value"])

    return scan


def _merge(state: DataFrame, keep: int) -> DataFrame:
    """Each query's best distinct codes of several states."""
    one = state.groupBy("qid", "code").agg(F.min("distance").alias("distance"), F.min("first_id").alias("first_id"), F.max("copies").alias("copies"))
    order = W.partitionBy("qid").orderBy("distance", "first_id", "code")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("rank")


def build_index(codes: DataFrame, segments: int, keep: int) -> tuple[DataFrame, DataFrame, int]:
    """(buckets, ids of each code, number of distinct codes); equal codes are one entry with their `keep` smallest ids."""
    first = W.partitionBy("code").orderBy("id")
    few = codes.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep)  # limited before the shuffle too
    ids = written(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "code-ids")
    count = ids.count()
    blocks = max(1, -(-count // (BLOCK << (BITS // segments))))
    entry = ids.select("code", F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("copies"))
    split = F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << n) - 1)).cast("int").alias("value")) for s, (a, n) in enumerate(segment_bounds(segments))])
    spread = entry.withColumn("at", F.explode(split)).select("at.*", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), F.struct("code", "first_id", "copies").alias("e"))
    buckets = spread.groupBy("segment", "value", "block").agg(F.collect_list("e").alias("e"))
    return written(buckets.select("segment", "value", F.col("e.code").alias("codes"), F.col("e.first_id").alias("first_ids"), F.col("e.copies").alias("copies")), "buckets"), ids, count


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = K, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k rows of codes (id, code) nearest each row of queries (id, code).

    Ordered by (Hamming distance, id); a query's own id is no neighbour of it. Fewer than k rows come back only if there
    are fewer. Repeated ids of one code are rows of their own. Queries with no rows to find have none, and an
    empty table gives an empty result. Rounds: one per radius, each with the queries that are still open; state between rounds is written.
    """
    spark = codes.sparkSession
    importable(spark)
    keep = k + 1  # one may be the query's own row
    buckets, ids, _ = build_index(codes, segments, keep)
    open_ = written(queries.select(F.col("id").alias("qid"), F.col("code").alias("qcode")).distinct(), "queries")
    all_queries = open_
    state = spark.createDataFrame([], STATE)
    for radius in range(max(n for _, n in segment_bounds(segments)) + 1):
        probes = open_.mapInArrow(_probes(radius, segments), "qid long, qcode long, segment int, value int")
        hits = probes.join(buckets, ["segment", "value"]).select("qid", "qcode", "codes", "first_ids", "copies")
        state = written(_merge(state.unionByName(hits.mapInArrow(_verify(keep), STATE)), keep), "nearest")
        upto = F.sum("copies").over(W.partitionBy("qid").orderBy("distance", "first_id", "code"))
        kth = state.withColumn("upto", upto).where(F.col("upto") >= keep).groupBy("qid").agg(F.min("distance").alias("kth"))
        done = kth.where(F.col("kth") <= segments * (radius + 1) - 1).select("qid")
        open_ = written(open_.join(done, "qid", "left_anti"), "open")
        if open_.isEmpty():
            break
    pairs = all_queries.select("qid").join(state, "qid").join(ids, "code").select("qid", "distance", F.explode("ids").alias("neighbour_id")).where("neighbour_id <> qid")
    order = W.partitionBy("qid").orderBy("distance", "neighbour_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "neighbour_id", "distance")
