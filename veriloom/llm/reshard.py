"""Resharding by minimum-cost flow: the fewest bytes move from old shard sizes to new capacities.

Sizes of hashed blocks of every old shard (shards x blocks, a bounded table) go to the driver. A flow network joins old
shards (supply: their bytes) to new shards (capacity: equal shares); bytes that stay cost nothing and bytes that move
cost `cost(i, j)`. The flow's transfers are cut from the blocks' running sizes; only the shards named in a transfer
change, and only their files are rewritten.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from veriloom.llm._base import new_path, text_of, written

#: Rows that change their shard are broadcast up to this many (tens of MB); beyond it the join shuffles.
BROADCAST_MOVES = 1_000_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at the least total cost; successive shortest paths with potentials.

    sum(supply) must not exceed sum(capacity).
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the old ones")
    source, sink, size = n + m, n + m + 1, n + m + 2
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(size)]

    def arc(u: int, v: int, c: int, w: int) -> None:
        for a, b, r, p in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            room.append(r)
            price.append(p)

    for i, x in enumerate(supply):
        arc(source, i, x, 0)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost(i, j))
    for j, x in enumerate(capacity):
        arc(n + j, sink, x, 0)
    potential = [0] * size
    left = sum(supply)
    while left:
        far = [None] * size
        came = [-1] * size
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if room[e]:
                    v, nd = to[e], d + price[e] + potential[u] - potential[to[e]]
                    if far[v] is None or nd < far[v]:
                        far[v], came[v] = nd, e
                        heapq.heappush(heap, (nd, v))
        for v in range(size):
            potential[v] += far[v] if far[v] is not None else max(x for x in far if x is not None)
        step, v = left, sink
        while v != source:
            step, v = min(step, room[came[v]]), to[came[v] ^ 1]
        v = sink
        while v != source:
            room[came[v]] -= step
            room[came[v] ^ 1] += step
            v = to[came[v] ^ 1]
        left -= step
    flow = {}
    for i in range(n):
        for e in out[i]:
            if n <= to[e] < n + m and room[e ^ 1] and not e & 1:
                flow[i, to[e] - n] = room[e ^ 1]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def levelled_capacities(total: int, fixed: list[int], shards: int) -> list[int]:
    """Equal shares, but at least `fixed` bytes for a shard that holds rows too large to share out; the others share the rest."""
    fixed = (fixed + [0] * shards)[:shards]
    over: set[int] = set()
    while True:
        share = equal_capacities(total - sum(fixed[k] for k in over), max(1, shards - len(over)))
        rest = iter(share)
        capacity = [fixed[k] if k in over else next(rest) for k in range(shards)]
        more = {k for k in range(shards) if k not in over and fixed[k] > capacity[k]}
        if not more or len(over) + len(more) >= shards:
            return capacity
        over |= more


@dataclass
class Plan:
    """Segments of each old shard's running size: (old shard, from byte, to byte, new shard)."""

    sizes: list[int]
    capacities: list[int]
    flow: dict[tuple[int, int], int]
    segments: list[tuple[int, int, int, int]]
    #: Large rows that move: (old shard, new shard, bytes).
    large: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def moved(self) -> int:
        return sum(x for (i, j), x in self.flow.items() if i != j) + sum(x for i, j, x in self.large if i != j)

    @property
    def affected(self) -> list[int]:
        return sorted({k for (i, j) in [*self.flow, *((i, j) for i, j, _ in self.large)] if i != j for k in (i, j)})


def plan_transfers(sizes: list[int], capacities: list[int], cost: Callable[[int, int], int] | None = None) -> Plan:
    """What stays in a shard comes first in its running size, then what goes to each new shard in order."""
    flow = min_cost_flow(sizes, capacities, cost or (lambda i, j: int(i != j)))
    segments = []
    for i in range(len(sizes)):
        at = 0
        for j in sorted((j for k, j in flow if k == i), key=lambda j: (j != i, j)):
            segments.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    return Plan(sizes, capacities, flow, segments)


def place_large(rows: list[tuple[int, int]], shards: int, share: float) -> list[int]:
    """New shards of large rows (old shard, bytes), the largest first: where a row is, while that fits in a share, else into the emptiest."""
    held, out = [0] * shards, [0] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k][1], k)):
        old, size = rows[k]
        out[k] = old if old < shards and held[old] + size <= share else min(range(shards), key=lambda j: (held[j], j))
        held[out[k]] += size
    return out


def hashed_shard(shards: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("int")


def reshard(rows: DataFrame, old_shard: Column, old_shards: int, new_shards: int = 40, size: str = "size", order: tuple[str, ...] = ("doc_id",), blocks: int = 128) -> tuple[DataFrame, Plan]:
    """rows with old_shard, shard and slot (gapless from 0 in each shard), and the plan.

    A shard's rows lie in blocks: a size class (power of two), large rows first, and a hash of `order` into `blocks`.
    So the rows that move are small ones, and boundaries fall within a small row.

    rows needs a positive long `size`; `order` makes the order of rows in a block definite. Rows of an eighth of a share and
    more, of which there are eight for each new shard at most, are placed one by one, the largest first; the flow shares out
    the rest. New shards get equal shares of the bytes, up to a small row at either end of a transfer and but for
    shards with a row larger than a share. Rows that are equal in `order` and size are interchangeable.
    Two shuffles: on (old shard, block) for running sizes, and none for the slots, which reuse it.
    """
    spark = rows.sparkSession
    block = (F.lit(63) - F.floor(F.log2(size))) * blocks + F.pmod(F.xxhash64(F.lit(7), *order), F.lit(blocks))
    every = written(rows.withColumns({"old_shard": old_shard.cast("int"), "block": block.cast("int")}), "sized")
    total = every.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    share = total / new_shards
    is_large = (F.col(size) * 8 >= share) & F.lit(total > 0)
    alike = W.partitionBy(*order, size, "old_shard").orderBy(F.lit(0))
    large = written(every.where(is_large).withColumn("nth", F.row_number().over(alike)), "large")
    listed = large.select(*order, size, "old_shard", "nth").orderBy(*order, size, "old_shard", "nth").collect()  # eight for each new shard at most
    goes = place_large([(r["old_shard"], r[size]) for r in listed], new_shards, share)
    held, ranks = [0] * new_shards, {}
    for r, j in zip(listed, goes, strict=True):
        held[j] += r[size]
        ranks[r["old_shard"], j] = [*ranks.get((r["old_shard"], j), []), r]
    rows = every.where(~is_large)
    within = W.partitionBy("old_shard", "block").orderBy(*order, size)
    sums = rows.groupBy("old_shard", "block").agg(F.sum(size).alias("bytes")).orderBy("old_shard", "block").collect()  # old_shards x size classes x blocks rows at most
    sizes, begins = [0] * old_shards, []
    for r in sums:
        begins.append((r["old_shard"], r["block"], sizes[r["old_shard"]]))
        sizes[r["old_shard"]] += r["bytes"]
    capacity = levelled_capacities(total, held, new_shards)
    plan = plan_transfers(sizes, [c - h for c, h in zip(capacity, held, strict=True)])
    plan.large = [(r["old_shard"], j, r[size]) for r, j in zip(listed, goes, strict=True)]
    small = lambda data, schema: F.broadcast(spark.createDataFrame(data, schema))  # noqa: E731  bounded by shards x size classes x blocks
    starts = small(begins, "old_shard int, block int, block_at long")
    segments = small([(s[0], s[1], s[2], s[3]) for s in plan.segments], "seg_old int, seg_from long, seg_to long, shard int")
    placed = rows.join(starts, ["old_shard", "block"]).withColumn("at", F.col("block_at") + F.sum(size).over(within.rowsBetween(W.unboundedPreceding, 0)) - F.expr(f"{size} div 2") - 1)
    placed = placed.join(segments, (F.col("old_shard") == F.col("seg_old")) & (F.col("at") >= F.col("seg_from")) & (F.col("at") < F.col("seg_to")))
    placed = placed.withColumn("rank", F.row_number().over(W.partitionBy("old_shard", "block", "shard").orderBy("at")))
    placed = placed.drop("block_at", "seg_old", "seg_from", "seg_to", "at")
    if listed:
        keys = [*order, size, "old_shard", "nth"]
        known = [(*(r[k] for k in keys), j, place) for (_, j), rs in ranks.items() for place, r in enumerate(rs, 1)]
        shape = T.StructType([*(T.StructField(f"large_{k}", large.schema[k].dataType) for k in keys), T.StructField("shard", T.IntegerType()), T.StructField("rank", T.IntegerType())])
        to = small(known, shape)
        on = [F.col(k).eqNullSafe(F.col(f"large_{k}")) for k in keys]
        one_by_one = large.join(to, on).withColumn("block", F.lit(-1)).select(*placed.columns)
        placed = placed.unionByName(one_by_one)
    placed = written(placed, "placed")
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n")).orderBy("shard", "old_shard", "block").collect()
    before, firsts = {}, []
    for r in counts:
        firsts.append((r["shard"], r["old_shard"], r["block"], before.get(r["shard"], 0)))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    firsts = small(firsts, "shard int, old_shard int, block int, first long")
    slotted = placed.join(firsts, ["shard", "old_shard", "block"]).withColumn("slot", F.col("first") + F.col("rank") - 1)
    return slotted.drop("first", "rank", "block"), plan


def evened(rows: DataFrame, old_shard: Column, shards: int, order: tuple[str, ...]) -> tuple[DataFrame, Plan]:
    """reshard() into as many shards, and once more from there: the second flow evens out, by the smallest rows, what the boundaries of the first left."""
    first, plan = reshard(rows.withColumn("held", old_shard.cast("int")), F.col("held"), shards, shards, order=order)
    again, more = reshard(first.drop("slot", "old_shard").withColumnRenamed("shard", "now"), F.col("now"), shards, shards, order=order)
    flow = dict(plan.flow)
    for (i, j), x in more.flow.items():
        if i != j:
            flow[i, j] = flow.get((i, j), 0) + x
    return again.drop("now", "old_shard").withColumnRenamed("held", "old_shard"), Plan(plan.sizes, plan.capacities, flow, plan.segments, plan.large)


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan]:
    """(doc_id, size, text_crc32, old_shard, shard, slot) under the law `bytes`, and the plan.

    Documents lie in hashed shards first; the flow evens out the bytes. Size: UTF-8 bytes of the text (null: none)
    plus 16. Copies of a text may lie in different shards: a group of copies can be larger than a shard. Null ids are dealt
    by their text; repeated rows are dealt like any others. An empty table gives an empty result.
    """
    text = F.encode(text_of(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return evened(rows, hashed_shard(shards, "doc_id", "text_crc32"), shards, ("doc_id", "text_crc32"))


class ShardStore:
    """Shards as folders of Parquet files; a manifest says which generation holds each shard."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or new_path(spark, "shards")
        self.where: dict[int, str] = {}

    def write(self, rows: DataFrame, shards: int) -> None:
        """rows: any columns and `shard`. Replaces everything."""
        self._generation(rows, range(shards))

    def read(self, shards: list[int] | None = None) -> DataFrame:
        """The rows of some shards (of all by default) with their `shard`."""
        parts = {}
        for k in sorted(self.where) if shards is None else shards:
            parts.setdefault(self.where[k], []).append(k)
        frames = [self.spark.read.schema(self.schema).parquet(path).where(F.col("shard").isin(ks)) for path, ks in parts.items()]
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    def rewrite(self, moves: DataFrame, plan: Plan, key: str = "doc_id") -> None:
        """Applies moves (key, shard; each row's key its own) to the files of the plan's affected shards; other shards keep their files.

        Rows whose shard stays need no partner: only those that change theirs are joined, by a broadcast up to BROADCAST_MOVES.
        """
        if not plan.affected:
            return
        old = self.read([k for k in plan.affected if k in self.where])
        held = old.select(F.col(key).alias("moved_key"), F.col("shard").alias("held_in"))
        to = moves.select(F.col(key).alias("to_key"), F.col("shard").alias("moved_to"))
        changed = held.join(to, F.col("moved_key").eqNullSafe(F.col("to_key"))).where("held_in <> moved_to").select("moved_key", "moved_to")
        changed = written(changed, "moves")
        if changed.count() <= BROADCAST_MOVES:
            changed = F.broadcast(changed)
        rows = old.join(changed, F.col(key).eqNullSafe(F.col("moved_key")), "left").withColumn("shard", F.coalesce("moved_to", "shard"))
        self._generation(rows.drop("moved_key", "moved_to"), plan.affected)

    def _generation(self, rows: DataFrame, shards: range | list[int]) -> None:
        """Each task writes its rows of every shard: the rows' bytes go to disk once, and no shuffle holds them a second time."""
        path = f"{self.root}/generation-{uuid.uuid4().hex}"
        rows = rows.withColumn("shard", F.col("shard").cast(T.IntegerType()))
        self.schema = T.StructType([*(f for f in rows.schema.fields if f.name != "shard"), T.StructField("shard", T.IntegerType())])
        rows.write.partitionBy("shard").parquet(path)
        self.where |= dict.fromkeys(shards, path)
        self.spark.createDataFrame([(json.dumps({str(k): v for k, v in self.where.items()}),)], "manifest string").coalesce(1).write.text(f"{self.root}/manifest-{uuid.uuid4().hex}")


def rewritten_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan, ShardStore]:
    """(doc_id, size, text_crc32, shard, slot) as read back from a store of the documents, the plan and the store.

    The documents are written into hashed shards; the flow plans the transfers under the law `bytes`, the affected shards'
    files are rewritten, and all shards are read again. Null texts stay null and weigh nothing. Each row has a number of its
    own, so null and repeated ids lose and double nothing. An empty table gives an empty result.
    """
    body = F.encode(text_of("text"), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    measured = {"size": (F.length(body) + 16).cast("long"), "text_crc32": F.crc32(body)}
    store = ShardStore(docs.sparkSession)
    store.write(rows.withColumn("crc", F.crc32(body)).withColumn("shard", hashed_shard(shards, "doc_id", "crc")).drop("crc"), shards)
    slim = store.read().withColumns(measured).select("row", "doc_id", "size", "text_crc32", F.col("shard").alias("was"))
    placed, plan = evened(slim, F.col("was"), shards, ("doc_id", "text_crc32", "row"))
    placed = written(placed.select("row", "shard", "slot"), "slots")
    store.rewrite(placed.select("row", "shard"), plan, "row")
    back = store.read().withColumns(measured).select("row", "doc_id", "size", "text_crc32", "shard")
    return back.join(placed.select("row", "slot"), "row").drop("row"), plan, store
