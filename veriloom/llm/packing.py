"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces of documents are bins' items. Items are dealt by hash into shards of about SHARD items, so that no task holds
more; each shard is evolved on several islands. A chromosome is a whole packing. Crossover injects well-filled bins of
one parent into the other, drops the bins that hold an injected item already, and some that have gaps, and best-fits the items
so displaced. A child then tries to do without its emptiest bin: that bin's items and those of some bins with gaps fill
these bins anew by subset sums. After each epoch the islands' elites migrate around a ring. Bins that stay too empty are
dissolved and their items, of all shards together, are packed again at the next level, until one shard is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm._base import importable, release, text_of, written

CAPACITY = 1024
END = 2
#: Items of a shard, on average.
SHARD = 3072
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 10
POPULATION = 6
ELITES = 2
#: Bins filled less than this go on to the next level.
FULL = 0.97


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[str, object] = {}


def fast_encoder(path: str):
    """The byte-level BPE of a tokenizer file as a tiktoken encoding: the same vocabulary by rank, several times as fast."""
    if path not in _ENCODERS:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from U+0100
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of a document's pieces: all but the first are full."""
    if n <= capacity:
        return [0]
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32): the documents' ids, each document ended by END, cut to the capacity.

    with_ids: also `ids`, little-endian unsigned 32-bit. item numbers the rows of one evaluation only; write them.
    """
    importable(docs.sparkSession)
    path = path or tokenizer_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(path).encode_ordinary
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            doc_ids, texts = batch.column(0), batch.column(1)
            rows = []
            for k in range(batch.num_rows):
                ids = np.array([*encode(texts[k].as_py()), END], dtype="<u4")
                starts = cut_points(len(ids), capacity)
                for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    body = ids[a:b].tobytes()
                    rows.append(k)
                    for column, v in zip(out, (p, a, b - a, zlib.crc32(body), body if with_ids else b""), strict=False):
                        column.append(v)
            arrays = [doc_ids.take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    found = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(scan, schema)
    return found.select(F.monotonically_increasing_id().alias("item"), "*")


class Packing:
    """A chromosome: the bin of each item and the fill of each bin (0: no bin)."""

    __slots__ = ("bins", "fill")

    def __init__(self, bins: np.ndarray, fill: np.ndarray) -> None:
        self.bins, self.fill = bins, fill

    def count(self) -> int:
        return int((self.fill > 0).sum())

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then uneven fills: sum of squared fills."""
        used = self.fill[self.fill > 0] / capacity
        return -len(used), float((used**2).sum() / max(1, len(used)))


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Puts items, in this order, into the fullest bin that has room, or a new one; bins and fill change in place."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = []
    mask = 0
    for b, f in enumerate(fill):
        if f:
            by_room[capacity - f].append(b)
            mask |= 1 << (capacity - f)
        else:
            free.append(b)
    mask &= ~1
    for item, size in zip(items.tolist(), sizes[items].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room = capacity
            if free:
                b = free.pop()
            else:
                b = len(fill)
                fill.append(0)
        bins[item] = b
        fill[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room


def refill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in `sizes` (falling): each takes the largest item left and the others that fill it up best, by subset sums."""
    left, out = list(range(len(sizes))), []
    while left:
        first, *others = left
        room = capacity - sizes[first]
        mask, reach, before = (1 << (room + 1)) - 1, 1, []
        for k in others:
            before.append(reach)
            reach |= (reach << sizes[k]) & mask
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        taken = [first]
        for k, had in zip(reversed(others[: len(before)]), reversed(before), strict=True):
            if not had >> total & 1:  # the sum needs this item
                taken.append(k)
                total -= sizes[k]
        out.append(taken)
        gone = set(taken)
        left = [k for k in left if k not in gone]
    return out


def close_gaps(sizes: np.ndarray, packing: Packing, capacity: int, rng: np.random.Generator, most: int = 64, tries: int = 2) -> Packing:
    """The packing without its emptiest bin, if some bins with gaps can take its items when they are filled anew; else as it is."""
    fill = packing.fill
    used = np.flatnonzero(fill)
    last = int(used[np.argmin(fill[used])])
    gappy = used[(fill[used] < capacity) & (used != last)]
    for _ in range(tries):
        some = rng.permutation(gappy)[:most]
        if (capacity - fill[some]).sum() < fill[last]:
            continue
        chosen = np.zeros(len(fill), dtype=bool)
        chosen[some], chosen[last] = True, True
        pool = np.flatnonzero(chosen[packing.bins])
        pool = pool[np.argsort(-sizes[pool], kind="stable")]
        found = refill(sizes[pool].tolist(), capacity)
        if len(found) <= len(some):
            bins, fill = packing.bins.copy(), np.where(chosen, 0, fill)
            for b, items in zip(some.tolist(), found, strict=False):
                bins[pool[items]] = b
                fill[b] = sizes[pool[items]].sum()
            return Packing(bins, fill)
    return packing


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """a, with some of b's well-filled bins injected whole; a's bins that hold one of their items go, some of its gappy ones too, and their items are best-fitted."""
    used = np.flatnonzero(b.fill >= capacity - capacity // 128)
    used = used if len(used) else np.flatnonzero(b.fill == b.fill.max())
    take = used[rng.permutation(len(used))[: max(1, int(len(used) * rng.uniform(0.1, 0.5)))]]
    chosen = np.zeros(len(b.fill), dtype=bool)
    chosen[take] = True
    injected = chosen[b.bins]
    broken = np.zeros(len(a.fill), dtype=bool)
    broken[a.bins[injected]] = True
    open_ = np.flatnonzero((a.fill > 0) & (a.fill < capacity) & ~broken)
    broken[open_[rng.random(len(open_)) < 0.3]] = True
    displaced = np.flatnonzero(broken[a.bins] & ~injected)
    bins, fill = a.bins.copy(), np.where(broken, 0, a.fill).tolist()
    holes = np.flatnonzero(np.asarray(fill) == 0).tolist()
    place = np.zeros(len(b.fill), dtype=np.int64)
    for t in take.tolist():
        if holes:
            place[t] = holes.pop()
            fill[place[t]] = int(b.fill[t])
        else:
            place[t] = len(fill)
            fill.append(int(b.fill[t]))
    bins[injected] = place[b.bins[injected]]
    order = displaced[np.argsort(-(sizes[displaced] * rng.uniform(0.97, 1.0, len(displaced))), kind="stable")]
    best_fit(sizes, order, bins, fill, capacity)
    return Packing(bins, np.asarray(fill))


def evolve(sizes: np.ndarray, capacity: int, start: list[Packing], rng: np.random.Generator, generations: int = GENERATIONS, population: int = POPULATION) -> list[Packing]:
    """The population after some generations, best first; it starts from `start` filled up with best-fit decreasing on shaken sizes. Children close the gaps of their bins before they compete."""
    herd = list(start)
    while len(herd) < population:
        shaken = sizes * (rng.uniform(0.9, 1.0, len(sizes)) if herd else 1.0)
        bins, fill = np.zeros(len(sizes), dtype=np.int64), []
        best_fit(sizes, np.argsort(-shaken, kind="stable"), bins, fill, capacity)
        herd.append(Packing(bins, np.asarray(fill)))
    least = -(-int(sizes.sum()) // capacity)
    key = lambda x: x.fitness(capacity)
    herd.sort(key=key, reverse=True)
    for _ in range(generations):
        if herd[0].count() <= least:
            break
        children = []
        for _ in range(population // 2):
            i, j = rng.choice(len(herd), size=2, replace=False).tolist()
            children.append(close_gaps(sizes, crossover(herd[i], herd[j], sizes, capacity, rng), capacity, rng))
            if children[-1].count() <= least:
                break
        herd = sorted([*herd, *children], key=key, reverse=True)[:population]
    return herd


def _restore(bins: bytes, sizes: np.ndarray) -> Packing:
    b = np.frombuffer(bins, dtype=np.int32).astype(np.int64)
    return Packing(b, np.bincount(b, weights=sizes).astype(np.int64))


def _level(spark: SparkSession, items: DataFrame, count: int, capacity: int, level: int) -> DataFrame:
    """(item, length, sequence_id, offset, fill) of one level's items (item, length)."""
    shards = -(-count // SHARD)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(shards)).cast("int"))
    dealt = written(dealt, "dealt")
    islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
    elites = spark.createDataFrame([], "shard int, island int, best int, even double, bins binary")

    def epoch(number: int):
        def run(own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({"shard": [], "island": [], "best": [], "even": [], "bins": []})
            own = own.sort_values("item")
            sizes = own["length"].to_numpy()
            shard, island = int(own["shard"].iloc[0]), int(own["island"].iloc[0])
            rng = np.random.default_rng([level, shard, island, number])
            came = came.sort_values(["best", "even", "bins"], ascending=False)
            herd = evolve(sizes, capacity, [_restore(x, sizes) for x in came["bins"].unique()][:POPULATION], rng)[:ELITES]
            scores = [x.fitness(capacity) for x in herd]
            return pd.DataFrame({"shard": shard, "island": island, "best": [s[0] for s in scores], "even": [s[1] for s in scores], "bins": [x.bins.astype(np.int32).tobytes() for x in herd]})

        return run

    for number in range(EPOCHS):
        found = islands.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island")).applyInPandas(epoch(number), elites.schema)
        found = written(found, "elites")
        elites = found.unionByName(found.withColumn("island", (F.col("island") + 1) % ISLANDS))  # migration around the ring

    def decode(own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("item")
        sizes = own["length"].to_numpy()
        best = _restore(came.sort_values(["best", "even", "bins"], ascending=False)["bins"].iloc[0], sizes)
        order = np.lexsort((own["item"].to_numpy(), best.bins))
        b, s = best.bins[order], sizes[order]
        ends = np.cumsum(s)
        new = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        begin = np.repeat((ends - s)[new], np.diff(np.r_[new, len(b)]))
        shard = int(own["shard"].iloc[0])
        return pd.DataFrame({"item": own["item"].to_numpy()[order], "length": s, "sequence_id": (level << 56) + (shard << 24) + b, "offset": ends - s - begin, "fill": best.fill[b]})

    champions = found.groupBy("shard").agg(F.max(F.struct("best", "even", "bins")).alias("top")).select("shard", "top.*")
    return dealt.groupBy("shard").cogroup(champions.groupBy("shard")).applyInPandas(decode, "item long, length long, sequence_id long, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY, full: float = FULL) -> DataFrame:
    """(item, sequence_id, offset) for items (item long unique, length long from 1 to capacity).

    Items as long as the capacity are sequences of their own. Offsets are gapless from 0 in each sequence.
    """
    spark = items.sparkSession
    importable(spark)
    whole = items.where(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("item", "length")
    done, level, count = [whole], 0, rest.count()
    while count:
        placed = written(_level(spark, rest, count, capacity, level), "placed")
        loose = placed.where(F.col("fill") < full * capacity)
        left = loose.count()
        if count <= SHARD or left in (0, count) or level > 20:
            done.append(placed.select("item", "sequence_id", "offset"))
            break
        done.append(placed.where(F.col("fill") >= full * capacity).select("item", "sequence_id", "offset"))
        rest, count, level = loose.select("item", "length"), left, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and `ids` if asked for: one row per piece.

    Null and empty texts are END alone. Repeated rows are packed once each; null ids stay null. An empty table gives an
    empty result.
    """
    parts = written(pieces(docs, id_col, text_col, path, capacity, with_ids), "pieces")
    return parts.join(pack(parts.select("item", "length"), capacity), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens): the packed ids of each sequence as an array, from packed_documents(with_ids=True)."""
    importable(packed.sparkSession)

    @F.pandas_udf("array<long>")
    def tokens(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: np.frombuffer(b"".join(x["ids"] for x in p), dtype="<u4").astype(np.int64))

    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", tokens("parts").alias("tokens"))
