"""Passage retrieval: postings, BM25, find with re-ranking, the best passage of a sentence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from veriloom.functions.scan import chunk_text
from veriloom.functions.text import STOP, stem, stem_of, with_overlap, words

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
#: Tokens of all queries that go to every task at most (tens of MB); beyond it queries and passages meet by joins.
SHARED_TOKENS = 1_000_000
#: Counters of passages by queries that a task holds at once, and words whose stems it remembers.
CELLS, REMEMBERED = 1 << 21, 1 << 20


def tokens(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


class PassageIndex:
    """Postings (term, id, tf) and lengths of passages (id, text); write() keeps them as tables, clustered by term."""

    def __init__(self, passages: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        t = passages.select(F.col(id_col).alias("id"), tokens(text_col).alias("tokens"))
        self.lengths = t.select("id", F.size("tokens").cast("double").alias("length"))
        self.postings = t.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").cast("double").alias("tf"))

    def write(self, path: str) -> None:
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str) -> PassageIndex:
        self = cls.__new__(cls)
        self.postings, self.lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
        return self

    def search(self, queries: DataFrame, limit: int = 12, query_col: str = "query", by: str = "query_id") -> DataFrame:
        """(query_id, id, score, place): the best passages of each query (query_id, query), any of whose distinct words of three characters and more they hold.

        idf = ln(1 + (N - n + 0.5) / (n + 0.5)). Postings are joined with the queries' terms only, on the term; a common
        term's posting list is split by adaptive execution. Ties go to the smaller id.
        """
        words = queries.select(by, F.explode(F.array_distinct(F.filter(tokens(query_col), lambda t: F.length(t) > 2))).alias("term"))
        asked = words.select("term").distinct()
        own = self.postings.join(asked, "term", "left_semi")
        df = own.groupBy("term").agg(F.count("*").cast("double").alias("n"))
        stats = self.lengths.agg(F.count("*").cast("double").alias("docs"), F.avg("length").alias("mean"))
        terms = words.join(df, "term").join(F.broadcast(stats))  # stats: one row
        idf = F.ln(F.lit(1.0) + (F.col("docs") - F.col("n") + F.lit(0.5)) / (F.col("n") + F.lit(0.5)))
        norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("length") / F.col("mean"))
        part = idf * F.col("tf") * F.lit(K1 + 1.0) / (F.col("tf") + norm)
        scored = terms.join(own, "term").join(self.lengths, "id").groupBy(by, "id").agg(F.round(F.sum(part), 6).alias("score"))
        order = W.partitionBy(by).orderBy(F.desc("score"), "id")
        return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def find(index: PassageIndex, passages: DataFrame, queries: DataFrame, limit: int = 8, nfkc: bool = True) -> DataFrame:
    """Twice the limit by BM25, one row for equal beginnings (key and 120 characters), cut, and ordered anew by overlap. passages: id, key, text."""
    hits = index.search(queries, 2 * limit).join(passages.select("id", "key", "text"), "id").join(queries.select("query_id", "query"), "query_id")
    same = W.partitionBy("query_id", "key", F.substring("text", 1, 120)).orderBy("place")
    once = hits.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    kept = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= limit)
    again = with_overlap(kept, "query", "text", nfkc=nfkc)
    return again.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("overlap"), "place"))).select("query_id", "id", "key", "score", "overlap", "rank")


def best_passages(index: PassageIndex, passages: DataFrame, sentences: DataFrame, nfkc: bool = True) -> DataFrame:
    """(query_id, id, overlap): of the 12 best passages by BM25, the one that overlaps most with the sentence; the first of equals."""
    hits = index.search(sentences, 12).join(passages.select("id", "text"), "id").join(sentences.select("query_id", "query"), "query_id")
    scored = with_overlap(hits, "query", "text", nfkc=nfkc)
    return scored.groupBy("query_id").agg(F.max_by(F.struct("id", "overlap"), F.struct("overlap", -F.col("place"))).alias("b")).select("query_id", "b.id", "b.overlap")


def abstract_passages(works: DataFrame) -> DataFrame:
    """(key, loc, place, text): abstracts (key, title, abstract) in passages, the title before them; works without an abstract have none."""
    whole = F.concat_ws(". ", F.nullif(F.rtrim("title", F.lit(".")), F.lit("")), "abstract")
    return works.where(F.coalesce("abstract", F.lit("")) != "").select("key", F.lit("abstract").alias("loc"), F.posexplode(chunk_text(whole)).alias("place", "text"))


class _Overlaps:
    """The overlap of word lists with a set of queries, given as lists of stems."""

    def __init__(self, queries: list[list[str]]) -> None:
        self.code: dict[str, int] = {}
        own = [[self.code.setdefault(t, len(self.code)) for t in q] for q in queries]
        self.n = np.array([len(q) for q in own], dtype=np.int64)
        pairs = [sorted({a * len(self.code) + b for a, b in zip(q, q[1:], strict=False)}) for q in own]
        self.kinds = np.array([max(1, len(x)) for x in pairs], dtype=np.int64)
        each = [(t, k) for k, q in enumerate(own) for t in q]
        self.one = self._lists(np.array([t for t, _ in each], dtype=np.int64), np.array([k for _, k in each], dtype=np.int64), len(self.code))
        self.pair = np.unique(np.array([x for q in pairs for x in q], dtype=np.int64))
        self.two = self._lists(np.searchsorted(self.pair, np.array([x for q in pairs for x in q], dtype=np.int64)), np.repeat(np.arange(len(pairs)), [len(x) for x in pairs]), len(self.pair))
        self.known: dict[str, int] = {}

    @staticmethod
    def _lists(key: np.ndarray, query: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where the list of a key begins, its length, all lists): the queries of each key, as often as they have it."""
        size = np.bincount(key, minlength=keys)
        return np.cumsum(size) - size, size, query[np.argsort(key, kind="stable")]

    def _codes(self, distinct: list[str]) -> np.ndarray:
        """-1: no query's stem, -2: no content token."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, stop = self.known, _STOP
        for w in distinct:
            if w not in known:
                known[w] = -2 if len(w) < 2 or w in stop else self.code.get(stem_of(w), -1)
        return np.array([known[w] for w in distinct], dtype=np.int64)

    def _counts(self, passage: np.ndarray, key: np.ndarray, lists: tuple, passages: int) -> np.ndarray:
        """(passages x queries) of how often queries have the distinct keys of each passage."""
        begin, size, query = lists
        both = np.unique(passage * max(1, len(begin)) + key)
        passage, key = both // max(1, len(begin)), both % max(1, len(begin))
        size = size[key]
        ends = np.cumsum(size)
        at = np.repeat(begin[key] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(np.repeat(passage * len(self.n), size) + query[at], minlength=passages * len(self.n))

    def of(self, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, query, overlap) of all that share a content token."""
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode() if len(lists) else None
        if coded is None or not len(coded) or not len(self.code):
            return
        code = self._codes(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        passage = np.repeat(np.arange(len(lists)), np.diff(offsets))
        passage, code = passage[code > -2], code[code > -2]
        step = max(1, CELLS // len(self.n))
        for low in range(0, len(lists), step):
            a, b = np.searchsorted(passage, [low, low + step])
            p, c, some = passage[a:b] - low, code[a:b], min(step, len(lists) - low)
            shared = self._counts(p[c >= 0], c[c >= 0], self.one, some)
            next_to = np.flatnonzero((p[1:] == p[:-1]) & (c[1:] >= 0) & (c[:-1] >= 0))
            key = c[next_to] * len(self.code) + c[next_to + 1]
            at = np.minimum(np.searchsorted(self.pair, key), max(0, len(self.pair) - 1))
            good = self.pair[at] == key if len(self.pair) else np.zeros(len(key), dtype=bool)
            two = self._counts(p[next_to[good]], at[good], self.two, some)
            cell = np.flatnonzero(shared)
            query = cell % len(self.n)
            u, v = shared[cell] / self.n[query], two[cell] / self.kinds[query]
            yield low + cell // len(self.n), query, np.where(self.n[query] < 2, u, np.minimum(1.0, 0.8 * u + 0.2 * v + 0.1 * v * u))


_STOP = frozenset(STOP)


def overlap_join(queries: DataFrame, passages: DataFrame, nfkc: bool = True) -> DataFrame:
    """(query_id, id, overlap) of every query (query_id, query) and passage (id, text) that share a content token: the measure of overlap().

    The queries' tokens, counted first, go to the tasks that read the passages; a passage's words stay where it is read. More
    than SHARED_TOKENS, and passages whose id is null or repeats, meet by joins.
    """
    spark = queries.sparkSession
    w = F.filter(words("query", nfkc), lambda x: (F.length(x) > 1) & ~x.isin(*STOP))
    asked = queries.select("query_id", w.alias("w"))
    counted = asked.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n"), F.count("*").alias("rows"), F.count_distinct("query_id").alias("ids")).first()
    if counted["n"] > SHARED_TOKENS or counted["rows"] > SHARED_TOKENS or counted["ids"] < counted["rows"]:
        return _overlap_by_joins(queries, passages, nfkc)
    found = asked.where(F.size("w") > 0).collect()  # SHARED_TOKENS words at most
    shared = spark.sparkContext.broadcast(_Overlaps([[stem_of(x) for x in r["w"]] for r in found]))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", passages.schema["id"].dataType), T.StructField("overlap", T.DoubleType())])
    numbers, kind = spark.sparkContext.broadcast([r["query_id"] for r in found]), to_arrow_type(schema["query_id"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for passage, query, overlap in shared.value.of(part.column(1)):
                    own = pa.array(numbers.value, kind) if own is None else own
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(query)), part.column(0).take(pa.array(passage)), pa.array(overlap)], names=["query_id", "id", "overlap"])

    again = passages.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("again_id"))
    alone, rest = passages, None
    if not again.isEmpty():
        repeats = F.col("id").eqNullSafe(F.col("again_id"))
        alone, rest = passages.join(again, repeats, "left_anti"), passages.join(again, repeats, "left_semi")
    out = alone.select("id", words("text", nfkc).alias("w")).mapInArrow(scan, schema)
    return out if rest is None else out.unionByName(_overlap_by_joins(queries, rest, nfkc))


def _overlap_by_joins(queries: DataFrame, passages: DataFrame, nfkc: bool) -> DataFrame:
    """overlap_join() on tokens and neighbouring pairs that are exploded and joined, whatever the number of queries."""

    def stems(df: DataFrame, by: str, c: str) -> DataFrame:
        w = F.filter(words(c, nfkc), lambda x: (F.length(x) > 1) & ~x.isin(*STOP))
        return df.select(by, F.posexplode(w).alias("at", "w")).select(by, "at", stem(F.col("w")).alias("t"))

    def pairs(df: DataFrame, by: str) -> DataFrame:
        order = W.partitionBy(by).orderBy("at")
        return df.withColumn("next", F.lead("t").over(order)).where("next is not null").select(by, F.concat_ws(" ", "t", "next").alias("pair")).distinct()

    q, p = stems(queries, "query_id", "query"), stems(passages, "id", "text")
    size = q.groupBy("query_id").agg(F.count("*").alias("n"))
    asked = q.groupBy("query_id", "t").agg(F.count("*").alias("times"))
    one = p.select("id", "t").distinct().join(asked, "t").groupBy("query_id", "id").agg(F.sum("times").alias("shared")).join(size, "query_id")
    own = pairs(q, "query_id")
    kinds = own.groupBy("query_id").agg(F.count("*").alias("kinds"))
    both = pairs(p.join(one.select("id").distinct(), "id", "left_semi"), "id").join(own, "pair").groupBy("query_id", "id").agg(F.count("*").alias("two")).join(kinds, "query_id")
    u, b = F.col("shared") / F.col("n"), F.coalesce(F.col("two") / F.col("kinds"), F.lit(0.0))
    full = F.least(F.lit(1.0), F.lit(0.8) * u + F.lit(0.2) * b + F.lit(0.1) * b * u)
    return one.join(both.select("query_id", "id", "two", "kinds"), ["query_id", "id"], "left").select("query_id", "id", F.when(F.col("n") < 2, u).otherwise(full).alias("overlap"))
