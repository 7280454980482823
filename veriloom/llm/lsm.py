"""Exact duplicates through a log-structured merge index of digests, in DataFrame operations only.

Every task of a batch is a memtable: it flushes its digests as one sorted run, without a shuffle, and the run's filter, the
short hashes of its digests. A digest whose short hash stands once in all filters is alone: it is looked up in no run and
takes no part in any merge. Those in doubt are compacted by tiers, FANOUT runs into one, until a single run is left, in which
each digest has its smallest entry. Rows in doubt are looked up there, and every hit is verified byte by byte
against the row that stays. Digests that hold a large share of all rows are looked up by a bounded broadcast and verified in
salted parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm._base import new_path, text_of, written

#: Rows of a table of ids or short hashes that is broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Runs that are merged into one.
FANOUT = 8
#: Bits of a filter's short hashes.
SHORT = 40
#: A digest with more than one in so many rows is a hot one; there are this many at most.
HOT = 1000


def normalised(text: Column) -> Column:
    """The text without ASCII white space (blank, tab to carriage return)."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def short_hash(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit((1 << SHORT) - 1))


def few(df: DataFrame) -> DataFrame:
    """df (written) with a broadcast hint if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


class DigestIndex:
    """Runs of entries (run, digest, rank, doc_id, copies) and their filters (run, short; a row for each entry) under one folder; of equal digests the smallest (rank, doc_id) wins."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path, self.batches, self.runs, self.rows = spark, path or new_path(spark, "lsm"), 0, 0, 0

    def flush(self, entries: DataFrame) -> None:
        """Writes memtables (digest, rank, doc_id): each partition of the frame is one, and becomes one sorted run with its filter."""
        run = (F.spark_partition_id() + self.runs).cast("long").alias("run")
        to = f"{self.path}/{{}}-{self.batches}"
        entries.select(run, "digest", "rank", "doc_id", F.lit(1).cast("long").alias("copies")).sortWithinPartitions("digest", "rank", "doc_id").write.parquet(to.format("runs"))
        new = self.spark.read.parquet(to.format("runs"))
        new.select("run", short_hash(F.col("digest")).alias("short")).sortWithinPartitions("run", "short").write.parquet(to.format("filters"))
        last, rows = new.agg(F.max("run"), F.count("*")).first()
        self.batches, self.rows = self.batches + 1, self.rows + rows
        self.runs = self.runs if last is None else last + 1

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{kind}-{k}" for k in range(self.batches)])

    def entries(self) -> DataFrame:
        return self._read("runs")

    def filters(self) -> DataFrame:
        return self._read("filters")

    def compacted(self, entries: DataFrame) -> DataFrame:
        """One run (digest, rank, doc_id, copies) of entries of all runs: tier by tier, FANOUT runs into one."""
        runs, now = self.runs, entries
        while True:
            best = F.min(F.struct("rank", "doc_id")).alias("best")
            now = now.groupBy(F.expr(f"run div {FANOUT}").alias("run"), "digest").agg(best, F.sum("copies").alias("copies"))
            now = written(now.select("run", "digest", "best.rank", "best.doc_id", "copies").sortWithinPartitions("run", "digest"), "tier")
            runs = -(-runs // FANOUT)
            if runs <= 1:
                return now.drop("run")

    def compact(self) -> None:
        """All runs become one."""
        level = self.compacted(self.entries())
        self.batches, self.runs, self.rows = 0, 0, 0
        self.path = new_path(self.spark, "lsm")
        level.select(F.lit(0).cast("long").alias("run"), "digest", "rank", "doc_id", "copies").write.parquet(f"{self.path}/runs-0")
        found = self.spark.read.parquet(f"{self.path}/runs-0")
        found.select("run", short_hash(F.col("digest")).alias("short")).write.parquet(f"{self.path}/filters-0")
        self.batches, self.runs, self.rows = 1, 1, found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    def repeated(self) -> DataFrame:
        """(short): the short hashes that more than one row has, in one run or several; a digest with none of these is alone."""
        return written(self.filters().groupBy("short").agg(F.count("*").alias("n")).where("n > 1").select("short"), "doubts")

    def probe(self, digests: DataFrame, doubts: DataFrame | None = None) -> DataFrame:
        """digests (with columns of their own) with keep_id, keep_rank and copies of their digest in all runs; digests that no filter knows are left out.

        doubts (short, written): looks up digests with one of these short hashes alone.
        """
        if doubts is None:
            doubts = written(digests.select(short_hash(F.col("digest")).alias("short")).distinct().join(self.filters().select("short").distinct(), "short"), "doubts")
        asked = few(doubts)
        where = short_hash(F.col("digest")) == F.col("short")
        level = self.compacted(self.entries().join(asked, where, "left_semi"))
        level = level.select("digest", F.col("rank").alias("keep_rank"), F.col("doc_id").alias("keep_id"), "copies")
        rows = digests.join(asked, where, "left_semi")
        hot = F.col("copies") > max(1, self.rows // HOT)
        common = F.broadcast(level.where(hot))  # HOT rows at most
        return rows.join(common, "digest").unionByName(rows.join(common.select("digest"), "digest", "left_anti").join(level.where(~hot), "digest"))


def _mismatches(docs: DataFrame, found: DataFrame, count: int) -> DataFrame:
    """Digests of which a row's normalised bytes differ from those of the row that stays. docs: doc_id, body; found: a probe's result; count: of all rows."""
    parts = F.expr(f"copies div {max(1, count // HOT)} + 1")
    hits = found.where("copies > 1").select("doc_id", "digest", "rank", parts.alias("parts"), _stays().alias("stays"))
    ids = few(written(hits.distinct(), "hits"))
    bodies = docs.join(ids.select(F.col("doc_id").alias("id"), "digest", "rank", "stays", "parts"), docs["doc_id"].eqNullSafe(F.col("id")) & (docs["own"] == F.col("digest")) & (docs["order"] == F.col("rank")))
    bodies = bodies.select("digest", "stays", "parts", "body", F.pmod(F.xxhash64("id", "rank"), F.col("parts")).alias("part"))
    kept = bodies.where("stays").select("digest", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).groupBy("digest", "part").agg(F.first("body").alias("kept_body"))
    return bodies.where(~F.col("stays")).join(kept, ["digest", "part"]).where("body <> kept_body").select("digest").distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """(doc_id, digest, rank, sha, keep_id, keep_rank, copies) of every row, verified."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("body"), (-F.length(text_of(text_col))).alias("order"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("body", 256))).withColumn("own", F.substring("sha", 1, digest_bits // 8))
    digests = written(rows.select("doc_id", F.col("order").alias("rank"), "sha"), "digests").withColumn("digest", F.substring("sha", 1, digest_bits // 8))
    index = DigestIndex(docs.sparkSession)
    index.flush(digests)
    doubts = index.repeated()
    columns = ["doc_id", "digest", "rank", "sha", "keep_id", "keep_rank", "copies"]
    alone = digests.join(few(doubts), short_hash(F.col("digest")) == F.col("short"), "left_anti")
    alone = alone.withColumns({"keep_id": F.col("doc_id"), "keep_rank": F.col("rank"), "copies": F.lit(1).cast("long")}).select(*columns)
    found = written(index.probe(digests, doubts).select(*columns), "found")
    bad = written(_mismatches(rows, found, index.rows), "mismatches")
    if bad.isEmpty():
        return alone.unionByName(found)
    clash = rows.join(bad, F.col("own") == F.col("digest"), "left_semi")
    best = clash.groupBy("body").agg(F.min(F.struct("order", "doc_id")).alias("best"), F.count("*").alias("copies"))
    again = clash.join(best, "body").select("doc_id", F.col("own").alias("digest"), F.col("order").alias("rank"), "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.order").alias("keep_rank"), "copies")
    return alone.unionByName(found.join(bad, "digest", "left_anti")).unionByName(again)


def _stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rank") == F.col("keep_rank"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when they are equal without ASCII white space; null counts as empty. The row with most code points
    in its original text stays, then that with the smallest doc_id (a null doc_id is smallest). Rows that repeat an id
    and a text share one verdict. `digest_bits` below 256 makes digests collide (for tests); rows whose bytes differ from
    those of the row that stays are grouped by their whole text instead. An empty table gives an empty result.
    """
    return _groups(docs, id_col, text_col, digest_bits).select("doc_id", "keep_id", F.col("copies").alias("group_size"), _stays().alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay (see exact_duplicates), one of each group: of rows that repeat an id, a text and its length, any one."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # free of clashes
    keyed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()])
    text = text_of(names[text_col])
    keyed = keyed.withColumns({"id": F.col(names[id_col]), "own": F.unhex(F.sha2(normalised(text), 256)), "order": -F.length(text)})
    found = _groups(docs, id_col, text_col, 256)
    key = lambda df: [F.col("id").eqNullSafe(df["doc_id"]), F.col("own") == df["digest"], F.col("order") == df["rank"]]

    ids = lambda df, name: few(written(df.select("doc_id", "digest", "rank").distinct(), name))
    gone = ids(found.where(~_stays()), "copies")
    left = keyed.join(gone, key(gone), "left_anti")
    twice = ids(found.where(_stays() & (F.col("copies") > 1)).groupBy("doc_id", "digest", "rank").count().where("count > 1"), "repeated")
    if not twice.isEmpty():
        again = left.join(twice, key(twice), "left_semi").dropDuplicates(["id", "own", "order"])
        left = left.join(twice, key(twice), "left_anti").unionByName(again)
    return left.select(*[F.col(k).alias(c) for c, k in names.items()])
