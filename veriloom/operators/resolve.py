"""Entity resolution: works that share an identifier become one, in two modes, and the merge of their fields."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions.identity import key_suffix


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder; without one (a session on one machine) the frame stays as it is, cached."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return df.cache()
    path = f"{shared.rstrip('/')}/veriloom/resolve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def canonical_groups(ids: DataFrame, rounds: int = 30) -> DataFrame:
    """(work, group): works joined by shared (kind, value), transitively; group is the smallest work.

    ids: work long, kind, value. The smallest label passes from works to identifiers and back, as two aggregates a round.
    """
    links = _written(ids.select("work", F.xxhash64("kind", "value").alias("id"), "kind", "value").distinct())
    labels = links.select("work").distinct().withColumn("group", F.col("work"))
    for _ in range(rounds):
        low = links.join(labels, "work").groupBy("kind", "value").agg(F.min("group").alias("low"))
        new = links.join(low, ["kind", "value"]).groupBy("work").agg(F.min("low").alias("group"))
        # a label's own label: paths halve every round
        new = new.join(new.select(F.col("work").alias("via"), F.col("group").alias("next")), F.col("group") == F.col("via")).select("work", F.least("group", "next").alias("group"))
        new = _written(new)
        changed = new.join(labels.withColumnRenamed("group", "old"), "work").where("group <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("the groups did not settle")


def first_hit_groups(ids: DataFrame, groups: DataFrame) -> DataFrame:
    """(work, key_work): the order-dependent mode. Works arrive by id; each takes the work that its first known identifier, in the order of `prio`, already belongs to.

    Works of different canonical groups never meet, so each group is replayed on its own.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        owner: dict[tuple[str, str], int] = {}
        out = []
        for work, part in pdf.sort_values(["work", "prio"]).groupby("work", sort=True):
            pairs = list(zip(part["kind"], part["value"], strict=True))
            own = next((owner[p] for p in pairs if p in owner), work)
            for p in pairs:
                owner.setdefault(p, own)  # the first writer keeps an identifier
            out.append((work, own))
        return pd.DataFrame(out, columns=["work", "key_work"])

    return ids.join(groups, "work").groupBy("group").applyInPandas(replay, "work long, key_work long")


def merge_works(works: DataFrame, group: str = "group", order: str = "work", lists: tuple[str, ...] = (), flags: tuple[str, ...] = (), largest: tuple[str, ...] = (), longest: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: lists are united in first-seen order, flags or-ed, `largest` and `longest` take the greatest number and the longest text, any other column its first non-empty value by `order`."""
    out = []
    for name, kind in works.dtypes:
        if name in (group, order):
            continue
        c = F.col(name)
        if name in lists:
            ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("v")))), lambda x: x["v"])
            out.append(F.array_distinct(F.flatten(ordered)).alias(name))
        elif name in flags:
            out.append(F.coalesce(F.bool_or(c), F.lit(False)).alias(name))
        elif name in largest:
            out.append(F.max(c).alias(name))
        elif name in longest:
            out.append(F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col(order))).alias(name))
        else:
            filled = F.nullif(c, F.lit("")) if kind == "string" else c
            out.append(F.coalesce(F.min_by(filled, F.when(filled.isNotNull(), F.col(order))), F.lit("" if kind == "string" else None).cast(kind)).alias(name))
    return works.groupBy(group).agg(*out, F.count("*").alias("records"))


def unique_keys(bases: DataFrame, base: str = "base", order: str = "work") -> DataFrame:
    """Adds `key`: the base, then base + a, b, ... by order.

    A key that equals another row's natural base moves on until it is free; rounds end when none does.
    """
    out = bases.withColumn("n", F.row_number().over(W.partitionBy(base).orderBy(order))).withColumn("key", F.concat(base, key_suffix(F.col("n"))))
    for _ in range(1000):
        natural = out.where("n = 1").select(F.col("key").alias("taken"))
        clash = out.where("n > 1").join(natural, F.col("key") == F.col("taken"), "left_semi").select(order)
        if clash.isEmpty():
            return out.drop("n")
        hit = clash.withColumn("hit", F.lit(1))
        out = out.join(hit, order, "left").withColumn("shift", F.sum(F.coalesce("hit", F.lit(0))).over(W.partitionBy(base).orderBy("n")))
        out = out.withColumn("n", F.col("n") + F.col("shift").cast("int")).drop("hit", "shift").withColumn("key", F.concat(base, key_suffix(F.col("n"))))
        out = _written(out)
    raise RuntimeError("the keys did not settle")


def rename_chain(renames: DataFrame) -> DataFrame:
    """(old, current): each key followed to the end of its renames. renames: old (once each), new. Paths double every round; a circle is an error."""
    now = _written(renames.select("old", F.col("new").alias("current")))
    for _ in range(64):
        step = now.select(F.col("old").alias("from_"), F.col("current").alias("to_"))
        new = _written(now.join(step, F.col("current") == F.col("from_"), "left").select("old", F.coalesce("to_", "current").alias("current"), F.col("to_").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")
    raise RuntimeError("keys are renamed in a circle")


def rekeyed(tables: dict[str, DataFrame], renames: DataFrame, column: str = "key") -> dict[str, DataFrame]:
    """The tables with renamed keys in place of old ones, the renames' chains followed."""
    to = rename_chain(renames)
    out = {}
    for name, df in tables.items():
        joined = df.join(to, df[column] == to["old"], "left")
        out[name] = joined.withColumn(column, F.coalesce("current", df[column])).select(*df.columns)
    return out


def upsert_works(library: DataFrame, index: DataFrame, arrivals: DataFrame, ids: DataFrame, references: DataFrame, **rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(library, index, renames) after arrivals. library: key, base and fields; index: kind, value, key; arrivals: work, base and the same fields; ids: work, kind, value, prio; references: key (used elsewhere).

    An arrival joins the work that its first known identifier belongs to, or gets a new key from its base. Fields are merged
    (`rules` as in merge_works), identifiers are indexed, the first writer keeps one. If the merged base differs, a key that
    nothing refers to is made anew from it.
    """
    hits = lookup_existing(ids, index.select("kind", "value", "key"))
    came = arrivals.join(hits, "work", "left")
    taken = library.select(F.lit(0).cast("long").alias("work"), F.col("key").alias("base"), "key")
    fresh = came.where("key is null").select("work", "base")
    both = taken.select("work", "base", F.col("key").alias("was")).unionByName(fresh.withColumn("was", F.lit(None).cast("string")))
    named = unique_keys(both.withColumn("order", F.struct(F.col("was").isNull(), "work", "was")), order="order").where("was is null").select("work", F.col("key").alias("new_key"))
    placed = came.join(named, "work", "left").withColumn("key", F.coalesce("key", "new_key")).drop("new_key")
    rows = library.withColumn("work", F.lit(0).cast("long")).unionByName(placed.select(*library.columns, "work"))
    merged = _written(merge_works(rows, group="key", order="work", **rules).drop("records"))
    indexed = index.withColumn("arrival", F.lit(0).cast("long")).unionByName(ids.join(placed.select("work", "key"), "work").select("kind", "value", "key", F.col("work").alias("arrival")))
    latest = rows.groupBy("key").agg(F.max_by("base", "work").alias("latest"), F.min_by("base", "work").alias("first"))
    moved = latest.where("first <> latest").join(references.select("key").distinct(), "key", "left_anti").select(F.col("key").alias("old"), F.col("latest").alias("base"))
    others = merged.select(F.col("key").alias("base")).join(moved.select(F.col("old").alias("base")), "base", "left_anti").withColumn("old", F.lit(None).cast("string"))
    renames = unique_keys(others.unionByName(moved.select("base", "old")).withColumn("order", F.struct(F.col("old").isNotNull(), "old", "base")), order="order").where("old is not null").select("old", F.col("key").alias("new")).where("old <> new")
    renames = _written(renames)
    tables = rekeyed({"library": merged, "index": index_ids(indexed)}, renames)
    return tables["library"], tables["index"], renames


def lookup_existing(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(work, key): the key that a work's first known identifier, by `prio`, belongs to. known: kind, value, key."""
    return ids.join(known, ["kind", "value"]).groupBy("work").agg(F.min_by("key", F.struct("prio", "key")).alias("key"))


def index_ids(rows: DataFrame) -> DataFrame:
    """The identifier index: of (kind, value) rows, the first by `arrival` keeps it."""
    return rows.groupBy("kind", "value").agg(F.min_by("key", F.struct("arrival", "key")).alias("key"))


def unreferenced(works: DataFrame, *uses: DataFrame) -> DataFrame:
    """New works, not entered by hand, that no table of uses (key) mentions."""
    out = works.where("status = 'new' and origin <> 'manual'")
    for u in uses:
        out = out.join(u.select("key").where("key is not null").distinct(), "key", "left_anti")
    return out


def expand_ids(works: DataFrame, ids: Column, order: str = "work") -> DataFrame:
    """(work, kind, value, prio) from a column of identifiers."""
    return works.select(order, F.explode(ids).alias("i")).select(order, "i.kind", "i.value", "i.prio")
