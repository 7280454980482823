"""Incremental work: what is new since a snapshot, replayed searches, one hop of the citation graph, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def new_since(now: DataFrame, before: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key the snapshot does not have."""
    return now.join(before.select(key).distinct(), key, "left_anti")


def replayable(searches: DataFrame) -> DataFrame:
    """(connector, query): each search to run again: without error, not itself a watch run, not ad hoc; once each."""
    return searches.where("coalesce(error, '') = '' and coalesce(run, '') <> 'watch' and coalesce(subq, '') <> 'adhoc'").select("connector", "query").distinct()


def watch_report(works: DataFrame, before: DataFrame, least: float = 0.3) -> DataFrame:
    """Works unseen before that are still `new` and relevant enough, the most relevant first."""
    return new_since(works, before).where((F.col("status") == "new") & (F.col("relevance") >= least)).orderBy(F.desc("relevance"), "key")


def one_hop(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """(seed, key, way): works that a seed cites (back) or that cite it (forward). edges: src, dst; seeds: key."""
    s = seeds.select(F.col("key").alias("seed")).distinct()
    back = edges.join(s, edges["src"] == F.col("seed")).select("seed", F.col("dst").alias("key"), F.lit("back").alias("way"))
    forward = edges.join(s, edges["dst"] == F.col("seed")).select("seed", F.col("src").alias("key"), F.lit("forward").alias("way"))
    return {"back": back, "forward": forward, "both": back.unionByName(forward)}[direction]


def snowball(edges: DataFrame, seeds: DataFrame, candidates: DataFrame, library: DataFrame, per_seed: int = 25, least: float = 0.25, direction: str = "both") -> DataFrame:
    """(seed, key, relevance, place): the most relevant works one hop from each seed that the library does not have. candidates: key, relevance."""
    hop = one_hop(edges, seeds, direction).select("seed", "key").distinct()
    fresh = new_since(hop, library).join(candidates.where(F.col("relevance") >= least).select("key", "relevance"), "key")
    order = W.partitionBy("seed").orderBy(F.desc("relevance"), "key")
    return fresh.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_seed).select("seed", "key", "relevance", "place")


def topic_histogram(works: DataFrame, field: str = "topic") -> DataFrame:
    return works.groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field)


def enrich(works: DataFrame, lookups: list[tuple[str, DataFrame]]) -> DataFrame:
    """works filled up from lookups: (id column, table with it); a column of works takes the first non-empty value, its own first. One left join for each table."""
    out = works
    for by, table in lookups:
        shared = [c for c in table.columns if c in works.columns and c != by]
        other = table.dropDuplicates([by]).select(F.col(by).alias("lookup_id"), *[F.col(c).alias(f"lookup_{c}") for c in shared])
        out = out.join(other, F.nullif(F.col(by), F.lit("")) == F.col("lookup_id"), "left")
        fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"lookup_{c}"), F.col(c)) if dict(works.dtypes)[c] == "string" else F.coalesce(F.col(c), F.col(f"lookup_{c}")) for c in shared}
        out = out.withColumns(fill).drop("lookup_id", *[f"lookup_{c}" for c in shared])
    return out


def running_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """Lines without running heads and feet. lines: doc, page, place, line. A line whose form (digits as #) stands on at least max(3, half) of a document's pages goes, in documents of three pages and more."""
    form = F.regexp_replace(F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))), r"\d+", "#")
    sized = lines.withColumn("form", form)
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    often = sized.where(F.length(F.trim("line")).between(4, 219)).groupBy("doc", "form").agg(F.count_distinct("page").alias("n")).join(pages, "doc")
    gone = often.where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") / 2)))).select("doc", "form")
    return sized.join(gone, ["doc", "form"], "left_anti").drop("form")


# Headings of reference lists and beginnings of appendices in full texts.
REFERENCE_HEAD = r"(?imU)^\s*(references|reference list|bibliography|literature cited|works cited|bibliografia|piśmiennictwo|literatura)\s*:?\s*$"
APPENDIX_HEAD = r"(?imU)^\s*(appendix\b|supplementary (material|appendix|tables?|figures?)\b|table s\d+\b|figure s\d+\b)"


def cut_references(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) without the reference list: from the first such heading in the second half of a document on, but for pages that begin an appendix."""
    whole = W.partitionBy("doc")
    p = pages.withColumns({"count": F.count("*").over(whole), "place": F.row_number().over(whole.orderBy("page"))})
    p = p.withColumn("head", F.min(F.when((F.col("place") > F.floor(F.col("count") / 2)) & F.col("text").rlike(REFERENCE_HEAD), F.col("place"))).over(whole))
    text = F.when(F.col("place") == F.col("head"), F.get(F.split("text", REFERENCE_HEAD, 2), F.lit(0))).otherwise(F.col("text"))
    keep = F.col("head").isNull() | (F.col("place") < F.col("head")) | ((F.col("place") == F.col("head")) & (F.trim(text) != "")) | ((F.col("place") > F.col("head")) & F.substring("text", 1, 300).rlike(APPENDIX_HEAD))
    return p.where(keep).select("doc", "page", text.alias("text"))


# How papers state funding and interests.
STATEMENTS = {
    "funding": r"(?isU)(?:^|\s)(?:funding|financial support|source of funding|finansowanie)\s*[:.]?\s+(.{20,700}?)(?=\s(?:conflicts? of interest|competing interests|declaration|author contributions|acknowledg|data availability|references)\b|$)",
    "coi": r"(?isU)(?:^|\s)(?:conflicts? of interests?|competing interests?|declaration of interests?|disclosures?|konflikt interesów)\s*[:.]?\s+(.{10,700}?)(?=\s(?:funding|author contributions|acknowledg|data availability|references|ethics)\b|$)",
}


def find_statements(text: str = "text"):
    """struct<funding, coi> of the last 60,000 characters."""
    tail = F.right(F.coalesce(F.col(text), F.lit("")), F.lit(60000))
    return F.struct(*[F.trim(F.regexp_replace(F.regexp_extract(tail, p, 1), r"\s+", " ")).alias(k) for k, p in STATEMENTS.items()])


def field_counts(works: DataFrame, fields: str = "fields") -> DataFrame:
    """How many works have each field of research; fields: array<string>."""
    return topic_histogram(works.select(F.explode(fields).alias("topic")))


def related_reviews(works: DataFrame, since: int | None = None, limit: int = 10) -> DataFrame:
    """Reviews (kind), the newest first, from a year on; a short list is the feature."""
    found = works.where("kind = 'review'")
    return (found.where(F.col("year") >= since) if since else found).orderBy(F.desc("date"), "key").limit(limit)


def works_where(works: DataFrame, status: tuple[str, ...] | str | None = None, origin: str | None = None) -> DataFrame:
    """Works of some statuses and an origin, in the order in which they came (created, key)."""
    out = works
    if status:
        out = out.where(F.col("status").isin(*([status] if isinstance(status, str) else status)))
    if origin:
        out = out.where(F.col("origin") == origin)
    return out.orderBy("created", "key")
