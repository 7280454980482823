"""Screening: the rule ladder, relevance, the decision log, the flow counts and the screening list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions.identity import norm_doi
from veriloom.functions.text import content_tokens, overlap_of

INCLUDED = ("ta_included", "ft_included")
EXCLUDED = ("ta_excluded", "ft_excluded", "auto_excluded", "not_retrieved")
# Three-letter language codes, and the kinds that are no research.
LANGUAGES = {"eng": "en", "pol": "pl", "ger": "de", "fre": "fr", "spa": "es"}
NOT_RESEARCH = ("paratext", "erratum", "peer-review")


def language_code(c: Column) -> Column:
    low = F.lower(c)
    out = low
    for a, b in LANGUAGES.items():
        out = F.when(low == a, b).otherwise(out)
    return F.substring(out, 1, 2)


def auto_screen(works: DataFrame, since: int | None = None, languages: list[str] | None = None, exclude_designs: list[str] | None = None, exclude_retracted: bool = True) -> DataFrame:
    """(key, reason) of the works with status `new` that a rule excludes, by the first rule that holds.

    works: key, status, is_retracted, year, design, kind, language, is_preprint, published_version, doi. An unknown year or
    language passes. The ladder is one CASE; only preprints with a published version join the DOIs of the library.
    """
    reason = F.when(F.lit(exclude_retracted) & F.coalesce("is_retracted", F.lit(False)), "retracted")
    if since:
        reason = reason.when((F.col("year") > 0) & (F.col("year") < since), f"published before {since}")
    if exclude_designs:
        reason = reason.when(F.col("design").isin(*exclude_designs), F.concat(F.lit("design excluded by pack: "), "design"))
    reason = reason.when(F.col("kind").isin(*NOT_RESEARCH), F.concat(F.lit("not a research item ("), "kind", F.lit(")")))
    if languages:
        known = F.coalesce("language", F.lit("")) != ""
        reason = reason.when(known & ~language_code(F.col("language")).isin(*[x.lower() for x in languages]), F.concat(F.lit("language "), "language", F.lit(" not in criteria")))
    ruled = works.where("status = 'new'").select("key", reason.alias("reason"), F.when(F.coalesce("is_preprint", F.lit(False)), F.nullif(norm_doi("published_version"), F.lit(""))).alias("version"))
    library = works.select(F.nullif(norm_doi("doi"), F.lit("")).alias("version"), F.col("key").alias("published")).where("version is not null").groupBy("version").agg(F.max("published").alias("published"))
    joined = ruled.join(library, "version", "left")
    return joined.select("key", F.coalesce("reason", F.concat(F.lit("superseded by published version @"), "published")).alias("reason")).where("reason is not null")


def reason_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy(F.substring_index("reason", ":", 1).alias("rule")).agg(F.count("*").alias("n"))


def relevance(text: Column, targets: list[Column], nfkc: bool = True) -> Column:
    """The best overlap of any target with a text."""
    tokens = content_tokens(text, nfkc)
    return F.coalesce(F.array_max(F.array(*[overlap_of(content_tokens(t, nfkc), tokens) for t in targets])), F.lit(0.0))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each key (by id)."""
    return decisions.groupBy("key").agg(F.max_by(F.struct("stage", "decision", "reason", "id"), "id").alias("d")).select("key", "d.*")


def status_of(stage: Column, decision: Column) -> Column:
    """The status that a decision leads to."""
    return (
        F.when((stage == "auto") & (decision == "exclude"), "auto_excluded")
        .when(decision == "not_retrieved", "not_retrieved")
        .when(decision == "maybe", "maybe")
        .when(decision == "include", F.concat(stage, F.lit("_included")))
        .when(decision == "exclude", F.concat(stage, F.lit("_excluded")))
        .otherwise("new")
    )


def exclusion_reasons(decisions: DataFrame, top: int = 8) -> DataFrame:
    """(full_text, reason, n): the most frequent reasons of latest exclusions, up to a colon or bracket and 60 characters, `top` for each stage group."""
    text = F.trim(F.substring_index(F.substring_index(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("no reason")), ":", 1), "(", 1))
    label = F.concat(F.when(F.col("stage") == "auto", "[auto] ").otherwise(""), F.substring(text, 1, 60))
    n = latest_decisions(decisions).where("decision = 'exclude'").groupBy((F.col("stage") == "ft").alias("full_text"), label.alias("reason")).agg(F.count("*").alias("n"))
    order = W.partitionBy("full_text").orderBy(F.desc("n"), "reason")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def flow_counts(works: DataFrame, searches: DataFrame, fulltext: DataFrame) -> DataFrame:
    """The flow of records as one row. works: key, status, origin; searches: connector, returned, error, run; fulltext: key."""
    found = searches.where("coalesce(error, '') = '' and coalesce(run, '') <> 'watch'").agg(F.coalesce(F.sum("returned"), F.lit(0)).cast("long").alias("identified"))
    has = fulltext.select("key").distinct().withColumn("has_text", F.lit(True))
    w = works.join(has, "key", "left")
    s, text = F.col("status"), F.coalesce("has_text", F.lit(False))
    count = F.count_if
    one = w.agg(
        count(F.col("origin") == "search").alias("from_search"), count(F.col("origin") != "search").alias("other_sources"), F.count("*").alias("screened"),
        count(s == "auto_excluded").alias("auto_excluded"), count(s == "ta_excluded").alias("ta_excluded"), count(s.isin("new", "maybe")).alias("awaiting"),
        count(s.isin(*INCLUDED, "ft_excluded", "not_retrieved")).alias("sought"), count(text & s.isin(*INCLUDED, "ft_excluded")).alias("full_text"),
        count(s == "ft_excluded").alias("ft_excluded"), count(s.isin(*INCLUDED)).alias("included"), count(text & s.isin(*INCLUDED)).alias("included_fulltext"),
    )
    both = one.join(F.broadcast(found))  # one row each
    return both.withColumns({"duplicates": F.greatest(F.lit(0), F.col("identified") - F.col("from_search")), "not_retrieved": F.col("sought") - F.col("full_text")}).drop("from_search")


def next_step(counts: DataFrame) -> DataFrame:
    """Adds what to do next to a row of flow counts."""
    step = F.when(F.col("screened") == 0, "search").when(F.col("awaiting") > 0, "screen").when(F.col("included") == 0, "search").when(F.col("full_text") < F.col("sought"), "fetch").otherwise("extract")
    return counts.withColumn("next_step", step)


def screening_page(works: DataFrame, sort: str = "both", offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of the list by 0.75 relevance + 0.25 weight, by weight and relevance, or by year. works: key, relevance, weight, year."""
    mixed = F.round(F.lit(0.75) * F.col("relevance") + F.lit(0.25) * F.col("weight"), 6)
    by = {"both": [mixed.desc()], "weight": [F.desc("weight"), F.desc("relevance")], "year": [F.desc_nulls_last("year")]}[sort]
    return works.orderBy(*by, "key").offset(offset).limit(limit)
