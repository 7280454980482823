"""Evidence tables: extraction templates, pivots, matrices, checked cells and effect ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions.identity import parse_effect
from veriloom.functions.scan import find_quote
from veriloom.functions.text import number_match, numbers, significant

RATIOS = ("OR", "AOR", "RR", "ARR", "HR", "AHR", "IRR")
NOT_REPORTED = ("", "NR", "N/A", "NA", "-", "–")


def latest_cells(cells: DataFrame) -> DataFrame:
    """The last write of each (key, field), by id."""
    return cells.groupBy("key", "field").agg(F.max_by(F.struct("value", "quote", "loc", "verified", "id"), "id").alias("c")).select("key", "field", "c.*")


def extraction_template(works: DataFrame, fields: list[str], cells: DataFrame) -> DataFrame:
    """(key, field, place, value): every field of every work, with what is known already."""
    listed = works.select("key", F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("place", "field"))
    return listed.join(latest_cells(cells).select("key", "field", "value"), ["key", "field"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def evidence_table(cells: DataFrame, fields: list[str]) -> DataFrame:
    """Wide: a row per key, a column per field with its value, and how many of its cells failed verification."""
    last = latest_cells(cells)
    wide = last.groupBy("key").pivot("field", fields).agg(F.first("value"))
    failed = last.groupBy("key").agg(F.count_if(F.coalesce("verified", F.lit(0.0)) < 0.85).alias("failed"))
    return wide.join(failed, "key")


def filled_columns(table: DataFrame, fields: list[str]) -> list[str]:
    """The fields that any row fills."""
    row = table.agg(*[F.count_if(F.coalesce(F.col(f"`{f}`"), F.lit("")) != "").alias(f) for f in fields]).first()
    return [f for f in fields if row[f]]


def claim_matrix(evidence: DataFrame, claims: list[str]) -> DataFrame:
    """A row per source, a column per claim with the symbol of the last stance: + for, - against, ± mixed, · neutral; a question mark if unverified."""
    symbol = F.when(F.col("stance") == "for", "+").when(F.col("stance") == "against", "-").when(F.col("stance") == "mixed", "±").otherwise("·")
    marked = F.concat(symbol, F.when(F.coalesce("verified", F.lit(0.0)) < 0.85, "?").otherwise(""))
    return evidence.withColumn("mark", marked).groupBy("key").pivot("claim_id", claims).agg(F.max_by("mark", "id")).fillna("")


def sources_table(works: DataFrame) -> DataFrame:
    """Sources by weight, then year, both falling. works: key, title, year, design, weight."""
    return works.select("key", "title", "year", "design", "weight").orderBy(F.desc("weight"), F.desc_nulls_last("year"), "key")


def design_counts(designs: Column) -> Column:
    """"rct×2, cohort×1" in the order of first use."""
    return F.array_join(F.transform(F.array_distinct(designs), lambda d: F.concat(d, F.lit("×"), F.size(F.filter(designs, lambda x: x == d)).cast("string"))), ", ")


def check_cells(cells: DataFrame, sources: DataFrame, nfkc: bool = True) -> DataFrame:
    """Adds score and problem to cells (key, value, quote): whether the source (key, text, depth) holds the quote and the quote the value's numbers.

    The score is the least of: 0.8 for a quote under six words; half the similarity of a quote that isn't found (under 0.9); 0.6
    for numbers without a quote; 0.85 for a number in the source but not in the quote; 0.3, or 0.5 where the source isn't the full
    text, for one in neither. Nothing to report scores 1. Without `depth`, sources count as full texts.
    """
    if "depth" not in sources.columns:
        sources = sources.withColumn("depth", F.lit("fulltext"))
    joined = cells.join(sources.select("key", F.col("text").alias("source"), "depth"), "key", "left")
    quoted = F.coalesce("quote", F.lit("")) != ""
    nothing = F.upper(F.trim(F.coalesce("value", F.lit("")))).isin(*NOT_REPORTED)
    joined = joined.withColumns({"found": F.when(quoted, find_quote("quote", "source")), "in_quote": numbers("quote", nfkc), "in_source": numbers("source", nfkc), "own": F.filter(numbers("value", nfkc), significant)})
    absent = F.when(F.col("depth") == "fulltext", 0.3).otherwise(0.5)

    def credit(n: Column) -> Column:
        return F.when(quoted & (number_match(n, F.col("in_quote")) != "missing"), 1.0).when(number_match(n, F.col("in_source")) != "missing", F.when(quoted, 0.85).otherwise(1.0)).otherwise(absent)

    joined = joined.withColumn("least", F.coalesce(F.array_min(F.transform("own", credit)), F.lit(1.0)))
    ratio = F.coalesce("found.similarity", F.lit(0.0))
    brief = quoted & (F.size(F.split(F.trim("quote"), r"\s+")) < 6)
    parts = [F.when(brief, 0.8).otherwise(1.0), F.when(quoted & (ratio < 0.9), ratio * 0.5).otherwise(1.0), F.when(~quoted & (F.size("own") > 0), 0.6).otherwise(1.0), F.col("least")]
    score = F.when(nothing, 1.0).otherwise(F.round(F.least(*parts), 3))
    problem = F.when(nothing, "").when(F.col("source").isNull(), "unknown source").when(quoted & (ratio < 0.9), "quote not found").when(F.col("least") < 0.6, "number not in source").when(~quoted & (F.size("own") > 0), "numbers without a quote").when(F.col("least") < 1, "number not in quote").when(brief, "short quote").otherwise("")
    return joined.withColumns({"score": score, "problem": problem}).drop("found", "source", "depth", "in_quote", "in_source", "own", "least")


def custom_cells(specs: DataFrame) -> DataFrame:
    """(table_id, row, column, key, value, quote, loc) of table specifications in JSON: cells are texts, "@key", or objects."""
    shape = "title string, columns array<string>, rows array<struct<key: string, cells: array<string>>>, notes array<string>"
    cell = "value string, quote string, loc string, key string"
    t = specs.withColumn("spec", F.from_json("spec", shape)).select("table_id", "spec.columns", F.posexplode("spec.rows").alias("row", "r"))
    t = t.select("table_id", "row", "columns", F.col("r.key").alias("row_key"), F.posexplode("r.cells").alias("at", "raw"))
    own = F.when(F.col("raw").startswith("{"), F.from_json("raw", cell))
    return t.select("table_id", "row", F.get("columns", F.col("at")).alias("column"), F.coalesce(own["key"], F.when(F.col("raw").startswith("@"), F.substring(F.col("raw"), F.lit(2), F.length("raw"))), F.col("row_key")).alias("key"), F.coalesce(own["value"], F.when(F.col("raw").startswith("@"), "").otherwise(F.col("raw"))).alias("value"), F.coalesce(own["quote"], F.lit("")).alias("quote"), F.coalesce(own["loc"], F.lit("")).alias("loc"))


def forest_rows(cells: DataFrame, field: str = "effect") -> DataFrame:
    """(key, metric, estimate, low, high) of the effects that can be read."""
    return latest_cells(cells).where(F.col("field") == field).select("key", parse_effect("value").alias("e")).where("e is not null").select("key", F.upper("e.metric").alias("metric"), "e.estimate", "e.low", "e.high")


def forest_range(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row (for each group, if asked for): whether the axis is logarithmic (all metrics ratios, all bounds positive), the null line, and the range with 8 % to spare."""
    log = F.bool_and(F.col("metric").isin(*RATIOS) & (F.col("low") > 0))
    r = rows.groupBy(*(by or [])).agg(log.alias("log_scale"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).withColumn("null_line", F.when(F.col("log_scale"), 1.0).otherwise(0.0))
    place = lambda c: F.when(F.col("log_scale"), F.ln(c)).otherwise(c)
    a, b = place(F.least("low", "null_line")), place(F.greatest("high", "null_line"))
    return r.select(*(by or []), "n", "log_scale", "null_line", (a - (b - a) * 0.08).alias("axis_from"), (b + (b - a) * 0.08).alias("axis_to"))


def first_uses(citations: DataFrame) -> DataFrame:
    """(draft, key, number): citations numbered by first appearance. citations: draft, key, position."""
    first = citations.groupBy("draft", "key").agg(F.min("position").alias("position"))
    return first.withColumn("number", F.row_number().over(W.partitionBy("draft").orderBy("position", "key"))).drop("position")


def nth_uses(citations: DataFrame) -> DataFrame:
    """citations (draft, key, position) with `use`: the how manieth use of its key in the draft each is."""
    return citations.withColumn("use", F.row_number().over(W.partitionBy("draft", "key").orderBy("position")))


def written_cells(cells: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells (key, field, value, quote, loc) as they are kept: `verified` is 1 where nothing is reported, else the check's score; a quote without a place gets the first page (key, page, loc, text) that has it."""
    checked = check_cells(cells, sources).withColumnRenamed("score", "verified")
    asked = cells.where((F.coalesce("loc", F.lit("")) == "") & (F.coalesce("quote", F.lit("")) != "")).select("key", "field", "quote").join(pages, "key")
    found = asked.withColumn("f", find_quote("quote", "text")).where(F.col("f.similarity") >= 0.9).groupBy("key", "field").agg(F.min_by("loc", "page").alias("at"))
    return checked.join(found, ["key", "field"], "left").withColumn("loc", F.coalesce(F.nullif("loc", F.lit("")), "at", F.lit(""))).drop("at", "problem")


def grouped_lists(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, rows): the rows of each group as structs in order."""
    rest = [c for c in rows.columns if c not in (by, order)]
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("rows"))
