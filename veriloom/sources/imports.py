"""What people hand in: screening decisions, evidence, extraction cells; and how rows are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STANCES = ("for", "against", "mixed", "neutral")


def screening_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, stage, decision, reason) from a JSON list or a CSV with a header."""
    want = "key string, stage string, decision string, reason string"
    df = spark.read.schema(want).option("multiLine", True).json(path) if path.endswith(".json") else spark.read.option("header", True).csv(path)
    for name in ("stage", "reason"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.select("key", F.coalesce("stage", F.lit("ta")).alias("stage"), F.lower("decision").alias("decision"), F.coalesce("reason", F.lit("")).alias("reason")).where("key is not null")


def extraction_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, field, value, quote, loc) from {"studies": {key: {field: text or {value, quote, loc}}}}; keys that begin with _ are notes."""
    text = spark.read.text(path, wholetext=True)
    studies = text.select(F.explode(F.from_json(F.get_json_object("value", "$.studies"), "map<string, map<string, string>>")).alias("key", "fields"))
    cells = studies.where(~F.col("key").startswith("_")).select("key", F.explode("fields").alias("field", "raw")).where(~F.col("field").startswith("_"))
    own = F.when(F.col("raw").startswith("{"), F.from_json("raw", "value string, quote string, loc string"))
    return cells.select("key", "field", F.coalesce(own["value"], F.when(~F.col("raw").startswith("{"), F.col("raw")), F.lit("")).alias("value"), F.coalesce(own["quote"], F.lit("")).alias("quote"), F.coalesce(own["loc"], F.lit("")).alias("loc"))


def evidence_file(spark: SparkSession, path: str) -> DataFrame:
    """(claim, key, stance, quote, loc, effect, note) from a JSON list."""
    return spark.read.schema("claim string, key string, stance string, quote string, loc string, effect string, note string").option("multiLine", True).json(path)


def checked_evidence(rows: DataFrame, claims: DataFrame, works: DataFrame) -> DataFrame:
    """Adds `problem`: an unknown claim, an unknown source or an unknown stance; '' if there is none. claims: claim_id; works: key."""
    known = rows.join(claims.select(F.col("claim_id").alias("claim")).distinct().withColumn("has_claim", F.lit(True)), "claim", "left").join(works.select("key").distinct().withColumn("has_work", F.lit(True)), "key", "left")
    problem = F.when(F.col("has_claim").isNull(), "unknown claim").when(F.col("has_work").isNull(), "unknown source").when(~F.coalesce("stance", F.lit("")).isin(*STANCES), "unknown stance").otherwise("")
    return known.withColumn("problem", problem).drop("has_claim", "has_work")


def upsert(now: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row, by `order`, of each key among what is kept and what is new; a snapshot to overwrite a table with."""
    both = now.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def first_wins(now: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As upsert, but the first row stays."""
    both = now.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in both.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def shown(pages: DataFrame, loc: str = "", grep: str = "") -> DataFrame:
    """Pages whose location holds `loc` and whose text holds `grep`, without regard to case."""
    return pages.where(F.lower("loc").contains(loc.lower()) & F.lower("text").contains(grep.lower()))
