"""Citation formats as columns: a text per work, written with df.write.text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.identity import norm_doi

# Entry types of designs.
BIBTEX = {"book": "book", "thesis": "phdthesis", "conference_paper": "inproceedings", "technical_report": "techreport", "preprint": "misc", "dataset": "misc", "legislation": "misc", "judgment": "misc"}
RIS = {"book": "BOOK", "thesis": "THES", "conference_paper": "CPAPER", "technical_report": "RPRT", "preprint": "UNPB", "dataset": "DATA", "legislation": "STAT", "judgment": "CASE"}
CSL = {"book": "book", "thesis": "thesis", "conference_paper": "paper-conference", "technical_report": "report", "preprint": "article", "dataset": "dataset", "legislation": "legislation", "judgment": "legal_case"}


def _map(design: Column, kinds: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for a, b in kinds.items():
        out = F.when(design == a, b).otherwise(out)
    return out


def _some(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def bibtex() -> Column:
    """From columns key, design, title, authors, year, venue, volume, issue, pages, doi, url; empty fields are left out."""
    fields = {"title": _some("title"), "author": _some(F.array_join("authors", " and ")), "year": _some("year"), "journal": _some("venue"), "volume": _some("volume"), "number": _some("issue"), "pages": F.regexp_replace(_some("pages"), "-+", "--"), "doi": _some(norm_doi("doi")), "url": _some("url")}
    body = F.concat_ws(",\n", *[F.concat(F.lit(f"  {k} = {{"), v, F.lit("}")) for k, v in fields.items()])
    return F.concat(F.lit("@"), _map(F.col("design"), BIBTEX, "article"), F.lit("{"), F.col("key"), F.lit(",\n"), body, F.lit("\n}"))


def ris() -> Column:
    lines = [F.concat(F.lit("TY  - "), _map(F.col("design"), RIS, "JOUR")), F.nullif(F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n"), F.lit(""))]
    lines += [F.concat(F.lit(f"{tag}  - "), v) for tag, v in (("TI", _some("title")), ("PY", _some("year")), ("JO", _some("venue")), ("VL", _some("volume")), ("IS", _some("issue")), ("SP", _some(F.substring_index("pages", "-", 1))), ("EP", F.when(F.col("pages").contains("-"), _some(F.substring_index("pages", "-", -1)))), ("DO", _some(norm_doi("doi"))), ("UR", _some("url")))]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\nER  - \n"))


def csl_json() -> Column:
    person = F.transform("authors", lambda a: F.when(a.contains(","), F.struct(F.trim(F.substring_index(a, ",", 1)).alias("family"), F.trim(F.regexp_extract(a, ",(.*)$", 1)).alias("given"), F.lit(None).cast("string").alias("literal"))).otherwise(F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), a.alias("literal"))))
    date = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array(F.col("year"))).alias("date-parts")))
    return F.to_json(F.struct(F.col("key").alias("id"), _map(F.col("design"), CSL, "article-journal").alias("type"), _some("title").alias("title"), person.alias("author"), date.alias("issued"), _some("venue").alias("container-title"), _some("volume").alias("volume"), _some("issue").alias("issue"), _some("pages").alias("page"), _some(norm_doi("doi")).alias("DOI"), _some("url").alias("URL")))


def export(works: DataFrame, form: str, path: str) -> None:
    made = {"bibtex": bibtex, "ris": ris, "csl": csl_json}[form]()
    works.select(made.alias("value")).write.mode("overwrite").text(path)


def vault(works: DataFrame, path: str, claims: DataFrame | None = None) -> None:
    """Markdown notes: sources by key, claims (claim_id, text, consensus, certainty, keys_for, keys_against, keys_mixed) by id with links to their sources, and an index."""
    lines = F.array_compact(F.array(F.concat(F.lit("# "), _some("title")), F.concat(F.lit("year:: "), _some("year")), F.concat(F.lit("design:: "), _some("design")), F.concat(F.lit("doi:: "), _some(norm_doi("doi"))), _some("abstract")))
    works.select("key", F.array_join(lines, "\n").alias("value")).write.mode("overwrite").partitionBy("key").text(f"{path}/sources")
    heads = [works.select(F.lit(1).alias("part"), F.concat(F.lit("- [["), "key", F.lit("]]")).alias("value"))]
    if claims is not None:
        links = lambda c, stance: F.transform(c, lambda k: F.concat(F.lit("- [["), k, F.lit(f"]] ({stance})")))
        body = F.concat(F.array_compact(F.array(F.concat(F.lit("# "), F.col("text")), F.concat(F.lit("consensus:: "), F.col("consensus").cast("string")), F.concat(F.lit("certainty:: "), F.col("certainty")))), links("keys_for", "for"), links("keys_against", "against"), links("keys_mixed", "mixed"))
        claims.select(F.col("claim_id").alias("claim"), F.array_join(body, "\n").alias("value")).write.mode("overwrite").partitionBy("claim").text(f"{path}/claims")
        heads.append(claims.select(F.lit(3).alias("part"), F.concat(F.lit("- [["), "claim_id", F.lit("]]")).alias("value")))
    index = works.sparkSession.createDataFrame([(0, "# Sources"), (2, "# Claims")][: len(heads)], "part int, value string")
    for h in heads:
        index = index.unionByName(h)
    index.orderBy("part", "value").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/index")
