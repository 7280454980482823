"""Full texts: located parts of JATS and plain files, what text a work gets, and whether it is the same document."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.identity import norm_doi
from veriloom.functions.text import slug, with_overlap

# Where a full text comes from, the best first.
SOURCES = ("user", "pmc", "arxiv", "saos", "ntrs", "oa")


def _flat(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def jats_parts(xml: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(position, kind, location, text) of a JATS article: paragraphs under their nested sections, tables as rows, figures, funding, interests, thanks."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return
    at = 0
    for e in root.iter():  # namespaces away
        e.tag = _local(e)

    def below(sec: ET.Element, path: list[str]) -> Iterator[tuple[str, str, str]]:
        own = [*path, _flat(sec.find("title"))] if sec.tag == "sec" else path
        text = [_flat(p) for p in sec if p.tag in ("p", "list", "disp-quote", "boxed-text")]
        if any(text):
            yield "sec", "sec. " + " › ".join(x for x in own if x) if any(own) else "sec. body", "\n".join(t for t in text if t)
        for t in sec:
            if t.tag == "table-wrap":
                rows = [" | ".join(_flat(c) for c in r if c.tag in ("td", "th")) for r in t.iter("tr")]
                yield "table", _flat(t.find("label")) or "table", "\n".join([x for x in (_flat(t.find("caption")),) if x] + rows)
            elif t.tag == "fig":
                yield "figure", _flat(t.find("label")) or "figure", _flat(t.find("caption"))
            elif t.tag == "sec":
                yield from below(t, own)

    for abstract in root.iter("abstract"):
        yield at, "abstract", "abstract", _flat(abstract)
        at += 1
    for body in root.iter("body"):
        for kind, loc, text in below(body, []):
            yield at, kind, loc, text
            at += 1
    for tag, kind in (("funding-statement", "funding"), ("ack", "ack")):
        for e in root.iter(tag):
            yield at, kind, kind, _flat(e)
            at += 1
    for e in root.iter("fn"):
        if e.get("fn-type") in ("conflict", "COI-statement", "coi-statement"):
            yield at, "coi", "coi", _flat(e)
            at += 1


@F.udtf(returnType=T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("loc", T.StringType()), T.StructField("text", T.StringType())]), useArrow=True)
class ParseJats:
    def eval(self, xml: str) -> Iterator[tuple]:
        yield from jats_parts(xml)


def register(spark) -> None:
    spark.udtf.register("parse_jats", ParseJats)


def plain_parts(files: DataFrame) -> DataFrame:
    """(key, page, text): parts of plain files (key, text) between two blank lines."""
    return files.select("key", F.posexplode(F.split("text", r"\n\s*\n\s*\n")).alias("page", "text")).where(F.trim("text") != "").withColumn("loc", F.concat(F.lit("part "), (F.col("page") + 1).cast("string")))


def pick_text(candidates: DataFrame) -> DataFrame:
    """The first acceptable candidate of each key in the order of SOURCES. candidates: key, source, accepted, path."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return candidates.where(F.col("accepted") & (rank > 0)).groupBy("key").agg(F.min_by(F.struct("source", "path"), F.struct(rank, "path")).alias("c")).select("key", "c.*")


def same_document(pairs: DataFrame, nfkc: bool = True) -> DataFrame:
    """Adds `same` to pairs (title, doi, first_pages): the title overlaps with the first 6,000 characters by 0.6, or the DOI stands there."""
    head = pairs.withColumn("head", F.substring(F.coalesce("first_pages", F.lit("")), 1, 6000))
    doi = F.nullif(norm_doi("doi"), F.lit(""))
    return with_overlap(head, "title", "head", "title_overlap", nfkc).withColumn("same", (F.col("title_overlap") >= 0.6) | F.coalesce(F.lower("head").contains(doi), F.lit(False))).drop("head")


def doi_in_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return norm_doi(F.regexp_extract(F.substring(c, 1, 8000), r"(?i)\b(10\.\d{4,9}/[^\s\"'<>]+)", 1))


def pdf_candidates(*urls: Column) -> Column:
    """Distinct non-empty URLs in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(u, F.lit("")) for u in urls])))


def user_files(listing: DataFrame, works: DataFrame) -> DataFrame:
    """(key, path): files (path) named by a work's key or the slug of its DOI. works: key, doi."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[A-Za-z0-9]+$", "")
    names = works.select("key", F.explode(F.array_distinct(F.array("key", slug("doi", 80)))).alias("name")).where("name <> 'x'")
    return listing.withColumn("name", name).join(names, "name").groupBy("key").agg(F.min("path").alias("path"))


def longer(old: Column, new: Column) -> Column:
    """The new value if it is longer."""
    return F.when(F.length(F.coalesce(new, F.lit(""))) > F.length(F.coalesce(old, F.lit(""))), new).otherwise(old)


def source_texts(works: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, depth, text): title, abstract and full text of each work. works: key, title, abstract; pages: key, page, text."""
    full = pages.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("full"))
    w = works.select("key", "title", "abstract").join(full, "key", "left")
    depth = F.when(F.col("full").isNotNull(), "fulltext").when(F.coalesce("abstract", F.lit("")) != "", "abstract").otherwise("metadata")
    return w.select("key", depth.alias("depth"), F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("abstract", F.lit("")), "full").alias("text"))
