"""The draft verifier: sentences joined with their citations, sources, claims; issues; a score from 0 to 100."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions.scan import CITATION, ParseDraft, find_quote, parse_citations
from veriloom.functions.text import number_match, numbers, significant, with_overlap, words
from veriloom.functions.words import STOP_EN
from veriloom.operators.evidence import VERIFIED, main_estimate

# Wording of causes, absolutes, hedges, animals, statements of fact and conclusions, in English and Polish.
CAUSAL = r"(?iU)\b(causes?|caused|causing|leads? to|results? in|prevents?|prevented|cures?|cured|protects? against|eliminates?|reverses?|boosts?|improves?|reduces?|increases?|decreases?|lowers?|raises?|powoduj\w*|spowodowa\w*|prowadzi do|zapobieg\w*|lecz[yąy]\w*|chroni\w* przed|zmniejsz\w*|zwiększ\w*|obniż\w*|podnos\w*|popraw\w*|redukuj\w*|wywołuj\w*)\b"
ABSOLUTE = r"(?iU)\b(proves?|proven|definitely|undeniabl\w*|undoubtedly|always|never|guarantee\w*|conclusively|there is no doubt|beyond doubt|udowodni\w*|niezaprzeczaln\w*|bez wątpienia|zawsze|nigdy|gwarantuj\w*|niewątpliwie|ponad wszelką wątpliwość)\b"
HEDGED = r"(?iU)\b(associated|association|linked|correlat\w*|may|might|could|suggest\w*|appears?|wiąż\w*|związ\w*|skorel\w*|może|mogą|sugeruj\w*|wydaje się|prawdopodobn\w*)\b"
ANIMAL = r"(?iU)\b(mice|mouse|rats?|animals?|murine|rodents?|in vitro|cells?|cell lines?|zebrafish|myszy|myszach|szczur\w*|zwierz\w*|komór\w*|in vivo)\b"
EMPIRICAL = r"(?iU)\b(stud(y|ies)|trials?|evidence|meta-analys\w*|research|found|showed|shown|demonstrat\w*|reported|associated|risk|rates?|effect|significant\w*|increase\w*|decrease\w*|reduc\w*|higher|lower|more likely|less likely|prevalence|incidence|percent|badani\w*|metaanaliz\w*|wykaza\w*|stwierdz\w*|wyniki|ryzyk\w*|skuteczn\w*|częstoś\w*|odsetek|istotn\w*|zwiększ\w*|zmniejsz\w*|wyższ\w*|niższ\w*)\b"
CONCLUSION = r"(?iU)(conclusion|summary|bottom line|take[- ]home|implications|discussion of limits|wnioski|podsumowanie|konkluzj|zakończenie)"
# The score's parts and their weights.
WEIGHTS = {"support": 30, "numbers": 20, "quotes": 10, "coverage": 20, "calibration": 10, "balance_scope": 10, "evidence_table": 5}
SEVERITIES = ("hard", "error", "warn", "note")
CHECKS = ("integrity", "quotes", "numbers", "support", "coverage", "calibration", "primary", "tables", "balance")
HUMAN_RANK = ("guideline", "legislation", "standard")


def parse_drafts(drafts: DataFrame, text_col: str = "text") -> DataFrame:
    """(draft, position, sentence, line, section, paragraph, in_table, cites, plain) for drafts (draft, text)."""
    from pyspark.sql.functions import col

    spark = drafts.sparkSession
    spark.udtf.register("veriloom_parse_draft", ParseDraft)
    drafts.select("draft", col(text_col).alias("text")).createOrReplaceTempView("veriloom_drafts")
    rows = spark.sql("select d.draft, p.* from veriloom_drafts d, lateral veriloom_parse_draft(d.text) p")
    return rows.withColumns({"cites": parse_citations("sentence"), "plain": F.regexp_replace("sentence", r"\s*" + CITATION, "")})


def _issue(df: DataFrame, severity: Column | str, check: str, message: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("draft", lit(severity).alias("severity"), F.lit(check).alias("check"), lit(message).alias("message"), "line", F.col("sentence").alias("text"))


@dataclass
class Matrix:
    """What the checks of claims, sub-questions and tables need, all of one project.

    claims: claim_id, subq. evidence: claim_id, key. votes: claim_id, keys_for, keys_against, keys_mixed (claim_summary gives
    them). works: key, year, design, abstract. subqs: subq. hits: subq, key (of included works). cells: key, field,
    verified. fields: whether the packs have extraction fields.
    """

    claims: DataFrame
    evidence: DataFrame
    votes: DataFrame
    works: DataFrame
    subqs: DataFrame
    hits: DataFrame
    cells: DataFrame
    fields: bool = True


def verify(drafts: DataFrame, sources: DataFrame, causal_designs: list[str], nfkc: bool = True, matrix: Matrix | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, scores). drafts: draft, text. sources: key, status, is_retracted, is_preprint, published_version, design, depth (fulltext, abstract or metadata), lang, text.

    issues: draft, severity, check, message, line, text. scores: draft, score, hard, errors, passed, band and the parts.
    Sentences, citations, quotes and numbers are rows; every check is a join or a grouped aggregate by draft and position.
    With a matrix, balance, freshness, scope, main results and tables are checked and scored too.
    """
    s = parse_drafts(drafts)
    s = s.withColumns({"numbers": F.filter(numbers("plain", nfkc), significant), "cited": F.size("cites") > 0})
    refs = s.select("draft", "position", "line", "section", "sentence", "plain", "in_table", "numbers", F.explode("cites").alias("c")).select("*", "c.key", "c.locator", "c.quote").drop("c")
    known = refs.join(sources.withColumnRenamed("text", "source"), "key", "left")
    unknown = F.col("status").isNull()
    issues = [
        _issue(s.where(F.col("plain").contains("[@")), "hard", "integrity", "malformed citation"),
        _issue(known.where(unknown), "hard", "integrity", F.concat(F.lit("unknown key @"), "key")),
    ]
    once = known.where(~unknown).withColumn("use", F.row_number().over(W.partitionBy("draft", "key").orderBy("position"))).where("use = 1")
    issues += [
        _issue(once.where("is_retracted"), "hard", "integrity", F.concat(F.lit("retracted source @"), "key")),
        _issue(once.where(~F.col("is_retracted") & F.col("status").endswith("excluded")), "hard", "integrity", F.concat(F.lit("excluded source @"), "key")),
        _issue(once.where(F.col("status").isin("new", "maybe")), "warn", "integrity", F.concat(F.lit("source not screened @"), "key")),
        _issue(once.where(F.col("is_preprint") & (F.coalesce("published_version", F.lit("")) != "")), "warn", "integrity", F.concat(F.lit("preprint with a published version @"), "key")),
    ]
    # quotes
    q = known.where(~unknown & (F.col("quote") != "")).withColumn("found", find_quote("quote", "source"))
    q = q.withColumn("right", F.when(F.col("found.similarity") >= 0.9, F.when(F.size(words("quote", nfkc)) >= 5, 1.0).otherwise(0.5)).otherwise(0.0))
    issues.append(_issue(q.where("right = 0"), F.when(F.col("depth") == "fulltext", "error").otherwise("warn"), "quotes", F.concat(F.lit("quote not found in @"), "key")))
    # support: the best of a sentence's sources
    live = known.where(~unknown & ~F.col("in_table"))
    anchored = F.max(F.when(F.col("a") > 0, F.least(F.lit(1.0), F.greatest(F.lit(1.6) * F.col("o"), F.lit(0.75)))))
    o = live.join(q.select("draft", "position", "key", F.col("right").alias("a")).groupBy("draft", "position", "key").agg(F.max("a").alias("a")), ["draft", "position", "key"], "left")
    o = with_overlap(o, "plain", "source", "o", nfkc)
    best = o.groupBy("draft", "position").agg(anchored.alias("anchored"), F.max("o").alias("o"), F.bool_or(F.col("depth") == "fulltext").alias("full"), F.first("line").alias("line"), F.first("sentence").alias("sentence"), F.max((F.col("design").isin(*causal_designs)).cast("int")).alias("may_cause"), F.max(F.col("design").isin(*HUMAN_RANK).cast("int")).alias("may_rule"), F.bool_and(F.col("design").isin("animal", "in_vitro")).alias("no_humans"), F.first("plain").alias("plain"))
    support = F.coalesce("anchored", F.when(F.col("o") >= 0.5, 1.0).when(F.col("o") >= 0.3, 0.5).otherwise(F.when(F.col("full"), 0.0).otherwise(0.4)))
    best = best.withColumn("support", support)
    issues += [
        _issue(best.where("anchored is null and o < 0.5 and o >= 0.3"), "warn", "support", "weak support"),
        _issue(best.where("anchored is null and o < 0.3"), F.when(F.col("full"), "error").otherwise("warn"), "support", "no support found in the cited sources"),
    ]
    # numbers: exact beats rounded beats missing over all cited sources
    n = known.where(~unknown).select("draft", "position", "line", "sentence", "depth", F.posexplode("numbers").alias("place", "n"), numbers("source", nfkc).alias("have"))
    rank = F.when(number_match(F.col("n"), F.col("have")) != "missing", 1.0).otherwise(F.when(F.col("depth") == "fulltext", 0.0).otherwise(0.4))
    n = n.groupBy("draft", "position", "place").agg(F.max(rank).alias("credit"), F.first("line").alias("line"), F.first("sentence").alias("sentence"), F.first("n.raw").alias("raw"))
    loose = s.where(~F.col("cited")).select("draft", "position", "line", "sentence", F.explode("numbers").alias("n"))
    issues += [_issue(n.where("credit < 1"), F.when(F.col("credit") == 0, "error").otherwise("warn"), "numbers", F.concat(F.lit("number not in the cited sources: "), "raw")), _issue(loose, "error", "numbers", F.concat(F.lit("number without a citation: "), "n.raw"))]
    # coverage and calibration
    empirical = ~F.col("in_table") & ~F.col("plain").endswith("?") & (F.col("plain").rlike(EMPIRICAL) | (F.size("numbers") > 0)) & ~(F.col("section").rlike(CONCLUSION) & (F.size("numbers") == 0))
    s = s.withColumn("empirical", empirical)
    issues.append(_issue(s.where(F.col("empirical") & ~F.col("cited")), "warn", "coverage", "statement of fact without a citation"))
    causal = F.col("plain").rlike(CAUSAL) & ~F.col("plain").rlike(HEDGED) & (F.col("may_cause") == 0)
    absolute = F.col("plain").rlike(ABSOLUTE) & (F.col("may_rule") == 0)
    animals = F.col("no_humans") & ~F.col("plain").rlike(ANIMAL)
    best = best.withColumn("over", causal.cast("int") + absolute.cast("int") + animals.cast("int"))
    issues += [_issue(best.where(t), "warn", "calibration", m) for t, m in ((causal, "causal wording without a design that allows it"), (absolute, "absolute wording"), (animals, "animal or cell evidence stated as if of humans"))]
    found = issues[0]
    for x in issues[1:]:
        found = found.unionByName(x)
    depth = known.where(~unknown).groupBy("draft").agg(F.count_distinct(F.when(F.col("depth") == "fulltext", F.col("key"))).alias("full"), F.count_distinct("key").alias("cited_keys"))
    shallow = depth.where("full < 0.5 * cited_keys").select("draft", F.lit("note").alias("severity"), F.lit("depth").alias("check"), F.lit("less than half of the sources were read in full").alias("message"), F.lit(0).alias("line"), F.lit("").alias("text"))
    found = found.unionByName(shallow)
    listed = s.select("draft").distinct().join(drafts.where(F.col("text").rlike(r"(?im)^#{1,6}\s*(references|bibliography|works cited|sources|bibliografia|literatura|źródła|przypisy)\b")).select("draft"), "draft", "left_semi")
    found = found.unionByName(_draft_issue(listed, "note", "format", "the draft has a hand-written list of references"))
    more = None
    if matrix is not None:
        cited = known.where(~unknown).select("draft", "key").distinct()
        extra, more = matrix_checks(drafts, s.select("draft").distinct(), cited, known.where(~unknown).select("draft", "key", "numbers", "line"), matrix, nfkc)
        found = found.unionByName(extra)
    # score
    parts = s.groupBy("draft").agg(F.count_if(F.col("empirical") & ~F.col("cited")).alias("uncited"), F.count_if("empirical").alias("empirical"), F.count_if(F.col("cited") & ~F.col("in_table")).alias("cited_sentences"))
    parts = parts.join(best.groupBy("draft").agg(F.sum("support").alias("support_sum"), F.count("*").alias("supported"), F.sum("over").alias("over")), "draft", "left")
    credit = n.select("draft", "credit").unionByName(loose.select("draft", F.lit(0.0).alias("credit")))
    parts = parts.join(credit.groupBy("draft").agg(F.sum("credit").alias("credit"), F.count("*").alias("checked")), "draft", "left")
    parts = parts.join(q.groupBy("draft").agg(F.sum("right").alias("right"), F.count("*").alias("quotes")), "draft", "left")
    parts = parts.join(found.groupBy("draft").agg(F.count_if(F.col("severity") == "hard").alias("hard"), F.count_if(F.col("severity") == "error").alias("errors")), "draft", "left").fillna(0, ["hard", "errors"])
    if more is not None:
        parts = parts.join(more, "draft", "left")
    return ranked_issues(found), score(parts)


def _draft_issue(df: DataFrame, severity: Column | str, check: str, message: Column | str, line: Column | None = None) -> DataFrame:
    """Issues of whole drafts (draft)."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("draft", lit(severity).alias("severity"), F.lit(check).alias("check"), lit(message).alias("message"), (F.lit(0) if line is None else line).cast("int").alias("line"), F.lit("").alias("text"))


def scope_issues(claims: DataFrame, evidence: DataFrame, subqs: DataFrame, hits: DataFrame, cited: DataFrame, drafts: DataFrame) -> DataFrame:
    """(draft, subq): sub-questions none of whose sources a draft cites. Sources: those of its claims, or, where these have none, its included hits."""
    own = claims.select("claim_id", "subq").join(evidence.select("claim_id", "key"), "claim_id").select("subq", "key").distinct()
    found = hits.select("subq", "key").distinct().join(own.select("subq").distinct(), "subq", "left_anti")
    sources = subqs.select("subq").distinct().join(own.unionByName(found), "subq")
    touched = sources.join(cited.select("draft", "key"), "key").select("draft", "subq").distinct()
    asked = drafts.select("draft").distinct().withColumn("subqs", F.lit(1)).join(sources.select("subq").distinct().withColumn("subqs", F.lit(1)), "subqs").drop("subqs")
    return asked.join(touched, ["draft", "subq"], "left_anti")


def primary_results(uses: DataFrame, works: DataFrame, nfkc: bool = True) -> DataFrame:
    """(draft, key, label, estimate, stated): cited reviews that a draft reports numbers of, and whether their main estimate is among them (within 0.0051). uses: draft, key, numbers; works: key, design, abstract."""
    reported = uses.select("draft", "key", F.explode("numbers").alias("n")).where((F.col("n.decimals") > 0) & ~F.col("n.pct"))
    values = reported.groupBy("draft", "key").agg(F.flatten(F.collect_list("n.values")).alias("values"))
    heads = works.where("design = 'sr_ma'").select("key", main_estimate("abstract", nfkc).alias("e")).where("e is not null").select("key", "e.label", "e.estimate")
    return values.join(heads, "key").select("draft", "key", "label", "estimate", F.exists("values", lambda v: F.abs(v - F.col("estimate")) < 0.0051).alias("stated"))


# How a draft marks a table's place, the tables there are, and designs that are no research.
TABLE_PLACE = r"<!--\s*(?:fr|cg):table\s+(\S+)[^>]*?-->"
TABLES = ("extraction", "sources", "sof", "matrix", "forest", "custom")
NO_RESEARCH = ("dataset", "legislation", "judgment", "standard", "trial_registration")


def verified_share(cells: DataFrame, cited: DataFrame, works: DataFrame) -> DataFrame:
    """(draft, research, covered, rows): cited research sources, those with a verified cell, and all keys with one."""
    rows = cells.where(F.coalesce("verified", F.lit(0.0)) >= VERIFIED).select("key").distinct()
    research = cited.join(works.where(~F.col("design").isin(*NO_RESEARCH)).select("key"), "key", "left_semi")
    marked = research.join(rows.withColumn("has", F.lit(1)), "key", "left")
    return marked.groupBy("draft").agg(F.count("*").alias("research"), F.count("has").alias("covered")).join(rows.agg(F.count("*").alias("rows")))  # one row


def matrix_checks(drafts: DataFrame, known: DataFrame, cited: DataFrame, uses: DataFrame, m: Matrix, nfkc: bool = True) -> tuple[DataFrame, DataFrame]:
    """(issues, (draft, balance_scope, evidence_table)) of drafts from their cited keys and the numbers that stand by them."""
    unbalanced = balance_issues(m.votes, cited)
    uncovered = scope_issues(m.claims, m.evidence, m.subqs, m.hits, cited, known)
    primary = primary_results(uses, m.works, nfkc)
    voted = m.votes.select("claim_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stance"), F.col(k).alias("keys")) for s, k in (("for", "keys_for"), ("against", "keys_against"), ("mixed", "keys_mixed"))])).alias("v")).select("claim_id", "v.stance", F.explode("v.keys").alias("key"))
    stale = freshness_issues(voted, m.works, cited).select("draft", "claim_id").distinct()
    tables = drafts.select("draft", F.explode(F.regexp_extract_all("text", F.lit(TABLE_PLACE), F.lit(1))).alias("name"))
    share = known.join(verified_share(m.cells, cited, m.works), "draft", "left").join(tables.where("name = 'extraction'").select("draft").distinct().withColumn("placed", F.lit(True)), "draft", "left")
    due = (F.col("research") >= 3) & F.lit(m.fields)
    empty = F.coalesce("placed", F.lit(False)) & (F.col("rows") > 0)
    covered = F.col("covered") / F.col("research")
    table_part = F.when(due, F.when(~empty, 0.0).otherwise(F.least(F.lit(1.0), covered / 0.5)))
    issues = [
        _draft_issue(unbalanced, "warn", "balance", F.concat(F.lit("contrary evidence is never mentioned: "), "claim_id")),
        _draft_issue(stale, "note", "freshness", F.concat(F.lit("a newer synthesis is not cited: "), "claim_id")),
        _draft_issue(uncovered, "warn", "scope", F.concat(F.lit("not addressed: "), "subq")),
        _draft_issue(primary.where("not stated"), "warn", "primary", F.concat(F.lit("the main result is not reported of @"), "key")),
        _draft_issue(tables.where(~F.col("name").isin(*TABLES)).distinct(), "warn", "tables", F.concat(F.lit("unknown table "), "name")),
        _draft_issue(tables.where("name = 'extraction'").select("draft").distinct().join(m.cells.where(F.coalesce("verified", F.lit(0.0)) < VERIFIED).select(F.concat_ws(".", "key", "field").alias("cell"))), "warn", "tables", F.concat(F.lit("a cell failed verification: "), "cell")),
        _draft_issue(share.where(due & ~empty), "warn", "tables", "no verified evidence table"),
        _draft_issue(share.where(due & empty & (covered < 0.5)), "note", "tables", "the evidence table covers less than half of the cited studies"),
    ]
    found = issues[0]
    for x in issues[1:]:
        found = found.unionByName(x)
    count = lambda df, name: df.groupBy("draft").agg(F.count("*").alias(name))
    bad = known.join(count(unbalanced, "a"), "draft", "left").join(count(uncovered, "b"), "draft", "left").join(primary.groupBy("draft").agg(F.count("*").alias("reviews"), F.count_if(~F.col("stated")).alias("c")), "draft", "left").fillna(0, ["a", "b", "c", "reviews"])
    total = m.claims.agg(F.count("*").alias("claims")).join(m.subqs.agg(F.count("*").alias("subqs")))  # one row each
    of = F.col("claims") + F.col("subqs") + F.col("reviews")
    part = bad.join(total).select("draft", F.when(of > 0, F.greatest(F.lit(0.0), F.lit(1.0) - (F.col("a") + F.col("b") + F.col("c")) / of)).alias("balance_scope"))
    return found, part.join(share.select("draft", table_part.alias("evidence_table")), "draft")


def score(parts: DataFrame) -> DataFrame:
    """The weighted mean of the parts that a draft has, times 100; at most 20 without a cited sentence; 15 less for each hard issue; a draft passes at 80 without hard issues and errors."""
    ratio = {
        "support": F.col("support_sum") / F.nullif("supported", F.lit(0)),
        "numbers": F.col("credit") / F.nullif("checked", F.lit(0)),
        "quotes": F.col("right") / F.nullif("quotes", F.lit(0)),
        "coverage": F.lit(1.0) - F.col("uncited") / F.nullif("empirical", F.lit(0)),
        "calibration": F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0) * F.col("over") / F.nullif("cited_sentences", F.lit(0))),
    }
    for more in ("balance_scope", "evidence_table"):
        if more in parts.columns:
            ratio[more] = F.col(more)
    p = parts.withColumns({f"part_{k}": v for k, v in ratio.items()})
    sum_ = lambda f: sum((f(k) for k in ratio), F.lit(0.0))
    total = sum_(lambda k: F.coalesce(F.col(f"part_{k}") * WEIGHTS[k], F.lit(0.0)))
    weight = sum_(lambda k: F.when(F.col(f"part_{k}").isNotNull(), F.lit(float(WEIGHTS[k]))).otherwise(0.0))
    raw = F.coalesce(F.lit(100.0) * total / F.nullif(weight, F.lit(0.0)), F.lit(0.0))
    raw = F.when(F.col("cited_sentences") == 0, F.least(raw, F.lit(20.0))).otherwise(raw)
    value = F.round(F.greatest(F.lit(0.0), raw - 15 * F.col("hard")), 1)
    p = p.withColumn("score", value)
    band = F.when(F.col("score") >= 90, "verified").when(F.col("score") >= 80, "solid").when(F.col("score") >= 60, "needs work").otherwise("unreliable")
    return p.select("draft", "score", "hard", "errors", ((F.col("score") >= 80) & (F.col("hard") == 0) & (F.col("errors") == 0)).alias("passed"), band.alias("band"), *[f"part_{k}" for k in ratio])


def ranked_issues(issues: DataFrame) -> DataFrame:
    """Adds rank: by severity, the order of checks (the others last), line."""
    place = lambda c, xs: F.array_position(F.array(*[F.lit(x) for x in xs]), F.col(c))
    check = place("check", CHECKS)
    order = W.partitionBy("draft").orderBy(place("severity", SEVERITIES), F.when(check > 0, check).otherwise(len(CHECKS) + 1), "line", "message")
    return issues.withColumn("rank", F.row_number().over(order))


def balance_issues(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(draft, claim_id): claims of which a draft cites supporting sources but none of the contradicting ones. claims: claim_id, keys_for, keys_against; cited: draft, key."""
    keys = cited.groupBy("draft").agg(F.collect_set("key").alias("keys"))
    votes = claims.select("claim_id", "keys_for", "keys_against").where(F.size("keys_against") > 0)
    touched = cited.join(votes.select("claim_id", F.explode("keys_for").alias("key")), "key").select("draft", "claim_id").distinct()
    return touched.join(votes, "claim_id").join(keys, "draft").where(~F.arrays_overlap("keys", "keys_against")).select("draft", "claim_id")


def freshness_issues(evidence: DataFrame, works: DataFrame, cited: DataFrame, gap: int = 2) -> DataFrame:
    """(draft, claim_id, key, newer): cited works of a claim for which a synthesis more than `gap` years younger is not cited."""
    w = evidence.join(works.select("key", "year", "design"), "key")
    newest = w.where(F.col("design").isin("sr_ma", "guideline")).select("claim_id", F.col("key").alias("newer"), F.col("year").alias("newer_year"))
    used = cited.join(w.where("stance = 'for'").select("claim_id", "key", "year"), "key")
    pairs = used.join(newest, "claim_id").where(F.col("newer_year") > F.col("year") + gap)
    return pairs.join(cited.select("draft", F.col("key").alias("newer")), ["draft", "newer"], "left_anti").select("draft", "claim_id", "key", "newer").distinct()


def semantic_score(a: Column, b: Column) -> Column:
    """Cosine of two vectors of floats, rescaled as (cosine - 0.35) / 0.4 within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) - 0.35) / 0.4))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def detect_language_votes(text: Column) -> Column:
    """Shares of English stop words, for the cross-language rule."""
    w = words(text, nfkc=False)
    return F.size(F.filter(w, lambda x: x.isin(*sorted(STOP_EN)))) / F.nullif(F.size(w), F.lit(0))


def style_scores(drafts: DataFrame, scorer: Callable[[str], float]) -> DataFrame:
    """(draft, style) by a scorer of one's own (text to a number); one that fails gives null."""

    def safe(x: str) -> float | None:
        try:
            return float(scorer(x or ""))
        except Exception:  # noqa: BLE001  whatever a foreign scorer raises
            return None

    return drafts.select("draft", F.udf(safe, "double")("text").alias("style"))


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """(query_id, id, cosine, place): the k vectors (id, vector) nearest each query (id, vector), itself left out; by the cosine to six places, then id.

    Queries, a stated set, go to all rows in blocks of a fixed size; a task keeps the best of each query that it sees.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    listed = queries.select("id", "vector").where("vector is not null")
    blocks = max(1, -(-listed.count() // block))
    dealt = listed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for number in range(blocks):
        rows = dealt.where(F.col("block") == number).orderBy("id").collect()  # about `block` rows
        if not rows:
            continue
        ids = np.array([r["id"] for r in rows])
        unit = np.array([r["vector"] for r in rows], dtype=np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, unit))

        def best(batches, shared=shared):
            ids, unit = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["id"].to_numpy()
                x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                score = np.round(unit @ x.T, 6)
                score[ids[:, None] == own[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
                q = np.repeat(ids, order.shape[1])
                out = pd.DataFrame({"query_id": q, "id": own[order].ravel(), "cosine": np.take_along_axis(score, order, axis=1).ravel()})
                yield out[np.isfinite(out["cosine"])]

        one = vectors.select("id", "vector").where("vector is not null").mapInPandas(best, "query_id long, id long, cosine double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, cosine double")
    return found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))).where(F.col("place") <= k)
