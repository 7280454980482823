"""Cases of the operators: design, evidence, screening, resolution, verification, tables, rendering, incremental work."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from veriloom.functions import export, text
from veriloom.operators import design, evidence, incremental, resolve, retrieval, screening, tables, verify
from veriloom.plans import packs, project, render
from veriloom.plans.cases import case, listed, numbered
from veriloom.streaming import watch

# ---- text and design by stated values


@case("id int, stem string", (1, "cat"), (2, "organ"), (3, "stud"), (4, "runn"), (5, "badan"), (6, "witamin"), (7, "effecti"), (8, "infecti"), (9, "is"))
def t06_stems(spark):
    """The first suffix in order that leaves three letters goes; seven letters at most."""
    return numbered(spark, "cat", "organization", "studies", "runnings", "badania", "witaminy", "effectives", "infections", "is").select("id", text.stem(F.col("x")).alias("stem"))


@case("id int, tokens string, lang string", (1, "vitamin|reduc|risk|infecti", "en"), (2, "witamin|zmniejs|ryzyk", "en"), (3, "", "en"))
def t07_tokens_by_value(spark):
    d = numbered(spark, "The vitamin reduces a risk of infections", "Witamina zmniejsza ryzyko", None)
    return d.select("id", listed(text.content_tokens("x")).alias("tokens"), text.detect_lang("x").alias("lang"))


@case("id int, design string, basis string",
      (1, "sr_ma", "pubtype:meta-analysis"), (2, "animal", "mesh:Animals (no Humans)"), (3, "rct", "pubtype:randomized controlled trial"), (4, "trial_registration", "kind:trial_registration"), (5, "narrative_review", "pubtype:review"),
      (6, "cohort", "title"), (7, "animal", "title"), (8, "preprint", "kind:preprint"), (9, "conference_paper", "kind:proceedings-article"), (10, "rct", "abstract"), (11, "journal_article", "default"), (12, "other", "default"), (13, "sr_ma", "openalex:systematic review"))
def r04_design_rungs(spark):
    """Every rung of the ladder: kind, publication type, study design, MeSH (P04), title, preprint, kind, abstract, default."""
    empty: list[str] = []
    rows = [
        (1, "", ["Meta-Analysis", "Journal Article"], empty, empty, "x", "", "BMJ", False), (2, "", ["Clinical Trial"], empty, ["Animals", "Mice"], "x", "", "BMJ", False), (3, "", ["Randomized Controlled Trial"], empty, empty, "x", "", "", False),
        (4, "trial_registration", empty, empty, empty, "A randomized controlled trial", "", "", False), (5, "", ["Review"], empty, ["Humans", "Animals"], "x", "", "", False), (6, "", empty, empty, empty, "A prospective study of diet", "", "", False),
        (7, "", empty, empty, empty, "Lesions in mice", "", "", False), (8, "", empty, empty, empty, "On x", "", "", True), (9, "proceedings-article", empty, empty, empty, "On x", "", "", False),
        (10, "", empty, empty, empty, "On x", "This double-blind study of 12", "", False), (11, "", empty, empty, empty, "On x", "", "BMJ", False), (12, "", empty, empty, empty, "On x", "", "", False), (13, "", empty, ["systematic review"], empty, "On x", "", "", False),
    ]
    d = spark.createDataFrame(rows, "id int, kind string, types array<string>, studies array<string>, mesh array<string>, title string, abstract string, venue string, pre boolean")
    found = design.infer_design(F.col("kind"), F.col("types"), F.col("studies"), F.col("mesh"), F.col("title"), F.col("abstract"), F.col("venue"), F.col("pre"), nfkc=False)
    return d.select("id", found.alias("d")).select("id", "d.design", "d.basis")


# ---- evidence


@case("id int, industry boolean", (1, True), (2, False), (3, True), (4, False), (5, False))
def p02_industry_funding(spark):
    """Marks of industry, unless denied; a denial is overridden by pay."""
    d = spark.createDataFrame([(1, "Funded by Pfizer Inc.", ""), (2, "Bayer", "The authors have no conflict of interest"), (3, "", "AB is an employee of Novartis; others declare no interests"), (4, "National Science Centre", ""), (5, None, None)], "id int, funding string, coi string")
    return d.select("id", evidence.industry_funded(F.col("funding"), F.col("coi")).alias("industry"))


@case("id int, flags string", (1, "RETRACTED|expression of concern"), (2, "preprint → published as 10.1/x"), (3, "not human|industry funding/COI"), (4, "registration only (RECRUITING, results posted)"), (5, "low-visibility venue"), (6, ""), (7, "corrected"))
def p03_flags(spark):
    """Eight rules; a venue that MEDLINE indexes is exempt from the last."""
    shape = "id int, is_retracted boolean, updates array<struct<type: string, label: string>>, is_preprint boolean, design string, published_version string, funding string, coi string, trial_status string, has_results boolean, listed_in array<string>, in_doaj boolean, core boolean, source_type string, medline boolean"
    none: list = []
    rows = [
        (1, True, [("correspondence", "Expression of Concern")], False, "rct", "", "", "", "", False, none, None, None, "journal", False), (2, False, none, True, "preprint", "10.1/x", "", "", "", False, none, False, False, "", False),
        (3, False, none, False, "animal", "", "Roche", "", "", False, none, True, None, "journal", False), (4, False, none, False, "trial_registration", "", "", "", "RECRUITING", True, none, False, False, "", False),
        (5, False, none, False, "rct", "", "", "", "", False, none, False, False, "journal", False), (6, False, none, False, "rct", "", "", "", "", False, none, False, False, "journal", True), (7, False, [("erratum", "")], False, "rct", "", "", "", "", False, ["x"], False, False, "journal", False),
    ]
    d = spark.createDataFrame(rows, shape)
    return d.select("id", listed(evidence.flags({c: F.col(c) for c in d.columns})).alias("flags"))


_SAID = ("SMD -0.34 (95% CI -0.68, -0.00; GRADE: very low quality of evidence)", "the available evidence is of poor quality and likely to be biased", "Certainty of evidence was evaluated using GRADE. Studies at high risk of bias were excluded.", "10 studies; low‐certainty evidence), but", "The body of evidence was assessed as being of high quality", "moderate-certainty evidence", "There was no serious risk of bias", "the certainty of the evidence was judged as moderate", "bardzo niska jakość dowodów", "")


@case("id int, level int", (1, 0), (2, 1), (3, None), (4, 1), (5, 3), (6, 2), (7, None), (8, 2), (9, 0), (10, None))
def p08_reported_certainty(spark):
    """What texts say of the certainty of their evidence, the lowest level first."""
    return numbered(spark, *_SAID).select("id", evidence.reported_certainty("x").alias("level"))


@case("id int, level int", (1, 1), (2, 2), (3, 1), (4, None))
def p09_certainty_near(spark):
    """The certainty that the sentence around a quote states."""
    abstract = "A may result in a slight reduction in visits (RR 0.95; low‐certainty evidence). It does not reduce costs (moderate‐certainty evidence). B may not change deaths (very low‐certainty evidence). We found low‐certainty evidence that A may slightly reduce the proportion with visits."
    d = numbered(spark, "may result in a slight reduction in visits", "does not reduce costs", "A may slightly reduce the proportion", "stands nowhere")
    return d.select("id", evidence.certainty_near(F.col("x"), F.lit(abstract)).alias("level"))


@case("id int, label string, estimate double, low double, high double", (1, "OR", 0.94, 0.88, 1.0), (2, None, None, None, None), (3, None, None, None, None), (4, "mean difference", -1.2, -2.0, -0.4), (5, "RR", 0.75, 0.6, 0.9))
def v11_main_estimate(spark):
    """The first estimate within its interval after the heading of the results."""
    d = numbered(
        spark,
        "Background: A 2021 meta-analysis found a protective effect (odds ratio [OR] 0.92, 95% CI 0.86 to 0.99). Findings: For the primary comparison the intervention did not significantly affect overall risk (OR 0.94, 95% CI 0.88 to 1.00, P=0.057). Daily dosing was protective (OR 0.84, 0.73 to 0.97).",
        "We found OR 0.80 (0.70 to 0.90).",
        "Results: patients took 2 or 3 doses or 4.5 or 6.1 to 7.2 tablets.",
        "METHODS We did. RESULTS The mean difference was -1.2 (95% CI, -2.0 to -0.4) points.",
        "Results: OR 3.0 (1.0-2.0) was dropped, RR 0.75 (95% CI 0.60–0.90) stayed.",
    )
    return d.select("id", evidence.main_estimate("x").alias("e")).select("id", "e.label", "e.estimate", "e.low", "e.high")


@case("key string, weight double", ("a", 1.0), ("b", 0.85), ("c", 0.0), ("d", 0.28), ("e", 0.5), ("f", 0.3), ("g", 0.1))
def g03_weights_by_rule(spark):
    """Medicine's weights: a top venue up to one, a preprint of another design, a concern, a retraction, an unknown design."""
    rows = [("a", "sr_ma", False, False, "The Lancet", False), ("b", "rct", False, False, "Some Journal", False), ("c", "rct", True, False, "", False), ("d", "journal_article", False, True, "", False), ("e", "rct", False, False, "The Lancet", True), ("f", "preprint", False, True, "", False), ("g", "no such", False, False, "", False)]
    combined = packs.combined("medicine")
    w = evidence.with_design_weights(spark.createDataFrame(rows, "key string, design string, is_retracted boolean, is_preprint boolean, venue string, concern boolean"), combined)
    return w.select("key", evidence.weight(F.col("design_weight"), F.col("is_retracted"), F.col("is_preprint"), F.col("design"), F.col("venue"), F.col("concern"), ["Lancet"]).alias("weight"))


_WORKS = "key string, design string, is_retracted boolean, is_preprint boolean, abstract string, venue string, concern boolean, funding string, coi string"


@case("claim_id string, n long, for_w double, against_w double, mixed_w double, consensus double, label string, certainty string",
      ("C1", 2, 1.85, 0.0, 0.0, 1.0, "support (few studies)", "low"), ("C2", 2, 0.85, 0.08, 0.0, 0.913978, "support (few studies)", "moderate"), ("C3", 1, 0.0, 0.0, 0.3, 0.5, "mixed / inconclusive", "very low"), ("C4", 0, 0.0, 0.0, 0.0, None, "no evidence", "very low"), ("C5", 0, 0.0, 0.0, 0.0, None, "no evidence", "very low"))
def g02_consensus_by_rule(spark):
    """Claims by weighted votes: the first stance of a key counts (W03), retracted works don't, a review's own appraisal is the ceiling; claims without evidence stay."""
    works = spark.createDataFrame([(k, d, r, p, a, "", False, "", "") for k, d, r, p, a in (("a", "sr_ma", False, False, "low-certainty evidence of benefit"), ("b", "rct", False, False, ""), ("c", "rct", True, False, ""), ("d", "animal", False, False, ""), ("e", "preprint", False, True, ""))], _WORKS)
    rows = [("C1", 1, "a", "for"), ("C1", 2, "b", "for"), ("C1", 3, "c", "against"), ("C1", 4, "a", "against"), ("C2", 5, "b", "for"), ("C2", 6, "d", "against"), ("C3", 7, "e", "mixed"), ("C4", 8, "c", "for"), ("C4", 9, "unknown", "for")]
    ev = spark.createDataFrame([(*r, "", 0.9, "") for r in rows], "claim_id string, id long, key string, stance string, quote string, verified double, effect string")
    claims = spark.createDataFrame([(f"C{k}",) for k in range(1, 6)], "claim_id string")
    s = evidence.claim_summary(ev, works, packs.combined("medicine"), claims)
    return s.select("claim_id", "n", "for_w", "against_w", "mixed_w", F.round("consensus", 6).alias("consensus"), "label", "certainty")


# ---- packs, plan


@case("id int, pack string, score double", (1, "medicine", 3.0), (2, "general", 1.0), (3, "physics", 2.0), (4, "medicine", 3.0))
def g05_detect_questions(spark):
    """Questions by the packs' keywords at the beginnings of words (P05); none: general. The last has the services' fields of research too: three times their share."""
    d = spark.createDataFrame([(1, "Does vitamin D supplementation reduce the risk of flu?", []), (2, "Why is the sky blue?", []), (3, "Is dark matter a quantum effect?", []), (4, "Which vitamin?", ["Medicine", "Nursing", "Mathematics"])], "id int, q string, fields array<string>")
    own = {n: p for n, p in packs.builtin().items() if n in ("medicine", "physics", "general")}
    return packs.detect(d, "q", own, fields="fields")


@case("what string, found string", ("connectors", "pubmed|europepmc|openalex|clinicaltrials|crossref"), ("causal", "guideline|rct|sr_ma"), ("weight of cohort", "0.5"), ("grade of dataset", "very low"), ("since", "2000"), ("per query", "60"), ("style", "vancouver"), ("first fields", "design|population|n"))
def g04_combined_packs(spark):
    """Two packs together: connectors in order, the best weight, causal designs united (U06), the earliest year, the most records, the first style."""
    c = packs.combined("medicine", "psychology")
    rows = [("connectors", "|".join(c.connectors())), ("causal", "|".join(sorted(c.causal()))), ("weight of cohort", str(c.weight("cohort"))), ("grade of dataset", c.grade("dataset")), ("since", str(c.since())), ("per query", str(c.per_query())), ("style", c.style()), ("first fields", "|".join(c.fields()[:3]))]
    return spark.createDataFrame(rows, "what string, found string")


@case("question string, lang string, packs string, since int, subq string, queries string", ("Does it work?", "en", "medicine", 2005, "SQ1", "a|b"), ("Does it work?", "en", "medicine", 2005, "X", ""))
def s48_plan_file(spark):
    """A plan's TOML; its first year is its packs' unless stated."""
    path = os.path.join(tempfile.mkdtemp(prefix="veriloom-case-"), "plan.toml")
    render.write('[question]\ntext = "Does it work?"\npacks = ["medicine"]\n[[subq]]\ntext = "first"\nqueries = ["a", "b"]\n[[subq]]\nid = "X"\n', path)
    p = project.load_plan(path)
    return spark.createDataFrame([(p.question, p.lang, "|".join(p.packs), p.first_year(), s["id"], "|".join(s["queries"])) for s in p.subqs], "question string, lang string, packs string, since int, subq string, queries string")


@case("name string, weight double, venues string, pack_count int", ("mine", 0.7, "Nature", 11))
def s47_pack_files(spark):
    """Built-in packs and a file's pack on top."""
    path = os.path.join(tempfile.mkdtemp(prefix="veriloom-case-"), "mine.toml")
    render.write('name = "mine"\ntop_venues = ["Nature"]\n[weight]\nrct = 0.7\n', path)
    known = packs.load([path])
    p = known["mine"]
    return spark.createDataFrame([(p.name, p.weight["rct"], "|".join(p.top_venues), len(known))], "name string, weight double, venues string, pack_count int")


# ---- screening and status


@case("key string, reason string", ("a", "retracted"), ("b", "published before 2000"), ("c", "design excluded by pack: editorial"), ("d", "not a research item (erratum)"), ("e", "language ger not in criteria"), ("f", "superseded by published version @g"))
def p01_every_rule(spark):
    """The ladder's rules, one work each; preprints whose published version the library has (J06); what is not new stays."""
    rows = [("a", "new", True, 1990, "rct", "", "en", False, "", ""), ("b", "new", False, 1999, "rct", "", "", False, "", ""), ("c", "new", False, 2010, "editorial", "", "en", False, "", ""), ("d", "new", False, 2010, "rct", "erratum", "en", False, "", ""), ("e", "new", False, 2010, "rct", "", "ger", False, "", ""), ("f", "new", False, 2010, "preprint", "", "eng", True, "https://doi.org/10.1/G", ""), ("g", "ta_included", True, 2011, "rct", "", "en", False, "", "10.1/g"), ("h", "new", False, None, "rct", "", "", False, "", "")]
    d = spark.createDataFrame(rows, "key string, status string, is_retracted boolean, year int, design string, kind string, language string, is_preprint boolean, published_version string, doi string")
    return screening.auto_screen(d, since=2000, languages=["en"], exclude_designs=["editorial"])


@case("rule string, n long", ("language de not in criteria", 1), ("retracted", 2), ("design excluded by pack", 2))
def g08_reason_counts(spark):
    return screening.reason_counts(numbered(spark, "retracted", "retracted", "design excluded by pack: editorial", "design excluded by pack: letter", "language de not in criteria").select(F.col("x").alias("reason")))


@case("key string, decision string, status string", ("a", "include", "ta_included"), ("b", "exclude", "ft_excluded"), ("c", "maybe", "maybe"), ("d", "exclude", "auto_excluded"), ("e", "not_retrieved", "not_retrieved"))
def z05_decision_log(spark):
    """The append-only log to statuses: the last decision of a key counts, by the stream's running state and by the table."""
    log = spark.createDataFrame([("a", "ta", "exclude", 1), ("a", "ta", "include", 5), ("b", "ta", "include", 2), ("b", "ft", "exclude", 6), ("c", "ta", "maybe", 3), ("d", "auto", "exclude", 4), ("e", "ft", "not_retrieved", 7)], "key string, stage string, decision string, id int").withColumn("reason", F.lit(""))
    last = screening.latest_decisions(log)
    same = watch.status_stream(log).select("key", F.col("decision").alias("running"))
    return last.join(same, "key").where("decision = running").select("key", "decision", screening.status_of(F.col("stage"), F.col("decision")).alias("status"))


@case("screened int, step string", (0, "search"), (3, "screen"), (2, "search"), (4, "fetch"), (5, "extract"))
def g13_next_step(spark):
    """What to do next, by the flow's counts."""
    d = spark.createDataFrame([(0, 0, 0, 0, 0), (3, 1, 2, 2, 2), (2, 0, 0, 0, 0), (4, 0, 2, 3, 1), (5, 0, 2, 2, 2)], "screened int, awaiting int, included int, sought int, full_text int")
    return screening.next_step(d).select("screened", F.col("next_step").alias("step"))


@case("identified long, duplicates long, screened long, auto_excluded long, awaiting long, sought long, full_text long, not_retrieved long, included long, included_fulltext long", (60, 56, 6, 1, 1, 3, 2, 1, 2, 1))
def g01_flow_by_rule(spark):
    """The funnel (G09): failed and watch runs don't count; texts that were sought but not found."""
    works = spark.createDataFrame([("a", "ta_included", "search"), ("b", "ft_included", "search"), ("c", "ft_excluded", "search"), ("d", "auto_excluded", "search"), ("e", "new", "manual"), ("f", "ta_excluded", "linked")], "key string, status string, origin string")
    searches = spark.createDataFrame([("x", 60, "", "r1"), ("y", 5, "timeout", "r1"), ("x", 9, "", "watch")], "connector string, returned int, error string, run string")
    return screening.flow_counts(works, searches, spark.createDataFrame([("b",), ("c",)], "key string"))


@case("id int, relevance double", (1, 1.0), (2, 0.0), (3, 0.2))
def g06_relevance(spark):
    """The best overlap of any target with a work's text."""
    d = numbered(spark, "vitamin prevents infection", "bridges", "infection of plants, soil").withColumn("t", F.lit("vitamin prevents infection"))
    first = screening.relevance(F.col("x"), [F.col("t"), F.lit("other")], nfkc=False)
    second = screening.relevance(F.col("x"), [F.lit("infection zzz yyy xxx")], nfkc=False)
    return d.select("id", F.round(F.when(F.col("id") == 3, second).otherwise(first), 2).alias("relevance"))


# ---- resolution


@case("work int, key string", (1, "k_doi"), (2, "k_title"))
def j02_lookup_existing(spark):
    """The first known identifier, in order, decides."""
    ids = spark.createDataFrame([(1, "title", "t", 8), (1, "doi", "d", 0), (2, "title", "t", 8), (2, "doi", "unknown", 0), (3, "pmid", "9", 1)], "work int, kind string, value string, prio int")
    known = spark.createDataFrame([("doi", "d", "k_doi"), ("title", "t", "k_title")], "kind string, value string, key string")
    return resolve.lookup_existing(ids, known)


@case("old string, current string", ("a", "d"), ("b", "d"), ("c", "d"), ("x", "y"), *[(f"n{k:02}", "n40") for k in range(40)])
def r06_rename_chains(spark):
    """Keys followed to the end of their renames, chains of forty too."""
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), *[(f"n{k:02}", f"n{k + 1:02}") for k in range(40)]]
    return resolve.rename_chain(spark.createDataFrame(rows, "old string, new string"))


@case("place string, key string, n int", ("cells", "new", 1), ("cells", "kept", 2), ("hits", "new", 3))
def r05_rekeyed(spark):
    """A rename goes through all tables, chains at once."""
    shape = "key string, n int"
    out = resolve.rekeyed({"cells": spark.createDataFrame([("old", 1), ("kept", 2)], shape), "hits": spark.createDataFrame([("mid", 3)], shape)}, spark.createDataFrame([("old", "mid"), ("mid", "new")], "old string, new string"))
    return out["cells"].withColumn("place", F.lit("cells")).unionByName(out["hits"].withColumn("place", F.lit("hits")))


@case("kind string, value string, key string", ("doi", "d", "first"), ("pmid", "1", "only"))
def r07_id_index(spark):
    return resolve.index_ids(spark.createDataFrame([("doi", "d", "late", 5), ("doi", "d", "first", 2), ("pmid", "1", "only", 3)], "kind string, value string, key string, arrival int"))


@case("key string, title string, year int, sources string, old string", ("smith2019vitamin", "Vitamin D", 2019, "a|b", None), ("jones2020", "Other", 2020, "c", None), ("smith2019vitamina", "Third", 2021, "d", None), ("real2001", "T", 2001, "e|f", "anonnd"))
def r02_upsert(spark):
    """Arrivals join works by their identifiers or get new keys; an unreferenced work whose base changed gets a new key (R05); sources are united, empty fields filled."""
    shape = "key string, base string, title string, year int, sources array<string>"
    library = spark.createDataFrame([("smith2019vitamin", "smith2019vitamin", "Vitamin D", None, ["a"]), ("anonnd", "anonnd", "T", None, ["e"])], shape)
    index = spark.createDataFrame([("doi", "10.1/a", "smith2019vitamin"), ("doi", "10.1/t", "anonnd")], "kind string, value string, key string")
    arrivals = spark.createDataFrame([(1, "smith2019vitamin", "Other title", 2019, ["b"]), (2, "jones2020", "Other", 2020, ["c"]), (3, "smith2019vitamin", "Third", 2021, ["d"]), (4, "real2001", "", 2001, ["f"])], "work long, base string, title string, year int, sources array<string>")
    ids = spark.createDataFrame([(1, "doi", "10.1/a", 0), (2, "doi", "10.1/b", 0), (3, "doi", "10.1/c", 0), (4, "doi", "10.1/t", 0)], "work long, kind string, value string, prio int")
    done, _, renames = resolve.upsert_works(library, index, arrivals, ids, spark.createDataFrame([("smith2019vitamin",)], "key string"), lists=("sources",))
    return done.join(renames.withColumnRenamed("new", "key"), "key", "left").select("key", "title", "year", listed("sources").alias("sources"), "old")


# ---- verification


@case("draft string, claim_id string", ("d1", "C1"))
def u03_balance(spark):
    """Claims of which a draft cites the support alone: intersections and differences of key sets."""
    claims = spark.createDataFrame([("C1", ["a"], ["b"]), ("C2", ["a"], ["c"]), ("C3", ["z"], ["b"])], "claim_id string, keys_for array<string>, keys_against array<string>")
    return verify.balance_issues(claims, spark.createDataFrame([("d1", "a"), ("d1", "c"), ("d2", "a"), ("d2", "b"), ("d2", "c")], "draft string, key string"))


@case("draft string, subq string", ("d1", "SQ2"), ("d2", "SQ1"))
def v01_scope(spark):
    """Sub-questions that a draft leaves out, by its claims' sources or else its hits."""
    claims = spark.createDataFrame([("C1", "SQ1")], "claim_id string, subq string")
    ev = spark.createDataFrame([("C1", "a")], "claim_id string, key string")
    subqs = spark.createDataFrame([("SQ1",), ("SQ2",), ("SQ3",)], "subq string")
    hits = spark.createDataFrame([("SQ2", "b"), ("SQ1", "zz")], "subq string, key string")
    cited = spark.createDataFrame([("d1", "a"), ("d2", "b")], "draft string, key string")
    return verify.scope_issues(claims, ev, subqs, hits, cited, cited)


@case("draft string, key string, stated boolean", ("good", "rev", True), ("bad", "rev", False))
def v01_primary(spark):
    """A cited review's main result must be among the numbers that stand by it."""
    abstract = "Background: earlier review (OR 0.92, 95% CI 0.86 to 0.99). Findings: overall the intervention did not affect risk (OR 0.94, 95% CI 0.88 to 1.00). Children benefited (OR 0.74, 95% CI 0.60 to 0.92)."
    uses = spark.createDataFrame([("good", "rev", "OR 0.94 and 0.74"), ("bad", "rev", "OR 0.74 (95 %)"), ("none", "rev", "in 12 trials"), ("other", "rct", "OR 0.5")], "draft string, key string, said string").withColumn("numbers", text.numbers("said"))
    works = spark.createDataFrame([("rev", "sr_ma", abstract), ("rct", "rct", abstract)], "key string, design string, abstract string")
    return verify.primary_results(uses, works).select("draft", "key", "stated")


@case("draft string, research long, covered long, verified_rows long", ("d1", 3, 1, 2), ("d2", 1, 1, 2))
def j16_verified_share(spark):
    """How many of a draft's research sources have verified cells."""
    cells = spark.createDataFrame([("a", 0.9), ("a", 0.2), ("b", 0.5), ("x", 1.0)], "key string, verified double")
    cited = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d1", "c"), ("d1", "law"), ("d2", "a")], "draft string, key string")
    works = spark.createDataFrame([("a", "rct"), ("b", "rct"), ("c", "cohort"), ("law", "legislation")], "key string, design string")
    return verify.verified_share(cells, cited, works).select("draft", "research", "covered", F.col("rows").alias("verified_rows"))


def _project(spark, with_table: bool):
    sources = [("a", "ft_included", False, False, "", "sr_ma", "fulltext", "en", "Vitamin D supplementation reduced the risk of infection. The odds ratio was 0.88 with 10933 participants."), ("b", "new", True, False, "", "animal", "abstract", "en", "Mice had 45 % fewer lesions."), ("c", "ta_included", False, False, "", "rct", "fulltext", "en", "The trial found no effect of vitamin D on infection."), ("d", "ta_included", False, False, "", "rct", "fulltext", "en", "Vitamin D in winter was safe.")]
    s = spark.createDataFrame(sources, "key string, status string, is_retracted boolean, is_preprint boolean, published_version string, design string, depth string, lang string, text string")
    good = '# A\nVitamin D supplementation reduced the risk of infection, odds ratio 0.88 with 10933 participants [@a :: "reduced the risk of infection. The odds ratio was 0.88"].\n\nThe trial found no effect of vitamin D on infection [@c]. Vitamin D in winter was safe [@d].' + ("\n\n<!-- fr:table extraction -->" if with_table else "")
    bad = "# A\nVitamin D always prevents infection in 77 % of patients [@b]. A study of 900 patients showed effects. Unknown claim [@zzz]."
    drafts = spark.createDataFrame([("good", good), ("bad", bad)], "draft string, text string")
    works = spark.createDataFrame([("a", 2010, "sr_ma", "Results: OR 0.88 (95% CI 0.8 to 0.96)."), ("b", 2012, "animal", ""), ("c", 2014, "rct", ""), ("d", 2015, "rct", ""), ("n", 2020, "sr_ma", "")], "key string, year int, design string, abstract string")
    matrix = verify.Matrix(
        spark.createDataFrame([("C1", "SQ1")], "claim_id string, subq string"), spark.createDataFrame([("C1", "a"), ("C1", "c"), ("C1", "n")], "claim_id string, key string"),
        spark.createDataFrame([("C1", ["a", "n"], ["c"], [])], "claim_id string, keys_for array<string>, keys_against array<string>, keys_mixed array<string>"), works,
        spark.createDataFrame([("SQ1",)], "subq string"), spark.createDataFrame([], "subq string, key string"), spark.createDataFrame([("a", "n", 1.0), ("c", "n", 1.0)], "key string, field string, verified double"),
    )
    return verify.verify(drafts, s, ["rct", "sr_ma", "guideline"], matrix=matrix)


@case("draft string, severity string, kind string, n long",
      ("good", "note", "freshness", 1), ("bad", "hard", "integrity", 2), ("bad", "warn", "integrity", 1), ("bad", "error", "numbers", 1), ("bad", "warn", "numbers", 1), ("bad", "warn", "support", 1), ("bad", "warn", "coverage", 1), ("bad", "warn", "calibration", 3), ("bad", "warn", "scope", 1), ("bad", "note", "depth", 1))
def v01_issues(spark):
    """All that is found in a good and a bad draft (V02, V03, O06): integrity, numbers, support, coverage, calibration (P07), scope, freshness, depth. Unknown keys survive the join with the sources."""
    issues, _ = _project(spark, True)
    return issues.groupBy("draft", "severity", F.col("check").alias("kind")).agg(F.count("*").alias("n"))


@case("draft string, table_part double, balance double, passed boolean, band string, hard long", ("good", 1.0, 1.0, True, "verified", 0), ("bad", None, 0.5, False, "unreliable", 2))
def v01_scores(spark):
    """The score with all seven parts: the table covers two of three studies, one of two claims and sub-questions is left out by the bad draft."""
    _, scores = _project(spark, True)
    return scores.select("draft", F.col("part_evidence_table").alias("table_part"), F.col("part_balance_scope").alias("balance"), "passed", "band", "hard")


@case("draft string, table_part double", ("good", 0.0), ("bad", None))
def v01_no_table(spark):
    """Three research sources and no table in the draft: the part counts as nothing."""
    _, scores = _project(spark, False)
    return scores.select("draft", F.col("part_evidence_table").alias("table_part"))


@case("id int, causal boolean, absolute boolean, hedged boolean, animal boolean, empirical boolean", (1, True, False, False, False, True), (2, False, True, True, False, False), (3, False, False, False, True, True), (4, True, False, False, False, True))
def p07_sentence_classes(spark):
    d = numbered(spark, "Vitamin D reduces risk", "It is always possible, it may be", "Mice had higher rates", "Witamina zmniejsza ryzyko")
    return d.select("id", *[F.col("x").rlike(p).alias(n) for n, p in (("causal", verify.CAUSAL), ("absolute", verify.ABSOLUTE), ("hedged", verify.HEDGED), ("animal", verify.ANIMAL), ("empirical", verify.EMPIRICAL))])


@case("text string", ("good: 95/100 (verified)\n- [note] freshness (line 0): m",))
def v13_issue_report(spark):
    issues = spark.createDataFrame([("good", "note", "freshness", "m", 0, "", 1)], "draft string, severity string, check string, message string, line int, text string, rank int")
    scores = spark.createDataFrame([("good", 95.0, "verified", True)], "draft string, score double, band string, passed boolean")
    return spark.createDataFrame([(render.issue_report(issues, scores, "good"),)], "text string")


@case("draft string, style double", ("a", 3.0), ("b", None))
def v12_style_scorer(spark):
    """A scorer of one's own; where it fails, there is no score."""
    return verify.style_scores(spark.createDataFrame([("a", "one two three"), ("b", "")], "draft string, text string"), lambda x: len(x.split()) or 1 / 0)


@case("key string, field string, verified double, loc string", ("a", "or", 1.0, "p. 2"), ("a", "n", 1.0, ""), ("a", "x", 0.3, "p. 1"))
def v09_written_cells(spark):
    """Cells as they are kept: nothing reported is verified, a quote without a place gets its page."""
    cells = spark.createDataFrame([("a", "or", "0.88", "odds ratio was 0.88 in all of the adults", ""), ("a", "n", "NR", "", ""), ("a", "x", "0.77", "odds ratio was 0.88 in all of the adults", "p. 1")], "key string, field string, value string, quote string, loc string")
    sources = spark.createDataFrame([("a", "Intro. The odds ratio was 0.88 in all of the adults.")], "key string, text string")
    pages = spark.createDataFrame([("a", 1, "p. 1", "Intro."), ("a", 2, "p. 2", "The odds ratio was 0.88 in all of the adults.")], "key string, page int, loc string, text string")
    return tables.written_cells(cells, sources, pages).select("key", "field", "verified", "loc")


# ---- retrieval


@case("key string, loc string, place int, body string", ("a", "abstract", 0, "A title. First. Second one."))
def v06_abstract_passages(spark):
    return retrieval.abstract_passages(spark.createDataFrame([("a", "A title.", "First. Second one."), ("b", "No abstract", "")], "key string, title string, abstract string")).select("key", "loc", "place", F.col("text").alias("body"))


@case("query_id int, id int, rank int", (1, 2, 1), (1, 1, 2))
def o03_find_by_rule(spark):
    """Two stages: BM25, equal beginnings once, ordered anew by overlap."""
    p = spark.createDataFrame([(1, "k1", "zebra words and common words"), (2, "k2", "rare zebra stripes"), (3, "k2", "rare zebra stripes"), (4, "k3", "nothing here")], "id int, key string, text string")
    q = spark.createDataFrame([(1, "rare zebra stripes")], "query_id int, query string")
    return retrieval.find(retrieval.PassageIndex(p), p, q, limit=3).select("query_id", "id", "rank")


# ---- tables and output


@case("key string, field string, place int, value string", ("a", "design", 0, "RCT"), ("a", "n", 1, ""), ("b", "design", 0, ""), ("b", "n", 1, "12"))
def n01_extraction_template(spark):
    cells = spark.createDataFrame([("a", "design", "cohort", 1), ("a", "design", "RCT", 2), ("b", "n", "12", 3)], "key string, field string, value string, id int").withColumns({"quote": F.lit(""), "loc": F.lit(""), "verified": F.lit(1.0)})
    return tables.extraction_template(spark.createDataFrame([("a",), ("b",)], "key string"), ["design", "n"], cells)


@case("place int, key string", (1, "c"), (2, "a"), (3, "b"), (4, "d"))
def o05_sources_order(spark):
    """Sources by weight, then year, both falling."""
    d = spark.createDataFrame([("a", "t", 2020, "rct", 0.85), ("b", "t", 2010, "rct", 0.85), ("c", "t", 2001, "sr_ma", 1.0), ("d", "t", None, "rct", 0.85)], "key string, title string, year int, design string, weight double")
    rows = [(k, r["key"]) for k, r in enumerate(tables.sources_table(d).collect(), 1)]  # four rows
    return spark.createDataFrame(rows, "place int, key string")


@case("n int, field string, key string, value string, quote string, loc string", (0, "A", "other", "", "", ""), (0, "B", "k", "5", "q", "p. 1"), (1, "A", "m", "text", "", ""))
def n06_custom_table(spark):
    spec = '{"title": "t", "columns": ["A", "B"], "rows": [{"key": "k", "cells": ["@other", "{\\"value\\": \\"5\\", \\"quote\\": \\"q\\", \\"loc\\": \\"p. 1\\"}"]}, {"key": "m", "cells": ["text"]}]}'
    found = tables.custom_cells(spark.createDataFrame([(1, spec)], "table_id int, spec string"))
    return found.select(F.col("row").alias("n"), F.col("column").alias("field"), "key", "value", "quote", "loc")


@case("key string, position int, use int, number int", ("a", 1, 1, 1), ("b", 2, 1, 2), ("a", 3, 2, 1), ("a", 9, 3, 1))
def w05_nth_uses(spark):
    """The how manieth use of a key each citation is, and the key's number by first appearance."""
    c = spark.createDataFrame([("d", "a", 3), ("d", "b", 2), ("d", "a", 1), ("d", "a", 9)], "draft string, key string, position int")
    return tables.nth_uses(c).join(tables.first_uses(c), ["draft", "key"]).select("key", "position", "use", "number")


@case("line int, issues string", (3, "error:x|warn:y"), (7, "note:z"))
def g12_grouped_lists(spark):
    d = spark.createDataFrame([(3, 2, "warn", "y"), (7, 1, "note", "z"), (3, 1, "error", "x")], "line int, rank int, severity string, message string")
    return tables.grouped_lists(d, "line", "rank").select("line", listed(F.transform("rows", lambda r: F.concat_ws(":", r["severity"], r["message"]))).alias("issues"))


def _text(spark, *parts: tuple[str, str]):
    return spark.createDataFrame(list(parts), "form string, made string")


@case("form string, made string",
      ("md", "**T**\n\n| key | n |\n| --- | --- |\n| a\\|b | 1 |"), ("csv", 'key,n,q\na|b,1,"said ""so"""\n'), ("json", '{"title": "T", "columns": ["key", "n"], "rows": [["a|b", "1"]]}'),
      ("latex", "\\begin{tabular}{ll}\nkey & n \\\\ \\hline\na|b & 1 \\\\\n\\end{tabular}"), ("html", '<table><caption>T</caption><tr><th>key</th><th>n</th></tr><tr><td title="said &quot;so&quot;">a|b</td><td title="said &quot;so&quot;">1</td></tr></table>'), ("file", "**T**\n\n| key | n |\n| --- | --- |\n| a\\|b | 1 |\n"))
def k01_table_forms(spark):
    """A table in five forms, with quotes as a column or as hints (K02), and as a file (K03); what needs escaping is."""
    df = spark.createDataFrame([("a|b", 1, 'said "so"')], "key string, n int, q string")
    made = [(f, render.table(df, f, "T", quotes="q")) for f in ("md", "csv", "json", "latex", "html")]
    path = os.path.join(tempfile.mkdtemp(prefix="veriloom-case-"), "t.md")
    render.write(made[0][1], path)
    with open(path, encoding="utf-8") as f:
        return _text(spark, *made, ("file", f.read()))


_ENTRY = "key string, design string, title string, authors array<string>, year int, venue string, volume string, issue string, pages string, doi string, url string, abstract string"


@case("form string, made string",
      ("bibtex", "@article{k1,\n  title = {T & t},\n  author = {Smith, Ann and Group},\n  year = {2020},\n  journal = {BMJ},\n  volume = {7},\n  pages = {1--9},\n  doi = {10.1/x}\n}"),
      ("ris", "TY  - JOUR\nAU  - Smith, Ann\nAU  - Group\nTI  - T & t\nPY  - 2020\nJO  - BMJ\nVL  - 7\nSP  - 1\nEP  - 9\nDO  - 10.1/x\nER  - \n"),
      ("csl", '{"id":"k1","type":"article-journal","title":"T & t","author":[{"family":"Smith","given":"Ann"},{"literal":"Group"}],"issued":{"date-parts":[[2020]]},"container-title":"BMJ","volume":"7","page":"1-9","DOI":"10.1/x"}'))
def k05_export_forms(spark):
    """One work as BibTeX (K04), RIS and CSL-JSON."""
    w = spark.createDataFrame([("k1", "rct", "T & t", ["Smith, Ann", "Group"], 2020, "BMJ", "7", "", "1-9", "10.1/X", "", "")], _ENTRY)
    pairs = F.array(*[F.struct(F.lit(n).alias("form"), c.alias("made")) for n, c in (("bibtex", export.bibtex()), ("ris", export.ris()), ("csl", export.csl_json()))])
    return w.select(F.explode(pairs).alias("p")).select("p.*")


@case("note string, body string", ("key=k1", "# T\nyear:: 2020\ndesign:: rct\ndoi:: 10.1/x\nAbs"), ("claim=C1", "# It works\nconsensus:: 0.9\ncertainty:: low\n- [[k1]] (for)"), ("index", "# Sources\n- [[k1]]\n# Claims\n- [[C1]]"))
def k07_vault(spark):
    """A vault: a note for each source and claim, and an index."""
    path = tempfile.mkdtemp(prefix="veriloom-case-")
    w = spark.createDataFrame([("k1", "rct", "T", [], 2020, "", "", "", "", "10.1/X", "", "Abs")], _ENTRY)
    claims = spark.createDataFrame([("C1", "It works", 0.9, "low", ["k1"], [], [])], "claim_id string, text string, consensus double, certainty string, keys_for array<string>, keys_against array<string>, keys_mixed array<string>")
    export.vault(w, path, claims)
    out = [("key=k1", "sources/key=k1"), ("claim=C1", "claims/claim=C1"), ("index", "index")]
    notes = None
    for name, at in out:
        one = spark.read.text(f"{path}/{at}", wholetext=True).select(F.lit(name).alias("note"), F.rtrim(F.col("value"), F.lit("\n")).alias("body"))
        notes = one if notes is None else notes.unionByName(one)
    return notes


@case("boxes int, identified string, included string", (9, "Identified: 30", "Included: 2"))
def k12_flow_svg(spark):
    svg = render.flow_svg({"identified": 30, "screened": 20, "included": 2, "full_text": 4})
    return spark.createDataFrame([(svg.count("<rect"), "Identified: 30" if "Identified: 30" in svg else "", "Included: 2" if "Included: 2" in svg else "")], "boxes int, identified string, included string")


@case("lines int, null_at double, log_scale boolean", (3, 442.1, True))
def k13_forest_svg(spark):
    """Two effects on a logarithmic axis; its null line at 1."""
    cells = spark.createDataFrame([("a", "effect", "OR 0.50 (0.25-0.99)", 1), ("b", "effect", "RR 0.80 (0.60-1.00)", 2), ("c", "effect", "unclear", 3)], "key string, field string, value string, id int").withColumns({"quote": F.lit(""), "loc": F.lit(""), "verified": F.lit(1.0)})
    rows = tables.forest_rows(cells)
    extent = tables.forest_range(rows).first().asDict()
    svg = render.forest_svg(rows, extent)
    return spark.createDataFrame([(svg.count("<line"), float(svg.split('x1="')[1].split('"')[0]), extent["log_scale"])], "lines int, null_at double, log_scale boolean").withColumn("null_at", F.round("null_at", 1))


@case("made string", ('{"decisions": [{"decision": "include", "key": "a", "reason": "", "stage": "ta"}], "included": ["a"], "searches": [{"connector": "x", "query": "q", "returned": 3}]}',))
def k14_lock(spark):
    s = spark.createDataFrame([("x", "q", 3)], "connector string, query string, returned int")
    d = spark.createDataFrame([("a", "ta", "include", "")], "key string, stage string, decision string, reason string")
    return spark.createDataFrame([(render.lock(s, d.select("key"), d),)], "made string")


@case("style string, made string",
      ("vancouver", "Claim [1]. Again [2, p. 3; 1].\n\n| t |\n\n## References\n\n1. Ref a\n2. Ref b\n"), ("apa", "Claim (Smith, 2019). Again (Brown, 2020, p. 3; Smith, 2019).\n\n| t |\n\n## References\n\n- Brown ref\n- Smith ref\n"))
def k09_rendered_draft(spark):
    """Citations as numbers by first appearance or as authors (N09), tables in their places (N07), the reference list in order."""
    draft = 'Claim [@a :: "q"]. Again [@b, p. 3; @a].\n\n<!-- fr:table sources -->'
    show = lambda spec: render.placeholder(spec, {"sources": lambda _: spark.createDataFrame([], "t string")}).split("\n")[0]
    one = render.render_draft(draft, {"a": "Ref a", "b": "Ref b"}, "vancouver", tables=show)
    two = render.render_draft(draft, {"a": "Smith ref", "b": "Brown ref"}, "apa", {"a": "Smith, 2019", "b": "Brown, 2020"}, show)
    return spark.createDataFrame([("vancouver", one), ("apa", two)], "style string, made string")


@case("contents string, lang string, heading boolean, listed boolean, mark string", ("intro|intro-2|pi-miennictwo", "pl", True, True, '<p><mark title="bad">S.</mark> T.</p>'))
def k10_article(spark):
    """An article page: contents with an anchor for each heading, the language, the reference list under its own name (I29, N10); sentences with issues marked."""
    import re

    page = render.article("A & b", "# Intro\nText [@a].\n\n# Intro\nMore **bold**.", {"a": "Ref a"}, lang="pl")
    marked = render.highlighted([{"line": 1, "sentence": "S."}, {"line": 2, "sentence": "T."}], {1: ["bad"]})
    row = ("|".join(re.findall(r'href="#([^"]+)"', page)), re.search(r'html lang="(\w+)"', page)[1], '<h1 id="intro">Intro</h1>' in page, "1. Ref a" in page, marked)
    return spark.createDataFrame([row], "contents string, lang string, heading boolean, listed boolean, mark string")


@case("sections int, title string", (2, "<title>R &lt;1&gt;</title>"))
def k11_report(spark):
    page = render.html_report("R <1>", {"Flow": "<p>x</p>", "Draft": "<p>y</p>"})
    return spark.createDataFrame([(page.count("<section"), page[page.index("<title>") : page.index("</title>") + 8])], "sections int, title string")


# ---- incremental work


@case("doc string, page int, body string", ("d", 1, "Intro"), ("d", 2, "Body"), ("d", 3, "End."), ("d", 5, "Appendix A"), ("e", 1, "References are cited."), ("e", 2, "More"))
def t23_cut_references(spark):
    """Reference lists go, from their heading in the second half of a document on; appendices stay."""
    pages = [("d", 1, "Intro"), ("d", 2, "Body"), ("d", 3, "End.\nReferences\n1. x"), ("d", 4, "2. y"), ("d", 5, "Appendix A"), ("e", 1, "References are cited."), ("e", 2, "More")]
    return incremental.cut_references(spark.createDataFrame(pages, "doc string, page int, text string")).select("doc", "page", F.trim(F.regexp_replace("text", r"\s+$", "")).alias("body"))


@case("id int, funding string, coi string", (1, "This work was paid for by the ministry of health.", "The authors have none to declare."), (2, "", ""))
def t24_statements_by_rule(spark):
    d = numbered(spark, "Body text here. Funding: This work was paid for by the ministry of health. Conflicts of interest: The authors have none to declare. References 1.", "nothing of the kind")
    return d.select("id", incremental.find_statements("x").alias("s")).select("id", F.trim("s.funding").alias("funding"), F.trim("s.coi").alias("coi"))


@case("seed string, key string, way string", ("s", "x", "back"), ("s", "z", "forward"), ("s", "q", "forward"))
def s07_both_ways(spark):
    """One hop back and forward."""
    return incremental.one_hop(spark.createDataFrame([("s", "x"), ("z", "s"), ("q", "s"), ("z", "q")], "src string, dst string"), spark.createDataFrame([("s",)], "key string"))


@case("key string, relevance double", ("n2", 0.9), ("n1", 0.3))
def o08_watch_report(spark):
    """New since the snapshot (U05, J13), still unscreened, relevant enough."""
    shape = "key string, status string, relevance double"
    now = spark.createDataFrame([("old", "new", 1.0), ("n1", "new", 0.3), ("n2", "new", 0.9), ("n3", "auto_excluded", 0.9), ("n4", "new", 0.1)], shape)
    return incremental.watch_report(now, now.where("key = 'old'")).select("key", "relevance")


@case("topic string, n long", ("Medicine", 2), ("Physics", 1))
def g14_field_counts(spark):
    return incremental.field_counts(spark.createDataFrame([(["Medicine", "Physics"],), (["Medicine"],), ([],)], "fields array<string>"))


@case("key string", ("c",), ("a",))
def s09_related_reviews(spark):
    return incremental.related_reviews(spark.createDataFrame([("a", "review", "2019-01", 2019), ("b", "article", "2021", 2021), ("c", "review", "2020-05", 2020), ("d", "review", "2010", 2010)], "key string, kind string, date string, year int"), since=2015, limit=2).select("key")


@case("key string", ("b",), ("c",))
def s51_works_where(spark):
    return incremental.works_where(spark.createDataFrame([("a", "new", "search", 1), ("b", "ta_included", "search", 2), ("c", "ft_included", "search", 3), ("d", "ta_included", "manual", 4)], "key string, status string, origin string, created int"), status=screening.INCLUDED, origin="search").select("key")


@case("key string, title string, doi string, year int", ("a", "kept", "10.1/a", 2001), ("b", "found", "10.1/b", 2002), ("c", "", "", None))
def j07_enrich_twice(spark):
    """Two lookups one after the other fill what is empty."""
    works = spark.createDataFrame([("a", "kept", "10.1/a", "", None), ("b", "", "10.1/b", "7", None), ("c", "", "", "", None)], "key string, title string, doi string, pmid string, year int")
    by_doi = spark.createDataFrame([("10.1/a", "other", 2001), ("10.1/b", "", 2002)], "doi string, title string, year int")
    by_pmid = spark.createDataFrame([("7", "found", 1999)], "pmid string, title string, year int")
    return incremental.enrich(works, [("doi", by_doi), ("pmid", by_pmid)]).select("key", "title", "doi", "year")
