import pytest
from pyspark.sql import functions as F

from veriloom.functions import identity
from veriloom.operators import design, evidence, incremental, resolve, retrieval, screening, tables, verify
from veriloom.plans import packs


def test_ids(one):
    assert one(identity.norm_doi(F.lit(" https://doi.org/10.1/AbC. "))) == "10.1/abc"
    for kind, raw, plain in (("pmcid", "123", "PMC123"), ("arxiv", "https://arxiv.org/abs/2101.00001v2", "2101.00001"), ("openalex", "https://openalex.org/w12", "W12"), ("pmid", "PMID: 99", "99")):
        assert one(identity.norm_id(F.lit(kind), F.lit(raw))) == plain
    assert one(identity.title_key(F.lit("Vitamin D for é infections: a meta-analysis of trials"))) == "vitamin for infections meta analysis trials"
    assert one(identity.title_key(F.lit("Too short"))) == ""


@pytest.mark.parametrize(("name", "turned"), [("Jan van der Berg", "van der Berg, Jan"), ("Smith JR", "Smith JR"), ("Xu, Chen", "Xu, Chen"), ("Martin Luther King Jr.", "King, Martin Luther"), ("World Health Organization", "World Health Organization"), ("Plato", "Plato"), ("", "")])
def test_display_names(one, name, turned):
    assert one(identity.display_name(F.lit(name))) == turned


def test_keys_and_references(one, spark):
    assert one(identity.key_base(F.lit("Smith, Ann"), F.lit(2020), F.lit("The effect of vitamin D"), F.lit("BMJ"))) == "smith2020vitamin"
    bases = spark.createDataFrame([(1, "a"), (2, "a"), (3, "aa"), (4, "a")], "work long, base string")
    keys = {r["work"]: r["key"] for r in resolve.unique_keys(bases).collect()}
    assert len(set(keys.values())) == 4 and keys[1] == "a" and keys[3] == "aa"
    authors = F.array(F.lit("Smith, Ann B."), F.lit("Xu, Chen"))
    none = F.lit("")
    ref = lambda style: one(identity.reference(style, authors, F.lit(2020), F.lit("T."), F.lit("BMJ"), F.lit("7"), F.lit("2"), F.lit("1-9"), F.lit("10.1/x"), none, none, none, F.lit(False)))
    assert ref("vancouver") == "Smith AB, Xu C. T. BMJ. 2020;7(2):1-9. doi:10.1/x."
    assert ref("apa") == "Smith, A. B., & Xu, C. (2020). T. *BMJ*, *7*(2), 1-9. https://doi.org/10.1/x"
    assert ref("ieee") == 'A. B. Smith and C. Xu, "T," *BMJ*, vol. 7, no. 2, pp. 1-9, 2020, doi:10.1/x.'
    assert ref("acs") == "Smith AB, Xu C. T. *BMJ* **2020**, *7*, 1-9. doi:10.1/x."
    assert ref("harvard") == "Smith, A. B. and Xu, C. (2020) 'T', *BMJ*, 7(2), pp. 1-9. https://doi.org/10.1/x."
    assert ref("chicago") == 'Smith, A. B. and Xu, C. 2020. "T." *BMJ* 7(2): 1-9. https://doi.org/10.1/x.'
    effect = one(identity.parse_effect(F.lit("OR 0.88 (95% CI 0.81-0.96)")))
    assert (effect["metric"], effect["estimate"], effect["low"], effect["high"]) == ("OR", 0.88, 0.81, 0.96)
    assert one(identity.parse_effect(F.lit("OR 0.98 (0.81-0.96)"))) is None
    assert one(identity.resolve_reference(F.lit("doi:10.1/X")))["value"] == "10.1/x"


def test_design(spark):
    rows = [("", ["Meta-Analysis"], [], "t"), ("", ["Randomized Controlled Trial"], ["Animals", "Mice"], "t"), ("", ["Observational Study"], ["Animals"], "t"), ("trial_registration", [], [], "t"), ("", [], [], "Vitamin D in mice lungs"), ("", [], [], "A randomised, double-blind trial"), ("book", [], [], "t"), ("", [], [], "t")]
    df = spark.createDataFrame(rows, "kind string, types array<string>, mesh array<string>, title string")
    empty = F.array().cast("array<string>")
    got = [r["d"]["design"] for r in df.select(design.infer_design(F.col("kind"), F.col("types"), empty, F.col("mesh"), F.col("title"), F.lit(None).cast("string"), F.lit("J"), F.lit(False)).alias("d")).collect()]
    assert got == ["sr_ma", "rct", "animal", "trial_registration", "animal", "rct", "book", "journal_article"]


def _works(spark):
    rows = [("a", "sr_ma", False, False, "low-certainty evidence of benefit"), ("b", "rct", False, False, ""), ("c", "rct", True, False, ""), ("d", "animal", False, False, ""), ("e", "preprint", False, True, "")]
    return spark.createDataFrame([(*r, "", False, "", "") for r in rows], "key string, design string, is_retracted boolean, is_preprint boolean, abstract string, venue string, concern boolean, funding string, coi string")


def test_consensus_ladder(spark):
    ev = [("C1", 1, "a", "for"), ("C1", 2, "b", "for"), ("C1", 3, "c", "against"), ("C1", 4, "a", "against"), ("C2", 5, "b", "for"), ("C2", 6, "d", "against"), ("C3", 7, "e", "mixed"), ("C4", 8, "c", "for")]
    rows = spark.createDataFrame([(*e, "", 0.9, "") for e in ev], "claim_id string, id long, key string, stance string, quote string, verified double, effect string")
    claims = spark.createDataFrame([(f"C{k}",) for k in range(1, 6)], "claim_id string")
    got = {r["claim_id"]: r for r in evidence.claim_summary(rows, _works(spark), packs.combined("medicine"), claims).collect()}
    assert got["C1"]["n"] == 2 and got["C1"]["consensus"] == 1.0 and got["C1"]["label"] == "support (few studies)"
    assert got["C1"]["certainty"] == "low"  # the review's own appraisal is the ceiling
    assert got["C2"]["label"] == "support (few studies)" and got["C2"]["consensus"] > 0.8
    assert got["C3"]["certainty"] == "very low" and got["C3"]["label"] == "mixed / inconclusive" and got["C3"]["consensus"] == 0.5
    assert got["C4"]["label"] == "no evidence" and got["C5"]["label"] == "no evidence"


@pytest.mark.parametrize(("said", "level"), [("GRADE: very low quality of evidence", 0), ("the certainty of evidence was rated as low", 1), ("moderate-certainty evidence", 2), ("we excluded studies at high risk of bias", None), ("high‐certainty evidence", 3)])
def test_reported_certainty(one, said, level):
    assert one(evidence.reported_certainty(F.lit(said))) == level


def test_certainty_near(one):
    a = F.lit("Deaths fell. We found low-certainty evidence that infections fell by 5. High-certainty evidence of harm.")
    assert one(evidence.certainty_near(F.lit("infections fell by 5"), a)) == 1
    assert one(evidence.certainty_near(F.lit("Deaths fell"), a)) is None and one(evidence.certainty_near(F.lit("absent"), a)) is None


def test_main_estimate(one):
    e = one(evidence.main_estimate(F.lit("Background: OR 0.50 (95% CI 0.4 to 0.6). Results: The pooled odds ratio 0.94 (95% CI 0.88 to 1.00) was found.")))
    assert (e["estimate"], e["low"], e["high"]) == (0.94, 0.88, 1.0)
    assert one(evidence.main_estimate(F.lit("OR 0.50 (95% CI 0.4 to 0.6)."))) is None


def test_industry(one):
    assert one(evidence.industry_funded(F.lit("Funded by Pfizer"), F.lit("")))
    assert not one(evidence.industry_funded(F.lit("no funding"), F.lit("none declared; pharma")))
    assert one(evidence.industry_funded(F.lit("no competing interests; employee of Bayer"), F.lit("")))


def test_screening(spark):
    rows = [("a", "new", True, 2020, "rct", "", "en", False, "", "10.1/a"), ("b", "new", False, 1990, "rct", "", "en", False, "", ""), ("c", "new", False, None, "rct", "", "ger", False, "", ""), ("d", "new", False, 2020, "preprint", "", "eng", True, "10.1/A", ""), ("e", "new", False, 2020, "rct", "erratum", "en", False, "", ""), ("f", "ta_included", True, 1900, "rct", "", "xx", False, "", ""), ("g", "new", False, 2021, "rct", "", "", False, "", "")]
    df = spark.createDataFrame(rows, "key string, status string, is_retracted boolean, year int, design string, kind string, language string, is_preprint boolean, published_version string, doi string")
    got = {r["key"]: r["reason"] for r in screening.auto_screen(df, since=2000, languages=["en"]).collect()}
    assert got == {"a": "retracted", "b": "published before 2000", "c": "language ger not in criteria", "d": "superseded by published version @a", "e": "not a research item (erratum)"}


def test_resolution_modes(spark):
    ids = [(1, "doi", "x", 0), (2, "pmid", "9", 1), (3, "doi", "x", 0), (3, "pmid", "9", 1), (4, "doi", "z", 0)]
    df = spark.createDataFrame(ids, "work long, kind string, value string, prio int")
    groups = resolve.canonical_groups(df)
    assert {r["work"]: r["group"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r["work"]: r["key_work"] for r in resolve.first_hit_groups(df, groups).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_long_chain_resolves(spark):
    ids = [(k, "l", str(k), 0) for k in range(60)] + [(k + 1, "l", str(k), 0) for k in range(60)]
    groups = resolve.canonical_groups(spark.createDataFrame(ids, "work long, kind string, value string, prio int"))
    assert {r["group"] for r in groups.collect()} == {0}


def test_merge(spark):
    rows = [(1, 1, "", ["a"], False, 3, "short"), (1, 2, "t", ["b", "a"], True, 5, "much longer")]
    df = spark.createDataFrame(rows, "group long, work long, title string, authors array<string>, retracted boolean, cited int, abstract string")
    r = resolve.merge_works(df, lists=("authors",), flags=("retracted",), largest=("cited",), longest=("abstract",)).first()
    assert (r["title"], r["authors"], r["retracted"], r["cited"], r["abstract"], r["records"]) == ("t", ["a", "b"], True, 5, "much longer", 2)


def test_bm25_prefers_rare_terms(spark):
    passages = spark.createDataFrame([(1, "common common words here"), (2, "rare zebra words"), (3, "common words")], "id long, text string")
    q = spark.createDataFrame([(7, "zebra words")], "query_id long, query string")
    hits = retrieval.PassageIndex(passages).search(q, 2).orderBy("place").collect()
    assert [h["id"] for h in hits][0] == 2 and len(hits) == 2


def test_cells(spark):
    sources = spark.createDataFrame([("a", "The odds ratio was 0.88 in all of the adults.")], "key string, text string")
    cells = spark.createDataFrame([("a", "0.88", "odds ratio was 0.88 in all of the adults"), ("a", "0.77", "odds ratio was 0.88 in all of the adults"), ("a", "NR", ""), ("b", "1.5", "x"), ("a", "0.88", "odds ratio")], "key string, value string, quote string")
    got = [(r["score"], r["problem"]) for r in tables.check_cells(cells, sources).collect()]
    assert sorted(got) == sorted([(1.0, ""), (0.3, "number not in source"), (1.0, ""), (0.0, "unknown source"), (0.8, "number not in quote")])


def test_custom_table(spark):
    spec = '{"title": "t", "columns": ["A", "B"], "rows": [{"key": "k", "cells": ["@other", "{\\"value\\": \\"5\\", \\"quote\\": \\"q\\"}"]}]}'
    rows = tables.custom_cells(spark.createDataFrame([(1, spec)], "table_id long, spec string")).orderBy("column").collect()
    assert [(r["column"], r["key"], r["value"], r["quote"]) for r in rows] == [("A", "other", "", ""), ("B", "k", "5", "q")]


def test_running_lines_and_references(spark):
    lines = [("d", p, k, t) for p in (1, 2, 3) for k, t in enumerate([f"Journal of X {p}", f"text {p} unique words {'abc'[p - 1]}"])]
    left = incremental.running_lines(spark.createDataFrame(lines, "doc string, page int, place int, line string")).collect()
    assert len(left) == 3 and all("unique" in r["line"] for r in left)
    pages = spark.createDataFrame([("d", 1, "Intro"), ("d", 2, "Body"), ("d", 3, "End.\nReferences\n1. x"), ("d", 4, "2. y"), ("d", 5, "Appendix A")], "doc string, page int, text string")
    assert [(r["page"], r["text"].strip()) for r in incremental.cut_references(pages).orderBy("page").collect()] == [(1, "Intro"), (2, "Body"), (3, "End."), (5, "Appendix A")]


def _sources(spark):
    rows = [("a", "ft_included", False, False, "", "sr_ma", "fulltext", "en", "Vitamin D supplementation reduced the risk of infection. The odds ratio was 0.88 with 10933 participants."), ("b", "new", True, False, "", "animal", "abstract", "en", "Mice had 45 % fewer lesions.")]
    return spark.createDataFrame(rows, "key string, status string, is_retracted boolean, is_preprint boolean, published_version string, design string, depth string, lang string, text string")


def test_good_draft_passes_and_bad_one_fails(spark):
    good = '# A\nVitamin D supplementation reduced the risk of infection, odds ratio 0.88 with 10933 participants [@a :: "reduced the risk of infection. The odds ratio was 0.88"].'
    bad = "# A\nVitamin D always prevents infection in 77 % of patients [@b]. A study of 900 patients showed effects. Unknown claim [@zzz]."
    issues, scores = verify.verify(spark.createDataFrame([("good", good), ("bad", bad)], "draft string, text string"), _sources(spark), ["rct", "sr_ma", "guideline"])
    got = {r["draft"]: r for r in scores.collect()}
    assert got["good"]["score"] >= 90 and got["good"]["passed"]
    assert got["bad"]["score"] < 60 and not got["bad"]["passed"]
    found = {(r["check"], r["severity"]) for r in issues.where("draft = 'bad'").collect()}
    assert {("integrity", "hard"), ("numbers", "error"), ("calibration", "warn")} <= found


def test_packs():
    c = packs.combined("medicine", "psychology")
    assert c.weight("rct") == 0.85 and c.grade("cohort") == "low" and c.since() == 2000 and c.per_query() == 60 and c.style() == "vancouver"
    assert c.grade("book") == "very low" and c.weight("book") == 0.15 and "sr_ma" in c.causal()


def test_snowball(spark):
    edges = spark.createDataFrame([("s", "x"), ("s", "y"), ("z", "s"), ("z", "q")], "src string, dst string")
    cand = spark.createDataFrame([("x", 0.9), ("y", 0.1), ("z", 0.5)], "key string, relevance double")
    got = incremental.snowball(edges, spark.createDataFrame([("s",)], "key string"), cand, spark.createDataFrame([("s",)], "key string")).orderBy("place").collect()
    assert [r["key"] for r in got] == ["x", "z"]
