"""The study-design ladder as one CASE: the first rule that holds gives the design and its basis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions.text import normalize

# Document kinds that settle the design.
DEFINITE = {"trial_registration": "trial_registration", "legislation": "legislation", "judgment": "judgment", "dataset": "dataset", "standard": "standard", "dissertation": "thesis", "thesis": "thesis"}

# Parts of publication types and their designs, in order.
TYPES = (
    ("practice guideline", "guideline"), ("guideline", "guideline"), ("consensus development", "guideline"),
    ("meta-analysis", "sr_ma"), ("systematic review", "sr_ma"), ("network meta-analysis", "sr_ma"),
    ("clinical trial protocol", "trial_registration"), ("study protocol", "trial_registration"),
    ("retraction of publication", "editorial"), ("retracted publication", "other"),
    ("randomized controlled trial", "rct"), ("randomised controlled trial", "rct"),
    ("pragmatic clinical trial", "rct"), ("equivalence trial", "rct"),
    ("controlled clinical trial", "clinical_trial"), ("clinical trial, phase", "clinical_trial"),
    ("clinical trial", "clinical_trial"),
    ("observational study", "observational"), ("cohort", "cohort"), ("case-control", "case_control"),
    ("cross-sectional", "cross_sectional"),
    ("case reports", "case_report"), ("case report", "case_report"),
    ("editorial", "editorial"), ("comment", "editorial"), ("letter", "editorial"), ("news", "editorial"),
    ("review", "narrative_review"),
    ("preprint", "preprint"),
)

# Patterns of titles (the first six of abstracts too), in order.
TITLES = (
    (r"\bumbrella review\b|\bmeta[- ]analys[ie]s\b|\bsystematic (literature )?review\b|\bpooled analysis\b|\bmetaanaliz|\bprzegląd systematyczny", "sr_ma"),
    (r"\bguideline|\bconsensus statement\b|\bposition statement\b|\brecommendations? (of|from)\b|\bwytyczn", "guideline"),
    (r"\brandomi[sz]ed\b.*\btrial\b|\brandomi[sz]ed controlled\b|\b(double|single)[- ]blind\b|\bplacebo[- ]controlled\b|\brandomizowan", "rct"),
    (r"\bcohort\b|\bprospective (study|analysis)\b|\blongitudinal (study|analysis)\b|\bbadanie kohortowe", "cohort"),
    (r"\bcase[- ]control\b", "case_control"),
    (r"\bcross[- ]sectional\b|\bprzekrojow", "cross_sectional"),
    (r"\bcase report\b|\bcase series\b|\ba case of\b", "case_report"),
    (r"\bin vitro\b|\bcell line|\bcultured cells\b|\bhek293\b|\bhela\b", "in_vitro"),
    (r"\bmice\b|\bmouse\b|\bmurine\b|\brats?\b|\bzebrafish\b|\bin vivo\b(?!.*\bhuman)|\bmyszy|\bszczur", "animal"),
    (r"\bmendelian randomi[sz]ation\b", "observational"),
    (r"\b(narrative|scoping|literature) review\b|\ba review\b|\breview of\b|\boverview\b", "narrative_review"),
)

# Document kinds and their designs.
KINDS = {
    "standard": "standard", "report": "technical_report", "technical_report": "technical_report",
    "proceedings-article": "conference_paper", "inproceedings": "conference_paper", "conference_paper": "conference_paper", "proceedings": "conference_paper",
    "journal-article": "journal_article", "article": "journal_article", "journal_article": "journal_article",
    "review": "narrative_review", "book": "book", "book-chapter": "book", "monograph": "book",
    "dissertation": "thesis", "thesis": "thesis", "dataset": "dataset", "legislation": "legislation",
    "judgment": "judgment", "trial_registration": "trial_registration", "editorial": "editorial",
    "letter": "editorial", "peer-review": "editorial", "erratum": "editorial", "paratext": "other",
}

ANIMAL_BASIS = "mesh:Animals (no Humans)"


def is_animal(mesh: Column) -> Column:
    low = F.transform(mesh, F.lower)
    return F.array_contains(low, "animals") & ~F.array_contains(low, "humans")


def infer_design(kind: Column, pub_types: Column, study_designs: Column, mesh: Column, title: Column, abstract: Column, venue: Column, is_preprint: Column, nfkc: bool = True) -> Column:
    """struct<design, basis>. Arrays may be empty, not null; texts may be null."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    types = F.transform(pub_types, F.lower)
    has = lambda parts, needle: F.exists(parts, lambda p: p.contains(needle))
    out = lambda design, basis: F.struct((F.lit(design) if isinstance(design, str) else design).alias("design"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"))
    animal = is_animal(mesh)
    chain = None

    def rule(test: Column, design, basis) -> None:
        nonlocal chain
        chain = F.when(test, out(design, basis)) if chain is None else chain.when(test, out(design, basis))

    for a, b in DEFINITE.items():
        rule(k == a, b, F.concat(F.lit("kind:"), kind))
    for needle, design in TYPES:
        test = has(types, needle)
        if design == "narrative_review":
            test = test & ~has(types, "systematic") & ~has(types, "meta")
        if design in ("clinical_trial", "observational", "narrative_review"):
            rule(test & animal, "animal", ANIMAL_BASIS)
        rule(test, design, f"pubtype:{needle}")
    # the first study design that any part matches, and the first part that does
    matched = F.filter(study_designs, lambda s: F.lower(s).rlike("|".join(n for n, _ in TYPES)))
    first = F.get(matched, F.lit(0))
    pick = None
    for needle, design in TYPES:
        test = F.lower(first).contains(needle)
        pick = F.when(test, F.lit(design)) if pick is None else pick.when(test, F.lit(design))
    rule(F.size(matched) > 0, pick, F.concat(F.lit("openalex:"), first))
    rule(animal, "animal", ANIMAL_BASIS)
    rule(F.array_contains(F.transform(mesh, F.lower), "in vitro techniques"), "in_vitro", "mesh:In Vitro Techniques")
    plain = F.lower(normalize(title, nfkc))
    for pattern, design in TITLES:
        rule(plain.rlike(f"(?U){pattern}"), design, "title")
    rule(F.coalesce(is_preprint, F.lit(False)) | k.isin("preprint", "posted-content"), "preprint", F.concat(F.lit("kind:"), F.coalesce(F.nullif(k, F.lit("")), F.lit("preprint"))))
    for a, b in KINDS.items():
        rule(k == a, b, F.concat(F.lit("kind:"), k))
    head = F.substring(F.lower(normalize(abstract, nfkc)), 1, 600)
    for pattern, design in TITLES[:6]:
        rule(head.rlike(f"(?U){pattern}"), design, "abstract")
    rule(F.coalesce(venue, F.lit("")) != "", "journal_article", "default")
    return chain.otherwise(out("other", "default"))
