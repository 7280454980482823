"""Domain packs: weights and starting certainty of study designs, and how packs combine.

A pack is a small table of fixed size, so its frames are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from veriloom.plans import pack_words

LEVELS = ("very low", "low", "moderate", "high")
PACKS = ("medicine", "psychology", "general", "cs_ai", "engineering", "physics", "chemistry", "economics", "climate", "law_pl_eu")

# Weight and, where stated, starting certainty (v, l, m, h: very low to high) of each design, by pack in the
# order of PACKS; a dash: the pack has no value of its own.
_DESIGNS = """
guideline          .95h -    .95h -    -    -    -    -    1.0h -
sr_ma              1.0h .95h .95h .85h .85h .9h  .85h .9h  .9h  -
rct                .85h .8h  .85h -    -    -    -    -    -    -
clinical_trial     .55l .5   -    -    -    -    -    -    -    -
cohort             .5l  .5l  .5   -    -    -    -    -    -    -
case_control       .4l  .35  -    -    -    -    -    -    -    -
cross_sectional    .3l  .3l  -    -    -    -    -    -    -    -
observational      .4l  .35l .4   -    -    -    -    -    -    -
narrative_review   .25v .3   .4   .45l .45l .6m  .5l  .45  .5   .4
case_report        .12v .1   -    -    -    -    -    -    -    -
animal             .08v -    -    -    -    -    .4   -    -    -
in_vitro           .05v -    -    -    -    -    .5   -    -    -
trial_registration .05  -    -    -    -    -    -    -    -    -
journal_article    .35l .4l  .6m  .65m .7m  .75m .7m  .7m  .7m  .5m
conference_paper   -    -    .5   .65m .55l .5   .45  -    -    -
technical_report   -    -    .45  .45l .6m  .5   -    .55l .6m  -
preprint           .3l  .3l  .3l  .35l .3l  .45l .3l  .45l .35l -
book               -    -    .5   .5m  .5m  .55  .55  .5   -    .55m
thesis             -    -    .3   .3   .35l .35  -    -    -    .25
dataset            -    -    .7m  .5   .6m  .7m  .8h  .85h .85h -
standard           -    -    1.0h .9h  1.0h -    -    -    -    -
legislation        -    -    1.0h -    -    -    -    -    -    1.0h
judgment           -    -    .85  -    -    -    -    -    -    .85h
editorial          .05  .05  .05  .05  .05  .05  .05  .05  .05  .1
other              .1   .15  .15  .2   .2   .2   .2   .2   .2   .2
"""

# Connectors (optional ones after a plus), records per query, first year, citation style, designs that may
# speak of causes, extraction fields.
_SETTINGS = """
medicine: pubmed europepmc openalex clinicaltrials crossref + semanticscholar | 60 2005 vancouver | rct sr_ma guideline | design population n intervention comparator duration outcome effect safety funding
psychology: openalex pubmed europepmc crossref + semanticscholar | 50 2000 apa | sr_ma rct | design sample measure effect replication limitations
general: openalex crossref europepmc + semanticscholar core | 50 1990 apa | guideline sr_ma rct standard legislation | design context method result limitations
cs_ai: openalex arxiv crossref + semanticscholar dblp | 50 2012 ieee | sr_ma conference_paper journal_article | task method data metric result baseline compute code limitations
engineering: openalex crossref ntrs arxiv + ieee core semanticscholar | 50 2000 ieee | standard sr_ma journal_article technical_report | system method conditions sample metric result baseline limitations
physics: inspire arxiv openalex crossref + nasa_ads | 50 1990 ieee | sr_ma journal_article | observable method data result significance limitations
chemistry: pubchem europepmc openalex crossref + pubmed semanticscholar | 50 1995 acs | sr_ma journal_article dataset | substance method conditions result limitations
economics: openalex crossref worldbank + gus_bdl core semanticscholar | 50 1995 apa | sr_ma journal_article dataset | setting data method estimate mechanism limitations
climate: openalex crossref ntrs + core semanticscholar | 50 2000 apa | guideline sr_ma journal_article | region period data result confidence limitations
law_pl_eu: sejm_eli saos openalex crossref + | 30 1990 apa | legislation judgment | source provision date holding status
"""


@dataclass
class Pack:
    name: str
    weight: dict[str, float] = field(default_factory=dict)
    grade: dict[str, str] = field(default_factory=dict)
    connectors: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    per_query: int = 50
    since: int = 1990
    style: str = "apa"
    causal: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    top_venues: list[str] = field(default_factory=list)
    screening: dict = field(default_factory=dict)
    topic_fields: list[str] = field(default_factory=list)


def builtin() -> dict[str, Pack]:
    packs = {n: Pack(n) for n in PACKS}
    for line in _DESIGNS.strip().splitlines():
        design, *cells = line.split()
        for name, cell in zip(PACKS, cells, strict=True):
            if cell != "-":
                packs[name].weight[design] = float(cell.rstrip("vlmh"))
                if cell[-1] in "vlmh":
                    packs[name].grade[design] = LEVELS["vlmh".index(cell[-1])]
    for line in _SETTINGS.strip().splitlines():
        name, _, rest = line.partition(": ")
        connectors, numbers, causal, fields = (x.strip() for x in rest.split("|"))
        p = packs[name]
        own, _, more = connectors.partition("+")
        p.connectors, p.optional, p.causal, p.fields = own.split(), more.split(), causal.split(), fields.split()
        per, since, p.style = numbers.split()
        p.per_query, p.since = int(per), int(since)
        p.keywords, p.topic_fields, p.top_venues = (pack_words.listed(t.get(name, "")) for t in (pack_words.KEYWORDS, pack_words.FIELDS, pack_words.VENUES))
        p.screening = dict(pack_words.SCREENING)
    return packs


def load(paths: list[str], base: dict[str, Pack] | None = None) -> dict[str, Pack]:
    """The built-in packs, then TOML files in order; a file's pack replaces one of its name."""
    import tomllib
    from dataclasses import fields as columns

    out = dict(base or builtin())
    for path in paths:
        with open(path, "rb") as f:
            spec = tomllib.load(f)
        name = spec.get("name") or path.rsplit("/", 1)[-1].removesuffix(".toml")
        out[name] = Pack(name, **{k: v for k, v in spec.items() if k in {c.name for c in columns(Pack)} - {"name"}})
    return out


@dataclass
class Combined:
    """Several packs used together: the best weight and level of each design, the union of the rest, the earliest year."""

    packs: list[Pack]

    def connectors(self, optional: bool = False) -> list[str]:
        return list(dict.fromkeys(c for p in self.packs for c in p.connectors + p.optional * optional))

    def weight(self, design: str) -> float:
        own = [p.weight[design] for p in self.packs if design in p.weight]
        return max(own or [p.weight.get("other", 0.15) for p in self.packs], default=0.15)

    def grade(self, design: str) -> str:
        stated = [p.grade[design] for p in self.packs if design in p.grade]
        if stated:
            return max(stated, key=LEVELS.index)
        w = self.weight(design)
        return next(level for level, least in (("high", 0.85), ("moderate", 0.6), ("low", 0.3), ("very low", -1.0)) if w >= least)

    def causal(self) -> set[str]:
        return {d for p in self.packs for d in p.causal}

    def fields(self) -> list[str]:
        return list(dict.fromkeys(f for p in self.packs for f in p.fields))

    def top_venues(self) -> list[str]:
        return list(dict.fromkeys(v for p in self.packs for v in p.top_venues))

    def screening(self, key: str, default=None):
        return next((p.screening[key] for p in self.packs if key in p.screening), default)

    def since(self) -> int:
        return min((p.since for p in self.packs), default=1990)

    def per_query(self) -> int:
        return max((p.per_query for p in self.packs), default=50)

    def style(self) -> str:
        return self.packs[0].style if self.packs else "apa"

    def frame(self, spark: SparkSession) -> DataFrame:
        """(design, design_weight, level): a row for each design that any pack names, and `other`."""
        designs = sorted({d for p in self.packs for d in p.weight} | {"other"})
        return spark.createDataFrame([(d, self.weight(d), LEVELS.index(self.grade(d))) for d in designs], "design string, design_weight double, level int")


def combined(*names: str, packs: dict[str, Pack] | None = None) -> Combined:
    known = packs or builtin()
    return Combined([known[n] for n in names])


def detect(questions: DataFrame, text: str, packs: dict[str, Pack], by: str = "id", fields: str | None = None) -> DataFrame:
    """(id, pack, score) for questions: how many of a pack's keywords begin words of it; packs with half the best score and more, three at most; `general` if none.

    fields: a column with the fields of research of a question's first hits; three times the share that a pack knows is added. Each
    question meets the packs' keywords, a table of fixed size, in one pass over its text.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window as W

    from veriloom.functions.text import normalize, strip_accents

    known = [p for p in packs.values() if p.name != "general"]
    keywords = sorted({(p.name, k.lower()) for p in known for k in p.keywords})
    spark = questions.sparkSession
    table = spark.createDataFrame(keywords, "pack string, keyword string").select("pack", strip_accents("keyword").alias("keyword")).distinct().groupBy("pack").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    columns = [F.lower(strip_accents(normalize(text))).alias("plain")] + ([F.col(fields).alias("own_fields")] if fields else [])
    own = questions.select(by, *columns)
    hit = lambda k: F.rlike(F.col("plain"), F.concat(F.lit(r"(?<![a-z])\Q"), k, F.lit(r"\E")))
    pairs = own.crossJoin(F.broadcast(table))  # a row for each pack: ten or so
    found = pairs.select(by, "pack", F.size(F.filter("keywords", hit)).cast("double").alias("score"))
    if fields:
        shares = spark.createDataFrame([(p.name, p.topic_fields) for p in known], "pack string, pack_fields array<string>")
        known_share = F.expr("size(filter(own_fields, f -> array_contains(pack_fields, f))) / greatest(size(own_fields), 1)")
        found = found.unionByName(own.crossJoin(F.broadcast(shares)).select(by, "pack", (F.lit(3.0) * known_share).alias("score"))).groupBy(by, "pack").agg(F.sum("score").alias("score"))
    found = found.where("score > 0")
    best = W.partitionBy(by)
    ranked = found.withColumn("top", F.max("score").over(best)).where("score >= 0.5 * top").withColumn("place", F.row_number().over(best.orderBy(F.desc("score"), "pack")))
    ranked = ranked.where("place <= 3").select(by, "pack", "score")
    none = own.select(by).join(ranked, by, "left_anti").select(by, F.lit("general").alias("pack"), F.lit(1.0).alias("score"))
    return ranked.unionByName(none)
