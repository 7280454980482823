"""Operators whose shape the driver's tables lack, on literal rows: each query calls the library, its SQL states what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import authors, identity, scan, text
from veriloom.plans import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_SQL_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(schema: str, rows: list[tuple]) -> str:
    """SQL of literal rows under a schema in Spark's words."""
    columns = [c.split() for c in schema.split(", ")]
    names = ", ".join(f"CAST({n} AS {_SQL_KINDS[k]}) AS {n}" for n, k in columns)
    return f"SELECT {names} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in columns)})"


def case(schema: str, *rows: tuple):
    """Registers a function of a session; its frame must have this schema and these rows, in any order."""

    def add(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            session.prepare(spark)
            return f(spark).selectExpr(*[f"CAST(`{n}` AS {k}) AS {n}" for n, k in (c.split() for c in schema.split(", "))])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = values(schema, list(rows))
        return f

    return add


def numbered(spark: SparkSession, *items: object, kind: str = "string") -> DataFrame:
    """(id, x) of single values, numbered from 1."""
    return spark.createDataFrame([(k, x) for k, x in enumerate(items, 1)], f"id int, x {kind}")


def listed(c) -> F.Column:
    return F.array_join(c, "|")


# ---- text


@case("id int, plain string", (1, "fi 1/2 km2 - it's"), (2, 'a "b" c'), (3, "coordination of words"), (4, ""), (5, "3.5 a"))
def t01_normalize(spark):
    """Compatibility forms, dashes, quotes, blanks, words broken over lines, zero-width characters."""
    return numbered(spark, "ﬁ ½ km² – it’s".replace("½", "1/2"), "a “b”​ c", "co-\n ordination  of\n words", None, "3·5\ta").select("id", text.normalize("x").alias("plain"))


@case("id int, plain string", (1, "Zazołc gesla jazn"), (2, "Ångstrom".replace("Å", "A")), (3, "øre"))
def t03_strip_accents(spark):
    return numbered(spark, "Zażołć gęślą jaźń", "Ångström", "øre").select("id", text.strip_accents("x").alias("plain"))


@case("id int, slug string", (1, "vitamin-d-copd-2019"), (2, "x"), (3, "a-very-long-title-that-goes-on-and-on-an"), (4, "ecole"))
def t04_slug(spark):
    return numbered(spark, "Vitamin D & COPD (2019)", "???", "A very long title that goes on and on and on and on", "École!").select("id", text.slug("x").alias("slug"))


@case("id int, place int, sentence string", (1, 0, "We saw 12 cases, e.g. in mice (n = 3. See Fig. 2)."), (1, 1, "Smith et al. found 3.5 % more."), (1, 2, "Was it so?"), (1, 3, "Yes!"), (2, 0, "One line only"), (4, 0, "Dr. J. Kowalski wrote it."), (4, 1, '"It holds."'), (4, 2, "(Mostly.)"))
def t10_sentence_rules(spark):
    """Brackets, abbreviations, initials, decimals and closing quotes."""
    d = numbered(spark, "We saw 12 cases, e.g. in mice (n = 3. See Fig. 2). Smith et al. found 3.5 % more. Was it so? Yes!", "One line only", "", 'Dr. J. Kowalski wrote it. "It holds." (Mostly.)')
    return d.select("id", F.posexplode(scan.split_sentences("x")).alias("place", "sentence"))


@case("id int, readings string", (1, "1234.0"), (2, "1.234|1234.0"), (3, "0.81"), (4, "1234567.0"), (5, "1234.56|1.23456"), (6, "10933.0"), (7, "12.5"))
def t11_number_readings(spark):
    """All plausible values of a numeral."""
    return numbered(spark, "1234", "1,234", "0,81", "1,234,567", "1.234,56", "10 933", "12.5").select("id", listed(F.transform(text.number_readings(F.col("x")), lambda v: v.cast("string"))).alias("readings"))


@case("id int, place int, raw string, readings string, decimals int, pct boolean, significant boolean",
      (1, 0, "0,88", "0.88", 2, False, True), (1, 1, "95%", "95.0", 0, True, True), (1, 2, "0,81", "0.81", 2, False, True), (1, 3, "0,96", "0.96", 2, False, True),
      (2, 0, "10 933", "10933.0", 0, False, True), (2, 1, "2019", "2019.0", 0, False, False), (2, 2, "7", "7.0", 0, False, False), (3, 0, "-1.5", "-1.5", 1, False, True), (3, 1, "12 %", "12.0", 0, True, True))
def t12_number_rules(spark):
    """Decimal commas, groups of thousands, signs, percentages; years and small counts need no check."""
    n = numbered(spark, "OR 0,88 (95% CI 0,81–0,96)", "10 933 people in 2019, 7 trials, COVID19", "fell by -1.5 or 12 %").select("id", F.posexplode(text.numbers("x")).alias("place", "n"))
    return n.select("id", "place", "n.raw", listed(F.transform("n.values", lambda v: v.cast("string"))).alias("readings"), "n.decimals", "n.pct", text.significant(F.col("n")).alias("significant"))


@case("id int, raw string, status string", (1, "8.3 %", "rounded"), (1, "1515", "exact"), (1, "1616", "missing"), (2, "0.5", "exact"), (2, "2.67", "missing"), (3, "9", "rounded"))
def t15_number_match(spark):
    """Numbers of a statement against a source's number index (T14, G07): equal, rounded to the statement's places, or missing."""
    d = spark.createDataFrame([(1, "8.3 %, 1515 and 1616", "8.34 % (n=1,515)"), (2, "0.5 and 2.67", "-0.5 and 2.665 0"), (3, "9", "8.7 of ten")], "id int, said string, source string")
    d = d.select("id", F.explode(text.numbers("said")).alias("n"), text.numbers("source").alias("have"))
    return d.select("id", "n.raw", text.number_match(F.col("n"), F.col("have")).alias("status"))


@case("id int, similarity double, found boolean", (1, 1.0, True), (2, 1.0, True), (3, None, False), (4, 1.0, True), (5, 0.964, True), (6, None, False))
def t16_find_quote(spark):
    """Quotes as they stand, over a broken line, in parts, and with one letter of 28 changed."""
    body = "Vitamin D supplementation reduced the risk of acute respiratory in-\nfection among all participants. Protection was seen in those with baseline deficiency."
    d = numbered(spark, "reduced the risk of acute", "acute respiratory infection among", "unrelated zebra sentence", "Vitamin D supplementation ... baseline deficiency", "Protection was sees in those", "").withColumn("body", F.lit(body))
    f = d.withColumn("f", scan.find_quote("x", "body"))
    return f.select("id", F.when(F.col("f.at") >= 0, F.round("f.similarity", 3)).alias("similarity"), (F.col("f.at") >= 0).alias("found"))


@case("place int, first string, last string, sentences int", (0, "S01", "S06", 6), (1, "S06", "S11", 6), (2, "S11", "S12", 2))
def t18_chunk_rules(spark):
    """Twelve sentences of 100 characters: up to 700 a chunk, each beginning with the last sentence of the one before."""
    made = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(F.lit("S"), F.lpad(k.cast("string"), 2, "0"), F.lit(" "), F.repeat(F.lit("x"), 95), F.lit("."))), " ")
    chunks = spark.range(1).select(F.posexplode(scan.chunk_text(made)).alias("place", "chunk"))
    names = F.regexp_extract_all("chunk", F.lit(r"(S\d\d)"), F.lit(1))
    return chunks.select("place", F.element_at(names, 1).alias("first"), F.element_at(names, -1).alias("last"), F.size(names).alias("sentences"))


@case("position int, sentence string, line int, section string, paragraph int, in_table boolean",
      (0, "First claim [@a].", 5, "Results", 1, False), (1, "It goes on over a line.", 5, "Results", 1, False), (2, "a | 1", 10, "Results", 2, True), (3, "item one", 12, "Results", 3, False), (4, "item two", 13, "Results", 4, False), (5, "The end.", 20, "Limits", 5, False))
def t27_draft_sentences(spark):
    """Front matter, comments, code and the reference list go; sections and paragraphs carry forward (W07, W08); rows of tables are sentences."""
    draft = "---\ntitle: x\n---\n# Results\nFirst claim [@a]. It goes\non over a **line**.\n\n| head | n |\n|---|---|\n| a | 1 |\n\n- item one\n- item two\n<!-- a\ncomment -->\n```\ncode.\n```\n## Limits\nThe end.\n\n## References\n- nothing"
    from veriloom.operators.verify import parse_drafts

    d = parse_drafts(spark.createDataFrame([("d", draft)], "draft string, text string"))
    return d.select("position", "sentence", "line", "section", "paragraph", "in_table")


# ---- identifiers, names, references


@case("prio int, kind string, value string", (0, "doi", "10.1000/x"), (1, "pmid", "123456"), (2, "pmcid", "PMC77"), (3, "arxiv", "2101.00001"), (4, "openalex", "W99"), (8, "title", "vitamin supplementation prevent infections"))
def i04_id_list(spark):
    """A work's identifiers in the order in which they are tried; the title key last."""
    w = spark.createDataFrame([("https://doi.org/10.1000/X.", "PMID 123456", "77", "arXiv:2101.00001v3", "https://openalex.org/w99", "", "Vitamin D supplementation to prevent infections")], "doi string, pmid string, pmcid string, arxiv string, openalex string, s2 string, title string")
    ids = identity.id_list({k: F.col(k) for k in ("doi", "pmid", "pmcid", "arxiv", "openalex", "s2")}, F.col("title"))
    return w.select(F.explode(ids).alias("i")).select("i.prio", "i.kind", "i.value")


@case("id int, name string, family string", (1, "Kowalski, Jan", "Kowalski"), (2, "van der Berg, Anna", "van der Berg"), (3, "Smith JA", "Smith"), (4, "World Health Organization", "World"), (5, "King, Martin Luther", "King"), (6, "Plato", "Plato"), (7, "", ""))
def i06_display_names(spark):
    """Names as displayed, turned; initials, organisations and single names stay. Their family names."""
    d = numbered(spark, "Jan Kowalski", "Anna van der Berg", "Smith JA", "World Health Organization", "Martin Luther King Jr.", "Plato", "").select("id", identity.display_name("x").alias("name"))
    return d.withColumn("family", identity.family_name("name"))


@case("id int, rank int, same boolean", (1, 2, True), (2, 1, True), (3, 2, False), (4, 0, False))
def i08_author_rank(spark):
    """Structured lists rank above displayed ones, none last (I08); whether the first names are one person's."""
    d = spark.createDataFrame([(1, ["Kowalski, Jan"], "J Kowalski"), (2, ["Jan Kowalski"], "Jan Kowalski"), (3, ["Smith, Adam"], "Smith, Eve"), (4, [], "x")], "id int, names array<string>, other string")
    rank = F.udf(lambda n: authors.rank(n, False), "int")
    same = F.udf(lambda n, o: bool(n) and authors.same_person(n[0], o), "boolean")
    return d.select("id", rank("names").alias("rank"), same("names", "other").alias("same"))


@case("id int, authors string, displayed boolean", (1, "Kowalski, Jan|Smith, Adam|Brown, Eve", False), (2, "Kowalski, Jan|Smith, Adam|New, Person", True), (3, "Kowalski, Jan", False), (4, "", False))
def i10_merge_authors(spark):
    """The longer list stands, displayed names (I07) take the structured ones of the same persons."""
    rows = [(1, ["Kowalski, Jan", "Smith, Adam", "Brown, Eve"], False, ["Jan Kowalski"], True), (2, ["Jan Kowalski", "Adam Smith", "Person New"], True, ["Kowalski, Jan", "Smith, Adam"], False), (3, [], False, ["Kowalski, Jan"], False), (4, [], False, [], False)]
    d = spark.createDataFrame(rows, "id int, a array<string>, ad boolean, b array<string>, bd boolean").withColumn("m", authors.merge_authors("a", "ad", "b", "bd"))
    return d.select("id", listed("m.authors").alias("authors"), "m.displayed")


@case("id int, organisation boolean, initials string, tight string", (1, True, None, None), (2, False, "J. M.", "JM"), (3, False, "J. A.", "JA"), (4, True, None, None), (5, False, "", ""))
def i15_initials(spark):
    """Organisations by their words or length (I11); initials of given names, with dots or without."""
    d = numbered(spark, "Cochrane Collaboration", "Kowalski, Jan Maria", "Smith JA", "one two three four five", "Plato")
    org = identity.is_organisation("x")
    return d.select("id", org.alias("organisation"), F.when(~org, identity.initials("x")).alias("initials"), F.when(~org, identity.initials("x", dots=False, space=False)).alias("tight"))


@case("id int, key string", (1, "martineau2017vitamin"), (2, "lopez2020retracted"), (3, "who2021guidelines"), (4, "anonnd"), (5, "vanderberg1999cohort"))
def i13_key_base(spark):
    """Family, year or nd, and the first long title word that is not too common."""
    d = spark.createDataFrame([(1, "Martineau, Adrian", 2017, "Vitamin D supplementation to prevent", "BMJ"), (2, "López, Ana", 2020, "The retracted paper", "X"), (3, "", 2021, "Using guidelines", "WHO"), (4, "", None, "", ""), (5, "van der Berg, A.", 1999, "A cohort from the north", "")], "id int, author string, year int, title string, venue string")
    return d.select("id", identity.key_base("author", "year", "title", "venue").alias("key"))


_PEOPLE = ["Kowalski, Jan Maria", "Smith, Adam", "World Health Organization", "Brown, Eve"]


@case("n int, apa string, vancouver string, ieee string, harvard string, intext string",
      (0, "", "", "", "", "Anon."),
      (1, "Kowalski, J. M.", "Kowalski JM", "J. M. Kowalski", "Kowalski, J. M.", "Kowalski"),
      (2, "Kowalski, J. M., & Smith, A.", "Kowalski JM, Smith A", "J. M. Kowalski and A. Smith", "Kowalski, J. M. and Smith, A.", "Kowalski & Smith"),
      (4, "Kowalski, J. M., Smith, A., World Health Organization, & Brown, E.", "Kowalski JM, Smith A, World Health Organization, Brown E", "J. M. Kowalski, A. Smith, World Health Organization, and E. Brown", "Kowalski, J. M. et al.", "Kowalski et al."))
def i16_author_lists(spark):
    """Author lists in the styles, and authors in the text."""
    d = spark.createDataFrame([(k, _PEOPLE[:k]) for k in (0, 1, 2, 4)], "n int, a array<string>")
    return d.select("n", *[identity.author_list(F.col("a"), s).alias(s) for s in ("apa", "vancouver", "ieee", "harvard")], identity.intext_author(F.col("a")).alias("intext"))


@case("style string, reference string",
      ("apa", "Kowalski, J. M., & Smith, A. (2019). Vitamin D. *BMJ*, *7*(2), 1-9. https://doi.org/10.1000/x"),
      ("vancouver", "Kowalski JM, Smith A. Vitamin D. BMJ. 2019;7(2):1-9. doi:10.1000/x."),
      ("ieee", 'J. M. Kowalski and A. Smith, "Vitamin D," *BMJ*, vol. 7, no. 2, pp. 1-9, 2019, doi:10.1000/x.'),
      ("acs", "Kowalski JM, Smith A. Vitamin D. *BMJ* **2019**, *7*, 1-9. doi:10.1000/x."),
      ("harvard", "Kowalski, J. M. and Smith, A. (2019) 'Vitamin D', *BMJ*, 7(2), pp. 1-9. https://doi.org/10.1000/x."),
      ("chicago", 'Kowalski, J. M. and Smith, A. 2019. "Vitamin D." *BMJ* 7(2): 1-9. https://doi.org/10.1000/x.'))
def i18_reference_styles(spark):
    """One work's reference in six styles."""
    w = spark.createDataFrame([(_PEOPLE[:2], 2019, "Vitamin D.", "BMJ", "7", "2", "1-9", "10.1000/x")], "authors array<string>, year int, title string, venue string, volume string, issue string, pages string, doi string")
    none = F.lit("")
    styles = ("apa", "vancouver", "ieee", "acs", "harvard", "chicago")
    made = [F.struct(F.lit(s).alias("style"), identity.reference(s, F.col("authors"), F.col("year"), F.col("title"), F.col("venue"), F.col("volume"), F.col("issue"), F.col("pages"), F.col("doi"), none, none, none, F.lit(False)).alias("reference")) for s in styles]
    return w.select(F.explode(F.array(*made)).alias("r")).select("r.*")


@case("place int, key string, locator string, quote string", (0, "a2019", "p. 3", "it [really]; holds"), (1, "b", "", ""), (2, "c:1", "tab. 2", ""), (3, "d", "", "x y"))
def i19_citation_items(spark):
    """Citation blocks, their items at semicolons outside quotes (I20), and key, locator and quote of each."""
    d = numbered(spark, 'Claim [@a2019, p. 3 :: "it [really]; holds"; @b] and [@c:1, tab. 2] but not [link](x) or a@mail. More [@d :: “x y”].')
    return d.select(F.posexplode(scan.parse_citations("x")).alias("place", "c")).select("place", "c.key", "c.locator", "c.quote")


@case("id int, plain string, kind string, value string", (1, "A claim.", "page", "12"), (2, "Two.", "sec", "results"), (3, "No citation [1].", "table", "2"), (4, "", "figure", "3a"), (5, "x", "", "abstract"))
def i22_locators(spark):
    """Sentences without their citations; locators as kind and value, English and Polish."""
    d = spark.createDataFrame([(1, 'A claim [@a :: "q"].', "str. 12"), (2, "Two [@a; @b].", "§ Results"), (3, "No citation [1].", "Tabela 2"), (4, "", "Fig. 3a"), (5, "x", "abstract")], "id int, x string, loc string")
    strip, where = F.udf(scan.without_citations, "string"), F.udf(lambda x: list(scan.location(x)), "array<string>")
    return d.select("id", strip("x").alias("plain"), F.get(where("loc"), F.lit(0)).alias("kind"), F.get(where("loc"), F.lit(1)).alias("value"))


@case("id int, stands boolean, place string", (1, True, "p. 2"), (2, False, "p. 2"), (3, None, "p. 2"), (4, True, "p. 2"), (5, True, "abstract"), (6, False, ""), (7, True, "p. 2"))
def i25_quote_location(spark):
    """Whether a quote stands where it is said to (I24): right, wrong and where it is, or not to be checked."""
    pages = [{"loc": "p. 1", "label": "i", "text": "Nothing of interest is written on this page."}, {"loc": "p. 2", "label": "411", "text": "Protection was seen in those with profound deficiency."}]
    d = spark.createDataFrame([(1, "p. 2"), (2, "p. 1"), (3, "Table 4"), (4, ""), (5, "abstract"), (6, "p. 2"), (7, "p. 411")], "id int, loc string")
    quote = F.when(F.col("id") == 6, "words that stand nowhere at all").when(F.col("id") == 5, "the abstract says so").otherwise("seen in those with profound deficiency")

    def at(q, loc):
        ok, place = scan.quote_at(q, loc, pages, "Here the abstract says so.")
        return (ok, place)

    f = F.udf(at, "stands boolean, place string")
    return d.withColumn("r", f(quote, "loc")).select("id", F.col("r.stands"), "r.place")


@case("id int, kind string, value string", (1, "doi", "10.1000/ab"), (2, "doi", "10.1000/x"), (3, "pmcid", "PMC123"), (4, "pmid", "12345678"), (5, "nct", "nct00000001"), (6, "openalex", "W1234567"), (7, "arxiv", "2101.00001"), (8, "key", "smith2019"), (9, "eli", "du/2004/535"))
def i26_resolve_reference(spark):
    """What a written reference points to, by its prefix or shape."""
    d = numbered(spark, "doi:10.1000/AB", "https://doi.org/10.1000/x", "PMC123", "12345678", "NCT00000001", "W1234567", "2101.00001v2", "@smith2019", "eli:DU/2004/535")
    return d.select("id", identity.resolve_reference("x").alias("r")).select("id", "r.*")


@case("id int, metric string, estimate double, low double, high double", (1, "OR", 0.88, 0.81, 0.96), (2, "SMD", -0.3, -0.5, -0.1), (3, "HR", 1.2, 1.0, 1.5), (4, None, None, None, None), (5, "RR", 0.5, 0.4, 0.6))
def i27_effect_forms(spark):
    """Effects as they are written; an estimate outside its interval is none."""
    d = numbered(spark, "OR 0.88 (95% CI 0.81-0.96)", "SMD = −0.3 [−0.5 to −0.1]", "hr: 1.2, 95 % CI: 1.0; 1.5", "OR 2.0 (0.5-1.5)", "RR 0,5 (95% PU 0,4–0,6)")
    return d.select("id", identity.parse_effect("x").alias("e")).select("id", "e.*")
