"""Cases of the sources: payload parsers, the search source on canned replies, full texts, imports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from veriloom.plans.cases import case, listed, numbered
from veriloom.sources import connectors, fulltext, imports, payloads

_OPENALEX = {
    "id": "https://openalex.org/w123", "display_name": "Vitamin <i>D</i>", "doi": "https://doi.org/10.1000/A", "publication_year": 2017, "publication_date": "2017-02-15", "type": "article", "language": "en", "cited_by_count": 9, "is_retracted": False,
    "primary_location": {"source": {"display_name": "Some Repository", "type": "repository"}, "landing_page_url": "http://r"}, "locations": [{"source": {"display_name": "Some Repository", "type": "repository"}}, {"source": {"display_name": "BMJ", "type": "journal"}}],
    "biblio": {"volume": "356", "issue": "1", "first_page": "10", "last_page": "19"}, "authorships": [{"author": {"display_name": "Adrian Martineau"}}, {"author": {"display_name": "David Jolliffe"}}],
    "abstract_inverted_index": {"effect": [2], "The": [0], "main": [1]}, "topics": [{"display_name": t} for t in "abcd"], "referenced_works": ["https://openalex.org/W5"], "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/28202713"}, "grants": [{"funder_display_name": "NIHR"}, {"funder_display_name": "MRC"}],
}


def _parsed(spark, connector: str, *bodies):
    rows = [(k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies, 1)]
    return payloads.parse(spark.createDataFrame(rows, "id int, body string"), connector)


@case("title string, year int, venue string, pages string, doi string, openalex string, pmid string, abstract string, topics string, refs string, authors string, funding string, is_preprint boolean, cited_by int",
      ("Vitamin D", 2017, "BMJ", "10-19", "10.1000/a", "W123", "28202713", "The main effect", "a|b|c", "openalex:W5", "Adrian Martineau|David Jolliffe", "NIHR; MRC", False, 9))
def s03_openalex(spark):
    """A repository gives way to the first journal; three topics; funders joined; the abstract from its index."""
    return _parsed(spark, "openalex", _OPENALEX).select("title", "year", "venue", "pages", "doi", "openalex", "pmid", "abstract", listed("topics").alias("topics"), listed("references").alias("refs"), listed("authors").alias("authors"), "funding", "is_preprint", "cited_by")


_PUBMED = """<PubmedArticle><MedlineCitation><PMID>111</PMID><Article><Journal><Title>BMJ</Title><JournalIssue><Volume>3</Volume><Issue>4</Issue><PubDate><MedlineDate>2018 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>A trial of <i>something</i>.</ArticleTitle><Pagination><MedlinePgn>5-9</MedlinePgn></Pagination><Abstract><AbstractText Label="BACKGROUND">Why.</AbstractText><AbstractText Label="RESULTS">OR 0.5.</AbstractText><AbstractText>More.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList><Language>eng</Language>
<PublicationTypeList><PublicationType>Randomized Controlled Trial</PublicationType></PublicationTypeList><ELocationID EIdType="doi">10.1/X</ELocationID></Article>
<MeshHeadingList><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList><CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"><RefSource>BMJ</RefSource><PMID>9</PMID></CommentsCorrections><CommentsCorrections RefType="ErratumIn"><RefSource>BMJ 2</RefSource></CommentsCorrections></CommentsCorrectionsList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pmc">PMC5</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="pubmed">77</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>"""


@case("pmid string, title string, abstract string, year int, venue string, pages string, doi string, pmcid string, authors string, mesh string, refs string, is_retracted boolean, updates string",
      ("111", "A trial of something.", "BACKGROUND: Why. RESULTS: OR 0.5. More.", 2018, "BMJ", "5-9", "10.1/x", "PMC5", "Doe, Jane|The Group", "Humans", "pmid:77", True, "retraction|correction"))
def s10_pubmed(spark):
    """Labelled parts of the abstract, the year from a Medline date, references, retraction and other notices."""
    w = _parsed(spark, "pubmed", _PUBMED)
    return w.select("pmid", "title", "abstract", "year", "venue", "pages", "doi", "pmcid", listed("authors").alias("authors"), listed("mesh").alias("mesh"), listed("references").alias("refs"), "is_retracted", listed(F.transform("updates", lambda u: u["type"])).alias("updates"))


@case("id int, title string, is_preprint boolean, is_retracted boolean, published_version string, updates string, pdf_url string, date string",
      (1, "Main: Sub", False, True, "", "retraction 10.1/r 2020-05-01", "http://x/a.pdf", "2019-03"), (2, "A preprint", True, False, "10.2/final", "", "", "2021"), (3, "Grant note with sub", False, False, "", "correction 10.1/c ", "", ""))
def s13_crossref_notices(spark):
    """Titles with subtitles unless held already, preprints by type and subtype, update notices, the published version, a PDF."""
    one = {"title": ["Main"], "subtitle": ["Sub"], "type": "journal-article", "published": {"date-parts": [[2019, 3]]}, "updated-by": [{"type": "retraction", "DOI": "10.1/R", "updated": {"date-time": "2020-05-01T00:00:00Z"}}], "link": [{"URL": "http://x/a", "content-type": "text/html"}, {"URL": "http://x/a.pdf", "content-type": "application/pdf"}]}
    two = {"title": ["A preprint"], "type": "posted-content", "subtype": "preprint", "relation": {"is-preprint-of": [{"id": "10.2/FINAL"}]}, "issued": {"date-parts": [[2021]]}}
    three = {"title": ["Grant note with sub"], "subtitle": ["With Sub"], "type": "posted-content", "subtype": "other", "updated-by": [{"type": "correction", "DOI": "10.1/c"}]}
    notice = F.transform("updates", lambda u: F.concat_ws(" ", u["type"], u["doi"], u["date"]))
    return _parsed(spark, "crossref", one, two, three).select("id", "title", "is_preprint", "is_retracted", "published_version", listed(notice).alias("updates"), "pdf_url", "date")


@case("id int, title string, year int, doi string, pmcid string, is_preprint boolean, pdf_url string, url string, authors string", (1, "T", 2020, "10.1/a", "PMC1", False, "http://p.pdf", "http://h", "Doe, J|Group"), (2, "U", 2021, "", "", True, "", "", ""))
def s16_europepmc(spark):
    one = {"title": "T", "pubYear": "2020", "doi": "10.1/A", "pmcid": "PMC1", "source": "MED", "fullTextUrlList": {"fullTextUrl": [{"availabilityCode": "S", "documentStyle": "pdf", "url": "http://no"}, {"availabilityCode": "OA", "documentStyle": "pdf", "url": "http://p.pdf"}, {"availabilityCode": "F", "documentStyle": "html", "url": "http://h"}]}, "authorList": {"author": [{"lastName": "Doe", "firstName": "J"}, {"collectiveName": "Group"}]}}
    return _parsed(spark, "europepmc", one, {"title": "U", "pubYear": "2021", "source": "PPR"}).select("id", "title", "year", "doi", "pmcid", "is_preprint", "pdf_url", "url", listed("authors").alias("authors"))


_ATOM = '<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/2101.00001v2</id><title>A  title\n here</title><summary> Sum. </summary><published>2021-01-03T00:00:00Z</published><author><name>Ann Bee</name></author><author><name>Cee Dee</name></author><category term="cs.LG"/><arxiv:doi>10.5/Z</arxiv:doi></entry>'


@case("arxiv string, title string, abstract string, year int, is_preprint boolean, published_version string, authors string, query string", ("2101.00001", "A title here", "Sum.", 2021, True, "10.5/z", "Ann Bee|Cee Dee", 'all:"deep learning" AND all:protein|ti:graph'))
def s18_arxiv(spark):
    """An Atom entry, and how queries are written for the service."""
    q = listed(F.array(*[F.lit(connectors.arxiv_query(x)) for x in ('"deep learning" of protein', "ti:graph")]))
    return _parsed(spark, "arxiv", _ATOM).select("arxiv", "title", "abstract", "year", "is_preprint", "published_version", listed("authors").alias("authors"), q.alias("query"))


@case("source string, title string, year int, kind string, authors string, note string",
      ("semanticscholar", "S2", 2019, "", "A B", "Review|Newsy"), ("dblp", "On graphs", 2015, "inproceedings", "Wei Wang|Li Li", "10.7/d"), ("inspire", "Quarks", 2001, "thesis", "Feyn, R.", "2001.5"), ("ntrs", "Wing", 1999, "conference_paper", "N. Asa", "x.pdf"),
      ("clinicaltrials", "Official", 2020, "trial_registration", "", "NCT1"), ("nasa_ads", "Star", 2010, "eprint", "Hub, E", "true"), ("ieee", "Chip", 2012, "conference_paper", "E E", "1-4"), ("core", "Open", 2018, "", "O A", "Univ"),
      ("sejm_eli", "Ustawa", 2004, "legislation", "", "DU/2004/535"), ("saos", "SENTENCE 2016-01-02 I C 1", 2016, "judgment", "J1|J2|J3|J4|J5", "tekst"), ("pubchem", "PubChem: Aspirin", None, "dataset", "", "MolecularFormula: C9H8O4."))
def s20_other_parsers(spark):
    """Eleven services' records (S20 to S28, S30, S31), with what is particular to each."""
    made = {
        "semanticscholar": ({"title": "S2", "year": 2019, "authors": [{"name": "A B"}], "publicationTypes": ["Review", "JournalArticle", "Newsy"]}, listed("pub_types")),
        "dblp": ({"title": "On graphs.", "year": "2015", "type": "Conference and Workshop Papers", "doi": "10.7/D", "authors": {"author": [{"text": "Wei Wang 0001"}, {"text": "Li Li"}]}}, F.col("doi")),
        "inspire": ({"titles": [{"title": "Quarks"}], "document_type": ["thesis", "article"], "earliest_date": "2001-02", "authors": [{"full_name": "Feyn, R."}], "arxiv_eprints": [{"value": "2001.5"}]}, F.col("arxiv")),
        "ntrs": ({"title": "Wing", "distributionDate": "1999-01-01", "stiType": "CONFERENCE_PAPER", "downloads": [{"mimetype": "text/plain", "links": {"original": "t"}}, {"mimetype": "application/pdf", "links": {"original": "x.pdf"}}], "authorAffiliations": [{"meta": {"author": {"name": "N. Asa"}}}]}, F.col("pdf_url")),
        "clinicaltrials": ({"protocolSection": {"identificationModule": {"nctId": "NCT1", "officialTitle": "Official", "briefTitle": "Brief"}, "statusModule": {"startDateStruct": {"date": "2020-05"}}}}, F.col("nct")),
        "nasa_ads": ({"title": ["Star"], "year": "2010", "author": ["Hub, E"], "doctype": "eprint"}, F.col("is_preprint").cast("string")),
        "ieee": ({"title": "Chip", "publication_year": 2012, "content_type": "Conferences", "start_page": "1", "end_page": "4", "authors": {"authors": [{"full_name": "E E"}]}}, F.col("pages")),
        "core": ({"title": "Open", "yearPublished": 2018, "authors": [{"name": "O A"}], "publisher": "Univ"}, F.col("publisher")),
        "sejm_eli": ({"title": "Ustawa", "publisher": "DU", "year": 2004, "pos": 535}, F.col("eli")),
        "saos": ({"judgmentType": "SENTENCE", "judgmentDate": "2016-01-02", "courtCases": [{"caseNumber": "I C 1"}], "judges": [{"name": f"J{k}"} for k in range(1, 8)], "textContent": "<p>tekst</p>"}, F.col("abstract")),
        "pubchem": ({"CID": "2244", "Title": "Aspirin", "MolecularFormula": "C9H8O4"}, F.col("abstract")),
    }
    out = None
    for name, (body, note) in made.items():
        one = _parsed(spark, name, body).select("source", "title", "year", "kind", listed("authors").alias("authors"), note.alias("note"))
        out = one if out is None else out.unionByName(one)
    return out


@case("country string, indicator string, abstract string, n long", ("DE", "GDP", "2000: 3.5; 2001: 1.23457e+06", 2), ("PL", "GDP", "1999: 0.000123", 1))
def s32_series(spark):
    """Values of a series by country, in order of years, to six significant digits."""
    d = spark.createDataFrame([("DE", "GDP", 2001, 1234567.8), ("DE", "GDP", 2000, 3.5), ("PL", "GDP", 1999, 0.000123), ("PL", "GDP", 2000, None)], "country string, indicator string, year int, value double")
    return payloads.series(d)


@case("id string, label string", ("a", "gdp growth annual / total"), ("c", "gdp per capita growth"))
def s33_indicators(spark):
    """Indicators whose names have all words; labels of a variable's levels."""
    d = spark.createDataFrame([("c", "GDP per capita growth", "", "gdp per capita growth"), ("b", "Inflation", "", ""), ("a", "GDP growth (annual)", "total", "gdp growth annual")], "id string, name string, n2 string, n1 string")
    return connectors.find_indicators(d, "gdp of growth").select("id", connectors.variable_label("n1", "n2").alias("label"))


@case("connector string, query string, place int, title string", ("openalex", "vitamin d", 1, "Vitamin D"), ("pubmed", "vitamin d", 1, "A trial of something."), ("sejm_eli", "ustawa o podatku dochodowym", 1, "Ustawa"), ("sejm_eli", "ustawa o podatku dochodowym", 2, "Inna"))
def s01_search_source(spark):
    """The search source (S01, S02, S05, S12) on canned replies: PubMed's two steps (S11), acts by their longest words without repeats (S29), hits with their ranks."""
    acts = [{"ELI": "DU/1", "title": "Ustawa", "publisher": "DU", "year": 2004, "pos": 1}, {"ELI": "DU/2", "title": "Inna", "publisher": "DU", "year": 2005, "pos": 2}]
    replies = [
        ["api.openalex.org/works?search=vitamin d&per-page=50", 200, json.dumps({"results": [_OPENALEX]})],
        ["esearch.fcgi?db=pubmed", 200, json.dumps({"esearchresult": {"idlist": ["111"]}})],
        ["efetch.fcgi?db=pubmed&id=111", 200, f"<PubmedArticleSet>{_PUBMED}</PubmedArticleSet>"],
        ["title=ustawa o podatku", 200, json.dumps({"items": []})],
        ["title=dochodow", 200, json.dumps({"items": acts[:1]})],
        ["title=podat", 200, json.dumps({"items": acts})],
    ]
    jobs = connectors.plan_jobs([{"id": "SQ1", "queries": ["vitamin d"], "connector_queries": {"sejm_eli": ["ustawa o podatku dochodowym"]}}], ["openalex", "pubmed", "sejm_eli"])
    connectors.register(spark)
    found = spark.read.format("scholarly").option("jobs", json.dumps([vars(j) for j in jobs])).option("replies", json.dumps(replies)).load()
    each = connectors.records(found)
    out = None
    for name in ("openalex", "pubmed", "sejm_eli"):
        one = payloads.parse(each.where(F.col("connector") == name), name).select("connector", "query", "place", "title")
        out = one if out is None else out.unionByName(one)
    return out


@case("connector string, query string, returned int, error string", ("crossref", "a b", 2, ""), ("dblp", "a b", 0, "status 404"), ("nasa_ads", "a b", 0, "ADS_API_TOKEN is not set"))
def z02_search_log(spark):
    """The log of a fan-out: what every query gave; errors and missing keys are rows, not failures."""
    replies = [["api.crossref.org", 200, json.dumps({"message": {"items": [{"title": ["x"]}, {"title": ["y"]}]}})]]
    os.environ.pop("ADS_API_TOKEN", None)
    jobs = connectors.plan_jobs([{"id": "SQ1", "queries": ["a b"]}], ["crossref", "dblp", "nasa_ads"])
    connectors.register(spark)
    found = spark.read.format("scholarly").option("jobs", json.dumps([vars(j) for j in jobs])).option("replies", json.dumps(replies)).load()
    return connectors.search_log(found).select("connector", "query", "returned", "error")


@case("kind string, requests int, first int, last int", ("openalex", 3, 50, 20), ("pubmed", 2, 150, 10))
def s06_batched_lookups(spark):
    """Ids in requests of 50, PubMed's in requests of 150."""
    rows = []
    for kind, n, glue in (("openalex", 120, "%7C"), ("pubmed", 160, "%2C")):
        urls = connectors.lookup_urls([str(k) for k in range(1000, 1000 + n)], kind)
        rows.append((kind, len(urls), urls[0].count(glue) + 1, urls[-1].count(glue) + 1))
    return spark.createDataFrame(rows, "kind string, requests int, first int, last int")


@case("step string, status int, waited string", ("ok after two refusals", 200, "2.0|4.0"), ("host says when", 200, "7.0"), ("not found", 404, ""), ("never up", 503, "2.0|4.0|8.0|16.0"), ("too long a wait", 200, "30.0"))
def s35_retries(spark):
    """Refusals for load are asked again, after the host's own delay or a doubling one, four times at most."""
    cases = {"ok after two refusals": [(429, b"", {}), (500, b"", {}), (200, b"", {})], "host says when": [(429, b"", {"retry-after": "7"}), (200, b"", {})], "not found": [(404, b"", {})], "never up": [(503, b"", {})] * 9, "too long a wait": [(503, b"", {"retry-after": "999"}), (200, b"", {})]}
    rows = []
    for name, answers in cases.items():
        waits, left = [], iter(answers)
        status, _ = connectors.fetch("u", lambda *_: next(left), waits.append)  # noqa: B023
        rows.append((name, status, "|".join(map(str, waits))))
    return spark.createDataFrame(rows, "step string, status int, waited string")


@case("doi string, body string", ("10.1/a", "x"))
def s15_by_doi(spark):
    """Landed payloads by DOI, however it is written; an unknown one has no row."""
    return connectors.by_doi(spark.createDataFrame([("10.1/A", "x"), ("10.1/b", "y")], "doi string, body string"), numbered(spark, "https://doi.org/10.1/a", "10.9/none", "").select(F.col("x").alias("doi")))


@case("pmcid string, body string", ("PMC7", "<article/>"))
def s17_fulltext_xml(spark):
    return connectors.fulltext_of(spark.createDataFrame([("PMC7", 200, "<article/>"), ("PMC8", 404, None)], "pmcid string, status int, body string"), spark.createDataFrame([("7",), ("8",)], "pmcid string"))


@case("url string, body string", ("u1", "new"), ("u3", "only"))
def s37_fresh_responses(spark):
    """The last good response of each address that is young enough."""
    d = spark.createDataFrame([("u1", 990.0, 200, "old"), ("u1", 995.0, 200, "new"), ("u2", 10.0, 200, "stale"), ("u3", 999.0, 200, "only"), ("u3", 1000.0, 500, "bad")], "url string, ts double, status int, body string")
    d = d.withColumns({"connector": F.lit("x"), "subq": F.lit(""), "query": F.lit("")})
    return connectors.fresh_responses(d, now=1000.0, ttl=100.0).select("url", "body")


@case("path string", ("a.pdf",), ("c.txt",))
def s38_downloads(spark):
    """Files that can be documents: no tiny ones, no web page that calls itself a PDF."""
    pdf, page, text = b"%PDF-1.4 " + b"x" * 2000, b"<!DOCTYPE html>" + b"x" * 2000, b"plain " * 400
    rows = [("a.pdf", len(pdf), pdf), ("b.pdf", len(page), page), ("c.txt", len(text), text), ("d.pdf", 4, b"%PDF"), ("e.pdf", len(text), text)]
    return connectors.acceptable_downloads(spark.createDataFrame([(p, n, bytearray(b)) for p, n, b in rows], "path string, length long, content binary")).select("path")


@case("position int, kind string, loc string, body string", (0, "abstract", "abstract", "Why and how."), (1, "sec", "sec. Methods", "We did."), (2, "sec", "sec. Methods › Sample", "Ten people."), (3, "table", "Table 1", "Doses\na | b\n1 | 2"), (4, "figure", "Figure 1", "A plot."), (5, "funding", "funding", "Paid by us."), (6, "ack", "ack", "Thanks."), (7, "coi", "coi", "None."))
def s40_jats(spark):
    """A JATS article: sections under their paths, tables as rows, figures, funding, interests, thanks; texts of elements collapsed."""
    xml = "<article><front><abstract><p>Why and\n how.</p></abstract></front><body><sec><title>Methods</title><p>We <b>did</b>.</p><sec><title>Sample</title><p>Ten people.</p><table-wrap><label>Table 1</label><caption><p>Doses</p></caption><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></table-wrap><fig><label>Figure 1</label><caption><p>A plot.</p></caption></fig></sec></sec></body><back><funding-statement>Paid by us.</funding-statement><ack><p>Thanks.</p></ack><fn-group><fn fn-type=\"conflict\"><p>None.</p></fn></fn-group></back></article>"
    fulltext.register(spark)
    numbered(spark, xml).createOrReplaceTempView("veriloom_case_jats")
    return spark.sql("SELECT p.position, p.kind, p.loc, p.text AS body FROM veriloom_case_jats d, LATERAL parse_jats(d.x) p")


@case("key string, loc string, body string", ("a", "part 1", "one\n\ntwo"), ("a", "part 2", "three"))
def s41_plain_parts(spark):
    return fulltext.plain_parts(spark.createDataFrame([("a", "one\n\ntwo\n\n\nthree")], "key string, text string")).select("key", "loc", F.col("text").alias("body"))


@case("key string, source string, path string, urls string", ("a", "pmc", "a.xml", "u|v"), ("b", "user", "b.pdf", "u|v"))
def s42_pick_text(spark):
    """The first acceptable text of a work in the order of sources; its candidate addresses once each."""
    d = spark.createDataFrame([("a", "oa", True, "a.pdf"), ("a", "pmc", True, "a.xml"), ("a", "user", False, "no"), ("b", "user", True, "b.pdf"), ("b", "pmc", True, "b.xml")], "key string, source string, accepted boolean, path string")
    urls = fulltext.pdf_candidates(F.lit("u"), F.lit(""), F.lit("v"), F.lit("u"))
    return fulltext.pick_text(d).select("key", "source", "path", listed(urls).alias("urls"))


@case("id int, same boolean, doi_found string", (1, True, ""), (2, False, ""), (3, True, "10.1000/xyz"))
def s43_same_document(spark):
    """By the title on the first pages, or the DOI there."""
    d = spark.createDataFrame([(1, "Vitamin D supplementation prevents infections", "10.1/none", "Vitamin D supplementation prevents infections in adults"), (2, "Vitamin D supplementation prevents infections", "10.1/none", "Bridges under heavy load"), (3, "Another title of it", "10.1000/XYZ", "see doi 10.1000/xyz, page 1")], "id int, title string, doi string, first_pages string")
    return fulltext.same_document(d).select("id", "same", fulltext.doi_in_text("first_pages").alias("doi_found"))


@case("key string, path string", ("smith2019", "/t/smith2019.pdf"), ("x2020", "/t/10-1000-x.txt"))
def s45_user_files(spark):
    files = spark.createDataFrame([("/t/smith2019.pdf",), ("/t/10-1000-x.txt",), ("/t/other.pdf",)], "path string")
    return fulltext.user_files(files, spark.createDataFrame([("smith2019", ""), ("x2020", "10.1000/x")], "key string, doi string"))


def _file(name: str, body: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="veriloom-case-"), name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
    return path


@case("key string, stage string, decision string, reason string", ("a", "ta", "include", ""), ("b", "ft", "exclude", "wrong design"), ("c", "ta", "maybe", ""))
def s49_screening_files(spark):
    """Decisions from a JSON list and from a CSV with a header."""
    one = imports.screening_file(spark, _file("d.json", json.dumps([{"key": "a", "decision": "Include"}, {"key": "b", "stage": "ft", "decision": "exclude", "reason": "wrong design"}, {"decision": "exclude"}])))
    return one.unionByName(imports.screening_file(spark, _file("d.csv", "key,decision\nc,maybe\n")))


@case("key string, field string, value string, quote string, loc string", ("a", "design", "RCT", "", ""), ("a", "n", "120", "120 adults", "p. 2"))
def s50_extraction_file(spark):
    return imports.extraction_file(spark, _file("e.json", json.dumps({"studies": {"a": {"design": "RCT", "n": {"value": "120", "quote": "120 adults", "loc": "p. 2"}, "_note": "x"}, "_help": {"design": "y"}}})))


@case("claim string, key string, problem string", ("C1", "a", ""), ("C9", "a", "unknown claim"), ("C1", "z", "unknown source"), ("C1", "b", "unknown stance"))
def v10_checked_evidence(spark):
    rows = spark.createDataFrame([("C1", "a", "for"), ("C9", "a", "for"), ("C1", "z", "for"), ("C1", "b", "perhaps")], "claim string, key string, stance string")
    return imports.checked_evidence(rows, spark.createDataFrame([("C1",)], "claim_id string"), spark.createDataFrame([("a",), ("b",)], "key string")).select("claim", "key", "problem")


@case("key string, field string, value string, first string", ("a", "n", "12", "10"), ("a", "x", "1", "1"), ("b", "n", "5", "5"))
def k15_upserts(spark):
    """The last write of a cell stays; an identifier's first writer stays (R07's rule)."""
    shape = "key string, field string, value string, id int"
    now, new = spark.createDataFrame([("a", "n", "10", 1), ("b", "n", "5", 2)], shape), spark.createDataFrame([("a", "n", "12", 3), ("a", "x", "1", 4)], shape)
    last = imports.upsert(now, new, ["key", "field"], "id").select("key", "field", "value")
    return last.join(imports.first_wins(now, new, ["key", "field"], "id").select("key", "field", F.col("value").alias("first")), ["key", "field"])


@case("loc string", ("p. 2",))
def p10_show_filters(spark):
    pages = spark.createDataFrame([("p. 1", "Dose and effect"), ("p. 2", "The EFFECT size"), ("abstract", "effect")], "loc string, text string")
    return imports.shown(pages.where("loc <> 'p. 1'"), loc="P.", grep="effect").select("loc")


@case("key string, depth string, body string, funding string", ("a", "fulltext", "T\nA\none\ntwo", "a longer note"), ("b", "abstract", "U\nB", "kept"), ("c", "metadata", "V", ""))
def v05_source_texts(spark):
    """Title, abstract and pages of a work, and how deep its text goes; of two notes the longer stands."""
    works = spark.createDataFrame([("a", "T", "A", "note", "a longer note"), ("b", "U", "B", "kept", "x"), ("c", "V", "", "", None)], "key string, title string, abstract string, old string, new string")
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "key string, page int, text string")
    return fulltext.source_texts(works, pages).join(works.select("key", fulltext.longer(F.col("old"), F.col("new")).alias("funding")), "key").select("key", "depth", F.col("text").alias("body"), "funding")
