import json

from pyspark.sql import functions as F

from veriloom.functions import export
from veriloom.plans import render
from veriloom.sources import connectors, payloads


def _parse(spark, connector, body):
    return payloads.parse(spark.createDataFrame([(1, body)], "id int, body string"), connector).first()


def test_openalex(spark):
    body = {"id": "https://openalex.org/w1", "doi": "https://doi.org/10.1/X", "display_name": "A <i>title</i>", "publication_year": 2020, "type": "article", "authorships": [{"author": {"display_name": "Ann Smith"}}], "primary_location": {"source": {"display_name": "Repo", "type": "repository"}}, "locations": [{"source": {"display_name": "BMJ", "type": "journal"}}], "abstract_inverted_index": {"world": [1], "Hello": [0]}, "biblio": {"first_page": "1", "last_page": "9"}, "topics": [{"display_name": x} for x in "abcd"], "referenced_works": ["https://openalex.org/W7"]}
    r = _parse(spark, "openalex", json.dumps(body))
    assert (r["title"], r["year"], r["doi"], r["openalex"], r["venue"], r["pages"], r["abstract"]) == ("A title", 2020, "10.1/x", "W1", "BMJ", "1-9", "Hello world")
    assert r["topics"] == ["a", "b", "c"] and r["references"] == ["openalex:W7"] and not r["is_preprint"]


def test_crossref(spark):
    body = {"DOI": "10.1/Y", "title": ["Main"], "subtitle": ["Sub"], "issued": {"date-parts": [[2019, 3]]}, "type": "posted-content", "author": [{"family": "Xu", "given": "Chen"}, {"name": "Group"}], "updated-by": [{"type": "retraction", "DOI": "10.1/r"}], "relation": {"is-preprint-of": [{"id": "10.1/Z"}]}}
    r = _parse(spark, "crossref", json.dumps(body))
    assert (r["title"], r["date"], r["year"], r["authors"], r["is_preprint"], r["is_retracted"], r["published_version"]) == ("Main: Sub", "2019-03", 2019, ["Xu, Chen", "Group"], True, True, "10.1/z")


def test_pubmed(spark):
    body = """<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><Volume>3</Volume><PubDate><MedlineDate>2018 Spring</MedlineDate></PubDate></JournalIssue><Title>BMJ</Title></Journal><ArticleTitle>On <i>x</i></ArticleTitle>
    <Abstract><AbstractText Label="RESULTS">Good &lt; bad.</AbstractText><AbstractText>More.</AbstractText></Abstract><AuthorList><Author><LastName>Xu</LastName><ForeName>Chen</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
    <ELocationID EIdType="doi">10.1/P</ELocationID><PublicationTypeList><PublicationType>Meta-Analysis</PublicationType></PublicationTypeList></Article><CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"/></CommentsCorrectionsList></MedlineCitation></PubmedArticle>"""
    r = _parse(spark, "pubmed", body)
    assert (r["pmid"], r["title"], r["abstract"], r["year"], r["doi"], r["authors"], r["is_retracted"], r["pub_types"]) == ("12", "On x", "RESULTS: Good < bad. More.", 2018, "10.1/p", ["Xu, Chen", "Group"], True, ["Meta-Analysis"])


def test_arxiv_and_others(spark):
    r = _parse(spark, "arxiv", '<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/2101.00001v2</id><title>T\n x</title><summary>S</summary><published>2021-01-01T00:00:00Z</published><author><name>A B</name></author></entry>')
    assert (r["arxiv"], r["title"], r["year"], r["is_preprint"], r["authors"]) == ("2101.00001", "T x", 2021, True, ["A B"])
    r = _parse(spark, "clinicaltrials", json.dumps({"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "b"}, "statusModule": {"startDateStruct": {"date": "2015-02"}}}}))
    assert (r["nct"], r["title"], r["year"], r["kind"]) == ("NCT1", "b", 2015, "trial_registration")
    r = _parse(spark, "dblp", json.dumps({"title": "X.", "authors": {"author": {"text": "Ann Smith 0001"}}, "year": "2020", "type": "Journal Articles"}))
    assert (r["title"], r["authors"], r["kind"]) == ("X", ["Ann Smith"], "journal-article")
    r = _parse(spark, "saos", json.dumps({"judgmentType": "SENTENCE", "judgmentDate": "2010-01-02", "courtCases": [{"caseNumber": "I C 1/10"}], "judges": [{"name": str(k)} for k in range(7)]}))
    assert r["title"] == "SENTENCE 2010-01-02 I C 1/10" and len(r["authors"]) == 5
    for name in payloads.PARSERS:
        for body in ("{}", "", "not json", "<x/>"):
            if name in ("arxiv", "pubmed") and not body.startswith("<"):
                continue
            assert _parse(spark, name, body) is not None


def test_series(spark):
    rows = spark.createDataFrame([("PL", "i", 2001, 3.5), ("PL", "i", 2000, 1234567.0), ("PL", "i", 2002, None)], "country string, indicator string, year int, value double")
    assert payloads.series(rows).first()["abstract"].startswith("2000: 1") and payloads.series(rows).first()["abstract"].endswith("2001: 3.5")


def test_jobs_and_retries():
    jobs = connectors.plan_jobs([{"id": "1", "queries": ["a"], "connector_queries": {"arxiv": ["b"]}}], ["openalex", "arxiv"], tiers={"openalex": "type:review"})
    assert [(j.connector, j.query) for j in jobs] == [("openalex", "a"), ("openalex", "(a) AND type:review"), ("arxiv", "b")]
    answers = iter([(429, b"", {}), (500, b"", {}), (200, b"ok", {})])
    waits = []
    assert connectors.fetch("u", lambda *_: next(answers), waits.append) == (200, b"ok") and waits == [2.0, 4.0]
    assert connectors.fetch("u", lambda *_: (404, b"no", {}), waits.append) == (404, b"no")
    assert connectors.arxiv_query('"vitamin d" of cells') == 'all:"vitamin d" AND all:cells'


def test_cache(spark):
    rows = spark.createDataFrame([("u", "c", "s", "q", 10.0, 200, "old"), ("u", "c", "s", "q", 20.0, 200, "new"), ("v", "c", "s", "q", 20.0, 500, None)], "url string, connector string, subq string, query string, ts double, status int, body string")
    assert [r["body"] for r in connectors.fresh_responses(rows, 25.0, 10.0).collect()] == ["new"]
    assert connectors.fresh_responses(rows, 99.0, 10.0).count() == 0 and connectors.fresh_responses(rows, 99.0, -1).count() == 1


def test_exports(spark):
    w = spark.createDataFrame([("k1", "rct", "T & t", ["Smith, Ann", "Group"], 2020, "BMJ", "7", "", "1-9", "10.1/X", "")], "key string, design string, title string, authors array<string>, year int, venue string, volume string, issue string, pages string, doi string, url string")
    b, r, c = w.select(export.bibtex(), export.ris(), export.csl_json()).first()
    assert b.startswith("@article{k1,") and "pages = {1--9}" in b and "number" not in b
    assert r.startswith("TY  - JOUR\nAU  - Smith, Ann\nAU  - Group") and r.endswith("ER  - \n")
    assert json.loads(c)["author"] == [{"family": "Smith", "given": "Ann"}, {"literal": "Group"}]


def test_render(spark):
    df = spark.createDataFrame([("a|b", 1)], "x string, y int")
    assert "| a\\|b | 1 |" in render.table(df) and render.table(df, "csv") == "x,y\na|b,1\n" and "<td>a|b</td>" in render.table(df, "html")
    out = render.render_draft("One [@b]. Two [@a; @b, p. 3].", {"a": "A ref", "b": "B ref"})
    assert out.startswith("One [1]. Two [2; 1, p. 3].") and out.index("1. B ref") < out.index("2. A ref")
    assert "<svg" in render.flow_svg({"identified": 3}) and "Identified: 3" in render.flow_svg({"identified": 3})


def test_streaming_watch(spark, tmp_path):
    from veriloom.streaming import watch

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 1)], "key string, v int").coalesce(1).write.parquet(src)
    spark.createDataFrame([("seen", 0)], "key string, v int").write.parquet(out)
    run = lambda: watch.watch_into(watch.replay(spark, src, "key string, v int"), lambda: spark.read.parquet(out), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("b", 2), ("c", 2), ("seen", 2)], "key string, v int").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "seen"]


def test_series_requests_and_indicators(spark):
    assert connectors.series_request("SP.POP@PL;DE:2000-2010") == ("SP.POP", ["PL", "DE"], 2000, 2010)
    assert connectors.series_request("SP.POP") == ("SP.POP", ["all"], 1990, None)
    df = spark.createDataFrame([("a", "GDP per capita"), ("b", "GDP growth"), ("c", "Capita income")], "id string, name string")
    assert [r["id"] for r in connectors.find_indicators(df, "gdp per capita").collect()] == ["a"]


def test_html(spark):
    out = render.markdown_html("# T\n\nA **b** [x](u)\n\n- i\n- j\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert "<h1>T</h1>" in out and "<strong>b</strong>" in out and '<a href="u">x</a>' in out and "<li>i</li><li>j</li>" in out and "<td>2</td>" in out
    assert render.placeholder("none x", {}) == "*(no table none)*" and render.label("Year", "pl") == "Rok"
    assert '<mark title="bad">' in render.highlighted([{"line": 1, "sentence": "S"}], {1: ["bad"]})
