"""The fetch side: planned search jobs as a Python data source, one partition a host, with paced retries and a response table.

Bodies land in a table (connector, query, url, ts, status, body) that the parsers read; a response younger than its time to
live is taken from there. The transport is a parameter, so the source works without a network in tests.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

from veriloom.functions.identity import norm_doi, norm_id

RETRIES, FIRST_DELAY, LONGEST_DELAY, TIMEOUT = 4, 2.0, 30.0, 40.0
#: Seconds that a response stays fresh: of searches, of anything else.
SEARCH_TTL, TTL = 3 * 86400, 7 * 86400


@dataclass(frozen=True)
class Service:
    """How a host is asked: its address, seconds between two requests, the names of the parameters for the query and the number of records with the most that it gives, what is always sent, where the first year goes, and where the records lie in a reply."""

    url: str
    pause: float
    query: str
    limit: str
    most: int
    always: dict[str, str] = field(default_factory=dict)
    since: tuple[str, str] | None = None
    #: What the query becomes with a first year, for hosts that take it there.
    written: str = ""
    items: str = ""
    key: str = ""


# The services and their parameters; `written` and `since` take the year, its predecessor as {before}.
SERVICES = {
    "openalex": Service("https://api.openalex.org/works", 0.15, "search", "per-page", 200, {}, ("filter", "from_publication_date:{year}-01-01"), items="$.results"),
    "crossref": Service("https://api.crossref.org/works", 0.1, "query.bibliographic", "rows", 1000, {}, ("filter", "from-pub-date:{year}-01-01"), items="$.message.items"),
    "europepmc": Service("https://www.ebi.ac.uk/europepmc/webservices/rest/search", 0.25, "query", "pageSize", 1000, {"format": "json", "resultType": "core"}, None, "({q}) AND FIRST_PDATE:[{year}-01-01 TO 3000-12-31]", "$.resultList.result"),
    "pubmed": Service("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", 0.4, "term", "retmax", 10000, {"db": "pubmed", "retmode": "json", "sort": "relevance"}, ("datetype=pdat&maxdate=3000/12/31&mindate", "{year}/01/01")),
    "arxiv": Service("https://export.arxiv.org/api/query", 3.1, "search_query", "max_results", 200, {"sortBy": "relevance"}),
    "semanticscholar": Service("https://api.semanticscholar.org/graph/v1/paper/search", 1.1, "query", "limit", 100, {}, ("year", "{year}-"), items="$.data"),
    "dblp": Service("https://dblp.org/search/publ/api", 1.0, "q", "h", 1000, {"format": "json"}, items="$.result.hits.hit"),
    "inspire": Service("https://inspirehep.net/api/literature", 0.4, "q", "size", 250, {"sort": "mostcited"}, None, "{q} and date > {before}", "$.hits.hits"),
    "ntrs": Service("https://ntrs.nasa.gov/api/citations/search", 0.5, "q", "page.size", 100, {}, ("published.gte", "{year}-01-01"), items="$.results"),
    "clinicaltrials": Service("https://clinicaltrials.gov/api/v2/studies", 0.3, "query.term", "pageSize", 100, {"countTotal": "true"}, ("filter.advanced", "AREA[StartDate]RANGE[{year}-01-01,MAX]"), items="$.studies"),
    "nasa_ads": Service("https://api.adsabs.harvard.edu/v1/search/query", 0.5, "q", "rows", 200, {"fl": "title,author,year,pub,doi,identifier,abstract,citation_count,doctype,property,bibcode"}, None, "{q} year:{year}-3000", "$.response.docs", "ADS_API_TOKEN"),
    "ieee": Service("https://ieeexploreapi.ieee.org/api/v1/search/articles", 0.5, "querytext", "max_records", 200, {"format": "json"}, ("start_year", "{year}"), items="$.articles", key="IEEE_API_KEY"),
    "core": Service("https://api.core.ac.uk/v3/search/works", 1.0, "q", "limit", 100, {}, None, "{q} AND yearPublished>={year}", "$.results", "CORE_API_KEY"),
    "sejm_eli": Service("https://api.sejm.gov.pl/eli/acts/search", 0.3, "title", "limit", 500, {}, ("dateFrom", "{year}-01-01"), items="$.items"),
    "saos": Service("https://www.saos.org.pl/api/search/judgments", 0.5, "all", "pageSize", 100, {"sortingField": "JUDGMENT_DATE", "sortingDirection": "DESC"}, ("judgmentDateFrom", "{year}-01-01"), items="$.items"),
    "pubchem": Service("https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound/name", 0.25, "", "", 1, items="$.PropertyTable.Properties"),
    "worldbank": Service("https://api.worldbank.org/v2/country", 0.25, "", "per_page", 2000, {"format": "json"}, items="$[1]"),
    "gus_bdl": Service("https://bdl.stat.gov.pl/api/v1/variables/search", 0.3, "name", "page-size", 40, {"format": "json", "lang": "pl"}, items="$.results"),
}
KEYED = {name: s.key for name, s in SERVICES.items() if s.key}
#: Records of one lookup request: by ids of a catalogue, by PubMed numbers.
LOOKUP, PMIDS = 50, 150


@dataclass
class Job:
    connector: str
    query: str
    limit: int = 50
    since: int | None = None
    subq: str = ""


def plan_jobs(subqs: list[dict], connectors: list[str], limit: int = 50, since: int | None = None, tiers: dict[str, str] | None = None) -> list[Job]:
    """Every sub-question's queries on every connector (a connector's own queries replace the common ones), and for connectors with a tier, the query narrowed to it as well."""
    jobs = []
    for s in subqs:
        for c in connectors:
            for q in (s.get("connector_queries") or {}).get(c) or s.get("queries") or []:
                jobs.append(Job(c, q, limit, since, s.get("id", "")))
                if c in (tiers or {}):
                    jobs.append(Job(c, f"({q}) AND {tiers[c]}", limit, since, s.get("id", "")))
    return list({(j.connector, j.query, j.subq): j for j in jobs}.values())


def arxiv_query(q: str) -> str:
    """Phrases and words of three letters and more, joined by AND; a query with fields stays."""
    import re

    if re.search(r"\b(?:all|ti|abs|au|cat):", q):
        return q
    parts = [a or b for a, b in re.findall(r'"([^"]+)"|(\w{3,})', q)]
    return " AND ".join(f'all:"{p}"' if " " in p else f"all:{p}" for p in parts if p.lower() not in ("and", "not"))


def relaxed_query(q: str) -> str:
    """The three longest words of seven letters and more, two letters shorter: for a phrase of three words and more without hits."""
    import re

    words = sorted(set(re.findall(r"[^\W\d_]{7,}", q.lower())), key=lambda w: (-len(w), w))
    return " ".join(w[:-2] for w in words[:3]) if len(q.split()) >= 3 else ""


#: (status, body, headers with lower-case names) of a URL and what is sent with it.
Transport = Callable[[str, dict], tuple[int, bytes, dict]]


def urllib_transport(url: str, headers: dict) -> tuple[int, bytes, dict]:
    low = lambda h: {k.lower(): v for k, v in h.items()}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as r:
            return r.status, r.read(), low(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read(), low(e.headers)


def canned_transport(replies: list) -> Transport:
    """Answers from a list of [part of the URL, status, body], the first that fits, for use without a network; nothing fits: 404."""

    def answer(url: str, headers: dict) -> tuple[int, bytes, dict]:
        plain = urllib.parse.unquote_plus(url)
        return next(((status, body.encode(), {}) for part, status, body in replies if part in plain), (404, b"", {}))

    return answer


def fetch(url: str, transport: Transport, sleep: Callable[[float], None] = time.sleep, headers: dict | None = None) -> tuple[int, bytes]:
    """Retries refusals for load and server errors, waiting as long as the host asks for, else twice as long each time, LONGEST_DELAY at most."""
    delay = FIRST_DELAY
    for k in range(RETRIES + 1):
        try:
            status, body, said = transport(url, headers or {})
        except OSError as e:
            status, body, said = 0, str(e).encode(), {}
        if status and status != 429 and status < 500 or k == RETRIES:
            return status, body
        asked = str(said.get("retry-after", ""))
        sleep(min(float(asked) if asked.isdigit() else delay, LONGEST_DELAY))
        delay *= 2
    raise AssertionError


def request_url(job: Job) -> str:
    """The address that a job's search asks; a connector that has the first year in its query gets it there."""
    s = SERVICES[job.connector]
    if job.connector == "pubchem":
        name = job.query.strip()
        base = s.url.removesuffix("/name") if name.isdigit() else s.url
        return f"{base}/{'cid/' if name.isdigit() else ''}{urllib.parse.quote(name)}/property/Title,MolecularFormula,MolecularWeight/JSON"
    limit = {s.limit: str(min(job.limit, s.most))}
    if job.connector == "worldbank":
        indicator, countries, first, last = series_request(job.query, job.since or 2000)
        return f"{s.url}/{';'.join(countries)}/indicator/{indicator}?" + urllib.parse.urlencode(s.always | {s.limit: str(s.most), "date": f"{first}:{last or 2100}"})
    q = arxiv_query(job.query) if job.connector == "arxiv" else job.query
    if job.connector == "openalex":
        q = " ".join(q.replace("?", " ").replace("*", " ").split())  # wildcards there
    years = {"year": job.since, "before": (job.since or 0) - 1, "q": q}
    if job.connector == "europepmc" and not job.since:
        q = f"({q})"
    params = s.always | {s.query: s.written.format(**years) if s.written and job.since else q} | limit
    if s.since and job.since:
        *fixed, name = s.since[0].split("&")
        params |= dict(x.split("=") for x in fixed) | {name: s.since[1].format(**years)}
    return f"{s.url}?{urllib.parse.urlencode(params)}"


def lookup_urls(ids: list[str], kind: str = "openalex") -> list[str]:
    """Requests for many records at once: LOOKUP ids of the catalogue (openalex, doi, pmid) a request, or PMIDS articles (pubmed)."""
    if kind == "pubmed":
        return [f"https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?{urllib.parse.urlencode({'db': 'pubmed', 'id': ','.join(ids[k : k + PMIDS]), 'retmode': 'xml'})}" for k in range(0, len(ids), PMIDS)]
    return [f"{SERVICES['openalex'].url}?{urllib.parse.urlencode({'filter': f'{kind}:' + '|'.join(ids[k : k + LOOKUP]), 'per-page': LOOKUP})}" for k in range(0, len(ids), LOOKUP)]


def searched(job: Job, transport: Transport, sleep: Callable[[float], None] = time.sleep) -> list[tuple[str, int, bytes]]:
    """(url, status, body) of everything that a job asks: one search; PubMed's numbers, then its articles; for acts without a hit, their longest words."""
    import json
    import os

    service = SERVICES[job.connector]
    key = os.environ.get(service.key, "") if service.key else ""
    if service.key and not key:
        return [("", 0, f"{service.key} is not set".encode())]
    headers = {"Authorization": f"Bearer {key}"} if key and job.connector != "ieee" else {}
    ask = lambda url: (url, *fetch(url, transport, sleep, headers))
    first = ask(request_url(job) + (f"&apikey={key}" if job.connector == "ieee" else ""))
    if first[1] != 200 or job.connector not in ("pubmed", "sejm_eli"):
        return [first]
    reply = json.loads(first[2] or b"{}")
    out = []
    if job.connector == "pubmed":
        for url in lookup_urls((reply.get("esearchresult") or {}).get("idlist") or [], "pubmed"):
            sleep(service.pause)
            out.append(ask(url))
    elif not reply.get("items"):
        for word in relaxed_query(job.query).split():
            sleep(service.pause)
            out.append(ask(request_url(Job("sejm_eli", word, max(5, job.limit // 3), job.since))))
    return out or [first]


class HostPartition(InputPartition):
    """All jobs of one host, so that no two tasks ask it at once."""

    def __init__(self, connector: str, jobs: list[Job]) -> None:
        super().__init__(None)
        self.connector, self.jobs = connector, jobs


class SearchReader(DataSourceReader):
    def __init__(self, options) -> None:
        import json

        self.jobs = [Job(**j) for j in json.loads(options.get("jobs", "[]"))]
        replies = options.get("replies", "")
        self.replies = json.loads(replies) if replies else None

    def partitions(self):
        by: dict[str, list[Job]] = {}
        for j in self.jobs:
            by.setdefault(j.connector, []).append(j)
        return [HostPartition(c, js) for c, js in sorted(by.items())] or [HostPartition("", [])]

    def read(self, partition):
        transport = urllib_transport if self.replies is None else canned_transport(self.replies)
        sleep = time.sleep if self.replies is None else lambda _: None
        for j in partition.jobs:
            for url, status, body in searched(j, transport, sleep):
                text = body.decode("utf-8", "replace")
                yield j.connector, j.subq, j.query, url, time.time(), status, "" if status == 200 else text[:200] or f"status {status}", text if status == 200 else None
                sleep(SERVICES[j.connector].pause)


class SearchSource(DataSource):
    """format("scholarly"), option jobs: a JSON list of jobs; option replies: canned answers instead of the network. An error is a row."""

    @classmethod
    def name(cls):
        return "scholarly"

    def schema(self):
        return "connector string, subq string, query string, url string, ts double, status int, error string, body string"

    def reader(self, schema):
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)


def records(responses: DataFrame) -> DataFrame:
    """(connector, subq, query, place, body): the records of good replies, numbered in each query from 1; an act that several requests give counts once."""
    lists = F.lit(None).cast("array<string>")
    for name, service in SERVICES.items():
        if service.items:
            lists = F.when(F.col("connector") == name, F.from_json(F.get_json_object("body", service.items), "array<string>")).otherwise(lists)
    lists = F.when(F.col("connector") == "arxiv", F.regexp_extract_all("body", F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1))).when(F.col("connector") == "pubmed", F.regexp_extract_all("body", F.lit(r"(?s)(<PubmedArticle\b.*?</PubmedArticle>)"), F.lit(1))).otherwise(lists)
    each = responses.where("status = 200").select("connector", "subq", "query", "url", F.posexplode(lists).alias("at", "body"))
    inner = F.when(F.col("connector") == "dblp", F.get_json_object("body", "$.info")).when(F.col("connector") == "inspire", F.get_json_object("body", "$.metadata")).otherwise(F.col("body"))
    each = each.withColumn("body", inner)
    same = F.when(F.col("connector") == "sejm_eli", F.get_json_object("body", "$.ELI"))
    own = W.partitionBy("connector", "subq", "query")
    each = each.withColumn("copy", F.row_number().over(W.partitionBy("connector", "subq", "query", F.coalesce(same, F.concat_ws("#", "url", "at"))).orderBy("url", "at"))).where("copy = 1")
    return each.withColumn("place", F.row_number().over(own.orderBy("url", "at"))).select("connector", "subq", "query", "place", "body")


def search_log(responses: DataFrame) -> DataFrame:
    """(connector, subq, query, returned, error): what every query gave; an error is logged, not raised."""
    found = records(responses).groupBy("connector", "subq", "query").agg(F.count("*").alias("returned"))
    asked = responses.groupBy("connector", "subq", "query").agg(F.max("error").alias("error"))
    return asked.join(found, ["connector", "subq", "query"], "left").select("connector", "subq", "query", F.coalesce("returned", F.lit(0)).alias("returned"), "error")


def by_doi(payloads: DataFrame, dois: DataFrame) -> DataFrame:
    """Landed payloads (doi, body) of asked DOIs; one that is not there has no row."""
    asked = dois.select(norm_doi("doi").alias("doi")).where("doi <> ''").distinct()
    return payloads.withColumn("doi", norm_doi("doi")).join(asked, "doi", "left_semi")


def fulltext_of(payloads: DataFrame, pmcids: DataFrame) -> DataFrame:
    """(pmcid, body): landed full-text XML of PMC articles, bare numbers too."""
    norm = lambda df: df.withColumn("pmcid", norm_id(F.lit("pmcid"), F.col("pmcid")))
    return norm(payloads.where("status = 200")).join(norm(pmcids).select("pmcid").distinct(), "pmcid", "left_semi").select("pmcid", "body")


def fresh_responses(responses: DataFrame, now: float, ttl: float = SEARCH_TTL) -> DataFrame:
    """The last good response of each URL that is young enough; a negative time to live never ends."""
    good = responses.where("status = 200")
    if ttl >= 0:
        good = good.where(F.col("ts") > now - ttl)
    return good.groupBy("url").agg(F.max_by(F.struct("connector", "subq", "query", "ts", "body"), "ts").alias("r")).select("url", "r.*")


def acceptable_downloads(files: DataFrame, least: int = 1000, most: int = 80_000_000) -> DataFrame:
    """Rows of binaryFile that can be documents: neither tiny nor huge, PDFs by their first bytes, no web pages in their place."""
    head = F.substring("content", 1, 512)
    is_pdf = F.hex(F.substring("content", 1, 4)) == "25504446"
    page = F.lower(F.decode(head, "ISO-8859-1")).rlike(r"<!doctype html|<html")
    return files.where(F.col("length").between(least, most) & (is_pdf | ~F.lower("path").endswith(".pdf")) & ~page)


def series_request(q: str, first: int = 1990) -> tuple[str, list[str], int, int | None]:
    """(indicator, countries, first year, last year) of "INDICATOR@C1;C2:Y0-Y1"; without countries: all; without years: from `first` on."""
    import re

    m = re.fullmatch(r"\s*([\w.]+)(?:@([\w;]+))?(?::(\d{4})(?:-(\d{4}))?)?\s*", q)
    if not m:
        raise ValueError(f"not a series: {q!r}")
    return m[1], (m[2] or "all").split(";"), int(m[3] or first), int(m[4]) if m[4] else None


def find_indicators(indicators: DataFrame, q: str, most: int = 30) -> DataFrame:
    """The first indicators (id, name) whose name has every word of three letters and more."""
    out = indicators
    for w in (w for w in q.lower().split() if len(w) > 2):
        out = out.where(F.lower("name").contains(w))
    return out.orderBy("id").limit(most)


def variable_label(*parts: str):
    """Names of a variable's levels, joined; empty ones leave no trace."""
    return F.concat_ws(" / ", *[F.nullif(F.col(p), F.lit("")) for p in parts])
