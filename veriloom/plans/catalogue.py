"""The engine's operators as queries over the driver's tables, and the SQL that each is held against.

documents play works and sources, benchmark the anchor quotes, labels the votes and screening, conversations the drafts,
pages the raw payloads, events the logs, lineitem and orders the cells and edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from veriloom.functions import export, identity, scan, text
from veriloom.functions.words import POLISH, STOP_EN, STOP_PL, SUFFIXES
from veriloom.operators import design, evidence, incremental, resolve, retrieval, screening, tables, verify
from veriloom.plans import cases, cases_sources, cases_work, packs, session  # noqa: F401
from veriloom.sources import payloads
from veriloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_t = session.table


# ---- SQL pieces

FOLD = r"""trim(regexp_replace(regexp_replace(lower({0}), '["''`*_\[\]()]', '', 'g'), '\s+', ' ', 'g'))"""
WORDS = r"""regexp_extract_all(lower({0}), '[\p{{L}}](?:[\p{{L}}\p{{N}}]|[''\-][\p{{L}}])*')"""


def _quoted(words_: frozenset[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words_))


def _stem_sql(w: str) -> str:
    steps = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {3 + len(s)} THEN substr({w}, 1, least(length({w}) - {len(s)}, 7))" for s in SUFFIXES)
    return f"CASE WHEN length({w}) <= 3 THEN {w} {steps} ELSE substr({w}, 1, 7) END"


STOP_SQL = _quoted(STOP_EN | STOP_PL)


def _tokens_sql(c: str) -> str:
    return f"list_transform(list_filter({WORDS.format(c)}, lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL})), lambda w: {_stem_sql('w')})"


OVERLAP = """
    CASE WHEN len(q) = 0 THEN 0.0 WHEN len(q) < 2 THEN CAST(one AS DOUBLE)
         ELSE least(CAST(1 AS DOUBLE), CAST(0.8 AS DOUBLE) * one + CAST(0.2 AS DOUBLE) * two + CAST(0.1 AS DOUBLE) * two * one) END"""
OVERLAP_PARTS = """
    SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE CAST(len(list_filter(q, lambda t: list_contains(p, t))) AS DOUBLE) / len(q) END AS one,
           CASE WHEN len(q) < 2 THEN 0 ELSE CAST(len(list_intersect(qp, pp)) AS DOUBLE) / greatest(len(qp), 1) END AS two
    FROM (SELECT *, list_distinct([q[i] || ' ' || q[i + 1] FOR i IN range(1, len(q))]) AS qp, list_distinct([p[i] || ' ' || p[i + 1] FOR i IN range(1, len(p))]) AS pp FROM {0})"""


# ---- quotes and text


@query(f"""
    WITH d AS (SELECT doc_id, {FOLD.format("text")} AS t FROM documents), b AS (SELECT item_id, {FOLD.format("text")} AS q FROM benchmark)
    SELECT item_id, doc_id, CAST(strpos(t, q) - 1 AS INTEGER) AS at FROM b JOIN d ON strpos(t, q) > 0 WHERE q <> ''""")
def j11_exact_quote(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes located in documents as they stand. Documents and quotes meet on a run of three whole words that lies inside the quote, so nothing is compared with everything; quotes of under five words are compared as they are."""
    docs = _t(spark, sf, "documents").select("doc_id", text.fold("text", nfkc=False).alias("t"))
    quotes = _t(spark, sf, "benchmark").select("item_id", text.fold("text", nfkc=False).alias("q")).where("q <> ''").withColumn("w", F.split("q", " "))
    run = lambda w, k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2))
    long = quotes.where(F.size("w") >= 5).select("item_id", "q", run(F.col("w"), F.lit(1)).alias("run"))
    words = F.split("t", " ")
    n = F.size(words)
    tail = lambda k: F.slice(words, F.lit(k), F.greatest(n - k + 1, F.lit(0)))
    threes = F.zip_with(F.zip_with(words, tail(2), lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b)), tail(3), lambda p, c: F.xxhash64(p["a"], p["b"], c))  # no lambda refers to the whole text
    runs = docs.where(n >= 3).select("doc_id", F.explode(F.array_distinct(F.slice(threes, F.lit(1), n - 2))).alias("run"))
    pairs = runs.join(long, "run").select("doc_id", "item_id", "q").distinct()  # the texts stay behind until a pair is a candidate
    found = pairs.join(docs, "doc_id").where(F.expr("instr(t, q) > 0"))
    short = docs.join(F.broadcast(quotes.where(F.size("w") < 5).select("item_id", "q")), F.expr("instr(t, q) > 0"))  # a stated set of short quotes
    both = found.select("item_id", "doc_id", "t", "q").unionByName(short.select("item_id", "doc_id", "t", "q"))
    return both.select("item_id", "doc_id", F.expr("instr(t, q) - 1").cast("int").alias("at")).distinct()


@query()
def t16_fuzzy_quote(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes aligned with every document that holds an anchor of theirs; without one there is no window to align. What is found exactly is not aligned."""
    quotes = _t(spark, sf, "benchmark").select("item_id", "text")
    rows = [tuple(r) for r in quotes.collect()]  # a stated set of quotes
    ids = F.broadcast(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], T.StructType([T.StructField("key", T.IntegerType()), quotes.schema["item_id"]])))
    found = scan.find_quotes(spark.sparkContext.broadcast([q for _, q in rows]))
    hits = _t(spark, sf, "documents").select("doc_id", F.explode(found("text")).alias("f")).select("doc_id", "f.*")
    return hits.join(ids, "key").select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"), "at")


@query(f"""
    SELECT doc_id, {FOLD.format("text")} AS folded, substr({FOLD.format("text")}, 1, 220) || CASE WHEN length({FOLD.format("text")}) > 220 THEN '…' ELSE '' END AS snippet
    FROM documents""")
def t02_fold_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", text.fold("text", nfkc=False).alias("folded"), text.snippet("text", F.lit(0)).alias("snippet"))


@query(f"""
    SELECT doc_id, CAST(len(a) AS INTEGER) AS n_words, CAST(len(list_distinct(a)) AS INTEGER) AS n_distinct,
           CASE WHEN len(list_filter(w, lambda x: x IN ({_quoted(STOP_PL)}))) + len(list_filter(w, lambda x: regexp_matches(x, '[{POLISH}]')))
                     > len(list_filter(w, lambda x: x IN ({_quoted(STOP_EN)}))) THEN 'pl' ELSE 'en' END AS lang
    FROM (SELECT doc_id, {WORDS.format("text")} AS a, {WORDS.format("substr(text, 1, 20000)")} AS w FROM documents)""")
def t05_words_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Words of whole texts; the language goes by the first 20,000 characters, as it is defined."""
    w = text.words("text", nfkc=False)
    return _t(spark, sf, "documents").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), text.detect_lang("text", nfkc=False).alias("lang"))


@query(f"""
    SELECT stem, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs
    FROM (SELECT doc_id, unnest({_tokens_sql("text")}) AS stem FROM documents) GROUP BY stem""")
def t07_content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The stem table of the corpus: words are counted per document first, and each distinct word is stemmed once a document."""
    w = F.filter(text.words("text", nfkc=False), lambda x: (F.length(x) > 1) & ~x.isin(*text.STOP))
    each = _t(spark, sf, "documents").select("doc_id", F.explode(w).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    return each.groupBy(text.stem(F.col("w")).alias("stem"), "doc_id").agg(F.sum("n").alias("n")).groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"""
    WITH q AS (SELECT item_id, unnest(t) AS t, generate_subscripts(t, 1) AS at FROM (SELECT item_id, {_tokens_sql("text")} AS t FROM benchmark)),
    p AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS at FROM (SELECT doc_id, {_tokens_sql("text")} AS t FROM documents)),
    n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), k AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY item_id, t),
    one AS (SELECT item_id, doc_id, sum(times) AS shared FROM (SELECT DISTINCT doc_id, t FROM p) JOIN k USING (t) GROUP BY item_id, doc_id),
    qp AS (SELECT DISTINCT a.item_id, a.t || ' ' || b.t AS pair FROM q a JOIN q b ON a.item_id = b.item_id AND b.at = a.at + 1), pp AS (SELECT DISTINCT a.doc_id, a.t || ' ' || b.t AS pair FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.at = a.at + 1),
    kinds AS (SELECT item_id, count(*) AS kinds FROM qp GROUP BY item_id), two AS (SELECT item_id, doc_id, count(*) AS two FROM qp JOIN pp USING (pair) GROUP BY item_id, doc_id),
    parts AS (SELECT item_id, doc_id, n, CAST(shared AS DOUBLE) / n AS u, coalesce(CAST(two AS DOUBLE) / kinds, 0) AS b FROM one JOIN n USING (item_id) LEFT JOIN two USING (item_id, doc_id) LEFT JOIN kinds USING (item_id))
    SELECT item_id, doc_id, round(CASE WHEN n < 2 THEN u ELSE least(CAST(1 AS DOUBLE), CAST(0.8 AS DOUBLE) * u + CAST(0.2 AS DOUBLE) * b + CAST(0.1 AS DOUBLE) * b * u) END, 6) AS overlap FROM parts""")
def t09_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The overlap of every quote with every document that shares a content token with it."""
    quotes = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.overlap_join(quotes, docs, nfkc=False).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("overlap", 6).alias("overlap"))


@query()
def t12_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "documents").select("doc_id", F.posexplode(text.numbers("text")).alias("place", "n"))
    return n.select("doc_id", "place", "n.raw", F.array_sort("n.values").alias("values"), "n.decimals", "n.pct", text.significant(F.col("n")).alias("significant"))


@query()
def t10_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(scan.split_sentences("text")).alias("place", "sentence"))


@query()
def t18_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(scan.chunk_text("text")).alias("place", "chunk"))


@query(r"""
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)</?(jats:)?(title|sec)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
           '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM pages""")
def t19_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", text.strip_tags("html").alias("plain"))


@query(r"SELECT page_id, TRY_CAST(regexp_extract(html, '(?:19|20)\d\d', 0) AS INTEGER) AS year FROM pages")
def t20_year_of(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", text.year_of("html").alias("year"))


@query(r"""
    WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
    s AS (SELECT *, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '\d+', '#', 'g') AS form FROM l),
    p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source),
    g AS (SELECT s.source, form FROM s JOIN p USING (source) WHERE length(trim(line)) BETWEEN 4 AND 219 GROUP BY s.source, form, pages HAVING pages >= 3 AND count(DISTINCT doc_id) >= greatest(3, pages // 2))
    SELECT source, CAST(count(*) AS BIGINT) AS lines FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = s.source AND g.form = s.form) GROUP BY source""")
def t22_running_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return incremental.running_lines(lines).groupBy(F.col("doc").alias("source")).agg(F.count("*").alias("lines"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(\*\*|__|\*|`)', '', 'g')) AS title FROM pages""")
def t26_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).alias("paragraphs"), text.strip_emphasis(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


@query()
def t24_statements(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", incremental.find_statements("text").alias("s")).select("doc_id", "s.*")


# ---- identifiers and keys


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^(?:https?://)?(?:dx\.)?doi\.org/', ''), '^doi:\s*', ''), '[.;,]+$', '') AS doi,
       upper(string_split(trim(url), '/')[-1]) AS openalex, regexp_replace(trim(url), '\D', '', 'g') AS pmid FROM pages""")
def i01_canonical_ids(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return _t(spark, sf, "pages").select("page_id", identity.norm_doi(u).alias("doi"), identity.norm_id(F.lit("openalex"), u).alias("openalex"), identity.norm_id(F.lit("pmid"), u).alias("pmid"))


TITLE_KEY = r"""substr(array_to_string(list_filter(string_split_regex(regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '[^a-z0-9 ]', ' ', 'g'), '\s+'), lambda w: length(w) > 2), ' '), 1, 120)"""


@query(f"""SELECT doc_id, CASE WHEN length(k) < 20 THEN '' ELSE k END AS title_key FROM (SELECT doc_id, {TITLE_KEY.format("text")} AS k FROM documents)""")
def i03_title_key(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", identity.title_key("text", ascii_only=True).alias("title_key"))


@query(r"""
    WITH b AS (SELECT doc_id, substr(regexp_replace(lower(source), '[^a-z]', '', 'g'), 1, 20) || CAST(2000 + doc_id % 5 AS VARCHAR) || lang AS base FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM b)
    SELECT doc_id, base, base || CASE WHEN n = 1 THEN '' WHEN n < 28 THEN chr(CAST(95 + n AS INTEGER)) ELSE CAST(n AS VARCHAR) END AS key FROM n""")
def i14_unique_keys(spark: SparkSession, sf: str) -> DataFrame:
    base = F.concat(F.substring(F.regexp_replace(F.lower("source"), "[^a-z]", ""), 1, 20), (F.lit(2000) + F.col("doc_id") % 5).cast("string"), "lang")
    return resolve.unique_keys(_t(spark, sf, "documents").select("doc_id", base.alias("base")), order="doc_id").select("doc_id", "base", "key")


@query(r"""
    SELECT c_custkey, CASE WHEN strpos(c_name, ',') > 0 THEN string_split(c_name, ',')[1] ELSE string_split_regex(trim(c_name), '\s+')[-1] END AS family,
           concat_ws(', ', nullif(trim(c_mktsegment), ''), nullif(trim(c_name), '')) AS person FROM customer""")
def i12_names(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select("c_custkey", identity.family_name("c_name").alias("family"), identity.person_name("c_mktsegment", "c_name").alias("person"))


@query(r"""
    WITH p AS (SELECT p_partkey, p_name, p_brand, 2000 + p_partkey % 20 AS year, CASE WHEN p_partkey % 2 = 0 THEN 'Mfgr, J. B.' END AS second FROM part),
    a AS (SELECT *, 'Brand, A. C.' || coalesce(', & ' || second, '') AS apa, 'Brand AC' || CASE WHEN second IS NULL THEN '' ELSE ', Mfgr JB' END AS short FROM p)
    SELECT p_partkey, apa || ' (' || CAST(year AS VARCHAR) || '). ' || rtrim(p_name, '.') || '. *' || p_brand || '*, *7*(2), 1-9. https://doi.org/10.1000/' || CAST(p_partkey AS VARCHAR) AS apa,
           short || '. ' || rtrim(p_name, '.') || '. ' || p_brand || '. ' || CAST(year AS VARCHAR) || ';7(2):1-9. doi:10.1000/' || CAST(p_partkey AS VARCHAR) || '.' AS vancouver,
           CASE WHEN second IS NULL THEN 'Brand' ELSE 'Brand & Mfgr' END AS in_text FROM a""")
def i18_references(spark: SparkSession, sf: str) -> DataFrame:
    """Each part as a reference in two styles; the other styles stand in i18_reference_styles."""
    d = _t(spark, sf, "part").withColumn("authors", F.array_compact(F.array(F.lit("Brand, A. C."), F.when(F.col("p_partkey") % 2 == 0, "Mfgr, J. B."))))
    none, doi, year = F.lit(""), F.concat(F.lit("10.1000/"), F.col("p_partkey").cast("string")), F.lit(2000) + F.col("p_partkey") % 20
    made = [identity.reference(s, F.col("authors"), year, F.col("p_name"), F.col("p_brand"), F.lit("7"), F.lit("2"), F.lit("1-9"), doi, none, none, none, F.lit(False)).alias(s) for s in ("apa", "vancouver")]
    return d.select("p_partkey", *made, identity.intext_author(F.col("authors")).alias("in_text"))


@query()
def i19_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citation blocks of assistant turns, each with its turn made into a cited sentence."""
    draft = F.concat("text", F.lit(" [@doc"), F.col("turn").cast("string"), F.lit(', p. 3 :: "a [b] c"; @other].'))
    c = _t(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(scan.parse_citations(draft)).alias("c"))
    return c.select("conv_id", "turn", "c.key", "c.locator", "c.quote")


# ---- screening, joins, sets


@query(r"""
    WITH w AS (SELECT d.doc_id, l.toxic, 1995 + d.doc_id % 30 AS year, d.lang FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))
    SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'retracted' WHEN year < 2000 THEN 'published before 2000' WHEN lang NOT IN ('en', 'fr') THEN 'language ' || lang || ' not in criteria' END AS reason FROM w) WHERE reason IS NOT NULL""")
def p01_screen_ladder(spark: SparkSession, sf: str) -> DataFrame:
    toxic = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    w = _t(spark, sf, "documents").join(toxic, "doc_id", "left")
    none = F.lit("")
    works = w.select(F.col("doc_id").alias("key"), F.lit("new").alias("status"), (F.col("toxic") == 1).alias("is_retracted"), (F.lit(1995) + F.col("doc_id") % 30).alias("year"), F.lit("other").alias("design"), none.alias("kind"), F.col("lang").alias("language"), F.lit(False).alias("is_preprint"), none.alias("published_version"), none.alias("doi"))
    return screening.auto_screen(works, since=2000, languages=["en", "fr"]).select(F.col("key").alias("doc_id"), "reason")


@query("""SELECT DISTINCT c_nationkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 45""")
def j01_three_way_distinct(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey")
    c = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")
    return li.join(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "l_partkey").distinct()


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j09_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    works = _t(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.lit("new").alias("status"), F.lit("search").alias("origin"))
    return resolve.unreferenced(works, _t(spark, sf, "labels").select(F.col("doc_id").alias("key"))).select(F.col("key").alias("doc_id"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def j05_included_with_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT 'sha' AS kind, sha256(text) AS value, min(doc_id) AS key FROM documents GROUP BY text")
def r07_index_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The identifier index of texts: the first document to arrive keeps it."""
    rows = _t(spark, sf, "documents").select(F.lit("sha").alias("kind"), F.sha2("text", 256).alias("value"), F.col("doc_id").alias("key"), F.col("doc_id").alias("arrival"))
    return resolve.index_ids(rows)


@query("""
    WITH f AS (SELECT lang, source, min(doc_id) AS first FROM documents GROUP BY lang, source)
    SELECT lang AS "group", string_agg(source, ',' ORDER BY first) AS sources, (SELECT CAST(count(*) AS BIGINT) FROM documents d WHERE d.lang = f.lang) AS records FROM f GROUP BY lang""")
def u01_united_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of a language as records of one work: its sources united in the order in which they came."""
    d = _t(spark, sf, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("work"), F.count("*").alias("n"))
    united = resolve.merge_works(d.select(F.col("lang").alias("group"), "work", F.array("source").alias("sources")), lists=("sources",)).drop("records")
    counts = d.groupBy(F.col("lang").alias("group")).agg(F.sum("n").alias("records"))
    return united.join(counts, "group").select("group", F.array_join("sources", ",").alias("sources"), "records")


@query("""
    WITH e AS (SELECT source, doc_id, quality = 1 AS f, toxic = 1 AS a FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, doc_id FROM documents WHERE doc_id % 7 = 0)
    SELECT lang AS draft, source AS claim_id FROM e JOIN c USING (doc_id) GROUP BY lang, source HAVING bool_or(f) AND NOT bool_or(a) AND source IN (SELECT source FROM e WHERE a)""")
def u03_key_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as claims, good documents for and toxic ones against them, languages as drafts that cite every seventh document."""
    d = _t(spark, sf, "documents")
    e = _t(spark, sf, "labels").join(d.select("doc_id", "source", "lang"), "doc_id")
    claims = e.groupBy(F.col("source").alias("claim_id")).agg(F.collect_set(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("keys_for"), F.collect_set(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("keys_against"))
    return verify.balance_issues(claims, d.where("doc_id % 7 = 0").select(F.col("lang").alias("draft"), F.col("doc_id").alias("key")))


# ---- aggregates


@query("""
    WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY user_id)
    SELECT decision, CAST(count(*) AS BIGINT) AS n FROM last GROUP BY decision""")
def w01_latest_decision(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.lit("ta").alias("stage"), F.col("event_type").alias("decision"), F.lit("").alias("reason"), F.col("event_id").alias("id"))
    return screening.latest_decisions(e).groupBy("decision").agg(F.count("*").alias("n"))


STATUS = "CASE WHEN l.doc_id IS NULL THEN 'new' WHEN quality = 1 AND toxic = 1 THEN 'ft_excluded' WHEN quality = 1 THEN 'ft_included' WHEN toxic = 1 THEN 'not_retrieved' ELSE 'ta_excluded' END"


@query(f"""
    WITH w AS (SELECT d.doc_id, {STATUS} AS status, CASE WHEN d.lang = 'en' THEN 'search' ELSE 'manual' END AS origin, d.n_chars > 1000 AS has_text FROM documents d LEFT JOIN labels l USING (doc_id)),
    f AS (SELECT CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS identified FROM events)
    SELECT any_value(identified) AS identified, CAST(count(*) AS BIGINT) AS screened, CAST(count(*) FILTER (WHERE origin <> 'search') AS BIGINT) AS other_sources,
           CAST(count(*) FILTER (WHERE status = 'ta_excluded') AS BIGINT) AS ta_excluded, CAST(count(*) FILTER (WHERE status = 'new') AS BIGINT) AS awaiting,
           CAST(count(*) FILTER (WHERE status IN ('ft_included', 'ft_excluded', 'not_retrieved')) AS BIGINT) AS sought, CAST(count(*) FILTER (WHERE has_text AND status IN ('ft_included', 'ft_excluded')) AS BIGINT) AS full_text,
           CAST(count(*) FILTER (WHERE status = 'ft_included') AS BIGINT) AS included, CAST(count(*) FILTER (WHERE has_text AND status = 'ft_included') AS BIGINT) AS included_fulltext,
           CAST(greatest(0, any_value(identified) - count(*) FILTER (WHERE origin = 'search')) AS BIGINT) AS duplicates
    FROM w, f""")
def g01_flow_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "new").when((F.col("quality") == 1) & (F.col("toxic") == 1), "ft_excluded").when(F.col("quality") == 1, "ft_included").when(F.col("toxic") == 1, "not_retrieved").otherwise("ta_excluded")
    works = d.select(F.col("doc_id").alias("key"), status.alias("status"), F.when(F.col("lang") == "en", "search").otherwise("manual").alias("origin"))
    searches = _t(spark, sf, "events").select(F.col("event_type").alias("connector"), F.lit(1).alias("returned"), F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"), F.lit("").alias("run"))
    out = screening.next_step(screening.flow_counts(works, searches, _t(spark, sf, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("key"))))
    return out.select("identified", "screened", "other_sources", "ta_excluded", "awaiting", "sought", "full_text", "included", "included_fulltext", F.col("duplicates").cast("long").alias("duplicates"))


@query("""
    WITH r AS (SELECT event_type || ': ' || CAST(event_id % 3 AS VARCHAR) AS reason, user_id AS key, event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'ft' ELSE 'auto' END AS stage FROM events),
    l AS (SELECT key, arg_max(stage, id) AS stage, arg_max(reason, id) AS reason FROM r GROUP BY key),
    n AS (SELECT stage = 'ft' AS full_text, CASE WHEN stage = 'auto' THEN '[auto] ' ELSE '' END || split_part(reason, ':', 1) AS reason, count(*) AS n FROM l GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY full_text ORDER BY n DESC, reason) AS place FROM n)
    SELECT full_text, reason, CAST(n AS BIGINT) AS n FROM p WHERE place <= 8""")
def g01_exclusion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 2 == 0, "ft").otherwise("auto").alias("stage"), F.lit("exclude").alias("decision"), F.concat("event_type", F.lit(": "), (F.col("event_id") % 3).cast("string")).alias("reason"), F.col("event_id").alias("id"))
    return screening.exclusion_reasons(e)


_COMBINED = ("medicine", "psychology")
_DESIGN_OF = ("sr_ma", "rct", "cohort", "journal_article", "animal", "preprint", "book")


def _weights_sql() -> str:
    c = packs.combined(*_COMBINED)
    return "(VALUES " + ", ".join(f"({k}, '{d}', CAST({c.weight(d)} AS DOUBLE), {packs.LEVELS.index(c.grade(d))})" for k, d in enumerate(_DESIGN_OF)) + ") AS w(k, design, weight, level)"


def _works(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    names = F.array(*[F.lit(x) for x in _DESIGN_OF])
    none = F.lit("")
    toxic = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = d.join(toxic, "doc_id", "left")
    kind = F.get(names, (F.col("doc_id") % len(_DESIGN_OF)).cast("int"))
    return d.select(F.col("doc_id").alias("key"), kind.alias("design"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_retracted"), (kind == "preprint").alias("is_preprint"), none.alias("venue"), F.lit(False).alias("concern"), none.alias("funding"), none.alias("coi"), none.alias("abstract"))


@query(f"""
    SELECT d.doc_id, w.design, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 0.0 ELSE round(w.weight, 3) END AS weight
    FROM documents d JOIN {_weights_sql()} ON w.k = d.doc_id % {len(_DESIGN_OF)} LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
def g03_weights(spark: SparkSession, sf: str) -> DataFrame:
    c = packs.combined(*_COMBINED)
    w = evidence.with_design_weights(_works(spark, sf), c)
    return w.select(F.col("key").alias("doc_id"), "design", evidence.weight(F.col("design_weight"), F.col("is_retracted"), F.col("is_preprint"), F.col("design"), F.col("venue"), F.col("concern"), c.top_venues()).alias("weight"))


@query(f"""
    WITH e AS (SELECT d.source AS claim_id, d.doc_id, w.design, w.weight, w.level, CASE WHEN d.doc_id % 11 = 0 THEN 'mixed' WHEN l.quality = 1 THEN 'for' ELSE 'against' END AS stance, l.toxic = 1 AS retracted
               FROM documents d JOIN labels l USING (doc_id) JOIN {_weights_sql()} ON w.k = d.doc_id % {len(_DESIGN_OF)}),
    v AS (SELECT * FROM e WHERE NOT retracted),
    g AS (SELECT claim_id, count(*) AS n, round(coalesce(sum(CASE WHEN stance = 'for' THEN round(weight, 3) END), 0), 6) AS for_w, round(coalesce(sum(CASE WHEN stance = 'against' THEN round(weight, 3) END), 0), 6) AS against_w,
                 round(coalesce(sum(CASE WHEN stance = 'mixed' THEN round(weight, 3) END), 0), 6) AS mixed_w, max(level) AS start,
                 count(*) FILTER (WHERE stance = 'against' AND design = 'sr_ma') AS sa, count(*) FILTER (WHERE stance = 'mixed' AND design = 'sr_ma') AS sm, bool_and(design = 'preprint') AS pre FROM v GROUP BY claim_id),
    c AS (SELECT *, (for_w + CAST(0.25 AS DOUBLE) * mixed_w) / nullif(for_w + against_w + CAST(0.5 AS DOUBLE) * mixed_w, 0) AS c FROM g),
    l AS (SELECT *, start - CASE WHEN c > 0.3 AND c < 0.75 THEN 1 WHEN sa > 0 THEN 1 WHEN sm > 0 THEN 1 ELSE 0 END AS level FROM c),
    m AS (SELECT *, CASE WHEN n = 1 THEN level - 1 WHEN n = 2 AND level > 2 THEN 2 ELSE level END - CASE WHEN pre THEN 1 ELSE 0 END AS final FROM l)
    SELECT claim_id, CAST(n AS BIGINT) AS n, for_w, against_w, mixed_w, round(c, 6) AS consensus,
           CASE WHEN c IS NULL THEN 'no evidence' WHEN c >= 0.8 AND n >= 3 THEN 'consistent support' WHEN c >= 0.8 THEN 'support (few studies)' WHEN c >= 0.6 THEN 'mostly supports' WHEN c > 0.4 THEN 'mixed / inconclusive' WHEN c > 0.2 THEN 'mostly contradicts' ELSE 'contradicted' END AS label,
           CASE WHEN c IS NULL THEN 'very low' ELSE ['very low', 'low', 'moderate', 'high'][CAST(greatest(final, 0) AS INTEGER) + 1] END AS certainty FROM m""")
def g02_consensus(spark: SparkSession, sf: str) -> DataFrame:
    l = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    stance = F.when(F.col("doc_id") % 11 == 0, "mixed").when(F.col("quality") == 1, "for").otherwise("against")
    rows = l.select(F.col("source").alias("claim_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("key"), stance.alias("stance"), F.lit("").alias("quote"), F.lit("").alias("effect"), F.lit(1.0).alias("verified"))
    s = evidence.claim_summary(rows, _works(spark, sf), packs.combined(*_COMBINED))
    return s.select("claim_id", "n", "for_w", "against_w", "mixed_w", F.round("consensus", 6).alias("consensus"), "label", "certainty").where("n > 0")


@query(r"""
    WITH k AS (SELECT * FROM (VALUES ('law_pl_eu', 'prawo'), ('law_pl_eu', 'prawa'), ('law_pl_eu', 'prawem')) AS t(pack, keyword)),
    d AS (SELECT doc_id, lower(strip_accents(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS t FROM documents),
    n AS (SELECT doc_id, pack, CAST(count(*) AS DOUBLE) AS score FROM d JOIN k ON regexp_matches(t, '(^|[^a-z])' || keyword) GROUP BY doc_id, pack)
    SELECT doc_id, pack, score FROM n UNION ALL SELECT doc_id, 'general', CAST(1 AS DOUBLE) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = d.doc_id)""")
def g05_detect_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as questions to a pack of three keywords; g05_detect_questions has the built-in ones."""
    own = {"general": packs.Pack("general"), "law_pl_eu": packs.Pack("law_pl_eu", keywords=["prawo", "prawa", "prawem"])}
    return packs.detect(_t(spark, sf, "documents").select("doc_id", F.col("text").alias("q")), "q", own, by="doc_id")


# ---- resolution and design


@query("SELECT doc_id AS work, min(doc_id) OVER (PARTITION BY text) AS \"group\" FROM documents")
def r02_components(spark: SparkSession, sf: str) -> DataFrame:
    ids = _t(spark, sf, "documents").select(F.col("doc_id").alias("work"), F.lit("sha").alias("kind"), F.sha2("text", 256).alias("value"))
    return resolve.canonical_groups(ids)


@query("SELECT doc_id AS work, min(doc_id) OVER (PARTITION BY text) AS key_work FROM documents")
def r02_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    ids = _t(spark, sf, "documents").select(F.col("doc_id").alias("work"), F.lit("sha").alias("kind"), F.sha2("text", 256).alias("value"), F.lit(0).alias("prio"))
    return resolve.first_hit_groups(ids, resolve.canonical_groups(ids))


@query("""
    WITH g AS (SELECT min(doc_id) OVER (PARTITION BY text) AS grp, * FROM documents)
    SELECT grp AS "group", arg_min(lang, doc_id) AS lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, max(n_chars) AS n_chars, bool_or(doc_id % 2 = 0) AS even, CAST(count(*) AS BIGINT) AS records FROM g GROUP BY grp""")
def r03_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    same = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("group"))
    works = d.withColumn("h", F.sha2("text", 256)).join(same, "h").select("group", F.col("doc_id").alias("work"), "lang", F.array("source").alias("sources"), "n_chars", (F.col("doc_id") % 2 == 0).alias("even"))
    m = resolve.merge_works(works, lists=("sources",), flags=("even",), largest=("n_chars",))
    return m.withColumn("sources", F.array_join(F.array_sort("sources"), ","))


def _design_sql() -> str:
    ladder = " ".join(f"WHEN t LIKE '%{n}%' THEN '{d}|pubtype:{n}'" for n, d in design.TYPES if d != "narrative_review")
    review = "WHEN t LIKE '%review%' AND t NOT LIKE '%systematic%' AND t NOT LIKE '%meta%' THEN 'narrative_review|pubtype:review'"
    return f"CASE {ladder} {review} ELSE 'journal_article|default' END"


_PUB = [n for n, _ in design.TYPES]


@query(f"""
    WITH p AS (SELECT doc_id, [{", ".join(f"'{x}'" for x in _PUB)}][doc_id % {len(_PUB)} + 1] AS t FROM documents), d AS (SELECT doc_id, {_design_sql()} AS d FROM p)
    SELECT doc_id, split_part(d, '|', 1) AS design, split_part(d, '|', 2) AS basis FROM d""")
def r04_design_ladder(spark: SparkSession, sf: str) -> DataFrame:
    none, empty = F.lit(""), F.array().cast("array<string>")
    t = F.get(F.array(*[F.lit(x) for x in _PUB]), (F.col("doc_id") % len(_PUB)).cast("int"))
    return _t(spark, sf, "documents").select("doc_id", design.infer_design(none, F.array(t), empty, empty, none, none, F.lit("V"), F.lit(False), nfkc=False).alias("d")).select("doc_id", "d.design", "d.basis")


# ---- windows and order


@query("SELECT event_type AS key, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS number FROM events GROUP BY event_type")
def w04_first_appearance(spark: SparkSession, sf: str) -> DataFrame:
    uses = _t(spark, sf, "events").select(F.lit(1).alias("draft"), F.col("event_type").alias("key"), F.col("event_id").alias("position"))
    return tables.first_uses(uses).select("key", "number")


@query(r"""
    WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[^a-zA-Z]+'), lambda w: w <> '')) AS n FROM conversations),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS paragraph FROM t WHERE n > 0) SELECT conv_id, turn, CAST(paragraph AS INTEGER) AS paragraph, CAST(n AS INTEGER) AS n_words FROM p""")
def w07_section_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as drafts with a heading for each turn: sentences carry their section and the number of their paragraph. Turns without a letter have no sentence."""
    plain = F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " "))
    turn = F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n"), plain, F.lit("\n"))
    drafts = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    s = verify.parse_drafts(drafts.select(F.col("conv_id").alias("draft"), "text"))
    return s.select(F.col("draft").alias("conv_id"), F.regexp_extract("section", r"(\d+)", 1).cast("long").alias("turn"), "paragraph", F.size(F.split("sentence", " ")).alias("n_words"))


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, o_orderpriority = '1-URGENT' AS synthesis FROM orders)
    SELECT a.o_custkey AS draft, a.o_orderkey AS key, b.o_orderkey AS newer FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND NOT a.synthesis AND b.synthesis AND b.y > a.y + 2""")
def w09_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as evidence for one claim, urgent ones as syntheses, the others as what a draft cites."""
    o = _t(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "sr_ma").otherwise("rct")
    works = o.select(F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("year"), kind.alias("design"))
    rows = o.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("key"), F.lit("for").alias("stance"))
    cited = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_custkey").alias("draft"), F.col("o_orderkey").alias("key"))
    return verify.freshness_issues(rows, works, cited).where("draft = claim_id").select("draft", "key", "newer")


@query("""
    SELECT c_custkey AS key, round(CAST(0.75 AS DOUBLE) * ((c_custkey * 7919) % 1000) / 1000 + CAST(0.25 AS DOUBLE) * ((c_custkey * 104729) % 1000) / 1000, 6) AS mixed
    FROM customer ORDER BY mixed DESC, key LIMIT 20 OFFSET 10""")
def o01_screening_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a screening list; a page is the feature."""
    hashed = lambda k: (F.col("c_custkey") * k % 1000) / F.lit(1000.0)
    works = _t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), hashed(7919).alias("relevance"), hashed(104729).alias("weight"), F.lit(2000).alias("year"))
    return screening.screening_page(works, offset=10, limit=20).select("key", F.round(F.lit(0.75) * F.col("relevance") + F.lit(0.25) * F.col("weight"), 6).alias("mixed"))


BM25 = r"""
    tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
    len AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS DOUBLE) AS length FROM documents),
    post AS (SELECT term, doc_id, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY term, doc_id), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS n FROM post GROUP BY term), st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(length) AS mean FROM len),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) WHERE length(term) > 2),
    s AS (SELECT item_id, doc_id, round(sum(ln(1.0 + (docs - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s)"""


@query(f"WITH {BM25} SELECT item_id, doc_id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 12")
def o02_bm25(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.PassageIndex(_t(spark, sf, "documents"), "doc_id", "text")
    quotes = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search(quotes, 12).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "place")


@query(f"""
    WITH {BM25}, pairs AS (SELECT r.item_id, r.doc_id, place, {_tokens_sql("b.text")} AS q, {_tokens_sql("d.text")} AS p FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE place <= 12),
    o AS (SELECT item_id, doc_id, place, {OVERLAP} AS overlap FROM ({OVERLAP_PARTS.format("pairs")})), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, place) AS n FROM o)
    SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM k WHERE n = 1""")
def o04_best_passage(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    quotes = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.best_passages(retrieval.PassageIndex(docs), docs, quotes, nfkc=False).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("overlap", 6).alias("overlap"))


@query()
def o03_find(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("key"), "text")
    quotes = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.find(retrieval.PassageIndex(docs), docs, quotes)


# ---- tables


@query("""
    WITH last AS (SELECT o_custkey AS key, o_orderpriority AS field, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1, 2)
    SELECT key, max(CASE WHEN field = '1-URGENT' THEN value END) AS urgent, max(CASE WHEN field = '2-HIGH' THEN value END) AS high, max(CASE WHEN field = '5-LOW' THEN value END) AS low, CAST(0 AS BIGINT) AS failed FROM last GROUP BY key""")
def n02_evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    cells = _t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value"), F.lit("").alias("quote"), F.lit("").alias("loc"), F.lit(1.0).alias("verified"), F.col("o_orderkey").alias("id"))
    wide = tables.evidence_table(cells, ["1-URGENT", "2-HIGH", "5-LOW"])
    return wide.select("key", F.col("`1-URGENT`").alias("urgent"), F.col("`2-HIGH`").alias("high"), F.col("`5-LOW`").alias("low"), "failed")


@query("""
    WITH m AS (SELECT user_id, event_type, CASE event_id % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '±' ELSE '·' END AS mark, event_id FROM events)
    SELECT user_id AS key, coalesce(arg_max(mark, event_id) FILTER (WHERE event_type = 'click'), '') AS click, coalesce(arg_max(mark, event_id) FILTER (WHERE event_type = 'view'), '') AS view FROM m GROUP BY user_id""")
def n05_claim_matrix(spark: SparkSession, sf: str) -> DataFrame:
    stance = F.get(F.array(*[F.lit(x) for x in ("for", "against", "mixed", "neutral")]), (F.col("event_id") % 4).cast("int"))
    e = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("claim_id"), stance.alias("stance"), F.lit(1.0).alias("verified"), F.col("event_id").alias("id"))
    return tables.claim_matrix(e, ["click", "view"])


@query("""
    WITH r AS (SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high, bool_and(l_extendedprice > 0) AS log, count(*) AS n FROM lineitem GROUP BY l_returnflag),
    p AS (SELECT *, ln(least(low, 1.0)) AS a, ln(greatest(high, 1.0)) AS b FROM r)
    SELECT l_returnflag, CAST(n AS BIGINT) AS n, log AS log_scale, CAST(1 AS DOUBLE) AS null_line, round(a - (b - a) * CAST(0.08 AS DOUBLE), 6) AS axis_from, round(b + (b - a) * CAST(0.08 AS DOUBLE), 6) AS axis_to FROM p""")
def n08_forest_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select("l_returnflag", F.lit("OR").alias("metric"), F.col("l_extendedprice").alias("low"), F.col("l_extendedprice").alias("high"))
    return tables.forest_range(rows, ["l_returnflag"]).select("l_returnflag", "n", "log_scale", "null_line", F.round("axis_from", 6).alias("axis_from"), F.round("axis_to", 6).alias("axis_to"))


@query("""
    WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id, role)
    SELECT conv_id, string_agg(role || '×' || CAST(n AS VARCHAR), ', ' ORDER BY first) AS roles FROM c GROUP BY conv_id""")
def n04_design_counts(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(tables.design_counts(ordered).alias("roles"))


@query()
def v08_checked_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark passage as a cell of the document that has its number."""
    cells = _t(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("value"), F.col("text").alias("quote"))
    sources = _t(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    return tables.check_cells(cells, sources).select("key", "score", "problem")


@query()
def v01_draft_score(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as drafts that cite the document of their number."""
    turns = _t(spark, sf, "conversations").where("role = 'assistant'")
    drafts = turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("draft"), F.concat(F.regexp_replace("text", r"[.\s]+$", ""), F.lit(" [@d"), F.col("conv_id").cast("string"), F.lit("].")).alias("text"))
    works = _works(spark, sf).join(_t(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang", "text"), "key")
    sources = works.select(F.concat(F.lit("d"), F.col("key").cast("string")).alias("key"), F.lit("ft_included").alias("status"), "is_retracted", "is_preprint", F.lit("").alias("published_version"), "design", F.lit("fulltext").alias("depth"), "lang", "text")
    _, scores = verify.verify(drafts, sources, sorted(packs.combined("medicine").causal()))
    return scores.select("draft", "score", "hard", "errors", "passed", "band")


@query("""
    WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
    c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_sum([CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]) / (sqrt(list_sum([CAST(q.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE) FOR i IN range(1, 65)])) * sqrt(list_sum([CAST(e.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]))) AS cosine
          FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, id) AS place FROM c)
    SELECT query_id, id, round(cosine, 6) AS cosine, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def v07_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth vector against all others."""
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return verify.cosine_neighbours(e, e.where("id % 50 = 0"))


# ---- incremental work and the graph


@query("SELECT DISTINCT user_id AS key FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00')")
def z01_watch_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("user_id").alias("key"), "ts")
    return incremental.new_since(e.where("ts >= timestamp '2024-01-01 06:00:00'"), e.where("ts < timestamp '2024-01-01 06:00:00'")).select("key").distinct()


@query("SELECT event_type AS connector, CAST(count(DISTINCT user_id) AS BIGINT) AS queries FROM events WHERE event_type <> 'error' GROUP BY event_type")
def z01_replayable(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "events").select(F.col("event_type").alias("connector"), F.col("user_id").cast("string").alias("query"), F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"), F.lit("").alias("run"), F.lit("").alias("subq"))
    return incremental.replayable(s).groupBy("connector").agg(F.count("*").alias("queries"))


@query("""
    SELECT p_partkey AS seed, l_orderkey AS key, 'forward' AS way FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1""")
def j14_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    edges = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    seeds = _t(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("key"))
    return incremental.one_hop(edges, seeds, "forward")


@query("""
    WITH h AS (SELECT DISTINCT l_partkey AS seed, l_orderkey AS key FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1 AND l_orderkey % 3 <> 0),
    c AS (SELECT o_orderkey AS key, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS relevance FROM orders), r AS (SELECT seed, key, relevance, row_number() OVER (PARTITION BY seed ORDER BY relevance DESC, key) AS place FROM h JOIN c USING (key) WHERE relevance >= 0.25)
    SELECT seed, key, relevance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def o07_snowball(spark: SparkSession, sf: str) -> DataFrame:
    edges = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    orders = _t(spark, sf, "orders")
    candidates = orders.select(F.col("o_orderkey").alias("key"), ((F.col("o_orderkey") * 7919 % 1000).cast("double") / 1000).alias("relevance"))
    library = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"))
    return incremental.snowball(edges, _t(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("key")), candidates, library, per_seed=5, direction="forward")


@query("SELECT o_orderpriority AS topic, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def s08_topic_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.topic_histogram(_t(spark, sf, "orders").select(F.col("o_orderpriority").alias("topic")))


@query("SELECT c_custkey, c_name AS name, coalesce(n_name, '') AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j07_enrich(spark: SparkSession, sf: str) -> DataFrame:
    works = _t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit("").alias("nation"), F.col("c_nationkey").cast("string").alias("nid"))
    lookup = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("nid"), F.col("n_name").alias("nation"))
    return incremental.enrich(works, [("nid", lookup)]).select("c_custkey", "name", "nation")


# ---- payloads, effects, exports, time windows


@query("""
    SELECT doc_id, '10.1000/' || CAST(doc_id AS VARCHAR) AS doi, CAST(1990 + doc_id % 30 AS INTEGER) AS year, CAST(1990 + doc_id % 30 AS VARCHAR) || '-0' || CAST(1 + doc_id % 9 AS VARCHAR) AS date,
           source || ': ' || lang AS title, doc_id % 3 = 0 AS is_preprint, doc_id % 5 = 0 AS is_retracted FROM documents""")
def s13_crossref_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents made into JSON payloads and read back by the parser."""
    d = _t(spark, sf, "documents")
    issued = F.struct(F.array(F.array((F.lit(1990) + F.col("doc_id") % 30).cast("int"), (F.lit(1) + F.col("doc_id") % 9).cast("int"))).alias("date-parts"))
    update = F.when(F.col("doc_id") % 5 == 0, F.array(F.struct(F.lit("retraction").alias("type"), F.lit("10.1/r").alias("DOI"))))
    body = F.to_json(F.struct(F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string")).alias("DOI"), F.array("source").alias("title"), F.array("lang").alias("subtitle"), issued.alias("issued"), F.when(F.col("doc_id") % 3 == 0, "posted-content").otherwise("journal-article").alias("type"), update.alias("updated-by")))
    return payloads.parse(d.select("doc_id", body.alias("body")), "crossref").select("doc_id", "doi", "year", "date", "title", "is_preprint", "is_retracted")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS abstract FROM documents")
def s04_inverted_abstract(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    each = _t(spark, sf, "documents").select("doc_id", F.posexplode(words).alias("k", "w")).groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("k")).alias("at"))
    index = F.map_from_entries(F.collect_list(F.struct("w", "at")))
    body = each.groupBy("doc_id").agg(F.to_json(F.struct(index.alias("abstract_inverted_index"))).alias("body"))
    return body.select("doc_id", payloads.inverted_abstract(F.col("body")).alias("abstract"))


@query("""
    SELECT l_orderkey, l_linenumber, 'OR' AS metric, round(1 + l_discount, 2) AS estimate, round(1 - l_tax, 2) AS low, round(1 + l_discount + l_tax, 2) AS high FROM lineitem""")
def i27_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Effects written as text and read back."""
    li = _t(spark, sf, "lineitem")
    said = F.format_string("OR %.2f (95%% CI %.2f to %.2f)", F.lit(1) + F.col("l_discount"), F.lit(1) - F.col("l_tax"), F.lit(1) + F.col("l_discount") + F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", identity.parse_effect(said).alias("e")).select("l_orderkey", "l_linenumber", "e.metric", "e.estimate", "e.low", "e.high")


@query(r"""SELECT s_suppkey, '@article{s' || CAST(s_suppkey AS VARCHAR) || ',' || chr(10) || '  title = {' || s_name || '},' || chr(10) || '  year = {2020},' || chr(10) || '  pages = {1--9}' || chr(10) || '}' AS entry FROM supplier""")
def k04_bibtex(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit("")
    s = _t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.lit("rct").alias("design"), F.col("s_name").alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(2020).alias("year"), none.alias("venue"), none.alias("volume"), none.alias("issue"), F.lit("1-9").alias("pages"), none.alias("doi"), none.alias("url"))
    return s.select("s_suppkey", export.bibtex().alias("entry"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS decision, max(event_id) AS id FROM events GROUP BY user_id")
def z05_decision_status(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of decisions: the running status of each key."""
    return watch.status_stream(_t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("decision"), F.col("event_id").alias("id")))


QUERIES |= cases.QUERIES  # with what cases_sources and cases_work register there
ORACLE_SQL |= cases.ORACLE_SQL
