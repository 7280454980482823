import json

from pyspark.sql import functions as F

from veriloom.functions import authors
from veriloom.sources import fulltext, imports

JATS = """<article xmlns:x="u"><front><article-meta><abstract><p>Short.</p></abstract><funding-group><funding-statement>By X.</funding-statement></funding-group></article-meta></front>
<body><sec><title>Methods</title><p>We did.</p><sec><title>Data</title><p>Some <i>data</i>.</p><table-wrap><label>Table 1</label><caption><p>Cap</p></caption><table><tr><th>a</th><td>1</td></tr></table></table-wrap></sec></sec></body><back><ack><p>Thanks.</p></ack></back></article>"""


def test_jats(spark):
    fulltext.register(spark)
    spark.createDataFrame([(JATS,), ("broken <",), (None,)], "x string").createOrReplaceTempView("jats_in")
    rows = [(r["kind"], r["loc"], r["text"]) for r in spark.sql("select p.* from jats_in, lateral parse_jats(x) p order by position").collect()]
    assert rows == [("abstract", "abstract", "Short."), ("sec", "sec. Methods", "We did."), ("sec", "sec. Methods › Data", "Some data."), ("table", "Table 1", "Cap\na | 1"), ("funding", "funding", "By X."), ("ack", "ack", "Thanks.")]


def test_cascade_and_guard(spark):
    c = spark.createDataFrame([("a", "oa", True, "1"), ("a", "pmc", True, "2"), ("a", "user", False, "3"), ("b", "oa", False, "4")], "key string, source string, accepted boolean, path string")
    assert [(r["key"], r["source"], r["path"]) for r in fulltext.pick_text(c).collect()] == [("a", "pmc", "2")]
    p = spark.createDataFrame([("Vitamin D and infections", "10.1/x", "Vitamin D and infections: a trial"), ("Other title here", "10.1/X", "text doi 10.1/x end"), ("Nothing alike", "", "quite different")], "title string, doi string, first_pages string")
    assert [r["same"] for r in fulltext.same_document(p).collect()] == [True, True, False]
    assert p.select(fulltext.doi_in_text("first_pages").alias("d")).collect()[1]["d"] == ""
    parts = fulltext.plain_parts(spark.createDataFrame([("a", "one\n\n\ntwo\nmore\n\n\n\nthree")], "key string, text string")).collect()
    assert [r["loc"] for r in parts] == ["part 1", "part 2", "part 3"]
    files = spark.createDataFrame([("/f/k1.pdf",), ("/f/10-1-x.txt",)], "path string")
    assert {r["key"] for r in fulltext.user_files(files, spark.createDataFrame([("k1", ""), ("k2", "10.1/x"), ("k3", "")], "key string, doi string")).collect()} == {"k1", "k2"}


def test_source_texts(spark):
    w = spark.createDataFrame([("a", "T", "A"), ("b", "T", ""), ("c", "T", "A")], "key string, title string, abstract string")
    got = {r["key"]: (r["depth"], r["text"]) for r in fulltext.source_texts(w, spark.createDataFrame([("a", 2, "q"), ("a", 1, "p")], "key string, page int, text string")).collect()}
    assert got == {"a": ("fulltext", "T\nA\np\nq"), "b": ("metadata", "T"), "c": ("abstract", "T\nA")}


def test_imports(spark, tmp_path):
    (tmp_path / "s.csv").write_text("key,decision,reason\na,Include,\nb,exclude,too old\n")
    assert [tuple(r) for r in imports.screening_file(spark, str(tmp_path / "s.csv")).collect()] == [("a", "ta", "include", ""), ("b", "ta", "exclude", "too old")]
    (tmp_path / "s.json").write_text(json.dumps([{"key": "a", "decision": "maybe", "stage": "ft"}]))
    assert [tuple(r) for r in imports.screening_file(spark, str(tmp_path / "s.json")).collect()] == [("a", "ft", "maybe", "")]
    (tmp_path / "x.json").write_text(json.dumps({"studies": {"k": {"n": "5", "effect": {"value": "OR 1", "quote": "q"}, "_note": "z"}, "_x": {"n": "1"}}}))
    assert sorted(tuple(r) for r in imports.extraction_file(spark, str(tmp_path / "x.json")).collect()) == [("k", "effect", "OR 1", "q", ""), ("k", "n", "5", "", "")]
    (tmp_path / "e.json").write_text(json.dumps([{"claim": "C1", "key": "k", "stance": "for"}, {"claim": "C9", "key": "k", "stance": "for"}, {"claim": "C1", "key": "zz", "stance": "for"}, {"claim": "C1", "key": "k", "stance": "perhaps"}]))
    rows = imports.checked_evidence(imports.evidence_file(spark, str(tmp_path / "e.json")), spark.createDataFrame([("C1",)], "claim_id string"), spark.createDataFrame([("k",)], "key string")).collect()
    assert sorted(r["problem"] for r in rows) == ["", "unknown claim", "unknown source", "unknown stance"]


def test_upserts(spark):
    now = spark.createDataFrame([("a", 1, "old"), ("b", 1, "stay")], "key string, ts int, v string")
    new = spark.createDataFrame([("a", 2, "new"), ("c", 2, "add")], "key string, ts int, v string")
    assert {r["key"]: r["v"] for r in imports.upsert(now, new, ["key"], "ts").collect()} == {"a": "new", "b": "stay", "c": "add"}
    assert {r["key"]: r["v"] for r in imports.first_wins(now, new, ["key"], "ts").collect()} == {"a": "old", "b": "stay", "c": "add"}


def test_author_merge(spark):
    assert authors.merged(["Julio J Secades", "World Health Organization"], True, ["Secades, J. J."], False) == (["Secades, J. J.", "World Health Organization"], False)
    assert authors.merged(["Xu Chen"], True, ["Xu, Chen"], False)[0] == ["Xu, Chen"]
    assert authors.merged([], False, ["Smith, A"], False) == (["Smith, A"], False)
    df = spark.createDataFrame([(["Jan van der Berg"], True, None, False)], "a array<string>, x boolean, b array<string>, y boolean")
    r = df.select(authors.merge_authors("a", "x", "b", "y").alias("m")).first()["m"]
    assert r["authors"] == ["van der Berg, Jan"] and r["displayed"]
    assert df.select(F.lit(1)).count() == 1
