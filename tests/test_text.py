import pytest
from pyspark.sql import functions as F

from veriloom.functions import scan, text


@pytest.mark.parametrize(("raw", "plain"), [("A – B “q”", 'A - B "q"'), ("infec-\ntion", "infection"), ("0·92", "0.92"), ("a​b  c", "ab c"), (None, ""), ("ﬁ", "fi")])
def test_normalize(one, raw, plain):
    assert one(text.normalize(F.lit(raw).cast("string"))) == plain
    assert scan.normalized(raw) == plain


def test_fold_and_slug(one):
    assert one(text.fold(F.lit("*The* [OR] “x”  Y"))) == "the or x y"
    assert one(text.slug(F.lit("Żółć: a Test!"))) == "zo-c-a-test"
    assert one(text.slug(F.lit("!!"))) == "x"


def test_strip_accents_keeps_barred_letters(one):
    assert one(text.strip_accents(F.lit("Łódź é"))) == "Łodz e"


@pytest.mark.parametrize(("word", "stem"), [("cats", "cat"), ("is", "is"), ("nationalization", "nationa"), ("ities", "iti"), ("studies", "stud"), ("ing", "ing")])
def test_stem(one, word, stem):
    assert one(text.stem(F.lit(word))) == stem


def test_words_and_language(one):
    assert one(text.words(F.lit("It's a well-known x2 test 3rd"))) == ["it's", "a", "well-known", "x2", "test", "rd"]
    assert one(text.detect_lang(F.lit("Suplementacja witaminy nie zmniejsza ryzyka i jest bezpieczna dla dzieci"))) == "pl"
    assert one(text.detect_lang(F.lit(""))) == "en"


def test_overlap(spark):
    rows = [("vitamin d prevents infection", "vitamin d supplements prevent infections"), ("alpha beta gamma", "alpha beta gamma"), ("the of", "x"), ("zebra quagga", "other words")]
    got = [r["overlap"] for r in text.with_overlap(spark.createDataFrame(rows, "q string, p string"), "q", "p").collect()]
    assert got[0] > 0.6 and got[1] == 1.0 and got[2] == 0.0 and got[3] == 0.0


def test_numbers(spark):
    df = spark.createDataFrame([("OR 0,88 (95% CI 0,81-0.96); n = 10 933 of 1,234 in 2019, 3 and -4.5",)], "t string")
    found = df.select(text.numbers("t").alias("n")).first()["n"]
    values = {v for n in found for v in n["values"]}
    assert {0.88, 95.0, 0.81, 10933.0, 1234.0, 1.234, 2019.0, 3.0, -4.5} <= values
    sig = df.select(F.transform(text.numbers("t"), text.significant).alias("s")).first()["s"]
    by = dict(zip([n["raw"] for n in found], sig, strict=True))
    assert by["0,88"] and by["95%"] and by["10 933"] and not by["2019"] and not by["3"]


def test_number_match(spark):
    df = spark.createDataFrame([("8.3 % of 1515", "8.34 % (n=1,515)"), ("1616", "8.34 %")], "v string, s string")
    df = df.withColumns({"own": text.numbers("v"), "have": text.numbers("s")})
    got = [r["m"] for r in df.select(F.transform("own", lambda n: text.number_match(n, F.col("have"))).alias("m")).collect()]
    assert got == [["rounded", "exact"], ["missing"]]


def test_markup(one):
    assert one(text.strip_tags(F.lit("<p>a&nbsp;&lt;b&gt;<br>c</p>"))) == "a <b> c"
    assert one(text.year_of(F.lit("published 12/2019"))) == 2019
    assert one(text.year_of(F.lit("none"))) is None
    assert one(text.strip_emphasis(F.lit("**b** [x](u) ![i](u) `c`"))) == "b x  c"


def test_sentences():
    assert scan.sentences("Risk fell (Smith et al. 2020) by 3.4 percent [@a]. Next one e.g. this. J. Smith came! End") == ["Risk fell (Smith et al. 2020) by 3.4 percent [@a].", "Next one e.g. this.", "J. Smith came!", "End"]
    assert scan.sentences(None) == [] and scan.sentences("  ") == []


def test_chunks():
    parts = scan.chunks(" ".join(f"Sentence number {k} is here." for k in range(60)), size=200)
    assert all(len(p) <= 260 for p in parts) and len(parts) > 5
    assert parts[0].split(". ")[-1].rstrip(".") in parts[1]


def test_quotes():
    assert scan.locate_quote("infection risk", "the infec-\ntion risk fell") == (1.0, 4)
    assert scan.locate_quote("the risk fell ... in adults", "The risk fell by 10 in adults")[0] == 1.0
    near, at = scan.locate_quote("vitamin d reduces infectoin risk markedly", "Vitamin D reduces infection risk markedly in adults")
    assert near > 0.88 and at == 0
    assert scan.locate_quote("quite another thing altogether", "vitamin d")[0] < 0.6
    assert scan.locate_quote("", "x") == (0.0, -1) and scan.locate_quote(None, None) == (0.0, -1)


def test_quote_of_itself_is_exact():
    for s in ("a plain sentence with words", "Ünïcode – and “quotes” 0·5"):
        assert scan.locate_quote(s, f"before {s} after")[0] == 1.0


def test_citations():
    got = scan.citations('x [@a, p. 3 :: "q [OR] ; 1.5"; -@b] y [@c]')
    assert [(c["key"], c["locator"], c["quote"]) for c in got] == [("a", "p. 3", "q [OR] ; 1.5"), ("b", "", ""), ("c", "", "")]
    assert scan.without_citations("x [@a] y") == "x y"


def test_locations():
    pages = [{"loc": "p. 1", "text": "first page words"}, {"loc": "p. 2", "text": "odds ratio of 0.97 here"}]
    assert scan.quote_at("odds ratio of 0.97", "p. 2", pages) == (True, "p. 2")
    assert scan.quote_at("odds ratio of 0.97", "p. 1", pages) == (False, "p. 2")
    assert scan.quote_at("odds ratio of 0.97", "sec. Results", pages) == (None, "p. 2")
    assert scan.location("str. 4") == ("page", "4") and scan.location("Tabela 2") == ("table", "2") and scan.same_location("section res", "sec. results")


def test_draft(spark):
    draft = "---\nt: 1\n---\n# Intro\nOne here. Two\nthere [@a].\n<!-- gone\nx -->\n| a | b |\n|---|---|\n| 1 | 2 |\n```\ncode\n```\n- item\n## References\nz"
    rows = list(scan.draft_sentences(draft))
    assert [(r[1], r[2], r[3], r[5]) for r in rows] == [("One here.", 5, "Intro", False), ("Two there [@a].", 5, "Intro", False), ("1 | 2", 11, "Intro", True), ("item", 15, "Intro", False)]
    scan.register(spark)
    assert spark.sql("select size(split_sentences('A b. C d.')) n").first()["n"] == 2
