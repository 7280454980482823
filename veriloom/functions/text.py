"""Text functions as Column builders; Arrow UDFs only where the JVM has no equivalent (Unicode normal forms)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.words import BLANKS, DASHES, DOUBLE_QUOTES, DROPPED, POLISH, SINGLE_QUOTES, STOP_EN, STOP_PL, SUFFIXES

ASCII = r"^\p{ASCII}*$"
#: A letter, then letters and digits, or an apostrophe or hyphen before a letter.
WORD = r"[\p{L}](?:[\p{L}\p{N}]|['\-][\p{L}])*"
NUMBER = r"(?U)(?<![\w.,])([-+]?)(\d{1,3}(?:[ ,.]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(\s?%)?(?![\w])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalize(c: Column | str, nfkc: bool = True) -> Column:
    """Compatibility forms, plain dashes, quotes and blanks, words joined over line breaks, white space collapsed. Null counts as empty.

    nfkc=False leaves out the only step that needs Python; on ASCII text the result is the same.
    """
    t = F.coalesce(_col(c), F.lit(""))
    if nfkc:
        t = _nfkc(t)
    pairs = [(DASHES, "-"), (DOUBLE_QUOTES, '"'), (SINGLE_QUOTES, "'"), (BLANKS, " "), ("·", "."), ("•", " ")]
    source, target = "".join(a for a, _ in pairs), "".join(b * len(a) for a, b in pairs)
    t = F.translate(t, source + DROPPED, target)
    t = F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def fold(c: Column | str, nfkc: bool = True) -> Column:
    """normalize, lower case, without quotes, emphasis and brackets."""
    t = F.regexp_replace(F.lower(normalize(c, nfkc)), r"[\"'`*_\[\]()]", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def strip_accents(c: Column | str) -> Column:
    """Without combining marks; letters such as ł stay."""
    return _without_marks(_col(c))


def slug(c: Column | str, most: int = 40) -> Column:
    t = F.regexp_replace(F.lower(strip_accents(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9]+", "-")
    t = F.regexp_replace(F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, most), "^-+|-+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("x"))


def words(c: Column | str, nfkc: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(normalize(c, nfkc)), F.lit(WORD), F.lit(0))


def stem(word: Column) -> Column:
    """Three letters or fewer stay; the first suffix in order that leaves three goes; seven letters at most."""
    out = F.when(F.length(word) <= 3, word)
    for s in SUFFIXES:
        out = out.when(word.endswith(s) & (F.length(word) >= 3 + len(s)), F.substring(word, F.lit(1), F.least(F.length(word) - len(s), F.lit(7))))
    return out.otherwise(F.substring(word, 1, 7))


def stem_of(word: str) -> str:
    """stem() of one string, for scanners."""
    if len(word) <= 3:
        return word
    for s in SUFFIXES:
        if word.endswith(s) and len(word) >= 3 + len(s):
            return word[: min(len(word) - len(s), 7)]
    return word[:7]


#: In lists of this length, isin is a look-up in a set.
STOP = sorted(STOP_EN | STOP_PL)


def content_tokens(c: Column | str, nfkc: bool = True) -> Column:
    """Stems of the words that are no stop words and longer than a letter."""
    kept = F.filter(words(c, nfkc), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))
    return F.transform(kept, stem)


def detect_lang(c: Column | str, nfkc: bool = True) -> Column:
    """`pl` if more Polish than English marks stand in the first 20,000 characters, else `en`."""
    w = words(F.substring(F.coalesce(_col(c), F.lit("")), 1, 20000), nfkc)
    count = lambda test: F.size(F.filter(w, test))
    english = count(lambda x: x.isin(*sorted(STOP_EN)))
    polish = count(lambda x: x.isin(*sorted(STOP_PL))) + count(lambda x: x.rlike(f"[{POLISH}]"))
    return F.when(polish > english, "pl").otherwise("en")


def overlap_of(q: Column, p: Column) -> Column:
    """Of two arrays of stems: the share of q's that p has, with a bonus for shared neighbours."""
    n = F.size(q)
    one = F.size(F.filter(q, lambda t: F.array_contains(p, t))) / n
    pairs = lambda x: F.array_distinct(F.when(F.size(x) > 1, F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    two = F.size(F.array_intersect(pairs(q), pairs(p))) / F.greatest(F.size(pairs(q)), F.lit(1))
    full = F.least(F.lit(1.0), F.lit(0.8) * one + F.lit(0.2) * two + F.lit(0.1) * two * one)
    return F.when(n == 0, F.lit(0.0)).when(n < 2, one).otherwise(full)


def overlap(query: Column | str, passage: Column | str, nfkc: bool = True) -> Column:
    return overlap_of(content_tokens(query, nfkc), content_tokens(passage, nfkc))


def with_overlap(df: DataFrame, query: str, passage: str, name: str = "overlap", nfkc: bool = True) -> DataFrame:
    """df with the overlap of two of its columns; their stems are made in a projection of their own, so that no lambda holds a Python function."""
    tokens = df.withColumns({"overlap_query": content_tokens(query, nfkc), "overlap_passage": content_tokens(passage, nfkc)})
    return tokens.withColumn(name, overlap_of(F.col("overlap_query"), F.col("overlap_passage"))).drop("overlap_query", "overlap_passage")


# ---- numbers


def number_readings(raw: Column) -> Column:
    """All plausible values of a numeral without sign: grouped thousands, decimal point or decimal comma."""
    s = F.regexp_replace(raw, " ", "")
    plain = s.rlike(r"^\d+$")
    decimal = s.rlike(r"^\d+[.,]\d+$")
    thousands = s.rlike(r"^\d{1,3}[.,]\d{3}$")
    grouped = s.rlike(r"^\d{1,3}(?:[,.]\d{3})+(?:[.,]\d+)?$")
    whole = F.regexp_replace(F.regexp_extract(s, r"^(\d{1,3}(?:[,.]\d{3})+)(?:([.,])(\d+))?$", 1), "[,.]", "")
    rest = F.regexp_extract(s, r"^(\d{1,3}(?:[,.]\d{3})+)(?:([.,])(\d+))?$", 3)
    number = lambda x: x.try_cast("double")
    found = (
        F.when(plain, F.array(number(s)))
        .when(decimal & thousands, F.array(number(F.regexp_replace(s, ",", ".")), number(F.regexp_replace(s, "[,.]", ""))))
        .when(decimal, F.array(number(F.regexp_replace(s, ",", "."))))
        .when(grouped, F.array(number(F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))), number(F.regexp_replace(s, ",", ""))))
        .otherwise(F.array(number(F.regexp_replace(s, ",", ""))))
    )
    return F.array_distinct(F.array_compact(found))


def numbers(c: Column | str, nfkc: bool = True) -> Column:
    """array<struct<raw, values, decimals, pct>>: the numbers of a text in order, each with all its readings."""
    found = F.regexp_extract_all(normalize(c, nfkc), F.lit(NUMBER), F.lit(0))

    def one(m: Column) -> Column:
        raw = F.trim(m)
        body = F.regexp_replace(F.regexp_replace(raw, r"\s?%$", ""), "^[-+]", "")
        sign = F.when(raw.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
        decimals = F.when(body.rlike(r"^\d{1,3}(?:[ ,.]\d{3})+$"), F.lit(0)).otherwise(F.length(F.regexp_extract(F.regexp_replace(body, " ", ""), r"[.,](\d+)$", 1)))
        return F.named_struct(F.lit("raw"), raw, F.lit("values"), F.transform(number_readings(body), lambda v: v * sign), F.lit("decimals"), decimals.cast("int"), F.lit("pct"), raw.endswith("%"))

    return F.transform(found, one)


def significant(n: Column) -> Column:
    """Worth checking: a percentage, decimals, or above ten and no year."""
    most = F.coalesce(F.array_max(F.transform(n["values"], F.abs)), F.lit(0.0))
    year = most.between(1900, 2100) & n["raw"].rlike(r"^\d{4}$")
    return n["pct"] | (n["decimals"] > 0) | ((most > 10) & ~year)


def number_match(n: Column, source: Column) -> Column:
    """`exact`, `rounded` or `missing` for a number against a source's numbers; rounding is half up on the decimal value."""
    exact = F.exists(n["values"], lambda v: F.exists(source, lambda s: F.exists(s["values"], lambda x: (x == v) | (x == -v))))
    rounded = F.exists(n["values"], lambda v: F.exists(source, lambda s: (s["decimals"] > n["decimals"]) & F.exists(s["values"], lambda x: _rounded(F.abs(x), n["decimals"]) == F.abs(v))))
    return F.when(exact, "exact").when(rounded, "rounded").otherwise("missing")


def _rounded(x: Column, places: Column) -> Column:
    """The number of places differs by row, which round() does not take: one branch for each up to six."""
    out = F.when(places == 0, F.round(x, 0))
    for k in range(1, 7):
        out = out.when(places == k, F.round(x, k))
    return out.otherwise(x)


# ---- markup


def strip_tags(c: Column | str) -> Column:
    """Tags become blanks, titles and sections line ends; common entities are read; white space is collapsed."""
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?i)</?(jats:)?(title|sec)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))


def year_of(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_col(c).cast("string"), F.lit("")), r"(?:19|20)\d\d", 0).try_cast("int")


def strip_emphasis(c: Column | str) -> Column:
    """Markdown images go, links keep their words, emphasis marks go."""
    t = F.regexp_replace(_col(c), r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(t, r"(\*\*|__|\*|`)", ""))


def snippet(c: Column | str, at: Column, length: int = 220) -> Column:
    """Around a place of the folded text, with an ellipsis where text is left out; a negative place gives nothing."""
    t = fold(c, nfkc=False)
    low = F.greatest(at - 30, F.lit(0))
    body = F.substring(t, low + 1, F.lit(length))
    return F.when(at < 0, "").otherwise(F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(low + length < F.length(t), "…").otherwise("")))
