"""Identifiers, names, citation keys and references as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions.text import _col, normalize, strip_accents
from veriloom.functions.words import KEY_STOP, NAME_SUFFIXES, ORGANISATIONS, PARTICLES

# The order in which identifiers are tried.
ID_KINDS = ("doi", "pmid", "pmcid", "arxiv", "openalex", "s2", "nct", "eli", "title")
_ORGANISATION = r"(?iU)\b(?:" + "|".join(ORGANISATIONS) + ")"


def _text(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def norm_doi(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(F.trim(_text(c))), r"^(?:https?://)?(?:dx\.)?doi\.org/", "")
    return F.regexp_replace(F.regexp_replace(t, r"^doi:\s*", ""), r"[.;,]+$", "")


def norm_id(kind: Column, value: Column) -> Column:
    """The canonical form of an identifier of a kind."""
    v = F.trim(value)
    upper = F.upper(v)
    arxiv = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:)", ""), r"\.pdf", ""), r"v\d+$", "")
    return (
        F.when(kind == "doi", norm_doi(v))
        .when(kind == "pmcid", F.when(upper.startswith("PMC"), upper).otherwise(F.concat(F.lit("PMC"), upper)))
        .when(kind == "arxiv", arxiv)
        .when(kind == "openalex", F.upper(F.substring_index(v, "/", -1)))
        .when(kind == "pmid", F.regexp_replace(v, r"\D", ""))
        .otherwise(F.lower(v))
    )


def title_key(c: Column | str, ascii_only: bool = False) -> Column:
    """Words of three characters and more, 120 characters at most; empty if under 20. The year plays no part.

    ascii_only leaves out accents and compatibility forms, the steps that need Python.
    """
    t = F.lower(normalize(c, nfkc=False) if ascii_only else strip_accents(normalize(c)))
    kept = F.filter(F.split(F.regexp_replace(t, "[^a-z0-9 ]", " "), r"\s+"), lambda w: F.length(w) > 2)
    key = F.substring(F.array_join(kept, " "), 1, 120)
    return F.when(F.length(key) < 20, "").otherwise(key)


def id_list(columns: dict[str, Column], title: Column, ascii_only: bool = False) -> Column:
    """array<struct<kind, value, prio>> of a work's identifiers in their order, the title key last."""
    parts = [F.struct(F.lit(k).alias("kind"), norm_id(F.lit(k), columns[k]).alias("value"), F.lit(p).alias("prio")) for p, k in enumerate(ID_KINDS) if k in columns]
    parts.append(F.struct(F.lit("title").alias("kind"), title_key(title, ascii_only).alias("value"), F.lit(len(ID_KINDS) - 1).alias("prio")))
    return F.filter(F.array(*parts), lambda x: F.coalesce(x["value"], F.lit("")) != "")


# ---- names


def person_name(family: Column | str, given: Column | str) -> Column:
    squeeze = lambda c: F.trim(F.regexp_replace(_text(c), r"\s+", " "))
    return F.concat_ws(", ", F.nullif(squeeze(family), F.lit("")), F.nullif(squeeze(given), F.lit("")))


def is_organisation(c: Column | str) -> Column:
    return _text(c).rlike(_ORGANISATION) | (F.size(F.filter(F.split(F.trim(_text(c)), r"\s+"), lambda w: w != "")) > 4)


def display_name(c: Column | str) -> Column:
    """"Family, Given" from a name as it is displayed; names with a comma, of organisations and with initials last stay."""
    plain = F.trim(F.regexp_replace(_text(c), r"\s+", " "))
    parts = F.split(plain, " ")
    parts = F.when((F.size(parts) > 2) & F.lower(F.element_at(parts, -1)).isin(*sorted(NAME_SUFFIXES)), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    n = F.size(parts)
    # particles before the family name, counted from the end; one given name is left
    before = F.reverse(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))))
    run = F.aggregate(before, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + (a["on"] & F.lower(w).isin(*sorted(PARTICLES))).cast("int")).alias("n"), (a["on"] & F.lower(w).isin(*sorted(PARTICLES))).alias("on")))["n"]
    given = n - 1 - run
    turned = F.concat(F.array_join(F.slice(parts, given + 1, F.greatest(n - given, F.lit(0))), " "), F.lit(", "), F.array_join(F.slice(parts, F.lit(1), F.greatest(given, F.lit(0))), " "))
    keep = plain.contains(",") | is_organisation(plain) | (n < 2) | F.element_at(parts, -1).rlike("^[A-Z]{1,3}$")
    return F.when(plain == "", "").when(keep, plain).otherwise(turned)


def family_name(c: Column | str) -> Column:
    a = F.trim(_text(c))
    parts = F.split(a, r"\s+")
    name_words = F.filter(F.regexp_extract_all(a, F.lit("([A-Za-zÀ-ž]+)"), F.lit(1)), lambda w: ~F.lower(w).isin("the", "of", "for", "and", "de", "la"))
    return (
        F.when(is_organisation(a) & ~a.contains(","), F.coalesce(F.get(name_words, F.lit(0)), a))
        .when(a.contains(","), F.substring_index(a, ",", 1))
        .when((F.size(parts) > 1) & F.element_at(parts, -1).rlike("^[A-Z]{1,3}$"), F.element_at(parts, 1))
        .otherwise(F.element_at(parts, -1))
    )


def initials(c: Column | str, dots: bool = True, space: bool = True) -> Column:
    """Of the given names: after the comma, else all words but the last; of initials that stand last, each letter."""
    a = F.trim(_text(c))
    parts = F.split(a, r"\s+")
    given = F.when(a.contains(","), F.trim(F.regexp_extract(a, ",(.*)$", 1))).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    last = F.element_at(parts, -1)
    letters = F.transform(F.filter(F.split(given, r"[\s-]+"), lambda w: w.rlike(r"^\p{L}")), lambda w: F.substring(w, 1, 1))
    plain = F.when(~a.contains(",") & (F.size(parts) > 1) & last.rlike("^[A-Z]{1,3}$"), F.split(last, "")).otherwise(letters)
    dot = "." if dots else ""
    return F.array_join(F.transform(plain, lambda x: F.concat(x, F.lit(dot))), " " if space else "")


def key_base(first_author: Column | str, year: Column | str, title: Column | str, venue: Column | str, ascii_only: bool = False) -> Column:
    """family[:20] + year or nd + the first title word of more than three letters that is not too common."""
    plain = (lambda c: F.lower(c)) if ascii_only else (lambda c: F.lower(strip_accents(c)))
    name = F.when(_text(first_author) != "", family_name(first_author)).otherwise(F.coalesce(F.nullif(_text(venue), F.lit("")), F.lit("anon")))
    letters = F.coalesce(F.nullif(F.regexp_replace(plain(name), "[^a-z]", ""), F.lit("")), F.lit("anon"))
    word = F.get(F.filter(F.regexp_extract_all(plain(_text(title)), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 3) & ~w.isin(*KEY_STOP)), F.lit(0))
    return F.concat(F.substring(letters, 1, 20), F.coalesce(F.nullif(_col(year), F.lit(0)).cast("string"), F.lit("nd")), F.coalesce(word, F.lit("")))


def key_suffix(n: Column) -> Column:
    """What makes the n-th use of a base unique: nothing, a letter, then a number."""
    return F.when(n <= 1, "").when(n < 28, F.char(F.lit(95) + n)).otherwise(n.cast("string"))


# ---- references


def _series(names: Column, before_last: Column | str) -> Column:
    """Names joined by commas, the last one by something else."""
    glue = F.lit(before_last) if isinstance(before_last, str) else before_last
    n = F.size(names)
    return F.when(n > 1, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), glue, F.element_at(names, -1))).otherwise(F.array_join(names, ""))


def author_list(authors: Column, style: str) -> Column:
    """Names as a style wants them: apa up to 20 then the last, vancouver and acs 6 and ieee 6 then et al., harvard and chicago 3 then et al. Organisations stay whole."""
    n = F.size(authors)
    short = style in ("vancouver", "acs")
    shape = {
        "ieee": lambda a: F.concat(initials(a), F.lit(" "), family_name(a)),
        **dict.fromkeys(("vancouver", "acs"), lambda a: F.concat(family_name(a), F.lit(" "), initials(a, dots=False, space=False))),
    }.get(style, lambda a: F.concat(family_name(a), F.lit(", "), initials(a)))
    names = F.transform(authors, lambda a: F.when(is_organisation(a), a).otherwise(shape(a)))
    first = F.concat(F.get(names, F.lit(0)), F.lit(" et al."))
    if short:
        out = F.concat(F.array_join(F.slice(names, 1, 6), ", "), F.when(n > 6, ", et al.").otherwise(""))
    elif style == "ieee":
        out = F.when(n > 6, first).otherwise(_series(names, F.when(n > 2, ", and ").otherwise(" and ")))
    elif style == "apa":
        out = _series(F.when(n > 20, F.array_append(F.slice(names, 1, 19), F.concat(F.lit("... "), F.element_at(names, -1)))).otherwise(names), ", & ")
    else:
        out = F.when(n > 3, first).otherwise(_series(names, " and "))
    return F.when(n == 0, "").otherwise(out)


def intext_author(authors: Column, venue: Column | str = "") -> Column:
    name = lambda k: F.when(is_organisation(F.get(authors, F.lit(k))), F.get(authors, F.lit(k))).otherwise(family_name(F.get(authors, F.lit(k))))
    n = F.size(authors)
    none = F.substring(F.coalesce(F.nullif(_text(F.lit(venue) if isinstance(venue, str) else venue), F.lit("")), F.lit("Anon.")), 1, 40)
    return F.when(n == 0, none).when(n == 1, name(0)).when(n == 2, F.concat(name(0), F.lit(" & "), name(1))).otherwise(F.concat(name(0), F.lit(" et al.")))


def reference(style: str, authors: Column, year: Column, title: Column, venue: Column, volume: Column, issue: Column, pages: Column, doi: Column, pmid: Column, arxiv: Column, url: Column, is_preprint: Column) -> Column:
    """A reference in one of six styles; what is missing leaves no trace. Italics and bold in Markdown."""
    some = lambda c: F.nullif(_text(c.cast("string")), F.lit(""))
    after = lambda before, c, end="": F.coalesce(F.concat(F.lit(before), some(c), F.lit(end)), F.lit(""))
    raw = F.coalesce(some(author_list(authors, style)), some(venue), F.lit("Anon."))
    names, name_of_work = F.rtrim(raw, F.lit(".")), F.rtrim(_text(title), F.lit("."))
    when, where = F.coalesce(some(year), F.lit("n.d.")), _text(venue)
    number = F.concat(_text(volume), after("(", issue, ")"))
    page = F.trim(_text(pages))
    page = F.when(page.rlike(r"^(\S+?)\s*[-–]\s*\1$"), F.regexp_extract(page, r"^(\S+?)\s*[-–]", 1)).otherwise(page)
    long = style in ("apa", "harvard", "chicago")
    ident = F.coalesce(F.concat(F.lit("https://doi.org/" if long else "doi:"), some(doi)), F.concat(F.lit("PMID: "), some(pmid)), F.concat(F.lit("arXiv:"), some(arxiv)), _text(url))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    if style == "apa":
        source = cat("*", where, "*", after(", *", volume, "*"), after("(", issue, ")"), after(", ", page))
        whole = cat(raw, " (", when, "). ", name_of_work, F.when(F.coalesce(is_preprint, F.lit(False)), " [Preprint]").otherwise(""), ". ", source, ". ", ident)
        return F.trim(F.replace(whole, F.lit(". ."), F.lit(".")))
    end = cat(after(". ", ident), ".")
    if style == "harvard":
        return cat(raw, " (", when, ") '", name_of_work, "', *", where, "*", after(", ", number), after(", pp. ", page), end)
    if style == "chicago":
        return cat(names, ". ", when, '. "', name_of_work, '." *', where, "*", after(" ", number), after(": ", page), end)
    if style == "vancouver":
        return cat(names, ". ", name_of_work, ". ", where, ". ", when, after(";", number), after(":", page), end)
    if style == "acs":
        return cat(names, ". ", name_of_work, ". *", where, "* **", when, "**", after(", *", volume, "*"), after(", ", page), end)
    if style == "ieee":
        return cat(raw, ', "', name_of_work, '," *', where, "*", after(", vol. ", volume), after(", no. ", issue), after(", pp. ", page), ", ", when, after(", ", ident), ".")
    raise ValueError(f"no style {style!r}")


def resolve_reference(c: Column | str) -> Column:
    """struct<kind, value>: what identifier a written reference is, by its prefix or shape; `key` if none."""
    t = F.trim(F.regexp_replace(_text(c), "^@", ""))
    prefix = F.lower(F.regexp_extract(t, r"^(doi|pmid|pmcid|arxiv|openalex|nct|eli|s2):", 1))
    rest = F.regexp_replace(t, r"(?i)^(?:doi|pmid|pmcid|arxiv|openalex|nct|eli|s2):\s*", "")
    kind = (
        F.when(prefix != "", prefix)
        .when(t.rlike(r"(?i)^(?:https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/"), "doi")
        .when(t.rlike(r"(?i)^PMC\d+$"), "pmcid")
        .when(t.rlike(r"^\d{6,9}$"), "pmid")
        .when(t.rlike(r"(?i)^NCT\d{8}$"), "nct")
        .when(t.rlike(r"(?i)^W\d{6,}$"), "openalex")
        .when(t.rlike(r"^\d{4}\.\d{4,5}(?:v\d+)?$"), "arxiv")
        .otherwise("key")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "key", t).otherwise(norm_id(kind, rest)).alias("value"))


#: Fixed value: how effects are written.
EFFECT = r"(?i)\b(OR|RR|HR|IRR|aOR|aHR|aRR|MD|SMD|RD|d|g|r)\b\s*[=:]?\s*(-?\d+(?:[.,]\d+)?)\s*[,;(\[]?\s*(?:95\s*%\s*(?:CI|confidence interval|PU)\s*[:=,]?\s*)?(-?\d+(?:[.,]\d+)?)\s*(?:-|–|to|,|;|\.\.)\s*(-?\d+(?:[.,]\d+)?)"


def parse_effect(c: Column | str) -> Column:
    """struct<metric, estimate, low, high> of an effect such as "OR 0.88 (95% CI 0.81-0.96)"; null unless low <= estimate <= high."""
    t = F.translate(_text(c), "·−", ".-")
    value = lambda k: F.regexp_replace(F.regexp_extract(t, EFFECT, k), ",", ".").try_cast("double")
    found = F.struct(F.upper(F.regexp_extract(t, EFFECT, 1)).alias("metric"), value(2).alias("estimate"), value(3).alias("low"), value(4).alias("high"))
    return F.when((value(3) <= value(2)) & (value(2) <= value(4)), found)
