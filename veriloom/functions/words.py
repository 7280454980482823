"""Fixed values that results depend on: word lists, suffixes, abbreviations and characters."""

# English stop words.
STOP_EN = frozenset(
    """a an the and or but if then else of to in on at by for with without from into onto over under
    as is are was were be been being am do does did done has have had having this that these those it its it's
    they them their there here which who whom whose what when where why how not no nor so than too very can could
    may might must shall should will would also such each other some any all both either neither more most less
    least many much few own same only just about above after again against before below between during through
    until up down out off further once i we you he she our your his her my me us one two per via vs versus
    et al eg ie""".split()
)

# Polish stop words.
STOP_PL = frozenset(
    """a aby albo ale ani aż bardzo bez bo być był była było były będzie będą by byli co coś czy czyli
    dla do gdy gdzie go i ich ile im inne inny iż ja jak jako je jego jej jest jeszcze jeśli już ją każdy kiedy
    kto która które którego której który których którym którzy lub ma mają mi mnie mu my na nad nam nas nie nich
    nim niż no o od oraz po pod podczas przez przy również się są ta tak także tam te tego tej ten też to tu tylko
    tym u w we więc wszystko z za ze że żeby oraz natomiast jednak według wśród około""".split()
)

# Suffixes in the order in which they are tried, English first.
SUFFIXES = (
    "ational", "ization", "fulness", "iveness", "ations", "ation", "ments", "ment", "ities",
    "ity", "ness", "ings", "ing", "ies", "ied", "ers", "er", "ed", "ly", "es", "s",
    "owaniami", "owaniach", "owanie", "owania", "ościami", "ościach", "ości", "ość", "ami", "ach",
    "ych", "ymi", "ego", "emu", "owi", "iem", "ów", "om", "ej", "ie", "ia", "a", "y", "e", "ą", "ę",
    "u", "i", "o",
)

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = (
    "e.g", "i.e", "et al", "fig", "figs", "tab", "vs", "approx", "ca", "cf", "no", "vol", "pp", "p",
    "dr", "prof", "mr", "mrs", "ms", "st", "jr", "sr", "inc", "ltd", "co", "eq", "ref", "refs", "sec",
    "np", "tzw", "tj", "m.in", "ok", "itd", "itp", "ds", "wg", "por", "zob", "r", "mln", "mld", "tys",
    "ang", "łac", "jw", "dot", "nr", "s",
)

# Letters that only Polish has.
POLISH = "ąćęłńóśźż"

# Characters that normalisation replaces or drops.
DASHES = "‐‑‒–—―−﹣－"
DOUBLE_QUOTES = "“”„‟«»″"
SINGLE_QUOTES = "‘’‚‛′"
BLANKS = "              　"
DROPPED = "​‌‍﻿­"

# Words that mark an organisation, as prefixes of words.
ORGANISATIONS = (
    "group", "collaboration", "consortium", "committee", "organization", "organisation", "center", "centre",
    "institute", "hospital", "university", "foundation", "agency", "ministry", "council", "society",
    "association", "bank", "sejm", "national", "department", "office", "inc", "ltd", "gmbh",
)

# Particles of family names and name suffixes.
PARTICLES = frozenset("van von der den de del della di da dos das du le la ter ten zu bin ibn al el".split())
NAME_SUFFIXES = frozenset("jr jr. sr sr. ii iii iv".split())

# Title words that no citation key takes.
KEY_STOP = ("with", "from", "that", "this", "their", "between", "among", "versus", "effect", "effects", "study", "analysis", "using", "based", "into")
