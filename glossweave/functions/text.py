"""String expressions of the engine as Column builders: normal forms, placeholders, words, lemmas, invariants, blocking features.

Everything here is JVM-side but for compatibility normalisation (NFKC, NFKD), which Catalyst doesn't have: an Arrow UDF that only
non-ASCII strings reach with a value.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# White space, placeholder grammar, word and locale patterns, word lists.
SPACE = r"[\t\n\x0B\f\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_SPACE = "[^" + SPACE[1:]
PLACEHOLDER = (
    rf"\{{\{{{SPACE}*[\w.]+{SPACE}*\}}\}}"
    rf"|[$%]\{{{SPACE}*[\w.]+{SPACE}*\}}"
    rf"|\{{{SPACE}*[\w.]+{SPACE}*\}}"
    r"|%(?:\d+\$)?[sdif@]"
    r"|</?[a-z][^>]*>"
    r"|&[a-z]+;"
    r"|&#\d+;"
)
MARK = "\ue000"
WORD = r"[\p{L}\p{N}\p{M}]+(?:['’\-][\p{L}\p{N}\p{M}]+)*"
LOCALE = r"^(?i:[a-z]{2,3}(?:[-_][a-z0-9]{2,8})*)$"
KINDS = ("whitespace", "placeholder", "casing", "punctuation")
STOPWORDS = (
    "a about above after again against all also am an and any are as at back be because been before being below between both but by can "
    "cancel click close could did do does doing down during each eg etc few for from further had has have having he her here hers him his "
    "how i ie if in into is it its itself just may me more most must my next no nor not now of off ok on once only or other our ours out "
    "over own per please previous same shall she should so some such than that the their theirs them then there these they this those "
    "through to too under until up us very via was we were what when where which while who whom why will with would yes you your yours "
    "yourself"
).split()
INNER = "of and to in for on by at &".split()

_OPEN, _SHUT = "\ue001", "\ue002"
_ASCII = r"^[\x00-\x7F]*$"


@cache
def _unicode_form(form: str):
    """An Arrow UDF, made on first use: this module is imported on executors too, which have no session."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return pandas_udf(run, "string")


def nfkc(x: Column) -> Column:
    plain = x.rlike(_ASCII)
    return F.coalesce(F.when(plain, x), _unicode_form("NFKC")(F.when(~plain, x)))


def nfkd(x: Column) -> Column:
    plain = x.rlike(_ASCII)
    return F.coalesce(F.when(plain, x), _unicode_form("NFKD")(F.when(~plain, x)))


@cache
def _halves():
    """An Arrow UDF: characters outside the basic plane as two of its private ones, one for each UTF-16 unit."""

    def split(c: str) -> str:
        n = ord(c) - 0x10000
        return c if n < 0 else chr(0xE100 + (n >> 10)) + chr(0xE500 + (n & 0x3FF))

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else "".join(map(split, v)))

    return pandas_udf(run, "string")


def by_units(x: Column) -> Column:
    """A text with one character for each UTF-16 unit, for distances; only texts with characters of two units go through Python."""
    wide = x.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.coalesce(F.when(~wide, x), _halves()(F.when(wide, x)))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(x, f"{SPACE}+", " "))


def is_blank(x: Column) -> Column:
    return ~x.rlike(NOT_SPACE)


def units(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in doubles."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def mask_placeholders(x: Column) -> Column:
    """Placeholders as MARK, tags and entities as spaces: one scan brackets all matches, two more tell them apart."""
    bracketed = F.regexp_replace(x, f"(?i)({PLACEHOLDER})", f"{_OPEN}$1{_SHUT}")
    return F.regexp_replace(F.regexp_replace(bracketed, f"{_OPEN}[<&][^{_SHUT}]*{_SHUT}", " "), f"{_OPEN}[^{_SHUT}]*{_SHUT}", MARK)


def stages(value: Column) -> list[Column]:
    """The value after each stage of normalisation, in the order of KINDS; every stage starts from the one before."""
    white = collapse(nfkc(value))
    masked = collapse(mask_placeholders(white))
    lower = F.lower(masked)
    bare = trim(F.regexp_replace(lower, rf"[^\p{{L}}\p{{N}}\p{{M}}\x{{E000}}]+", " "))
    return [white, masked, lower, bare]


def normalise(value: Column) -> Column:
    return stages(value)[-1]


def strip_placeholders(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, f"(?i)(?:{PLACEHOLDER})", " "), f"https?://{NOT_SPACE}+", " ")


def clean(value: Column) -> Column:
    return collapse(strip_placeholders(value))


def is_invariant(value: Column) -> Column:
    """Whether a string may be the same in every language: hardly any letters, or one short or numbered upper-case code."""
    text = trim(strip_placeholders(value))
    letters = units(F.regexp_replace(text, r"[^\p{L}]", ""))
    code = text.rlike(r"^[\p{Lu}\p{N}_\-./:#]+$") & ((letters <= 4) | text.rlike(r"\p{N}"))
    return (letters <= 2) | code


def words(value: Column) -> Column:
    return F.regexp_extract_all(strip_placeholders(value), F.lit(WORD), F.lit(0))


def lemma(word: Column) -> Column:
    """Lower case, regular English plurals folded."""
    w = F.regexp_replace(F.lower(word), "’", "'")
    size = units(w)
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when((size <= 3) | w.rlike("[0-9]"), w)
        .when(w.endswith("ies") & (size > 4), F.concat(cut(3), F.lit("y")))
        .when(w.rlike("(?:ss|sh|ch|x|z|us)es$"), cut(2))
        .when(w.endswith("s") & ~w.rlike("(?:ss|us|is|'s)$"), cut(1))
        .otherwise(w)
    )


def lemmas(value: Column) -> Column:
    return F.transform(words(value), lemma)


def _among(x: Column, values: list[str]) -> Column:
    return x.isin(values)


def is_candidate(gram: Column) -> Column:
    """Whether an array of lemmas may be a term."""
    first, last = F.get(gram, F.lit(0)), F.get(gram, F.size(gram) - 1)
    digit = lambda w: w.rlike("^[0-9]")
    one = (units(first) >= 3) & ~_among(first, STOPWORDS) & ~digit(first)
    inner = F.slice(gram, 2, F.greatest(F.size(gram) - 2, F.lit(0)))
    more = ~_among(first, STOPWORDS) & ~_among(last, STOPWORDS) & ~F.exists(gram, digit) & F.forall(inner, lambda w: _among(w, INNER) | ~_among(w, STOPWORDS))
    return F.when(F.size(gram) == 1, one).otherwise(more)


def language(locale: Column) -> Column:
    return F.split_part(locale, F.lit("-"), F.lit(1))


def is_locale_code(name: Column) -> Column:
    return name.rlike(LOCALE)


def canonical_locale(code: Column) -> Column:
    return F.lower(F.translate(code, "_", "-"))


def locale_of_file(name: Column) -> Column:
    """The locale that a JSON file is named after, or null."""
    base = F.regexp_replace(name, r"\.json$", "")
    return F.when(name.endswith(".json") & is_locale_code(base), canonical_locale(base))


def sorted_tokens(norm: Column) -> Column:
    return F.array_join(F.array_sort(F.split(norm, " ")), " ")


def similarity(a: Column, b: Column, least: float) -> Column:
    """1 - distance / longer length; 0 if the distance is over what `least` allows."""
    longer = F.greatest(F.length(a), F.length(b))
    budget = F.floor(F.lit(1.0 - least) * longer).cast("int")
    distance = F.call_function("levenshtein", a, b, budget)
    return F.when(a == b, 1.0).when(distance < 0, 0.0).otherwise(1.0 - distance / longer)


def blocking_features(norm: Column) -> Column:
    """Distinct words of over one character; for texts of one or two such words, all trigrams of the padded text as well."""
    own = F.array_distinct(F.filter(F.split(norm, " "), lambda w: F.length(w) > 1))
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))
    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    return F.when(F.size(own) > 2, tag("w:", own)).otherwise(F.concat(tag("w:", own), tag("g:", grams)))


def fold_latin(x: Column) -> Column:
    return F.regexp_replace(nfkd(F.lower(x)), r"[^\p{L}\p{N}]", "")


def lemma_phrase(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, f"{SPACE}+"), lemma), " ")


def kept_english(text: Column, english: Column, term: Column) -> Column:
    """Whether a rendering keeps the English word: the same, part of it, or built on it."""
    t, e = fold_latin(text), fold_latin(english)
    plain = t.rlike("^[a-z0-9]+$") & (((F.length(e) >= 4) & t.contains(e)) | ((F.length(t) >= 3) & e.contains(t)))
    return F.when((t == "") | (e == ""), False).otherwise((t == e) | (lemma_phrase(text) == term) | plain)


def japanese_key(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, r"\p{IsHiragana}", ""), F.lit("")), text)


def script_of(char: Column) -> Column:
    return F.when(char.rlike(r"[\p{IsKatakana}ー]"), "kana").when(char.rlike(r"\p{IsHan}"), "han").when(char.rlike("[A-Za-z0-9]"), "latin").otherwise("other")


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", *parts).cast("binary"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
