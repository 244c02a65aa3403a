"""Column expressions: missing-value predicates and the scalar cleaners.

All of these are built-in Spark expressions (whole-stage codegen where Spark
supports it, interpreted lambdas only for title case / e-mail arrays); no
Python UDF is involved, so they run identically in batch and streaming plans.

Text semantics follow Python's ``str`` methods: whitespace is the Unicode
``isspace`` set (derived below from that rule), not Spark's ASCII ``trim``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FREE_PROVIDERS, NAME_TLDS, PERSONAL_RANKS

# Python's whitespace set, derived from str.isspace (all such code points are < U+3001).
PY_WS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# The same set as a Java regex character class.
WS_CLASS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WS) + "]"


def C(name: str) -> Column:
    """Column by its exact name (spaces, dots and back-ticks allowed); reused per session."""
    return _cached("col:" + name, lambda: F.col("`" + name.replace("`", "``") + "`"))


def _cached(name: str, make):
    """Reuse constant Columns (names, literals, map literals) within one SparkContext.

    The cache lives on the active SparkContext object, so a stopped context
    takes its Columns with it.
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None:
        return make()
    cache = sc.__dict__.setdefault("_leadsmith_columns", {})
    if name not in cache:
        cache[name] = make()
    return cache[name]


def strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(c, _cached("ws", lambda: F.lit(PY_WS)))


def _lower_in(c: Column, words) -> Column:
    return F.lower(c).isin(list(words))


# ---------------------------------------------------------------------------
# Missing-value predicates M1..M9 (True = the value counts as missing).
# ---------------------------------------------------------------------------

def m1(c: Column) -> Column:
    """Priority mapping: null, '' or lower == 'nan' (blank is a value)."""
    return c.isNull() | (c == "") | (F.lower(c) == "nan")


def m2_target(c: Column) -> Column:
    """Variant consolidation, target side: null or blank."""
    return c.isNull() | (strip(c) == "")


def m2(c: Column) -> Column:
    """Variant consolidation, source side: null, blank or lower == 'nan'."""
    return c.isNull() | (strip(c) == "") | (F.lower(c) == "nan")


def m3(c: Column) -> Column:
    """Names / company domain / company name: null, blank, lower in nan/none/null."""
    return c.isNull() | (strip(c) == "") | _lower_in(c, ("nan", "none", "null"))


def m4(c: Column) -> Column:
    """E-mail collection: null, blank or lower == 'nan' ('none'/'null' are kept)."""
    return c.isNull() | (strip(c) == "") | (F.lower(c) == "nan")


def m5(c: Column) -> Column:
    """Domain / integer cleaning: null, '' or lower in nan/none/null (no trim)."""
    return c.isNull() | (c == "") | _lower_in(c, ("nan", "none", "null"))


def m6(c: Column) -> Column:
    """Dedup key parts: null, blank, lower in nan/none ('null' is a value)."""
    return c.isNull() | (strip(c) == "") | _lower_in(c, ("nan", "none"))


def m7(c: Column) -> Column:
    """Group merge: null, blank, lower in nan/none."""
    return c.isNull() | (strip(c) == "") | _lower_in(c, ("nan", "none"))


def m8(c: Column) -> Column:
    """Composite sample: null, blank, lower in nan/null/none."""
    return c.isNull() | (strip(c) == "") | _lower_in(c, ("nan", "null", "none"))


def m9(c: Column) -> Column:
    """Payload: null only."""
    return c.isNull()


def m9_additional(c: Column) -> Column:
    """Payload additional_fields: null or ''."""
    return c.isNull() | (c == "")


MISSING = {"m1": m1, "m2": m2, "m3": m3, "m4": m4, "m5": m5,
           "m6": m6, "m7": m7, "m8": m8, "m9": m9}


# ---------------------------------------------------------------------------
# Scalar cleaners.
# ---------------------------------------------------------------------------

def na_token_to_null(c: Column, tokens) -> Column:
    """CSV NA tokens (exact, untrimmed) -> null."""
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def collapse_ws(c: Column) -> Column:
    """strip + collapse every whitespace run to one space."""
    return F.regexp_replace(strip(c), WS_CLASS + "+", " ")


def normalize_text(c: Column) -> Column:
    """Whitespace normalisation: null or exactly 'nan' -> '', else strip+collapse."""
    return F.when(c.isNull() | (c == "nan"), F.lit("")).otherwise(collapse_ws(c))


# Python's "cased" characters (upper, lower and title case letters) decide word starts in str.title().
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def title_case(c: Column) -> Column:
    """Python ``str.title()``: title-case the first cased letter after any uncased character.

    The lower-cased text is cut into runs of cased / uncased characters; each
    run's first character goes through ``initcap`` (Java title-case mapping).
    """
    pieces = F.regexp_extract_all(F.lower(c), F.lit(f"([{CASED}]+|[^{CASED}]+)"), 1)
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.initcap(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        "",
    )


def title_name(c: Column) -> Column:
    """Name/title column rule: '' or 'nan' -> '', else title case."""
    return F.when(c.isNull() | (c == "") | (F.lower(c) == "nan"), F.lit("")).otherwise(title_case(c))


# Python float() syntax (digits with single underscores, optional fraction/exponent).
_DIGITS = r"\d(?:_?\d)*"
PY_FLOAT_RE = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def clean_integer(c: Column) -> Column:
    """Numeric text -> integer text rounded half-even; other text -> stripped text."""
    t = strip(c)
    as_num = F.replace(t, F.lit("_"), F.lit("")).try_cast("double")
    rounded = F.bround(as_num, 0).try_cast("decimal(38,0)").cast("string")
    return (
        F.when(m5(c), F.lit(""))
        .when(t.rlike(PY_FLOAT_RE) & rounded.isNotNull(), rounded)
        .otherwise(t)
    )


def clean_domain(c: Column) -> Column:
    """Domain cleaning chain (scheme, www, path, query, redaction, lists, trailing junk)."""
    ws = WS_CLASS
    d = F.lower(strip(c))
    d = F.regexp_replace(d, r"^https?://", "")
    d = F.regexp_replace(d, r"^www\.", "")
    d = F.substring_index(d, "/", 1)
    d = F.substring_index(d, "?", 1)
    d = F.regexp_replace(d, rf",?{ws}*\*\*\*redacted\*?\*?", "")
    d = F.regexp_replace(d, rf",?{ws}*redacted", "")
    d = F.regexp_replace(d, rf",?{ws}*\[redacted\]", "")
    d = F.regexp_replace(d, rf",?{ws}*\(redacted\)", "")
    d = F.regexp_replace(d, rf"^[,{ws[1:-1]}]+|[,{ws[1:-1]}]+$", "")
    d = F.regexp_replace(d, rf"{ws}*,{ws}*", ",")
    d = F.when(d.contains(","), strip(F.substring_index(d, ",", 1))).otherwise(d)
    d = F.regexp_replace(d, r"(?U)[^\w.-]+$", "")
    return F.when(m5(c), F.lit("")).otherwise(d)


def email_domain(c: Column) -> Column:
    """Text after the last '@'."""
    return F.substring_index(c, "@", -1)


def _rank_map() -> Column:
    def make():
        items = []
        for k, v in PERSONAL_RANKS.items():
            items += [F.lit(k), F.lit(v)]
        return F.create_map(*items)
    return _cached("ranks", make)


def personal_rank(email: Column) -> Column:
    """Rank of a personal address (null when not personal)."""
    return F.element_at(_rank_map(), F.lower(email_domain(email)))


def is_personal_email(email: Column) -> Column:
    return email.contains("@") & personal_rank(email).isNotNull()


def is_free_provider(domain: Column) -> Column:
    return domain.isin(FREE_PROVIDERS)


def domain_from_email(email: Column) -> Column:
    """Second '@'-separated part of a stripped e-mail, lower-cased."""
    return F.lower(F.get(F.split(strip(email), "@"), 1))


def company_name_from_domain(domain: Column) -> Column:
    """Drop one known suffix and 'www.', then capitalise each '-' separated word.

    Returns null when nothing can be generated (no '.', or nothing left).
    """
    d = F.lower(strip(domain))
    alts = "|".join(t[1:] for t in NAME_TLDS)
    base = F.regexp_replace(F.regexp_replace(d, rf"\.(?:{alts})$", ""), r"^www\.", "")
    words = F.transform(
        F.split(base, "-"),
        lambda w: F.concat(F.initcap(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))),
    )
    return F.when(d.contains(".") & (base != ""), F.array_join(words, " "))


def split_multi_emails(c: Column) -> Column:
    """Addresses in one field: split on : , ; | and whitespace when a delimiter is present."""
    parts = F.filter(
        F.transform(F.split(c, r"[;:,|\s]+"), lambda e: strip(e)),
        lambda e: e.contains("@"),
    )
    has_delim = c.rlike(r"[:,;|]")
    single = F.when(c.contains("@"), F.array(strip(c))).otherwise(F.array().cast("array<string>"))
    return (
        F.when(c.isNull() | (strip(c) == ""), F.array().cast("array<string>"))
        .when(has_delim, parts)
        .otherwise(single)
    )


def is_hash_like(c: Column) -> Column:
    """len >= 10 and one of the id/hash shapes (value stripped first)."""
    from .constants import HASH_PATTERNS

    v = strip(c)
    hit = F.lit(False)
    for p in HASH_PATTERNS:
        hit = hit | v.rlike(p)
    return (F.length(v) >= 10) & hit
