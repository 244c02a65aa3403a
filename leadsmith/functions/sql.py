"""SQL surface (U1): the scalar cleaners as temporary SQL functions.

``register_sql_functions(spark)`` creates SQL user-defined functions
(``CREATE TEMPORARY FUNCTION ... RETURN <expression>``). Their bodies are
built-in expressions, so Catalyst inlines them like any other expression —
no Python runs per row. They share the regex/term constants of
``functions.columns`` and are tested to agree with the Column versions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .columns import CASED, PY_FLOAT_RE, PY_WS, WS_CLASS
from .constants import FREE_PROVIDERS, HASH_PATTERNS, NAME_TLDS, PERSONAL_RANKS


def _s(text: str) -> str:
    """Spark SQL string literal (raw: backslashes kept for the regex engine)."""
    return "r'" + text.replace("'", "\\'") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    return f"btrim({x}, {_s(PY_WS)})"


def _m5(x: str) -> str:
    return f"({x} IS NULL OR {x} = '' OR lower({x}) IN ('nan', 'none', 'null'))"


def clean_domain_sql(x: str = "x") -> str:
    ws, wsi = WS_CLASS, WS_CLASS[1:-1]
    d = f"lower({_strip(x)})"
    d = f"regexp_replace({d}, {_s('^https?://')}, '')"
    d = f"regexp_replace({d}, {_s('^www[.]')}, '')"
    d = f"substring_index({d}, '/', 1)"
    d = f"substring_index({d}, '?', 1)"
    for pat in (rf",?{ws}*[*][*][*]redacted[*]?[*]?", rf",?{ws}*redacted", rf",?{ws}*\[redacted\]",
                rf",?{ws}*\(redacted\)"):
        d = f"regexp_replace({d}, {_s(pat)}, '')"
    d = f"regexp_replace({d}, {_s(f'^[,{wsi}]+|[,{wsi}]+$')}, '')"
    d = f"regexp_replace({d}, {_s(f'{ws}*,{ws}*')}, ',')"
    d = f"CASE WHEN contains({d}, ',') THEN {_strip(f'substring_index({d}, {chr(39)},{chr(39)}, 1)')} ELSE {d} END"
    d = f"regexp_replace({d}, {_s('(?U)[^\\w.-]+$')}, '')"
    return f"CASE WHEN {_m5(x)} THEN '' ELSE {d} END"


def clean_integer_sql(x: str = "x") -> str:
    t = _strip(x)
    num = f"CAST(try_cast(bround(try_cast(replace({t}, '_', '') AS DOUBLE), 0) AS DECIMAL(38,0)) AS STRING)"
    return (f"CASE WHEN {_m5(x)} THEN '' WHEN {t} RLIKE {_s(PY_FLOAT_RE)} AND {num} IS NOT NULL THEN {num} "
            f"ELSE {t} END")


def normalize_text_sql(x: str = "x") -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = 'nan' THEN '' ELSE regexp_replace({_strip(x)}, {_s(WS_CLASS + '+')}, ' ') END"


def title_case_sql(x: str = "x") -> str:
    runs = f"([{CASED}]+|[^{CASED}]+)"
    return (f"array_join(transform(regexp_extract_all(lower({x}), {_s(runs)}, 1), "
            f"w -> concat(initcap(substr(w, 1, 1)), substr(w, 2))), '')")


def personal_rank_sql(x: str = "x") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PERSONAL_RANKS.items())
    return f"CASE lower(substring_index({x}, '@', -1)) {whens} END"


def company_name_sql(x: str = "x") -> str:
    alts = "|".join(t[1:] for t in NAME_TLDS)
    d = f"lower({_strip(x)})"
    base = f"regexp_replace(regexp_replace({d}, {_s(f'[.](?:{alts})$')}, ''), {_s('^www[.]')}, '')"
    words = f"transform(split({base}, '-'), w -> concat(initcap(substr(w, 1, 1)), lower(substr(w, 2))))"
    return f"CASE WHEN contains({d}, '.') AND {base} <> '' THEN array_join({words}, ' ') END"


def is_hash_like_sql(x: str = "x") -> str:
    v = _strip(x)
    pats = " OR ".join(f"{v} RLIKE {_s(p)}" for p in HASH_PATTERNS)
    return f"(length({v}) >= 10 AND ({pats}))"


def is_free_provider_sql(x: str = "x") -> str:
    return f"({x} IN ({', '.join(repr(d) for d in FREE_PROVIDERS)}))"


FUNCTIONS = {
    "clean_domain": ("STRING", clean_domain_sql),
    "clean_integer": ("STRING", clean_integer_sql),
    "normalize_text": ("STRING", normalize_text_sql),
    "title_case": ("STRING", title_case_sql),
    "personal_rank": ("INT", personal_rank_sql),
    "company_name_from_domain": ("STRING", company_name_sql),
    "is_hash_like": ("BOOLEAN", is_hash_like_sql),
    "is_free_provider": ("BOOLEAN", is_free_provider_sql),
}


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    names = []
    for name, (rtype, body) in FUNCTIONS.items():
        fn = prefix + name
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {fn}(x STRING) RETURNS {rtype} RETURN {body('x')}")
        names.append(fn)
    return names
