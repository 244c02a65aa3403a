"""DuckDB twins of the Spark plans (the correctness oracle).

These render the same semantics as independent SQL text for DuckDB, over the
same driver tables, so the driver can compare both engines' results. They are
test oracles, not an execution path of the library.
"""

from __future__ import annotations

from collections import OrderedDict

from ..functions.columns import PY_WS
from ..functions.constants import (
    CONSOLIDATION_RULES, DEDUP_KEYS, FREE_PROVIDERS, INTEGER_FIELDS, NAME_TLDS,
    PERSONAL_RANKS, standard_fields,
)
from ..operators.standardize import PRIORITIES, plan_mappings

WS = "'" + PY_WS + "'"
WSC = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WS) + "]"
WSI = WSC[1:-1]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def m1(x):
    return f"({x} is null or {x} = '' or lower({x}) = 'nan')"


def m2t(x):
    return f"({x} is null or {strip(x)} = '')"


def m2(x):
    return f"({x} is null or {strip(x)} = '' or lower({x}) = 'nan')"


def m3(x):
    return f"({x} is null or {strip(x)} = '' or lower({x}) in ('nan', 'none', 'null'))"


def m4(x):
    return f"({x} is null or {strip(x)} = '' or lower({x}) = 'nan')"


def m5(x):
    return f"({x} is null or {x} = '' or lower({x}) in ('nan', 'none', 'null'))"


def m6(x):
    return f"({x} is null or {strip(x)} = '' or lower({x}) in ('nan', 'none'))"


m7 = m6


def m8(x):
    return f"({x} is null or {strip(x)} = '' or lower({x}) in ('nan', 'null', 'none'))"


def normalize_text(x):
    return f"(case when {x} is null or {x} = 'nan' then '' else regexp_replace({strip(x)}, '{WSC}+', ' ', 'g') end)"


def title_case(x):
    cased = "\\p{Lu}\\p{Ll}\\p{Lt}"
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '([{cased}]+|[^{cased}]+)', 1), "
            f"lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), '')")


def title_name(x):
    return f"(case when {x} is null or {x} = '' or lower({x}) = 'nan' then '' else {title_case(x)} end)"


_D = r"\d(?:_?\d)*"
PY_FLOAT_RE = rf"^[+-]?(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?$"


def clean_integer(x):
    t = strip(x)
    num = f"cast(cast(round_even(try_cast(replace({t}, '_', '') as double), 0) as decimal(38,0)) as varchar)"
    return (f"(case when {m5(x)} then '' when regexp_full_match({t}, '{PY_FLOAT_RE}') "
            f"and try_cast(replace({t}, '_', '') as double) is not null then {num} else {t} end)")


def clean_domain(x):
    d = f"lower({strip(x)})"
    d = f"regexp_replace({d}, '^https?://', '')"
    d = f"regexp_replace({d}, '^www\\.', '')"
    d = f"split_part({d}, '/', 1)"
    d = f"split_part({d}, '?', 1)"
    d = f"regexp_replace({d}, ',?{WSC}*\\*\\*\\*redacted\\*?\\*?', '', 'g')"
    d = f"regexp_replace({d}, ',?{WSC}*redacted', '', 'g')"
    d = f"regexp_replace({d}, ',?{WSC}*\\[redacted\\]', '', 'g')"
    d = f"regexp_replace({d}, ',?{WSC}*\\(redacted\\)', '', 'g')"
    d = f"regexp_replace({d}, '^[,{WSI}]+|[,{WSI}]+$', '', 'g')"
    d = f"regexp_replace({d}, '{WSC}*,{WSC}*', ',', 'g')"
    d = f"(case when contains({d}, ',') then {strip(f'split_part({d}, chr(44), 1)')} else {d} end)"
    d = f"regexp_replace({d}, '[^\\w.-]+$', '')"
    return f"(case when {m5(x)} then '' else {d} end)"


def email_domain(x):
    return f"string_split({x}, '@')[-1]"


def personal_rank(x):
    whens = " ".join(f"when {lit(k)} then {v}" for k, v in PERSONAL_RANKS.items())
    return f"(case lower({email_domain(x)}) {whens} end)"


def is_personal(x):
    return f"(contains({x}, '@') and {personal_rank(x)} is not null)"


def domain_from_email(x):
    return f"lower(string_split({strip(x)}, '@')[2])"


def company_name_from_domain(x):
    d = f"lower({strip(x)})"
    alts = "|".join(t[1:] for t in NAME_TLDS)
    base = f"regexp_replace(regexp_replace({d}, '\\.(?:{alts})$', ''), '^www\\.', '')"
    words = f"list_transform(string_split({base}, '-'), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2)))"
    return f"(case when contains({d}, '.') and {base} <> '' then array_to_string({words}, ' ') end)"


def split_multi_emails(x):
    parts = f"list_filter(list_transform(regexp_split_to_array({x}, '[;:,|\\s]+'), lambda e: {strip('e')}), lambda e: contains(e, '@'))"
    return (f"(case when {x} is null or {strip(x)} = '' then []::varchar[] "
            f"when regexp_matches({x}, '[:,;|]') then {parts} "
            f"when contains({x}, '@') then [{strip(x)}] else []::varchar[] end)")


# ---------------------------------------------------------------------------
# Pipeline CTE builder (mirrors plans.pipeline.clean_leads)
# ---------------------------------------------------------------------------

class Chain:
    """Accumulates named CTEs; each step is a full projection of named expressions."""

    def __init__(self, base_sql: str, cols: list[str]):
        self.ctes = [("s0", base_sql)]
        self.cols = OrderedDict((c, q(c)) for c in cols)
        self.extra = ["_row"]

    def step(self, plan: "OrderedDict[str, str]", extra=None):
        name = f"s{len(self.ctes)}"
        prev = self.ctes[-1][0]
        extra = self.extra if extra is None else extra
        sel = ", ".join([f"{e} as {q(n)}" for n, e in plan.items()] + [q(x) for x in extra])
        self.ctes.append((name, f"select {sel} from {prev}"))
        self.cols = OrderedDict((c, q(c)) for c in plan)
        self.extra = list(extra)

    def raw(self, sql_from_prev: str, cols: list[str], extra: list[str]):
        name = f"s{len(self.ctes)}"
        self.ctes.append((name, sql_from_prev.replace("{prev}", self.ctes[-1][0])))
        self.cols = OrderedDict((c, q(c)) for c in cols)
        self.extra = list(extra)

    def sql(self, final_select: str | None = None) -> str:
        body = ",\n".join(f"{n} as materialized ({s})" for n, s in self.ctes)
        last = self.ctes[-1][0]
        return f"with {body}\n" + (final_select.replace("{prev}", last) if final_select else f"select * from {last}")


def raw_chain(fixture_sql: str, fixture_cols: list[str]) -> Chain:
    cols = [c for c in fixture_cols if c not in ("row_idx", "source")]
    base = (f"select {', '.join(f'cast({q(c)} as varchar) as {q(c)}' for c in cols)}, source as \"Source\", cast(row_idx as bigint) as _row "
            f"from ({fixture_sql})")
    return Chain(base, cols + ["Source"])


def standardize_step(ch: Chain, spec, table_type: str, consolidate=True):
    cols = list(ch.cols)
    merged = plan_mappings(spec)
    plan = OrderedDict()
    for h in standard_fields(table_type):
        if h in merged:
            cands = [c for p in PRIORITIES for c in merged[h][p] if c and c in cols]
            parts = [f"case when not {m1(q(c))} then {q(c)} end" for c in cands]
            plan[h] = f"coalesce({', '.join(parts + [lit('')])})"
        else:
            plan[h] = "''"
    plan["Source"] = q("Source")
    used = {"Source"} | {c for s in merged.values() for p in PRIORITIES for c in s[p] if c}
    for c in cols:
        if c not in used:
            plan[c] = q(c)
    if consolidate:
        plan = consolidate_plan(plan, table_type)
    ch.step(plan)


def consolidate_plan(plan, table_type):
    plan = OrderedDict(plan)
    for target, variants in CONSOLIDATION_RULES[table_type]:
        by_lower = {}
        for n in plan:
            by_lower[n.lower()] = n
        found = []
        for v in variants:
            a = by_lower.get(v.lower())
            if a is not None and a not in found:
                found.append(a)
        if not found:
            continue
        if target not in plan:
            plan[target] = "''"
        for v in found:
            t, s = plan[target], plan[v]
            plan[target] = f"(case when {m2t(t)} and not {m2(s)} then {s} else {t} end)"
            if v != target:
                del plan[v]
    return plan


def enrich_steps(ch: Chain):
    split_step(ch)
    emails_step(ch)
    domain_step(ch)
    clean_domains_step(ch)
    cname_step(ch)
    normalize_step(ch)


def split_step(ch: Chain):
    cols = list(ch.cols)
    if "Full Name" in cols:
        plan = OrderedDict(ch.cols)
        first = q("First Name") if "First Name" in cols else "cast(null as varchar)"
        last = q("Last Name") if "Last Name" in cols else "cast(null as varchar)"
        parts = f"regexp_split_to_array({strip(q('Full Name'))}, '{WSC}+')"
        ok = f"not {m3(q('Full Name'))}"
        plan["First Name"] = f"(case when {ok} and {m3(first)} and len({parts}) >= 1 then {parts}[1] else {first} end)"
        plan["Last Name"] = f"(case when {ok} and {m3(last)} and len({parts}) >= 2 then {parts}[-1] else {last} end)"
        ch.step(plan)


def emails_step(ch: Chain):
    cols = list(ch.cols)
    ecols = [c for c in cols if "email" in c.lower()]
    arr = "list_filter([" + ", ".join(f"case when not {m4(q(c))} then lower({strip(q(c))}) end" for c in ecols) + \
          "]::varchar[], lambda e: e is not null)"
    plan = OrderedDict(ch.cols)
    for c in ecols:
        if c not in ("Personal Email", "Work Email"):
            plan[c] = "''"
    pers = f"list_filter(__emails, lambda e: {is_personal('e')})"
    ranks = f"list_transform({pers}, lambda e: {personal_rank('e')})"
    plan["Personal Email"] = f"coalesce({pers}[list_position({ranks}, list_max({ranks}))], '')"
    plan["Work Email"] = f"coalesce(list_filter(__emails, lambda e: not {is_personal('e')})[1], '')"
    ch.raw(f"select *, {arr} as __emails from {{prev}}", list(ch.cols), ch.extra + ["__emails"])
    ch.step(plan, extra=[x for x in ch.extra if x != "__emails"])


def domain_step(ch: Chain):
    cols = list(ch.cols)
    if "Company Domain" in cols and "Work Email" in cols:
        we = q("Work Email")
        usable = (f"({we} is not null and {strip(we)} <> '' and contains({we}, '@') "
                  f"and lower({we}) not in ('nan', 'none', 'null', ''))")
        dom = domain_from_email(we)
        plan = OrderedDict(ch.cols)
        plan["Company Domain"] = (f"(case when {m3(q('Company Domain'))} and {usable} and "
                                  f"coalesce({dom} not in {inlist(FREE_PROVIDERS)}, true) then {dom} "
                                  f"else {q('Company Domain')} end)")
        ch.step(plan)


def cname_step(ch: Chain):
    cols = list(ch.cols)
    if "Company Domain" in cols:
        name = q("Company Name") if "Company Name" in cols else "''"
        gen = company_name_from_domain(q("Company Domain"))
        plan = OrderedDict(ch.cols)
        plan["Company Name"] = (f"(case when {m3(name)} and not {m3(q('Company Domain'))} and {gen} is not null "
                                f"then {gen} else {name} end)")
        ch.step(plan)


def normalize_step(ch: Chain):
    plan = OrderedDict(ch.cols)
    for c in list(plan):
        if c == "Source":
            continue
        v = normalize_text(q(c))
        if "name" in c.lower() or "title" in c.lower():
            v = title_name(v)
        if c in INTEGER_FIELDS:
            v = clean_integer(v)
        plan[c] = v
    ch.step(plan)


def clean_domains_step(ch: Chain):
    plan = OrderedDict(ch.cols)
    for c in list(plan):
        if "domain" in c.lower() or "website" in c.lower():
            plan[c] = clean_domain(q(c))
    ch.step(plan)


def key_expr(cols, table_type):
    keys = [k for k in DEDUP_KEYS[table_type] if k in cols]
    parts = [f"case when not {m6(q(k))} then lower({strip(q(k))}) end" for k in keys]
    j = f"concat_ws('|', {', '.join(parts)})"
    return f"(case when {j} = '' then 'unique_' || cast(_row as varchar) else {j} end)"


def dedup_step(ch: Chain, table_type: str):
    cols = list(ch.cols)
    ch.raw(f"select *, {key_expr(cols, table_type)} as _key from {{prev}}", cols, ch.extra + ["_key"])
    keyed = ch.ctes[-1][0]
    aggs = ["count(*) as __n", "min(_row) as _row"]
    outs = []
    for i, c in enumerate(cols):
        if c == "Source":
            continue
        t = strip(q(c))
        aggs.append(f"first({t} order by length({t}) desc, _row) filter (where not {m7(q(c))}) as __b{i}")
        aggs.append(f"any_value({q(c)}) as __r{i}")
        outs.append(f"case when __n = 1 then __r{i} else coalesce(__b{i}, '') end as {q(c)}")
    aggs.append(f"any_value(\"Source\") as __src_raw")
    src = (f"(select _key, string_agg(s, '; ' order by f) as srcs from (select _key, {strip(q('Source'))} as s, "
           f"min(_row) as f from {keyed} where not {m7(q('Source'))} group by 1, 2) group by 1)")
    outs.append("case when __n = 1 then __src_raw else coalesce(srcs, '') end as \"Source\"")
    sql = (f"select {', '.join(outs)}, _row, g._key as _key, __n as _n from "
           f"(select _key, {', '.join(aggs)} from {keyed} group by _key) g left join {src} s on g._key = s._key")
    # restore column order
    ch.raw(sql, [c for c in cols if c != "Source"] + ["Source"], ["_row", "_key", "_n"])
    plan = OrderedDict((c, q(c)) for c in cols)
    ch.step(plan, extra=["_row", "_key", "_n"])


def clean_leads_sql(fixture_sql: str, fixture_cols: list[str], spec, table_type: str,
                    final_select: str | None = None) -> str:
    ch = raw_chain(fixture_sql, fixture_cols)
    standardize_step(ch, spec, table_type)
    enrich_steps(ch)
    dedup_step(ch, table_type)
    clean_domains_step(ch)
    return ch.sql(final_select)


# ---------------------------------------------------------------------------
# Column profile (mirrors operators.profile.column_profile)
# ---------------------------------------------------------------------------

def contains_any(low: str, terms) -> str:
    arr = "[" + ", ".join(lit(t) for t in terms) + "]"
    return f"(len(list_filter({arr}, lambda t: contains({low}, t))) > 0)"


def is_useless(name: str, sample: str, unwanted=None) -> str:
    from ..functions.constants import (BOOLEANISH_SAMPLES, HASH_PATTERNS, ID_TERMS, IMPORTANT_TERMS,
                                       TRACKING_TERMS, UNWANTED_TERMS)
    unwanted = [t.lower() for t in (unwanted or UNWANTED_TERMS)]
    low = f"lower({name})"
    v = strip(f"coalesce({sample}, '')")
    hashes = " or ".join(f"regexp_matches({v}, {lit(p)})" for p in HASH_PATTERNS)
    return (f"({contains_any(low, unwanted)} or {contains_any(low, ID_TERMS)} "
            f"or (length({v}) >= 10 and ({hashes})) "
            f"or (lower({v}) in {inlist(BOOLEANISH_SAMPLES)} and not {contains_any(low, IMPORTANT_TERMS)}) "
            f"or (regexp_matches({name}, '^.+/\\d+$') and {v} = '') "
            f"or {contains_any(low, TRACKING_TERMS)} "
            f"or (length({name}) - length(replace({name}, '/', ''))) > 2)")


def profile_sql(base_sql: str, cols: list[str], sample_rows=1000, headers=None) -> str:
    """base_sql yields cols + "Source" + _row; headers: file -> its columns (None: all files have all)."""
    cells = ", ".join(f"{{'ordinal': {i}, 'column_name': {lit(c)}, 'value': cast({q(c)} as varchar)}}"
                      for i, c in enumerate(cols))
    own = "true" if headers is None else " or ".join(
        f"(\"Source\" = {lit(f)} and c.column_name in {inlist(cs)})" for f, cs in headers.items())
    t = strip("value")
    return f"""
with base as materialized (select *, row_number() over (partition by "Source" order by _row) as pos from ({base_sql})),
cells as materialized (select "Source", pos, c.ordinal as ordinal, c.column_name as column_name, c.value as value
  from (select "Source", pos, unnest([{cells}]) as c from base) where {own}),
prof as materialized (select "Source", ordinal, column_name,
  first(coalesce(value, '') order by pos) as first_value,
  first({t} order by length({t}) desc, pos) filter (where pos <= {sample_rows} and not {m8('value')}) as best_v,
  max(length({t})) filter (where pos <= {sample_rows} and not {m8('value')}) as best_n,
  count_if(value is not null) as non_null,
  count_if(value is null or {t} <> '') as not_blank,
  count_if(pos <= {sample_rows} and value is not null) as smp_non_null,
  count_if(pos <= {sample_rows} and (value is null or {t} <> '')) as smp_not_blank,
  count_if(pos <= {sample_rows}) as smp_rows
  from cells group by all),
flagged as materialized (select "Source", ordinal, column_name, first_value,
  (non_null = 0 or not_blank = 0) as is_empty,
  {is_useless('column_name', 'first_value')} as is_junk,
  case when not (smp_rows > 1 and smp_non_null > 0 and smp_not_blank > 0) then first_value
       when best_v is null then first_value
       when not {m8('first_value')} and length({strip('first_value')}) >= best_n then first_value
       else best_v end as sample_value,
  cast(non_null as bigint) as non_null_count from prof)
select *, (not is_empty and (not is_junk or max(case when not is_empty and not is_junk then 1 else 0 end)
  over (partition by "Source") = 0)) as kept from flagged"""
