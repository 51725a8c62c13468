"""The detectors and rules as SQL text, for the independent check."""

from __future__ import annotations

from ..functions import detect

LEAD_COLUMNS = ["name", "email", "phone", "country", "status", "created", "budget_num", "budget", "interested", "remarks"]


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def trim(v: str) -> str:
    return rf"regexp_replace(regexp_replace({v}, '^\s+', ''), '\s+$', '')"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def email(v: str) -> str:
    return rf"regexp_matches({v}, '^[^\s@]+@[^\s@]+\.[^\s@]+$')"


def date(v: str) -> str:
    return "regexp_matches(" + v + ", '^(" + "|".join(detect.DATE_SHAPES) + ")$')"


def phone(v: str) -> str:
    return rf"(NOT {date(v)} AND regexp_matches({v}, '^[+()\-.\s\d]+$') AND length({digits(v)}) BETWEEN 7 AND 15)"


def numeric(v: str) -> str:
    return rf"regexp_matches(replace(regexp_replace(regexp_replace({v}, '^[+-]?\$', ''), '%$', ''), ',', ''), '^[+-]?\d+(\.\d+)?$')"


def empty(v: str) -> str:
    return f"lower({trim(v)}) IN ({quoted(detect.EMPTY_TOKENS)})"


def whitespace(v: str) -> str:
    return rf"trim(regexp_replace({v}, '[ \t]+', ' ', 'g'))"


def parts(v: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({v}, '{pattern}'), lambda p: trim(p)), lambda p: p <> '')"


EMAIL_PARTS = r"[;,]|(?i)\s+and\s+"
PHONE_PARTS = r"[;,/]|(?i)\s+or\s+"


def iso(v: str) -> str:
    """The ISO date of a text in any supported spelling, or null."""
    g = lambda p, i: f"regexp_extract({v}, '{p}', {i})"
    ok = lambda y, m, d: f"try_cast(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) IS NOT NULL"
    out = lambda y, m, d: f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    a, b, c, e = r"^(\d{4})-(\d{2})-(\d{2})([T ].*)?$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", r"^(\d{1,2})[-\s]([A-Za-z]{3,})[-\s](\d{4})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    month = f"CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({g(c, 2)}[1:3])) AS VARCHAR)"
    cases = []
    for p, y, m, d in ((a, g(a, 1), g(a, 2), g(a, 3)), (b, g(b, 1), g(b, 2), g(b, 3)), (c, g(c, 3), month, g(c, 1))):
        cases.append(f"WHEN regexp_matches({v}, '{p}') THEN CASE WHEN {ok(y, m, d)} THEN {out(y, m, d)} END")
    x, y, z = g(e, 1), g(e, 2), g(e, 3)
    number = lambda t: f"try_cast({t} AS INTEGER)"
    cases.append(f"WHEN regexp_matches({v}, '{e}') THEN CASE WHEN {number(x)} > 12 AND {number(y)} <= 12 AND {ok(z, y, x)} THEN {out(z, y, x)} WHEN {number(y)} > 12 AND {number(x)} <= 12 AND {ok(z, x, y)} THEN {out(z, x, y)} END")
    return "CASE " + " ".join(cases) + " END"


def number_text(v: str) -> str:
    """A double as text: DuckDB's own, which has an exponent from 1e16 on and below 1e-4, brought to one from 1e21 on and below 1e-6."""
    t = f"CAST({v} AS VARCHAR)"
    digits, power = f"replace(replace(regexp_extract({t}, '^([^e]*)e', 1), '.', ''), '-', '')", f"try_cast(regexp_extract({t}, 'e(.*)$', 1) AS INTEGER)"
    sign = f"CASE WHEN {v} < 0 THEN '-' ELSE '' END"
    return (
        f"CASE WHEN NOT contains({t}, 'e') THEN regexp_replace({t}, '\\.0$', '') "
        f"WHEN {power} >= 21 OR {power} < -6 THEN regexp_replace(regexp_replace({t}, '\\.0e', 'e'), 'e([+-]?)0', 'e\\1') "
        f"WHEN {power} < 0 THEN {sign} || '0.' || repeat('0', -{power} - 1) || {digits} ELSE {sign} || rpad({digits}, {power} + 1, '0') END"
    )


def ambiguous(v: str) -> str:
    e = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
    return f"(regexp_matches({v}, '{e}') AND coalesce(try_cast(regexp_extract({v}, '{e}', 1) AS INTEGER) <= 12, false) AND coalesce(try_cast(regexp_extract({v}, '{e}', 2) AS INTEGER) <= 12, false))"


def cells(columns: list[str] = LEAD_COLUMNS, source: str = "leads", row: str = "row_number") -> str:
    """Long cells of a table as SQL."""
    return " UNION ALL ".join(f"SELECT CAST({row} AS BIGINT) AS row_number, {i} AS column_index, '{c}' AS header, CAST({c} AS VARCHAR) AS raw_value FROM {source}" for i, c in enumerate(columns))


def fields(leads: str) -> str:
    """Common table expressions up to ``fields``: leads, cells, and their normalized values."""
    return rf"""
leads AS ({leads}), cells AS ({cells()}),
w AS (SELECT *, coalesce(raw_value, '') AS raw, {whitespace("coalesce(raw_value, '')")} AS v FROM cells),
k AS (SELECT *, CASE WHEN {empty('v')} THEN 'null'
   WHEN len(list_filter({parts('v', EMAIL_PARTS)}, lambda p: regexp_matches(p, '^[^\s@]+@[^\s@]+$'))) > 0 THEN 'email'
   WHEN len(list_filter({parts('v', PHONE_PARTS)}, lambda p: {phone('p')})) > 0 THEN 'phone'
   WHEN {date('v')} THEN 'date' WHEN {numeric('v')} THEN 'number'
   WHEN lower(v) IN ('yes','y','true','t','no','n','false','f') THEN 'boolean' ELSE 'text' END AS kind FROM w),
q AS (SELECT *, lower({parts('v', EMAIL_PARTS)}[1]) AS mail, {parts('v', PHONE_PARTS)}[1] AS tel, {iso('v')} AS iso,
   replace(replace(regexp_replace(v, '[$€£₹]', '', 'g'), '%', ''), ',', '') AS num FROM k),
fields AS (SELECT row_number, column_index, header, raw_value, kind,
   CASE kind WHEN 'null' THEN NULL WHEN 'email' THEN mail
     WHEN 'phone' THEN CASE WHEN regexp_matches(tel, '^\+') AND regexp_matches({digits('tel')}, '^91[6-9]\d{{9}}$') THEN '+' || {digits('tel')} ELSE {digits('tel')} END
     WHEN 'date' THEN coalesce(iso, v)
     WHEN 'number' THEN {number_text('CAST(num AS DOUBLE)')}
     WHEN 'boolean' THEN CASE WHEN lower(v) IN ('yes','y','true','t') THEN 'true' ELSE 'false' END
     ELSE translate(v, '“”‘’', '""''''') END AS normalized_value,
   CASE kind WHEN 'email' THEN CASE WHEN {email('mail')} THEN 1.0 ELSE 0.4 END
     WHEN 'phone' THEN CASE WHEN regexp_matches(tel, '^\+') AND regexp_matches({digits('tel')}, '^91[6-9]\d{{9}}$') THEN 1.0 ELSE 0.5 END
     WHEN 'date' THEN CASE WHEN iso IS NOT NULL THEN 1.0 WHEN {ambiguous('v')} THEN 0.3 ELSE 0.2 END ELSE 1.0 END::DOUBLE AS confidence,
   concat_ws(',', CASE WHEN v <> raw THEN 'whitespace' END, CASE WHEN kind <> 'text' THEN kind WHEN translate(v, '“”‘’', '""''''') <> v THEN 'text' END) AS applied_rules
   FROM q)
"""
