"""Pieces of SQL, for DuckDB, that say what the operators say."""

from __future__ import annotations

from doclens.functions import patterns as P
from doclens.operators import checks, classify, extract, quality, score

def lines(source: str, text: str = "raw_text", name: str = "lines") -> str:
    return f"""{name} AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS start
  FROM (SELECT doc_id, (i - 1)::int AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split({text}, chr(10)) AS ls FROM {source} WHERE {text} IS NOT NULL), unnest(range(1, len(ls) + 1)) AS r(i)))"""


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern}')"


def group(col: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({col}, '{pattern}', {n}), '')"


def size(col: str, pattern: str, n: int) -> str:
    return f"length(regexp_extract({col}, '{pattern}', {n}))"


def gone(col: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({col}, '{pattern}', {by}, 'g')"


def any_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


TIDY = lambda c: gone(gone(c, P.TIDY_LEFT), P.TIDY_RIGHT)
LEAD = lambda c: f"(length({c}) - length({gone(c, P.TIDY_LEFT)}))"
SQUEEZED = lambda c: f"lower(trim({gone(c, chr(92) + 's+', repr(' '))}))"
NAME_KEY = lambda c: f"trim({gone(SQUEEZED(c), '^[.,;:]+|[.,;:]+$')})"
VALUE_KEY = lambda c: f"lower({gone(c, chr(92) + 's+')})"
LEGIBLE = lambda c: f"length({gone(c, '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')})"
PRESCRIBED = f"({has('line', P.FREQUENCY_CODE.anywhere)} OR {has('line', P.MEDICINE_DOSE)} OR {has('ltrim(line)', P.LEADING_FORM)})"
LAB = f"({has('line', P.LAB_ROW)} AND ({group('line', P.LAB_ROW, 6)} IS NOT NULL OR {group('line', P.LAB_ROW, 8)} IS NOT NULL) AND NOT {has('line', P.NOT_MEDICINE_LINE)} AND NOT {has('line', P.DATE)})"
ROUTE = f"""CASE WHEN {has('line', P.ALLERGY)} OR {has('line', P.NO_ALLERGY)} THEN 'allergy' WHEN {has('line', P.DIAGNOSIS)} THEN 'diagnosis' WHEN {has('line', P.COMPLAINT)} THEN 'complaint'
  WHEN NOT {PRESCRIBED} AND {has('line', P.VITAL_MEASURE)} THEN 'vitals' WHEN {has('trim(line)', P.PANEL)} THEN 'panel' WHEN NOT {PRESCRIBED} AND {LAB} THEN 'lab' ELSE 'medicine' END"""
IS_NAME = f"length(name) >= 2 AND {has('name', '[A-Za-z]{3,}')} AND NOT {has('name', P.WHOLE_DOSE)} AND NOT {has('name', '^' + P.STRENGTHS)}"


def medicines(source: str, mention: str) -> str:
    """CTEs up to `medicines` over lines(doc_id, line_no, start, line); `mention` says which lines only name medicines."""
    found = {"dose": P.DOSE, "bare": P.BARE_NUMBER, "code": P.FREQUENCY_CODE, "phrase": P.FREQUENCY_PHRASE, "span": P.DURATION}
    parts = ", ".join(f"{group('tail', m.parts, 2)} AS {n}, base + {size('tail', m.parts, 1)} AS {n}_at" for n, m in found.items())
    return f"""segs AS (SELECT * EXCLUDE (parts, i), (i - 1)::int AS seg_no, parts[i] AS seg, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::int AS seg_at FROM (
  SELECT *, {mention} AS mention, string_split(substring(line, 1, 3) || regexp_replace(substring(line, 4), '{P.SEGMENT}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM {source} WHERE NOT {has('line', P.NOT_MEDICINE_LINE)}), unnest(range(1, len(parts) + 1)) AS r(i)),
heads AS (SELECT *, length(regexp_extract(seg, '{P.NUMBERED}')) AS head, substring(seg, head + 1) AS body, {size('body', P.LEADING_FORM, 1)} AS form, {size('body', P.PRODUCT, 1)} AS before, regexp_extract(body, '{P.PRODUCT}', 2) AS product,
  seg_at + length(seg) AS seg_end, seg_at + head + CASE WHEN mention THEN before ELSE form END AS begin_, CASE WHEN mention THEN begin_ + length(product) ELSE seg_end END AS end_,
  CASE WHEN NOT mention OR (product <> '' AND lower(product) NOT IN {any_in(P.NOT_PRODUCT)}) THEN substring(line, begin_ + 1, end_ - begin_) END AS source_ FROM segs),
named AS (SELECT *, coalesce({group('source_', P.NAME_STOP, 1)}, source_) AS stretch, {TIDY('stretch')} AS name, begin_ + {LEAD('stretch')} AS name_at FROM heads WHERE source_ IS NOT NULL),
tails AS (SELECT *, CASE WHEN regexp_matches(name, '\\w$') THEN 'a' ELSE ' ' END || substring(line, name_at + length(name) + 1, seg_end - name_at - length(name)) AS tail, name_at + length(name) - 1 AS base, {has('tail', P.STRENGTHS)} AS several, {parts}
  FROM named WHERE {IS_NAME}),
medicines AS (SELECT *, CASE WHEN NOT several THEN coalesce(dose, bare) END AS dosage, CASE WHEN dose IS NOT NULL THEN dose_at ELSE bare_at END AS dosage_at, code IS NOT NULL AND (phrase IS NULL OR code_at <= phrase_at) AS earlier,
  CASE WHEN NOT mention THEN CASE WHEN earlier THEN code ELSE phrase END END AS frequency, CASE WHEN earlier THEN code_at ELSE phrase_at END AS frequency_at, CASE WHEN NOT mention THEN span END AS duration, span_at AS duration_at FROM tails
  WHERE CASE WHEN mention THEN (NOT several AND coalesce(dose, bare) IS NOT NULL) OR several OR form > 0 OR product <> '' ELSE form > 0 OR code IS NOT NULL OR coalesce({has('dose', P.PLAIN_DOSE)}, false) END)"""


def classified(source: str) -> str:
    points = {f: " + ".join(f"CASE WHEN {has('low', e.pattern)} THEN {e.points} ELSE 0 END" for e in P.SIGNALS if e.family == f) for f in classify.FAMILIES}
    points["prescription"] += f" + CASE WHEN len(list_filter(string_split(low, chr(10)), lambda x: {has('trim(x)', P.LEADING_FORM)})) >= 2 THEN 2 ELSE 0 END"
    doubled = r"regexp_replace(low, '([\s,;])', '\1\1', 'g')"
    points["prescription"] += f" + CASE WHEN len(regexp_extract_all({doubled}, '{P.FREQUENCY_CODE.anywhere}')) >= 2 THEN 2 ELSE 0 END"
    points["lab"] += f" + CASE WHEN len(list_filter(string_split(low, chr(10)), lambda x: {has('x', P.LAB_ROW)})) >= 3 THEN 2 ELSE 0 END"
    return f"""scored AS (SELECT doc_id, raw_text, {', '.join(f'{v} AS {k}' for k, v in points.items())}, {has('low', P.MEDICAL)} AS medical FROM (SELECT *, lower(coalesce(raw_text, '')) AS low FROM {source})),
classified AS (SELECT *, kind NOT IN {classify.NOT_ABOUT_A_PATIENT} AS about_a_patient FROM (SELECT *, CASE WHEN discharge >= 3 THEN 'discharge_summary' WHEN lab >= 3 THEN 'lab_report'
  WHEN invoice >= 5 THEN CASE WHEN medical THEN 'medical_invoice' ELSE 'unknown' END WHEN product_info >= 4 THEN 'pharmaceutical_information' WHEN prescription >= 4 THEN 'prescription'
  WHEN medical AND (prescription > 0 OR lab > 0 OR product_info > 0) THEN 'other_medical' ELSE 'unknown' END AS kind FROM scored))"""


def reasons(source: str = "lines") -> str:
    cjk, letters = f"length(line) - length({gone('line', P.CJK)})", rf"length({gone('line', '[^' + chr(92) + 'p{L}]')})"
    return f"""reasons AS (SELECT *, CASE WHEN length(key) >= {quality.KEY_CHARS} AND times >= {quality.REPEATS} AND nth > 1 THEN 'repeated line'
  WHEN coalesce(share, 0) < 0.3 AND {cjk} > 0 THEN 'foreign script' WHEN {has('line', P.COMMENTARY)} THEN 'commentary' END AS reason FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS times, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS nth,
  sum({cjk}) OVER (PARTITION BY doc_id) / nullif(sum({letters}) OVER (PARTITION BY doc_id), 0) AS share FROM (SELECT *, {SQUEEZED('line')} AS key FROM {source})))"""


def date_reasons(date: str, today: str) -> str:
    """An array of reasons against a date as printed, over columns that this defines beside it."""
    return f"""list_filter([CASE WHEN m['s'] = '|' AND m['s'] = m['t'] THEN 'unusual separator' END, CASE WHEN m['s'] = m['t'] AND length(m['y']) = 2 THEN 'two-digit year' END, CASE WHEN m['y'] <> '' AND m['s'] = m['t'] AND day IS NULL THEN 'no calendar date' END,
  CASE WHEN m['s'] = m['t'] AND day > {today} + 31 THEN 'in the future' END, CASE WHEN m['s'] = m['t'] AND day <= {today} + 31 AND year(day) < 1950 THEN 'implausibly old' END], lambda x: x IS NOT NULL)"""


DATE_PARTS = lambda date: (
    f"regexp_extract({date}, '^([0-9]{{1,2}})([/.|-])([0-9]{{1,2}})([/.|-])([0-9]{{2,4}})$', ['a', 's', 'b', 't', 'y']) AS m, CASE WHEN length(m['y']) = 2 THEN '20' ELSE '' END || m['y'] AS yyyy, "
    "coalesce(try_strptime(m['a'] || '/' || m['b'] || '/' || yyyy, '%d/%m/%Y'), try_strptime(m['b'] || '/' || m['a'] || '/' || yyyy, '%d/%m/%Y'))::date AS day"
)

# ---- headers

TRIMMED = lambda c: gone(gone(c, P.PATIENT_TAIL), "[.]+$")
BLOCK = "array_to_string(ls[greatest(i - 2, 1) : i + 2], chr(10))"
_OFFSET = lambda no: f"coalesce(list_sum(list_transform(ls[1:{no} - 1], lambda x: length(x) + 1)), 0)::int"


def headers(source: str = "classified") -> str:
    """CTE `headed(doc_id, doctor, doctor_at, patient, patient_at, why, date, date_at)`."""
    doc = P.DOCTOR.parts
    line = "ls[i]"
    bare = f"list_filter(range(1, len(ls) + 1), lambda i: {has(line, P.BARE_NAME)} AND {has(BLOCK, P.DEMOGRAPHICS)} AND NOT {has(BLOCK, P.PAYEE)} AND {TRIMMED(f"regexp_extract({line}, '{P.BARE_NAME}', 2)")} <> '')"
    return f"""headed AS (SELECT doc_id, about_a_patient, string_split(raw_text, chr(10)) AS ls, regexp_extract(raw_text, '{doc}', 2) AS dr, {gone(f"coalesce({group('dr', P.DOCTOR_TAIL, 1)}, dr)", '[,. ]+$')} AS doctor, {size('raw_text', doc, 1)} AS doctor_at,
  list_filter(regexp_extract_all(raw_text, '({P.PATIENT})', 1), lambda x: {TRIMMED(f"regexp_extract(x, '{P.PATIENT}', 1)")} <> '')[1] AS a, regexp_extract(a, '{P.PATIENT}', 1) AS a_name,
  CASE WHEN about_a_patient THEN {bare}[1] END AS b, CASE WHEN about_a_patient THEN list_filter(range(1, len(ls) + 1), lambda i: {has(line, P.UNSEPARATED_NAME)})[1] END AS c,
  CASE WHEN a IS NOT NULL THEN {TRIMMED('a_name')} WHEN b IS NOT NULL THEN {TRIMMED(f"regexp_extract(ls[b], '{P.BARE_NAME}', 2)")} WHEN c IS NOT NULL THEN {TRIMMED(f"regexp_extract(ls[c], '{P.UNSEPARATED_NAME}', 2)")} END AS patient,
  CASE WHEN a IS NOT NULL THEN instr(raw_text, a) - 1 + length(a) - length(a_name) WHEN b IS NOT NULL THEN {_OFFSET('b')} + {size('ls[b]', P.BARE_NAME, 1)} WHEN c IS NOT NULL THEN {_OFFSET('c')} + {size('ls[c]', P.UNSEPARATED_NAME, 1)} END AS patient_at,
  CASE WHEN a IS NOT NULL THEN NULL WHEN b IS NOT NULL THEN '{extract.BARE_LABEL}' WHEN c IS NOT NULL THEN '{extract.NO_SEPARATOR}' END AS why,
  list_filter(range(1, len(ls) + 1), lambda i: {has(line, P.DATE)}) AS dated, coalesce(list_filter(dated, lambda i: {has(line, P.DATE_WORDS)})[1], dated[1]) AS d, ls[d] AS dl,
  {group('dl', P.NUMERIC_DATE.parts, 2)} AS num, {group('dl', P.WRITTEN_DATE.parts, 2)} AS wri, num IS NOT NULL AND (wri IS NULL OR {size('dl', P.NUMERIC_DATE.parts, 1)} <= {size('dl', P.WRITTEN_DATE.parts, 1)}) AS first_,
  CASE WHEN first_ THEN num ELSE wri END AS date, CASE WHEN first_ THEN {size('dl', P.NUMERIC_DATE.parts, 1)} ELSE {size('dl', P.WRITTEN_DATE.parts, 1)} END + {_OFFSET('d')} AS date_at FROM {source})"""


# ---- every value

#: The readings of names that may be others, for joins.
SWAPS = ", ".join(f"('{a}', '{b}')" for a, b in checks.misreadings())
MISREAD_WORDS = f"""swaps AS (SELECT * FROM (VALUES {SWAPS}) AS t(seen, meant)),
misread AS (SELECT name, arg_min(meant, (wi, ci)) AS meant FROM (SELECT name, wi, ci, substring(w, 1, ci - 1) || s.meant || substring(w, ci + 1) AS meant FROM (
  SELECT name, wi, ws[wi] AS w, ci FROM (SELECT DISTINCT name, regexp_extract_all(name, '[A-Za-z0-9|]+(?:-[A-Za-z0-9]+)?') AS ws FROM names), unnest(range(1, len(ws) + 1)) AS a(wi), unnest(range(1, length(ws[wi]) + 1)) AS b(ci)) q
  JOIN swaps s ON s.seen = lower(substring(w, 1, ci - 1)) || substring(w, ci, 1) || lower(substring(w, ci + 1)) WHERE {has('w', '[A-Za-z]')} AND lower(w) NOT IN {any_in(P.LAB_LEXICON)}) GROUP BY name)"""


def _cut(text: str, pattern: str) -> str:
    """A text in pieces: every second one is what group 1 of the pattern takes."""
    return f"string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\1' || chr(1), 'g'), chr(1))"


_AT = "coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0)::int"
_LAB_PARTS = ("lead_", "name", "gap1", "value", "gap2", "unit", "gap3", "reference_range")


def entities(source: str, today: str | None = None) -> str:
    """CTEs up to `entities(doc_id, field, item_no, sub, text, start, end, reasons)` over source(doc_id, raw_text), without recognisers."""
    why = lambda *xs: "list_filter([" + ", ".join(xs) + "], lambda r: r IS NOT NULL)"
    n = "CAST(NULL AS VARCHAR)"
    section = " ".join(f"WHEN '{r}' THEN {size('line', f'(?s)^(.*?{p})', 1)}" for r, p in (("allergy", P.ALLERGY), ("diagnosis", P.DIAGNOSIS), ("complaint", P.COMPLAINT)))
    stop = rf"(?s)^(.*?){P.SECTION_END}"
    lab_at = lambda k: "start + " + " + ".join(f"length({p})" for p in _LAB_PARTS[:k]) if k else "start"
    slip = f"""CASE WHEN reference_range <> '' AND (CASE WHEN {has('reference_range', P.RANGE)} THEN (hi > 0 AND x > 10 * hi) OR (lo > 0 AND x < lo / 10) ELSE lim > 0 AND x > 10 * lim END) THEN 'more than ten times outside the range' END"""
    dose, code = group("after_", P.DOSE_WITH_LETTERS.parts, 2), group("after_", P.CODE_WITH_LETTERS.parts, 2)
    meds = f"""SELECT *, substring(line, name_at + 1) AS after_, CASE WHEN {dose} IS NOT NULL THEN 'letters in a dose' END AS r1, CASE WHEN {code} IS NOT NULL THEN 'letters in a dosing code' END AS r2,
  CASE WHEN dosage IS NOT NULL AND {has('substring(line, dosage_at + length(dosage) + 1, 3)', P.STRAY_CAPITAL)} THEN 'stray capital after a dose' END AS r3, CASE WHEN mention THEN 'medication_mentions' ELSE 'medications' END AS field FROM medicines"""
    rows = [
        f"SELECT doc_id, 'doctor_name' AS field, doctor_at AS begin_, 'text' AS sub, doctor AS text, doctor_at AS start, {why(n)} AS reasons FROM headed",
        f"SELECT doc_id, 'patient_name', patient_at, 'text', patient, patient_at, {why('why')} FROM headed",
        (f"SELECT doc_id, 'date', date_at, 'text', date, date_at, {date_reasons('date', today)} FROM (SELECT *, {DATE_PARTS('date')} FROM headed WHERE date IS NOT NULL)" if today else f"SELECT doc_id, 'date', date_at, 'text', date, date_at, {why(n)} FROM headed"),
        f"SELECT doc_id, field, start + name_at, 'name', name, start + name_at, {why(f'CASE WHEN mention THEN {chr(39)}{extract.MENTIONED}{chr(39)} END', repr(extract.BY_PATTERN), 'r1', 'r2', 'r3')} FROM meds",
        f"SELECT doc_id, field, start + name_at, 'dosage', dosage, start + dosage_at, {why('r1', 'r3')} FROM meds", f"SELECT doc_id, field, start + name_at, 'frequency', frequency, start + frequency_at, {why('r2')} FROM meds",
        f"SELECT doc_id, field, start + name_at, 'duration', duration, start + duration_at, {why(n)} FROM meds",
        f"SELECT doc_id, 'panels', start + {LEAD('line')}, 'text', {TIDY('line')}, start + {LEAD('line')}, {why(n)} FROM routed WHERE route = 'panel'",
        f"SELECT doc_id, 'vitals', at_, 'name', name, at_, {why(n)} FROM vital", f"SELECT doc_id, 'vitals', at_, 'value', value, at_ + length(name) + length(gap), {why(n)} FROM vital",
        f"SELECT doc_id, 'vitals', at_, 'unit', unit, at_ + length(m) - length(unit), {why(n)} FROM vital",
        f"SELECT doc_id, 'test_results', {lab_at(1)}, 'name', l.name, {lab_at(1).replace('name', 'l.name')}, {why(repr(extract.UNKNOWN_TEST), f'CASE WHEN m.meant IS NOT NULL THEN {extract.CONFUSABLE!r} END')} FROM lab l LEFT JOIN misread m ON m.name = l.name",
        f"SELECT doc_id, 'test_results', {lab_at(1)}, 'value', value, {lab_at(3)}, {why(slip)} FROM lab",
        f"SELECT doc_id, 'test_results', {lab_at(1)}, 'unit', unit, {lab_at(5)}, {why(n)} FROM lab", f"SELECT doc_id, 'test_results', {lab_at(1)}, 'reference_range', reference_range, {lab_at(7)}, {why(n)} FROM lab",
        f"SELECT doc_id, field, at_, 'text', item, at_, {why(repr(extract.BY_PATTERN))} FROM sections",
    ]
    range_ = f"TRY_CAST(value AS DOUBLE) AS x, TRY_CAST(regexp_extract(reference_range, '{P.RANGE}', 1) AS DOUBLE) AS lo, TRY_CAST(regexp_extract(reference_range, '{P.RANGE}', 2) AS DOUBLE) AS hi, TRY_CAST(regexp_extract(reference_range, '{P.LIMIT}', 1) AS DOUBLE) AS lim"
    key = f"CASE WHEN field = 'medication_mentions' THEN {MENTION_KEY('text')} WHEN field IN {any_in(extract.LISTS)} THEN lower(text) ELSE CAST(begin_ AS VARCHAR) END"
    return f"""filled AS (SELECT * FROM {source} WHERE trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) <> ''), {classified('filled')}, {headers()}, {lines('filled')},
routed AS (SELECT l.*, about_a_patient, {ROUTE} AS route FROM lines l JOIN classified USING (doc_id)), rx AS (SELECT * FROM routed WHERE route = 'medicine'),
{medicines('rx', f"(NOT about_a_patient OR {has('line', P.INVOICE_ROW)} OR {has('line', P.STRENGTHS)})")}, meds AS ({meds}),
vital AS (SELECT doc_id, start + {_AT} AS at_, ps[i] AS m, regexp_extract(m, '{P.VITAL_MEASURE}', 1) AS name, regexp_extract(m, '{P.VITAL_MEASURE}', 2) AS gap, regexp_extract(m, '{P.VITAL_MEASURE}', 3) AS value, regexp_extract(m, '{P.VITAL_MEASURE}', 4) AS unit
  FROM (SELECT *, {_cut('line', f'({P.VITAL_MEASURE})')} AS ps FROM routed WHERE route = 'vitals'), unnest(range(2, len(ps) + 1, 2)) AS r(i)),
lab AS (SELECT doc_id, start, {', '.join(f"regexp_extract(line, '{P.LAB_ROW}', {k + 1}) AS {p}" for k, p in enumerate(_LAB_PARTS))}, {range_} FROM routed WHERE route = 'lab' AND about_a_patient), names AS (SELECT DISTINCT name FROM lab), {MISREAD_WORDS},
bodies AS (SELECT *, CASE route {section} END AS at0, substring(line, at0 + 1) AS whole, CASE WHEN {has('whole', stop)} THEN regexp_extract(whole, '{stop}', 1) ELSE whole END AS body, {_cut('body', P.ITEM_BREAK)} AS ps FROM routed
  WHERE route IN ('allergy', 'diagnosis', 'complaint') AND about_a_patient AND NOT (route = 'allergy' AND ({has('line', P.NO_ALLERGY)} OR {has('whole', P.ABSENT)}))),
sections AS (SELECT *, CASE route WHEN 'allergy' THEN 'allergies' WHEN 'diagnosis' THEN 'diagnoses' ELSE 'symptoms' END AS field FROM (SELECT doc_id, line_no, route, i, {TIDY('ps[i]')} AS item, start + at0 + {_AT} + {LEAD('ps[i]')} AS at_ FROM bodies, unnest(range(1, len(ps) + 1, 2)) AS r(i))
  WHERE length(item) >= 2 AND {has('item', '[A-Za-z]')} AND NOT {has('item', P.ABSENT)}),
found AS (SELECT *, min(key) FILTER (sub IN ('name', 'text')) OVER (PARTITION BY doc_id, field, begin_) AS k FROM (SELECT *, CASE WHEN sub IN ('name', 'text') THEN {key} END AS key FROM ({' UNION ALL '.join(rows)}) WHERE text IS NOT NULL AND text <> '')),
kept AS (SELECT * FROM found QUALIFY begin_ = min(begin_) OVER (PARTITION BY doc_id, field, k)),
entities AS (SELECT doc_id, field, (dense_rank() OVER (PARTITION BY doc_id, field ORDER BY begin_) - 1)::int AS item_no, sub, text, start::int AS start, (start + length(text))::int AS end_, reasons FROM kept)"""


def MENTION_KEY(name: str) -> str:  # noqa: N802
    words = f"trim({gone(f'lower({name})', '[' + chr(92) + 's.]+', repr(' '))})"
    return gone(words, rf"(?: \(?(?:{'|'.join(P.SALTS)})\)?)+$")


# ---- whole tokens


def token_places(text: str) -> str:
    out = f"lower({text})"
    for p, by in score.TOKEN_MARKS:
        out = f"regexp_replace({out}, '{p}', '{by}', 'g')"
    return f"replace(chr(5) || {out} || chr(6), chr(5) || chr(6), chr(6) || chr(5))"


def token_pattern(token: str) -> str:
    marks = score
    one = f"""CASE WHEN c = '.' THEN '[.{marks._POINT}{marks._POINT_BEFORE}{marks._POINT_AFTER}]' WHEN regexp_matches(c, '^[!-/:-@\\[-`{{-~]$') THEN '\\' || c ELSE c END"""
    return f"""(chr(5) || array_to_string(list_transform(string_split(regexp_replace(lower({token}), '\\s+', '', 'g'), ''), lambda c: {one}), '[' || chr(1) || chr(5) || chr(6) || ']*') || chr(6))"""
