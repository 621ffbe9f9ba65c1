"""Queries over application forms, each with the whole text of a document below, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import applications
from ..sources import bridge as B
from .text_queries import FIELDS_SQL, date_sql, has, part_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
q = B.sql_text

# Forms; names in braces are words and numbers by a document's number (WORDS), so that answers differ.
FORMS = [
    "Legal Business Name: {w} Foods Inc\nBusiness Owner Information\nOwner Name: Ann B. {n}\nDate of Birth: 02/{d}/1975\nFederal Tax ID: 12-34567{d}\nSSN: 123-45-67{d}\nAverage Monthly Revenue: $125,0{d}\nCell (212) 555-01{d} ann@{w}.com",
    "Owner Name: Credit Score\nCompany Name: DBA:\n{w} Holdings LLC\nBusiness Start Date: 2011-01-{d}\nAnnual revenue 1,2{d},000",
    "Owner Name: Date of Birth:\nAnn {n}\nBusiness Name: Blue {w} Doing Business As {w} Cafe\nBusiness start date under\ncurrent ownership\nFeb {d}, 2022",
    "Owner Name: Ann {n} 123\nOwner Information\nName: Ann B. {n}\nBusiness Address: {d} Main St City: Austin State: TX Zip Code: 787{d}\nDOB: March 3, {d}",
    "First Name: Joe\nLast Name: van {n}   Date of Birth: 1980-03-{d}\nBusiness Address\n{d} Side Rd\nCity: Reno   State: NV   Zip: 895{d}\nDate Established: March {d}\nsince about\n2015",
    "DBA Business Name: wrong\nCorporate Name | {w} & Sons, Corp.\nGuarantor Name: owner #1: Max {n}  Title: CEO\nDate of Birth: Wednesday, {d}/{d}/62 0:00:00\nAuthorizations\nI agree. Date of birth above\nSignature Date:\nTuesday, May {d}, 2024",
    "Full Name: Title: City:\nname joe {n}\nApplicant details\nname\njoe {n}\nStart Date: SSN:\nPhone\nJune 4, 2001\nsigned on 3/{d}/24",
    "Name of bank: First {w}\nName: Kim {n}\nBusiness Address: Suite {d}, {d} Oak Ave, Dallas, TX\nCity of Dallas\nState: Texas\nZip 75201-00{d}\nDate signed 2024-2-{d}",
    "",
]
WORDS = {"w": ["River", "Harbor", "Summit", "Cedar", "Zenith"], "n": ["Lee", "Ortiz", "O'Neil", "Smith-Jones"], "d": [str(x) for x in range(10, 29)]}


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, head = F.col("doc_id"), B.pick(FORMS, F.col("doc_id"))
    for name, some in WORDS.items():
        head = F.replace(head, F.lit("{" + name + "}"), B.pick(some, F.floor(n / len(FORMS))))
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", B.pick(B.FILENAMES, n).alias("filename"), F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("raw_text"))


def _head_sql() -> str:
    head = B.sql_pick(FORMS, "doc_id").replace("\n", "' || chr(10) || '")
    for name, some in WORDS.items():
        head = f"replace({head}, '{{{name}}}', {B.sql_pick(some, f'doc_id // {len(FORMS)}')})"
    return head


def _cs(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(160), ' '), '\\s+', ' ', 'g'))"


def _bounded(x: str) -> str:
    return f"trim(regexp_replace({_cs(f'regexp_extract(coalesce({x}, {q(chr(0)[:0])}), {q(L.BOUNDED)}, 1)')}, '\\s*:\\s*$', ''))"


def _is_label(v: str) -> str:
    words = f"list_filter(string_split_regex(regexp_replace(lower({v}), '[():,]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"({v} = '' OR {has(v, r':\s*$')} OR {has(v, ':.*:')} OR (len({words}) > 0 AND len(list_filter({words}, lambda w: w NOT IN ({', '.join(map(q, L.LABEL_WORDS))}))) = 0))"


def _person(v: str) -> str:
    return f"CASE WHEN {has(v, L.PERSON)} AND NOT {has(v, L.NOT_A_PERSON)} AND NOT {_is_label(v)} THEN {v} END"


def _person_text(x: str) -> str:
    return f"trim(regexp_replace({_cs(f'regexp_replace(coalesce({x}, {q(chr(0)[:0])}), {q(L.OWNER_PREFIX)}, {q(chr(0)[:0])})')}, '\\s*:\\s*$', ''))"


def _company_text(x: str) -> str:
    return f"substr(trim(regexp_replace(regexp_replace({_cs(f'regexp_extract({x}, {q(L.COMPANY_BOUNDED)}, 1)')}, {q(L.COMPANY_PREFIX)}, ''), {q(r'''[^A-Za-z0-9&.,'\- /]''')}, '', 'g')), 1, 90)"


def _address_part(x: str) -> str:
    v = f"regexp_replace(regexp_replace({_cs(x)}, {q(L.ADDRESS_LABEL)}, ' ', 'g'), '\\s*,\\s*', ', ', 'g')"
    return f"trim(regexp_replace(regexp_replace({v}, '(?:,\\s*){{2,}}', ', ', 'g'), '^,|,$', '', 'g'))"


LABELS = ", ".join(f"({q(f)}, {i}, {q(x.lower())})" for f, some in L.FORM_LABELS.items() for i, x in enumerate(some))
_part = [part_sql("v", L.YEAR_DATE, i) for i in (1, 2, 3)]
_num = [part_sql("v", L.NUMBER_DATE, i) for i in (1, 2, 3)]
LONG = f"CASE WHEN {has('v', L.YEAR_DATE)} THEN lpad({_part[1]}, 2, '0') || '/' || lpad({_part[2]}, 2, '0') || '/' || {_part[0]} ELSE strftime({date_sql(f'regexp_replace(v, {q(L.DAY_NAME)}, {q(chr(0)[:0])})')}, '%m/%d/%Y') END"
SHORT = f"""CASE WHEN v = '' OR ({has('v', r'\b[A-Za-z]{3,9},?\s+\d{1,2},?\s+\d{2}\b')} AND NOT {has('v', r'\b(?:19|20)\d{2}\b')}) THEN NULL WHEN {has('v', L.YEAR_DATE)} THEN lpad({_part[1]}, 2, '0') || '/' || lpad({_part[2]}, 2, '0') || '/' || right({_part[0]}, 2)
 WHEN {has('v', L.NUMBER_DATE)} THEN lpad({_num[0]}, 2, '0') || '/' || lpad({_num[1]}, 2, '0') || '/' || right({_num[2]}, 2) WHEN year({date_sql('v')}) BETWEEN 1900 AND 2026 THEN strftime({date_sql('v')}, '%m/%d/%y') END"""
FORM_SQL = f"""docs AS (SELECT doc_id, {B.sql_pick(B.FILENAMES, 'doc_id')} AS filename, {_head_sql()} || chr(10) || coalesce(text, '') AS raw_text FROM documents),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, line FROM (SELECT doc_id, i, {_cs('x')} AS line FROM (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM docs)) WHERE line <> ''),
trimmed AS (SELECT doc_id, g, regexp_replace(x, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS g FROM docs)),
form AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS i, line, lower(line) AS low FROM trimmed WHERE line <> ''),
spots AS (SELECT doc_id, coalesce(min(i) FILTER (contains(low, 'business address')), 1) AS address_i, coalesce(min(i) FILTER ({has('line', L.AUTHORISATION)}), 1) AS signed_i FROM form GROUP BY 1),
hits AS (SELECT f.doc_id, f.i, f.line, f.low, k.field, k.no, regexp_replace(substr(f.line, position(k.low IN f.low) + length(k.low)), '^[\\s:#\\-|]+', '') AS rest, position(k.low IN f.low) = 1 OR NOT regexp_matches(substr(f.low, position(k.low IN f.low) - 1, 1), '[a-z0-9]') AS begins, {_cs('n.line')} AS under
 FROM form f JOIN (VALUES {LABELS}) k(field, no, low) ON contains(f.low, k.low) LEFT JOIN form n ON n.doc_id = f.doc_id AND n.i = f.i + 1),
beside AS (SELECT *, {_cs(f'regexp_extract(rest, {q(L.BOUNDED)}, 1)')} AS own FROM hits WHERE field IN ('company', 'owner') AND begins),
answers AS (SELECT *, CASE WHEN NOT {_is_label('own')} THEN {_bounded('own')} WHEN NOT contains(under, ':') AND NOT {_is_label('under')} THEN {_bounded('under')} END AS answer FROM beside),
read_names AS (SELECT doc_id, i, field, no, CASE WHEN field = 'company' THEN {_company_text('answer')} ELSE {_person_text('answer')} END AS v FROM answers WHERE answer IS NOT NULL),
good_names AS (SELECT doc_id, i, field, no, v FROM read_names WHERE CASE WHEN field = 'company' THEN regexp_matches(v, '[A-Za-z]{{3}}') AND NOT {_is_label('v')} ELSE ({_person('v')}) IS NOT NULL END),
sections AS (SELECT f.doc_id, f.i, f.line, {_person_text(f"regexp_extract(f.line, '(?i)^name{chr(92)}s*:?{chr(92)}s*(.*)$', 1)")} AS v, regexp_extract(f.line, '(?i)^name\\s*:?\\s*(.*)$', 1) = '' AS bare, {_person_text('n.line')} AS nv, (SELECT max(s.i) FROM form s WHERE s.doc_id = f.doc_id AND s.i <= f.i AND {has('s.line', L.OWNER_SECTION)}) AS heading
 FROM form f LEFT JOIN form n ON n.doc_id = f.doc_id AND n.i = f.i + 1 WHERE regexp_matches(f.low, '^name\\b') AND NOT regexp_matches(f.low, '^name\\s*of')),
section_names AS (SELECT doc_id, i, heading, coalesce({_person('v')}, CASE WHEN bare THEN {_person('nv')} END) AS v FROM sections),
dated AS (SELECT doc_id, i, field, no, {_bounded('rest')} AS own FROM hits WHERE field IN ('dob', 'start_date')),
yeared AS (SELECT d.*, CASE WHEN {has('own', L.MONTH_DAY)} AND NOT regexp_matches(own, '\\b(?:19|20)\\d{{2}}\\b') THEN (SELECT arg_min(regexp_extract(b.line, '\\b((?:19|20)\\d{{2}})\\b', 1), b.i) FROM form b WHERE b.doc_id = d.doc_id AND b.i > d.i AND b.i <= d.i + 5 AND regexp_matches(b.line, '\\b(?:19|20)\\d{{2}}\\b')) END AS y FROM dated d),
cuts AS (SELECT d.*, coalesce((SELECT min(b.i) FROM form b WHERE b.doc_id = d.doc_id AND b.i > d.i AND b.i <= d.i + 3 AND {has(_bounded('b.line'), L.OTHER_FIELD)}), d.i + 4) AS stop FROM dated d),
tried AS (SELECT doc_id, i, field, no, 0 AS step, own || coalesce(' ' || y, '') AS x FROM yeared WHERE own <> '' UNION ALL SELECT c.doc_id, c.i, field, no, b.i - c.i, {_bounded('b.line')} FROM cuts c JOIN form b ON b.doc_id = c.doc_id AND b.i > c.i AND b.i < c.stop),
stripped AS (SELECT *, {_bounded("regexp_replace(x, '\\s+0:00:00\\b', '')")} AS v FROM tried WHERE x <> ''),
dates AS (SELECT doc_id, i, field, no, step, CASE field WHEN 'dob' THEN {SHORT} ELSE {LONG} END AS v FROM stripped),
signing AS (SELECT h.doc_id, h.i, h.no, h.rest, signed_i + {applications.SIGNED_LINES} AS until FROM hits h JOIN spots USING (doc_id) WHERE field = 'app_date' AND h.i >= signed_i AND h.i < signed_i + {applications.SIGNED_LINES} AND NOT {has('h.low', L.OTHER_DATE)}),
signed_stop AS (SELECT s.*, coalesce((SELECT min(b.i) FROM form b WHERE b.doc_id = s.doc_id AND b.i > s.i AND b.i <= s.i + 2 AND {has('b.low', L.OTHER_DATE)}), s.i + 3) AS stop FROM signing s),
signed_tried AS (SELECT doc_id, i, no, 0 AS step, {_bounded('rest')} AS x FROM signing UNION ALL SELECT s.doc_id, s.i, s.no, b.i - s.i, b.line FROM signed_stop s JOIN form b ON b.doc_id = s.doc_id AND b.i > s.i AND b.i < s.stop AND b.i < s.until),
signed_v AS (SELECT *, {_bounded("regexp_replace(x, '\\s+0:00:00\\b', '')")} AS v FROM signed_tried),
signed_dates AS (SELECT doc_id, i, no, step, {LONG} AS v FROM signed_v),
simple AS (SELECT doc_id, arg_min(rest, i) FILTER (field = 'first') AS f, arg_min(rest, i) FILTER (field = 'last') AS l, arg_min(rest, i) FILTER (field = 'address') AS street, arg_min(line, i) FILTER (field = 'address') AS whole,
 {', '.join(f"arg_min(rest, i) FILTER (field = '{x}' AND i >= address_i AND i < address_i + {applications.ADDRESS_LINES}) AS {x}" for x in ('city', 'state', 'zip'))} FROM hits JOIN spots USING (doc_id) GROUP BY 1),
places AS (SELECT doc_id, {', '.join(f"{_address_part(f'CASE WHEN {has("whole", L.WHOLE_ADDRESS)} THEN regexp_extract(whole, {q(L.WHOLE_ADDRESS)}, {i}) ELSE {_bounded(x)} END')} AS {x}" for i, x in enumerate(('street', 'city', 'state', 'zip'), 1))},
 trim(regexp_replace({_bounded('f')}, '[^A-Za-z\\- ]', '', 'g')) || ' ' || trim(regexp_replace({_bounded('l')}, '[^A-Za-z\\- ]', '', 'g')) AS both_names FROM simple),
places2 AS (SELECT doc_id, {_person_text('both_names')} AS both_names, CASE WHEN regexp_matches(street, '\\d') AND NOT {_is_label(_cs('street'))} THEN street END AS street, CASE WHEN NOT {_is_label(_cs('city'))} THEN city END AS city, substr(upper(regexp_replace(state, '[^A-Za-z]', '', 'g')), 1, 2) AS state, regexp_extract(zip, '\\b(\\d{{5}}(?:-\\d{{4}})?)\\b', 1) AS zip FROM places),
places3 AS (SELECT doc_id, both_names, street, concat_ws(', ', city, CASE WHEN state IN ({', '.join(map(q, L.STATES))}) THEN state END) || CASE WHEN zip <> '' THEN ' ' || zip ELSE '' END AS place FROM places2),
fields AS (SELECT d.doc_id, (SELECT arg_min(v, {{'n': no, 'i': i}}) FROM good_names g WHERE g.doc_id = d.doc_id AND field = 'company') AS company,
 coalesce((SELECT arg_min(v, {{'n': no, 'i': i}}) FROM good_names g WHERE g.doc_id = d.doc_id AND field = 'owner'), {_person('both_names')}, (SELECT arg_min(v, i) FROM section_names s WHERE s.doc_id = d.doc_id AND v IS NOT NULL AND (coalesce(i <= heading + {applications.OWNER_REACH}, false) OR len(list_filter(string_split(v, ' '), lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0))) AS owner,
 (SELECT arg_min(v, {{'i': i, 'n': no, 's': step}}) FROM dates x WHERE x.doc_id = d.doc_id AND field = 'dob' AND v IS NOT NULL) AS dob, (SELECT arg_min(v, {{'i': i, 'n': no, 's': step}}) FROM dates x WHERE x.doc_id = d.doc_id AND field = 'start_date' AND v IS NOT NULL) AS start_date,
 (SELECT arg_min(v, {{'i': i, 'n': no, 's': step}}) FROM signed_dates x WHERE x.doc_id = d.doc_id AND v IS NOT NULL) AS app_date,
 nullif(trim(regexp_replace(regexp_replace(concat_ws(', ', street, nullif(place, '')), '\\s+,', ',', 'g'), '(?:,\\s*){{2,}}', ', ', 'g')), '') AS address FROM docs d LEFT JOIN places3 p USING (doc_id)),
{FIELDS_SQL},
application AS (SELECT docs.doc_id, company, owner, address, dob, start_date, app_date,
 coalesce({part_sql('raw_text', L.EIN_NEAR, 1)} || '-' || {part_sql('raw_text', L.EIN_NEAR, 2)}, {part_sql('raw_text', L.EIN_PLAIN, 1)} || '-' || {part_sql('raw_text', L.EIN_PLAIN, 2)}) AS ein, 'XXX-XX-' || {part_sql('raw_text', L.SSN, 3)} AS ssn_mask,
 coalesce(floor(monthly.v + 0.5), floor(annual.v / 12 + 0.5)) AS stated_revenue, {has('raw_text', L.PHONES)} AS phone, {has('raw', L.EMAILS)} OR {has('tight', L.EMAILS)} OR {has('loose', L.EMAILS)} AS email
 FROM docs JOIN flat USING (doc_id) LEFT JOIN fields USING (doc_id) LEFT JOIN monthly USING (doc_id) LEFT JOIN annual USING (doc_id))"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {FORM_SQL} SELECT doc_id, company, owner, dob, start_date, app_date, address, ein, ssn_mask, stated_revenue,
 CAST((company IS NOT NULL)::INT + (owner IS NOT NULL)::INT + phone::INT + email::INT + (address IS NOT NULL)::INT + (start_date IS NOT NULL)::INT + (ein IS NOT NULL)::INT + (dob IS NOT NULL)::INT AS BIGINT) AS fields_found FROM application""")
def extract_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = applications.extract_application(forms(spark, sf_dir))
    return d.select("doc_id", "company", "owner", "dob", "start_date", "app_date", "address", "ein", "ssn_mask", "stated_revenue", F.col("fields_found").cast("long").alias("fields_found"))


def flags(d: DataFrame) -> list[Column]:
    from ..operators.verdicts import FIELDS

    return [F.max(F.when(F.col("field") == x, F.col("found"))).alias(x.lower().replace(" ", "_")) for x in FIELDS]


@query(f"""WITH {FORM_SQL} SELECT doc_id, company IS NOT NULL AS company, owner IS NOT NULL AS owner, phone, email, address IS NOT NULL AS address, start_date IS NOT NULL AS start_date, ein IS NOT NULL AS ein, dob IS NOT NULL AS dob FROM application""")
def application_field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight flags of each form as columns."""
    from ..operators.verdicts import application_field_checks as run

    d = run(applications.extract_application(forms(spark, sf_dir)))
    return d.groupBy("doc_id").agg(*flags(d))
