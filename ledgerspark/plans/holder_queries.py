"""Queries over statement texts derived from documents: banks, accounts, holders, addresses and amounts, with SQL from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import holders as H
from ..operators import statements as S
from ..sources import bridge as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
q = B.sql_text


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {B.STATEMENTS_SQL}{sql}"
        return f

    return add


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def bank_sql() -> str:
    """Tables that end in banks: doc_id, bank."""
    heads = ", ".join(f"({i}, {q(b)}, {q(p)})" for i, (b, ps) in enumerate(L.LETTERHEADS) for p in ps)

    def part(p: str) -> str:
        what = p[2:]
        return {"h": f"contains(h, {q(what)})", "t": f"contains(t, {q(what)})", "f": f"contains(f, {q(what)})", "w": has("f", rf"\b{what}\b")}[p[0]]

    rules = " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(map(part, y.split(' + '))) + ')' for y in ways)} THEN {q(b)}" for b, ways in L.BANK_RULES)
    return f""", ends AS (SELECT doc_id, greatest(coalesce(min(line_no - 1) FILTER (line_no <= 30 AND {has('line', L.TABLE_START)}), 30), 6) AS e FROM lines GROUP BY 1),
places AS (SELECT doc_id, coalesce(lower(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no <= 120)), '') AS h, coalesce(lower(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no <= e)), '') AS head
 FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN ends USING (doc_id) GROUP BY 1),
seen AS (SELECT doc_id, instr(head, p) AS pos, no, b FROM places, (VALUES {heads}) v(no, b, p) WHERE instr(head, p) > 0
 UNION ALL SELECT doc_id, greatest(instr(head, 'nano'), instr(head, 'ban')), 999, 'Nano Banc' FROM places WHERE contains(head, 'nano') AND contains(head, 'ban')),
firsts AS (SELECT doc_id, arg_min(b, {{'pos': pos, 'no': no}}) AS b FROM seen GROUP BY 1),
banks AS (SELECT doc_id, coalesce(b, CASE {rules} END) AS bank FROM (SELECT doc_id, h, lower(raw_text) AS t, lower(filename) AS f FROM docs JOIN places USING (doc_id)) LEFT JOIN firsts USING (doc_id))"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.statement_texts(spark, sf_dir)


def with_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).withColumn("bank", T.bank(F.col("raw_text"), F.col("filename")))


@query(f"{bank_sql()} SELECT doc_id, bank FROM banks")
def recognise_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bank(spark, sf_dir).select("doc_id", "bank")


def token(x: str) -> str:
    return f"translate(regexp_replace({x}, '[^0-9Xx*]', '', 'g'), 'x*', 'XX')"


def below(rule: int, head: str, most: str, count: int) -> str:
    """Rows under heading lines, in order."""
    return f"SELECT b.doc_id, {rule} AS rule, a.line_no * 1000 + b.line_no - a.line_no AS place, b.line FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no + 1 AND a.line_no + {count} WHERE {head} AND a.line_no <= {most}"


ACCOUNTS = f""", marks AS (SELECT doc_id, bool_or(contains(upper(line), 'MICRO BUSINESS DRAFT')) AS draft, bool_or(line_no <= 60 AND upper(line) = 'ACCOUNTS SUMMARY') AND bool_or(line_no <= 70 AND contains(upper(line), 'ACCOUNT NUMBER')) AS listing FROM lines GROUP BY 1),
found AS (
 SELECT doc_id, 1 AS rule, 0 AS place, {token(f"regexp_extract(raw_text, {q(L.ACCOUNT_ENDING)}, 1)")} AS t FROM docs
 UNION ALL SELECT doc_id, 2, 0, regexp_extract(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), {q(L.MEMBER_NUMBER)}, 1) || '050' FROM docs JOIN marks USING (doc_id) WHERE draft AND {has("trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))", L.MEMBER_NUMBER)}
 UNION ALL SELECT doc_id, rule, place, regexp_extract(line, '\\b(\\d{{4,}})\\b', 1) || '050' FROM ({below(3, "lower(a.line) = 'member #:'", '1000000', 3)}) JOIN marks USING (doc_id) WHERE draft AND {has('line', r'\b(\d{4,})\b')}
 UNION ALL SELECT doc_id, 4, line_no, t FROM (SELECT doc_id, line_no, CASE WHEN {has('t', r'^\d{24}$')} THEN left(t, 12) WHEN {has('t', r'^\d{18}$')} AND left(t, 9) = right(t, 9) THEN left(t, 9) ELSE t END AS t
  FROM (SELECT doc_id, line_no, {token(f"regexp_extract(line, {q(L.ACCOUNT_LABEL)}, 1)")} AS t FROM lines WHERE line_no <= 180 AND {has('line', L.ACCOUNT_LABEL)})) WHERE {has('t', r'^X+\d{4,}$')} OR NOT {has('t', L.TOLL_FREE)}
 UNION ALL SELECT doc_id, 5, 0, {token(f"regexp_extract(raw_text, {q(L.ACCOUNT_MASKED)}, 1)")} FROM docs
 UNION ALL SELECT doc_id, rule, place, {token('line')} FROM ({below(6, has('lower(a.line)', L.ACCOUNT_ALONE), '180', 7)}) WHERE NOT {has('line', L.NOT_AN_ACCOUNT)} AND {has(token('line'), r'\d{4,}')} AND {token('line')} <> '0000' AND NOT {has(token('line'), L.TOLL_FREE)}
 UNION ALL SELECT doc_id, rule, place, {token('line')} FROM ({below(7, has('a.line', '(?i)business checking|business draft'), '120', 5)}) JOIN marks USING (doc_id) WHERE listing AND {has(token('line'), r'^\d{5,12}$')} AND NOT {has(token('line'), '^(2026|2025)')}
 UNION ALL SELECT b.doc_id, 8, a.line_no * 1000 + a.line_no - b.line_no, {token('b.line')} FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 9 AND a.line_no - 1 WHERE starts_with(a.line, 'Account Summary Account #') AND a.line_no <= 90 AND {has(token('b.line'), r'^\d{8,12}$')} AND NOT {has(token('b.line'), '^(800|888|877|866|855|844|833)')}
 UNION ALL SELECT doc_id, 9, line_no, {token('line')} FROM lines WHERE line_no <= 35 AND NOT {has('line', L.ACCOUNT_DATED)} AND NOT {has('line', L.ACCOUNT_NARRATIVE)} AND {has(token('line'), r'^\d{10,17}$')} AND NOT {has(token('line'), L.TOLL_FREE)}
 UNION ALL SELECT doc_id, 10, 0, 'XXXX' || regexp_extract(raw_text, '\\*{{2,}}\\s*(\\d{{4}})', 1) FROM docs WHERE {has('raw_text', r'\*{2,}\s*(\d{4})')}),
least_found AS (SELECT doc_id, arg_min(t, {{'r': rule, 'p': place}}) AS account FROM found WHERE t <> '' GROUP BY 1)
SELECT doc_id, account, CASE WHEN contains(account, 'X') THEN account WHEN account IS NOT NULL THEN 'XXXX' || right(account, 4) END AS masked FROM docs LEFT JOIN least_found USING (doc_id)"""


@query(ACCOUNTS)
def extract_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir).select("doc_id", T.account_number(F.col("raw_text")).alias("account"))
    return d.withColumn("masked", T.mask_account(F.col("account")))


def cleaned(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(replace({x}, chr(160), ' '), '\\s+', ' ', 'g')), '[,;]+$', ''))"


def plausible_sql(x: str) -> str:
    suffix = has(x, L.ENTITY_SUFFIX)
    address = f"({has(x, L.ADDRESS_START)} OR (NOT {suffix} AND (({has(x, r'^\s*\d')} AND {has(x, L.STREET_TYPE)}) OR {has(x, L.TOWN_END)} OR {has(x, r'^\s*\d+\s+\w+')})))"
    return f"(length({x}) BETWEEN 3 AND 80 AND {has(x, '[A-Za-z]{2}')} AND NOT {has(x, L.POSTING_DATE)} AND NOT {has(x, L.STATEMENT_FURNITURE)} AND NOT {address})"


def own_sql(x: str) -> str:
    a, b = (f"regexp_replace(lower(coalesce({y}, '')), '[^a-z0-9]', '', 'g')" for y in (x, "bank"))
    return f"({plausible_sql(x)} AND NOT ({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a}))))"


def stripped_sql(x: str) -> str:
    def without(p: str) -> str:
        return f"trim(substr({x}, length(regexp_extract({x}, {q(p)}, 1)) + 1))"

    def named(p: str) -> str:
        return f"{has(without(p), L.ENTITY_SUFFIX)} AND contains({without(p)}, ' ')"

    code = f"regexp_extract({x}, {q(L.SORT_CODE)}, 1)"
    begins = f"starts_with(lower(regexp_extract({x}, {q(L.FUSED_CODE)}, 1)), lower(split_part({without(L.FUSED_CODE)}, ' ', 1)))"
    return f"CASE WHEN {has(x, L.SORT_CODE)} AND {has(code, L.CONSONANTS)} AND {named(L.SORT_CODE)} THEN {without(L.SORT_CODE)} WHEN {has(x, L.FUSED_CODE)} AND {begins} AND {named(L.FUSED_CODE)} THEN {without(L.FUSED_CODE)} ELSE {x} END"


BEFORE = f"trim(regexp_extract(line, {q(rf'(?i)^(.*?\b(?:{L.ENTITY_WORDS})\b\.?)')}, 1))"
TRADE = cleaned(f"regexp_extract(line, {q(L.TRADE_NAME)}, 1)")
NAMES = f"""{bank_sql()},
name_rows AS (SELECT doc_id, i, {cleaned('x')} AS line FROM (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM docs)),
name_lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no FROM name_rows WHERE line <> ''),
tried AS (SELECT doc_id, no, line, bank, [{', '.join(cleaned(f"regexp_extract(line, {q(p + '(.+)')}, 1)") for p in L.HOLDER_LABELS)}] AS labels, {BEFORE} AS short, {TRADE} AS trade FROM name_lines JOIN banks USING (doc_id)
 WHERE no <= {L.HOLDER_LINES} OR {has('line', '|'.join(f'(?:{p})' for p in L.HOLDER_LABELS))}),
told AS (SELECT doc_id, no, list_filter(labels, lambda n: {own_sql('n')})[1] AS labelled, CASE WHEN no <= {L.HOLDER_LINES} AND {has('line', L.ENTITY_SUFFIX)} AND {own_sql('line')} THEN line END AS suffix,
 CASE WHEN no <= {L.HOLDER_LINES} AND short <> line AND len(string_split(short, ' ')) BETWEEN 2 AND 6 AND len(list_filter(string_split(short, ' ')[:-2], lambda w: NOT {has('w', '^[A-Z0-9]')})) = 0 AND {own_sql('short')} THEN short END AS short,
 CASE WHEN no <= {L.HOLDER_LINES} AND {has('line', L.TRADE_NAME)} AND {plausible_sql('trade')} THEN trade END AS dba FROM tried),
one AS (SELECT doc_id, arg_min(labelled, no) FILTER (labelled IS NOT NULL) AS labelled, arg_min(suffix, no) FILTER (suffix IS NOT NULL) AS suffix, arg_min(short, no) FILTER (short IS NOT NULL) AS short, arg_min(dba, no) FILTER (dba IS NOT NULL) AS dba FROM told GROUP BY 1),
named AS (SELECT doc_id, coalesce(labelled, suffix, short) AS n, dba, CASE WHEN labelled IS NOT NULL THEN 'labelled' WHEN suffix IS NOT NULL THEN 'entity_suffix' WHEN short IS NOT NULL THEN 'entity_suffix_split_row' WHEN dba IS NOT NULL THEN 'dba_only' ELSE 'none' END AS evidence FROM docs LEFT JOIN one USING (doc_id)),
companies AS (SELECT doc_id, {stripped_sql('n')} AS legal_name, dba, evidence FROM named)"""


@query(f"{NAMES} SELECT doc_id, legal_name, dba, evidence FROM companies")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.company_names(with_bank(spark, sf_dir))


STREET_SQL = f"regexp_extract(regexp_replace(line, '^\\d{{5,}}\\s+(\\d+\\s+\\D)', '\\1'), {q(L.STREET)}, 1)"


@query(f"""{NAMES},
begun AS (SELECT doc_id, min(line_no) AS start FROM lines JOIN companies USING (doc_id) WHERE legal_name <> '' AND contains(lower(line), lower(legal_name)) GROUP BY 1),
near AS (SELECT doc_id, line_no AS no, line, nullif(trim(regexp_replace({STREET_SQL}, '\\s+', ' ', 'g')), '') AS street, {has('line', L.POST_BOX)} AS box, {has('line', L.TOWN_LINE)} AS is_town,
 regexp_extract(line, {q(L.TOWN_LINE)}, 1) AS town, upper(regexp_extract(line, {q(L.TOWN_LINE)}, 2)) AS state, regexp_extract(line, {q(L.TOWN_LINE)}, 3) AS postcode FROM lines JOIN begun USING (doc_id) WHERE line_no > start AND line_no <= start + {L.ADDRESS_REACH} AND NOT {has('line', L.NO_ADDRESS)}),
streets AS (SELECT doc_id, min(no) AS s, arg_min(street, no) AS first_street FROM near WHERE street IS NOT NULL GROUP BY 1),
boxes AS (SELECT doc_id, min(no) AS b, arg_min(line, no) AS first_box FROM near LEFT JOIN streets USING (doc_id) WHERE box AND (s IS NULL OR no < s) GROUP BY 1),
ends AS (SELECT doc_id, no, CASE WHEN no > s THEN first_street WHEN (s IS NULL OR no < s) AND b <= no THEN first_box END AS street, trim(regexp_replace(town, '\\s+', ' ', 'g')) AS town, state, postcode FROM near LEFT JOIN streets USING (doc_id) LEFT JOIN boxes USING (doc_id) WHERE is_town),
best AS (SELECT doc_id, arg_min({{'street': street, 'town': town, 'state': state, 'postcode': postcode}}, no) AS x FROM ends WHERE street IS NOT NULL GROUP BY 1)
SELECT doc_id, x.street AS street, x.town AS town, x.state AS state, x.postcode AS postcode, x.street || ', ' || x.town || ', ' || x.state || ' ' || x.postcode AS "full" FROM docs LEFT JOIN best USING (doc_id)""".replace("ends AS (SELECT doc_id, no, CASE", "towns AS (SELECT doc_id, no, CASE").replace("FROM ends WHERE street", "FROM towns WHERE street"))
def holder_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_bank(spark, sf_dir)
    names = H.company_names(d).select("doc_id", F.col("legal_name").alias("name"))
    return H.holder_addresses(d.join(names, "doc_id"))


@query(f""", cut AS (SELECT doc_id, line_no, line, regexp_extract_all(line, {q(L.FIGURE)}) AS v, string_split_regex(line, {q(L.FIGURE)}) AS g FROM lines),
parts AS (SELECT doc_id, line_no, list_transform(range(1, len(v) + 1), lambda i: {{'t': v[i], 'c': right(coalesce(v[i - 1], '') || g[i], 3) || v[i] || left(g[i + 1] || coalesce(v[i + 1], ''), 3), 'n': CAST(regexp_replace(v[i], '[^0-9.]', '', 'g') AS DECIMAL(18,2))}}) AS p FROM (SELECT *, CASE WHEN len(v) = 0 THEN [''] ELSE g END AS g0 FROM cut)),
vals AS (SELECT doc_id, line_no, list_transform(list_filter(p, lambda x: NOT (length(regexp_replace(x.t, '\\D', '', 'g')) >= 7 AND NOT regexp_matches(x.t, '[,$.]')) AND x.n <= 50000000), lambda x: CASE WHEN contains(x.c, '-') OR (contains(x.c, '(') AND contains(x.c, ')')) THEN -x.n ELSE x.n END) AS a FROM parts),
firsts AS (SELECT doc_id, line_no, a, CASE WHEN len(list_filter(a, lambda x: NOT abs(x) BETWEEN 2020 AND 2030)) > 0 THEN {{'m': abs(list_filter(a, lambda x: NOT abs(x) BETWEEN 2020 AND 2030)[1]), 'n': line_no}} END AS s FROM vals),
w AS (SELECT doc_id, line_no, a, first_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS nx, last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pv FROM firsts)
SELECT doc_id, line_no, len(a) AS n_amounts, CAST(list_sum(a) AS DOUBLE) AS total, CAST(nx.m AS DOUBLE) AS next_amount, nx.n AS next_line, CAST(pv.m AS DOUBLE) AS previous_amount, pv.n AS previous_line FROM w""")
def amounts_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.explode_lines(texts(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
    total = F.when(F.size("amounts") > 0, F.aggregate("amounts", F.lit(0).cast("decimal(28,2)"), lambda x, y: (x + y).cast("decimal(28,2)"))).cast("double")
    money = {f"{s}_amount": F.col(f"{s}_amount").cast("double") for s in ("next", "previous")}
    return H.amounts_near(lines).select("doc_id", "line_no", F.size("amounts").cast("long").alias("n_amounts"), total.alias("total"), money["next_amount"].alias("next_amount"), "next_line", money["previous_amount"].alias("previous_amount"), "previous_line")


KEY_NAME = "coalesce(legal_name, dba, source || ' Traders, Inc.')"
KEYS = f"""{NAMES}, printed AS (SELECT companies.doc_id, {KEY_NAME} AS name FROM companies JOIN documents ON documents.doc_id = companies.doc_id),
spaced AS (SELECT doc_id, name, trim(regexp_replace(replace(name, chr(160), ' '), '\\s+', ' ', 'g')) AS s FROM printed),
key_words AS (SELECT doc_id, name, list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({stripped_sql('s')}), '[''’]s\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x <> 's'), lambda x: CASE WHEN length(x) >= 4 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END) AS words FROM spaced),
key_joined AS (SELECT doc_id, name, array_to_string(words, ' ') AS j, trim(regexp_replace(array_to_string(words, ' '), {q(L.NAME_SUFFIX)}, '')) AS short FROM key_words)"""


@query(f"{KEYS} SELECT doc_id, name, CASE WHEN coalesce(j, '') = '' THEN 'unassociated' WHEN short = '' THEN j ELSE short END AS company_key FROM key_joined")
def company_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of the name that each statement prints, else of its source as a company's."""
    d = with_bank(spark, sf_dir)
    source = B.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" Traders, Inc.")).alias("other"))
    named = H.company_names(d).join(source, "doc_id").select("doc_id", F.coalesce("legal_name", "dba", "other").alias("name"))
    return named.withColumn("company_key", T.company_key(F.col("name")))


@query(f"""SELECT doc_id, line_no, line, nullif(lower(regexp_extract(line, '\\b(\\d+[A-Za-z]?)\\b', 1)), '') AS house, list_last(regexp_extract_all(line, '\\b(\\d{{5}})(?:-\\d{{4}})?\\b', 1)) AS postcode,
 CASE WHEN {has('line', L.TOWN)} THEN trim(lower(regexp_extract(line, {q(L.TOWN)}, 1))) || ' ' || lower(regexp_extract(line, {q(L.TOWN)}, 2)) END AS town FROM (SELECT doc_id, line_no, line FROM lines WHERE {has('line', L.STREET)} OR {has('line', L.TOWN)} OR {has('line', L.POST_BOX)})""")
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells a place on every line that has a street, a town or a post box."""
    line = F.col("line")
    d = S.explode_lines(texts(spark, sf_dir)).where(line.rlike(T.ascii_edges(L.STREET)) | line.rlike(r"[A-Za-z]\s+\d{5}") & line.rlike(T.ascii_edges(L.TOWN)) | line.rlike(L.POST_BOX))
    return d.select("doc_id", "line_no", "line", T.address_parts(line).alias("p")).select("doc_id", "line_no", "line", "p.house", "p.postcode", "p.town")
