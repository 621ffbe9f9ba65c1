"""Queries over statements in fourteen layouts, with amounts from each document's row and its own text below, and their SQL.

The SQL walks lines one after another and tries signs part by part, where the library uses windows and sums of choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import balances
from ..operators import statements as S
from ..sources import bridge as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
q = B.sql_text

# Layouts of summaries; names in braces are amounts in cents of AMOUNTS, printed with commas and a dollar sign.
LAYOUTS = [
    "Account Summary\nBeginning balance {begin_at}\nDeposits {in1}\nInterest credits {in2}\nChecks {out1}\nFees and charges {out2}\nEnding balance {fin}",
    "Opening balance\n{begin_at}\nDeposits and credits\n100 200\n{in1}\n{in2}\nAdditions\nWithdrawals\n{out1}\nFees\n{out2}\nClosing balance\n{fin}",
    "SUMMARY\nBeginning Balance {begin_at} Minimum Daily Balance $9,791 -\nDeposits & Credits {in1} + Average Statement Balance {in2}\n-\nWithdrawals {out1}\nFees {out2} -\nEnding Balance {fin1}",
    "Beginning Dividend Service Ending\nBalance + Deposits + Paid - Withdrawals - Charges = Balance\n{begin_at} {in1} {in2} {out1} {out2} {fin}\nPost Date Description",
    "Balance Summary\nBeginning Deposits and Checks and other Ending\nbalance other additions deductions balance\n{begin_at} {in1} {out1} {fin2}\n{in2} {out2} {out2} {in2}\nAverage ledger Average collected",
    "Account Summary\nBeginning balance {begin_at}\nDeposits {in1}\nUnnamed {in2}\nChecks {out1}\nEnding balance {far}",
    "SAVINGS ID 0001 Beginning Balance {in2}\n0 Total Deposits for {out2}\n0 Total Withdrawals for {out2}\nEnding Balance {in2}\nCHECKING ID 0010 Beginning Balance {begin_at}\nDividends Paid {in2} 85 Total Deposits for {in1}\n66 Total Withdrawals for {out1}\nAnnual yield 0.240% Ending Balance {fin2}",
    "Account Detail - Wells Fargo\nTotals {in1} {out1}\nEnding collected balance\n{begin_at}",
    "Printed from Chase for Business\nACH CREDIT STRIPE {in1} {begin_at}\nWIRE CREDIT {in2} {begin_at}\nZELLE CREDIT {out1} {begin_at} -\n{fin}\nPresent balance",
    "01/05/2026 DEPOSIT {in1} {begin_at}\n2026-01-07 credit memo {in2} {begin_at}\n01/09 check {out1} {fin}",
    "",
    "FARMERS\n12 CREDITS  {in1} x\nTHIS STATEMENT 01/30/26 {bare}",
    "Beginning balance {begin_at}\nDeposits {in1}\nAverage deposits {in2}\nChecks {out1}\nEnding balance {fin2}",
    "LAST STATEMENT 12/31/25 {begin_at}\n60 CREDITS {in1}\n72 DEBITS {out1}\nTHIS STATEMENT 01/30/26 {fin2}",
]
SCAN = 11
# Amounts in cents by a document's number and length; later ones may use earlier ones.
AMOUNTS = {
    "begin_at": "doc_id * 7919 % 900000 + 10000", "in1": "n_chars * 101 % 500000 + 100100", "in2": "(doc_id * 31 + n_chars) % 90000 + 50", "out1": "(doc_id * 17 + n_chars * 7) % 400000 + 75",
    "out2": "n_chars * 3 % 8000 + 25", "fin": "begin_at + in1 + in2 - out1 - out2", "fin1": "begin_at + in1 - out1 - out2", "fin2": "begin_at + in1 - out1", "far": "begin_at + in1 - out1 + in2 * 3 + 7",
}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    for name, rule in AMOUNTS.items():
        d = d.withColumn(name, F.expr(rule))

    def dollars(name: str) -> Column:
        x = F.col(name)
        return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x).cast("decimal(18,2)") / 100, 2))

    head = B.pick(LAYOUTS, F.col("doc_id"))
    for name in AMOUNTS:
        head = F.replace(head, F.lit("{" + name + "}"), dollars(name))
    head = F.replace(head, F.lit("{bare}"), F.format_number(F.col("begin_at").cast("decimal(18,2)") / 100, 2))
    head = F.replace(head, F.lit("CREDITS  $"), F.lit("CREDITS  "))
    return d.select("doc_id", F.lit("statement.pdf").alias("filename"), F.concat(head, F.lit("\n"), "text").alias("raw_text"), (F.pmod("doc_id", F.lit(len(LAYOUTS))) == SCAN).alias("used_ocr"))


def _head_sql() -> str:
    head = B.sql_pick(LAYOUTS, "doc_id").replace("\n", "' || chr(10) || '")
    for name in AMOUNTS:
        head = f"replace({head}, '{{{name}}}', CASE WHEN {name} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs({name}) / 100.0))"
    return f"replace(replace({head}, '{{bare}}', format('{{:,.2f}}', begin_at / 100.0)), 'CREDITS  $', 'CREDITS  ')"


def _figures_sql(name: str, source: str, keys: str, text: str) -> str:
    """Tables that end in `name`: keys, no, label, cents and sign of the amounts of source's texts."""
    return f"""{name}_t AS (SELECT {keys}, regexp_extract_all({text}, {q(L.PRINTED_FIGURE)}) AS v, string_split(regexp_replace({text}, {q(L.PRINTED_FIGURE)}, chr(1), 'g'), chr(1)) AS g FROM {source}),
{name}_k AS (SELECT {keys}, k, v[k] AS v, g[k] AS gap, g[k + 1] AS after, right(coalesce(v[k - 1], '') || g[k], 1) AS near, replace(regexp_replace(v[k], '^\\$\\s*', ''), ',', '') AS digits FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM {name}_t)),
{name}_c AS (SELECT *, regexp_matches(v, '[$,.]') AND NOT (starts_with(digits, '.') AND regexp_matches(near, '[0-9.]')) AND TRY_CAST(digits AS DECIMAL(18,2)) IS NOT NULL AS counts, regexp_replace(right(gap, 4), '[\\s$(]+$', '') AS front, regexp_replace(left(after, 4), '^[\\s$)]+', '') AS back FROM {name}_k),
{name}_g AS (SELECT *, sum(counts::INT) OVER (PARTITION BY {keys} ORDER BY k) - counts::INT AS grp FROM {name}_c),
{name} AS (SELECT {keys}, CAST(grp + 1 AS BIGINT) AS no, trim(regexp_replace(string_agg(gap || CASE WHEN counts THEN '' ELSE v END, '' ORDER BY k), '[^A-Za-z&/ ]', ' ', 'g')) AS label, max(CAST(CAST(TRY_CAST(digits AS DECIMAL(18,2)) AS DECIMAL(38,2)) * 100 AS BIGINT)) FILTER (counts) AS cents,
 max(CASE WHEN ends_with(front, '-') THEN -1 WHEN ends_with(front, '+') THEN 1 WHEN starts_with(back, '-') THEN -1 WHEN starts_with(back, '+') THEN 1 END) FILTER (counts) AS sign FROM {name}_g GROUP BY {keys}, grp HAVING bool_or(counts))"""


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


_amounts = ""
for _name, _rule in AMOUNTS.items():
    _amounts += f", {_rule} AS {_name}"
TEXTS = f"""cents AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(n_chars, 0) AS n_chars FROM documents), amounts AS (SELECT *{_amounts} FROM cents),
docs AS (SELECT doc_id, {_head_sql()} || chr(10) || text AS raw_text, doc_id % {len(LAYOUTS)} = {SCAN} AS used_ocr FROM amounts),
split AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM docs),
clean AS (SELECT doc_id, i, trim(regexp_replace(replace(replace(x, chr(160), ' '), chr(1), ' '), '\\s+', ' ', 'g')) AS line FROM split),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, line FROM clean WHERE line <> '')"""

CREDIT_OR_DEBIT = rf"(?i){L.CREDIT_NAME[4:]}|{L.DEBIT_NAME[4:]}"
AFTER_FIRST = f"CASE WHEN {_has('header', f'(?i){L.OPENING}')} AND NOT contains(regexp_extract(header, {q(f'(?i)^(.*?){L.OPENING}.*$')}, 1), '|') THEN regexp_extract(header, {q(f'(?i)^(.*?){L.OPENING}(.*)$')}, 2) ELSE regexp_extract(header, '^[^|]*\\|(.*)$', 1) END"
EQUATIONS = f"""WITH RECURSIVE {TEXTS},
carry AS (SELECT doc_id, line_no, line, CASE lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) WHEN '-' THEN -1 WHEN '+' THEN 1 END AS carried FROM lines),
plain AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, line, carried FROM carry WHERE line NOT IN ('-', '+')),
{_figures_sql('f', 'plain', 'doc_id, i', 'line')},
counted AS (SELECT doc_id, i, count(*) AS n FROM f GROUP BY 1, 2),
kinds AS (SELECT p.*, coalesce(n, 0) AS n, CASE WHEN regexp_matches(line, '[A-Za-z]') AND n IS NULL THEN 'L' WHEN NOT regexp_matches(line, '[A-Za-z]') AND n = 1 THEN 'F' ELSE 'O' END AS kind FROM plain p LEFT JOIN counted USING (doc_id, i)),
seen AS (SELECT *, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2 FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, false AS taken, CAST(NULL AS BIGINT) AS mate, false AS t1, false AS t2 FROM docs
 UNION ALL SELECT doc_id, i, taken, mate, t1 OR coalesce(mate = i + 1, false), coalesce(mate = i + 2, false) FROM (
  SELECT s.doc_id, s.i, w.t1 AS taken, w.t2 AS t1, CASE WHEN w.t1 THEN NULL WHEN s.kind = 'F' AND s.k1 = 'L' THEN s.i + 1 WHEN s.kind = 'L' AND NOT w.t2 AND s.k1 = 'F' THEN s.i + 1 WHEN s.kind = 'L' AND (w.t2 OR s.k1 = 'O') AND s.k2 = 'F' THEN s.i + 2 END AS mate
  FROM walk w JOIN seen s ON s.doc_id = w.doc_id AND s.i = w.i + 1)),
joined AS (SELECT k.doc_id, k.i, CASE WHEN m.line IS NULL THEN k.line WHEN k.kind = 'F' THEN m.line || ' ' || k.line ELSE k.line || ' ' || m.line END AS line, CASE WHEN k.kind = 'F' THEN coalesce(m.carried, k.carried) ELSE coalesce(k.carried, m.carried) END AS carried
 FROM kinds k JOIN walk w ON w.doc_id = k.doc_id AND w.i = k.i LEFT JOIN kinds m ON m.doc_id = w.doc_id AND m.i = w.mate WHERE NOT w.taken),
paired AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, line, carried, {_has('line', f'(?i){L.OPENING}')} AS opens, regexp_extract(line, {q(f'(?i)({L.OPENING}.*)')}, 1) AS from_open, regexp_extract(line, {q(f'(?i)({L.CLOSING}.*)')}, 1) AS from_close FROM joined),
named AS (SELECT * FROM paired WHERE from_open <> '' OR from_close <> ''),
{_figures_sql('fo', 'named', 'doc_id, r', 'from_open')}, {_figures_sql('fc', 'named', 'doc_id, r', 'from_close')},
balances AS (SELECT p.doc_id, p.r, p.opens, o.cents * coalesce(o.sign, p.carried, 1) AS opening, c.cents * coalesce(c.sign, p.carried, 1) AS closing FROM named p LEFT JOIN fo o ON o.doc_id = p.doc_id AND o.r = p.r AND o.no = 1 LEFT JOIN fc c ON c.doc_id = p.doc_id AND c.r = p.r AND c.no = 1),
starts AS (SELECT a.doc_id, a.r, a.opening, min(b.r) FILTER (b.opens) AS next_open, min(b.r) FILTER (NOT b.opens AND b.closing IS NOT NULL) AS until FROM balances a LEFT JOIN balances b ON a.doc_id = b.doc_id AND b.r > a.r AND b.r < a.r + {balances.BLOCK_LINES} WHERE a.opening IS NOT NULL GROUP BY 1, 2, 3),
blocks AS (SELECT s.doc_id, s.r AS pos, s.until, s.opening AS beginning, e.closing AS ending FROM starts s JOIN balances e ON e.doc_id = s.doc_id AND e.r = s.until WHERE next_open IS NULL OR until < next_open),
inside AS (SELECT p.doc_id, p.r, p.line, p.carried, b.pos, b.beginning, b.ending FROM blocks b JOIN paired p ON p.doc_id = b.doc_id AND p.r > b.pos AND p.r < b.until),
{_figures_sql('fp', 'inside', 'doc_id, pos, r', 'line')},
block_parts AS (SELECT 0 AS kind, CAST(0 AS BIGINT) AS head, i.doc_id, i.pos, i.beginning, i.ending, row_number() OVER (PARTITION BY i.doc_id, i.pos ORDER BY i.r, fp.no) AS k, fp.cents, coalesce(fp.sign, i.carried) IS NOT NULL AS printed,
 coalesce(fp.sign, i.carried, CASE WHEN {_has('fp.label', L.CREDIT_NAME)} AND NOT {_has('fp.label', L.DEBIT_NAME)} THEN 1 WHEN {_has('fp.label', L.DEBIT_NAME)} AND NOT {_has('fp.label', L.CREDIT_NAME)} THEN -1 END) AS sign
 FROM inside i JOIN fp ON fp.doc_id = i.doc_id AND fp.pos = i.pos AND fp.r = i.r WHERE fp.label <> ''),
firsts AS (SELECT h.doc_id, h.i AS head, min(t.i) AS j FROM kinds h JOIN kinds t ON t.doc_id = h.doc_id AND t.i > h.i AND t.i <= h.i + {balances.HEADER_LINES} AND t.n >= 3 WHERE {_has('h.line', L.HEADER_BEGINS)} GROUP BY 1, 2),
heads AS (SELECT f1.doc_id, f1.head, f1.j, string_agg(k.line, ' ' ORDER BY k.i) AS header FROM firsts f1 JOIN kinds k ON k.doc_id = f1.doc_id AND k.i >= f1.head AND k.i < f1.j GROUP BY 1, 2, 3),
bounds AS (SELECT h.*, coalesce((SELECT min(k.i) FROM kinds k WHERE k.doc_id = h.doc_id AND k.i > h.j AND k.n < 3), 1000000000) AS stop FROM heads h WHERE {_has('header', L.HEADER_ENDS)}),
told AS (SELECT b.*, list_transform(list_filter(string_split(header, ' ')[2:-2], lambda x: x IN ('+', '-')), lambda x: CASE WHEN x = '-' THEN -1 ELSE 1 END) AS marks, list_transform(regexp_extract_all(regexp_extract({AFTER_FIRST}, {q(f'(?i)^(.*?)(?:{L.CLOSING}.*)?$')}, 1), {q(CREDIT_OR_DEBIT)}), lambda x: CASE WHEN {_has('x', L.CREDIT_NAME)} THEN 1 ELSE -1 END) AS names FROM bounds b),
cells AS (SELECT t.doc_id, t.head, f.i AS pos, f.no, f.cents, f.sign, k.n, CASE WHEN len(marks) = k.n - 2 THEN marks WHEN len(names) = k.n - 2 THEN names END AS signs FROM told t JOIN kinds k ON k.doc_id = t.doc_id AND k.i >= t.j AND k.i < t.stop JOIN f ON f.doc_id = k.doc_id AND f.i = k.i),
ends_of AS (SELECT doc_id, head, pos, max(cents * coalesce(sign, 1)) FILTER (no = 1) AS beginning, max(cents * coalesce(sign, 1)) FILTER (no = n) AS ending FROM cells GROUP BY 1, 2, 3),
table_parts AS (SELECT 1 AS kind, head, doc_id, pos, beginning, ending, no - 1 AS k, cents, signs IS NOT NULL AS printed, signs[no - 1] AS sign FROM cells JOIN ends_of USING (doc_id, head, pos) WHERE no > 1 AND no < n),
parts AS (SELECT *, CASE WHEN sign IS NULL THEN [1, -1, 0] ELSE [sign] END AS strict, CASE WHEN sign IS NULL THEN [1, -1, 0] WHEN printed THEN [sign] ELSE [sign, 0] END AS loose FROM (SELECT * FROM block_parts UNION ALL SELECT * FROM table_parts)),
units AS (SELECT kind, head, doc_id, pos, beginning, ending, max(k) AS n, sum(ln(len(strict))) <= ln({balances.MOST}) + 1e-9 AS try_strict, sum(ln(len(loose))) <= ln({balances.MOST}) + 1e-9 AS try_loose, sum(CASE WHEN sign > 0 THEN cents ELSE 0 END) AS named_plus, sum(CASE WHEN sign < 0 THEN cents ELSE 0 END) AS named_minus FROM parts GROUP BY 1, 2, 3, 4, 5, 6),
tries AS (SELECT kind, head, doc_id, pos, w.pass, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS plus, CAST(0 AS BIGINT) AS minus, CAST(0 AS BIGINT) AS code, CAST(1 AS BIGINT) AS size FROM units, (VALUES (1), (2)) w(pass) WHERE CASE w.pass WHEN 1 THEN try_strict ELSE try_loose END
 UNION ALL SELECT kind, head, doc_id, pos, pass, k, plus + CASE WHEN s > 0 THEN cents ELSE 0 END, minus + CASE WHEN s < 0 THEN cents ELSE 0 END, code + size * (no - 1), size * len(few) FROM (
  SELECT t.kind, t.head, t.doc_id, t.pos, t.pass, p.k, t.plus, t.minus, t.code, t.size, p.cents, o.few, unnest(o.few) AS s, generate_subscripts(o.few, 1) AS no FROM tries t JOIN parts p ON p.kind = t.kind AND p.head = t.head AND p.doc_id = t.doc_id AND p.pos = t.pos AND p.k = t.k + 1, LATERAL (SELECT CASE t.pass WHEN 1 THEN p.strict ELSE p.loose END AS few) o)),
all_signs AS (SELECT t.*, abs(u.beginning + plus - minus - u.ending) AS gap FROM tries t JOIN units u USING (kind, head, doc_id, pos) WHERE t.k = u.n),
proofs AS (SELECT kind, head, doc_id, pos, pass, plus, minus FROM (SELECT DISTINCT kind, head, doc_id, pos, pass, plus, minus, min(plus + minus) OVER (PARTITION BY kind, head, doc_id, pos, pass) AS least FROM all_signs WHERE gap <= 1) WHERE plus + minus = least),
proven AS (SELECT kind, head, doc_id, pos, pass, min(plus) AS plus, min(minus) AS minus FROM proofs GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 1),
one AS (SELECT kind, head, doc_id, pos, arg_min(plus, pass) AS plus, arg_min(minus, pass) AS minus FROM proven GROUP BY 1, 2, 3, 4),
near AS (SELECT kind, head, doc_id, pos, arg_min(plus, {{'g': gap, 'c': code}}) AS plus, arg_min(minus, {{'g': gap, 'c': code}}) AS minus FROM all_signs WHERE pass = 1 GROUP BY 1, 2, 3, 4),
solved AS (SELECT u.kind, u.head, u.doc_id, u.pos, u.beginning, u.ending, coalesce(o.plus, n.plus, named_plus) AS deposits, coalesce(o.minus, n.minus, named_minus) AS withdrawals, o.plus IS NOT NULL AS verified FROM units u LEFT JOIN one o USING (kind, head, doc_id, pos) LEFT JOIN near n USING (kind, head, doc_id, pos)),
equations AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, pos) AS block_no FROM solved s WHERE kind = 0 OR (verified AND head = (SELECT min(head) FROM solved x WHERE x.doc_id = s.doc_id AND x.kind = 1 AND x.verified))),
picked AS (SELECT *, count(*) FILTER (verified) OVER (PARTITION BY doc_id, kind) AS accounts, row_number() OVER (PARTITION BY doc_id ORDER BY verified DESC, CASE WHEN verified THEN deposits + withdrawals ELSE 0 END DESC, block_no) AS place FROM equations)"""
MONEY_OUT = "CAST(beginning AS DOUBLE) / 100 AS beginning, CAST(ending AS DOUBLE) / 100 AS ending, CAST(deposits AS DOUBLE) / 100 AS deposits, CAST(withdrawals AS DOUBLE) / 100 AS withdrawals, CAST(beginning + deposits - withdrawals - ending AS DOUBLE) / 100 AS difference"
LAYOUT_OUT = "verified, CASE kind WHEN 0 THEN 'labelled_block' ELSE 'column_table' END AS layout"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TEXTS}, {_figures_sql('f', 'lines', 'doc_id, line_no', 'line')},
placed AS (SELECT doc_id, line_no, counts, sum(counts::INT) OVER w AS no, sum(length(gap) + length(v)) OVER w AS ends, length(v) AS n FROM f_c WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY k))
SELECT doc_id, line_no, CAST(no AS BIGINT) AS figure_no, CAST(ends - n AS BIGINT) AS starts, CAST(ends AS BIGINT) AS ends, cents, CAST(sign AS BIGINT) AS sign FROM placed JOIN f USING (doc_id, line_no, no) WHERE counts""")
def printed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.explode_lines(statements(spark, sf_dir))
    return balances.figure_rows(lines).withColumns({"starts": F.col("starts").cast("long"), "sign": F.col("sign").cast("long")})


@query(f"{EQUATIONS} SELECT doc_id, block_no, {MONEY_OUT}, {LAYOUT_OUT} FROM equations")
def summary_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balances.summary_blocks(statements(spark, sf_dir))
    return d.select("doc_id", F.col("block_no").cast("long").alias("block_no"), "beginning", "ending", "deposits", "withdrawals", "difference", "verified", "layout")


@query(f"{EQUATIONS} SELECT doc_id, {MONEY_OUT}, {LAYOUT_OUT}, accounts FROM picked WHERE place = 1")
def pick_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balances.pick_equation(balances.summary_blocks(statements(spark, sf_dir)))
    return d.select("doc_id", "beginning", "ending", "deposits", "withdrawals", "difference", "verified", "layout", "accounts")


def _money_values_sql() -> str:
    return f"""mv AS (SELECT doc_id, line_no, k, v[k] AS v, right(coalesce(v[k - 1], '') || g[k], 3) || v[k] || left(g[k + 1] || coalesce(v[k + 1], ''), 3) AS chunk FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM (
 SELECT doc_id, line_no, regexp_extract_all(line, {q(L.FIGURE)}) AS v, string_split(regexp_replace(line, {q(L.FIGURE)}, chr(1), 'g'), chr(1)) AS g FROM lines))),
mn AS (SELECT doc_id, line_no, k, TRY_CAST(regexp_replace(v, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) AS a FROM mv WHERE NOT (length(regexp_replace(v, '\\D', '', 'g')) >= 7 AND NOT regexp_matches(v, '[,$.]'))),
money AS (SELECT doc_id, line_no, list(a ORDER BY k) AS vals, coalesce(list(a ORDER BY k) FILTER (a NOT BETWEEN 2020 AND 2030), []) AS few FROM mn WHERE a <= 50000000 GROUP BY 1, 2),
amounted AS (SELECT l.doc_id, l.line_no, l.line, lower(l.line) AS low, coalesce(vals, []) AS vals, coalesce(few, []) AS few FROM lines l LEFT JOIN money USING (doc_id, line_no)),
near_lines AS (SELECT *, coalesce(lead(few[1]) OVER w, lead(few[1], 2) OVER w) AS below, coalesce(lag(few[1]) OVER w, lag(few[1], 2) OVER w, lag(few[1], 3) OVER w) AS above FROM amounted WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


def _last_sql(condition: str, value: str) -> str:
    return f"max({{'n': line_no, 'v': {value}}}) FILTER ({condition})"


_dated, _has_some = _has("low", L.DATED_LINE), "len(few) >= 2"
SUMMARY = f"""{EQUATIONS}, {_money_values_sql()},
marks_of AS (SELECT doc_id, contains(lower(raw_text), {q(L.ONLINE_HEADS[0])}) AS online, contains(lower(raw_text), {q(L.ONLINE_HEADS[1])}) AS posted, contains(lower(raw_text), 'farmers') AS farmers, {_has('lower(raw_text)', L.SCANNED_MEMBERS)} AS members FROM docs),
evidence AS (SELECT doc_id,
 {_last_sql("online AND (low = 'totals' OR starts_with(low, 'totals ')) AND len(vals) >= 2", 'vals[1]')}.v AS od, {_last_sql("online AND (starts_with(low, 'current posted balance') OR starts_with(low, 'ending collected balance'))", 'coalesce(vals[1], below)')}.v AS oe,
 sum(few[-2]) FILTER (posted AND {_has('low', L.POSTED_CREDIT)} AND {_has_some} AND NOT regexp_matches(line, '[—–-]\\s*$')) AS pd, {_last_sql("posted AND contains(low, 'present balance')", 'coalesce(few[1], above)')}.v AS pe,
 sum(few[-2]) FILTER ({_dated} AND {_has('low', L.DATED_CREDIT)} AND NOT regexp_matches(low, 'ending balance|balance forward') AND {_has_some}) AS dd, {_last_sql(f"(regexp_matches(low, '\\bending balance\\b') AND len(few) >= 1) OR ({_dated} AND {_has_some})", 'few[-1]')}.v AS de
 FROM near_lines JOIN marks_of USING (doc_id) GROUP BY 1),
scans AS (SELECT doc_id, TRY_CAST(regexp_replace(regexp_extract(raw_text, {q(L.SCANNED_CREDITS)}, 1), '[,\\s]', '', 'g') AS DOUBLE) AS fd, TRY_CAST(regexp_replace(regexp_extract(raw_text, {q(L.SCANNED_ENDING)}, 1), '[,\\s]', '', 'g') AS DOUBLE) AS fe,
 list_max(list_filter(list_transform(regexp_extract_all(trim(regexp_replace(replace(raw_text, chr(160), ' '), '\\s+', ' ', 'g')), {q(L.SCANNED_DEPOSITS)}, 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x >= 1000 AND x < 10000000)) AS md,
 TRY_CAST(replace(regexp_extract(trim(regexp_replace(replace(raw_text, chr(160), ' '), '\\s+', ' ', 'g')), {q(L.SCANNED_TOTAL)}, 1), ',', '') AS DOUBLE) AS mt FROM docs WHERE used_ocr),
accounts_of AS (SELECT doc_id, CAST(arg_min(list_filter(few, lambda x: x >= 100 AND x < 1000000)[-1], line_no) AS DOUBLE) AS me FROM amounted WHERE {_has('line', L.SCANNED_ACCOUNT)} AND len(list_filter(few, lambda x: x >= 100 AND x < 1000000)) > 0 GROUP BY 1),
scanned AS (SELECT doc_id, CASE WHEN farmers AND (fd IS NOT NULL OR fe IS NOT NULL) THEN {{'d': fd, 'e': fe, 'w': 'Farmers OCR summary'}} WHEN members AND (md IS NOT NULL OR coalesce(me, mt) IS NOT NULL) THEN {{'d': md, 'e': coalesce(me, mt), 'w': 'IMCU OCR summary'}} END AS x FROM scans JOIN marks_of USING (doc_id) LEFT JOIN accounts_of USING (doc_id)),
eq AS (SELECT doc_id, {MONEY_OUT}, {LAYOUT_OUT} FROM picked WHERE place = 1),
ranked AS (SELECT docs.doc_id, CASE WHEN verified THEN 99 WHEN od IS NOT NULL AND oe IS NOT NULL THEN 94 WHEN pd IS NOT NULL AND pe IS NOT NULL THEN 88 WHEN dd IS NOT NULL AND de IS NOT NULL THEN 78 WHEN layout IS NOT NULL THEN 40 ELSE 0 END AS c, eq.* EXCLUDE (doc_id), evidence.* EXCLUDE (doc_id), CASE WHEN NOT coalesce(verified, false) THEN scanned.x END AS x
 FROM docs LEFT JOIN eq USING (doc_id) LEFT JOIN evidence USING (doc_id) LEFT JOIN scanned USING (doc_id))"""
SUMMARY_ROWS = f"""SELECT doc_id, CASE WHEN c IN (99, 40) THEN beginning END AS beginning, coalesce(x.d, CASE c WHEN 94 THEN CAST(od AS DOUBLE) WHEN 88 THEN CAST(pd AS DOUBLE) WHEN 78 THEN CAST(dd AS DOUBLE) WHEN 0 THEN NULL ELSE deposits END) AS deposits, CASE WHEN c IN (99, 40) THEN withdrawals END AS withdrawals,
 coalesce(x.e, CASE c WHEN 94 THEN CAST(oe AS DOUBLE) WHEN 88 THEN CAST(pe AS DOUBLE) WHEN 78 THEN CAST(de AS DOUBLE) WHEN 0 THEN NULL ELSE ending END) AS ending, CASE WHEN c IN (99, 40) THEN difference END AS difference, CAST(CASE WHEN x IS NOT NULL THEN greatest(c, 95) ELSE c END AS BIGINT) AS confidence,
 coalesce(x.w, CASE c WHEN 94 THEN {q(L.SUMMARY_EVIDENCE[0][2])} WHEN 88 THEN {q(L.SUMMARY_EVIDENCE[1][2])} WHEN 78 THEN {q(L.SUMMARY_EVIDENCE[2][2])} WHEN 0 THEN 'No summary found' ELSE CASE WHEN verified THEN 'Verified ' ELSE 'Unproven ' END || replace(layout, '_', ' ') END) AS evidence FROM ranked"""


@query(f"{SUMMARY}\n{SUMMARY_ROWS}")
def statement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balances.statement_summary(statements(spark, sf_dir))
