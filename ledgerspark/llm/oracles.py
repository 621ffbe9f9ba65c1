"""DuckDB SQL of the operators that SQL can express, for the production parameters of the queries."""

from __future__ import annotations

from . import licences
from .mixing import STEP

WORD = r"[^\x20\x09-\x0D]+"


def _hash(value: str) -> str:
    return f"CAST('0x' || substr(md5({value}), 1, 15) AS BIGINT)"


def _seats(cells: str, group: str, ideal: str, total: str, name: str) -> str:
    """Tables that end in `name`: cells with `seats`, whole numbers of the sum `total` by highest quotients."""
    return f"""
{name}_n AS (SELECT *, CAST(floor({ideal} + 0.5) AS BIGINT) AS near, row_number() OVER () AS cell_no FROM {cells}),
{name}_g AS (SELECT *, CAST({total} AS BIGINT) - sum(near) OVER (PARTITION BY {group}) AS gap FROM {name}_n),
{name}_s AS (SELECT *, CASE WHEN gap > 0 THEN near + step ELSE near - 1 - step END AS seat FROM (SELECT *, unnest(range(0, CAST(greatest(abs(gap), 1) AS BIGINT))) AS step FROM {name}_g)),
{name}_q AS (SELECT *, CASE WHEN gap <> 0 AND seat >= 0 THEN {ideal} / (2 * seat + 1) END AS quotient FROM {name}_s),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN gap > 0 THEN -quotient ELSE quotient END ASC NULLS LAST, ordering ASC NULLS LAST, step) AS place FROM {name}_q),
{name}_m AS (SELECT cell_no, sum(CASE WHEN quotient IS NOT NULL AND place <= abs(gap) THEN sign(gap) ELSE 0 END) AS moved FROM {name}_p GROUP BY 1),
{name} AS (SELECT n.*, CAST(n.near + m.moved AS BIGINT) AS seats FROM {name}_n n JOIN {name}_m m USING (cell_no))"""


MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, {_hash("'17/' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS pos FROM documents),
e AS (SELECT *, pos % (SELECT greatest(1, CAST(ceil(sum(size) / 1000000.0) AS BIGINT)) FROM d) AS shard FROM d),
c AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell_size FROM e GROUP BY 1, 2),
s AS (SELECT source, CAST(sum(cell_size) AS BIGINT) AS source_size FROM c GROUP BY 1),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST) + weight AS weight_left, sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST) - cap AS cap_before FROM w),
l AS (SELECT *, (total - cap_before) / weight_left AS level FROM r),
t AS (SELECT source, source_size, source AS ordering, 1 AS one, coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1) * weight), CAST(cap AS DOUBLE)) AS target FROM l),
b AS (SELECT *, target / 32 AS blocks FROM t),{_seats('b', 'one', 'blocks', 'floor(sum(blocks) OVER () + 0.5)', 'q')},
i AS (SELECT c.source, c.shard, c.shard AS ordering, c.cell_size, q.source_size, q.target, q.seats AS quota, CASE WHEN q.source_size > 0 THEN CAST(q.seats * c.cell_size AS DOUBLE) / q.source_size ELSE 0.0 END AS ideal FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source),{_seats('i', 'source', 'ideal', 'max(quota) OVER (PARTITION BY source)', 'k')},
n AS (SELECT *, CAST(greatest(1, ceil(cell_size / 32)) AS BIGINT) AS n_blocks FROM k),
x AS (SELECT *, least(2 * n_blocks, CAST(floor((CAST(seats * 32 AS DOUBLE) / greatest(cell_size, 1)) * n_blocks + 0.5) AS BIGINT)) AS taken_blocks FROM n),
y AS (SELECT *, taken_blocks // n_blocks AS passes, taken_blocks % n_blocks AS extra, {_hash("'17/' || coalesce(source, '') || '/' || CAST(shard AS VARCHAR)")} % n_blocks AS turn FROM x),
f AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY pos, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM e),
j AS (SELECT f.doc_id, f.size, f.before, y.source_size, y.target, y.cell_size, y.n_blocks, y.passes, y.extra, y.turn FROM f JOIN y ON f.source IS NOT DISTINCT FROM y.source AND f.shard = y.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE passes * size + CASE WHEN extra > 0 THEN list_sum(list_transform(range(before * n_blocks // cell_size, (before + size - 1) * n_blocks // cell_size + 1), lambda b:
 CASE WHEN (b * ({STEP} % n_blocks) + turn) % n_blocks < extra THEN greatest(0, least(before + size, ((b + 1) * cell_size + n_blocks - 1) // n_blocks) - greatest(before, (b * cell_size + n_blocks - 1) // n_blocks)) ELSE 0 END)) ELSE 0 END END AS BIGINT) AS taken FROM j"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINES = f"""
WITH split AS (SELECT doc_id, unnest(string_split({LOWER}, chr(10))) AS line, generate_subscripts(string_split({LOWER}, chr(10)), 1) - 1 AS pos FROM documents),
sets AS (SELECT doc_id, pos, list_sort(list_distinct(regexp_extract_all(line, '{WORD}'))) AS words FROM split WHERE regexp_matches(line, '{WORD}')),
classes AS (SELECT words, min({{'d': doc_id, 'a': pos}}) AS first, count(*) AS n, row_number() OVER () AS id, len(words) AS size FROM sets GROUP BY words),
each AS (SELECT id, size, unnest(words) AS word FROM classes),
rare AS (SELECT word, count(*) AS df FROM each GROUP BY 1),
ranked AS (SELECT id, size, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS place FROM each JOIN rare USING (word)),
prefix AS (SELECT * FROM ranked WHERE place <= size - CAST(ceil(4 * size / 5) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.word = b.word AND a.id <> b.id AND 4 * a.size <= 5 * b.size AND 4 * b.size <= 5 * a.size),
links AS (SELECT x, y FROM pairs JOIN classes a ON a.id = x JOIN classes b ON b.id = y WHERE 5 * len(list_intersect(a.words, b.words)) >= 4 * (a.size + b.size - len(list_intersect(a.words, b.words)))),
near AS (SELECT x AS id, count(*) AS links, min(first) AS near FROM links JOIN classes ON classes.id = y GROUP BY 1),
judged AS (SELECT s.doc_id, s.pos, coalesce(links, 0) AS links, least(c.first, coalesce(near, c.first)) < {{'d': s.doc_id, 'a': s.pos}} AS gone FROM sets s JOIN classes c USING (words) LEFT JOIN near USING (id))
SELECT d.doc_id, count(pos) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (gone), '') AS removed_lines, CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY 1"""

ORACLE_SQL = {"op2_similar_lines": LINES, "op5_mix_sources": MIX, "op8_license_digests": licences.scan_sql()}
