"""SQL for the operators it can express, from their definitions: all blocks against all templates, all windows, closed forms."""

from __future__ import annotations

from .licenses import BASE, NOTICES, rivals
from .mixing import WEIGHTS

BLANKS = r"[^ \t\n\v\f\r]+"


def _values(rows) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def license_scan() -> str:
    step = max(len(t.words) for t in BASE + NOTICES)
    tokens = [(k, t.label, t.need, len(t.tokens), w) for k, t in enumerate(NOTICES) for w in t.tokens]
    phrases = [(t.label, " ".join(t.words), len(t.words)) for t in BASE]
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
tok AS (SELECT * FROM (VALUES {_values(tokens)}) AS t(k, label, need, n, word)), phr AS (SELECT * FROM (VALUES {_values(phrases)}) AS p(label, phrase, n)),
b AS (SELECT DISTINCT doc_id, i // {step} - o AS block, word FROM w, (VALUES (0), (1)) AS o(o) WHERE i // {step} - o >= 0),
rival AS (SELECT * FROM (VALUES {_values(rivals(NOTICES))}) AS r(k, other)),
fits AS (SELECT doc_id, block, k, any_value(label) AS label, count(*) / any_value(n)::DOUBLE AS score FROM b JOIN tok USING (word) GROUP BY doc_id, block, k HAVING count(*) >= any_value(need)),
beaten AS (SELECT DISTINCT m.doc_id, m.block, m.k FROM fits m JOIN rival USING (k) JOIN fits o ON o.doc_id = m.doc_id AND o.k = rival.other AND o.score > m.score AND abs(o.block - m.block) <= 1),
hit AS (SELECT * FROM fits ANTI JOIN beaten USING (doc_id, block, k)),
place AS (SELECT d.doc_id, p.label, i FROM d, phr p, unnest(range(0, len(d.w) - p.n + 1)) AS u(i) WHERE array_to_string(d.w[i + 1:i + p.n], ' ') = p.phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM hit) GROUP BY doc_id),
top AS (SELECT doc_id, max(score) AS score FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, greatest(coalesce(top.score, 0), CASE WHEN base.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN top USING (doc_id)"""


def near_dedup(size: int = 4, threshold: int = 80) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low}, '{BLANKS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + {size}], ' ') AS item FROM d, unnest(range(0, greatest(len(w) - {size} + 1, 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {threshold} * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, v FROM reach JOIN both_ways ON b = u),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def quality_rules(max_docs: int = 50, min_share: float = 0.2, min_chars: int = 40) -> str:
    return rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{BLANKS}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS x FROM d, unnest(range(0, len(w) - 4)) AS u(i)),
again AS (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN again USING (doc_id, x), unnest(range(0, 5)) AS u(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, line, trim(regexp_replace(lower(line), '[ \t\n\v\f\r]+', ' ', 'g')) AS norm FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{BLANKS}')),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS chars FROM l GROUP BY doc_id),
often AS (SELECT source, norm, min(doc_id) AS first_id FROM l GROUP BY source, norm HAVING count(DISTINCT doc_id) > {max_docs}),
lost AS (SELECT doc_id, sum(length(line)) AS chars FROM l JOIN often o ON o.norm = l.norm AND o.source IS NOT DISTINCT FROM l.source WHERE doc_id <> first_id GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.chars, 0)::BIGINT AS removed_chars, coalesce(ln.chars, 0)::BIGINT AS line_chars
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN lost USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, removed_chars > 0 AND (line_chars - removed_chars < {min_share} * line_chars OR line_chars - removed_chars < {min_chars}) AS depleted FROM m)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v"""


def lines_removed(max_docs: int = 50) -> str:
    """The texts that the quality stage keeps, without their lines above the limit."""
    return rf"""WITH verdict AS ({quality_rules(max_docs)}),
l AS (SELECT doc_id, source, i, line, CASE WHEN regexp_matches(line, '{BLANKS}') THEN trim(regexp_replace(lower(line), '[ \t\n\v\f\r]+', ' ', 'g')) END AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
often AS (SELECT source, norm FROM l WHERE norm IS NOT NULL GROUP BY source, norm HAVING count(DISTINCT doc_id) > {max_docs}),
k AS (SELECT l.* FROM l JOIN verdict v USING (doc_id) WHERE v.kept),
witness AS (SELECT k.source, k.norm, min(doc_id) AS holder FROM k JOIN often o ON o.norm = k.norm AND o.source IS NOT DISTINCT FROM k.source GROUP BY ALL),
x AS (SELECT k.*, coalesce(k.doc_id <> w.holder, FALSE) AS cut FROM k LEFT JOIN witness w ON w.norm = k.norm AND w.source IS NOT DISTINCT FROM k.source),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS t, count(*) FILTER (cut) AS n_cut FROM x GROUP BY doc_id)
SELECT doc_id, n_cut, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM t"""


def mixing(share: float = 1.5, cap: float = 2.0, seed: str = "mix", block: int = 1024, interleaved: bool = False) -> str:
    """The schedule slot by slot: points, ranks, blocks, and the words each slot holds of each document."""
    weights = "[" + ", ".join(f"{float(w)}" for w in WEIGHTS) + "]"
    tables = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{BLANKS}'))::BIGINT AS size, md5(concat('{seed}', coalesce(doc_id::VARCHAR, 'null'))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
w AS (SELECT *, ({weights})[idx % {len(WEIGHTS)} + 1]::DOUBLE AS w, {cap}::DOUBLE * source_size AS most, {share}::DOUBLE * sum(source_size) OVER () AS budget FROM s),
f AS (SELECT *, sum(most) OVER (ORDER BY most / w, idx) + most / w * coalesce(sum(w) OVER (ORDER BY most / w, idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) < budget AS capped FROM w),
g AS (SELECT *, (budget - coalesce(sum(most) FILTER (capped) OVER (), 0)) / nullif(sum(w) FILTER (NOT capped) OVER (), 0) AS level FROM f),
t AS (SELECT idx, source, source_size, CASE WHEN capped THEN most ELSE least(most, level * w) END AS target FROM g),
a AS (SELECT d.*, idx, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos0 FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
p AS (SELECT idx, source_size, round(target)::BIGINT % source_size AS rest, (source_size + {block - 1}) // {block} AS blocks,
  round(target)::BIGINT // source_size * ((source_size + {block - 1}) // {block}) + (round(target)::BIGINT % source_size + {block - 1}) // {block} AS need FROM t WHERE source_size > 0),
iv AS (SELECT *, (sum(need) OVER (ORDER BY idx))::BIGINT AS hi, (sum(need) OVER (ORDER BY idx))::BIGINT - need AS lo, (sum(need) OVER ())::BIGINT AS total FROM p),
point AS (SELECT slot, floor((slot % 2147483648 * 2654435769) % 4294967296 / 4294967296.0::DOUBLE * total) AS y FROM (SELECT any_value(total) AS total FROM iv) n, range(coalesce(total, 0)) AS r(slot)),
drawn AS (SELECT idx, slot, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank FROM point JOIN iv ON y >= lo AND y < hi),
got AS (SELECT iv.idx, need, total, count(slot) AS got FROM iv LEFT JOIN drawn USING (idx) GROUP BY ALL),
more AS (SELECT idx, total + row_number() OVER (ORDER BY idx, rank) - 1 AS slot, rank FROM got, range(got, need) AS r(rank)),
slots AS (SELECT u.idx, slot, rank % blocks AS block, CASE WHEN rank = need - 1 AND rest > 0 THEN least(rest - rank % blocks * {block}, {block}) ELSE least({block}, source_size - rank % blocks * {block}) END AS tokens
  FROM (SELECT * FROM drawn UNION ALL BY NAME SELECT * FROM more) u JOIN iv USING (idx) WHERE rank < need),
held AS (SELECT a.doc_id, a.h, a.size, a.pos0, a.idx, slot, block, greatest(a.pos0, block * {block}) AS lo, least(a.pos0 + a.size, block * {block} + tokens) AS hi
  FROM a JOIN slots USING (idx) WHERE a.size > 0 AND block * {block} < a.pos0 + a.size AND block * {block} + tokens > a.pos0)"""
    if interleaved:
        return tables + "\nSELECT slot::BIGINT AS slot, idx::BIGINT AS idx, block::BIGINT AS block, doc_id, (lo - pos0)::BIGINT AS start, (hi - lo)::BIGINT AS length FROM held"
    return tables + """,
sums AS (SELECT idx, pos0, doc_id, sum(hi - lo) AS taken, count(*) AS n_slots, min(slot) AS first_slot FROM held GROUP BY ALL)
SELECT a.doc_id, a.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_slots, 0)::BIGINT AS n_slots, first_slot::BIGINT AS first_slot
FROM a LEFT JOIN sums u ON u.idx = a.idx AND u.pos0 = a.pos0 AND u.doc_id IS NOT DISTINCT FROM a.doc_id AND a.size > 0"""
