"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

from strandflow.llm.quality_rules import MEASURES, Fences

_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase

OP2 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""

#: The checksum of doc_id as text, bit by bit.
_CRC32 = "xor(list_reduce([4294967295::BIGINT] || [ord(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: Levels of nodes by recursion, their siblings to the left and right, then from each leaf up: through its source's tree (kind 0) and the tree of subroots (kind 1).
OP11 = rf"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_LEAF.format(text='text')} AS leaf,
             {_LEAF.format(text=f"(CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS candidate FROM documents),
s AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM s
      UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 3, n),
r AS (SELECT tree, digest AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM r) AS n, subroot AS digest FROM r
      UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
a AS (SELECT 0 AS kind, tree, level, pos, n, digest FROM t UNION ALL SELECT 1, 0, level, pos, n, digest FROM u),
b AS (SELECT a.kind, a.tree, a.level, a.pos, coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos < a.pos), '') AS before, coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos > a.pos), '') AS after
      FROM a LEFT JOIN a o ON o.kind = a.kind AND o.tree = a.tree AND o.level = a.level AND o.pos // 3 = a.pos // 3 AND o.pos != a.pos WHERE a.n > 1 GROUP BY ALL),
p AS (SELECT rid, 0 AS kind, tree, 0 AS level, pos, n, '' AS proof, candidate AS folded FROM s
      UNION ALL SELECT p.rid, p.kind, p.tree, p.level + 1, p.pos // 3, (p.n + 2) // 3, p.proof || b.before || b.after, sha256(b.before || p.folded || b.after)
      FROM p JOIN b ON b.kind = p.kind AND b.tree = p.tree AND b.level = p.level AND b.pos = p.pos),
q AS (SELECT rid, 1 AS kind, 0 AS level, tree AS pos, proof, folded FROM p WHERE n = 1
      UNION ALL SELECT q.rid, q.kind, q.level + 1, q.pos // 3, q.proof || b.before || b.after, sha256(b.before || q.folded || b.after)
      FROM q JOIN b ON b.kind = 1 AND b.level = q.level AND b.pos = q.pos),
f AS (SELECT rid, max_by(proof, level) AS proof, max_by(folded, level) AS folded FROM q GROUP BY rid),
top AS (SELECT max_by(digest, level) AS root FROM u)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM s JOIN r USING (tree) JOIN f USING (rid), top
"""

#: Every kept term with every group of its language, then all pairs of sources; q is the part in the whole language.
OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v))::BIGINT AS p,
             (1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v))::BIGINT AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def op1(how: Fences = Fences()) -> str:
    names = [k for k, _, _ in MEASURES]
    levels = {"s": ("lang, source", "s.lang IS NOT DISTINCT FROM r.lang AND s.source IS NOT DISTINCT FROM r.source"), "l": ("lang", "l.lang IS NOT DISTINCT FROM r.lang"), "a": ("1", "true")}

    def level(name: str) -> str:
        by = levels[name][0]
        ranked = ", ".join(f"{k}, row_number() OVER (PARTITION BY {by}, {k} IS NULL ORDER BY {k}) AS i_{k}, count({k}) OVER (PARTITION BY {by}) AS n_{k}" for k in names)
        quarts = ", ".join(f"min({k}) FILTER ({k} IS NOT NULL AND i_{k} >= ceil({q} * n_{k})) AS q{p}_{k}" for k in names for p, q in ((1, 0.25), (3, 0.75)))
        keys = "" if by == "1" else f"{by}, "
        return f"{name} AS (SELECT {keys}count(*) AS n, {quarts} FROM (SELECT lang, source, {ranked} FROM r WHERE n_words > 0) GROUP BY {by if by != '1' else 'ALL'})"

    pick = lambda c: f"CASE WHEN s.n >= {how.support} THEN s.{c} WHEN l.n >= {how.support} THEN l.{c} ELSE a.{c} END"
    within = []
    for k, spread, low in MEASURES:
        reach = f"{how.reach} * greatest({pick(f'q3_{k}')} - {pick(f'q1_{k}')}, {getattr(how, spread)})"
        within.append(f"coalesce(r.{k} <= {pick(f'q3_{k}')} + {reach}, true)")
        if low:
            within.append(f"coalesce(r.{k} >= {pick(f'q1_{k}')} - {reach}, true)")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS k FROM w, unnest(range(1, len(words) - 3)) AS t(i)),
twice AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM twice GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep ON w.rid = rep.rid),
r AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words::DOUBLE END AS symbol_rate, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words::DOUBLE END AS word_length,
       CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines::DOUBLE END AS line_rate, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
{level('s')}, {level('l')}, {level('a')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(within)} AS kept
FROM r LEFT JOIN s ON {levels['s'][1]} LEFT JOIN l ON {levels['l'][1]} LEFT JOIN a ON true
"""
