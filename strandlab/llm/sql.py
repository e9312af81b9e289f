"""SQL twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from strandlab.llm.host_reputation import BOUND, GOOD, STRONGEST, WEAKEST
from strandlab.llm.merkle import DIGITS, LEAF, PARAGRAPH, SECTION

EXACT = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""


def _tree(text: str, name: str) -> str:
    """Columns of the tree of ``text``: its digests by section, paragraph and leaf."""
    short = lambda x: f"substr(sha256({x}), 1, {DIGITS})"
    return (
        f"list_transform(regexp_extract_all({text}, '{SECTION}'), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}'), "
        f"lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: {short('x')}))) AS {name}_tree"
    )


def _form(name: str) -> str:
    short = lambda x: f"substr(sha256({x}), 1, {DIGITS})"
    joined = "coalesce(list_aggregate({}, 'string_agg', '{}'), '')".format
    par = short(joined("p", ""))
    section = short(joined(f"list_transform(s, lambda p: {par})", ""))
    root = f"sha256({joined(f'list_transform({name}_tree, lambda s: {section})', '')})"
    paragraphs = joined(f"list_transform(s, lambda p: {par} || '[' || {joined('p', ',')} || ']')", " ")
    sections = joined(f"list_transform({name}_tree, lambda s: {section} || '(' || {paragraphs} || ')')", " ")
    return f"{root} AS {name}_root, CASE WHEN len({name}_tree) = 0 THEN {root} ELSE {root} || ' ' || {sections} END AS {name}, list_distinct(flatten(flatten({name}_tree))) AS {name}_leaves"


def _near(a: str, b: str) -> str:
    both = f"(len({a}_leaves) + len({b}_leaves))"
    return f"CASE WHEN {a}_root = {b}_root THEN 1.0::DOUBLE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}_leaves, {b}_leaves)) / {both} END"


MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, text[:n_chars - n_chars // 2] || next[:n_chars // 2] AS edited FROM o),
t AS (SELECT *, {_tree('text', 'fingerprint')}, {_tree('edited', 'edited_fingerprint')}, {_tree('next', 'next')} FROM e),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_form('fingerprint')}, {_form('edited_fingerprint')}, {_form('next').replace(' AS next,', ' AS next_form,')} FROM t)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_near('fingerprint', 'edited_fingerprint')} AS near_edited, {_near('fingerprint', 'next')} AS near_next FROM f
"""


def url_filter(rules: Sequence[tuple[str, str]]) -> str:
    values = ", ".join(f"('{verdict}', '{pattern}', '{pattern.partition('/')[0]}', '/{pattern.partition('/')[2]}')" for verdict, pattern in rules)
    strength = """SELECT CASE WHEN k < 2 OR p <= 0 OR p >= 1 OR p IS NULL THEN {most} WHEN room <= 0 OR spread / room <= 0 THEN {most} ELSE least({most}, greatest({least}, room / spread - 1)) END AS w
        FROM (SELECT k, p, (g2 - g * p) / (p * (1 - p)) - (k - 1) AS spread, n - n2 / n - (k - 1) AS room
              FROM (SELECT count(*) AS k, sum(tried)::DOUBLE AS n, sum(tried * tried)::DOUBLE AS n2, sum(good)::DOUBLE AS g, sum(good)::DOUBLE / sum(tried) AS p, sum(good * good / tried::DOUBLE) AS g2 FROM {table} WHERE tried > 0))"""
    weight = lambda table: strength.format(table=table, most=STRONGEST, least=WEAKEST)
    return rf"""
WITH rules(verdict, pattern, rule_host, rule_path) AS (VALUES {values}),
parsed AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
pairs AS (SELECT DISTINCT host, path FROM parsed),
fits AS (SELECT host, path, arg_max(pattern, length(pattern)) AS rule, arg_max(verdict, length(pattern)) AS said FROM pairs JOIN rules
         ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
judged AS (SELECT page_id, host, path, rule, said FROM parsed LEFT JOIN fits USING (host, path)),
hosts AS (SELECT host, array_to_string(string_split(regexp_replace(host, ':[0-9]*$', ''), '.')[-2:], '.') AS domain, string_split(regexp_replace(host, ':[0-9]*$', ''), '.')[-1] AS suffix,
                 count(said) AS tried, count(*) FILTER (said = 'allow') AS good FROM judged GROUP BY host),
domains AS (SELECT domain, suffix, sum(tried)::BIGINT AS tried, sum(good)::BIGINT AS good FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(tried)::BIGINT AS tried, sum(good)::BIGINT AS good FROM domains GROUP BY suffix),
mean AS (SELECT coalesce(sum(good)::DOUBLE / nullif(sum(tried), 0), {GOOD}) AS m FROM suffixes),
ws AS ({weight('suffixes')}), wd AS ({weight('domains')}), wh AS ({weight('hosts')}),
s AS (SELECT suffix, (good + w * m) / (tried + w) AS prior FROM suffixes, ws, mean),
d AS (SELECT domain, (good + w * prior) / (tried + w) AS prior FROM domains JOIN s USING (suffix), wd),
h AS (SELECT host, (good + w * prior) / (tried + w) AS rate, tried + w AS n FROM hosts JOIN d USING (domain), wh)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN round(rate + {BOUND} * sqrt(rate * (1 - rate) / (n + 1)), 9) >= {GOOD} THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN round(rate, 9) END AS rate
FROM judged JOIN h USING (host)
"""


def near_join(width: int, num: int, den: int) -> str:
    """Links of equal sets are one class each; pairs of classes are counted over all their shared shingles."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
      ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i:i + {width - 1}], ' ')))) END AS shingles FROM w),
d AS (SELECT doc_id, len(shingles) AS n, sha256(array_to_string(shingles, chr(10))) AS k, shingles FROM s),
c AS (SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(shingles) AS shingles FROM d WHERE n > 0 GROUP BY k),
e AS (SELECT id, n, unnest(shingles) AS g FROM c),
p AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.g = y.g AND x.id < y.id AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)
      GROUP BY x.id, y.id, x.n, y.n HAVING {den} * count(*) >= {num} * (x.n + y.n - count(*))),
b AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, seen) AS (SELECT id, id FROM c UNION SELECT r.id, b.b FROM r JOIN b ON r.seen = b.a),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, d.n AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM d LEFT JOIN c ON d.k = c.k AND d.n > 0 LEFT JOIN m ON c.id = m.id
"""


#: crc32 of a decimal number: each byte is added and then shifted out bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

PREFIX_TRIE = f"""
WITH d AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS t, digest, chars FROM d),
c AS (SELECT conv_id, count(*) AS n, {_CRC} % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.t AS pos, digest, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.t < c.h
      UNION ALL SELECT t.conv_id, t.t - c.h + least(c.h, coalesce(f.n, 0)), digest, chars FROM t JOIN c ON t.conv_id = c.conv_id LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % 100 WHERE t.t >= c.h),
p AS (SELECT conv_id, pos + 1 AS depth, chars, list(digest) OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM c),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY k, depth),
e AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k),
u AS (SELECT k[:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(u.n_children, 0) AS n_children FROM n LEFT JOIN u ON n.k = u.k),
s AS (SELECT p.k, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.k)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM m JOIN s ON m.k = s.k LEFT JOIN n q ON m.depth > 0 AND q.k = m.k[:m.depth - 1] LEFT JOIN e ON e.k = m.k
"""
