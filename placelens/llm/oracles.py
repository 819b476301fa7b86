"""SQL for the operators that SQL can express."""

from . import quality, url_filter

_DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _like(glob: str) -> str:
    """A glob of the URL filter as a pattern of whole strings."""
    out = glob.replace(".", r"\.").replace("^*", "[^/]@").replace("*", ".*").replace("?", ".").replace("@", "*")
    return f"^{out}$"


_URLS = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
fit AS (SELECT page_id, r.verdict, r.rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC, r.verdict DESC, r.rule) AS n
  FROM p JOIN r ON (host = split_part(r.rule, '/', 1) OR ends_with(host, '.' || split_part(r.rule, '/', 1))) AND starts_with(path, substr(r.rule, instr(r.rule, '/'))))
SELECT p.page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN {" OR ".join(f"regexp_matches('.' || host || path, '{_like(g)}', 's')" for g in url_filter.BLOCKED)} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.n = 1
"""


def _fails() -> str:
    out = []
    for ratio, least, most in quality.THRESHOLDS.values():
        x = ratio if "/" not in ratio else "CAST({} AS DOUBLE) / nullif({}, 0)".format(*ratio.split(" / "))
        out += [f"coalesce({x} {op} {v}, false)" for op, v in (("<", least), (">", most)) if v is not None]
    return " OR ".join(out)


_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
n AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM t) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  CAST(length(x) - length(translate(x, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(length(x) - length(replace(x, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(list_distinct(list_filter(w, lambda y: list_contains({quality.STOP_WORDS}, y)))) AS BIGINT) AS n_stop_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN n USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {_fails()}) AS kept
FROM m
"""

#: Unsigned CRC-32 of an ASCII text, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda k, z: CASE WHEN k & 1 = 1 THEN xor(3988292384::BIGINT, k >> 1) ELSE k >> 1 END)), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes (g, lvl, i, n, h) of the trees over leaves (g, i, n, h)."""
    return f"""{name}(g, lvl, i, n, h) AS (SELECT g, 0, i, n, h FROM {leaves}
  UNION ALL SELECT g, lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 3)"""


_MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_field("source")} AS g, {_leaf("text")} AS h, CASE WHEN {_CRC.format(x="doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS broken FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS r FROM d),
{_tree("t", "p")},
s AS (SELECT t.g, t.h, t.lvl FROM t WHERE n = 1),
q AS (SELECT 0 AS g, s.g AS name, row_number() OVER (ORDER BY o.source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, s.h FROM s JOIN (SELECT DISTINCT g, source FROM p) o ON o.g = s.g),
{_tree("u", "q")},
steps AS (SELECT r, t.lvl AS lvl, string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.i // pow(3, t.lvl)::BIGINT) AS a, string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.i // pow(3, t.lvl)::BIGINT) AS b
  FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.i // 3 = p.i // pow(3, t.lvl + 1)::BIGINT GROUP BY r, t.lvl
  UNION ALL SELECT r, 1000 + u.lvl, string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < q.i // pow(3, u.lvl)::BIGINT), string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > q.i // pow(3, u.lvl)::BIGINT)
  FROM p JOIN q ON q.name = p.g JOIN u ON u.n > 1 AND u.i // 3 = q.i // pow(3, u.lvl + 1)::BIGINT GROUP BY r, u.lvl),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM steps),
proof AS (SELECT r, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY k) AS x FROM k GROUP BY r),
f(r, k, h) AS (SELECT r, 0, coalesce(broken, h) FROM p UNION ALL SELECT f.r, f.k + 1, sha256(coalesce(a, '') || f.h || coalesce(b, '')) FROM f JOIN k ON k.r = f.r AND k.k = f.k + 1)
SELECT p.doc_id, p.h AS leaf, q.h AS subroot, root.h AS root, sha256(coalesce(proof.x, '')) AS proof_sha256, top.h AS folded_root, top.h = root.h AS verified
FROM p JOIN q ON q.name = p.g CROSS JOIN (SELECT h FROM u WHERE n = 1) AS root LEFT JOIN proof ON proof.r = p.r
JOIN (SELECT r, arg_max(h, k) AS h FROM f GROUP BY r) AS top ON top.r = p.r
"""

_TRIE = rf"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {_CRC.format(x="conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, o.i AS d, role, text FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, o.i + 1000000, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
s AS (SELECT c.conv_id, coalesce(x, []) AS s FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY d) AS x FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, d, s[1:d] AS pre, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
node AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(pre[d].text, '[ 	-]+'), lambda y: y <> '')) END AS words FROM p GROUP BY d, pre),
up AS (SELECT *, row_number() OVER () AS id FROM node),
kids AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids ON kids.d = up.d AND kids.pre = up.pre),
subtree AS (SELECT a AS d, pre[1:a] AS pre, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * words) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, CAST(x.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN subtree ON subtree.d = x.d AND subtree.pre = x.pre LEFT JOIN node y ON y.d = x.d - 1 AND y.pre = x.pre[1:x.d - 1]
"""

ORACLES = {"op12_merkle": _MERKLE, "op13_conversation_trie": _TRIE, "op2_decontamination": _DECONTAMINATION, "op7_url_filter": _URLS, "op8_quality": _QUALITY}
