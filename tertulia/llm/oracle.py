"""SQL for DuckDB that gives the rows of the queries SQL can express, written from their definition."""

from __future__ import annotations

from tertulia.llm.licenses import BLOCK, NAMING, NOTICES, PHRASES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rows(templates: dict[str, str]) -> str:
    return ", ".join(f"('{label}', {text.split()!r})" for text, label in templates.items())


LICENSES = rf"""
WITH frases(label, f) AS (VALUES {_rows(PHRASES)}),
notices(label, t) AS (SELECT label, list_distinct(t) FROM (VALUES {_rows(NOTICES)}) AS v(label, t)),
words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, label, i - 1 AS word
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words), frases WHERE w[i:i + len(f) - 1] = f),
blocks AS (
  SELECT doc_id, list_distinct(w[{BLOCK // 2} * b + 1:{BLOCK // 2} * b + {BLOCK}]) AS held
  FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {BLOCK // 2 - 1}) // {BLOCK // 2})) AS b FROM words)),
matches AS (
  SELECT doc_id, label, len(list_intersect(held, t)) / len(t) AS part
  FROM blocks, notices WHERE len(list_intersect(held, t)) >= 0.8 * len(t)
  AND list_has_all(held, list_intersect(t, {sorted(NAMING)!r}))),
base AS (
  SELECT doc_id, count(*) AS n, min(word) AS first_word, max(word) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
shown AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM matches) GROUP BY doc_id),
best AS (SELECT doc_id, max(part) AS part FROM matches GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(shown.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0::DOUBLE) END AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN shown USING (doc_id) LEFT JOIN best USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
       doc_id <= coalesce(b, doc_id) AS kept
FROM sets LEFT JOIN lowest USING (doc_id)
"""

CHATS = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
            + length('<turn:></turn>') + 1 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, text, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

# DuckDB has no CRC-32: eight shifts for each byte, the byte joining in before the first.
_BYTES = "list_concat([4294967295], flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split({text}, '')]))"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text that is not empty."""
    step = "xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1))"
    return f"xor(list_reduce({_BYTES.format(text=text)}, lambda crc, x: {step}), 4294967295)"


NEAR_VECTORS = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS vec_id, min(b) AS b FROM reached GROUP BY a),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN lowest USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


# The trees of the sources, then the tree over them, node by node; a leaf's siblings are looked up by its place.
MANIFEST = rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS found
  FROM documents),
placed AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM leaves WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
low AS (
  SELECT coalesce('=' || source, '-') AS tree, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 16, n),
sources AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, n, subroot AS h FROM sources
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 16, n),
tops AS (SELECT tree, subroot, i, (SELECT h FROM high WHERE n = 1) AS root FROM sources),
rows AS (
  SELECT row_number() OVER () AS row, p.doc_id, p.leaf, p.found, coalesce('=' || p.source, '-') AS tree, p.i, t.i AS top, t.subroot, t.root
  FROM placed p JOIN tops t ON t.tree = coalesce('=' || p.source, '-')),
runs AS (
  SELECT tree, level, i, n, h, i // 16 AS run FROM low WHERE n > 1
  UNION ALL SELECT '', 1000 + level, i, n, h, i // 16 FROM high WHERE n > 1),
steps AS (
  SELECT own.tree, own.level, own.i,
         coalesce(string_agg(other.h, '' ORDER BY other.i) FILTER (other.i < own.i), '') AS before,
         coalesce(string_agg(other.h, '' ORDER BY other.i) FILTER (other.i > own.i), '') AS after
  FROM runs own JOIN runs other ON own.tree = other.tree AND own.level = other.level AND own.run = other.run GROUP BY ALL),
proofs AS (
  SELECT row, list(before || '|' || after ORDER BY level) AS steps
  FROM (SELECT row, level, before, after FROM rows JOIN steps s ON s.tree = rows.tree AND s.i = rows.i // CAST(pow(16, s.level) AS BIGINT)
        UNION ALL
        SELECT row, level, before, after FROM rows JOIN steps s ON s.tree = '' AND s.i = rows.top // CAST(pow(16, s.level - 1000) AS BIGINT))
  GROUP BY row),
folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(coalesce(steps, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_concat([found], coalesce(steps, [])),
                     lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM rows LEFT JOIN proofs USING (row))
SELECT *, folded_root = root AS verified FROM folded
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# The cheapest edits for each top after each row; tops: 0 nothing, 1 a system row, 2 a user's, 3 complete pairs.
REPAIR = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS which
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE which WHEN 4 THEN 'user' ELSE role END AS role,
         CASE which WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM given JOIN (VALUES (1), (2)) AS copies(k) ON k = 1 OR which = 3 WHERE which <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         trim(text, {_BLANK}) AS held FROM damaged),
rows AS (
  SELECT *, left(role, 1) AS r, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
         CASE WHEN held = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(held, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
takes(top, next, role) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
inserts AS (
  SELECT top, top AS next, 0 AS cost, '' AS edit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT top FROM takes)
  UNION ALL
  SELECT top, next, 3, 'I', [CASE role WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM takes WHERE role <> 's'),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS top, {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best
  FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, i, top, min(best)
  FROM (
    SELECT w.conv_id, w.i + 1 AS i, s.next AS top,
           {{'cost': w.best.cost + s.cost + 4, 'audit': w.best.audit || s.edit || 'D', 'lines': list_concat(w.best.lines, s.lines)}} AS best
    FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN inserts s ON s.top = w.top
    UNION ALL
    SELECT w.conv_id, w.i + 1, t.next,
           {{'cost': w.best.cost + s.cost + CASE WHEN r.r = t.role THEN 0 ELSE 3 END + CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END,
             'audit': w.best.audit || s.edit || CASE WHEN r.r = t.role THEN 'K' ELSE 'R' END,
             'lines': list_concat(w.best.lines, s.lines, [CASE WHEN r.r = t.role THEN r.role WHEN t.role = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text])}}
    FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN inserts s ON s.top = w.top
    JOIN takes t ON t.top = s.next AND (r.r = t.role OR t.role <> 's')
    WHERE r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY conv_id, i, top),
ends AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.edit, 'lines': list_concat(w.best.lines, s.lines)}}) AS best
  FROM ways w JOIN (SELECT conv_id, max(i) AS n FROM rows GROUP BY conv_id) c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
  JOIN inserts s ON s.top = w.top AND s.next IN (0, 3) GROUP BY w.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLE = {
    "op1_licenses": LICENSES,
    "op6_chat": CHATS,
    "op10_minmax": NEAR_DUPLICATES,
    "op11_pivots": NEAR_VECTORS,
    "op12_merkle": MANIFEST,
    "op13_repair": REPAIR,
}
