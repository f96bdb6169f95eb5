"""SQL twins of the registered queries, where SQL can express them."""

from __future__ import annotations

from noticegrade.llm.licence_rules import LONGEST
from noticegrade.llm.licences import rule_rows

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
o AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM d),
b AS (SELECT doc_id, pos, line, length(line) AS n, doc_id::hugeint * 100000000 + pos AS ord FROM o WHERE length(line) >= 1),
f AS (SELECT line, n, min(ord) AS ord FROM b GROUP BY line, n),
h AS (SELECT line, n, ord, s, side, CASE WHEN side = 0 THEN substr(line, 1, s // 2) ELSE right(line, s - s // 2) END AS part
      FROM (SELECT *, unnest([n, n - 1]) AS s FROM f), (SELECT unnest([0, 1]) AS side)),
c AS (SELECT DISTINCT x.line AS a, y.line AS b, x.ord, x.n AS na, y.n AS nb FROM h x JOIN h y USING (s, side, part)
      WHERE y.ord < x.ord AND abs(x.n - y.n) <= 1),
e AS (SELECT DISTINCT ord FROM c WHERE CASE
        WHEN na = nb THEN len(list_filter(range(1, na + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) <= 1
        WHEN na > nb THEN len(list_filter(range(0, na), lambda i: substr(a, 1, i) || substr(a, i + 2) = b)) > 0
        ELSE len(list_filter(range(0, nb), lambda i: substr(b, 1, i) || substr(b, i + 2) = a)) > 0 END),
k AS (SELECT b.doc_id, b.pos, CASE WHEN b.ord > f.ord THEN 'exact' WHEN e.ord IS NOT NULL THEN 'near' END AS why
      FROM b JOIN f USING (line) LEFT JOIN e ON e.ord = b.ord),
j AS (SELECT o.doc_id, string_agg(line, chr(10) ORDER BY o.pos) FILTER (WHERE why IS NULL) AS text, count(*) AS n_lines,
        count(*) FILTER (WHERE why = 'exact') AS n_exact, count(*) FILTER (WHERE why = 'near') AS n_near
      FROM o LEFT JOIN k ON k.doc_id = o.doc_id AND k.pos = o.pos GROUP BY o.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text, coalesce(n_lines, 0)::bigint AS n_lines,
  coalesce(n_exact, 0)::bigint AS n_exact, coalesce(n_near, 0)::bigint AS n_near
FROM d LEFT JOIN j USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN win ON win.n = dw.n AND win.k = array_to_string(w[p:p + dw.n - 1], ' ')),
places AS (SELECT DISTINCT doc_id, p, n FROM hits),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM places) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_DIGITS = " || ".join(f"to_base(('0x' || substr(s, {1 + 5 * k}, 5))::bigint, 32, 4)" for k in range(8))

OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
w AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(h)::bigint AS payload_bytes,
  translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN w USING (h)
"""

_RULES = ", ".join(f"('{label}', {priority}, {rank}, '{key}', '{pattern}', {sure}::double)" for label, priority, rank, key, pattern, sure in rule_rows())

OP10 = f"""
WITH r AS (SELECT * FROM (VALUES {_RULES}) AS t(label, priority, rank, keyword, pattern, sure)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(len(w))) AS start FROM d),
f AS (SELECT doc_id, start, w[start + 1] AS keyword, array_to_string(w[start + 1:start + {LONGEST}], ' ') || ' ' AS rest FROM k
      WHERE w[start + 1] IN (SELECT keyword FROM r)),
m AS (SELECT doc_id, start, label, priority, rank, sure, regexp_extract(rest, '^(?:' || pattern || ') ') AS hit FROM f JOIN r USING (keyword)),
i AS (SELECT doc_id, start, start + len(hit) - len(replace(hit, ' ', '')) AS stop, label, priority, rank, sure FROM m WHERE hit <> ''),
kept AS (SELECT * FROM i WHERE priority = 0 OR NOT EXISTS (SELECT 1 FROM i AS o
         WHERE o.doc_id = i.doc_id AND o.priority BETWEEN 1 AND i.priority AND o.start <= i.start AND o.stop >= i.stop
           AND (o.start < i.start OR o.stop > i.stop OR o.priority < i.priority OR o.rank < i.rank))),
g AS (SELECT doc_id, count(*) FILTER (WHERE priority = 0) AS n_base, min(start) FILTER (WHERE priority = 0) AS first_word,
        max(start) FILTER (WHERE priority = 0) AS last_word, list_sort(list_distinct(list(label) FILTER (WHERE priority = 0))) AS b,
        list_sort(list_distinct(list(label))) AS l, max(sure) AS score FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
  coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0)::double AS score
FROM d LEFT JOIN g USING (doc_id)
"""

SQL: dict[str, str] = {
    "op2_line_dedup": OP2,
    "op8_decontaminate": OP8,
    "op9_warc": OP9,
    "op10_licences": OP10,
}
