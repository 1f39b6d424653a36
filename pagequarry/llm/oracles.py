"""SQL for the operators that SQL can express, in another way than the operators work."""

from __future__ import annotations

from pagequarry.llm import licenses, repetition

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS ws FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS ws FROM benchmark),
dg AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM d),
dh AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS g FROM dg),
ig AS (SELECT item_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS p, ws FROM i),
ih AS (SELECT item_id, n, array_to_string(ws[p:p + 4], ' ') AS g, count(*) AS c FROM ig GROUP BY ALL),
size AS (SELECT item_id, n, sum(c) AS total FROM ih GROUP BY ALL),
hit AS (SELECT doc_id, p, item_id, ih.n FROM dh JOIN ih USING (g)),
win AS (
  SELECT DISTINCT doc_id, item_id, hit.n, unnest(range(greatest(1, p - n + 5), least(p, greatest(1, len(ws) - n + 1)) + 1)) AS s
  FROM hit JOIN d USING (doc_id)),
have AS (
  SELECT win.doc_id, win.item_id, win.s, dh.g, count(*) AS c FROM win JOIN dh ON dh.doc_id = win.doc_id AND dh.p >= win.s AND dh.p <= win.s + win.n - 5
  GROUP BY ALL),
mass AS (SELECT doc_id, item_id, s, sum(c) AS total FROM have GROUP BY ALL),
shared AS (SELECT have.doc_id, have.item_id, s, sum(least(have.c, ih.c)) AS k FROM have JOIN ih ON ih.item_id = have.item_id AND ih.g = have.g GROUP BY ALL),
sim AS (
  SELECT doc_id, item_id, s, CAST(k AS DOUBLE) / (mass.total + size.total - k) AS similarity
  FROM shared JOIN mass USING (doc_id, item_id, s) JOIN size USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(s - 1 AS BIGINT) AS first_word, similarity FROM best WHERE r = 1
"""


SEARCH = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (
  SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*) AS total, CAST(sum(len(ts)) AS BIGINT) AS lengths FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t, total),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // lengths)))) AS BIGINT) AS score
  FROM i JOIN f USING (t) JOIN w USING (t), c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""

EXACT_GROUPS = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def repetition_sql(limits: repetition.Limits | None = None) -> str:
    """Counts, shares and verdicts, from n-grams written out as text."""
    limits = limits or repetition.Limits()
    rows = ", ".join(f"({n}, CAST({share} AS DOUBLE))" for n, share in limits.ngrams)
    tops = ", ".join(f"({n}, CAST({share} AS DOUBLE))" for n, share in limits.tops)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d),
base AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(length(w)) AS chars FROM word GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
lines AS (
  SELECT doc_id, l, count(*) AS c, length(l) AS b FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dup AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines, CAST(sum((c - 1) * b) AS DOUBLE) / sum(c * b) AS dup_line_share,
    sum(CASE WHEN c > 1 THEN c * b ELSE 0 END) <= CAST({limits.line_copies} AS DOUBLE) * sum(c * b) AS copies_ok FROM lines GROUP BY doc_id),
lim(n, share) AS (VALUES {rows}),
g AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM d, lim),
gram AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS t FROM g),
twice AS (SELECT doc_id, n, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, t) AS c FROM gram) WHERE c > 1),
cover AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS k FROM twice),
covered AS (SELECT doc_id, n, count(*) AS words, sum(length(w)) AS b FROM cover JOIN word USING (doc_id, k) GROUP BY ALL),
shares AS (
  SELECT doc_id, max(CAST(b AS DOUBLE) / chars / share) AS ngram_excess, bool_and(CAST(b AS DOUBLE) / chars <= share) AS ok,
    max(CASE WHEN n = {repetition.WINDOW} THEN words ELSE 0 END) AS n_repeat_words
  FROM covered JOIN base USING (doc_id) JOIN lim USING (n) GROUP BY doc_id),
top(n, share) AS (VALUES {tops}),
short AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM d, top),
often AS (SELECT doc_id, n, array_to_string(ws[p:p + n - 1], ' ') AS t, list(p) AS ps FROM short GROUP BY ALL HAVING count(*) > 1),
each AS (SELECT doc_id, n, t, unnest(ps) AS p FROM often),
inside AS (SELECT DISTINCT doc_id, n, t, unnest(range(p, p + n)) AS k FROM each),
held AS (SELECT doc_id, n, t, sum(length(w)) AS b FROM inside JOIN word USING (doc_id, k) GROUP BY ALL),
tops AS (SELECT doc_id, bool_and(CAST(b AS DOUBLE) / chars <= share) AS top_ok FROM held JOIN base USING (doc_id) JOIN top USING (n) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(ngram_excess, 0.0) AS ngram_excess, coalesce(dup_line_share, 0.0) AS dup_line_share,
    coalesce(ok, true) AND coalesce(top_ok, true) AND coalesce(copies_ok, true) AND coalesce(dup_line_share, 0.0) <= {limits.lines} AS method_kept
  FROM t LEFT JOIN base USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN shares USING (doc_id) LEFT JOIN tops USING (doc_id)),
f AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND method_kept AS kept FROM f
"""


def license_sql() -> str:
    """Phrases by position; templates by counting the distinct words of every block between two template words."""
    quoted = lambda words: ", ".join(repr(w.decode()) for w in sorted(words))
    rows = []
    for number, (label, text) in enumerate(licenses.all_templates()):
        words, need, length = licenses.needs(text)
        rows.append(f"({number}, '{label}', [{quoted(words)}], {need}, {length})")
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in licenses.PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH t AS (SELECT doc_id, {_LOWER} AS text FROM documents),
d AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS ws FROM t),
template(k, label, words, need, length) AS (VALUES {", ".join(rows)}),
phrase(label, words) AS (VALUES {phrases}),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d),
place AS (SELECT doc_id, label, k - 1 AS k FROM pos JOIN phrase ON ws[k] = words[1] AND ws[k:k + len(words) - 1] = words),
base AS (
  SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM place GROUP BY doc_id),
near AS (SELECT doc_id, ws, template.* FROM d, template WHERE len(list_intersect(list_distinct(ws), words)) >= need),
scope AS (SELECT doc_id, k, label, need, length, len(words) AS size, unnest(range(1, len(ws) + 1)) AS p, ws, words FROM near),
spot AS (SELECT doc_id, k, label, need, length, size, p - 1 AS p, ws[p] AS w FROM scope WHERE list_contains(words, ws[p])),
block AS (
  SELECT b.doc_id, b.k, b.label, CAST(count(DISTINCT a.w) AS DOUBLE) / b.size AS share, min(a.p) AS a, b.p AS b
  FROM spot b JOIN spot a ON a.doc_id = b.doc_id AND a.k = b.k AND a.p <= b.p AND a.p > b.p - b.length
  GROUP BY b.doc_id, b.k, b.label, b.size, b.need, b.p HAVING count(DISTINCT a.w) >= b.need),
found AS (
  SELECT doc_id, label, share, a FROM block x WHERE NOT EXISTS (
    SELECT 1 FROM block y WHERE y.doc_id = x.doc_id AND y.label <> x.label AND y.share > x.share AND x.a <= y.b AND y.a <= x.b)),
both_kinds AS (SELECT doc_id, label, share FROM found UNION ALL SELECT doc_id, label, 1.0 FROM place),
total AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM both_kinds GROUP BY doc_id),
best AS (SELECT doc_id, label, a FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY share DESC, a) = 1),
earliest AS (SELECT doc_id, min(a) AS block_word FROM best GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, block_word
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN total USING (doc_id) LEFT JOIN earliest USING (doc_id)
"""


COMPONENTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k:k + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, edge.y FROM reach JOIN edge ON edge.x = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
