"""The same results in DuckDB's SQL, where SQL can express them."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
spots AS (SELECT item_id, size, i AS j, array_to_string(w[i:i + size - 1], ' ') AS s
          FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
windows AS (SELECT DISTINCT item_id, size, s FROM spots),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.size, p.i, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.s = x.s),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id),
starts AS (SELECT p.doc_id, x.item_id, p.size, p.i, p.i - row_number() OVER (PARTITION BY p.doc_id, x.item_id, p.size, p.i - x.j ORDER BY p.i) AS run, p.i - x.j AS diagonal
           FROM places p JOIN spots x ON p.size = x.size AND p.s = x.s),
runs AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, min(i) - 1 AS start, count(*) + size - 1 AS n FROM starts GROUP BY doc_id, item_id, size, diagonal, run),
longest AS (SELECT doc_id, n AS longest, start AS longest_start, item AS longest_item FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start, item) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest, longest_start, longest_item
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

OP6 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
k AS (SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY s) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM k
"""

_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = _PLAIN.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP9 = rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN least USING (s) WHERE doc_id > m)),
words AS (SELECT doc_id, k, w[k] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS s FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_have p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * p.n >= 80 * (a.n + b.n - p.n)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_PLAIN} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS quality, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic,
                  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
                  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
           FROM d LEFT JOIN l USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(quality) AS good, sum(toxic) AS bad FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, step, substr(o, step, 1) AS x, 1 << (ascii(substr(o, step, 1)) - 65) AS own,
                 coalesce(list_sum([1 << (ascii(substr(o, k, 1)) - 65) FOR k IN range(1, step)]), 0)::INTEGER AS before
          FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders)),
told AS (SELECT part, o, step, x, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost
         FROM counts, steps GROUP BY part, o, step, x)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM told
"""

_SHARES = " OR ".join(f"100 * coalesce(c{n}, 0) > 20 * word_chars" for n in (5, 6, 7, 8, 9, 10))

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_PLAIN} AS w FROM documents),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS turn
          FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d))
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
copied AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines WHERE turn > 1 GROUP BY doc_id),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n) WHERE len(w) >= n)),
seen AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, s ORDER BY i) AS turn, count(*) OVER (PARTITION BY doc_id, n, s) AS times FROM places),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS k FROM seen WHERE (n = 3 AND times > 1) OR (n > 3 AND turn > 1)),
sums AS (SELECT doc_id, n, count(*) AS words, sum(length(w[k])) AS chars FROM inside JOIN d USING (doc_id) GROUP BY doc_id, n),
wide AS (SELECT doc_id, max(words) FILTER (n = 3) AS repeated, {", ".join(f"max(chars) FILTER (n = {n}) AS c{n}" for n in (5, 6, 7, 8, 9, 10))} FROM sums GROUP BY doc_id),
full_rows AS (SELECT *, n_words < 50 OR 100 * coalesce(repeated, 0) > 50 * n_words AS base_failed
              FROM base LEFT JOIN copied USING (doc_id) LEFT JOIN wide USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words,
       CAST(coalesce(chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(f"CAST(coalesce(c{n}, 0) AS BIGINT) AS dup_chars_{n}" for n in (5, 6, 7, 8, 9, 10))},
       base_failed, NOT (base_failed OR 100 * coalesce(chars, 0) > 20 * word_chars OR {_SHARES}) AS kept
FROM full_rows
"""

ORACLE: dict[str, str] = {"op2_decontaminate": OP2, "op6_exact_dedup": OP6, "op9_repeats": OP9, "op10_ngram_join": OP10, "op11_filter_audit": OP11, "op12_repetition": OP12}
