"""DuckDB SQL for the operators that SQL can express."""

# Fixed: the rules of op1 as SQL values (verdict, host, path).
_URL = """
WITH rules(v, h, p) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'),
                               ('block','net','/es/'), ('block','net','/fr/')),
u AS (SELECT page_id,
             coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
hit AS (SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.v,
               row_number() OVER (PARTITION BY u.page_id, u.host, u.path
                                  ORDER BY length(r.h) DESC, length(r.p) DESC) AS k
        FROM u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, hit.rule, coalesce(hit.v, 'allow') AS verdict
FROM u LEFT JOIN hit ON hit.page_id = u.page_id AND hit.host = u.host AND hit.path = u.path AND hit.k = 1
"""

# Words covered by windows of n words that occur twice or more in one text are
# those of repeated substrings of n or more words; a repeat of over 100 words
# is a window of 101 words found twice.
_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
p AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM t),
h AS MATERIALIZED (SELECT r, n, i, x FROM (
  SELECT r, 3 AS n, i, string_agg(a, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS x,
         lead(i, 2) OVER (PARTITION BY r ORDER BY i) AS last FROM p
  UNION ALL
  SELECT r, 10, i, string_agg(a, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING),
         lead(i, 9) OVER (PARTITION BY r ORDER BY i) FROM p) WHERE last IS NOT NULL),
m AS (SELECT r, n, x FROM h GROUP BY r, n, x HAVING count(*) > 1),
k AS (SELECT h.r, h.n, h.i, 2 AS c FROM h JOIN m ON m.r = h.r AND m.n = h.n AND m.x = h.x),
c AS (SELECT r, n, count(DISTINCT p) AS covered
      FROM (SELECT r, n, unnest(range(i, i + n)) AS p FROM k WHERE c > 1) GROUP BY r, n),
l AS (SELECT r, unnest(range(0, len(w) - 100)) AS i, w FROM t JOIN c USING (r) WHERE c.n = 10 AND c.covered > 100),
long AS (SELECT DISTINCT r FROM (SELECT r, array_to_string(list_slice(w, i + 1, i + 101), ' ') AS x FROM l)
         GROUP BY r, x HAVING count(*) > 1),
b AS (SELECT t.r, t.doc_id, len(w) AS n_words,
             length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(three.covered, 0) AS n_repeat_words, coalesce(ten.covered, 0) AS n_covered_words,
             t.r IN (SELECT r FROM long) AS long_repeat
      FROM t LEFT JOIN c three ON three.r = t.r AND three.n = 3 LEFT JOIN c ten ON ten.r = t.r AND ten.n = 10),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 2 * n_covered_words <= n_words AND NOT long_repeat AS kept,
       n_covered_words::BIGINT AS n_covered_words
FROM f
"""

_SPANS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text,
                  regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+') AS parts FROM documents),
s AS (SELECT r, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM d),
w AS (SELECT *, regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+') AS words FROM s),
c AS (SELECT *, sum(len(words)) OVER (PARTITION BY r ORDER BY i) AS upto FROM w),
runs AS (SELECT a.r, a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON b.r = a.r AND b.i > a.i
             AND b.upto - a.upto + len(a.words) >= 20 GROUP BY ALL
         UNION
         SELECT b.r, b.doc_id, max(a.i), b.i FROM c a JOIN c b ON b.r = a.r AND b.i > a.i
             AND b.upto - a.upto + len(a.words) >= 20 GROUP BY ALL),
plain AS (SELECT x.r, x.doc_id, x.i, x.j, string_agg(array_to_string(w.words, ' '), ' ' ORDER BY w.i)
                 FILTER (len(w.words) > 0) AS body
          FROM runs x JOIN w ON w.r = x.r AND w.i BETWEEN x.i AND x.j GROUP BY ALL),
placed AS (SELECT *, rank() OVER (PARTITION BY body ORDER BY doc_id, i, j) AS k FROM plain),
gone AS (SELECT DISTINCT r, unnest(range(i, j + 1)) AS i FROM placed WHERE k > 1),
kept AS (SELECT s.r, string_agg(s.part, '' ORDER BY s.i) FILTER (gone.i IS NULL) AS text, count(*) AS n_sentences,
                count(gone.i) AS n_removed
         FROM s LEFT JOIN gone ON gone.r = s.r AND gone.i = s.i GROUP BY s.r)
SELECT d.doc_id, coalesce(kept.n_sentences, 0)::BIGINT AS n_sentences, coalesce(kept.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept ON kept.r = d.r
"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS count,
            1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p,
            1 + (1000000000::HUGEINT * (kept.n + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE count > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= 50
"""

_FILTERS = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'),
              'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS fails
      FROM w LEFT JOIN l USING (doc_id)),
cell AS (SELECT part, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) ||
                (CASE WHEN fails.C THEN 'C' ELSE '' END) || (CASE WHEN fails.D THEN 'D' ELSE '' END) ||
                (CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed,
                count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM f a, f b, f c, f e, f g
      WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS (SELECT *, filter_order[step] AS x, regexp_matches(failed, '[' || filter_order[1:step - 1] || '-]') AS gone,
             contains(failed, filter_order[step]) AS fails FROM cell, o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, x, sum(n) FILTER (NOT gone AND NOT fails) AS kept,
             sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
             sum(n) FILTER (failed = x) AS unique_fails, sum(good) FILTER (NOT gone AND fails) AS good_lost,
             sum(toxic) FILTER (NOT gone AND fails) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM r
"""

_SUFFIXES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(b[i + 1:i + 200]) AS h
                   FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
m AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g
      FROM (SELECT r, i, (coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true))::INT AS new FROM c)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM m GROUP BY r, g),
cut AS (SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS start FROM
        (SELECT r, a, z FROM s UNION ALL SELECT r, octet_length(b), NULL FROM d)),
k AS (SELECT d.r, string_agg(hex(d.b[cut.start + 1:cut.a]), '' ORDER BY cut.a) AS kept
      FROM d JOIN cut ON cut.r = d.r WHERE cut.a > cut.start GROUP BY d.r),
n AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(n.n_removed, 0)::BIGINT AS n_removed,
       coalesce(n.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN n ON n.r = d.r
"""

ORACLE: dict[str, str] = {"op1_url_filter": _URL, "op2_quality_rules": _QUALITY, "op10_sentence_spans": _SPANS,
                          "op11_source_divergence": _DIVERGENCE, "op12_filter_audit": _FILTERS,
                          "op13_suffix_dedup": _SUFFIXES}
