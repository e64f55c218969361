"""DuckDB oracle SQL for the registered queries (same semantics, brute force).

The oracle deliberately takes the naive route (encode every line, unnest
every token, global ``row_number``) so it checks the Spark plans' shortcuts
(distinct-encode-and-join, bucketed ranks, histogram percentiles).
"""

from __future__ import annotations

from tessera.plans import sqlfrag as s

SEED = 42
#: Gold fixture: prefix, stem, suffix, ending -- one to four segments.
GOLD = "^(un|re|en|be|th)?(.+?)(tion|ing|heit|que)?(ed|er|en|ly|es|s)?$"

BASE = rf"""
doc_lines AS (
  SELECT doc_id, lang, source, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no,
         unnest(parts) AS line
  FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '\r\n|\r|\n') AS parts
        FROM documents)
),
dirty AS (
  SELECT doc_id, lang, line_no,
    CASE (doc_id + line_no) % 10
      WHEN 0 THEN line
      WHEN 1 THEN '12. ' || line
      WHEN 2 THEN '3:16 ' || line
      WHEN 3 THEN chr(160) || '  ' || line || chr(9)
      WHEN 4 THEN replace(line, ' ', chr(8195) || ' ')
      WHEN 5 THEN replace(line, chr(233), 'e' || chr(769))
      WHEN 6 THEN '7.'
      WHEN 7 THEN '2024 - 10'
      WHEN 8 THEN substring(line, 1, 2)
      ELSE ' 5. ' || line END AS line
  FROM doc_lines
),
cleaned AS (
  SELECT doc_id, lang, line_no, {s.clean('line')} AS clean FROM doc_lines
),
prepared AS (
  SELECT doc_id, lang, line_no, '<' || lang || '> ' || clean AS text
  FROM cleaned WHERE {s.good('clean')}
),
hashed AS (
  SELECT *, md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR))) AS shuffle_key
  FROM prepared
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY shuffle_key, doc_id, line_no) - 1 AS r,
         count(*) OVER () AS n
  FROM hashed
),
splits AS (
  SELECT doc_id, lang, line_no, text, shuffle_key, r AS shuffle_rank,
    CASE WHEN r < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train'
         WHEN r < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + CAST(floor(n * 0.1::DOUBLE) AS BIGINT) THEN 'valid'
         ELSE 'test' END AS split
  FROM ranked
),
test_lines AS (SELECT * FROM splits WHERE split = 'test'),
train_lines AS (SELECT * FROM splits WHERE split = 'train'),
fixture_base AS (
  SELECT doc_id, lang, line_no, {s.clean('line')} AS c FROM dirty
),
tagged_fixture AS (
  SELECT doc_id, line_no, lang,
    CASE (doc_id * 3 + line_no) % 6
      WHEN 2 THEN c
      WHEN 3 THEN '<' || lang || ' ' || c
      WHEN 4 THEN '<> ' || c
      WHEN 5 THEN '<' || lang || '><x> ' || c
      ELSE '<' || lang || '> ' || c END AS text
  FROM fixture_base WHERE length(c) > 0
),
train_pt AS (
  SELECT pt AS pretoken, count(*) AS n
  FROM (SELECT unnest({s.pretokens(s.strip_tag('text'))}) AS pt FROM train_lines)
  GROUP BY pt
),
top500 AS (SELECT pretoken FROM train_pt ORDER BY n DESC, pretoken LIMIT 500),
topl AS (SELECT list(pretoken) AS tl FROM top500),
gold AS (
  SELECT word, list_filter([regexp_extract(word, '{GOLD}', 1), regexp_extract(word, '{GOLD}', 2),
                            regexp_extract(word, '{GOLD}', 3), regexp_extract(word, '{GOLD}', 4)], lambda x: x <> '') AS segments
  FROM (SELECT DISTINCT unnest({s.words('text')}) AS word FROM prepared)
)
"""

# Rule tokenizers: (name, order, pieces-of-pretoken SQL, add_special, needs topl)
TOKENIZERS = [
    ("pretok", 0, "[{x}]", False),
    ("chunk3", 1, "list_transform(regexp_extract_all({x}, '(?s).{{1,3}}'), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END)", False),
    ("chars", 2, "list_transform(regexp_extract_all({x}, '(?s).'), lambda c, i: CASE WHEN i = 1 THEN '▁' || c ELSE c END)", False),
    ("closed_vocab", 3, "[CASE WHEN list_contains(tl, {x}) THEN {x} ELSE '[UNK]' END]", False),
    ("pretok_special", 4, "[{x}]", True),
]
SPECIALS_SQL = "['[PAD]','[UNK]','[CLS]','[SEP]','[MASK]']"


def pieces(tok: str, x: str) -> str:
    for name, _, tmpl, _ in TOKENIZERS:
        if name == tok:
            return tmpl.format(x=x)
    raise KeyError(tok)


def encode(tok: str, text: str) -> str:
    """Token list of a text for a rule tokenizer (needs ``tl`` in scope)."""
    body = f"flatten(list_transform({s.pretokens(text)}, lambda p: {pieces(tok, 'p')}))"
    special = dict((n, a) for n, _, _, a in TOKENIZERS)[tok]
    if special:
        body = f"list_concat(['[CLS]'], {body}, ['[SEP]'])"
    return body


def with_base(*ctes: str, select: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return f"WITH {BASE}{extra}\n{select}"


def encoded_cte(src: str, name: str = "enc", cols: str = "doc_id, line_no") -> str:
    """One row per (tokenizer, line): tokens of the tag-stripped text."""
    parts = []
    for tok, order, _, _ in TOKENIZERS:
        parts.append(
            f"SELECT '{tok}' AS tokenizer, {order} AS tok_order, {cols}, language, text, clean, "
            f"n_words, n_chars, {encode(tok, 'clean')} AS tokens FROM {src}_feat, topl")
    feat = (f"{src}_feat AS (SELECT *, len({s.words('clean')}) AS n_words, length(clean) AS n_chars "
            f"FROM (SELECT {cols}, text, {s.lang_tag('text')} AS language, {s.strip_tag('text')} AS clean "
            f"FROM {src}))")
    return feat + f",\n{name} AS (" + "\nUNION ALL\n".join(parts) + ")"


def vocab_cte() -> str:
    parts = []
    for tok, _, _, _ in TOKENIZERS:
        if tok == "closed_vocab":
            parts.append("SELECT 'closed_vocab' AS tokenizer, pretoken AS piece FROM top500")
        else:
            parts.append(f"SELECT '{tok}' AS tokenizer, unnest({pieces(tok, 'pretoken')}) AS piece "
                         f"FROM train_pt, topl")
        parts.append(f"SELECT '{tok}' AS tokenizer, unnest({SPECIALS_SQL}) AS piece")
    return "vocab AS (SELECT DISTINCT tokenizer, piece FROM (" + "\nUNION ALL\n".join(parts) + "))"


def report_sql(src: str, columns=None) -> str:
    """Tokenizer report over the lines of CTE ``src`` (brute force)."""
    ctes = [encoded_cte(src), vocab_cte(),
            """lm AS (
  SELECT tokenizer, tok_order, GROUPING(language) AS gid, language, count(*) AS num_examples,
    CAST(sum(CASE WHEN n_words > 0 THEN len(tokens) ELSE 0 END) AS BIGINT) AS tw,
    CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(n_chars) AS BIGINT) AS chars,
    CAST(sum(len(tokens)) AS BIGINT) AS toks,
    CAST(sum(len(list_filter(tokens, lambda t: t IN ('[UNK]', '<unk>', '<UNK>')))) AS BIGINT) AS unk
  FROM enc GROUP BY GROUPING SETS ((tokenizer, tok_order), (tokenizer, tok_order, language)))""",
            f"""tl AS (
  SELECT tokenizer, language, length(c) AS l
  FROM (SELECT tokenizer, language, {s.clean_marker('t')} AS c
        FROM (SELECT tokenizer, language, unnest(tokens) AS t FROM enc))
  WHERE length(c) > 0)""",
            """ls AS (
  SELECT tokenizer, GROUPING(language) AS gid, language, avg(l) AS mean_l,
         quantile_cont(l, 0.5) AS med, quantile_cont(l, 0.95) AS p95
  FROM tl GROUP BY GROUPING SETS ((tokenizer), (tokenizer, language)))""",
            f"""types AS (SELECT DISTINCT language, unnest({s.words('text')}) AS word FROM {src}_feat)""",
            """hits AS (
  SELECT t.tokenizer, ty.language, ty.word,
         CASE WHEN v.piece IS NULL THEN 0 ELSE 1 END AS hit
  FROM types ty CROSS JOIN (SELECT DISTINCT tokenizer FROM enc) t
  LEFT JOIN vocab v ON v.tokenizer = t.tokenizer AND v.piece = ty.word)""",
            """cov AS (
  SELECT tokenizer, 0 AS gid, language, sum(hit) / count(*) AS cov FROM hits GROUP BY tokenizer, language
  UNION ALL
  SELECT tokenizer, 1 AS gid, NULL AS language, sum(hit) / count(*) AS cov
  FROM (SELECT tokenizer, word, max(hit) AS hit FROM hits GROUP BY tokenizer, word) GROUP BY tokenizer)""",
            f"""report AS (
  SELECT CASE WHEN lm.gid = 1 THEN 'all' ELSE lm.language END AS language, lm.tokenizer,
    CAST(lm.num_examples AS BIGINT) AS num_examples,
    {s.r9('lm.tw / greatest(lm.words, 1)')} AS fertility,
    {s.r9('lm.chars / greatest(lm.toks, 1)')} AS char_per_token,
    {s.r9('lm.unk / greatest(lm.toks, 1)')} AS unk_rate,
    {s.r9('coalesce(cov.cov, 0.0)')} AS vocab_coverage,
    {s.r9('coalesce(ls.mean_l, 0.0)')} AS mean_token_chars,
    {s.r9('coalesce(ls.med, 0.0)')} AS median_token_chars,
    {s.r9('coalesce(ls.p95, 0.0)')} AS p95_token_chars,
    lm.gid, lm.tok_order
  FROM lm
  LEFT JOIN ls ON ls.tokenizer = lm.tokenizer AND ls.gid = lm.gid AND ls.language IS NOT DISTINCT FROM lm.language
  LEFT JOIN cov ON cov.tokenizer = lm.tokenizer AND cov.gid = lm.gid AND cov.language IS NOT DISTINCT FROM lm.language)"""]
    cols = columns or ["language", "tokenizer", "num_examples", "fertility", "char_per_token",
                       "unk_rate", "vocab_coverage", "mean_token_chars", "median_token_chars",
                       "p95_token_chars"]
    return with_base(*ctes, select=f"SELECT {', '.join(cols)} FROM report ORDER BY gid DESC, language, tok_order")


def boundary_sql(drop_specials: bool = True, summary: bool = False, raw_cols: bool = False) -> str:
    clean = s.clean_token if drop_specials else s.clean_marker
    parts = []
    for tok, order, _, _ in TOKENIZERS:
        parts.append(f"SELECT '{tok}' AS tokenizer, word, segments, {encode(tok, 'word')} AS pieces FROM gold, topl")

    def offsets(arr):
        return (f"(CASE WHEN len({arr}) > 1 THEN list_distinct(list_transform(range(1, len({arr})), "
                f"lambda i: list_sum(list_transform({arr}[1:i], lambda x: length(x))))) ELSE [] END)")
    ctes = ["gw AS (" + "\nUNION ALL\n".join(parts) + ")",
            f"""gp AS (SELECT *, list_filter(list_transform(pieces, lambda t: {clean('t')}), lambda t: length(t) > 0) AS cp FROM gw)""",
            f"""go AS (SELECT *, {offsets('segments')} AS g, {offsets('cp')} AS p FROM gp)""",
            """gs AS (SELECT *, len(list_intersect(g, p)) AS tp0,
                 len(list_filter(p, lambda x: NOT list_contains(g, x))) AS fp0,
                 len(list_filter(g, lambda x: NOT list_contains(p, x))) AS fn0,
                 len(g) = 0 AND len(p) = 0 AS both_empty FROM go)""",
            """gr AS (SELECT *, tp0 / greatest(tp0 + fp0, 1) AS p0, tp0 / greatest(tp0 + fn0, 1) AS r0 FROM gs)""",
            f"""words_scored AS (
  SELECT tokenizer, word, array_to_string(segments, '|') AS gold_segments,
    array_to_string(pieces, '|') AS predicted_tokens,
    array_to_string(list_transform(list_sort(g), lambda x: CAST(x AS VARCHAR)), ',') AS gold_boundaries,
    array_to_string(list_transform(list_sort(p), lambda x: CAST(x AS VARCHAR)), ',') AS predicted_boundaries,
    CASE WHEN both_empty THEN 1.0 ELSE p0 END AS precision_raw,
    CASE WHEN both_empty THEN 1.0 ELSE r0 END AS recall_raw,
    CASE WHEN both_empty THEN 1.0 WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f1_raw,
    CAST(CASE WHEN both_empty THEN 0 ELSE tp0 END AS BIGINT) AS true_positive,
    CAST(CASE WHEN both_empty THEN 0 ELSE fp0 END AS BIGINT) AS false_positive,
    CAST(CASE WHEN both_empty THEN 0 ELSE fn0 END AS BIGINT) AS false_negative
  FROM gr)"""]
    if summary:
        sel = f"""SELECT tokenizer, count(word) AS num_words,
  {s.r9('avg(precision_raw)')} AS boundary_precision, {s.r9('avg(recall_raw)')} AS boundary_recall,
  {s.r9('avg(f1_raw)')} AS boundary_f1,
  CAST(sum(true_positive) AS BIGINT) AS total_true_positive,
  CAST(sum(false_positive) AS BIGINT) AS total_false_positive,
  CAST(sum(false_negative) AS BIGINT) AS total_false_negative
FROM words_scored GROUP BY tokenizer ORDER BY tokenizer"""
    elif raw_cols:
        sel = f"""SELECT tokenizer, word, {s.r9('precision_raw')} AS precision, {s.r9('recall_raw')} AS recall,
  {s.r9('f1_raw')} AS f1 FROM words_scored"""
    else:
        sel = f"""SELECT tokenizer, word, gold_segments, predicted_tokens, gold_boundaries, predicted_boundaries,
  {s.r9('precision_raw')} AS precision, {s.r9('recall_raw')} AS recall, {s.r9('f1_raw')} AS f1,
  true_positive, false_positive, false_negative FROM words_scored"""
    return with_base(*ctes, select=sel)
