"""Registered queries: name -> Spark plan builder and DuckDB oracle SQL.

Every builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver tables (``documents`` and what Spark derives from it).  Arrays are
rendered as strings and doubles rounded to 9 places so the driver's
value hash compares like with like.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import boundaries as bd
from tessera.operators import metrics as mt
from tessera.operators import split as sp
from tessera.operators import tokenizers as tk
from tessera.operators.leaderboard import leaderboard
from tessera.plans import oracle as o
from tessera.plans import sqlfrag as s
from tessera.plans.corpus import LINE_KEY, Corpus
from tessera.session import materialize, path_exists, save_whole, shared_dir

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _line_sql(fn, src: str = "dirty", col: str = "line") -> str:
    return o.with_base(select=f"SELECT doc_id, line_no, {fn(col)} AS line FROM {src}")


# ---------------------------------------------------------------------------
# Sources (R1-R3)
# ---------------------------------------------------------------------------
@query("corpus_lines", o.with_base(select="SELECT doc_id, lang, source, line_no, line FROM doc_lines"))
def corpus_lines(spark, sf):
    return Corpus.of(spark, sf).doc_lines.select("doc_id", "lang", "source", "line_no", "line")


@query("nonempty_lines", o.with_base(
    select=f"SELECT doc_id, line_no, {s.strip('line')} AS line FROM doc_lines WHERE length({s.strip('line')}) > 0"))
def nonempty_lines(spark, sf):
    c = Corpus.of(spark, sf)
    return (c.doc_lines.select("doc_id", "line_no", tx.ustrip("line").alias("line"))
            .filter(F.length("line") > 0))


def gold_words(c: Corpus) -> DataFrame:
    """Gold segmentations derived from the corpus words (FIXTURES.md §4): every
    distinct word as prefix, stem, suffix and ending, those of them it has."""
    words = c.stretches.filter("stripped").select(F.explode(tx.words(F.col("stretch"))).alias("word")).distinct()
    parts = F.array(*[F.regexp_extract("word", o.GOLD, i) for i in range(1, 5)])
    return words.select("word", F.filter(parts, lambda x: x != "").alias("segments"))


@query("gold_segments", o.with_base(
    select="SELECT word, array_to_string(segments, '|') AS segments, CAST(len(segments) AS BIGINT) AS n_segments FROM gold"))
def gold_segments(spark, sf):
    g = Corpus.of(spark, sf).gold
    return g.select("word", F.array_join("segments", "|").alias("segments"),
                    F.size("segments").cast("bigint").alias("n_segments"))


# ---------------------------------------------------------------------------
# Text functions (F1-F16) on the dirty fixture
# ---------------------------------------------------------------------------
def _dirty_map(fn):
    def run(spark, sf):
        return Corpus.of(spark, sf).dirty.select("doc_id", "line_no", fn(F.col("line")).alias("line"))
    return run


query("nfc_lines", _line_sql(s.nfc))(_dirty_map(tx.nfc))
query("strip_lines", _line_sql(s.strip))(_dirty_map(tx.ustrip))
query("lower_lines", _line_sql(lambda x: f"lower({x})"))(_dirty_map(tx.lowercase))
query("collapse_ws", _line_sql(s.collapse))(_dirty_map(tx.collapse_whitespace))
query("strip_verse", _line_sql(s.verse))(_dirty_map(tx.strip_verse_number))
query("clean_lines", _line_sql(s.clean))(_dirty_map(tx.clean_line))


@query("good_lines", o.with_base(
    select=f"SELECT doc_id, line_no, c AS line FROM fixture_base WHERE {s.good('c')}"))
def good_lines(spark, sf):
    c = Corpus.of(spark, sf).dirty.select("doc_id", "line_no", tx.clean_line(F.col("line")).alias("line"))
    return c.filter(tx.is_good_line(F.col("line")))


@query("tagged_lines", o.with_base(select="SELECT doc_id, line_no, lang, text FROM prepared"))
def tagged_lines(spark, sf):
    return Corpus.of(spark, sf).prepared.select("doc_id", "line_no", "lang", "text")


@query("untag_lines", o.with_base(
    select=f"SELECT doc_id, line_no, {s.strip_tag('text')} AS line FROM tagged_fixture"))
def untag_lines(spark, sf):
    return Corpus.of(spark, sf).tagged_fixture.select(
        "doc_id", "line_no", tx.strip_language_tag(F.col("text")).alias("line"))


@query("tag_language", o.with_base(
    select=f"SELECT doc_id, line_no, {s.lang_tag('text')} AS language FROM tagged_fixture"))
def tag_language(spark, sf):
    return Corpus.of(spark, sf).tagged_fixture.select(
        "doc_id", "line_no", tx.language_tag(F.col("text")).alias("language"))


@query("line_words", o.with_base(
    select=f"SELECT doc_id, line_no, array_to_string({s.words(s.strip_tag('text'))}, ' ') AS words, "
           f"CAST(len({s.words(s.strip_tag('text'))}) AS BIGINT) AS n_words FROM tagged_fixture"))
def line_words(spark, sf):
    w = tx.simple_words(tx.strip_language_tag(F.col("text")))
    return Corpus.of(spark, sf).tagged_fixture.select(
        "doc_id", "line_no", F.array_join(w, " ").alias("words"),
        F.size(w).cast("bigint").alias("n_words"))


@query("pretokens", o.with_base(
    select=f"SELECT doc_id, line_no, array_to_string({s.pretokens(s.strip_tag('text'))}, ' ') AS pretokens, "
           f"CAST(len({s.pretokens(s.strip_tag('text'))}) AS BIGINT) AS n_pretokens FROM prepared"))
def pretokens_q(spark, sf):
    p = tx.pretokens(tx.strip_language_tag(F.col("text")))
    return Corpus.of(spark, sf).prepared.select(
        "doc_id", "line_no", F.array_join(p, " ").alias("pretokens"),
        F.size(p).cast("bigint").alias("n_pretokens"))


_PIECE_TOKS = ["chunk3", "chars", "pretok_special"]


def _clean_pieces_sql(fn) -> str:
    parts = [f"SELECT '{t}' AS tokenizer, unnest({o.encode(t, s.strip_tag('text'))}) AS token FROM prepared, topl"
             for t in _PIECE_TOKS]
    return o.with_base("tokens AS (" + " UNION ALL ".join(parts) + ")",
                       select=f"SELECT tokenizer, token, {fn('token')} AS cleaned, count(*) AS n "
                              f"FROM tokens GROUP BY ALL")


def _clean_pieces_spark(fn):
    def run(spark, sf):
        c = Corpus.of(spark, sf)
        lines = c.prepared.select(tx.strip_language_tag(F.col("text")).alias("t"))
        parts = [lines.select(F.lit(t).alias("tokenizer"),
                             F.explode(c.tokenizer(t).encode_text(F.col("t"))).alias("token"))
                 for t in _PIECE_TOKS]
        toks = reduce(DataFrame.unionByName, parts)
        return (toks.groupBy("tokenizer", "token").agg(F.count(F.lit(1)).alias("n"))
                .select("tokenizer", "token", fn(F.col("token")).alias("cleaned"), "n"))
    return run


query("clean_pieces", _clean_pieces_sql(s.clean_marker))(_clean_pieces_spark(tx.clean_subword_marker))
query("clean_pieces_nospecial", _clean_pieces_sql(s.clean_token))(_clean_pieces_spark(tx.clean_token))


@query("template_single", o.with_base(
    select=f"SELECT doc_id, line_no, array_to_string(list_concat(['[CLS]'], {s.pretokens(s.strip_tag('text'))}, ['[SEP]']), ' ') AS tokens "
           f"FROM prepared"))
def template_single(spark, sf):
    t = Corpus.of(spark, sf).prepared
    return t.select("doc_id", "line_no", F.array_join(
        tx.template_single(tx.pretokens(tx.strip_language_tag(F.col("text")))), " ").alias("tokens"))


@query("template_pair", o.with_base(
    f"pa AS (SELECT doc_id, line_no, {s.pretokens(s.strip_tag('text'))} AS p FROM prepared)",
    select="SELECT a.doc_id, a.line_no, "
           "array_to_string(list_concat(['[CLS]'], a.p, ['[SEP]'], b.p, ['[SEP]']), ' ') AS tokens, "
           "array_to_string(list_concat(list_transform(range(len(a.p) + 2), lambda x: '0'), "
           "list_transform(range(len(b.p) + 1), lambda x: '1')), ' ') AS type_ids "
           "FROM pa a JOIN pa b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1"))
def template_pair(spark, sf):
    pa = Corpus.of(spark, sf).prepared.select(
        "doc_id", "line_no", tx.pretokens(tx.strip_language_tag(F.col("text"))).alias("p"))
    a = pa.alias("a")
    b = pa.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("p").alias("q"))
    j = a.join(b, ["doc_id", "line_no"])
    toks, types = tx.template_pair(F.col("p"), F.col("q"))
    return j.select("doc_id", "line_no", F.array_join(toks, " ").alias("tokens"),
                    F.array_join(F.transform(types, lambda x: x.cast("string")), " ").alias("type_ids"))


# ---------------------------------------------------------------------------
# Languages, shuffle, split
# ---------------------------------------------------------------------------
@query("languages", o.with_base(select=f"SELECT DISTINCT {s.lang_tag('text')} AS language FROM prepared ORDER BY 1"))
def languages(spark, sf):
    p = Corpus.of(spark, sf).prepared
    return p.select(tx.language_tag(F.col("text")).alias("language")).distinct().orderBy("language")


@query("shuffled_lines", o.with_base(
    select="SELECT doc_id, line_no, shuffle_key, CAST(r AS BIGINT) AS shuffle_rank FROM ranked"))
def shuffled_lines(spark, sf):
    p = Corpus.of(spark, sf).prepared
    return sp.shuffled(p, LINE_KEY).select("doc_id", "line_no", "shuffle_key",
                                           F.col("shuffle_rank").cast("bigint"))


@query("split_lines", o.with_base(select="SELECT doc_id, line_no, lang, split FROM splits"))
def split_lines(spark, sf):
    return Corpus.of(spark, sf).splits.select("doc_id", "line_no", "lang", "split")


@query("split_summary", o.with_base(select="SELECT split, count(*) AS n_lines FROM splits GROUP BY split"))
def split_summary(spark, sf):
    return sp.split_summary(Corpus.of(spark, sf).splits)


# ---------------------------------------------------------------------------
# Encoding and metrics
# ---------------------------------------------------------------------------
@query("encoded_lines", o.with_base(
    o.encoded_cte("test_lines"),
    select="SELECT tokenizer, doc_id, line_no, array_to_string(tokens, ' ') AS tokens, "
           "CAST(len(tokens) AS BIGINT) AS n_tokens FROM enc"))
def encoded_lines(spark, sf):
    c = Corpus.of(spark, sf)
    test = c.split("test").select("doc_id", "line_no",
                                  tx.strip_language_tag(F.col("text")).alias("clean"))
    parts = []
    for tok in c.rule_tokenizers:
        e = tok.encode_text(F.col("clean"))
        parts.append(test.select(F.lit(tok.name).alias("tokenizer"), "doc_id", "line_no",
                                 F.array_join(e, " ").alias("tokens"),
                                 F.size(e).cast("bigint").alias("n_tokens")))
    return reduce(DataFrame.unionByName, parts)


def _report(c: Corpus, lines: DataFrame) -> DataFrame:
    return mt.tokenizer_report(lines, c.rule_tokenizers, c.rule_vocabs)


@query("tokenizer_report", o.report_sql("test_lines"))
def tokenizer_report(spark, sf):
    c = Corpus.of(spark, sf)
    return _report(c, c.split("test"))


def _fixture_metric(cols):
    def run(spark, sf):
        c = Corpus.of(spark, sf)
        # one report serves the five metrics
        if "report" not in c.__dict__:
            c.report = materialize(_report(c, c.tagged_fixture), "fixture_report")
        return c.report.select("language", "tokenizer", *cols)
    return run


for _name, _cols in [("fertility", ["fertility"]), ("char_per_token", ["char_per_token"]),
                     ("unk_rate", ["unk_rate"]), ("vocab_coverage", ["vocab_coverage"]),
                     ("token_length_stats", ["mean_token_chars", "median_token_chars", "p95_token_chars"])]:
    query(_name, o.report_sql("tagged_fixture", ["language", "tokenizer"] + _cols))(_fixture_metric(_cols))


@query("token_counts", o.with_base(
    o.encoded_cte("prepared"),
    select="SELECT tokenizer, token, count(*) AS n FROM (SELECT tokenizer, unnest(tokens) AS token FROM enc) GROUP BY ALL"))
def token_counts(spark, sf):
    c = Corpus.of(spark, sf)
    return mt.token_counts(c.prepared, c.rule_tokenizers)


@query("word_types", o.with_base(
    select=f"SELECT {s.lang_tag('text')} AS language, word, count(*) AS n FROM "
           f"(SELECT text, unnest({s.words('text')}) AS word FROM test_lines) GROUP BY ALL"))
def word_types(spark, sf):
    t = Corpus.of(spark, sf).split("test")
    return (t.select(tx.language_tag(F.col("text")).alias("language"),
                     F.explode(tx.simple_words(F.col("text"))).alias("word"))
            .groupBy("language", "word").agg(F.count(F.lit(1)).alias("n")))


@query("leaderboard", o.report_sql("test_lines").replace(
    "SELECT language, tokenizer, num_examples, fertility, char_per_token, unk_rate, vocab_coverage, "
    "mean_token_chars, median_token_chars, p95_token_chars FROM report ORDER BY gid DESC, language, tok_order",
    """SELECT metric, tokenizer, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY value, tokenizer) AS BIGINT) AS position
FROM (UNPIVOT (SELECT tokenizer, fertility, char_per_token, unk_rate, vocab_coverage, mean_token_chars
               FROM report WHERE language = 'all')
      ON fertility, char_per_token, unk_rate, vocab_coverage, mean_token_chars INTO NAME metric VALUE value)"""))
def leaderboard_q(spark, sf):
    return leaderboard(tokenizer_report(spark, sf))


# ---------------------------------------------------------------------------
# Morpheme boundaries
# ---------------------------------------------------------------------------
@query("boundary_offsets", o.with_base(
    select="SELECT word, array_to_string(list_transform(list_sort(CASE WHEN len(segments) > 1 THEN "
           "list_distinct(list_transform(range(1, len(segments)), lambda i: list_sum(list_transform(segments[1:i], lambda x: length(x))))) "
           "ELSE [] END), lambda x: CAST(x AS VARCHAR)), ',') AS gold_boundaries FROM gold"))
def boundary_offsets_q(spark, sf):
    g = Corpus.of(spark, sf).gold
    off = bd.boundary_offsets(F.col("segments"))
    return g.select("word", F.array_join(F.transform(F.array_sort(off), lambda x: x.cast("string")), ",")
                    .alias("gold_boundaries"))


@query("boundary_words", o.boundary_sql())
def boundary_words(spark, sf):
    c = Corpus.of(spark, sf)
    return bd.score_words(c.gold, c.rule_tokenizers)


@query("boundary_words_raw", o.boundary_sql(drop_specials=False, raw_cols=True))
def boundary_words_raw(spark, sf):
    c = Corpus.of(spark, sf)
    return bd.score_words(c.gold, c.rule_tokenizers, drop_specials=False).select(
        "tokenizer", "word", "precision", "recall", "f1")


@query("boundary_summary", o.boundary_sql(summary=True))
def boundary_summary(spark, sf):
    c = Corpus.of(spark, sf)
    return bd.macro_summary(bd.score_words(c.gold, c.rule_tokenizers, round_to=None))


# ---------------------------------------------------------------------------
# Vocabulary learning and encoding
# ---------------------------------------------------------------------------
from tessera.operators import bpe as bp  # noqa: E402

# Sizes of the learned vocabularies (fixed values: the reference's settings).
VOCAB_SIZE = 16000
BPE_MIN_FREQUENCY = 2
_MODELS: dict = {}


def _word_freq(c: Corpus) -> DataFrame:
    return c.word_freq


def _model(spark, sf, kind: str, model_class, train):
    """A model is learned once: it is saved in the shared folder under a digest of
    its word table and settings, so that later applications load it."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _MODELS:
        wf = _word_freq(Corpus.of(spark, sf))
        cells = wf.agg(F.count("*"), F.sum("freq"), F.bit_xor(F.xxhash64("word", "freq")),
                       F.bit_xor(F.xxhash64("freq", "word"))).first()
        path = f"{shared_dir(spark)}/models/{kind}-{hashlib.md5(repr(tuple(cells)).encode()).hexdigest()}"
        if path_exists(spark, path):
            _MODELS[key] = model_class.load(spark, path)
        else:
            _MODELS[key] = model = train(wf)
            save_whole(spark, path, lambda at: model.save(spark, at))
    return _MODELS[key]


def bpe_model(spark, sf, vocab_size: int = VOCAB_SIZE):
    return _model(spark, sf, f"bpe-{vocab_size}-{BPE_MIN_FREQUENCY}", bp.BpeModel, lambda wf: bp.train_bpe(
        wf, vocab_size=vocab_size, min_frequency=BPE_MIN_FREQUENCY))


def _encoded(c: Corpus, tok) -> DataFrame:
    """Tokens of every prepared line, without its tag."""
    enc = tok.encode_lines(c.prepared.select("doc_id", "line_no", tx.strip_language_tag(F.col("text")).alias("t")), "t")
    return enc.select("doc_id", "line_no", F.array_join("tokens", " ").alias("tokens"),
                      F.size("tokens").cast("bigint").alias("n_tokens"))


_WF_SQL = (f"wf AS (SELECT pt AS word, count(*) AS freq FROM "
           f"(SELECT unnest({s.pretokens(s.nfc('text'))}) AS pt FROM train_lines) GROUP BY pt)")


@query("word_frequency", o.with_base(_WF_SQL, select="SELECT word, freq FROM wf"))
def word_frequency(spark, sf):
    return _word_freq(Corpus.of(spark, sf)).select("word", F.col("freq").cast("bigint"))


@query("alphabet", o.with_base(
    _WF_SQL,
    select="SELECT symbol, CAST(4 + row_number() OVER (ORDER BY symbol) AS INTEGER) AS id FROM "
           "(SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS symbol FROM wf)"))
def alphabet_q(spark, sf):
    return bp.alphabet(_word_freq(Corpus.of(spark, sf)))


@query("bpe_pair_counts", o.with_base(
    _WF_SQL,
    "wc AS (SELECT regexp_extract_all(word, '(?s).') AS ch, freq FROM wf)",
    select="SELECT ch[i] AS left, ch[i + 1] AS right, CAST(sum(freq) AS BIGINT) AS n "
           "FROM (SELECT ch, freq, unnest(range(1, len(ch))) AS i FROM wc WHERE len(ch) > 1) GROUP BY ALL"))
def bpe_pair_counts(spark, sf):
    wf = _word_freq(Corpus.of(spark, sf))
    words = wf.select("freq", tx.characters(F.col("word")).alias("symbols"))
    return bp.pair_counts(words).select("left", "right", F.col("n").cast("bigint"))


@query("bpe_merges")
def bpe_merges(spark, sf):
    m = bpe_model(spark, sf)
    return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(m.merges)],
                                 "rank int, left string, right string, merged string")


@query("vocab_table")
def vocab_table(spark, sf):
    return bpe_model(spark, sf).vocab_df(spark)


@query("bpe_encode")
def bpe_encode(spark, sf):
    return _encoded(Corpus.of(spark, sf), bp.BpeTokenizer(bpe_model(spark, sf), spark))


# ---------------------------------------------------------------------------
# WordPiece against a vocabulary table
# ---------------------------------------------------------------------------
from tessera.operators import mlm as ml  # noqa: E402
from tessera.operators.wordpiece import WordPieceTokenizer  # noqa: E402

_WORDPIECE_SQL = o.with_base(
    o.vocab_cte(),
    "wv AS (SELECT piece FROM vocab WHERE tokenizer = 'chunk3')",
    f"""wl AS (SELECT doc_id, line_no, {s.pretokens(s.nfc(s.strip_tag('text')))} AS pts FROM prepared)""",
    "wd AS (SELECT DISTINCT w FROM (SELECT unnest(pts) AS w FROM wl))",
    """wsub AS (SELECT w, i, max(j) AS j FROM (
        SELECT w, i, unnest(range(i + 1, length(w) + 1)) AS j
        FROM (SELECT w, unnest(range(0, length(w))) AS i FROM wd WHERE length(w) <= 100))
      WHERE (CASE WHEN i = 0 THEN '' ELSE '##' END) || substring(w, i + 1, j - i) IN (SELECT piece FROM wv)
      GROUP BY w, i)""",
    """walk(w, pos, out) AS (
        SELECT w, 0, []::VARCHAR[] FROM wd
        UNION ALL
        SELECT walk.w, wsub.j, list_append(walk.out, (CASE WHEN pos = 0 THEN '' ELSE '##' END) || substring(walk.w, pos + 1, wsub.j - pos))
        FROM walk JOIN wsub ON wsub.w = walk.w AND wsub.i = walk.pos)""",
    "we AS (SELECT wd.w, coalesce(any_value(walk.out), ['[UNK]']) AS pieces FROM wd LEFT JOIN walk ON walk.w = wd.w AND walk.pos = length(wd.w) GROUP BY wd.w)",
    """wt AS (SELECT doc_id, line_no, pts, unnest(pts) AS w, generate_subscripts(pts, 1) AS k FROM wl)""",
    """wj AS (SELECT doc_id, line_no, flatten(list(pieces ORDER BY k)) AS tokens FROM wt JOIN we USING (w) GROUP BY doc_id, line_no)""",
    select="""SELECT wl.doc_id, wl.line_no, coalesce(array_to_string(tokens, ' '), '') AS tokens,
      CAST(coalesce(len(tokens), 0) AS BIGINT) AS n_tokens FROM wl LEFT JOIN wj USING (doc_id, line_no)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("wordpiece_encode", _WORDPIECE_SQL)
def wordpiece_encode(spark, sf):
    """WordPiece with the ``##`` vocabulary the chunk3 rule emits on the
    training split (a user-supplied vocabulary table in general)."""
    c = Corpus.of(spark, sf)
    return _encoded(c, WordPieceTokenizer(c.rule_vocabs["chunk3"], spark))


# ---------------------------------------------------------------------------
# Masked-LM data (M1-M3): closed-vocabulary ids of the tagged lines
# ---------------------------------------------------------------------------
MLM_MAX_LENGTH = 128
MLM_BATCH = 64


def _mlm_lines(c: Corpus) -> DataFrame:
    return c.splits.filter(F.col("split").isin("train", "valid")).select("doc_id", "line_no", "split", "text")


def _mlm_examples(c: Corpus) -> DataFrame:
    words = c.tokenizer("closed_vocab").words
    vocab = c.spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "piece string, id int")
    lines = _mlm_lines(c).select("doc_id", "line_no", "split", tx.pretokens(F.col("text")).alias("tokens"))
    ids = ml.ids_by_join(lines, "tokens", vocab, ["doc_id", "line_no", "split"])
    return ml.examples(ids, F.col("ids"), MLM_MAX_LENGTH)


def _ids_str(c):
    return F.array_join(c.cast("array<string>"), " ")


_MLM_SQL = [
    "ids_cte AS (SELECT tok, CAST(4 + rn AS INTEGER) AS id FROM (SELECT pretoken AS tok, "
    "row_number() OVER (ORDER BY n DESC, pretoken) AS rn FROM train_pt) WHERE rn <= 500)",
    f"""mt AS (SELECT doc_id, line_no, split, unnest(pts) AS tok, generate_subscripts(pts, 1) AS pos
        FROM (SELECT doc_id, line_no, split, {s.pretokens('text')} AS pts FROM splits WHERE split IN ('train', 'valid')))""",
    """mi AS (SELECT mt.doc_id, mt.line_no, mt.split, list(coalesce(ids_cte.id, 1) ORDER BY mt.pos) AS ids
        FROM mt LEFT JOIN ids_cte ON ids_cte.tok = mt.tok GROUP BY mt.doc_id, mt.line_no, mt.split)""",
    f"mx AS (SELECT doc_id, line_no, split, list_concat([2], ids[1:{MLM_MAX_LENGTH - 2}], [3]) AS input_ids FROM mi)",
]


def _h01(parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '42', '0', {parts})), 1, 8)) AS BIGINT) / 4294967296.0)"


@query("mlm_examples", o.with_base(
    *_MLM_SQL,
    select="SELECT doc_id, line_no, split, array_to_string(input_ids, ' ') AS input_ids, "
           "array_to_string(list_transform(input_ids, lambda x: 1), ' ') AS attention_mask, "
           "CAST(len(input_ids) AS BIGINT) AS n_ids FROM mx"))
def mlm_examples(spark, sf):
    ex = _mlm_examples(Corpus.of(spark, sf))
    return ex.select("doc_id", "line_no", "split", _ids_str(F.col("input_ids")).alias("input_ids"),
                     _ids_str(F.col("attention_mask")).alias("attention_mask"),
                     F.size("input_ids").cast("bigint").alias("n_ids"))


_K = "CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR), CAST(i - 1 AS VARCHAR)"
_MASK_SQL = (
    "mk AS (SELECT doc_id, line_no, input_ids, list_transform(input_ids, lambda x, i: "
    f"CASE WHEN x IN (0, 2, 3) OR {_h01(_K + ', ' + repr('p'))} >= 0.15 THEN struct_pack(m := x, l := -100) "
    f"WHEN {_h01(_K + ', ' + repr('v'))} < 0.8 THEN struct_pack(m := 4, l := x) "
    f"WHEN {_h01(_K + ', ' + repr('v'))} < 0.9 THEN struct_pack(m := CAST(floor({_h01(_K + ', ' + repr('r'))} * 505) AS INTEGER), l := x) "
    "ELSE struct_pack(m := x, l := x) END) AS ml, split FROM mx)")


@query("mlm_masked", o.with_base(
    *_MLM_SQL, _MASK_SQL,
    select="SELECT doc_id, line_no, split, array_to_string(list_transform(ml, lambda e: e.m), ' ') AS masked_ids, "
           "array_to_string(list_transform(ml, lambda e: e.l), ' ') AS labels, "
           "CAST(len(list_filter(ml, lambda e: e.l <> -100)) AS BIGINT) AS n_masked FROM mk"))
def mlm_masked(spark, sf):
    c = Corpus.of(spark, sf)
    m = ml.mask(_mlm_examples(c), 5 + len(c.tokenizer("closed_vocab").words))
    return m.select("doc_id", "line_no", "split", _ids_str(F.col("masked_ids")).alias("masked_ids"),
                    _ids_str(F.col("labels")).alias("labels"),
                    F.size(F.filter("labels", lambda x: x != ml.IGNORE)).cast("bigint").alias("n_masked"))


def _batches_sql(order: str) -> str:
    return o.with_base(
        *_MLM_SQL, _MASK_SQL,
        f"""mb AS (SELECT *, len(ml) AS n, row_number() OVER (PARTITION BY split ORDER BY {order}
              md5(concat_ws(':', '42', '0', CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR))), doc_id, line_no) - 1 AS r FROM mk)""",
        f"mw AS (SELECT *, max(n) OVER (PARTITION BY split, r // {MLM_BATCH}) - n AS n_pad FROM mb)",
        select=f"""SELECT doc_id, line_no, split, CAST(r // {MLM_BATCH} AS BIGINT) AS batch_id, CAST(r % {MLM_BATCH} AS INTEGER) AS position,
          CAST(n + n_pad AS INTEGER) AS batch_len,
          array_to_string(list_concat(list_transform(ml, lambda e: e.m), list_transform(range(n_pad), lambda x: 0)), ' ') AS padded_ids,
          array_to_string(list_concat(list_transform(ml, lambda e: 1), list_transform(range(n_pad), lambda x: 0)), ' ') AS padded_mask,
          array_to_string(list_concat(list_transform(ml, lambda e: e.l), list_transform(range(n_pad), lambda x: -100)), ' ') AS padded_labels
          FROM mw""")


def _batched(masked: DataFrame, by_length: bool) -> DataFrame:
    masked = materialize(masked.drop("input_ids", "attention_mask"), "mlm_masked")     # batches are of the masked ids
    parts = [ml.batches(masked.filter(F.col("split") == x), MLM_BATCH, by_length=by_length) for x in ("train", "valid")]
    return reduce(DataFrame.unionByName, parts).select(
        "doc_id", "line_no", "split", "batch_id", "position", F.col("batch_len").cast("int"),
        *[_ids_str(F.col(x)).alias(x) for x in ("padded_ids", "padded_mask", "padded_labels")])


def _mlm_batches(spark, sf, by_length: bool) -> DataFrame:
    c = Corpus.of(spark, sf)
    return _batched(ml.mask(_mlm_examples(c), 5 + len(c.tokenizer("closed_vocab").words)), by_length)


@query("mlm_batches", _batches_sql(""))
def mlm_batches(spark, sf):
    return _mlm_batches(spark, sf, by_length=False)


@query("mlm_batches_by_length", _batches_sql("len(ml),"))
def mlm_batches_by_length(spark, sf):
    """Batches of rows of like length, so that little is padded."""
    return _mlm_batches(spark, sf, by_length=True)


def _learned_examples(spark, sf) -> DataFrame:
    """M1 with the ids of the learned BPE vocabulary, straight from the encoder."""
    model = bpe_model(spark, sf)
    tok = bp.BpeTokenizer(model, spark, add_special_tokens=False)
    ids = tok.encode_ids(F.col("text"), model.token_to_id(), model.token_to_id()[model.unk_token])
    lines = _mlm_lines(Corpus.of(spark, sf)).select("doc_id", "line_no", "split", ids.alias("ids"))
    return ml.examples(lines, F.col("ids"), MLM_MAX_LENGTH)


@query("mlm_examples_learned")
def mlm_examples_learned(spark, sf):
    """M1 on learned ids: map-only."""
    return _learned_examples(spark, sf).select(
        "doc_id", "line_no", "split", _ids_str(F.col("input_ids")).alias("input_ids"),
        F.size("input_ids").cast("bigint").alias("n_ids"))


@query("mlm_masked_learned")
def mlm_masked_learned(spark, sf):
    """M2 on learned ids."""
    m = ml.mask(_learned_examples(spark, sf), len(bpe_model(spark, sf).vocab))
    return m.select("doc_id", "line_no", "split", _ids_str(F.col("masked_ids")).alias("masked_ids"),
                    _ids_str(F.col("labels")).alias("labels"),
                    F.size(F.filter("labels", lambda x: x != ml.IGNORE)).cast("bigint").alias("n_masked"))


@query("mlm_batches_learned")
def mlm_batches_learned(spark, sf):
    """M3 on learned ids."""
    return _batched(ml.mask(_learned_examples(spark, sf), len(bpe_model(spark, sf).vocab)), by_length=False)


# ---------------------------------------------------------------------------
# Unigram LM vocabulary (V6-V9)
# ---------------------------------------------------------------------------
from tessera.operators import unigram as ug  # noqa: E402

# The public library's defaults (parameters of the trainer).
UNIGRAM_SEED_SIZE = 1_000_000
UNIGRAM_MAX_PIECE = 16


def unigram_model(spark, sf, vocab_size: int = VOCAB_SIZE):
    return _model(spark, sf, f"unigram-{vocab_size}-{UNIGRAM_SEED_SIZE}-{UNIGRAM_MAX_PIECE}", ug.UnigramModel, lambda wf: ug.train_unigram(
        wf, vocab_size=vocab_size, seed_size=UNIGRAM_SEED_SIZE, max_piece_len=UNIGRAM_MAX_PIECE))


@query("unigram_seed", o.with_base(
    _WF_SQL,
    f"""subs AS (SELECT substring(word, s, l) AS piece, freq * l AS sc, l = 1 AS is_char
        FROM (SELECT word, freq, s, unnest(range(1, least({UNIGRAM_MAX_PIECE}, length(word) - s + 1) + 1)) AS l
              FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS s FROM wf)))""",
    "scored AS (SELECT piece, CAST(sum(sc) AS BIGINT) AS score, bool_or(is_char) AS is_char FROM subs GROUP BY piece)",
    select=f"""SELECT piece, score, is_char FROM scored WHERE is_char
UNION ALL
SELECT piece, score, is_char FROM (SELECT * FROM scored WHERE NOT is_char ORDER BY score DESC, piece LIMIT {UNIGRAM_SEED_SIZE})"""))
def unigram_seed(spark, sf):
    wf = _word_freq(Corpus.of(spark, sf))
    return ug.seed_pieces(wf, UNIGRAM_MAX_PIECE, UNIGRAM_SEED_SIZE).select(
        "piece", F.col("score").cast("bigint"), "is_char")


@query("unigram_em_step")
def unigram_em_step(spark, sf):
    """One EM pass from the seed scores: expected count per piece."""
    wf = _word_freq(Corpus.of(spark, sf))
    # the seed (bounded by its size and the characters) is the model that is sent out
    seed = ug.seed_pieces(wf, UNIGRAM_MAX_PIECE, UNIGRAM_SEED_SIZE).toArrow()
    scores = dict(zip(seed.column("piece").to_pylist(), seed.column("score").to_pylist()))
    total = float(sum(scores.values()))
    expected = ug._counts(wf, {p: math.log(n / total) for p, n in scores.items()}, UNIGRAM_MAX_PIECE, "em")
    return spark.createDataFrame(pd.DataFrame({"piece": list(expected), "expected_count": list(expected.values())}),
                                 "piece string, expected_count double")


@query("unigram_vocab")
def unigram_vocab(spark, sf):
    return unigram_model(spark, sf).vocab_df(spark)


@query("unigram_encode")
def unigram_encode(spark, sf):
    return _encoded(Corpus.of(spark, sf), ug.UnigramTokenizer(unigram_model(spark, sf), spark))


@query("boundary_summary_trained")
def boundary_summary_trained(spark, sf):
    """B6 for the learned tokenizers and WordPiece."""
    c = Corpus.of(spark, sf)
    toks = [bp.BpeTokenizer(bpe_model(spark, sf), spark), ug.UnigramTokenizer(unigram_model(spark, sf), spark),
            WordPieceTokenizer(c.rule_vocabs["chunk3"], spark)]
    return bd.macro_summary(bd.score_words(c.gold, toks, round_to=None))


@query("benchmark_coverage", o.with_base(
    o.vocab_cte(),
    f"bt AS (SELECT DISTINCT unnest({s.words('text')}) AS word FROM benchmark)",
    select="""SELECT t.tokenizer, count(*) AS n_types, count(v.piece) AS n_known
FROM bt CROSS JOIN (SELECT DISTINCT tokenizer FROM vocab) t
LEFT JOIN vocab v ON v.tokenizer = t.tokenizer AND v.piece = bt.word GROUP BY t.tokenizer"""))
def benchmark_coverage(spark, sf):
    """Distinct words of the held-out benchmark texts that are pieces."""
    c = Corpus.of(spark, sf)
    types = c.table("benchmark").select(F.explode(tx.simple_words(F.col("text"))).alias("word")).distinct()
    vocab = reduce(DataFrame.unionByName, [v.select(F.lit(n).alias("tokenizer"), F.col("piece").alias("word")).distinct()
                                           for n, v in c.rule_vocabs.items()])
    known = types.join(vocab, "word").groupBy("tokenizer").agg(F.count("*").alias("n_known"))
    names = spark.createDataFrame([(n,) for n in c.rule_vocabs], "tokenizer string")
    total = types.agg(F.count("*").alias("n_types"))
    return (names.join(known, "tokenizer", "left").join(F.broadcast(total))
            .select("tokenizer", "n_types", F.coalesce("n_known", F.lit(0).cast("bigint")).alias("n_known")))


@query("tokenizer_report_trained")
def tokenizer_report_trained(spark, sf):
    """A8 with the learned tokenizers next to the rule ones: BPE and Unigram
    (templated, as the reference's own tokenizers) and WordPiece against the
    chunk3 vocabulary table."""
    c = Corpus.of(spark, sf)
    bm, um = bpe_model(spark, sf), unigram_model(spark, sf)
    toks = [bp.BpeTokenizer(bm, spark), ug.UnigramTokenizer(um, spark),
            WordPieceTokenizer(c.rule_vocabs["chunk3"], spark)] + list(c.rule_tokenizers)
    vocabs = dict(c.rule_vocabs)
    vocabs.update({t.name: t.vocab(spark) for t in toks[:3]})
    return mt.tokenizer_report(c.split("test"), toks, vocabs)


# ---------------------------------------------------------------------------
# Second corpus: conversations, the speaker role as the group key
# ---------------------------------------------------------------------------
from tessera.plans.corpus import prepare_lines  # noqa: E402

_CONV_SQL = (f"conv_lines AS (SELECT doc_id, line_no, '<' || lang || '> ' || c AS text FROM "
             f"(SELECT conv_id AS doc_id, turn AS line_no, role AS lang, {s.clean('text')} AS c "
             f"FROM conversations) WHERE {s.good('c')})")


@query("conversation_report", o.report_sql("conv_lines").replace(
    "WITH ", "WITH " + _CONV_SQL + ",\n", 1))
def conversation_report(spark, sf):
    """A8 over the conversation turns, grouped by role instead of language,
    with the rule tokenizers (and vocabularies) learned on the documents."""
    c = Corpus.of(spark, sf)
    turns = c.table("conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"),
        F.col("role").alias("lang"), F.col("text").alias("line"))
    return mt.tokenizer_report(prepare_lines(turns), c.rule_tokenizers, c.rule_vocabs)
