"""Tokenizer metrics (A1-A8) as one aggregate plan for all tokenizers.

Every metric is a ratio of sums.  The plan never re-encodes a line per
metric (the reference encodes each text eight times per tokenizer) and its
shape does not grow with the number of tokenizers:

1. one pass over the lines counts everything that the report needs of them
   (:func:`count_lines`): pre-tokens ``(language, has_words, pretoken) -> n`` for each
   way of splitting a text, words, and the line-level sums, as rows of one
   aggregate (partial sums map-side, so a hot word like ``the`` is summed before
   the shuffle); tokenizers that split texts alike share them;
2. each *distinct* pre-token is encoded once per tokenizer, after it has been
   spread, and written (``tokenizer, pretoken, n_pieces, n_unk, lens``); that
   small table is joined back to the counts on ``pretoken`` -- both sides are
   unique per key and tokenizer, so the join cannot skew on frequent words;
3. ``GROUPING SETS ((tokenizer), (tokenizer, language))`` gives the overall
   ``all`` rows and the per-language rows in one aggregate; rows are told
   apart by ``grouping_id()``, not by NULL, so a NULL or empty language never
   merges with the total.

Token-length median / p95 are exact (``percentile`` with a frequency column
over the length histogram -- linear interpolation as NumPy).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.tokenizers import CLS, SEP, Tokenizer
from tessera.session import discard, materialize

REPORT_COLUMNS = ["language", "tokenizer", "num_examples", "fertility",
                  "char_per_token", "unk_rate", "vocab_coverage",
                  "mean_token_chars", "median_token_chars", "p95_token_chars"]


def _clean_len(token: str) -> int:
    """Length of a special token after marker removal (fixed strings)."""
    s = token
    for m in tx.SUBWORD_MARKERS:
        s = s.replace(m, "")
    return len(s.strip())


def _by_tokenizer_and_language(df: DataFrame, *aggs) -> DataFrame:
    """Aggregate over (tokenizer) and (tokenizer, language); gid 1 = all."""
    return (df.groupingSets([["tokenizer"], ["tokenizer", "language"]], "tokenizer", "language")
            .agg(F.grouping_id().alias("gid"), *aggs)
            .withColumn("gid", F.col("gid").cast("int")))


def line_features(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """``language, clean, _text, n_words, n_chars`` per line (tag-aware)."""
    t = F.col(text_col)
    return (lines.select(tx.language_tag(t).alias("language"),
                         F.explode(F.array(tx.strip_language_tag(t))).alias("clean"),
                         t.alias("_text"))
            .select("language", "clean", "_text",
                    F.size(tx.simple_words(F.col("clean"))).alias("n_words"),
                    F.length("clean").alias("n_chars")))


def _splitters(tokenizers) -> dict:
    """Tokenizers by how they split a text: ``{key: [tokenizers]}``."""
    out: dict = {}
    for tok in tokenizers:
        out.setdefault((type(tok).pretokens, getattr(tok, "specials", ())), []).append(tok)
    return out


def pretoken_table(features: DataFrame, tokenizers) -> DataFrame:
    """``splitter, language, has_words, pretoken, n`` over all lines; a
    ``splitter`` numbers the ways in which the tokenizers split a text."""
    parts = [features.select(F.lit(i).alias("splitter"), "language", (F.col("n_words") > 0).alias("has_words"),
                             F.explode(group[0].pretokens(F.col("clean"))).alias("pretoken"))
             for i, group in enumerate(_splitters(tokenizers).values())]
    return (reduce(DataFrame.unionByName, parts)
            .groupBy("splitter", "language", "has_words", "pretoken").agg(F.count(F.lit(1)).alias("n")))


#: What the rows of :func:`count_lines` count that are not pre-tokens of a splitter.
WORDS, LINES, LINE_WORDS, LINE_CHARS = -1, -2, -3, -4


def count_lines(features: DataFrame, tokenizers) -> DataFrame:
    """``splitter, language, has_words, pretoken, n`` in one pass over the lines:
    the rows of :func:`pretoken_table`, word types (``splitter`` WORDS) and, without a
    pre-token, lines, their words and their characters."""
    # a line's tokens of every kind and, last, three NULLs for its own numbers make one
    # array: what an element is follows from its place
    tokens = {i: group[0].pretokens(F.col("clean")) for i, group in enumerate(_splitters(tokenizers).values())}
    tokens[WORDS] = tx.simple_words(F.col("_text"))
    arrays = list(tokens.values())
    ends = F.struct(*[reduce(lambda a, b: a + b, [F.size(F.col("a")[f"t{j}"]) for j in range(k + 1)]).alias(f"e{k}")
                      for k in range(len(arrays))])
    split = (features.select("language", "n_words", "n_chars",
                             F.explode(F.array(F.struct(*[a.alias(f"t{k}") for k, a in enumerate(arrays)]))).alias("a"))
             .select("language", "n_words", "n_chars", ends.alias("e"), F.posexplode(F.concat(
                 *[F.col("a")[f"t{k}"] for k in range(len(arrays))], F.array(*[F.lit(None).cast("string")] * 3)))
                 .alias("at", "pretoken")))
    behind = F.col("at") - F.col("e")[f"e{len(arrays) - 1}"]
    splitter = reduce(lambda rest, k: F.when(behind == k, (LINES, LINE_WORDS, LINE_CHARS)[k]).otherwise(rest), (1, 0),
                      F.lit(LINE_CHARS))
    for k, kind in reversed(list(enumerate(tokens))):
        splitter = F.when(F.col("at") < F.col("e")[f"e{k}"], kind).otherwise(splitter)
    n = F.when(behind == 1, F.col("n_words")).when(behind == 2, F.col("n_chars")).otherwise(1)
    return (split.select(splitter.alias("splitter"), "language", (F.col("n_words") > 0).alias("has_words"), "pretoken",
                         n.cast("bigint").alias("n"))
            .groupBy("splitter", "language", "has_words", "pretoken").agg(F.sum("n").alias("n")))


def line_stats(counts: DataFrame) -> DataFrame:
    """Line-level sums per language and overall, from :func:`count_lines`."""
    total = lambda kind: F.sum(F.when(F.col("splitter") == kind, F.col("n")).otherwise(0))
    return (counts.filter(F.col("splitter") <= LINES).rollup("language").agg(
        F.grouping_id().cast("int").alias("gid"), total(LINES).alias("num_examples"), total(LINE_WORDS).alias("words"),
        F.sum(F.when((F.col("splitter") == LINES) & F.col("has_words"), F.col("n")).otherwise(0)).alias("lines_with_words"),
        total(LINE_CHARS).alias("chars")))


def encoded_pretokens(distinct: DataFrame, tokenizers, unk_tokens=tuple(tx.UNK_TOKENS)) -> DataFrame:
    """Per tokenizer and distinct ``(splitter, pretoken)``: pieces, unknowns
    (pieces in ``unk_tokens``), cleaned lengths."""
    parts = []
    for i, group in enumerate(_splitters(tokenizers).values()):
        mine = distinct.filter(F.col("splitter") == i)
        for tok in group:
            # explode of a one-element array: the pieces are evaluated once
            enc = (tok.encode_distinct(mine, "pretoken")
                   .select("splitter", "pretoken", F.explode(F.array("pieces")).alias("pieces")))
            parts.append(enc.select(
                F.lit(tok.name).alias("tokenizer"), "splitter", "pretoken",
                F.size("pieces").cast("bigint").alias("n_pieces"),
                F.size(F.filter("pieces", lambda p: p.isin(list(unk_tokens)))).cast("bigint").alias("n_unk"),
                F.transform(tx.clean_pieces(F.col("pieces")), lambda p: F.length(p)).alias("lens")))
    return reduce(DataFrame.unionByName, parts)


def _spread(df: DataFrame, key: str) -> DataFrame:
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism * 2,
            int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.col(key))


def _specials_of(tokenizers) -> F.Column:
    """Special tokens added per line, by tokenizer name (bounded literal)."""
    expr = F.lit(0)
    for tok in tokenizers:
        if tok.add_special_tokens:
            expr = F.when(F.col("tokenizer") == tok.name, F.lit(2)).otherwise(expr)
    return expr


#: The ``len`` of the rows of :func:`piece_cells` that carry the sums of all pieces.
PIECES = -1


def piece_cells(joined: DataFrame) -> DataFrame:
    """``tokenizer, language, has_words, len, w, pieces, unk``: the length histogram of the
    cleaned pieces and, in the rows of ``len`` PIECES, all pieces and the unknown ones.
    All that the report needs of the pieces, from one pass over the joined pre-tokens."""
    whole = F.col("len") == PIECES
    return (joined.select("tokenizer", "language", "has_words", "n", "n_pieces", "n_unk",
                          F.explode(F.concat("lens", F.array(F.lit(PIECES)))).alias("len"))
            .groupBy("tokenizer", "language", "has_words", "len").agg(
                F.sum("n").alias("w"), F.sum(F.when(whole, F.col("n") * F.col("n_pieces"))).alias("pieces"),
                F.sum(F.when(whole, F.col("n") * F.col("n_unk"))).alias("unk")))


def piece_stats(cells: DataFrame) -> DataFrame:
    return _by_tokenizer_and_language(
        cells.filter(F.col("len") == PIECES),
        F.sum("pieces").alias("pieces_all"),
        F.sum(F.when(F.col("has_words"), F.col("pieces")).otherwise(0)).alias("pieces_words"),
        F.sum("unk").alias("unk"))


def length_stats(cells: DataFrame, counts: DataFrame, tokenizers) -> DataFrame:
    """Mean / median / p95 of cleaned piece lengths (empties dropped); ``counts`` as
    :func:`count_lines` gives them."""
    hist = (cells.filter(F.col("len") != PIECES).select("tokenizer", "language", "len", "w")
            .groupBy("tokenizer", "language", "len").agg(F.sum("w").alias("w")))
    with_specials = [t.name for t in tokenizers if t.add_special_tokens]
    if with_specials:
        special_lens = [L for L in (_clean_len(CLS), _clean_len(SEP)) if L > 0]
        per_lang = counts.filter(F.col("splitter") == LINES).groupBy("language").agg(F.sum("n").alias("lines"))
        extra = [per_lang.select(F.lit(name).alias("tokenizer"), "language",
                                 F.lit(L).alias("len"), F.col("lines").alias("w"))
                 for name in with_specials for L in special_lens]
        hist = (reduce(DataFrame.unionByName, [hist] + extra)
                .groupBy("tokenizer", "language", "len").agg(F.sum("w").alias("w")))
    pct = F.percentile(F.col("len"), F.array(F.lit(0.5), F.lit(0.95)), F.col("w"))
    return _by_tokenizer_and_language(
        hist, (F.sum(F.col("len") * F.col("w")) / F.sum("w")).alias("mean_token_chars"),
        pct.alias("pct"))


def vocab_coverage(features: DataFrame, vocabs: dict) -> DataFrame:
    """Share of distinct, case-sensitive word types that are pieces as is.

    Word types come from the raw line (one tag strip, as the reference);
    ``all`` is over distinct words of every language, not a sum of languages.
    The vocabularies are stacked and joined on the word (a shuffle join;
    AQE turns it into a broadcast when the vocabularies are small).
    """
    return types_coverage(features.select("language", F.explode(tx.simple_words(F.col("_text"))).alias("word"))
                          .distinct(), vocabs)


def types_coverage(types: DataFrame, vocabs: dict) -> DataFrame:
    """:func:`vocab_coverage` of distinct ``language, word`` rows."""
    vocab = reduce(DataFrame.unionByName,
                   [v.select(F.lit(name).alias("tokenizer"), F.col("piece").alias("word"))
                    for name, v in vocabs.items()]).distinct()
    hits = (types.join(vocab, "word").select("tokenizer", "language", "word"))
    # denominators do not depend on the tokenizer; a (tokenizer, language)
    # without any hit is absent here and becomes 0.0 in the report
    per_lang_n = types.groupBy("language").agg(F.count(F.lit(1)).alias("types"))
    all_n = types.select("word").distinct().agg(F.count(F.lit(1)).alias("types"),
                                                F.lit(1).alias("gid"))
    per_lang = (hits.groupBy("tokenizer", "language").agg(F.count(F.lit(1)).alias("hit"))
                .join(per_lang_n, "language")
                .select("tokenizer", F.lit(0).alias("gid"), "language",
                        (F.col("hit") / F.col("types")).alias("vocab_coverage")))
    overall = (hits.select("tokenizer", "word").distinct()
               .groupBy("tokenizer").agg(F.count(F.lit(1)).alias("hit"), F.lit(1).alias("gid"))
               .join(all_n, "gid")
               .select("tokenizer", "gid", F.lit(None).cast("string").alias("language"),
                       (F.col("hit") / F.col("types")).alias("vocab_coverage")))
    return per_lang.unionByName(overall)


def _join(a: DataFrame, b: DataFrame, on_tokenizer: bool = True) -> DataFrame:
    b = b.withColumnRenamed("gid", "_g").withColumnRenamed("language", "_l")
    cond = (F.col("gid") == F.col("_g")) & F.col("language").eqNullSafe(F.col("_l"))
    if on_tokenizer:
        b = b.withColumnRenamed("tokenizer", "_t")
        cond = cond & (F.col("tokenizer") == F.col("_t"))
        return a.join(b, cond, "left").drop("_g", "_l", "_t")
    return a.join(b, cond, "left").drop("_g", "_l")


def tokenizer_report(lines: DataFrame, tokenizers, vocabs: dict,
                     text_col: str = "text", round_to: int | None = 9,
                     unk_tokens=tuple(tx.UNK_TOKENS)) -> DataFrame:
    """A7 + A8: one row per (language, tokenizer); ``all`` rows first, then
    each language in order, tokenizers in the given order.  Pieces in
    ``unk_tokens`` count as unknown."""
    tokenizers = list(tokenizers)
    # counts and encodings are read by several branches of the plan: written
    # once, the lines are read once
    counts = materialize(count_lines(line_features(lines, text_col), tokenizers), "report_counts")
    pt = counts.filter(F.col("splitter") >= 0)
    # distinct pre-tokens are few bytes but CPU-heavy to encode: spread them
    # over all cores instead of letting size-based coalescing pack them
    distinct = materialize(_spread(pt.select("splitter", "pretoken").distinct(), "pretoken"), "report_distinct")
    enc = materialize(encoded_pretokens(distinct, tokenizers, unk_tokens), "report_encodings")
    cells = materialize(piece_cells(pt.join(enc, ["splitter", "pretoken"])), "report_cells")
    ls = line_stats(counts)
    ps = piece_stats(cells)
    lens = length_stats(cells, counts, tokenizers)
    types = materialize(counts.filter(F.col("splitter") == WORDS).select("language", F.col("pretoken").alias("word"))
                        .distinct(), "report_types")
    cov = types_coverage(types, {t.name: vocabs[t.name] for t in tokenizers})
    df = _join(_join(ps, lens), cov)
    df = _join(df, ls, on_tokenizer=False)
    specials = _specials_of(tokenizers)
    pieces_all = F.coalesce(F.col("pieces_all"), F.lit(0))
    pieces_words = F.coalesce(F.col("pieces_words"), F.lit(0))
    tokens_all = pieces_all + specials * F.col("num_examples")
    tokens_words = pieces_words + specials * F.col("lines_with_words")
    has_len = F.col("pct").isNotNull()
    cols = {
        "fertility": tokens_words / F.greatest(F.col("words"), F.lit(1)),
        "char_per_token": F.col("chars") / F.greatest(tokens_all, F.lit(1)),
        "unk_rate": F.coalesce(F.col("unk"), F.lit(0)) / F.greatest(tokens_all, F.lit(1)),
        "vocab_coverage": F.coalesce(F.col("vocab_coverage"), F.lit(0.0)),
        "mean_token_chars": F.when(has_len, F.col("mean_token_chars")).otherwise(0.0),
        "median_token_chars": F.when(has_len, F.col("pct")[0]).otherwise(0.0),
        "p95_token_chars": F.when(has_len, F.col("pct")[1]).otherwise(0.0),
    }
    order = F.lit(None).cast("int")
    for i, tok in enumerate(tokenizers):
        order = F.when(F.col("tokenizer") == tok.name, F.lit(i)).otherwise(order)
    out = [F.when(F.col("gid") == 1, F.lit("all")).otherwise(F.col("language")).alias("language"),
           "tokenizer", F.col("num_examples").cast("bigint").alias("num_examples")]
    for k, v in cols.items():
        v = v.cast("double")
        out.append((F.round(v, round_to) if round_to is not None else v).alias(k))
    report = materialize(df.select(*out, F.col("gid"), order.alias("_tok_order")), "report")
    discard(counts, distinct, enc, cells, types)
    return (report
            .orderBy(F.desc("gid"), F.asc("language"), F.asc("_tok_order"))
            .select(*REPORT_COLUMNS))


def tokenizer_metrics(lines: DataFrame, tok: Tokenizer, vocab: DataFrame,
                      text_col: str = "text", round_to: int | None = 9) -> DataFrame:
    """A7 for a single tokenizer (overall and per language)."""
    return tokenizer_report(lines, [tok], {tok.name: vocab}, text_col, round_to)


def token_counts(lines: DataFrame, tokenizers, text_col: str = "text") -> DataFrame:
    """Frequency of every output piece over the tag-stripped lines,
    ``tokenizer, token, n``."""
    tokenizers = list(tokenizers)
    # explode of a one-element array: the text is stripped once
    clean = lines.select(F.explode(F.array(tx.strip_language_tag(F.col(text_col)))).alias("clean"))
    parts = []
    for group in _splitters(tokenizers).values():
        # each way of splitting is counted and written once; a distinct pre-token carries
        # its count through every tokenizer that splits so, without a join
        pt = _spread(clean.select(F.explode(group[0].pretokens(F.col("clean"))).alias("pretoken"))
                     .groupBy("pretoken").agg(F.count(F.lit(1)).alias("n")), "pretoken")
        pt = materialize(pt, "token_counts")
        parts += [tok.encode_distinct(pt, "pretoken")
                  .select(F.lit(tok.name).alias("tokenizer"), F.explode("pieces").alias("token"), "n") for tok in group]
    counts = reduce(DataFrame.unionByName, parts)
    with_specials = [t.name for t in tokenizers if t.add_special_tokens]
    if with_specials:
        n_lines = lines.agg(F.count(F.lit(1)).alias("n"))
        counts = reduce(DataFrame.unionByName, [counts] + [
            n_lines.select(F.lit(name).alias("tokenizer"), F.lit(s).alias("token"), "n")
            for name in with_specials for s in (CLS, SEP)])
    return (counts.groupBy("tokenizer", "token").agg(F.sum("n").cast("bigint").alias("n")))
