"""WordPiece encoding against a user-supplied vocabulary table.

Greedy longest-match-first per pre-token (Wu et al. 2016): the first piece
is a plain vocabulary entry, later pieces carry the ``##`` prefix; a word
that cannot be covered, or is longer than ``max_chars`` (the public library's
default), becomes one ``[UNK]``.

A vocabulary of up to ``max_broadcast`` pieces is broadcast and applied by an
Arrow UDF.  A larger one stays a table: the substrings of the distinct
pre-tokens are joined with it, and the longest match at each position is
walked; lines get their pieces by a join with the distinct pre-tokens.  The rows
are written with a number first, so that equal rows stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tokenizers import UNK, ModelTokenizer
from tessera.session import materialize

PREFIX = "##"


def wordpiece_word(word: str, vocab: set, unk: str = UNK, prefix: str = PREFIX,
                   max_chars: int = 100) -> list:
    if len(word) > max_chars:
        return [unk]
    out, start = [], 0
    while start < len(word):
        end, piece = len(word), None
        while start < end:
            sub = word[start:end]
            if start > 0:
                sub = prefix + sub
            if sub in vocab:
                piece = sub
                break
            end -= 1
        if piece is None:
            return [unk]
        out.append(piece)
        start = end
    return out


def _wp(payload, word):
    vocab, unk, prefix, max_chars = payload
    return wordpiece_word(word, vocab, unk, prefix, max_chars)


class WordPieceTokenizer(ModelTokenizer):
    def __init__(self, vocab_df: DataFrame, spark: SparkSession, name: str = "wordpiece",
                 add_special_tokens: bool = False, unk: str = UNK, max_chars: int = 100,
                 max_broadcast: int = 1_000_000, specials=()):
        self._vocab = vocab_df.select("piece").distinct()
        self.unk, self.max_chars = unk, max_chars
        rows = self._vocab.limit(max_broadcast + 1).collect()
        self.joined = len(rows) > max_broadcast
        known = set() if self.joined else {r["piece"] for r in rows}
        super().__init__(spark, name, (known, unk, PREFIX, max_chars), _wp, add_special_tokens, specials)

    def vocab(self, spark, train_pretokens=None):
        return self._vocab

    def encode_distinct(self, df: DataFrame, col: str = "pretoken") -> DataFrame:
        return self._by_join(df, col) if self.joined else super().encode_distinct(df, col)

    def encode_lines(self, df: DataFrame, text_col: str, out: str = "tokens") -> DataFrame:
        if not self.joined:
            return super().encode_lines(df, text_col, out)
        # a written number tells rows apart, whatever they hold and however often they occur
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "wordpiece-rows")
        words = rows.select("_row", F.posexplode(self.pretokens(F.col(text_col))).alias("_at", "_w"))
        pieces = self._by_join(words.select("_w").distinct(), "_w")
        tokens = (words.join(pieces, "_w").groupBy("_row")
                  .agg(F.array_sort(F.collect_list(F.struct("_at", "pieces"))).alias("_p")))
        none = F.array().cast("array<string>")
        found = F.coalesce(F.flatten(F.transform("_p", lambda p: p["pieces"])), none)
        return (rows.join(tokens, "_row", "left")
                .withColumn(out, F.when(F.col(text_col).isNotNull(), self.wrap(found))).select(*df.columns, out))

    def encode_text(self, text: Column) -> Column:
        if self.joined:
            raise ValueError("a vocabulary too large to broadcast has no column form: use encode_lines")
        return super().encode_text(text)

    def _by_join(self, df: DataFrame, col: str) -> DataFrame:
        word = F.col(col)
        starts = df.select(word.alias("_word")).distinct().filter(F.length("_word") <= self.max_chars).select(
            "_word", F.explode(F.sequence(F.lit(1), F.length("_word"))).alias("_i"))
        spans = starts.select("_word", "_i", F.explode(F.sequence(F.lit(1), F.length("_word") - F.col("_i") + 1)).alias("_n"))
        prefix = F.when(F.col("_i") > 1, F.lit(PREFIX)).otherwise(F.lit(""))
        found = (spans.withColumn("piece", F.concat(prefix, F.substring("_word", F.col("_i"), F.col("_n"))))
                 .join(self._vocab, "piece").groupBy("_word", "_i").agg(F.max(F.struct("_n", "piece")).alias("_m"))
                 .groupBy("_word").agg(F.sort_array(F.collect_list(F.struct("_i", "_m._n", "_m.piece"))).alias("_all")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
        walk = F.aggregate("_all", start, lambda acc, m: F.when(m["_i"] == acc["at"], F.struct(
            (acc["at"] + m["_n"]).alias("at"), F.concat(acc["out"], F.array(m["piece"])).alias("out"))).otherwise(acc))
        whole = found.select("_word", walk.alias("_walked")).filter(F.col("_walked.at") == F.length("_word") + 1)
        return (df.join(whole, word == F.col("_word"), "left")
                .withColumn("pieces", F.coalesce("_walked.out", F.array(F.lit(self.unk)))).drop("_word", "_walked"))
