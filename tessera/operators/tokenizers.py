"""Tokenizer protocol and the rule tokenizers that SQL can express.

A tokenizer maps one pre-token to an array of pieces (every tokenizer here
works per pre-token, as the library tokenizers with a whitespace
pre-tokenizer do) and optionally wraps a whole line in ``[CLS] … [SEP]``.

Two ways to apply it:

* ``pieces(pt)`` -- a Column expression (rule tokenizers): runs in codegen.
* ``encode_distinct(df, col)`` -- a DataFrame operator over *distinct*
  pre-tokens (model tokenizers override it with an Arrow UDF and a broadcast
  model).  Metrics encode each distinct pre-token once and join the small
  result back to aggregated counts, never to every occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx

CLS, SEP, UNK = "[CLS]", "[SEP]", "[UNK]"
#: Stretches of text that a task counts at once.
HELD_STRETCHES = 4_000_000


class Tokenizer:
    name: str = "tokenizer"
    add_special_tokens: bool = False

    # -- per pre-token -----------------------------------------------------
    def pieces(self, pt: Column) -> Column:  # pragma: no cover - abstract
        raise NotImplementedError

    def encode_distinct(self, df: DataFrame, col: str = "pretoken") -> DataFrame:
        """Add ``pieces array<string>`` for every row of ``df[col]``."""
        return df.withColumn("pieces", self.pieces(F.col(col)))

    def pretokens(self, text: Column) -> Column:
        """The units that :meth:`pieces` takes, of a whole text."""
        return tx.pretokens(text)

    # -- per line ----------------------------------------------------------
    def wrap(self, tokens: Column) -> Column:
        return tx.template_single(tokens, CLS, SEP) if self.add_special_tokens else tokens

    def encode_text(self, text: Column) -> Column:
        """Token array of a whole text (pre-tokenize, encode, template)."""
        return self.wrap(F.flatten(F.transform(self.pretokens(text), self.pieces)))

    def encode_lines(self, df: DataFrame, text_col: str, out: str = "tokens") -> DataFrame:
        return df.withColumn(out, self.encode_text(F.col(text_col)))

    # -- vocabulary --------------------------------------------------------
    def vocab(self, spark, train_pretokens: DataFrame | None = None) -> DataFrame:
        """``piece`` table: specials plus the pieces emitted on the training
        pre-tokens (rule tokenizers have no stored vocabulary)."""
        specials = spark.createDataFrame([(s,) for s in tx.SPECIAL_TOKENS], "piece string")
        if train_pretokens is None:
            return specials
        emitted = (self.encode_distinct(train_pretokens.select("pretoken").distinct())
                   .select(F.explode("pieces").alias("piece")))
        return emitted.unionByName(specials).distinct()


class PretokTokenizer(Tokenizer):
    """One token per pre-token."""

    def __init__(self, name: str = "pretok", add_special_tokens: bool = False):
        self.name, self.add_special_tokens = name, add_special_tokens

    def pieces(self, pt):
        return F.array(pt)


class Chunk3Tokenizer(Tokenizer):
    """Pre-token cut every ``k`` characters; later pieces prefixed ``##``."""

    def __init__(self, name: str = "chunk3", k: int = 3):
        self.name, self.k = name, k

    def pieces(self, pt):
        parts = F.regexp_extract_all(pt, F.lit("(?s).{1,%d}" % self.k), 0)
        return F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("##"), x)))


class CharsTokenizer(Tokenizer):
    """One token per character; the first of a pre-token prefixed U+2581."""

    def __init__(self, name: str = "chars"):
        self.name = name

    def pieces(self, pt):
        return F.transform(tx.characters(pt),
                           lambda x, i: F.when(i == 0, F.concat(F.lit("▁"), x)).otherwise(x))


class ClosedVocabTokenizer(Tokenizer):
    """Pre-token if in a fixed word list, else ``[UNK]``.

    The list is bounded by construction (``top_k`` words); build it with
    :meth:`from_counts`.
    """

    def __init__(self, words, name: str = "closed_vocab"):
        self.name, self.words = name, list(words)

    @classmethod
    def from_counts(cls, pretoken_counts: DataFrame, top_k: int = 500,
                    name: str = "closed_vocab"):
        """Top ``top_k`` pre-tokens by count (ties by token)."""
        rows = (pretoken_counts.orderBy(F.desc("n"), F.asc("pretoken"))
                .limit(top_k).collect())
        return cls([r["pretoken"] for r in rows], name)

    def pieces(self, pt):
        return F.array(F.when(pt.isin(self.words), pt).otherwise(F.lit(UNK)))

    def vocab(self, spark, train_pretokens=None):
        rows = [(w,) for w in self.words] + [(s,) for s in tx.SPECIAL_TOKENS]
        return spark.createDataFrame(rows, "piece string").distinct()


def _pieces(words: pa.DictionaryArray, encode, kind: pa.DataType, encode_all=None) -> pa.ListArray:
    """``encode(word)`` of each word; ``encode_all`` of many, where it is given and takes them."""
    distinct = words.dictionary.to_pylist()
    found = encode_all(distinct) if encode_all is not None else None
    if found is None:
        found = pa.array([encode(w) for w in distinct], type=pa.list_(kind))
    return found.take(words.indices)


def _line_pieces(lines: pa.ListArray, encode, kind: pa.DataType, encode_all=None) -> pa.ListArray:
    """The pieces ``encode(word)`` of each line's words, one after the other."""
    pieces = _pieces(lines.flatten().dictionary_encode("encode"), encode, kind, encode_all)
    ends = [np.append(0, np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))) for a in (lines, pieces)]
    return pa.ListArray.from_arrays(pa.array(ends[1][ends[0]], pa.int32()), pieces.flatten(),
                                    mask=lines.is_null() if lines.null_count else None)


class ModelTokenizer(Tokenizer):
    """A tokenizer backed by a learned model applied per pre-token in Python.

    ``word_fn(payload, word) -> list[str]`` is a small per-word helper, ``words_fn(payload,
    words)`` one for many words at once, whose pieces are a ``pa.ListArray``; the
    model ``payload`` (bounded by the vocabulary size) is broadcast once.
    Special tokens in the text are tokens of their own; what stands between
    them is NFC-normalised and pre-tokenized, on every path.  Each
    distinct word of an Arrow batch is encoded once.
    """

    def __init__(self, spark, name: str, payload, word_fn, add_special_tokens: bool = True,
                 specials=tuple(tx.SPECIAL_TOKENS), words_fn=None):
        self.name, self.add_special_tokens, self.specials = name, add_special_tokens, tuple(specials)
        bc = spark.sparkContext.broadcast(payload)
        own = frozenset(self.specials)
        self._spark, self._payload, self._word_fn = spark, bc, word_fn

        def encode(word):
            return [word] if word in own else word_fn(bc.value, word)

        def encode_all(words):
            return words_fn(bc.value, words) if words_fn is not None and own.isdisjoint(words) else None

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def _per_word(words: pa.Array) -> pa.Array:
            return _pieces(words.dictionary_encode(), encode, pa.string(), encode_all)

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def _per_line(lines: pa.Array) -> pa.Array:
            return _line_pieces(lines, encode, pa.string(), encode_all)

        self._per_word, self._per_line = _per_word, _per_line

    def pretokens(self, text: Column) -> Column:
        return tx.pretokens_with_specials(tx.nfc(text), self.specials)

    def pieces(self, pt: Column) -> Column:
        return self._per_word(pt)

    def encode_text(self, text: Column) -> Column:
        return self.wrap(self._per_line(self.pretokens(text)))

    def encode_ids(self, text: Column, ids: dict, unk_id: int) -> Column:
        """Ids of a whole text's pieces, in one pass over the line; ``ids`` is the
        piece table (bounded by the vocabulary), other pieces get ``unk_id``."""
        bc, own, per_word = self._payload, frozenset(self.specials), self._word_fn
        table = self._spark.sparkContext.broadcast(ids)

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def _ids(lines: pa.Array) -> pa.Array:
            known = table.value

            def encode(word):
                return [known.get(p, unk_id) for p in ([word] if word in own else per_word(bc.value, word))]

            return _line_pieces(lines, encode, pa.int32())

        return _ids(self.pretokens(text))


class FunctionTokenizer(ModelTokenizer):
    """A plain ``encode_fn(text) -> list[str]`` as a tokenizer.

    The function sees whole texts (nothing is normalised or split for it);
    ``pieces`` calls it on a pre-token.  It must be picklable.
    """

    def __init__(self, spark, encode_fn, name: str = "function", add_special_tokens: bool = False):
        super().__init__(spark, name, None, lambda _, word: list(encode_fn(word)), add_special_tokens, ())

    def pretokens(self, text: Column) -> Column:
        return F.array(text)


def stretch_counts(lines: DataFrame, texts: dict) -> DataFrame:
    """``part, stretch, n``: what stands between blanks in the texts of each part, and how often;
    ``texts`` names the column of a text's part (an int) by the column of the text.

    No word and no pre-token holds a blank and NFC joins nothing across one, so they can
    be looked for in the distinct stretches.  The texts are split and counted as Arrow arrays,
    ``HELD_STRETCHES`` at a time, before the shuffle.
    """
    def run(batches):
        held, rows = {}, 0

        def counted():
            for part, arrays in held.items():
                found = pc.value_counts(pa.chunked_array(arrays))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part, np.int32)), *found.flatten()], ["part", "stretch", "n"])

        for batch in batches:
            for k in range(len(texts)):
                text, parts = batch.column(2 * k), batch.column(2 * k + 1)
                for part in pc.unique(parts).drop_null().to_pylist():
                    held.setdefault(part, []).append(pc.split_pattern(text.filter(pc.equal(parts, part)), " ").flatten())
                    rows += len(held[part][-1])
            if rows >= HELD_STRETCHES:
                yield from counted()
                held, rows = {}, 0
        yield from counted()

    return (lines.select(*[c for text, part in texts.items() for c in (text, F.col(part).cast("int"))])
            .mapInArrow(run, "part int, stretch string, n bigint")
            .groupBy("part", "stretch").agg(F.sum("n").alias("n")))


def pretoken_counts(lines: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``pretoken, n``: pre-token frequencies (partial aggregation map-side); with
    ``count_col``, each text counts so often."""
    n = F.count(F.lit(1)) if count_col is None else F.sum("_n")
    return (lines.select(F.explode(tx.pretokens(F.col(text_col))).alias("pretoken"),
                         (F.lit(1) if count_col is None else F.col(count_col)).alias("_n"))
            .groupBy("pretoken").agg(n.alias("n")))


def rule_tokenizers(train_counts: DataFrame, top_k: int = 500):
    """The five rule tokenizers of the oracle-checked queries."""
    return [PretokTokenizer(), Chunk3Tokenizer(), CharsTokenizer(),
            ClosedVocabTokenizer.from_counts(train_counts, top_k),
            PretokTokenizer("pretok_special", add_special_tokens=True)]
