"""Tokenizer loader.  A saved model folder (``vocab`` / ``merges``
parquet tables, K4) or a ``tokenizer.json`` becomes a tokenizer; a missing one is
skipped with a warning, as the reference skips a missing custom tokenizer."""

from __future__ import annotations

import warnings

from pyspark.sql import SparkSession

from tessera.sources.corpus import _fs_exists


def load_tokenizers(spark: SparkSession, paths: dict, add_special_tokens: bool = True) -> dict:
    """``{name: path}`` -> ``{name: Tokenizer}`` for the folders that exist.

    A path that ends in ``.json`` is a library's tokenizer document, whose own template holds.
    A folder with a ``merges`` table is a BPE model, one with only a scored
    ``vocab`` table is a Unigram model.
    """
    from tessera.operators.bpe import BpeModel, BpeTokenizer
    from tessera.operators.unigram import UnigramModel, UnigramTokenizer
    from tessera.sources.tokenizer_json import read_tokenizer_json
    out = {}
    for name, path in paths.items():
        document = path.endswith(".json")
        if not _fs_exists(spark, path if document else f"{path}/vocab"):
            warnings.warn(f"tokenizer not found: {path}")
            continue
        if document:
            out[name] = read_tokenizer_json(spark, path, name)
        elif _fs_exists(spark, f"{path}/merges"):
            out[name] = BpeTokenizer(BpeModel.load(spark, path), spark, name, add_special_tokens)
        else:
            out[name] = UnigramTokenizer(UnigramModel.load(spark, path), spark, name, add_special_tokens)
    return out
