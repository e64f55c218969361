"""Streaming prepare path equals the batch one; model loader skips missing."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.bpe import BpeModel
from tessera.plans.corpus import prepare_lines
from tessera.sources.models import load_tokenizers
from tessera.streaming.cleaning import start_prepare


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    os.makedirs(f"{d}/raw/north side")
    lines = ["12. Cafe\u0301 by the river", "  ", "7.", "Two  wide rivers", "ab"]
    with open(f"{d}/raw/north side/a.txt", "w") as f:
        f.write("\n".join(lines) + "\n")
    q = start_prepare(spark, f"{d}/raw", f"{d}/out", f"{d}/ckpt")
    q.awaitTermination(120)
    got = sorted(r["text"] for r in spark.read.parquet(f"{d}/out").collect())
    batch = spark.createDataFrame([(0, "north side", i, s) for i, s in enumerate(lines)],
                                  "doc_id long, lang string, line_no long, line string")
    exp = sorted(r["text"] for r in prepare_lines(batch).collect())
    assert got == exp == ["<north side> Caf\u00e9 by the river", "<north side> Two wide rivers"]


def test_loader_skips_missing(spark):
    d = tempfile.mkdtemp(prefix="tessera-models-")
    m = BpeModel(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "b", "ab"], [("a", "b")])
    m.save(spark, f"{d}/bpe")
    with pytest.warns(UserWarning):
        toks = load_tokenizers(spark, {"mine": f"{d}/bpe", "other": f"{d}/missing"})
    assert list(toks) == ["mine"]
    r = spark.createDataFrame([("abab ba",)], "t string").select(toks["mine"].encode_text(F.col("t"))).first()[0]
    assert list(r) == ["[CLS]", "ab", "ab", "b", "a", "[SEP]"]
