"""Small helpers shared by the operators: staged tables, batches, words."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.session import discard, materialize  # noqa: F401

#: Rows that one Arrow batch may hold; documents are long, so batches are short.
BATCH_ROWS = 512
#: Words (``[^\x20\x09-\x0D]+``) as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows Spark hands to Python at once (texts may be long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stage(df: DataFrame, name: str, partition_by=None) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back."""
    return materialize(df, f"llm-{name}", partition_by)


_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks: the table asked for last, and
    nothing else."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what another operator has left in this Python worker: workers are
    reused, and their tables would add up."""
    _HELD.clear()


def chunks(sizes, most: int):
    """Cut a sequence of sizes into runs of about ``most`` in sum; yields
    ``(start, end)``.  One larger item is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def byte_words(text) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly the six
    characters that :data:`WORD` excludes.  Null has no words."""
    return [] if text is None else utf8(text).split()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_ids(words: list[list[bytes]]):
    """Number the words of several texts: ``(ids, lengths of the texts)``."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    ids = defaultdict(itertools.count().__next__)
    flat = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
    return flat, n
