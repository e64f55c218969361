"""Byte-pair-encoding vocabulary learning and encoding (V1-V5) on Spark.

Learning runs on the **word-type table** ``(freq, ids)`` -- one row per
distinct pre-token, symbols as numbers -- never on the corpus:

1. weighted adjacent-pair counts of all word types (one aggregate, map-side
   partial sums).  The ``max_pairs`` first of them in the library's order
   ``(count desc, left, right)`` are the driver's candidates; where there are
   more, the last candidate is the *frontier*: a pair that is not held ranks
   after it, and stays there, as merging others only lowers its count.
2. while a merge changes very many word types (those that step 3 would need don't fit), the
   driver *foresees* the next ones, twice as many as came true the last time (within
   ``ahead``): it merges a bounded sample of the most frequent word types (``sample_types``),
   taking the counts of the pairs met so far as they are; what a merge changes in the sample
   is scaled by the pair's count in all words to that in the sample.  One job applies this sequence, in order,
   to every word type and returns the changes of pair counts *step by step* -- for a
   merge at most four rows per symbol of the vocabulary, whatever the corpus.  New pairs too
   rare to be merged are dropped where they arise.  The driver replays the steps with
   these exact counts and commits merges as long as each one is the first of the true
   ranking.  What was foreseen wrongly is taken back.  The first merge of a
   sequence is always right, so a poor sample costs rounds, never results;
3. from the start in small tables, later on in large ones, merges are rare enough that the
   word types they change can be *held* (tried first, and when few came true): all
   those that have one of the first M pairs of the ranking, M as large as ``held_symbols``
   allows, come to the driver.  Merging such a pair changes held word types only, and the
   pairs that arise are in held word types only, so counts stay exact without a job; this
   goes on until a pair that is not held so comes first;
4. with no candidate left before the frontier, step 1 is run again on the
   current words.

A merge whose string exists already (made from other symbols) can raise the
counts of pairs that are not held; it ends its sequence and step 1 follows.

The word types are written to the checkpoint folder with the committed merges
applied every ``checkpoint_every`` rounds of step 2 and before each of step 3 (the table
before is deleted); in between, a job applies the merges committed since then first.

Encoding applies the learned merges by rank to each *distinct* pre-token
(Arrow UDF, model broadcast once), unseen characters become ``[UNK]``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.tokenizers import UNK, ModelTokenizer
from tessera.session import Tables

#: Symbols are code points; merged ones count on from here in the order made.
FIRST_MERGED = 0x110000
#: Pairs the driver holds at most.
MAX_PAIRS = 500_000
#: Word types the driver holds to foresee merges (as arrays, twice), and merges
#: foreseen at once: at least the first number (four times as many at first), at most the second.
SAMPLE_TYPES = 200_000
AHEAD = 50, 4_000
#: Symbols of the word types that the driver holds (about 60 bytes each) or a task works on at once.
HELD_SYMBOLS, TASK_SYMBOLS = 4_000_000, 1_000_000
#: Of the ranking, so many pairs are looked for to hold their word types; fewer than
#: the least number of merges that a round brings are rather foreseen.
HELD_PAIRS, LEAST_HELD = 50_000, 24
#: Symbols of a word up to which encoding needs no heap.
SHORT_WORD = 32


# ---------------------------------------------------------------------------
# V1-V3
# ---------------------------------------------------------------------------
def word_frequency(lines: DataFrame, text_col: str = "text", normalize: bool = True,
                   strip_tags: bool = False, count_col: str | None = None) -> DataFrame:
    """V1: ``word, freq`` over the pre-tokens of the (NFC) training lines.

    Training lines keep their ``<lang>`` tag unless ``strip_tags``.  With ``count_col``,
    each text counts so often.
    """
    t = F.col(text_col)
    if strip_tags:
        t = tx.strip_language_tag(t)
    if normalize:
        t = tx.nfc(t)
    freq = F.count(F.lit(1)) if count_col is None else F.sum("_n")
    return (lines.select(F.explode(tx.pretokens(t)).alias("word"), (F.lit(1) if count_col is None else F.col(count_col)).alias("_n"))
            .groupBy("word").agg(freq.alias("freq")))


def alphabet(word_freq: DataFrame, n_special: int = 5) -> DataFrame:
    """V2: distinct characters by code point; ids follow the special tokens.

    The alphabet is bounded by the character repertoire, not by the data.
    """
    return word_freq.sparkSession.createDataFrame(
        [(s, n_special + i) for i, s in enumerate(_symbols(word_freq))], "symbol string, id int")


def _symbols(word_freq: DataFrame) -> list:
    """The distinct characters in order."""
    chars = word_freq.select(F.explode(tx.characters(F.col("word"))).alias("symbol")).distinct()
    return sorted(r["symbol"] for r in chars.collect())


def pair_counts(words: DataFrame, sym_col: str = "symbols", freq_col: str = "freq") -> DataFrame:
    """V3: weighted adjacent-pair counts ``left, right, n``."""
    s = F.col(sym_col)
    n = F.size(s)
    pairs = F.arrays_zip(F.slice(s, 1, F.greatest(n - 1, F.lit(0))),
                         F.slice(s, 2, F.greatest(n - 1, F.lit(0))))
    return (words.filter(n > 1)
            .select(F.col(freq_col).alias("f"), F.explode(pairs).alias("p"))
            .select(F.col("p").getField("0").alias("left"), F.col("p").getField("1").alias("right"), "f")
            .groupBy("left", "right").agg(F.sum("f").alias("n")))


# ---------------------------------------------------------------------------
# V4  training
# ---------------------------------------------------------------------------
@dataclass
class BpeModel:
    vocab: list                      # token string by id
    merges: list                     # (left string, right string) by rank
    special_tokens: list = field(default_factory=lambda: list(tx.SPECIAL_TOKENS))
    unk_token: str = UNK
    rounds: int = 0

    def token_to_id(self) -> dict:
        return {t: i for i, t in enumerate(self.vocab)}

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, i) for i, t in enumerate(self.vocab)], "piece string, id int")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)],
                                     "rank int, left string, right string")

    def save(self, spark: SparkSession, path: str, mode: str = "overwrite"):
        """K4: ``vocab``, ``merges`` and ``settings`` parquet tables under ``path``."""
        self.vocab_df(spark).coalesce(1).write.mode(mode).parquet(f"{path}/vocab")
        self.merges_df(spark).coalesce(1).write.mode(mode).parquet(f"{path}/merges")
        (spark.createDataFrame([(self.special_tokens, self.unk_token)], "special_tokens array<string>, unk_token string")
         .coalesce(1).write.mode(mode).parquet(f"{path}/settings"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BpeModel":
        """Reload a saved model (bounded by the vocabulary size)."""
        vocab = [r["piece"] for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
        merges = [(r["left"], r["right"])
                  for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        settings = spark.read.parquet(f"{path}/settings").first()
        return cls(vocab, merges, list(settings["special_tokens"]), settings["unk_token"])


def merge_word(ids: list, table: dict, changes=None, freq: int = 1, first: int = 0) -> list:
    """``ids`` after the merges ``{(left, right): (step, symbol)}`` in the order of
    their steps, each from left to right.

    ``changes[step, left, right]`` gains what step ``first`` and those after it
    change of the pair's count, times ``freq``.  A heap of the pairs of neighbours over
    a linked list: little more than linear time in a long word.
    """
    ids, n = list(ids), len(ids)
    heap = [(table[pair][0], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in table]
    if not heap:
        return ids
    heapq.heapify(heap)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    while heap:
        step, i, pair = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
            continue
        new, a, k = table[pair][1], before[i], after[j]
        if changes is not None and step >= first:
            changes[step, *pair] -= freq
            if a >= 0:
                changes[step, ids[a], pair[0]] -= freq
                changes[step, ids[a], new] += freq
            if k < n:
                changes[step, pair[1], ids[k]] -= freq
                changes[step, new, ids[k]] += freq
        ids[i], alive[j], after[i] = new, False, k
        if k < n:
            before[k] = i
        for x, y in ((a, i), (i, k)):
            # a pair that arises after its step was taken stays
            if x >= 0 and y < n and (hit := table.get((ids[x], ids[y]))) and hit[0] > step:
                heapq.heappush(heap, (hit[0], x, (ids[x], ids[y])))
    return [x for x, here in zip(ids, alive) if here]


class _Symbols:
    """Word types as arrays: all symbols in a row, each word closed by an ``_END``,
    linked over those that merges have taken.  A merge costs little more than
    the places where its pair stands."""

    def __init__(self, freq: np.ndarray, flat: np.ndarray, sizes: np.ndarray):
        words = len(sizes)
        self.freq, self.words = freq, words
        self.word = np.repeat(np.arange(words, dtype=np.int32), sizes + 1)
        self.ids = np.full(len(self.word) + 1, _END, np.int32)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(self.word), bool)
        inside[ends] = False
        self.ids[:-1][inside] = flat
        n = len(self.ids)
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        at = np.flatnonzero((self.ids[:-1] >= 0) & (self.ids[1:] >= 0)).astype(np.int32)
        codes = _code(self.ids[at], self.ids[at + 1])
        order = np.argsort(codes, kind="stable")
        self.places = {None: [(codes[order], at[order])]}      # by the symbol that made the pairs: sorted pairs, where they stand

    @classmethod
    def of(cls, batch) -> "_Symbols":
        column = batch.column("ids")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return cls(batch.column("freq").to_numpy(), column.flatten().to_numpy(),
                   np.diff(column.offsets.to_numpy()).astype(np.int64))

    def merge(self, left: int, right: int, new: int):
        """Merge a pair from left to right; ``(pairs, changes)`` of the weighted pair
        counts, each pair once, where there are any."""
        ids, after, before, code = self.ids, self.after, self.before, (left << 32) | right
        found, sources = [], 0
        for symbol in {None, left, right}:
            for codes, at in self.places.get(symbol, ()):
                i, j = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
                if i < j:
                    found.append(at[i:j])
        if not found:
            return None
        p = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        p = p[(ids[p] == left) & (ids[after[p]] == right)]
        if left == right and len(p) > 1:        # of a run of equal symbols, every second pair
            starts = np.ones(len(p), bool)
            starts[1:] = after[p[:-1]] != p[1:]
            k = np.arange(len(p))
            p = p[(k - np.maximum.accumulate(np.where(starts, k, 0))) % 2 == 0]
        if not len(p):
            return None
        q = after[p]
        x, y, f = before[p], after[q], self.freq[self.word[p]]
        joined = np.zeros(len(p), bool)         # right behind the merge before
        joined[1:] = x[1:] == q[:-1]
        follows = np.append(joined[1:], False)
        on_left, on_right = ids[x] >= 0, (ids[y] >= 0) & ~follows
        on_left &= x >= 0
        old_left, old_right = ids[x[on_left]], ids[y[on_right]]
        ids[p], ids[q], after[p], before[y] = new, _TAKEN, y, p
        x = np.where(joined, np.append(-1, p[:-1]), x)[on_left]
        new_left = _code(ids[x], new)
        new_right = _code(np.full(len(old_right), new, np.int32), old_right)
        made = np.concatenate([new_left, new_right])
        if len(made):
            at = np.concatenate([x, p[on_right]]).astype(np.int32)
            order = np.lexsort((at, made))
            self.places.setdefault(new, []).append((made[order], at[order]))
        pairs = np.concatenate([[code], _code(old_left, left), _code(np.full(len(old_right), right, np.int32), old_right), made])
        by = np.concatenate([[-f.sum()], -f[on_left], -f[on_right], f[on_left], f[on_right]])
        pairs, which = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, which, by)
        some = sums != 0
        return pairs[some], sums[some]

    def state(self):
        """What merges change, for :meth:`restore`."""
        return self.ids.copy(), self.after.copy(), self.before.copy(), {symbol: list(p) for symbol, p in self.places.items()}

    def restore(self, state):
        ids, after, before, places = state
        self.ids, self.after, self.before = ids.copy(), after.copy(), before.copy()
        self.places = {symbol: list(p) for symbol, p in places.items()}

    def batch(self):
        """The words as they are now (those of one symbol left out), with their frequencies."""
        here = np.flatnonzero(self.ids[:-1] >= 0)
        sizes = np.bincount(self.word[here], minlength=self.words)
        keep = sizes > 1
        flat = self.ids[here[keep[self.word[here]]]]
        offsets = np.append(0, np.cumsum(sizes[keep])).astype(np.int32)
        return self.freq[keep], flat, offsets


_END, _TAKEN = -1, -2


def _code(left, right):
    return (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)


def _chunks(batches):
    """Arrow batches of word types as :class:`_Symbols` of ``TASK_SYMBOLS`` or so."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 10_000):
            part = batch.slice(start, 10_000)
            held.append(part)
            size += len(part.column("ids").flatten())
            if size >= TASK_SYMBOLS:
                yield _Symbols.of(pa.Table.from_batches(held))
                held, size = [], 0
    if size:
        yield _Symbols.of(pa.Table.from_batches(held))


class _Sample:
    """The most frequent word types on the driver, merged ahead of the others."""

    def __init__(self, symbols: _Symbols):
        self.symbols, self.kept = symbols, symbols.state()
        self.log: list = []                 # merges since the state that is kept

    def merge(self, pair, new) -> dict:
        """Merge one pair; returns the changes of pair counts."""
        self.log.append((*pair, new))
        found = self.symbols.merge(*pair, new)
        if found is None:
            return {}
        codes, by = found
        return dict(zip(zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist()), by.tolist()))

    def keep(self, steps: int):
        """Take all but the first ``steps`` merges since the last call back."""
        if steps < len(self.log):
            self.symbols.restore(self.kept)
            for merge in self.log[:steps]:
                self.symbols.merge(*merge)
        self.kept, self.log = self.symbols.state(), []


class _Ranking:
    """Pair counts in the order ``(count desc, left, right)``: a heap that has an entry
    of at least its count for each pair; one that is too high is put right when it comes
    up, so that only rising counts are pushed."""

    def __init__(self, counts: dict, least: int):
        self.counts, self.least = counts, least
        self.heap = [(-n, *pair) for pair, n in counts.items()]
        heapq.heapify(self.heap)

    def first(self):
        while self.heap:
            high, *pair = entry = self.heap[0]
            n = self.counts.get(entry[1:])
            if n == -high:
                return entry
            if n is None or n > -high:
                heapq.heappop(self.heap)
            else:
                heapq.heapreplace(self.heap, (-n, *pair))
        return None

    def top(self, most: int, frontier):
        """The first pairs in order, up to the frontier: ``(left, right)`` arrays."""
        pairs = np.array(list(self.counts), np.int64).reshape(-1, 2)
        n = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        order = np.lexsort((pairs[:, 1], pairs[:, 0], -n))[:most]
        if frontier is not None:
            order = [k for k in order.tolist() if (-int(n[k]), *pairs[k].tolist()) <= frontier]
        return pairs[order, 0], pairs[order, 1]

    def change(self, pair, by: int):
        self.set(pair, self.counts.get(pair, 0) + by)

    def set(self, pair, n: int):
        if n >= self.least:
            if n > self.counts.get(pair, 0):
                heapq.heappush(self.heap, (-n, *pair))
            self.counts[pair] = n
        else:
            self.counts.pop(pair, None)


def train_bpe(word_freq: DataFrame, vocab_size: int = 16000, min_frequency: int = 2,
              special_tokens=None, max_pairs: int = MAX_PAIRS, checkpoint_every: int = 5,
              partitions: int | None = None, sample_types: int = SAMPLE_TYPES, ahead: tuple = AHEAD,
              held_symbols: int = HELD_SYMBOLS) -> BpeModel:
    """V4: exact BPE merges, foreseen in sequences and verified on all word types, or made on all
    the word types they change (see module doc).  ``partitions`` spreads the word types; by
    default as shuffles do.  ``held_symbols`` of 0: all are foreseen.
    """
    with bounded_plan_strings(word_freq.sparkSession), Tables() as tables:
        return _train_bpe(word_freq, vocab_size, min_frequency, special_tokens, max_pairs, checkpoint_every, partitions,
                          sample_types, ahead, held_symbols, tables)


class bounded_plan_strings:
    """Settings while an iterative job runs: rounds are many and small, so plans
    are not re-planned between stages and their printed form is bounded."""

    SETTINGS = {"spark.sql.maxPlanStringLength": "200000", "spark.sql.adaptive.enabled": "false"}

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
        for k, v in self.SETTINGS.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.old.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def _candidates(words: DataFrame, least: int, max_pairs: int):
    """``({(left, right): n}, frontier)`` of the current words."""
    top = (pair_counts(words, "ids").filter(F.col("n") >= least)
           .orderBy(F.desc("n"), "left", "right").limit(max_pairs).toArrow())
    left, right, n = (top.column(c).to_pylist() for c in ("left", "right", "n"))
    frontier = (-n[-1], left[-1], right[-1]) if len(n) == max_pairs else None
    return dict(zip(zip(left, right), n)), frontier


def _table(merges: list, start: int = 0) -> dict:
    return {(left, right): (start + k, new) for k, (left, right, new) in enumerate(merges)}


def _merged(words: DataFrame, merges: list, top=None) -> DataFrame:
    """The word types after ``merges``; with ``top``, the pairs ``(left, right)`` of a ranking,
    also the place in it of the first one that a word has (``first``)."""
    if not merges and top is None:
        return words
    if top is not None:
        codes = _code(*top)
        order = np.argsort(codes)
        shared = words.sparkSession.sparkContext.broadcast((codes[order], order))

    def run(batches):
        for symbols in _chunks(batches):
            for left, right, new in merges:
                symbols.merge(left, right, new)
            freq, flat, offsets = symbols.batch()
            if not len(freq):
                continue
            columns = [pa.array(freq), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
            if top is not None:
                codes, ranks = shared.value
                none = len(codes)
                mine = _code(flat, np.append(flat[1:], 0))
                at = np.minimum(np.searchsorted(codes, mine), max(none - 1, 0))
                first = np.where(codes[at] == mine, ranks[at], none) if none else np.full(len(mine), none)
                first[offsets[1:] - 1] = none           # a word's last symbol begins no pair
                first = np.minimum.reduceat(first, offsets[:-1])
                columns.append(pa.array(first, pa.int32(), mask=first == none))
            yield pa.RecordBatch.from_arrays(columns, ["freq", "ids", "first"][:len(columns)])

    return words.select("freq", "ids").mapInArrow(run, "freq bigint, ids array<int>" + (", first int" if top is not None else ""))


def _changes(words: DataFrame, pending: list, sequence: list) -> DataFrame:
    """``step, left, right, n``: what each merge of the sequence, made after the
    pending ones, changes of the pair counts."""
    def run(batches):
        for symbols in _chunks(batches):
            for left, right, new in pending:
                symbols.merge(left, right, new)
            steps, pairs, changes = [], [], []
            for step, (left, right, new) in enumerate(sequence):
                found = symbols.merge(left, right, new)
                if found is not None:
                    steps.append(np.full(len(found[0]), step, np.int32))
                    pairs.append(found[0])
                    changes.append(found[1])
            if steps:
                pairs = np.concatenate(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(steps)), pa.array((pairs >> 32).astype(np.int32)),
                     pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(np.concatenate(changes))],
                    ["step", "left", "right", "n"])

    return (words.select("freq", "ids").mapInArrow(run, "step int, left int, right int, n bigint")
            .groupBy("step", "left", "right").agg(F.sum("n").alias("n")).filter("n != 0"))


def _held(words: DataFrame, most: int):
    """``(M, symbols)``: the word types whose ``first`` pair is one of the first M, with
    at most ``most`` symbols in all."""
    sizes = words.filter("first is not null").groupBy("first").agg(F.sum(F.size("ids") + 1).alias("n")).toArrow()
    first, n = sizes.column("first").to_numpy(), sizes.column("n").to_numpy()
    order = np.argsort(first)
    fits = np.cumsum(n[order]) <= most
    over = first[order][~fits]
    m = int(over[0]) if len(over) else HELD_PAIRS
    return m, (_Symbols.of(words.filter(F.col("first") < m).select("freq", "ids").toArrow()) if m and fits.any() else None)


def _train_bpe(word_freq, vocab_size, min_frequency, special_tokens, max_pairs, checkpoint_every, partitions,
               sample_types, ahead, held_symbols, tables):
    specials = list(special_tokens or tx.SPECIAL_TOKENS)
    alpha = _symbols(word_freq)
    vocab = specials + [a for a in alpha if a not in specials]
    made: list[str] = []                        # merged symbols, in order
    known = {t: ord(t) for t in alpha}          # string -> symbol
    text = lambda x: chr(x) if x < FIRST_MERGED else made[x - FIRST_MERGED]
    least = max(min_frequency, 1)
    words = (word_freq.select(F.col("freq").cast("bigint").alias("freq"),
                              F.transform(tx.characters(F.col("word")), lambda c: F.ascii(c)).alias("ids"))
             .filter(F.size("ids") > 1))
    cores = word_freq.sparkSession.sparkContext.defaultParallelism
    if not partitions and words.rdd.getNumPartitions() < 2 * cores:
        partitions = 2 * cores                  # a small table of few files
    words = tables.keep(words.repartition(partitions) if partitions else words, "bpe-words")
    counts, frontier = _candidates(words, least, max_pairs)
    ranking = _Ranking(counts, least)
    merges, pending, rounds, written, reach = [], [], 0, 0, min(ahead[1], 4 * ahead[0])
    sample, came_true = None, 0                 # merges that came true of the last sequence

    def drawn():
        some = words.orderBy(F.desc("freq"), "ids").limit(sample_types).toArrow()
        return _Sample(_Symbols.of(some))

    def commit(left, right, symbol):
        joined = text(left) + text(right)
        merges.append((text(left), text(right)))
        if joined not in known:
            known[joined] = symbol
            made.append(joined)
            vocab.append(joined)

    def merge_held(symbols, top):
        """Merge what the held word types hold all of; whether the last one's string was known already."""
        pairs, fresh = set(zip(*(c.tolist() for c in top))), FIRST_MERGED + len(made)
        while len(vocab) < vocab_size:
            entry = ranking.first()
            if entry is None or frontier is not None and entry > frontier or not (
                    entry[1:] in pairs or max(entry[1:]) >= fresh):
                break
            pair = entry[1:]
            joined = text(pair[0]) + text(pair[1])
            again = joined in known
            symbol = known.get(joined, FIRST_MERGED + len(made))
            commit(*pair, symbol)
            pending.append((*pair, symbol))
            codes, by = symbols.merge(*pair, symbol)
            for left, right, n in zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist(), by.tolist()):
                if (left, right) in counts or max(left, right) >= fresh and n > 0:
                    ranking.change((left, right), n)
            if again:
                return True
        return False

    def foreseen():
        """The next merges ``(left, right, symbol)`` by the sample, and whether
        the last one's string is known already."""
        names_made: set = set()
        fresh, names, sequence, again = FIRST_MERGED + len(made), [], [], False
        name = lambda x: names[x - fresh] if x >= fresh else text(x)
        before: dict = {}                       # counts as they are, of the pairs that are changed here
        while len(sequence) < min(reach, vocab_size - len(vocab)) and not again:
            entry = ranking.first()
            if entry is None or frontier is not None and entry > frontier:
                break
            pair = entry[1:]
            joined = name(pair[0]) + name(pair[1])
            if joined in names_made:            # made by this sequence itself: left to the next one
                break
            again = joined in known
            sequence.append((*pair, known.get(joined, fresh + len(names))))
            if not again:
                names.append(joined)
                names_made.add(joined)
                changes, n = sample.merge(pair, sequence[-1][2]), counts[pair]
                seen = -changes.get(pair, -n)   # the sample's share of the pair stands for all of it
                changes[pair] = -seen
                for changed, by in changes.items():
                    if changed in counts or max(changed) >= fresh:
                        before.setdefault(changed, counts.get(changed, 0))
                        ranking.change(changed, by * n // seen)
        for pair, n in before.items():
            ranking.set(pair, n)
        return sequence, again

    while len(vocab) < vocab_size:
        entry = ranking.first()
        if held_symbols and came_true < ahead[0] and entry is not None and not (frontier is not None and entry > frontier):
            came_true = ahead[1]                # if too few can be held, the next are foreseen
            top = ranking.top(HELD_PAIRS, frontier)
            words, pending, written = tables.replace(words, _merged(words, pending, top), "bpe-words"), [], rounds
            m, symbols = _held(words, held_symbols)
            if symbols is not None and m >= LEAST_HELD:
                rounds, sample, came_true = rounds + 1, None, 0
                if merge_held(symbols, [c[:m] for c in top]):
                    words, pending = tables.replace(words, _merged(words, pending), "bpe-words"), []
                    counts, frontier = _candidates(words, least, max_pairs)
                    ranking = _Ranking(counts, least)
                continue
        if sample is None:
            if pending:
                words, pending, written = tables.replace(words, _merged(words, pending), "bpe-words"), [], rounds
            sample = drawn()
        sequence, again = foreseen()
        if not sequence:
            if frontier is None:
                break
            if pending:
                words, pending = tables.replace(words, _merged(words, pending), "bpe-words"), []
            counts, frontier = _candidates(words, least, max_pairs)
            ranking = _Ranking(counts, least)
            continue
        rounds += 1
        fresh = FIRST_MERGED + len(made)
        floor = -frontier[0] if frontier else least
        new = (F.col("left") >= fresh) | (F.col("right") >= fresh)
        found = _changes(words, pending, sequence).filter(~new | (F.col("n") >= floor) | (F.col("n") < 0)).toArrow()
        steps = defaultdict(list)
        for step, left, right, n in zip(*(found.column(c).to_pylist() for c in ("step", "left", "right", "n"))):
            steps[step].append(((left, right), n))
        committed = 0
        for step, (left, right, symbol) in enumerate(sequence):
            entry = ranking.first()
            if entry is None or entry[1:] != (left, right) or frontier is not None and entry > frontier:
                break
            commit(left, right, symbol)
            for pair, n in steps[step]:
                if pair in counts or max(pair) >= fresh and n > 0:
                    ranking.change(pair, n)
            committed += 1
        reach, came_true = max(ahead[0], min(ahead[1], 2 * committed)), committed
        sample.keep(committed)
        pending += sequence[:committed]
        again = again and committed == len(sequence)
        if again or rounds - written >= checkpoint_every:
            words, pending, written = tables.replace(words, _merged(words, pending), "bpe-words"), [], rounds
        if again:
            for left, right, symbol in sequence[-1:]:
                sample.merge((left, right), symbol)
                sample.keep(1)
            counts, frontier = _candidates(words, least, max_pairs)
            ranking = _Ranking(counts, least)
    return BpeModel(vocab, merges, specials, rounds=rounds)


# ---------------------------------------------------------------------------
# V5  encoding
# ---------------------------------------------------------------------------
def bpe_encode_word(word: str, ranks: dict, vocab: set, unk: str = UNK) -> list:
    """Apply merges by rank (lowest first, leftmost on ties) to one word: a
    heap of the pairs of neighbours over a linked list, so that a long word
    takes little more than linear time; a short one is looked through for each merge."""
    syms = [c if c in vocab else unk for c in word]
    n = len(syms)
    if n <= SHORT_WORD:
        none = float("inf")
        found = [ranks.get(pair, none) for pair in zip(syms, syms[1:])]
        while found and (first := min(found)) < none:
            i = found.index(first)
            syms[i:i + 2] = [syms[i] + syms[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((syms[i - 1], syms[i]), none)
            if i < len(found):
                found[i] = ranks.get((syms[i], syms[i + 1]), none)
        return syms
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(syms, syms[1:])) if pair in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or (syms[i], syms[j]) != pair:
            continue
        syms[i] += syms[j]
        alive[j] = False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n and (rank := ranks.get((syms[a], syms[b]))) is not None:
                heapq.heappush(heap, (rank, a, (syms[a], syms[b])))
    return [s for s, here in zip(syms, alive) if here]


class BpeTokenizer(ModelTokenizer):
    """Tokenizer view of a trained :class:`BpeModel` (template on by default,
    as the reference's own tokenizers add ``[CLS]``/``[SEP]``)."""

    def __init__(self, model: BpeModel, spark: SparkSession, name: str = "bpe",
                 add_special_tokens: bool = True):
        self.model = model
        payload = ({(a, b): i for i, (a, b) in enumerate(model.merges)}, set(model.vocab),
                   model.unk_token)
        super().__init__(spark, name, payload, _bpe_word, add_special_tokens, model.special_tokens)

    def vocab(self, spark, train_pretokens=None):
        return self.model.vocab_df(spark).select("piece")


def _bpe_word(payload, word):
    ranks, vocab, unk = payload
    return bpe_encode_word(word, ranks, vocab, unk)
