"""Unigram language-model vocabulary (Kudo 2018) on Spark (V6-V9).

All corpus-sized work runs on the word-type table ``(word, freq)``:

* V6 ``seed``: every substring of every word type up to ``max_piece_len``
  characters, scored ``freq x length``, from a suffix array in parts; the top
  ``seed_size`` (ties by piece) plus every single character are kept.
  ``seed_size`` bounds what later reaches the driver.
* V7 ``em_step``: expected piece counts by forward-backward over the words'
  piece lattices (:mod:`tessera.operators.lattice`), many words at once.  Which pieces stand where
  is written once, next to the words; a pass sends the (bounded) scores, each task emits
  its partial sums, a ``groupBy`` adds them.  The M-step is the Bayesian (digamma) update; pieces with an
  expected count below 0.5 leave the model, single characters never do.
* V8 ``prune``: Viterbi counts per piece (distributed like V7); the loss of
  removing a piece compares its log-probability with that of its best
  segmentation into the other pieces, found by a distributed pass over the
  piece table; the lowest-loss pieces are removed until ``shrink x size``
  remain, then EM again, down to ``vocab_size`` -- or to the single
  characters, which always stay, if there are more of these.
* V9 encoding: Viterbi best path per pre-token; runs of characters that no
  piece covers become one ``[UNK]``.

Exact equality with the library's trainer is not a goal (its seed comes
from a suffix array and its sums run in another order); the definition
here is deterministic: pieces are sorted before every sum that reaches
the model and scores are rounded to 1e-9 before ranking, ties by piece.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.bpe import bounded_plan_strings
from tessera.operators.lattice import Edges, Lattice, code_points
from tessera.operators.tokenizers import UNK, ModelTokenizer
from tessera.session import Tables

UNK_PENALTY = 10.0
#: Suffixes that a task sums before it hands them on, and characters of words and edges of them it works on at once.
HELD_SUFFIXES, HELD_CHARS, HELD_EDGES = 1_000_000, 500_000, 1_000_000
#: Words of more characters are cut into suffixes one by one.
LONG_WORD = 64


def digamma(x: float) -> float:
    r = 0.0
    while x < 6.0:
        r -= 1.0 / x
        x += 1.0
    f = 1.0 / (x * x)
    return r + math.log(x) - 0.5 / x - f * (1.0 / 12 - f * (1.0 / 120 - f * (1.0 / 252 - f * (
        1.0 / 240 - f / 132))))


def digammas(x: np.ndarray) -> np.ndarray:
    """:func:`digamma` of each number."""
    x, r = np.array(x, np.float64), np.zeros(len(x))
    while (low := x < 6.0).any():
        r[low] -= 1.0 / x[low]
        x[low] += 1.0
    f = 1.0 / (x * x)
    return r + np.log(x) - 0.5 / x - f * (1.0 / 12 - f * (1.0 / 120 - f * (1.0 / 252 - f * (
        1.0 / 240 - f / 132))))


# ---------------------------------------------------------------------------
# V6
# ---------------------------------------------------------------------------
def _suffixes(word_freq: DataFrame, max_piece_len: int) -> DataFrame:
    """``suffix, freq``: what follows each position of the word types, cut to
    ``max_piece_len`` characters (two or more of them), equal ones of a task summed."""
    def cut(words, freq):
        size = pc.utf8_length(words)
        long = pc.greater(size, LONG_WORD)
        for word, n in zip(words.filter(long).to_pylist(), freq.filter(long).to_pylist()):
            for k in range(0, len(word) - 1, HELD_SUFFIXES):
                found = pa.array([word[i:i + max_piece_len] for i in range(k, min(k + HELD_SUFFIXES, len(word) - 1))])
                yield found, pa.array(np.full(len(found), n, np.int64))
        for i in range(LONG_WORD - 1):          # of all other words those at one position
            some = pc.and_(pc.greater(size, i + 1), pc.invert(long))
            words, freq, size, long = words.filter(some), freq.filter(some), size.filter(some), long.filter(some)
            if not len(words):
                break
            yield pc.utf8_slice_codeunits(words, i, i + max_piece_len), freq

    def run(batches):
        held, rows = [], 0

        def summed():
            table = pa.concat_tables(held).group_by("suffix", use_threads=False).aggregate([("freq", "sum")])
            return table.select(["suffix", "freq_sum"]).rename_columns(["suffix", "freq"]).to_batches()

        for batch in batches:
            for found, freq in cut(batch.column("word"), batch.column("freq")):
                held.append(pa.table({"suffix": found.cast(pa.string()), "freq": freq}))
                rows += len(found)
                if rows >= HELD_SUFFIXES:
                    yield from summed()
                    held, rows = [], 0
        if rows:
            yield from summed()

    return word_freq.select("word", F.col("freq").cast("bigint").alias("freq")).mapInArrow(run, "suffix string, freq bigint")


def _intervals(batches):
    """The distinct prefixes of two or more characters of sorted suffixes, each
    once with its total: suffixes with a common prefix are neighbours.  The prefixes of a batch's last
    suffix may go on in the next one: they are carried over, as suffixes with what counts for them alone."""
    def closed(suffixes, freq, last):
        size = pc.utf8_length(suffixes).to_numpy()
        codes, starts = code_points(suffixes.to_pylist())
        width = int(size.max())
        table = np.zeros((width, len(size)), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        table[np.arange(len(codes)) - starts[row], row] = codes
        differs, found, open_ = np.ones(len(size), bool), [], {}
        differs[1:] = table[0, 1:] != table[0, :-1]
        for length in range(2, width + 1):
            differs[1:] |= table[length - 1, 1:] != table[length - 1, :-1]
            rows = np.flatnonzero(size >= length)
            begin = np.flatnonzero(differs[rows])
            total = np.add.reduceat(freq[rows], begin)
            rows = rows[begin]
            if not last and size[-1] >= length:
                open_[length] = int(total[-1])
                rows, total = rows[:-1], total[:-1]
            if len(rows):
                found.append(pa.RecordBatch.from_arrays([
                    pc.utf8_slice_codeunits(suffixes.take(pa.array(rows)), 0, length).cast(pa.string()), pa.array(total * length)], ["piece", "score"]))
        before = suffixes[-1].as_py()
        carried = [(before[:n], total - open_.get(n + 1, 0)) for n, total in open_.items() if total != open_.get(n + 1, 0)]
        return found, carried

    carried = []
    for batch in batches:
        if batch.num_rows:
            suffixes, freq = (pa.array([x[k] for x in carried], t) for k, t in enumerate((pa.string(), pa.int64())))
            found, carried = closed(pa.concat_arrays([suffixes, batch.column("suffix").cast(pa.string())]),
                                    pa.concat_arrays([freq, batch.column("freq")]).to_numpy(), False)
            yield from found
    if carried:
        yield from closed(pa.array([x[0] for x in carried]), np.array([x[1] for x in carried], np.int64), True)[0]


def seed_pieces(word_freq: DataFrame, max_piece_len: int = 16,
                seed_size: int = 1_000_000, tables: Tables | None = None) -> DataFrame:
    """``piece, score, is_char``: top substrings by ``freq x length`` plus all
    characters.

    Linear in the length of a word: its suffixes, one row a position, are dealt by
    their first two characters and sorted there (a suffix array in parts);
    the intervals of common prefixes give every substring once with its total.  With ``tables``
    these are written, and those that score too low, by a histogram, are left out of the ranking.
    """
    chars = (word_freq.select(F.explode(tx.characters(F.col("word"))).alias("piece"), "freq")
             .groupBy("piece").agg(F.sum("freq").cast("bigint").alias("score")).withColumn("is_char", F.lit(True)))
    tasks = 2 * word_freq.sparkSession.sparkContext.defaultParallelism
    scored = (_suffixes(word_freq.repartition(tasks), max_piece_len)
              .repartition(F.substring("suffix", 1, 2)).sortWithinPartitions("suffix")
              .mapInArrow(_intervals, "piece string, score bigint"))
    if tables is not None:
        scored = tables.keep(scored, "unigram-substrings")
        step = F.floor(F.log2("score") * 64)
        steps = sorted(scored.groupBy(step.alias("step")).count().collect(), reverse=True)
        enough = np.flatnonzero(np.cumsum([r["count"] for r in steps]) >= seed_size)
        if len(enough):
            scored = scored.filter(step >= steps[enough[0]]["step"])
    top = scored.orderBy(F.desc("score"), F.asc("piece")).limit(seed_size).withColumn("is_char", F.lit(False))
    return chars.unionByName(top)


# ---------------------------------------------------------------------------
# lattice helpers (per word, small)
# ---------------------------------------------------------------------------
def viterbi(word: str, logp: dict, max_len: int, unk: str | None = UNK, unk_score: float = -1e9,
            unk_text: bool = False, without_itself: bool = False):
    """Best segmentation; a run of characters no piece covers is fused into
    one unknown token -- ``unk``, or the run's own text when ``unk_text``
    (what the library's Unigram reports as the token, with the unknown id).
    ``without_itself`` leaves out the piece that is the whole word."""
    n = len(word)
    best = [-math.inf] * (n + 1)
    back = [None] * (n + 1)
    best[0] = 0.0
    for j in range(1, n + 1):
        for i in range(max(0, j - max_len), j):
            if best[i] == -math.inf:
                continue
            lp = logp.get(word[i:j])
            if lp is not None and best[i] + lp > best[j] and not (without_itself and j - i == n):
                best[j], back[j] = best[i] + lp, (i, False)
        if unk is not None and best[j - 1] > -math.inf and best[j - 1] + unk_score > best[j]:
            best[j], back[j] = best[j - 1] + unk_score, (j - 1, True)
    if best[n] == -math.inf:
        return ([word] if unk_text else [unk]) if unk else [word], best[n]
    spans, j = [], n
    while j > 0:
        i, is_unk = back[j]
        if is_unk and spans and spans[-1][2]:
            spans[-1][0] = i
        else:
            spans.append([i, j, is_unk])
        j = i
    spans.reverse()
    return [word[a:b] if (not u or unk_text) else unk for a, b, u in spans], best[n]


# ---------------------------------------------------------------------------
# V7 / V8 distributed passes
# ---------------------------------------------------------------------------
def _kind(max_len: int) -> str:
    """What the lengths of pieces are written as."""
    return "<u2" if max_len < 1 << 16 else "<i8"


_EDGES = "counts binary, lengths binary, pieces binary"


def _cut(sizes, most: int):
    """``(start, end)`` of stretches with ``most`` in all or so."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most), "right"))
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def _rows(numbers, edges: Edges, column: str, kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *edges.rows(kind)], [column, "counts", "lengths", "pieces"])


def _held(batches, column: str, kind: str):
    """``(column, edges)`` of stretches of the rows."""
    for batch in batches:
        for a, b in _cut(pc.binary_length(batch.column("pieces")).to_numpy() // 4, HELD_EDGES):
            part = batch.slice(a, b - a)
            yield part.column(column).to_numpy(), Edges.of(*map(part.column, ("counts", "lengths", "pieces")), kind)


class _Spelled:
    """``words`` (``freq`` and edges) and ``own`` (``id`` and edges): word types, and the pieces themselves,
    with the pieces that stand in them, by their places in the sorted ``pieces``.  This is
    searched for once; what passes need besides is a score a piece, -inf for those that have left."""

    def __init__(self, spark, pieces: list, max_len: int, words: DataFrame, own: DataFrame, lattice=None):
        self.spark, self.pieces, self.max_len, self.words, self.own, self.lattice = spark, pieces, max_len, words, own, lattice

    @classmethod
    def of(cls, word_freq: DataFrame, pieces: list, max_len: int) -> "_Spelled":
        """``lattice``, the broadcast :class:`Lattice`, is destroyed by the caller."""
        spark, kind = word_freq.sparkSession, _kind(max_len)
        lattice = spark.sparkContext.broadcast(Lattice(pieces, np.zeros(len(pieces)), max_len))

        def spell(column, words_of):
            def run(batches):
                for batch in batches:
                    words, numbers = words_of(batch), batch.column(column).to_numpy()
                    for a, b in _cut(np.array(list(map(len, words)), np.int64), HELD_CHARS):
                        yield _rows(numbers[a:b], lattice.value.edges(words[a:b]), column, kind)
            return run

        tasks = 2 * spark.sparkContext.defaultParallelism
        words = word_freq.select("word", F.col("freq").cast("bigint").alias("freq")).repartition(tasks)
        own = spark.range(0, len(pieces), 1, tasks)
        return cls(spark, pieces, max_len,
                   words.mapInArrow(spell("freq", lambda batch: batch.column("word").to_pylist()), f"freq bigint, {_EDGES}"),
                   own.mapInArrow(spell("id", lambda batch: [lattice.value.pieces[i] for i in batch.column("id").to_pylist()]),
                                  f"id bigint, {_EDGES}"), lattice)

    def without(self, scores: np.ndarray) -> "_Spelled":
        """The pieces that have left left out."""
        alive, kind = scores > -np.inf, _kind(self.max_len)
        sent = self.spark.sparkContext.broadcast(np.where(alive, np.cumsum(alive) - 1, -1).astype(np.int32))

        def words(batches):
            for freq, edges in _held(batches, "freq", kind):
                yield _rows(freq, edges.kept(sent.value), "freq", kind)

        def own(batches):
            for batch in batches:
                batch = batch.filter(pa.array(sent.value[batch.column("id").to_numpy()] >= 0))
                for ids, edges in _held([batch], "id", kind):
                    yield _rows(sent.value[ids], edges.kept(sent.value), "id", kind)

        return _Spelled(self.spark, [p for p, here in zip(self.pieces, alive.tolist()) if here], self.max_len,
                        self.words.mapInArrow(words, f"freq bigint, {_EDGES}"), self.own.mapInArrow(own, f"id bigint, {_EDGES}"), sent)

    def counts(self, scores: np.ndarray, mode: str) -> tuple[np.ndarray, float]:
        """V7: expected counts (mode ``em``) or counts on best paths (mode ``viterbi``) of the pieces, and the
        total log-likelihood.  A task sums its words and emits a row a piece."""
        sent, kind, work = self.spark.sparkContext.broadcast(scores), _kind(self.max_len), Edges.expected if mode == "em" else Edges.path_counts

        def run(batches):
            logp = sent.value
            total, ll = np.zeros(len(logp)), 0.0
            for freq, edges in _held(batches, "freq", kind):
                found, score = work(edges, logp, freq)
                total, ll = total + found, ll + score
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], ll))], ["row", "value"])

        # as many partial sums as can be worked on at once, however many files there are
        words = self.words.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        found = words.mapInArrow(run, "row int, value double").groupBy("row").agg(F.sum("value").alias("value")).toArrow()
        sent.destroy()
        total = np.zeros(len(scores) + 1)                   # row -1 is the last one
        total[found.column("row").to_numpy()] = found.column("value").to_numpy()
        return total[:-1], float(total[-1])

    def em(self, scores: np.ndarray, chars: np.ndarray):
        """One EM iteration: ``(new scores, log-likelihood, expected counts)``."""
        expected, ll = self.counts(scores, "em")
        kept = (expected >= 0.5) | chars
        counts = np.maximum(expected[kept], 0.5)            # below it are characters only
        new = np.full(len(scores), -np.inf)
        new[kept] = np.round(digammas(counts) - digamma(sum(counts.tolist())), 9)
        return new, ll, expected

    def prune(self, scores: np.ndarray, keep: int, chars: np.ndarray) -> np.ndarray:
        """V8: the scores without the pieces whose loss is lowest, until ``keep`` remain (or only ``chars``,
        which stay).  The losses are worked out on the executors and ranked here, a number a piece."""
        freq, _ = self.counts(scores, "viterbi")
        total = sum(freq.tolist()) or 1.0
        alive, kind = scores > -np.inf, _kind(self.max_len)
        open_ = alive & ~chars
        sent = self.spark.sparkContext.broadcast((scores, freq, open_))

        def losses(batches):
            logp, freq, open_ = sent.value
            for batch in batches:
                batch = batch.filter(pa.array(open_[batch.column("id").to_numpy()]))
                for rows, edges in _held([batch], "id", kind):
                    f = freq[rows]
                    used = f > 0
                    # removing a piece moves its count to its alternatives; every
                    # alternative piece is then drawn from the new total
                    alternatives, log_alt = np.zeros(len(rows)), np.zeros(len(rows))
                    some, score, steps = edges.best(logp, without_itself=True)
                    for live, piece, _ in steps:
                        alternatives[some[live]] += 1
                        log_alt[some[live]] += np.log(np.maximum(freq[piece] + f[some[live]], 1e-300))
                    none = some[score == -np.inf]           # nothing else spells it: it is its own only path
                    alternatives[none], log_alt[none] = 1, np.log(np.maximum(2 * f[none], 1e-300))
                    moved = np.log(total + f * (alternatives - 1))
                    safe = np.where(used, f, 1.0)
                    loss = safe * (np.log(safe) - math.log(total) - (log_alt - alternatives * moved))
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.where(used, np.round(loss, 9), 0.0))], ["id", "loss"])

        found = self.own.mapInArrow(losses, "id bigint, loss double").toArrow()
        sent.destroy()
        ids, loss = found.column("id").to_numpy(), found.column("loss").to_numpy()
        best = ids[np.lexsort((ids, -loss))[:max(keep - int((alive & chars).sum()), 0)]]
        kept = alive & chars
        kept[best] = True
        return np.where(kept, scores, -np.inf)


def _spelled(word_freq: DataFrame, logp: dict, max_len: int, chars=()):
    """``(table, scores, which are characters)`` of a model as a dict."""
    pieces, chars = sorted({*logp, *chars}), set(chars)
    return (_Spelled.of(word_freq, pieces, max_len), np.array([logp.get(p, -np.inf) for p in pieces]),
            np.array([p in chars for p in pieces], bool))


def _model(pieces: list, scores: np.ndarray) -> dict:
    return {p: x for p, x in zip(pieces, scores.tolist()) if x > -math.inf}


def _counts(word_freq: DataFrame, logp: dict, max_len: int, mode: str) -> dict:
    """:meth:`_Spelled.counts` (where there are any) by piece, the log-likelihood by None."""
    table, scores, _ = _spelled(word_freq, logp, max_len)
    found, ll = table.counts(scores, mode)
    table.lattice.destroy()
    return {p: n for p, n in zip(table.pieces, found.tolist()) if n} | {None: ll}


def em_step(word_freq: DataFrame, logp: dict, max_len: int = 16, chars=()):
    """One EM iteration; returns ``(new_logp, log_likelihood, expected)``."""
    table, scores, chars = _spelled(word_freq, logp, max_len, chars)
    new, ll, expected = table.em(scores, chars)
    table.lattice.destroy()
    return _model(table.pieces, new), ll, {p: n for p, n in zip(table.pieces, expected.tolist()) if n}


def prune(word_freq: DataFrame, logp: dict, keep: int, max_len: int, chars) -> dict:
    """Remove the pieces whose loss is lowest until ``keep`` remain (or only ``chars``, which stay)."""
    table, scores, chars = _spelled(word_freq, logp, max_len, set(chars) & set(logp))
    kept = table.prune(scores, keep, chars)
    table.lattice.destroy()
    return _model(table.pieces, kept)


@dataclass
class UnigramModel:
    pieces: list            # (piece, score) in id order, specials first
    unk_token: str = UNK
    max_piece_len: int = 16
    rounds: int = 0
    special_tokens: list = field(default_factory=lambda: list(tx.SPECIAL_TOKENS))

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i, float(s)) for i, (p, s) in enumerate(self.pieces)],
                                     "piece string, id int, score double")

    def save(self, spark: SparkSession, path: str, mode: str = "overwrite"):
        self.vocab_df(spark).coalesce(1).write.mode(mode).parquet(f"{path}/vocab")
        (spark.createDataFrame([(self.unk_token, self.max_piece_len, self.special_tokens)],
                               "unk_token string, max_piece_len int, special_tokens array<string>")
         .coalesce(1).write.mode(mode).parquet(f"{path}/settings"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "UnigramModel":
        rows = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
        settings = spark.read.parquet(f"{path}/settings").first()
        return cls([(r["piece"], r["score"]) for r in rows], settings["unk_token"], settings["max_piece_len"],
                   special_tokens=list(settings["special_tokens"]))


def train_unigram(word_freq: DataFrame, vocab_size: int = 16000, special_tokens=None,
                  max_piece_len: int = 16, seed_size: int = 1_000_000, em_iters: int = 2,
                  shrink: float = 0.75) -> UnigramModel:
    """V8: seed -> (EM x em_iters -> prune to shrink x size) until vocab_size.

    ``max_piece_len`` and ``seed_size`` are the public library's defaults and
    bound the model the driver holds.  Single characters are never pruned: with
    more of them than ``vocab_size`` holds, they are the result, which is then
    larger than asked for.
    """
    spark = word_freq.sparkSession
    specials = list(special_tokens or tx.SPECIAL_TOKENS)
    target = vocab_size - len(specials)

    def written(old, table):
        table.words = tables.replace(old and old.words, table.words, "unigram-words")
        table.own = tables.replace(old and old.own, table.own, "unigram-pieces")
        table.lattice.destroy()
        return table

    with bounded_plan_strings(spark), Tables() as tables:
        wf = tables.keep(word_freq.select("word", "freq"), "unigram_words")
        with Tables() as part:
            seed = seed_pieces(wf, max_piece_len, seed_size, part).toArrow()
        seed = seed.take(pc.sort_indices(seed.column("piece")))
        chars, score = seed.column("is_char").to_numpy(), seed.column("score").to_pylist()
        total = float(sum(score))
        scores = np.array([round(math.log(x / total), 9) for x in score])
        table = written(None, _Spelled.of(wf, seed.column("piece").to_pylist(), max_piece_len))
        rounds = 0
        while True:
            for _ in range(em_iters):
                scores, _, _ = table.em(scores, chars)
            rounds += 1
            size = int((scores > -np.inf).sum())
            if size <= target or not (~chars & (scores > -np.inf)).any():
                break
            scores = table.prune(scores, max(target, int(size * shrink)), chars)
            alive = scores > -np.inf
            if 2 * alive.sum() <= len(alive):
                table = written(table, table.without(scores))
                scores, chars = scores[alive], chars[alive]
        scores, _, _ = table.em(scores, chars)
    logp, chars = _model(table.pieces, scores), [p for p, one in zip(table.pieces, chars.tolist()) if one]
    ranked = sorted(logp.items(), key=lambda kv: (-kv[1], kv[0]))
    if len(ranked) > target:
        keep = set(chars) | {p for p, _ in [kv for kv in ranked if kv[0] not in chars][:max(target - len(chars), 0)]}
        ranked = [kv for kv in ranked if kv[0] in keep]
    pieces = [(s, 0.0) for s in specials] + [(p, s) for p, s in ranked if p not in specials]
    return UnigramModel(pieces, max_piece_len=max_piece_len, rounds=rounds, special_tokens=specials)


def _uni_word(payload, word):
    logp, max_len, unk, unk_score, _ = payload
    return viterbi(word, logp, max_len, unk, unk_score, unk_text=True)[0]


def _uni_words(payload, words) -> pa.ListArray:
    """:func:`_uni_word` of each word, along the lattices of many at once."""
    *_, unk_score, lattice = payload
    sizes = np.array(list(map(len, words)), np.int64)
    parts = [_paths(lattice, words[a:b], sizes[a:b], unk_score) for a, b in _cut(sizes, HELD_CHARS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def _paths(lattice: Lattice, words, sizes, unk_score: float) -> pa.ListArray:
    order, _, steps = lattice.edges(words).best(lattice.logp[:-1], unk=unk_score)
    if not steps:
        return pa.array([[] for _ in words], pa.list_(pa.string()))
    word, piece, begins = map(np.concatenate, zip(*((order[live], piece, begins) for live, piece, begins in steps)))
    there = np.lexsort((begins, word))
    word, piece, begins = word[there], piece[there], begins[there]
    # a run of characters that no piece covers is one unknown token, its own text
    apart = np.ones(len(word), bool)
    apart[1:] = (word[1:] != word[:-1]) | (piece[1:] >= 0) | (piece[:-1] >= 0)
    word, piece, begins = word[apart], piece[apart], begins[apart]
    last = np.append(word[1:] != word[:-1], True)
    ends = np.where(last, sizes[word], np.append(begins[1:], 0))
    unknown = np.flatnonzero(piece < 0)
    names = pa.array([words[word[k]][begins[k]:ends[k]] for k in unknown.tolist()], pa.string())
    which = np.where(piece < 0, len(lattice.pieces) + np.cumsum(piece < 0) - 1, piece)
    texts = pa.concat_arrays([pa.array(lattice.pieces, pa.string()), names]).take(pa.array(which))
    offsets = np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts)


class UnigramTokenizer(ModelTokenizer):
    def __init__(self, model: UnigramModel, spark: SparkSession, name: str = "unigram",
                 add_special_tokens: bool = True):
        self.model = model
        specials = set(model.special_tokens)
        logp = {p: s for p, s in model.pieces if p not in specials}
        unk_score = (min(logp.values()) if logp else 0.0) - UNK_PENALTY
        pieces = sorted(p for p in logp if p)
        lattice = Lattice(pieces, [logp[p] for p in pieces], model.max_piece_len)
        super().__init__(spark, name, (logp, model.max_piece_len, model.unk_token, unk_score, lattice), _uni_word,
                         add_special_tokens, model.special_tokens, _uni_words if model.unk_token is not None else None)

    def vocab(self, spark, train_pretokens=None):
        return self.model.vocab_df(spark).select("piece")
