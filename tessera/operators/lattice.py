"""Piece lattices of many words at once, with numpy.

A :class:`Lattice` holds a piece table as a trie whose nodes are numbered level
by level, so that a step is a binary search in one sorted array of ``(node,
character)`` keys and every start position of every word takes it together.
What it finds are :class:`Edges`: the pieces that stand in the words and where.  They
depend on the piece table alone, so that scores can change, and pieces fall away, without
a new search (:meth:`Edges.rows`).  All words are run side by side: forward, backward and
best path are a few array operations a position on the edges that begin there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CHARS = np.int64(1 << 21)
#: Characters of words whose pieces are looked for at once.
CHARS = 250_000
#: Words of up to so many characters, no path of which has a log-probability below the
#: second, are summed without logarithms.
PLAIN, LEAST_LOG = 500, -600.0


def code_points(words: list) -> tuple[np.ndarray, np.ndarray]:
    """All characters of ``words`` in a row (as code point + 1) and where each
    word starts, with the end."""
    text = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(text, "<u4").astype(np.int64) + 1, np.cumsum([0, *map(len, words)])


class Lattice:
    """``pieces`` (sorted, distinct, not empty) of up to ``max_len`` characters
    with the scores ``logp``; pieces that are longer are left out."""

    def __init__(self, pieces: list, logp, max_len: int):
        self.pieces, self.max_len = pieces, max_len
        self.logp = np.append(np.asarray(logp, np.float64), -np.inf)     # the last one is that of no piece
        codes, starts = code_points(pieces)
        size = np.diff(starts)
        rows, width = len(pieces), int(min(max_len, size.max(initial=1)))
        table = np.zeros((rows, width), np.int64)
        flat = np.arange(len(codes)) - np.repeat(starts[:-1], size)
        inside = flat < width
        table[np.repeat(np.arange(rows), size)[inside], flat[inside]] = codes[inside]
        # the first character in which a row differs from the one before begins its new nodes
        differs = np.ones((rows, width), bool)
        differs[1:] = np.logical_or.accumulate(table[1:] != table[:-1], axis=1)
        keys, nodes, parent, count = [], [], np.zeros(rows, np.int64), 0
        for level in range(width):
            new = differs[:, level] & (size > level)
            node = count + np.cumsum(new)
            keys.append((parent * _CHARS + table[:, level])[new])
            ends = (size == level + 1) & new
            nodes.append((node[ends], np.flatnonzero(ends)))
            count, parent = count + int(new.sum()), node
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.piece = np.full(count + 1, -1, np.int32)
        for node, row in nodes:
            self.piece[node] = row
        self.width = width

    def spans(self, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """``[position, l]``: the piece of ``l + 1`` characters that starts there, or -1."""
        n = len(codes)
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)    # characters to the word's end
        out = np.full((n, self.width), -1, np.int32)
        at, node = np.arange(n), np.zeros(n, np.int64)
        for length in range(self.width):
            alive = left[at] > length
            at, node = at[alive], node[alive]
            if not len(at) or not len(self.keys):
                break
            key = node * _CHARS + codes[at + length]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at, node = at[hit], found[hit] + 1
            out[at, length] = self.piece[node]
        return out

    def edges(self, words: list) -> "Edges":
        """The pieces that stand in the words."""
        codes, starts = code_points(words)
        counts, lengths, pieces = np.zeros(len(codes), np.int64), [], []
        cuts = np.searchsorted(starts, np.arange(CHARS, len(codes), CHARS)) if len(codes) > CHARS else []
        for some in np.split(np.arange(len(words)), np.unique(cuts)):
            if len(some):
                a, b = starts[some[0]], starts[some[-1] + 1]
                spans = self.spans(starts[some[0]:some[-1] + 2] - a, codes[a:b])
                at, length = np.nonzero(spans >= 0)
                counts[a:b] = np.bincount(at, minlength=b - a)
                lengths.append(length + 1)
                pieces.append(spans[at, length])
        return Edges(np.diff(starts), counts, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lengths, pieces)))

    def expected(self, words: list, freq) -> tuple[np.ndarray, float]:
        """Expected number of each piece over all segmentations, times the words'
        ``freq``, and the log-likelihood (of the words that can be segmented)."""
        return self.edges(words).expected(self.logp[:-1], freq)

    def best(self, words: list, without_itself: bool = False):
        """Yield ``(indices, score, steps)`` of the words: :meth:`Edges.best`, without the places of the pieces."""
        some, score, steps = self.edges(words).best(self.logp[:-1], without_itself)
        yield some, score, [step[:2] for step in steps]

    def path_counts(self, words: list, freq) -> tuple[np.ndarray, float]:
        """How often each piece is on the best paths, times ``freq``, and their score."""
        return self.edges(words).path_counts(self.logp[:-1], freq)


class Edges:
    """The pieces in some words: ``sizes`` of the words, ``counts`` of the pieces that begin at
    each of their characters, ``lengths`` and numbers (``pieces``) of these in the same order.

    Words are put in the order of falling size, and their positions, the ends included, are
    numbered position by position: what stands at one position is in a row, and the edges
    that begin at one position of all words end at different places."""

    def __init__(self, sizes, counts, lengths, pieces):
        self.sizes, self.counts, self.lengths, self.pieces = sizes, counts, lengths, pieces

    def rows(self, kind) -> list:
        """``counts``, ``lengths`` (numbers of ``kind``) and ``pieces`` (int32) of each word as Arrow columns of bytes."""
        ends = np.append(0, np.cumsum(self.sizes))
        edges = np.append(0, np.cumsum(self.counts))[ends]
        return [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.sizes), [
                    None, pa.py_buffer((at * np.dtype(to).itemsize).astype(np.int64)), pa.py_buffer(x.astype(to))]).cast(pa.binary())
                for x, at, to in ((self.counts, ends, kind), (self.lengths, edges, kind), (self.pieces, edges, "<i4"))]

    @classmethod
    def of(cls, counts, lengths, pieces, kind) -> "Edges":
        """Back from :meth:`rows`."""
        def flat(column, to):
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            ends = np.frombuffer(column.buffers()[1], "<i4" if pa.types.is_binary(column.type) else "<i8")[
                column.offset:column.offset + len(column) + 1]
            values = column.buffers()[2]
            size = np.dtype(to).itemsize
            return np.diff(ends).astype(np.int64) // size, (
                np.frombuffer(values, to, (ends[-1] - ends[0]) // size, ends[0]) if len(column) and ends[-1] > ends[0] else np.zeros(0, to))

        sizes, counts = flat(counts, kind)
        return cls(sizes, counts.astype(np.int64), flat(lengths, kind)[1], flat(pieces, "<i4")[1])

    def kept(self, number) -> "Edges":
        """Those of the pieces that have a new number (not -1), with it."""
        pieces = number[self.pieces]
        at = np.repeat(np.arange(len(self.counts)), self.counts)[pieces >= 0]
        return Edges(self.sizes, np.bincount(at, minlength=len(self.counts)), self.lengths[pieces >= 0], pieces[pieces >= 0])

    def _laid(self, logp, some=None, without_itself: bool = False):
        """The edges of ``some`` of the words position by position, those without a score left out:
        ``(order, held, longer, base, cuts, word, source, target, piece)``."""
        sizes = self.sizes
        order = np.arange(len(sizes)) if some is None else some
        order = order[np.argsort(-sizes[order], kind="stable")]
        held = sizes[order]
        n = int(held[0]) if len(held) else 0
        longer = np.searchsorted(-held, -np.arange(n + 1))              # words of more than i characters
        starts, first = np.cumsum(sizes) - sizes, np.append(0, np.cumsum(self.counts))
        base = np.append(0, np.cumsum(np.searchsorted(-held, -np.arange(n + 1), "right")))    # positions before the i-th of all
        total = int(longer.sum())
        begin = np.append(0, np.cumsum(longer))[:-1]
        at = np.repeat(np.arange(n + 1), longer)                         # every character, position by position
        word = np.arange(total) - begin[at]
        place = starts[order[word]] + at
        each = self.counts[place]
        which = np.repeat(first[place] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        piece, length = self.pieces[which], self.lengths[which].astype(np.int64)
        at, word = np.repeat(at, each), np.repeat(word, each)
        alive = logp[piece] > -np.inf
        if without_itself:
            alive &= (at > 0) | (length < held[word])
        if not alive.all():
            piece, length, at, word = piece[alive], length[alive], at[alive], word[alive]
        cuts = np.searchsorted(at, np.arange(n + 1)).tolist()
        return order, held, longer.tolist(), base, cuts, word, base[at] + word, base[at + length] + word, piece

    def expected(self, logp, freq) -> tuple[np.ndarray, float]:
        """Expected number of each piece over all segmentations, times the words' ``freq``, and the
        log-likelihood (of the words that can be segmented); a piece of score -inf is none."""
        logp, freq, total, ll = np.asarray(logp, np.float64), np.asarray(freq, np.float64), np.zeros(len(logp)), 0.0
        scores = logp[logp > -np.inf]
        plain = self.sizes <= (PLAIN if scores.max(initial=0.0) <= 0 else 0)
        plain &= self.sizes * scores.min(initial=0.0) >= LEAST_LOG
        for work, some in ((self._plain, np.flatnonzero(plain)), (self._logs, np.flatnonzero(~plain))):
            if len(some):
                ll += work(logp, freq, some, total)
        return total, ll

    def _plain(self, logp, freq, some, total) -> float:
        """:meth:`expected` of ``some`` words with the chances themselves, as none of their paths
        is too rare or too many for a double; adds to ``total``, returns the log-likelihood."""
        order, held, longer, base, cuts, word, source, target, piece = self._laid(logp, some)
        ahead, back = np.zeros(base[-1]), np.zeros(base[-1])
        ends = base[held] + np.arange(len(held))
        ahead[:len(held)], back[ends] = 1.0, 1.0
        chance = np.exp(logp)[piece]
        for a, b in zip(cuts, cuts[1:]):
            ahead[target[a:b]] += ahead[source[a:b]] * chance[a:b]
        for i in range(len(cuts) - 2, -1, -1):
            a, b, k, first = cuts[i], cuts[i + 1], longer[i], base[i]
            back[first:first + k] = np.bincount(word[a:b], chance[a:b] * back[target[a:b]], k)
        z = ahead[ends]
        whole = z > 0
        f = np.where(whole, freq[order], 0.0) / np.where(whole, z, 1.0)
        total += np.bincount(piece, ahead[source] * chance * back[target] * f[word], len(total))
        return float((f * z)[whole] @ np.log(z[whole]))

    def _logs(self, logp, freq, some, total) -> float:
        """:meth:`_plain` with logarithms."""
        order, held, longer, base, cuts, word, source, target, piece = self._laid(logp, some)
        ahead, back = np.full(base[-1], -np.inf), np.full(base[-1], -np.inf)
        ends = base[held] + np.arange(len(held))
        ahead[:len(held)], back[ends] = 0.0, 0.0
        score = logp[piece]
        for a, b in zip(cuts, cuts[1:]):
            ahead[target[a:b]] = np.logaddexp(ahead[target[a:b]], ahead[source[a:b]] + score[a:b])
        for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
            if a < b:
                begins = np.flatnonzero(np.append(True, source[a + 1:b] != source[a:b - 1]))
                back[source[a:b][begins]] = np.logaddexp.reduceat(score[a:b] + back[target[a:b]], begins)
        z = ahead[ends]
        whole = z > -np.inf
        f = np.where(whole, freq[order], 0.0)
        share = np.exp(ahead[source] + score + back[target] - np.where(whole, z, np.inf)[word])
        total += np.bincount(piece, share * f[word], len(total))
        return float(f[whole] @ z[whole])

    def best(self, logp, without_itself: bool = False, unk: float | None = None):
        """``(indices, score, steps)``: the best path's score (-inf if there is none) of each word
        and its pieces from the last to the first as arrays ``(which of the indices, piece, where it
        begins)``.  Of equal paths the one whose last pieces are longest; ``without_itself`` leaves the
        piece out that is the whole word.  With ``unk``, any character may stand for itself (piece -1)
        with that score, if that is better than all pieces that end with it."""
        logp = np.asarray(logp, np.float64)
        order, held, longer, base, cuts, word, source, target, piece = self._laid(logp, None, without_itself)
        score, last = np.full(base[-1], -np.inf), np.full(base[-1], -1)
        score[:len(held)] = 0.0
        weight = logp[piece]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            reach, to = score[source[a:b]] + weight[a:b], target[a:b]
            better = reach > score[to]
            score[to[better]], last[to[better]] = reach[better], np.flatnonzero(better) + a
            if unk is not None:
                alone, to = score[base[i]:base[i] + longer[i]] + unk, slice(base[i + 1], base[i + 1] + longer[i])
                better = alone > score[to]
                score[to] = np.where(better, alone, score[to])
                last[to] = np.where(better, -1, last[to])
        at, here = base[held] + np.arange(len(held)), held.copy()
        found = score[at]
        source, piece = np.append(source, 0), np.append(piece, -1)          # edge -1 is a character that stands for itself
        live, steps = np.flatnonzero((held > 0) & (found > -np.inf)), []
        while len(live):
            edge = last[at[live]]
            one = edge < 0
            before = np.where(one, base[np.maximum(here[live] - 1, 0)] + live, source[edge])
            begins = np.searchsorted(base, before, "right") - 1
            steps.append((live, piece[edge], begins))
            at[live], here[live] = before, begins
            live = live[begins > 0]
        return order, found, steps

    def path_counts(self, logp, freq) -> tuple[np.ndarray, float]:
        """How often each piece is on the best paths, times ``freq``, and their score."""
        freq, total = np.asarray(freq, np.float64), np.zeros(len(logp))
        order, score, steps = self.best(logp)
        f, found = freq[order], score > -np.inf
        for live, piece, _ in steps:
            total += np.bincount(piece, f[live], len(total))
        return total, float(f[found] @ score[found])
