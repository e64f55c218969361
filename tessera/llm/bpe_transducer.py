"""Byte-level BPE as a lazily determinised finite-state transducer."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from array import array

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import held, short_batches, utf8

#: Memory bounds per Python worker: of a full table, what was met least
#: recently goes and is worked out again when needed.
MAX_STATES, MAX_PAIRS, MAX_SEGMENTS = 200_000, 300_000, 150_000
#: Longer segments are not remembered.
LONG_SEGMENT = 64

#: Bytes whose steps stand in a dense table, ``DENSE`` to a state; steps on
#: others are rarer and stand in a dictionary.  A step is a number: the next
#: state's place in the table, then ``TOKEN_BITS`` of the last token.
COMMON = b" etaoinshrdlucmfgypwbvkxjqz\xc3\xa9.,"
DENSE, TOKEN_BITS = 32, 24
_CLASS = bytes(COMMON.index(b) if b in COMMON else DENSE - 1 for b in range(256))
_EMPTY = array("q", [-1] * DENSE)
_TOKEN = (1 << TOKEN_BITS) - 1

# The White_Space characters, which \s means in the public pattern.
SPACE = "\t\n\v\f\r \x85\xa0  -     　"
#: Cuts a text at ends of the public pattern's matches, which look at nothing
#: before them.  The first line's parts are such matches as they are, known from
#: the ASCII character behind them; what begins otherwise is a run of non-spaces
#: (with the one space before it), which the pattern itself cuts, or of spaces.
_SEGMENT = re.compile(
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[\0-@\[-`{-\x7f]|\Z)"
    r"| ?[0-9]+(?=[\0-/:-\x7f]|\Z)| ?[!-/:-@\[-`{-~]+(?=[\t-\r 0-9A-Za-z]|\Z)"
    f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


def read_ranks(lines) -> dict[bytes, int]:
    """``{token: rank}`` from the lines of a rank file (base64, blank, number)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Left-to-right BPE of one pre-token, byte by byte.

    Facts used (published on incremental and automaton BPE): the encoding of
    every prefix is the encoding of a shorter prefix plus one last token, and
    that token is the only one that ends there whose predecessor goes with it
    -- two tokens go together if the merges leave just them of their joined
    bytes.

    After some bytes, a prefix can still be extended only while the bytes since
    then begin some token.  These live prefixes, each with its node in the
    token trie and its last token, are a state; a step reads a byte and gives
    the last token of the prefix read so far.  A step depends on state and byte
    alone, so it is worked out once, when first met, and kept.

    Last tokens are held back until every live prefix agrees on what led to
    it, which is the case for all but about the longest token's last bytes;
    the agreed tokens are then emitted.  So input of any length is encoded in
    one pass with a bounded buffer.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        if max(self.bytes_of, default=0) >= _TOKEN:
            raise ValueError(f"ranks beyond {_TOKEN}")
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        self._clear()

    def _clear(self, first=(0,)):
        #: A state has a number for each live prefix, the oldest first: its trie
        #: node, then TOKEN_BITS of its last token plus one (0: it is empty).
        self.states = [(0,)]
        self.number = {self.states[0]: 0}
        self.table = array("q", _EMPTY)
        self.others: dict[int, int] = {}
        return self._numbered(first)

    def _numbered(self, state) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
            self.table.extend(_EMPTY)
        return number

    def together(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left, right`` of their joined bytes.

        They don't if a symbol that stands at the end of ``left`` for a while
        and one that stands at the beginning of ``right`` merge before either is
        merged into its own token; of equal ranks the leftmost merge is first.
        """
        found = self.pairs.get(left << TOKEN_BITS | right)
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            rank = self.ranks.get
            found = self.pairs[left << TOKEN_BITS | right] = not any(
                (m := rank(x + y)) is not None and m < until_x and m <= until_y
                for x, until_x in self._edge(left, 1) for y, until_y in self._edge(right, 0))
        return found

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The symbols that stand at one side (0: first, 1: last) of a token in
        the course of its merges, and the rank that ends each."""
        found = self.edges.get((token, side))
        if found is None:
            data, until = self.bytes_of[token], float("inf")
            found = self.edges[token, side] = [(data, until)]
            while len(data) > 1:
                until = self.ranks[data]
                data = self.merged(data, 2)[side]
                found.append((data, until))
        return found

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging by rank, leftmost first, down to ``stop`` symbols (for
        short strings)."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > stop:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _first(self, token: int) -> bool:
        """Whether a token can stand at the start: the merges make it."""
        found = self.pairs.get(~token)
        if found is None:
            found = self.pairs[~token] = len(self.merged(self.bytes_of[token])) == 1
        return found

    def _step(self, at: int, byte: int) -> int:
        """Work out a step from the state whose place in the table is ``at``."""
        moved = [(nxt, live & _TOKEN) for live in self.states[at // DENSE]
                 if (nxt := self.trie[live >> TOKEN_BITS].get(byte)) is not None]
        for node, before in moved:  # the oldest prefix has the longest last token
            token = self.token_at[node]
            if token is not None and self._first(token) and (not before or self.together(before - 1, token)):
                break
        else:
            raise ValueError(f"no token ends with byte {byte}")
        nxt = self._numbered((*(n << TOKEN_BITS | b for n, b in moved if self.trie[n]), token + 1))
        found = nxt * DENSE << TOKEN_BITS | token
        if _CLASS[byte] < DENSE - 1:
            self.table[at + _CLASS[byte]] = found
        else:
            self.others[at << 8 | byte] = found
        return found

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token.  A pre-token that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._clear()
        ids: list[int] = []
        last: list[int] = []  # last token after each byte not yet emitted
        at, step = 0, 64 * self.longest
        for start in range(0, len(data), step):
            part = data[start:start + step] if len(data) > step else data
            table, others, rare = self.table, self.others, DENSE - 1
            for c, byte in zip(part.translate(_CLASS), part):
                found = table[at + c] if c < rare else others.get(at << 8 | byte, -1)
                if found < 0:
                    found = self._step(at, byte)
                at = found >> TOKEN_BITS
                last.append(found & _TOKEN)
            if start + step < len(data):
                ids += self._agreed(last, at // DENSE)
                if len(self.states) > MAX_STATES:
                    at = self._clear(self.states[at // DENSE]) * DENSE
        return ids + self._back(last, len(last))

    def _back(self, last, end: int) -> list[int]:
        """Tokens of the prefix that ends at ``end``: each last token leads to
        the prefix before it."""
        out, length = [], self.length
        while end:
            token = last[end - 1]
            out.append(token)
            end -= length[token]
        out.reverse()
        return out

    def _agreed(self, last, state: int) -> list[int]:
        """Take off and return the tokens that all live prefixes share."""
        ends = {len(last) - self.depth[live >> TOKEN_BITS] for live in self.states[state]}
        while len(ends) > 1:  # follow the longest prefix back until all meet
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.length[last[end - 1]])
        end = ends.pop()
        out = self._back(last, end)
        del last[:end]
        return out


class Encoder:
    """Whole texts to ids: segments, the pattern's matches, the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        # the public pattern's \s is White_Space, which the library reads wider
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")
                                     .replace(r"\S", f"[^{SPACE}]"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for segment in _SEGMENT.findall(text):
            ids = self.known.get(segment)
            out.append(self._segment(segment) if ids is None else ids)
        return b"".join(out)

    def _segment(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            ids = b"".join([self._packed(utf8(m)) for m in self.pattern.findall(segment)])
        if len(segment) <= LONG_SEGMENT:
            if len(self.known) >= MAX_SEGMENTS:
                self.older, self.known = self.known, {}
            self.known[segment] = ids
        return ids


    def _packed(self, pretoken: bytes) -> bytes:
        ids = array("I", self.transducer.encode(pretoken))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


class Utf8Stream:
    """Incremental UTF-8: a state machine over the bytes of a character.

    ``feed`` returns the text that is certain; an unfinished character waits
    for its other bytes; bytes that no character can hold become U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character and need more: walks back
        over at most three continuation bytes to a lead byte."""
        for back in range(1, min(4, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.unfinished(data)
        self.held = data[len(data) - n:]
        return data[:len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def pieces(self, ids, block: int = 1 << 16):
        """Bytes of the ids, a block at a time."""
        get = self.bytes_of.__getitem__
        for i in range(0, len(ids), block):
            yield b"".join(map(get, ids[i:i + block]))

    def text(self, ids) -> str:
        stream = Utf8Stream()
        return "".join([*map(stream.feed, self.pieces(ids)), stream.end()])




def _coder(name: str, pattern: str):
    """Encoder and decoder of this Python worker; the rank file is one that
    ``addFile`` sent to every executor."""
    def make():
        with open(SparkFiles.get(name), "rb") as f:
            ranks = read_ranks(f)
        coder = Encoder(ranks, pattern), Decoder(ranks)
        gc.freeze()  # the tables stay; the collector need not walk them again
        return coder

    return held(("bpe", name, pattern), make)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", as_ids: bool = True) -> DataFrame:
    """``docs`` without the text, with what encoding and decoding it gives.

    Adds ``n_tokens``, ``ids`` (array of int, with ``as_ids``), ``ids_sha256``
    (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (of the bytes that decoding the ids through the
    incremental UTF-8 machine gives, equal to those of the text).  A null text
    counts as an empty one.  Columns that share a new column's name are
    replaced; rows are neither dropped nor merged.  No special tokens.

    The rank file, of a fixed size, goes to the executors by ``addFile``.
    """
    spark = docs.sparkSession
    short_batches(spark)
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rstrip("/").rsplit("/", 1)[-1]
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * as_ids
    new = [c.split()[0] for c in made.split(", ")]
    others = [c for c in docs.columns if c not in (*new, text_col)]

    @F.pandas_udf(made)
    def run(text: pd.Series) -> pd.DataFrame:
        encoder, decoder = _coder(name, pattern)
        rows = []
        for t in text:
            packed = encoder.packed(t or "")
            ids = memoryview(packed).cast("I")
            back, stream = hashlib.sha256(), Utf8Stream()
            for piece in decoder.pieces(ids):
                back.update(utf8(stream.feed(piece)))
            back.update(utf8(stream.end()))
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), back.hexdigest())
                        + ((ids.tolist(),) if as_ids else ()))
        return pd.DataFrame(rows, columns=new)

    return (docs.select(*others, F.explode(F.array(run(F.col(text_col)))).alias("__e"))
            .select(*others, *[F.col("__e")[c].alias(c) for c in new]))


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with ``text_col``: the text of an array of ids (null: null)."""
    spark = tokens.sparkSession
    short_batches(spark)
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rstrip("/").rsplit("/", 1)[-1]

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        _, decoder = _coder(name, "")
        return ids.map(lambda x: None if x is None else decoder.text(list(x)))

    return tokens.withColumn(text_col, run(F.col(ids_col)))
