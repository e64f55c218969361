"""Per-row text functions as Spark Columns (cleaning, tags, words, pieces).

Every function takes and returns a :class:`~pyspark.sql.Column`, so they
compose into one projection that stays inside whole-stage codegen.  The only
Python on the path is NFC normalisation (no Spark built-in), done by an
Arrow-batched UDF that receives NULL for rows that are NFC at a glance.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Special tokens of the trained tokenizers, in id order 0..4.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
# Tokens removed before boundary scoring.
BOUNDARY_SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]",
                           "<pad>", "<unk>", "<s>", "</s>", "<mask>"]
# Tokens counted as unknown by the UNK-rate metric.
UNK_TOKENS = ["[UNK]", "<unk>", "<UNK>"]
# Subword boundary markers removed before measuring a piece.
SUBWORD_MARKERS = ["##", "▁", "Ġ"]
# Word pattern of the metrics (letters joined by apostrophe, right single
# quotation mark or hyphen).
WORD_PATTERN = r"\p{L}+(?:['’\-]\p{L}+)*"
# Leading verse / list number removed by the cleaner.
VERSE_PATTERN = r"(?U)^\d+[.:]\s*"
# Pre-tokenizer: runs of word characters, or runs of other non-space chars.
PRETOKEN_PATTERN = r"(?U)\w+|[^\w\s]+"
# Language tag at the start of a line.
TAG_PATTERN = r"(?U)^<[^>]+>\s*"

# Python's str.strip() removes White_Space plus U+001C..U+001F.
_STRIPPED = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# F1  NFC
# ---------------------------------------------------------------------------
def _nfc_one(x):
    if x is None or unicodedata.is_normalized("NFC", x):
        return x
    return unicodedata.normalize("NFC", x)


@F.arrow_udf(T.StringType())
def _nfc_arrow(s: pa.Array) -> pa.Array:
    # Python's unicodedata (as the reference); pyarrow's utf8_normalize is
    # not used: in this build its NFC output is decomposed.
    return pa.array([_nfc_one(x) for x in s.to_pylist()], type=pa.string())


def is_ascii(c) -> Column:
    """True when every character is ASCII (one byte per character)."""
    c = _c(c)
    return F.length(c) == F.octet_length(c)


#: What is not below U+0300, before which every character is its own NFC and none combines.
_BEYOND_LATIN = r"[^\x{0}-\x{2ff}]"
#: Stretches of characters that need no look are listed if they are this long.
_STRETCH = 64


@cache
def nfc_unsure_pattern() -> str:
    """A character class of all characters that NFC may change or that may
    combine with one before them (UAX #15, quick check not "yes", or a combining class).

    It is spelled as what it leaves out: the long stretches of characters that are
    their own NFC, are not the second half of a composition, and have combining
    class 0 -- text of such characters only is NFC as it is.
    """
    second = {0x110000}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    second.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))     # Hangul vowels and finals
    second.update(range(0xD800, 0xE000))
    stretches, start = [], 0
    for c in range(0x110001):
        sure = c not in second and not unicodedata.combining(chr(c)) and unicodedata.normalize("NFC", chr(c)) == chr(c)
        if not sure:
            if c - start >= _STRETCH:
                stretches.append((start, c - 1))
            start = c + 1
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in stretches) + "]"


def nfc(c) -> Column:
    """Unicode NFC.  Rows of characters that NFC leaves alone (ASCII, accented
    Latin, most scripts without separate marks) cross to Python as NULL; rows below
    the first combining mark are told apart without the long class."""
    c = _c(c)
    unsure = ~is_ascii(c) & c.rlike(_BEYOND_LATIN) & c.rlike(nfc_unsure_pattern())
    return F.coalesce(_nfc_arrow(F.when(unsure, c)), c)


# ---------------------------------------------------------------------------
# F2-F7  cleaning
# ---------------------------------------------------------------------------
def ustrip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace and U+001C..U+001F."""
    return F.btrim(_c(c), F.lit(_STRIPPED))


def lowercase(c) -> Column:
    return F.lower(_c(c))


def collapse_whitespace(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)\s+", " ")


def strip_verse_number(c) -> Column:
    """Drop one leading ``<digits>.`` or ``<digits>:`` and following spaces."""
    return F.regexp_replace(_c(c), VERSE_PATTERN, "")


def clean_line(c, lowercase_text: bool = False) -> Column:
    """NFC -> strip -> (lower) -> collapse whitespace -> drop verse number."""
    out = ustrip(nfc(c))
    if lowercase_text:
        out = lowercase(out)
    return strip_verse_number(collapse_whitespace(out))


def is_good_line(c, min_chars: int = 3) -> Column:
    """At least ``min_chars`` code points after strip and at least one letter."""
    c = _c(c)
    return (F.length(ustrip(c)) >= F.lit(min_chars)) & c.rlike(r"\p{L}")


# ---------------------------------------------------------------------------
# F8-F12  tags, words, pre-tokens
# ---------------------------------------------------------------------------
def render_tag(lang, c) -> Column:
    return F.concat(F.lit("<"), _c(lang), F.lit("> "), _c(c))


def strip_language_tag(c) -> Column:
    c = _c(c)
    return ustrip(F.when(c.startswith("<"), F.regexp_replace(c, TAG_PATTERN, "")).otherwise(c))


def language_tag(c) -> Column:
    """Text between a leading ``<`` and the first ``>``; else ``unknown``."""
    c = _c(c)
    return (F.when(c.startswith("<") & c.contains(">"),
                   F.regexp_extract(c, r"^<([^>]*)>", 1))
            .otherwise(F.lit("unknown")))


def words(c) -> Column:
    """Runs of letters joined by apostrophe, right single quotation mark or hyphen."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_PATTERN), 0)


def simple_words(c) -> Column:
    """Words of the line after (another) tag strip."""
    return words(strip_language_tag(c))


def pretokens(c) -> Column:
    """Whitespace pre-tokenizer: ``\\w+|[^\\w\\s]+`` on Unicode classes."""
    return F.regexp_extract_all(_c(c), F.lit(PRETOKEN_PATTERN), 0)


def pretokens_with_specials(c, specials) -> Column:
    """:func:`pretokens` with special tokens matched in the raw text first,
    wherever they stand (the library adds them as tokens of their own)."""
    if not specials:
        return pretokens(c)
    special = "|".join(re.escape(x) for x in specials)
    # a special token that begins with no word character cannot begin inside a run of them
    inside = r"\w+" if not any(re.match(r"\w", x) for x in specials) else rf"(?:(?!{special})\w)+"
    return F.regexp_extract_all(_c(c), F.lit(rf"(?U){special}|{inside}|(?:(?!{special})[^\w\s])+"), 0)


def characters(c) -> Column:
    """Array of the code points of a string (surrogate pairs kept whole)."""
    return F.regexp_extract_all(_c(c), F.lit(r"(?s)."), 0)


# ---------------------------------------------------------------------------
# F13-F16  pieces and templates
# ---------------------------------------------------------------------------
def clean_subword_marker(c) -> Column:
    """Remove every ``##``, U+2581 and U+0120, then strip.  Keeps specials."""
    # one after the other: the others are single characters, so none makes a marker of another kind
    out = _c(c)
    for marker in SUBWORD_MARKERS:
        out = F.replace(out, F.lit(marker))
    return ustrip(out)


def clean_token(c) -> Column:
    """Like :func:`clean_subword_marker`, but special tokens become empty."""
    c = _c(c)
    return F.when(c.isin(BOUNDARY_SPECIAL_TOKENS), F.lit("")).otherwise(
        clean_subword_marker(c))


def clean_pieces(arr, drop_specials: bool = False) -> Column:
    """Clean every piece of an array and drop the empty ones."""
    fn = clean_token if drop_specials else clean_subword_marker
    return F.filter(F.transform(_c(arr), fn), lambda x: F.length(x) > 0)


def split_segments(c) -> Column:
    """Gold segmentation string ``a|b|c`` (stripped) -> array."""
    return F.split(ustrip(_c(c)), r"\|")


def template_single(tokens, cls: str = "[CLS]", sep: str = "[SEP]") -> Column:
    return F.concat(F.array(F.lit(cls)), _c(tokens), F.array(F.lit(sep)))


def template_pair(a, b, cls: str = "[CLS]", sep: str = "[SEP]"):
    """Return (tokens, type_ids) of ``[CLS] A [SEP] B [SEP]``; B has type 1."""
    a, b = _c(a), _c(b)
    tokens = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)), b,
                      F.array(F.lit(sep)))
    type_ids = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2),
                        F.array_repeat(F.lit(1), F.size(b) + 1))
    return tokens, type_ids
