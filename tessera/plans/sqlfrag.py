"""DuckDB SQL fragments mirroring :mod:`tessera.functions.text`.

Used only to build the oracle SQL that checks the Spark plans.  DuckDB's
``\\s`` and ``\\d`` are ASCII only, so the Unicode classes are spelled out.
"""

from __future__ import annotations

WS = r"[\t-\r \x{85}\p{Z}]"
STRIP = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
WORDCH = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + STRIP + '+|' + STRIP + '+$')}, '', 'g')"


def nfc(x: str) -> str:
    return f"nfc_normalize({x})"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')"


def verse(x: str) -> str:
    return f"regexp_replace({x}, {q(r'^\p{Nd}+[.:]' + WS + '*')}, '')"


def clean(x: str, lowercase: bool = False) -> str:
    out = strip(nfc(x))
    if lowercase:
        out = f"lower({out})"
    return verse(collapse(out))


def good(x: str, min_chars: int = 3) -> str:
    return f"(length({strip(x)}) >= {min_chars} AND regexp_matches({x}, {q(r'\p{L}')}))"


def strip_tag(x: str) -> str:
    return strip(f"regexp_replace({x}, {q('^<[^>]+>' + WS + '*')}, '')")


def lang_tag(x: str) -> str:
    return (f"(CASE WHEN starts_with({x}, '<') AND contains({x}, '>') "
            f"THEN regexp_extract({x}, '^<([^>]*)>', 1) ELSE 'unknown' END)")


def words(x: str) -> str:
    return f"regexp_extract_all({strip_tag(x)}, {q(r"\p{L}+(?:['’\-]\p{L}+)*")})"


def pretokens(x: str) -> str:
    pat = "[" + WORDCH + "]+|[^" + WORDCH + r"\t-\r \x{85}\p{Z}]+"
    return f"regexp_extract_all({x}, {q(pat)})"


def clean_marker(x: str) -> str:
    return strip(f"regexp_replace({x}, '##|▁|Ġ', '', 'g')")


BOUNDARY_SPECIALS_SQL = ("('[PAD]','[UNK]','[CLS]','[SEP]','[MASK]',"
                         "'<pad>','<unk>','<s>','</s>','<mask>')")


def clean_token(x: str) -> str:
    return f"(CASE WHEN {x} IN {BOUNDARY_SPECIALS_SQL} THEN '' ELSE {clean_marker(x)} END)"


def r9(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 9)"
