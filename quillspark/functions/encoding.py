"""Repair of text whose UTF-8 bytes were read as Windows-1252 or Latin-1.

Such text has sequences that spell a whole UTF-8 character: a lead letter (``Ã``,
``â``, ``à``) and one to three of the characters that stand for continuation
bytes.  Each is read again as what it spells; what was broken twice, twice.
Only sequences of valid UTF-8 count.  Clean text can have two-letter ones by
chance, a capital and a quote or a dash: these count where they spell Latin-1
(``Ã©``), Greek or Cyrillic, or one of two letters.  All else stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sql_text, text_of

ROUNDS = 3
_CLOSERS = "‘’“”…–—«»"


def _as_read(byte: int) -> set[str]:
    """The characters that a byte may have been read as."""
    return {chr(byte)} | set(bytes([byte]).decode("cp1252", "ignore"))


def _class(low: int, high: int, but: str = "") -> str:
    return "[" + "".join(sorted(set().union(*(_as_read(b) for b in range(low, high + 1))) - set(but))) + "]"


_REST = _class(0x80, 0xBF)
#: Valid UTF-8, by lead.
_SEQUENCES = [
    _class(0xC2, 0xC3) + _REST,
    _class(0xCE, 0xD0) + _REST,  # Greek and most of Cyrillic
    _class(0xC4, 0xCD) + _class(0x80, 0xBF, _CLOSERS),
    _class(0xD1, 0xDF) + _class(0x80, 0xBF, _CLOSERS),
    "Å“|Æ’",  # œ, and what ƒ becomes, the second half of a twice broken Ã
    _class(0xE0, 0xE0) + _class(0xA0, 0xBF) + _REST,
    _class(0xE1, 0xEC) + _REST * 2,
    _class(0xED, 0xED) + _class(0x80, 0x9F) + _REST,
    _class(0xEE, 0xEF) + _REST * 2,
    _class(0xF0, 0xF0) + _class(0x90, 0xBF) + _REST * 2,
    _class(0xF1, 0xF3) + _REST * 3,
    _class(0xF4, 0xF4) + _class(0x80, 0x8F) + _REST * 2,
]
BROKEN = f"(?:{'|'.join(_SEQUENCES)})+"
#: What isn't a lead goes by in long stretches, a lone lead by itself.
PIECES = f"(?s){BROKEN}|[^{chr(0xC2)}-{chr(0xF4)}]+|."
#: The same for Java: the alternatives are tried at leads alone, and ``++``, which gives
#: nothing back, goes along a run of any length without recursion.
_FIRST = f"(?=[{chr(0xC2)}-{chr(0xF4)}])(?:{'|'.join(_SEQUENCES)})"
_RUN = f"{_FIRST}++"
_TABLE = [(chr(b), c) for b in range(0x80, 0xA0) for c in bytes([b]).decode("cp1252", "ignore")]
CONTROLS, SPECIALS = ("".join(x) for x in zip(*_TABLE, strict=True))


def repair_encoding(c: str | Column) -> Column:
    """The text, mended; null is the empty text.  Runs in the row, and isn't more
    than one test of a pattern for text without a broken sequence."""

    def mended(text: Column) -> Column:
        # All runs are read at once, a line each: none spells a line feed.
        runs = F.array_join(F.regexp_extract_all(text, F.lit(f"({_RUN})"), F.lit(1)), "\n")
        read = F.split(F.decode(F.encode(F.translate(runs, SPECIALS, CONTROLS), "ISO-8859-1"), "UTF-8"), "\n")
        # One more stretch than there are runs.
        return F.array_join(F.zip_with(F.split(text, _RUN), read, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")

    def rounds(text: Column, left: int) -> Column:
        if not left:
            return text
        # Through an array, so that each round is computed once; one that changes
        # nothing is the last.
        again = F.transform(F.array(mended(text)), lambda t: rounds(t, left - 1))[0]
        return F.when(text.rlike(_FIRST), again).otherwise(text)

    return F.transform(F.array(text_of(c)), lambda t: rounds(t, ROUNDS))[0]


def sql_repair(expr: str) -> str:
    """The same as SQL, for comparison."""
    one = f"array_to_string(list_transform(regexp_extract_all(translate(p, {sql_text(SPECIALS)}, {sql_text(CONTROLS)}), '(?s).'), lambda h: printf('%02x', unicode(h))), '')"
    for _ in range(ROUNDS):
        pieces = f"regexp_extract_all({expr}, {sql_text(PIECES)})"
        expr = f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN regexp_full_match(p, {sql_text(BROKEN)}) THEN decode(unhex({one})) ELSE p END), '')"
    return expr
