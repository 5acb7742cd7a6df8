"""The rules that chunking applies to every text, on Python strings.

They are ``text``'s and ``patterns``' own, for use in a task's Arrow batches: where
a rule is tried at every character, Python's string methods take a fraction of the
time of a regular expression in the row.  Python's white space is ``patterns.SPACE``.
"""

from __future__ import annotations

import re

from . import patterns as P

_BENGALI, _LATIN = re.compile(f"[{P.BENGALI}]"), re.compile("[a-zA-Z]")
_AFTER_STOP, _OPEN, _CLOSE = (re.compile(p) for p, _ in P.CLEAN[5:8])
_MCQ, _HEADING, _LIST, _EQUATION = (re.compile(p.replace(r"\p{Nd}", r"\d")) for p in (P.MCQ, P.HEADING, P.LIST, P.EQUATION))
_BN, _EN, _ANY = (re.compile(p) for p in (f"[।!?]+{P.SPACE}*", f"[.!?]+{P.SPACE}+", "[।.!?]+"))


def clean(text: str) -> str:
    """``patterns.CLEAN``, rule by rule."""
    words = text.split()
    out = " ".join(words)
    if text[:1].isspace():
        out = f" {out}"
    if words and text[-1:].isspace():
        out += " "
    for twice in ("।।", "??", "!!"):
        out = out.replace(twice, twice[0])
    for stop in "।!?,.;:":
        out = out.replace(f" {stop}", stop)
    if "।" in out or "!" in out or "?" in out:
        out = _AFTER_STOP.sub(r"\1 ", out)
    if "(" in out:
        out = _OPEN.sub(" (", out)
    if ")" in out:
        out = _CLOSE.sub(") ", out)
    return out.strip(" ")


def language(text: str) -> str:
    """``text.chunk_language`` without a detector."""
    bengali = 0 if text.isascii() else len(_BENGALI.findall(text))
    if len(text.strip()) < 10 or not bengali and not _LATIN.search(text):
        return "unknown"
    share = bengali / (bengali + len(_LATIN.findall(text))) if bengali else 0
    return "bn" if share > 0.7 else "mixed" if share > 0.3 else "en"


def content_type(text: str) -> str:
    """``text.content_type``."""
    lowered, lines = text.lower(), text.split("\n")
    if len(lines) > 3 and any(w in lowered for w in P.ANSWER_WORDS):
        return "answer_table"
    if _MCQ.search(text):
        return "mcq"
    if text.count("|") > 2 or len(lines) > 2 and all(len(x.split()) > 2 for x in lines[:3]):
        return "table"
    if _HEADING.match(text) and len(text.strip()) < 150:
        return "heading"
    if _LIST.search(text):
        return "list"
    if len(text) < 200 and _EQUATION.search(text):
        return "equation"
    if len(text) < 300 and any(w in lowered for w in P.DEFINITION_WORDS):
        return "definition"
    return "paragraph"


def _parts(text: str, pattern: re.Pattern) -> list[str]:
    return [p for p in (x.strip() for x in pattern.split(text)) if p]


def sentences(text: str, lang: str) -> list[str]:
    """``chunking.sentences``."""
    found = {"bn": (_BN,), "mixed": (_BN, _EN), "en": (_EN,)}.get(lang, ())
    return [s for p in found for s in _parts(text, p)] or _parts(text, _ANY)
