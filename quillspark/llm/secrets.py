r"""Secret scans (operator 2).

Fixed patterns find assigned, access-key and hexadecimal secrets.  Besides, the
value in every credential context (an assignment to a credential-like name, an
authorization header, the password of a URL) is scored by the guesses an
attacker would need: dynamic programming over its characters finds the cheapest
segmentation into ranked words, dates, repeats of a block, keyboard walks and
brute-force spans.  Values that are written out, not code, a link or a sentence
(``is_literal``), become spans of kind ``guess`` where these guesses (log10) are
``min_guesses`` at least and ``MIN_PER_CHARACTER`` for each character: an
expression's cost grows with its length, but it is made of words.  Fixed-pattern
spans always stay.  A password that is easy to guess is no ``guess`` span.

The word ranks come from the whole-word entries of a public tokenizer
vocabulary, whose merge order follows frequency; its path is a parameter, and
without a file only the words of credentials and placeholders are known.

Work is per document, in Arrow batches, without a shuffle.  Dynamic programming
is linear in the value: words, dates and the blocks of repeats are bounded in
length; repeats, walks and brute force extend a state.

Edge cases: null and empty texts have no spans; positions are code points, end
exclusive; repeated rows are scanned each; extra columns are ignored; whole
texts are scanned whatever their length.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, map_batches, table

# Fixed values of the contract: kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

_NAME = "(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"
#: Values that stand where a credential would.  A quoted value runs to its closing
#: quote on the line; another (also after a quote that isn't closed) to white space
#: or the next credential's name, without delimiters at its end.  Each part scans
#: at most up to where the next match could begin, so that no length is bounded.
CONTEXTS = (
    re.compile(
        _NAME + r"""["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\x00-\x08\n-\x1f]{6,})"|'([^'\x00-\x08\n-\x1f]{6,})'|"""
        r"""(?:"(?![^"\x00-\x08\n-\x1f]*")|'(?![^'\x00-\x08\n-\x1f]*'))?"""
        r"""((?!["'])[<>,;]*+[^\x00-\x20"'<>,;]++(?:(?:["'<>]|[,;](?!["']?""" + _NAME + r"""["']?\x20*[:=]))++[^\x00-\x20"'<>,;]++)*+))""",
        re.IGNORECASE | re.ASCII,
    ),
    re.compile(r"(?:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]{8,})", re.IGNORECASE | re.ASCII),
    re.compile(r"(?<=[a-z0-9+.-]{2})://[^\s:/@]*:([^\s/@]{4,})@", re.IGNORECASE | re.ASCII),
)
MIN_VALUE = dict(zip(CONTEXTS, (6, 8, 4), strict=True))
#: Set on one half of a labelled table (``tests/llm/secret_values.py``), which the
#: other half measures.
MIN_GUESSES, MIN_PER_CHARACTER = 12.0, 0.9
#: What stands for a value: a call or an index of a name that has a path, is made of
#: words, or of a letter or two; a template's variable, a link, a sentence of five words.
_CALL = re.compile(r"([A-Za-z_][\w.:>-]*)\s*[(\[{]", re.ASCII)
_CODE = re.compile(r"[$%#]?[({<].*|\$[A-Za-z_].*|[A-Za-z][A-Za-z0-9+.-]*://.*", re.ASCII | re.DOTALL)
_PROSE = re.compile(r"(?:[A-Za-z\x80-\U0010ffff'’,.;:!?()-]+\s+){4,}[A-Za-z\x80-\U0010ffff'’,.;:!?()-]+", re.ASCII)

#: Words of credentials and of what stands in for them: in these contexts they
#: are guessed first, in this order.
CONTEXT_WORDS = (
    "password", "secret", "token", "key", "api", "your", "my", "the", "here", "example", "changeme", "placeholder", "test", "user", "admin", "none", "null",
    "true", "false", "env", "process", "config", "settings", "os", "environ", "get", "getenv", "self", "this", "string", "value", "name", "access", "auth",
    "client", "private", "default", "dummy", "sample", "replace", "insert", "enter", "with", "me", "app", "id", "login", "pass", "passwd", "credentials",
)
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_MAX_WORD = 24
_MAX_BLOCK = 24
_SEPARATORS, _BRACKETS = "_-. ", "(){}[]<>$"
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_M1, _D1, _Y2 = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])", r"\d\d"
#: Year, month and day in any usual order, with one separator or two digits each.
_DATE = re.compile(
    "|".join(
        [f"{a}{b}{c}" for y in (_YEAR, _Y2) for a, b, c in ((y, _MONTH, _DAY), (_DAY, _MONTH, y), (_MONTH, _DAY, y))]
        + [f"{a}{s}{b}{s}{c}" for s in ("-", "/", r"\.", "_") for y in (_YEAR, _Y2) for a, b, c in ((y, _M1, _D1), (_D1, _M1, y), (_M1, _D1, y))]
    ),
    re.ASCII,
)
_DATE_LENGTHS = range(6, 11)
_ONLY_YEAR = re.compile(_YEAR, re.ASCII)
_JOIN, _AGAIN, _STEP, _WALK = (math.log10(x) for x in (2, 1.2, 1.6, 47 * 2))
_ONE_DATE, _ONE_YEAR = math.log10(365 * 120), math.log10(120)
_LEET = str.maketrans("013457@$!", "oleastasi")


def _neighbours() -> dict[str, str]:
    """Keys next to each other in a row, and the keys below them."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for c, key in enumerate(row):
            around = [row[c + 1 : c + 2]] + [_ROWS[r + 1][k : k + 1] for k in (c - 1, c) if r + 1 < len(_ROWS) and k >= 0]
            for other in filter(None, around):
                near.setdefault(key, set()).add(other)
                near.setdefault(other, set()).add(key)
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEAR = _neighbours()


@functools.lru_cache(maxsize=4)
def word_ranks(path: str | None) -> dict[str, int]:
    """Rank of each whole ASCII word of three letters or more in the vocabulary,
    and of the words of the context."""
    ranks = {w: i + 1 for i, w in enumerate(CONTEXT_WORDS)}
    if path is not None:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        whole = [k[:-4] for k, _ in sorted(vocab.items(), key=lambda x: x[1]) if k.endswith("</w>")]
        whole = [w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha()]
        ranks = {w: i + 1 for i, w in enumerate(whole)} | ranks
    return ranks


def _cardinality(c: str) -> int:
    if c.isdigit():
        return 10
    if c.isascii() and c.isalpha():
        return 26
    return 4 if c in _SEPARATORS else 9 if c in _BRACKETS else 33 if c.isascii() else 100


def _lower(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def guess_cost(value: str, ranks: dict[str, int], known: dict[str, float] | None = None) -> float:
    """Least log10 guesses over all segmentations of ``value``.

    A segment costs the log of: rank of a word, at most 24 letters (times two if
    digit-for-letter swaps are undone, times two if capitals are); 365 * 120 for
    a date (120 for a year); for a block of at most 24 characters that is
    repeated, the least guesses of the block, and a factor 1.2 for each further
    copy; keys * turns for a keyboard walk, and a factor 1.6 for each step; 4 to
    100 per character by class for brute force.  Each further segment costs a
    factor 2.  ``known`` holds the costs of blocks seen.
    """
    n, lower, known = len(value), _lower(value), {} if known is None else known
    plain = lower.translate(_LEET)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    brute = walk = math.inf  # cheapest with an open segment of that kind that ends here
    # again[b][i]: cheapest with an open repeat of a block of b characters whose last copy ends at i.
    again: dict[int, dict[int, float]] = {}
    same = [0] * (_MAX_BLOCK + 1)  # for how many characters the value has had each period

    def repeats(i: int) -> None:
        for b in range(1, min(_MAX_BLOCK, i // 2) + 1):
            if same[b] >= b:
                block, ends = value[i - b : i], again.setdefault(b, {})
                if block not in known:
                    known[block] = guess_cost(block, ranks, known)
                opened = best[i - 2 * b] + (_JOIN if i > 2 * b else 0.0) + known[block]
                ends[i] = min(opened, ends.pop(i - b, math.inf)) + _AGAIN
                best[i] = min(best[i], ends[i])

    for i in range(n):
        repeats(i)  # then best[i] is final
        c, before = lower[i], best[i] + (_JOIN if i else 0.0)
        brute = min(brute, before) + math.log10(_cardinality(value[i]))
        step = i > 0 and c in NEAR.get(lower[i - 1], "")
        walk = min(walk + _STEP if step else math.inf, before + _WALK) if c in NEAR else math.inf
        best[i + 1] = min(best[i + 1], brute, walk)
        for j in range(i + 2, min(n, i + _MAX_WORD) + 1):
            for form, factor in ((lower[i:j], 1), (plain[i:j], 2)):
                if rank := ranks.get(form):
                    factor *= 1 if value[i:j] == lower[i:j] else 2
                    best[j] = min(best[j], before + math.log10(rank * factor + 1))
        if c.isdigit():
            if _ONLY_YEAR.match(value, i):
                best[i + 4] = min(best[i + 4], before + _ONE_YEAR)
            for j in _DATE_LENGTHS:
                if i + j <= n and _DATE.fullmatch(value, i, i + j):
                    best[i + j] = min(best[i + j], before + _ONE_DATE)
        for b in range(1, min(_MAX_BLOCK, i) + 1):
            same[b] = same[b] + 1 if value[i] == value[i - b] else 0
    repeats(n)
    return best[n]


def is_literal(value: str, ranks: dict[str, int], per_character: float = MIN_PER_CHARACTER) -> bool:
    """Whether a value is written out, and not an expression, a link or prose."""
    if _CODE.fullmatch(value) or _PROSE.fullmatch(value):
        return False
    name = call.group(1) if (call := _CALL.match(value)) else None
    return name is None or (len(name) > 2 and not re.search(r"\w[.:>]", name) and guess_cost(name, ranks) >= per_character * len(name))


def hard_to_guess(value: str, ranks: dict[str, int], min_guesses: float = MIN_GUESSES, per_character: float = MIN_PER_CHARACTER) -> bool:
    if not is_literal(value, ranks, per_character):
        return False
    cost = guess_cost(value, ranks)
    return cost >= min_guesses and cost >= per_character * len(value)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, ranks: dict[str, int], min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of hard-to-guess values in credential contexts."""
    spans = set()
    for pattern in CONTEXTS:
        m = pattern.search(text)
        while m:
            group = next(g for g in range(1, pattern.groups + 1) if m.group(g) is not None)
            short = m.end(group) - m.start(group) < MIN_VALUE[pattern]
            if not short and hard_to_guess(m.group(group), ranks, min_guesses):
                spans.add((m.start(group), 3, m.end(group)))
            m = pattern.search(text, m.start() + 1 if short else m.end())
    return sorted(spans)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(
    docs: DataFrame,
    vocabulary: str | None = None,
    min_guesses: float = MIN_GUESSES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and its spans: array<struct<start, kind, end, value>> by start."""
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(vocabulary)
        for batch in in_parts(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = sorted([*base_spans(text), *guess_spans(text, ranks, min_guesses)])
                out.append([{"start": s, "kind": KINDS[k], "end": e, "value": text[s:e]} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], ["doc_id", "found"])

    return map_batches(
        docs.select(id_col, text_col),
        scan, f"doc_id {id_type}, found array<struct<start: bigint, kind: string, end: bigint, value: string>>"
    )


def op2_secret_spans(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

    def digest(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> F.Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        counted("assign"),
        counted("access"),
        counted("hex"),
        F.sha2(digest(F.filter("found", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        digest(F.col("found")).alias("spans"),
        counted("guess"),
    )
