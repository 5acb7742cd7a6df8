"""Character trigrams of many texts at once, as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BITS = 21  # a code point has at most 21


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams, none across texts, and the place of the text of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    codes = points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:]
    within = of[:-2] == of[2:]
    return codes[within], of[:-2][within]


SLICE = 1 << 20  # characters


def sliced(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``SLICE`` characters, as each takes some fifty
    bytes on the way to its number; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > SLICE:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text and how often each occurs, taken a slice at a time."""
    codes, n = np.unique(trigrams([text[: SLICE + 2]])[0], return_counts=True)
    for i in range(SLICE, len(text) - 2, SLICE):
        more, m = np.unique(trigrams([text[i : i + SLICE + 2]])[0], return_counts=True)
        codes, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, m])).astype(np.int64)
    return codes, n


def spelled(code: int) -> str:
    mask = (1 << _BITS) - 1
    return "".join(chr(code >> s & mask) for s in (2 * _BITS, _BITS, 0))
