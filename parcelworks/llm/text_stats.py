"""Counts on whole texts that the quality operators share; numpy and bytes inside a task."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first one included.
    Windows are named exactly: pairs of equal halves get equal numbers, doubling up to the width."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        pairs = code[:-width] * (int(code.max()) + 1) + code[width:]
        width *= 2
        if width == window:
            order = np.argsort(pairs, kind="stable")
            same = pairs[order[1:]] == pairs[order[:-1]]
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
        else:
            code = np.unique(pairs, return_inverse=True)[1]
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps) > 0).sum())


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text and its words."""
    solid = b"".join(words)
    chars = len(solid) - len(solid.translate(None, _HEADS))  # bytes that begin a code point
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


#: Bytes that begin a code point: all but continuation bytes.
_HEADS = bytes(b for b in range(256) if b & 0xC0 != 0x80)
