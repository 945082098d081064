"""Statistics of whole texts, one row of numbers a text, from byte histograms and word codes."""

from __future__ import annotations

import numpy as np

from larkspur.llm.common import WordCodes, window_hashes, word_codes

#: Words are runs of anything but space and the ASCII controls from tab to carriage return; bytes.split() cuts there.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "shouts", "distinct", "runs", "line_words", "foreign", "one_letter", "entropy")

_BYTES = np.arange(256)
_IS = {
    "space": np.isin(_BYTES, [32, *range(9, 14)]),
    "symbol": np.isin(_BYTES, list(SYMBOLS)),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "mark": np.isin(_BYTES, list(b".,;:?'\"()-")),
    "shout": np.isin(_BYTES, list(b"!@~^_=+{}[]\\/")),
    "inner": (_BYTES >= 128) & (_BYTES < 192),
    "lead": _BYTES >= 192,
}
_TABLE = np.stack([_IS[k] for k in _IS], axis=1).astype(np.float64)


def repeated_words(codes: np.ndarray, k: int = 3) -> int:
    """Words in k-word windows that occur twice or more in the text, the first occurrence included."""
    h = window_hashes(codes, k)
    if len(h) < 2:
        return 0
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(codes), bool)
    for j in range(k):
        covered[j : j + len(h)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def text_stats(texts: list[bytes], cache: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS as a long matrix and SHARES as a double matrix. An empty text has zeros."""
    counts, shares = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(SHARES)))
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not text:
            continue
        byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        space, symbol, upper, lower, digit, mark, shout, inner, lead = byte @ _TABLE
        chars = len(text) - inner - space
        n_lines, dup = duplicate_lines(text)
        codes = word_codes(words, cache)
        repeats = repeated_words(codes)
        counts[i] = n, chars, symbol, dup, repeats
        if not n:
            continue
        letters = max(1.0, upper + lower + lead)
        used = byte[byte > 0] / len(text)
        shares[i] = (
            chars / n, symbol / chars, dup / n_lines, repeats / n, upper / letters, digit / chars, mark / chars, shout / chars,
            len(np.unique(codes)) / n, (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0, np.log1p(n / n_lines), lead / letters,
            sum(len(w) == 1 for w in words) / n, -(used * np.log2(used)).sum(),
        )
    return counts, shares
