"""Hashes of words and word runs, vectorised over the bytes of many texts."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word per text) of the maximal runs of word bytes inside each text.

    ``is_word`` says for each of the 256 byte values whether it belongs to a word.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    change = np.empty(len(raw) + 1, bool)
    change[0], change[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    edges = np.flatnonzero(change)
    starts, ends = edges[0::2], edges[1::2]
    # a run that goes on into the next text is two words
    at = np.unique(offsets[1:-1])
    at = at[(at > 0) & (at < len(raw))]
    at = at[inside[at] & inside[at - 1]] if len(at) else at
    if len(at):
        starts = np.sort(np.concatenate([starts, at]))
        ends = np.sort(np.concatenate([ends, at]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``raw[start:end]``: a polynomial over the bytes, finalised."""
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, picks: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the words at ``picks`` after each position that has them all."""
    n = len(words) - int(picks[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for p, c in zip(picks, constants(len(picks), seed)):
        out += words[p : p + n] * c
    return mix(out)
