"""Vectorised scanning of many texts at once: words, word hashes and shingle hashes as numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of _BASE modulo 2^64.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _word_bytes(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


SPACES = b" \t\n\x0b\x0c\r"
#: ASCII signs that matching leaves out, as white space.
SIGNS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_PLAIN, _MATCHING = _word_bytes(SPACES), _word_bytes(SPACES + SIGNS)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts, in order: text index, first and last byte, 64-bit hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    data: np.ndarray
    per_text: np.ndarray


def lowered(text: bytes) -> bytes:
    """Every capital as its small letter, code point by code point: no letter depends on its place in a word, none becomes two."""
    if text.isascii():
        return text.lower()
    # str.lower() ends words with another sigma and gives the dotted I a mark of its own
    return text.decode("utf-8", "surrogateescape").replace("Σ", "σ").replace("İ", "i").lower().encode("utf-8", "surrogateescape")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, kept for the longest slice so far; those of a very long text are not."""
    if len(_powers.known[0]) >= n:
        return tuple(x[:n] for x in _powers.known)
    made = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, _INVERSE))
    if n <= 1 << 21:
        _powers.known = made
    return made


_powers.known = (np.zeros(0, np.uint64),) * 2


def words(texts: list[bytes], matching: bool = False, hashes: bool = True) -> Words:
    """matching: case and ASCII signs are levelled, so only letters and digits count."""
    if matching:
        texts = [lowered(t) for t in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    is_word = (_MATCHING if matching else _PLAIN)[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(stops, start, side="right")
    value = None
    if hashes:
        power, undo = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64, out=total[1:])
        value = mix((total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))
    return Words(text, start, end, value, data, np.bincount(text, minlength=len(texts)))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of `width` words within a text, in order."""
    n = len(w.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * _BASE + w.hash[j : j + n]
    whole = w.text[:n] == w.text[width - 1 :]
    return w.text[:n][whole], mix(h[whole] + np.uint64(width))
