"""Distinct word shingles of many texts at once, as 64-bit hashes, by arithmetic on whole arrays."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F))
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * _MIX[0]
        h = h ^ (h >> np.uint64(27))
        h = h * _MIX[1]
        return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        with np.errstate(over="ignore"):
            for name, r in (("up", _R), ("down", _R_INV)):
                p = np.full(max(n, 1 << 16), r, np.uint64)
                p[0] = 1
                _tables[name] = np.cumprod(p)
    return _tables["up"], _tables["down"]


def _alnum() -> np.ndarray:
    """For each code point: a letter or a digit."""
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _tables["alnum"]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text), in order. Words are maximal runs of letters or digits after lower-casing."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    is_word = _alnum()[cp]
    edge = np.diff(is_word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(cp) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=prefix[1:])
        h = mix((prefix[end] - prefix[start]) * down[start])
    bounds = np.cumsum([len(t) + 1 for t in low])
    return h, np.searchsorted(bounds, start, side="right")


def shingles(h: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of the distinct runs of ``size`` words of each text, sorted by both."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for k in range(size):
            s += h[k : k + n] * (_POS[k % 5] + np.uint64(2 * (k // 5)))
    inside = of[:n] == of[size - 1 :]
    s, d = mix(s[inside]), of[:n][inside]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]
