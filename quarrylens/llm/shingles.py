"""Word shingles as hashed sets, computed on bytes, many texts at a time."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = 512  # texts handled at once, which bounds the memory
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting, which is faster here than hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _A)
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _B, np.uint64)]))


def _words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text)."""
    buf = np.frombuffer(b"\n" + b"\n".join(bodies) + b"\n", np.uint8)
    is_word = _WORD_BYTE[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.array([len(b) + 1 for b in bodies], np.int64)) + 1
    count = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    if not len(start):
        return np.zeros(0, np.uint64), count
    n = end - start
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first, n)
    power = _POWER if at.max() < len(_POWER) else np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(at.max()), _B, np.uint64)]))
    return mix(np.add.reduceat(_BYTE[buf[is_word]] * power[at], first) + n.astype(np.uint64)), count


def shingle_sets(texts: list[str | None], n_words: int) -> list[np.ndarray]:
    """The sorted hashes of every run of n_words consecutive words (runs of a-z and 0-9 in the lower-cased text); empty for a
    null text or one with fewer words."""
    out: list[np.ndarray] = []
    for lo in range(0, len(texts), _STEP):
        h, counts = _words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts[lo : lo + _STEP]])
        r = h[: max(0, len(h) - n_words + 1)].copy()
        for k in range(1, n_words):
            r = r * _A + h[k : k + len(r)]
        r, at = mix(r), 0
        for n in counts.tolist():
            if n >= n_words:
                s = r[at : at + n - n_words + 1].copy()
                s.sort()
                new = s[1:] != s[:-1]
                out.append(s if new.all() else s[np.concatenate([[True], new])])
            else:
                out.append(r[:0])
            at += n
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each non-empty set that depend on its members only, as two signed 64-bit numbers."""
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.add.reduceat(mix(x ^ _B), first).view(np.int64), np.add.reduceat(mix(x + _A), first).view(np.int64)
