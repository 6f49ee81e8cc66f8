"""Word shingles of many texts at a time, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Texts are hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting beats the hash table of ``np.unique`` several times on millions of numbers."""
    ordered = np.sort(values)
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return ordered[fresh]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * PIECE_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, factor in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of lower-cased bytes: a polynomial of the bytes, mixed."""
    flat = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(flat) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[flat]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    up, down = power_tables(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[flat] * up[:len(flat)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > 2 * PIECE_BYTES:
        space = _SPACE.search(text, at + PIECE_BYTES)
        if not space:
            break
        yield text[at:space.start()]
        at = space.start()
    yield text[at:]


def _set_of(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) >= size:
        h = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            h = mixed(h * np.uint64(3) + words[k:len(words) - size + 1 + k])
        return distinct(h)
    if len(words):
        h = np.array([len(words)], np.uint64)
        for w in words:
            h = mixed(h * np.uint64(5) + w)
        return h
    return np.empty(0, np.uint64)


def shingle_sets(texts: list[bytes], size: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of every text (A-Z lower-cased).

    A text with fewer words has its whole sequence as only shingle, one without words has none.
    """
    result: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def close() -> None:
        nonlocal held
        if not group:
            return
        begins = np.cumsum([0, *(len(t) + 1 for t in group)])
        words, starts = word_hashes(b" ".join(group))
        cuts = np.searchsorted(starts, begins)
        result.extend(_set_of(words[cuts[k]:cuts[k + 1]], size) for k in range(len(group)))
        group.clear()
        held = 0

    for text in texts:
        text = text.lower()
        if len(text) > PIECE_BYTES:
            close()
            result.append(_set_of(np.concatenate([word_hashes(p)[0] for p in _pieces(text)]), size))
            continue
        group.append(text)
        held += len(text)
        if held >= PIECE_BYTES:
            close()
    close()
    return result
