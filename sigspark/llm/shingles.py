"""Word shingles of many texts at once, as sorted 64-bit hashes, computed with numpy over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WIDTH = 5
# Bytes of texts that are worked on together; a longer text is worked on alone.
CHUNK_BYTES = 400_000
# Texts of a column that are made Python objects at once.
PIECE_ROWS = 500

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_JOIN = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(size, U(base))
                powers[0] = U(1)
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, UTF-8 of a few texts in a row)."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """``chunks`` of a column, whose texts are never all made Python objects at once."""
    for at in range(0, len(texts), PIECE_ROWS):
        for first, held in chunks(texts.slice(at, PIECE_ROWS).to_pylist()):
            yield at + first, held


def sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hashes, bounds), ascending within bounds[i]:bounds[i+1].

    Words are what stands between ASCII white space, A-Z as a-z. A text of fewer than five words has all of
    them as its one shingle; a text without words has none.
    """
    raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    space = _SPACE[raw]
    inside = np.concatenate(([False], ~space, [False]))
    begin = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(~inside[1:] & inside[:-1])
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    none = np.zeros(len(texts) + 1, np.int64)
    if not len(begin):
        return np.zeros(0, U), none
    up, down = _POWERS.get(len(raw) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * up[:-1], dtype=U)))
    words = mix((total[end] - total[begin]) * down[begin])
    owner = np.searchsorted(ends_of_texts, begin, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    # runs of five; the words of a short text alone, told apart by their number
    n = len(words)
    if n >= WIDTH:
        run = words[: n - 4].copy()
        for k in range(1, WIDTH):
            run = mix(run * _JOIN + words[k : n - 4 + k])
        whole = owner[: n - 4] == owner[4:]
        hashes, whose = run[whole], owner[: n - 4][whole]
    else:
        hashes, whose = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = np.zeros(len(short), U)
        for k in range(WIDTH - 1):
            there = counts[short] > k
            extra[there] = mix(extra[there] * _JOIN + words[first[short[there]] + k] + U(k + 1))
        hashes, whose = np.concatenate((hashes, extra)), np.concatenate((whose, short))
    order = np.lexsort((hashes, whose))
    hashes, whose = hashes[order], whose[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1])
    hashes, whose = hashes[fresh], whose[fresh]
    none[1:] = np.cumsum(np.bincount(whose, minlength=len(texts)))
    return hashes, none


def signature(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit number per set, equal for equal sets; 0 for the empty set."""
    out = np.zeros(len(bounds) - 1, U)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), bounds[full]) + np.diff(bounds)[full].astype(U))
        out[full] |= U(1)
    return out
