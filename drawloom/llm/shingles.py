"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A 64-bit value for each byte, and the base of the polynomial over them and its inverse.
BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of text that are hashed in one piece.
PIECE = 1 << 18


class _Powers:
    """Powers of the base and of its inverse, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_U(BASE), _U(INVERSE)))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of lower-cased bytes: runs without spaces, tabs and line ends."""
    a = np.frombuffer(raw, np.uint8)
    blank = np.concatenate([[True], BLANK[a], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = POWERS.upto(len(a) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(BYTES[a] * up[:-1], dtype=_U)])
    return start, _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The set of each text: hashes of its ``k``-word shingles, sorted; of all its words if they are fewer; empty without words."""
    out: list[np.ndarray] = []
    at = 0
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= PIECE):
            size += len(raws[end]) + 1
            end += 1
        out += _sets(raws[at:end], k)
        at = end
    return out


def _sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    start, h = word_hashes(b"\n".join(raws))
    begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
    cut = np.searchsorted(start, begin)  # words of text i: cut[i] to cut[i + 1]
    words = np.diff(cut)
    n = len(h)
    shingle = np.zeros(n, _U)
    for j in range(k):
        part = h[j:] * _U((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        shingle[: max(n - j, 0)] += part
    of = np.repeat(np.arange(len(raws)), words)
    full = np.arange(n) + k <= cut[1:][of]
    short = {}
    for i in np.flatnonzero((words > 0) & (words < k)):
        own = h[cut[i] : cut[i + 1]]
        short[int(i)] = _mix(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(own)) + len(own) & (1 << 64) - 1], _U))
    s, of = _mix(shingle[full]), of[full]
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[new], of[new]
    bounds = np.searchsorted(of, np.arange(len(raws) + 1))
    return [short.get(i, s[bounds[i] : bounds[i + 1]]) for i in range(len(raws))]


def identity(own: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    if not len(own):
        return 0
    total = np.add.reduce(_mix(own ^ _U(0xA0761D6478BD642F)))
    return int(_mix(np.array([int(total) + len(own) * 0xE7037ED1A0B428DB & (1 << 64) - 1], _U)).view(np.int64)[0])


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0
