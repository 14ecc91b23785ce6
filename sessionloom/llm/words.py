"""Words of many texts at once: 64-bit hashes from byte tables, in numpy."""

from __future__ import annotations

import numpy as np

#: Base of the polynomial word hash (odd, so it has an inverse modulo 2^64), and that inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; runs are cut between words.
RUN = 1 << 20


def table_of(word) -> np.ndarray:
    """For each byte its value after lower-casing A-Z, plus 1, or 0 where ``word(byte)`` is false."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([x + 1 if word(x) else 0 for x in low], np.uint16)


#: Everything but space and \x09-\x0D.
SPACED = table_of(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, letters and all beyond ASCII.
ALNUM = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))


_POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads nearby values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a run that is cut between words."""
    edge = np.diff((values > 0).astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.empty(0, np.uint64)
    _POWERS.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _POWERS.up[: len(values)], out=total[1:])
    found = (total[stop] - total[start]) * _POWERS.down[start]
    return start, mixed(found + (stop - start).astype(np.uint64))


def word_hashes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0, *(len(d) + 1 for d in data)])
    values = table[np.frombuffer(b" ".join([*data, b""]), np.uint8)]
    where, hashes, at = [], [], 0
    while at < len(values):
        stop = min(at + RUN, len(values))
        while stop < len(values) and values[stop - 1]:
            stop += 1
        s, h = _hashes(values[at:stop])
        where.append(s + at)
        hashes.append(h)
        at = stop
    where = np.concatenate([*where, np.empty(0, np.int64)])
    counts = np.diff(np.searchsorted(where, starts))
    return np.concatenate([*hashes, np.empty(0, np.uint64)]), counts
