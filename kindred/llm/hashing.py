"""Words of many texts at once: numpy arrays of word hashes over concatenated UTF-8 bytes.

Hashes are 64-bit values of random byte polynomials. Two given different words collide with a chance of about 2**-64.
"""

from functools import lru_cache

import numpy as np

_SEED = np.random.default_rng(20240601)
BYTE_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
WINDOW_BASE = 0xD6E8FEB86659FD93
CHUNK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    size = CHUNK * 2
    while size < n:
        size *= 2
    return _powers(base, size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def chunks(texts: list, limit: int = CHUNK):
    """(index of the first text, texts as UTF-8) of about `limit` bytes; a null text is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        held.append(data)
        size += len(data) + 1
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def split_words(data: list[bytes], separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, word starts, word ends and, for each text, its first word (with a last entry for the end)."""
    buffer = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    starts, ends = runs(~separator[buffer])
    at = np.cumsum([0] + [len(x) + 1 for x in data])
    return buffer, starts, ends, np.searchsorted(starts, at)


def hash_words(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(buffer)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * powers(BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of `width` values, by doubling: width 35 is 32 + 2 + 1."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    power, length, base = words, 1, WINDOW_BASE
    out, done = None, 0
    left = width
    while left:
        if left & 1:
            part = power[done : done + len(words) - width + 1]
            out = part.copy() if out is None else out * np.uint64(base) + part
            done += length
        left >>= 1
        if left:
            power = power[:-length] * np.uint64(base) + power[length:]
            length, base = length * 2, base * base % 2**64
    return mix(out)
