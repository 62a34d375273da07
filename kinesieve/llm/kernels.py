"""Vectorised byte and word kernels that the operators run inside Spark tasks.

All of them work on a block of texts at once, so that the cost per document stays small
for short documents and the memory stays bounded by the block for long ones.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial hashes and the constants of the finaliser (fixed values).
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(MIX_1)
    x = x ^ (x >> U64(27))
    x = x * U64(MIX_2)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and its inverse modulo 2**64, for i below n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        for name, base in (("up", MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], equal for equal bytes wherever they lie."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + mix((ends - starts).astype(U64)))


def chain_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` neighbouring 64-bit values (order matters)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = mix(out + values[k : k + n])
    return out


def normalise(text: str | None) -> bytes:
    """Words of the text, A-Z lower-cased, joined by one space; null has no words."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of normalised texts, and the bounds of each text in them."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    joined = b"\n".join(texts)
    if not joined.strip(b"\n"):
        return np.zeros(0, U64), bounds
    data = np.frombuffer(joined, np.uint8)
    breaks = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate(([0], breaks + 1))
    ends = np.concatenate((breaks, [len(data)]))
    full = ends > starts
    starts, ends = starts[full], ends[full]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text_ends = np.cumsum(lengths + 1) - 1
    bounds[1:] = np.searchsorted(starts, text_ends)
    return span_hashes(data, starts, ends), bounds


def blocks(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Neighbouring items in blocks of at most `limit` in sum, or of one larger item."""
    out, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            out.append((first, i))
            first, total = i, 0
        total += int(size)
    if first < len(sizes):
        out.append((first, len(sizes)))
    return out


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(blob, dtype)


def first_of_runs(ordered: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array takes a new value."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
