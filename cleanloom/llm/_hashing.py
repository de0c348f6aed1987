"""Vectorised hashing of words and word shingles: whole texts in, numpy arrays out. It runs in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Words beyond this many bytes are hashed one by one.
_LONG = 64
#: Texts are hashed together up to so many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def chunks(texts: list[bytes]):
    """(first index, texts) of runs that hold about CHUNK bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def slices(column: pa.Array):
    """(first index, texts) of runs of an Arrow column that hold about CHUNK bytes; only one run at a time is unpacked. Null is empty."""
    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield first, [t or b"" for t in column.slice(first, last - first).to_pylist()]
        first = last


def packed(values: np.ndarray, delta: bool = False) -> bytes:
    """Unsigned integers, or the steps between sorted ones, byte plane by byte plane and compressed."""
    values = values.astype("<u8")
    if delta:
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if delta else values


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (A-Z in lower case), in order, and the bounds of each text's words among them."""
    buffer = b"\n".join(texts) + b"\n" + bytes(8)
    data = _LOWER[np.frombuffer(buffer, np.uint8)]
    used = len(buffer) - 8
    space = _SPACE[data[:used]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if used and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    length = end - start
    eight = np.ndarray((used,), "<u8", data, strides=(1,))
    left = length.copy()
    h = (length.astype(np.uint64) + _A) * _B
    live, at = np.arange(len(start)), start.copy()
    for _ in range(_LONG // 8):
        if not len(live):
            break
        word = eight[at] & _MASK[np.minimum(left, 8)]
        h[live] = mix(h[live] * _A ^ word)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    stops = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return h, np.concatenate(([0], np.searchsorted(start, stops)))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text of fewer words than the width has its whole word sequence as the only one; a text without words has none.
    """
    out: list[np.ndarray] = []
    for _, part in chunks(texts):
        h, bounds = token_hashes(part)
        n = len(h) - width + 1
        if n > 0:
            acc = np.full(n, width, np.uint64)
            for j in range(width):
                acc = mix(acc * _A ^ h[j : j + n])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(acc[a : b - width + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    one = mix(one * _A ^ x)
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
