"""Rolling hashes, words and winnowed segments of texts, vectorised inside tasks.

Texts arrive in Arrow batches; every helper here works on one text (its UTF-8
bytes or its word hashes) and holds memory in proportion to one block of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
HIGH = U(0xFFFFFFFF00000000)
LOW = U(0x00000000FFFFFFFF)
BLOCK = 1 << 20  # positions handled at once in a long text

# White space that parts words in the contracts on prose: blank and 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but digits and letters parts words in the other contracts.
SYMBOLS = np.ones(256, bool)
SYMBOLS[0x30:0x3A] = SYMBOLS[0x41:0x5B] = SYMBOLS[0x61:0x7B] = SYMBOLS[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_random = np.random.Generator(np.random.PCG64(20240131))
BYTE_CODES = _random.integers(0, 1 << 64, 256, dtype=np.uint64) | U(1)
_powers = {True: np.ones(1, U), False: np.ones(1, U)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 to BASE**(n-1), or of its inverse, modulo 2^64."""
    have = _powers[inverse]
    if len(have) < n:
        step = U(INVERSE if inverse else BASE)
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, step, U)
        have[0] = 1
        _powers[inverse] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix hash of a sequence of 64-bit codes."""
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every [start, end) from prefix sums; equal spans get equal hashes."""
    if not len(prefix):
        return np.zeros(0, U)
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts])


def gram_hashes(codes: np.ndarray, k: int, prefix: np.ndarray | None = None) -> np.ndarray:
    """Hash of every run of ``k`` codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = prefix_sums(codes) if prefix is None else prefix
    return mix((sums[k:] - sums[:n]) * powers(len(sums), inverse=True)[:n])


def word_bounds(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_codes(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a text."""
    starts, ends = word_bounds(data, separators)
    return span_hashes(prefix_sums(BYTE_CODES[data]), starts, ends), starts, ends


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive keys."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cut_segments(codes: np.ndarray, length: int, k: int, salt: int = 0):
    """Partition the windows of ``length`` codes by their smallest k-gram hash.

    Windows in a row that share their smallest k-gram form one segment.  Equal
    windows have equal smallest k-grams at equal offsets, so all copies of a
    window lie in segments with the same anchor.  Yields, by block of a long
    sequence, arrays (anchor, content hash, first window, windows, anchor place).
    """
    windows = len(codes) - length + 1
    for at in range(0, max(windows, 0), BLOCK):
        part = codes[at : at + BLOCK + length - 1]
        sums = prefix_sums(part)
        grams = gram_hashes(part, k, sums)
        order = mix(grams ^ U(salt)) if salt else grams
        keys = (order & HIGH) | np.arange(len(grams), dtype=U)
        place = (sliding_minimum(keys, length - k + 1) & LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(first, append=len(place))
        anchors = place[first]
        content = span_hashes(sums, first, first + count + length - 1)
        content = mix(content ^ (((anchors - first) << 32) + count).astype(U))
        yield grams[anchors], content, first + at, count, anchors + at


def texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """UTF-8 bytes of every value of an Arrow string column, without copies."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else []
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[bounds[i] : bounds[i + 1]] if valid[i] else None


def rows_in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Collect Python rows into Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def cover(n: int, starts, ends) -> np.ndarray:
    """Positions below ``n`` that lie in any [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(starts, n), 1)
    np.add.at(steps, np.minimum(ends, n), -1)
    return np.cumsum(steps[:n]) > 0
