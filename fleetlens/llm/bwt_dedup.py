"""Suffix-array dedup by merging Burrows-Wheeler transforms.

Texts are cut into segments around winnowed anchors (see ``anchors``), so that
equal windows of 100 bytes meet in one group whatever documents they are in.
A group is dealt out to shards of bounded size.  Each shard yields its
transform: the symbols before its suffixes in sorted order.  The transforms
are merged by refining their interleave: first all suffixes form one block,
then each round sorts the interleave stably by the symbols before, so that
after h rounds suffixes are grouped by their first h symbols.  The round in
which a border appears is the length of the common prefix there; borders that
never appear leave intervals of suffixes that share a whole window.  No suffix
of a shard is sorted again.

Symbols are 10 bytes wide: a suffix's chain takes every tenth byte, ranks of
10-byte strings are the alphabet, and ten rounds cover a window.

Bytes of windows that start earlier (smaller doc_id, then smaller start) are
removed.  Null texts count as empty.  Repeated rows (equal doc_id and text) are
one document; rows that share only the doc_id are in order of a digest of
their text.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import anchors as A
from fleetlens.llm import textblocks as B

LENGTH = 100  # bytes of a window
SEED = 24  # bytes of an anchor
WIDE = 10  # bytes of a symbol
TARGET = 48_000  # bytes of text that are merged at once
SHARD = 12_000  # bytes of a shard


def byte_units(data: np.ndarray) -> np.ndarray:
    return B.BYTE_CODES[data]


def _piece(data: np.ndarray):
    return lambda low, high: data[low:high].tobytes()


def stable_order(ranks: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers by radix, 16 bits at a time."""
    order = np.argsort((ranks & 0xFFFF).astype(np.uint16), kind="stable")
    top = int(ranks.max(initial=0)) >> 16
    while top:
        ranks = ranks >> 16
        order = order[np.argsort((ranks[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        top >>= 16
    return order


def symbols(data: np.ndarray, ends: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """Rank, from 1, of the ``wide`` bytes at every place, ended by the string's end."""
    half = wide // 2
    n = len(data)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # bytes to the string's end
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(wide, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(half):
        key = key * np.uint64(257) + np.where(left > j, padded[j : j + n], np.uint64(0))
    _, first = np.unique(key, return_inverse=True)
    second = np.zeros(n, np.int64)
    second[: n - half] = first[half:] + 1
    second[left <= half] = 0
    _, rank = np.unique(first.astype(np.int64) * (n + 2) + second, return_inverse=True)
    return rank.astype(np.int64) + 1


class Shard:
    """Sorted suffixes of some strings and their transform.

    ``order`` holds the places (numbers in the group) of the suffixes, sorted by
    ``depth`` symbols.  ``before`` is the symbol before each entry, 0 where a
    string's chain begins; the empty suffixes at the chains' ends come first.
    """

    def __init__(self, low: int, high: int, rank: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int, wide: int) -> None:
        places = np.arange(low, high)
        begins = left[low:high] < wide  # no symbol before
        last = places[right[low:high] <= wide]  # the chain's last symbol
        order = places
        for _ in range(depth):
            before = np.concatenate([last, order[~begins[order - low]] - wide])
            order = before[stable_order(rank[before])]
        self.order = order
        self.n_empty = len(last)
        self.before = np.concatenate([rank[last], np.where(begins[order - low], 0, rank[np.maximum(order - wide, 0)])])


def interleave(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every suffix in merged order, and the common prefix with the one before, in symbols (``depth`` at most)."""
    empties = np.repeat(np.arange(len(shards)), [s.n_empty for s in shards])
    which = np.repeat(np.arange(len(shards)), [len(s.order) for s in shards])
    before = np.concatenate([s.before for s in shards])
    block = np.zeros(len(which), np.int64)  # the empty suffixes stand apart after the first round
    prefix = np.full(len(which), depth)
    prefix[:1] = 0
    for h in range(depth):
        every = np.concatenate([empties, which])
        symbol = np.empty(len(every), np.int64)
        symbol[stable_order(every)] = before  # each shard's symbols in its own order
        has = symbol > 0
        order = stable_order(symbol[has])
        source = np.concatenate([np.zeros(len(empties), np.int64), block])[has][order]
        which, symbol = every[has][order], symbol[has][order]
        border = np.append(True, (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1]))
        prefix[border & (prefix == depth)] = h
        block = np.cumsum(border)
    return which, prefix


def repeated_intervals(contents: list[np.ndarray], windows: np.ndarray, length: int = LENGTH, wide: int = WIDE, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Window starts (as places in the joined contents) that share a window with another, and their interval's number."""
    data = np.concatenate(contents)
    sizes = np.array([len(c) for c in contents])
    ends = np.cumsum(sizes)
    begin = np.repeat(ends - sizes, sizes)
    left = np.arange(len(data)) - begin
    right = np.repeat(sizes, sizes) - left
    rank = symbols(data, ends, wide)
    bounds, low = [], 0
    size = max(shard, len(data) // 64)
    for end in ends.tolist():  # whole strings to a shard
        if end - low >= size or end == ends[-1]:
            bounds.append((low, end))
            low = end
    depth = length // wide
    shards = [Shard(a, b, rank, left, right, depth, wide) for a, b in bounds if b > a]
    which, prefix = interleave(shards, depth)
    merged = np.empty(len(which), np.int64)
    merged[stable_order(which)] = np.concatenate([s.order for s in shards])
    is_window = left[merged] < np.repeat(windows, sizes)[merged]
    interval = np.cumsum(prefix < depth)[is_window]
    merged = merged[is_window]
    times = np.bincount(interval, minlength=1)
    shared = times[interval] > 1
    return merged[shared], interval[shared]


def later_windows(columns: dict, length: int = LENGTH, wide: int = WIDE) -> list[np.ndarray]:
    """For every segment, which of its windows start earlier in another one."""
    contents, windows = columns["content"], columns["windows"]
    place, interval = repeated_intervals(contents, windows, length, wide)
    sizes = np.array([len(c) for c in contents])
    row = np.repeat(np.arange(len(contents)), sizes)[place]
    start = place - (np.cumsum(sizes) - sizes)[row]
    at = columns["first"][row] + start
    order = np.lexsort((at, columns["version"][row], columns["doc_id"][row], interval))
    later = order[1:][interval[order][1:] == interval[order][:-1]]
    masks = [np.zeros(w, bool) for w in windows]
    for r, s in zip(row[later].tolist(), start[later].tolist()):
        masks[r][s] = True
    return masks


def mark_repeats(docs: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """doc_id, version, text and the spans of windows that start earlier, of every document."""
    return A.repeated(A.versioned(docs), byte_units, length, k, True, _piece, lambda c: later_windows(c, length), TARGET)


def _removed(batch: pa.RecordBatch, length: int, spans: str = "spans") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for data, (first, windows) in zip(B.texts(batch.column("text")), A.spans_of(batch.column(spans))):
        data = np.zeros(0, np.uint8) if data is None else data
        yield data, B.cover(len(data), first, first + windows + length - 1) if len(first) else np.zeros(len(data), bool)


def deduplicated(docs: DataFrame, length: int = LENGTH, k: int = SEED, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (or their digest)."""
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, gone in _removed(batch, length):
                rest = data[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), len(B.runs(gone)[0]), hashlib.sha256(rest).hexdigest() if digest else rest))
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    marked = mark_repeats(docs, length, k).select("doc_id", "text", "spans")
    return marked.mapInArrow(kept, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {name} {kind}")


def cut_documents(docs: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """The rows of ``docs`` with their columns, repeated bytes cut out of the text.

    Characters of which a byte is lost go as a whole.  Documents of which
    nothing is left go too; those that had no text stay as they are.
    """
    columns, schema = docs.columns, docs.schema
    plain = A.versioned(docs)
    marked = A.stored(A.marks(A.segments(plain, byte_units, length, k), True))
    more = A.settled(A.contents(plain, marked, byte_units, length, k, _piece), byte_units, length, True, lambda c: later_windows(c, length), TARGET)
    spans = A.all_spans(marked, more).withColumnsRenamed({"doc_id": "__id", "version": "__version", "spans": "__spans"})
    same = docs["doc_id"].cast("bigint").eqNullSafe(spans["__id"]) & A.version_of(docs["text"]).eqNullSafe(spans["__version"])
    both = docs.join(spans, same, "left").select(*[docs[c] for c in columns], "__spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for valid, (data, gone) in zip(batch.column("text").is_valid().to_pylist(), _removed(batch, length, "__spans")):
                if gone.any():
                    inner = (data & 0xC0) == 0x80  # a character's later bytes
                    character = np.cumsum(~inner) - 1
                    lost = np.bincount(character, gone) > 0
                    rest = data[~lost[character]]
                else:
                    rest = data
                keep.append(len(rest) > 0 or not len(data))
                texts.append(rest.tobytes().decode() if valid else None)
            whole = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield whole.select(columns).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(cut, schema)
