"""Byte-level BPE: encoding by tree concatenation, and decoding.

Text is parted as the vocabulary's pattern says, and the parts are merged by
rank.  A long unsplit part is halved until it is short; the halves are encoded
on their own, then around each join a window of tokens is encoded again and
widened until its first and last token are those that both sides had there.
Such a window is exact: a token sequence is the BPE of its bytes when every
two neighbours are, and beyond the window no neighbours change.

Long documents are cut into pieces which are encoded as rows of their own, in
parallel; pieces of one long part are joined as above when the document's
tokens come together.

Null texts count as empty: no tokens.  Rows that repeat give equal rows.  The
special string of the vocabulary becomes its id, as the vocabulary's own
library does it.  Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B

# How byte-level vocabularies part text (fixed).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 128  # bytes of a part that are merged at once
CHUNK = 1 << 15  # bytes of a piece of a long document
CACHED = 200_000  # parts whose tokens a worker remembers
WHOLE, PART, SPECIAL = 0, 1, 2  # kinds of pieces
BETWEEN = b"\xff"  # parts the parts of a whole piece; no UTF-8 text has this byte


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class Vocabulary:
    """Merge ranks, token bytes and special strings of a byte-level vocabulary file."""

    _loaded: dict[str, "Vocabulary"] = {}

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.token_bytes = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_ids[symbols[token]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.token_bytes.update({i: s.encode() for s, i in self.special.items()})
        self.pattern = regex.compile(PATTERN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ids_of = {token: i for i, token in self.token_bytes.items() if i not in self.special.values()}
        self.longest = max(map(len, self.ids_of), default=1)
        self.fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def of(cls, content: str) -> "Vocabulary":
        """One vocabulary per worker, loaded once."""
        if content not in cls._loaded:
            cls._loaded[content] = cls(content)
        return cls._loaded[content]

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a stretch: the lowest rank first, from the left."""
        return self._match(data) if len(data) <= SHORT else self._merge_long(data)

    def _match(self, data: bytes) -> list[int]:
        """Tokens of a short stretch by longest matches that fit their left neighbour.

        The tokens of a stretch are the only cover in which every neighbouring
        pair is the BPE of its bytes, so a search that steps back where no match
        fits ends at them; a place that failed once is not tried again.
        """
        fits, known, ids, ends, failed = self.fits, self.ids_of, [], [0], set()
        at, n = 0, len(data)
        end = n
        while at < n:
            end = min(end, at + self.longest)
            last = ids[-1] if ids else -1
            while end > at:
                if end not in failed and (i := known.get(data[at:end])) is not None:
                    ok = fits.get((last, i))
                    if ok or ok is None and self._fit(last, i):
                        break
                end -= 1
            if end > at:
                ids.append(i)
                ends.append(end)
                at, end = end, n
            elif not ids:
                return self._merge_ranks(data)
            else:
                failed.add(at)
                ids.pop()
                end = ends.pop() - 1
                at = ends[-1]
        return ids

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens (or one alone) are the BPE of their bytes."""
        if len(self.fits) >= 10 * CACHED:
            self.fits.clear()
        pair = [right] if left < 0 else [left, right]
        self.fits[left, right] = ok = self._merge_ranks(b"".join(self.token_bytes[i] for i in pair)) == pair
        return ok

    def _merge_ranks(self, data: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in data]
        merges = self.merges
        while len(ids) > 1:
            found = [merges.get(pair) for pair in zip(ids, ids[1:])]
            best = min((f for f in found if f), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i < len(found) and found[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a queue of pairs, for windows that had to grow."""
        n = len(data)
        ids = [self.byte_ids[b] for b in data]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(*m, i) for i, pair in enumerate(zip(ids, ids[1:])) if (m := self.merges.get(pair))]
        heapify(queue)
        while queue:
            rank, made, i = heappop(queue)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.merges.get((ids[i], ids[j])) != (rank, made):
                continue  # one of the two has merged with another meanwhile
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merges.get((made, ids[k])):
                    heappush(queue, (*m, i))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], made))):
                heappush(queue, (*m, h))
        return [x for x in ids if x >= 0]

    def encode_part(self, data: bytes) -> list[int]:
        """Tokens of one part of any length: halves, joined."""
        if len(data) <= SHORT:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_part(data[:half]), self.encode_part(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring stretches of one part."""
        reach = 1
        while left and right:
            a, b = min(reach, len(left)), min(reach, len(right))
            window = b"".join(self.token_bytes[i] for i in (*left[-a:], *right[:b]))
            ids = self.merge(window)
            fits_left = a == len(left) or ids[0] == left[-a]
            fits_right = b == len(right) or ids[-1] == right[b - 1]
            if fits_left and fits_right:
                return [*left[:-a], *ids, *right[b:]]
            reach *= 2
        return left or right

    def tokens(self, text: str) -> bytes:
        """Ids of a text without special strings, as little-endian 32-bit integers."""
        parts = self.pattern.findall(text)
        out = list(map(self.cache.get, parts))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    out[i] = self._remember(parts[i])
        return b"".join(out)

    def _remember(self, part: str) -> bytes:
        found = self.cache.get(part)
        if found is None:
            if len(self.cache) >= CACHED:
                # What was used since the last time is asked for here again and stays.
                self.cache, self.older = {}, self.cache
            found = self.older.get(part) or pack(self.encode_part(part.encode()))
            if len(part) <= 32:
                self.cache[part] = found
        return found

    def stretches(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special strings and the text between them."""
        if self.special_pattern is None:
            yield False, text
            return
        for i, piece in enumerate(self.special_pattern.split(text)):
            if piece:
                yield i % 2 == 1, piece

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed."""
        return b"".join(pack([self.special[t]]) if special else self.tokens(t) for special, t in self.stretches(text))

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, unpack(ids))).decode("utf-8", "replace")

    def pieces(self, text: str) -> Iterator[tuple[int, int, bytes]]:
        """(kind, part number, bytes) of a long text's pieces, in order."""
        number = 0
        for special, stretch in self.stretches(text):
            if special:
                yield SPECIAL, number, stretch.encode()
                number += 1
                continue
            held, size = [], 0
            for match in self.pattern.finditer(stretch):
                part = match.group()
                data = part.encode()
                if size and size + len(data) > CHUNK:
                    yield WHOLE, number, BETWEEN.join(held)
                    number, held, size = number + 1, [], 0
                if len(data) <= CHUNK:
                    held.append(data)
                    size += len(data)
                    continue
                for at in range(0, len(data), CHUNK):
                    yield PART, number, data[at : at + CHUNK]
                number += 1
            if held:
                yield WHOLE, number, BETWEEN.join(held)
                number += 1

    def encode_piece(self, kind: int, data: bytes) -> bytes:
        if kind == SPECIAL:
            return pack([self.special[data.decode()]])
        if kind == PART:
            return pack(self.encode_part(data))
        return b"".join(self._remember(part.decode()) for part in data.split(BETWEEN))

    def join_pieces(self, pieces: list[tuple[int, int, bytes]]) -> bytes:
        """Ids of a document from the ids of its pieces; those of one part join as a tree."""
        out, i = [], 0
        while i < len(pieces):
            j = i + 1
            while j < len(pieces) and pieces[i][0] == PART and pieces[j][1] == pieces[i][1]:
                j += 1
            level = [ids for _, _, ids in pieces[i:j]]
            if len(level) > 1:
                level = [unpack(ids).tolist() for ids in level]
                while len(level) > 1:
                    level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
                level = [pack(level[0])]
            out += level
            i = j
        return b"".join(out)


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpack(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


def encode(docs: DataFrame, vocabulary_file: str, digest: bool = False) -> DataFrame:
    """doc_id and packed ids of every text (or their count and digests, and that of the decoded text).

    ``vocabulary_file`` is read once, on the driver; its size is fixed, so its
    content is broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary_file, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    schema = "doc_id bigint, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids binary")
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def result(v: Vocabulary, doc_ids: list, packed: list[bytes]) -> pa.RecordBatch:
        ids = pa.array(doc_ids, pa.int64()) if isinstance(doc_ids, list) else doc_ids
        if not digest:
            return pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], ["doc_id", "ids"])
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(sha, packed), pa.string()),
            pa.array([sha(v.decode(p).encode()) for p in packed], pa.string()),
        ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(content.value)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                packed = [b"" if d is None else v.encode(d.tobytes().decode()) for d in B.texts(batch.column("text"))]
                yield result(v, batch.column("doc_id"), packed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(content.value)
        def rows():
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "copies")), B.texts(batch.column("text")))
                for doc_id, version, copies, data in keys:
                    for seq, (kind, number, piece) in enumerate(v.pieces(data.tobytes().decode())):
                        yield doc_id, version, copies, seq, kind, number, piece
        names = ["doc_id", "version", "copies", "seq", "kind", "number", "piece"]
        return B.rows_in_batches(rows(), names, [*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.int32(), pa.binary()], 64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(content.value)
        for batch in batches:
            ids = [v.encode_piece(k, p) for k, p in zip(batch.column("kind").to_pylist(), batch.column("piece").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("piece"), "piece", pa.array(ids, pa.binary()))

    def joined(group: pa.Table) -> pa.Table:
        v = Vocabulary.of(content.value)
        rows = sorted(group.select(["seq", "kind", "number", "piece"]).to_pylist(), key=lambda r: r["seq"])
        packed = v.join_pieces([(r["kind"], r["number"], r["piece"]) for r in rows])
        return pa.Table.from_batches([result(v, [group.column("doc_id")[0].as_py()], [packed])]).append_column("copies", group.column("copies").slice(0, 1))

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    is_long = F.coalesce(F.octet_length("text") > CHUNK, F.lit(False))
    # Repeated rows of a long text are encoded once.
    long = chosen.where(is_long).groupBy("doc_id", F.xxhash64("text").alias("version")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    piece = "doc_id bigint, version bigint, copies bigint, seq int, kind int, number int, piece binary"
    pieces = long.mapInArrow(cut, piece).repartition("doc_id", "version", "seq").mapInArrow(encoded, piece)
    whole = pieces.groupBy("doc_id", "version").applyInArrow(joined, schema + ", copies bigint")
    again = whole.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "col")
    return chosen.where(~is_long).mapInArrow(short, schema).unionByName(again)


def decode(encoded: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id and text of packed ids."""
    with open(vocabulary_file, encoding="utf-8") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(content.value)
        for batch in batches:
            texts = [v.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id bigint, text string")
