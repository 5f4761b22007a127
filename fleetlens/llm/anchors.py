"""Repeated windows of many texts: winnowed segments, their copies and what is left to compare.

Every window of ``length`` units belongs to the segment around its smallest
k-gram (its anchor), so all copies of a window lie in segments with one
anchor.  Segments with equal anchor and content are copies as a whole and need
no further look.  Only where one anchor has different contents must windows be
compared, and there one segment per content, the first in order of places, is
enough.  An anchor with very many contents (a frequent phrase) is split: its
segments are cut into pieces of ``STEP`` windows at fixed offsets from the
anchor, and pieces meet on what all their windows have in common.  Copies among
the pieces are settled like those among segments; where one key still has very
many contents, each window is a piece of its own, and all are settled as copies.
So no more than ``HOT`` contents are compared at once.  A place is (doc_id,
version, start); version tells rows apart that share a doc_id, and rows equal in
both are one document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B
from fleetlens.session import checkpoint_dir

KEY = ["doc_id", "version"]
# Text bytes to the sequence of units whose windows are compared.
Units = Callable[[np.ndarray], np.ndarray]
OUT_ROWS = 1 << 16
HOT = 2048  # an anchor with more contents is split
STEP = 8  # windows of one piece of a split segment
FOUND = "anchor bigint, content bigint, doc_id bigint, version bigint, first int, windows int, later boolean, here boolean"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def version_of(text: Column) -> Column:
    """A digest of 64 bits that tells texts under one doc_id apart."""
    return F.coalesce(F.xxhash64(text.cast("string")), F.lit(0))


def versioned(docs: DataFrame) -> DataFrame:
    """doc_id, version and text."""
    return docs.select(F.col("doc_id").cast("bigint"), version_of(F.col("text")).alias("version"), F.col("text").cast("string"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["version"].eqNullSafe(b["version"])


def settled_here(anchor: np.ndarray, content: np.ndarray, places: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Among some segments, which have a copy at an earlier place, and which have one at all.

    ``places`` are compared as (doc_id, version, first); equal ones are one place.
    """
    later, any_copy = np.zeros(len(content), bool), np.zeros(len(content), bool)
    order = np.argsort(content, kind="stable")
    same = content[order][1:] == content[order][:-1]
    some = order[np.append(same, False) | np.append(False, same)]
    if len(some):
        some = some[np.lexsort((*(p[some] for p in reversed(places)), anchor[some], content[some]))]
        new = np.append(True, (content[some][1:] != content[some][:-1]) | (anchor[some][1:] != anchor[some][:-1]))
        lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        differs = np.zeros(len(some), bool)
        for p in places:
            differs |= p[some] != p[lead]
        later[some[differs]] = True
        any_copy[some] = np.bincount(np.cumsum(new), differs)[np.cumsum(new)] > 0
    return later, any_copy


def segments(docs: DataFrame, units: Units, length: int, k: int) -> DataFrame:
    """anchor, content, doc_id, version, first window and windows of every segment, and what is settled.

    Copies that one task sees together are settled there: only the first goes
    on under its anchor, the others get keys of their own.  So a segment that
    fills a large part of the corpus has some rows per task, not one per copy.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = 0
            for i, data in enumerate(B.texts(batch.column("text"))):
                if data is None or len(data) < length:
                    continue
                for anchor, content, first, count, _ in B.cut_segments(units(data), length, k):
                    held.append((anchor, content, np.full(len(first), i), first, count))
                    rows += len(first)
                if rows >= OUT_ROWS:
                    yield out(batch, held)
                    held, rows = [], 0
            if held:
                yield out(batch, held)

    def out(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        anchor, content, row, first, count = (np.concatenate(x) for x in zip(*held))
        return found_here(batch, anchor, content, row, first, count)

    return docs.mapInArrow(cut, FOUND)


def found_here(batch: pa.RecordBatch, anchor: np.ndarray, content: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Segments of a batch's rows, copies among them settled."""
    doc, version = batch.column("doc_id").take(pa.array(row)), batch.column("version").take(pa.array(row))
    later, copied = settled_here(anchor, content, (doc.fill_null(-(1 << 63)).to_numpy(), version.to_numpy(), first))
    own = B.mix(content[later] + B.mix(row[later].astype(np.uint64) << np.uint64(32) | first[later].astype(np.uint64)))
    anchor[later], content[later] = own, own
    return pa.RecordBatch.from_arrays([
        pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), doc, version,
        pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(later), pa.array(copied),
    ], ["anchor", "content", "doc_id", "version", "first", "windows", "later", "here"])


def ranked(found: DataFrame, keep_first: bool) -> DataFrame:
    """Segments that are copies as a whole, that must be compared (wanted), and whether their anchor is hot.

    With ``keep_first`` a copy counts from its second place on, else at every
    place if there are two.  One shuffle and one sort by anchor and content
    serve both windows.
    """
    place = F.struct(*KEY, "first")
    copies = Window.partitionBy("anchor", "content").orderBy(*KEY, "first")
    every = copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    group = Window.partitionBy("anchor")
    rows = found.repartition("anchor").withColumn("is_first", F.rank().over(copies) == 1)
    if keep_first:
        rows = rows.withColumn("copied", ~F.col("is_first") | F.col("later"))
    else:
        rows = rows.withColumn("copied", (F.first(place).over(every) != F.last(place).over(every)) | F.col("later") | F.col("here"))
    rows = rows.withColumn("mixed", F.min("content").over(group) != F.max("content").over(group))
    wanted = F.col("is_first") & F.col("mixed")
    rows = rows.withColumn("hot", F.sum(F.col("is_first").cast("int")).over(group) > HOT)
    return rows.withColumn("wanted", wanted).where(F.col("copied") | F.col("wanted"))


def marks(found: DataFrame, keep_first: bool) -> DataFrame:
    """Per document: segments that are copies as a whole, and those that must be compared."""
    span = F.struct("first", "windows")
    return ranked(found, keep_first).groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("copied"), span)).alias("copied"),
        F.collect_list(F.when(F.col("wanted"), F.struct("first", "windows", "anchor", "hot"))).alias("compare"),
    )


def anchor_place(codes: np.ndarray, length: int, k: int) -> int:
    """Where the anchor of a segment's first window starts."""
    return int(np.argmin(B.gram_hashes(codes[:length], k) & B.HIGH))


def pieces(codes: np.ndarray, windows: int, anchor: int, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(key, first window, windows) of a segment's pieces.

    Windows whose offset to the anchor falls into one step share a core; equal
    windows have equal cores, so the core's hash splits the anchor's segments.
    """
    at = anchor_place(codes, length, k)
    sums = B.prefix_sums(codes)
    for step in range((at - windows + 1) // STEP, at // STEP + 1):
        low, high = max(0, at - STEP * step - STEP + 1), min(windows, at - STEP * step + 1)
        if low < high:
            core = B.span_hashes(sums, np.array([at - STEP * step]), np.array([at - STEP * step - STEP + 1 + length]))
            key = B.mix(core + B.mix(np.array([anchor ^ step], np.int64).view(np.uint64)))
            yield int(key.view(np.int64)[0]), low, high - low


def contents(
    docs: DataFrame, marked: DataFrame, units: Units, length: int, k: int, piece: Callable[[np.ndarray], Callable[[int, int], bytes]]
) -> DataFrame:
    """anchor (or key of a piece), place, windows, text and whether it is a piece, of every segment to compare."""
    todo = marked.where(F.size("compare") > 0).select(*KEY, "compare")
    both = docs.join(todo, same_key(docs, todo)).select(docs["doc_id"], docs["version"], "text", "compare")
    names = ["anchor", "doc_id", "version", "first", "windows", "content", "split"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                keys = zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), B.texts(batch.column("text")))
                for i, (doc_id, version, data) in enumerate(keys):
                    take = piece(data)
                    for s in batch.column("compare")[i].as_py():
                        text = take(s["first"], s["first"] + s["windows"] + length - 1)
                        if not s["hot"]:
                            yield s["anchor"], doc_id, version, s["first"], s["windows"], text, False
                            continue
                        codes = units(np.frombuffer(text, np.uint8))
                        for key, low, count in pieces(codes, s["windows"], s["anchor"], length, k):
                            low += s["first"]
                            yield key, doc_id, version, low, count, take(low, low + count + length - 1), True
        return B.rows_in_batches(rows(), names, types, 8192)

    return both.mapInArrow(sliced, "anchor bigint, doc_id bigint, version bigint, first int, windows int, content binary, split boolean")


def pieces_found(rows: DataFrame, units: Units, length: int, single: bool) -> DataFrame:
    """Pieces with text as segments are found, with their text; with ``single`` each window by itself, without text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 4096):
                batch = whole.slice(low, 4096)
                anchor, content, row, first, count = [], [], [], [], []
                starts, windows, keys = (batch.column(c).to_numpy() for c in ("first", "windows", "anchor"))
                for i, data in enumerate(B.texts(batch.column("text"))):
                    codes = units(data)
                    hashes = B.gram_hashes(codes, length if single else len(codes))
                    key = keys[i : i + 1].view(np.uint64)
                    anchor.append(B.mix(hashes + B.mix(key)) if single else key)
                    content.append(hashes)
                    row.append(np.full(len(hashes), i))
                    first.append(starts[i] + np.arange(len(hashes)))
                    count.append(np.full(len(hashes), 1 if single else windows[i]))
                if not row:
                    continue
                anchor, content, row, first, count = (np.concatenate(x) for x in (anchor, content, row, first, count))
                found = found_here(batch, anchor, content, row, first.astype(np.int64), count)
                yield found if single else found.append_column("text", batch.column("text"))

    return rows.mapInArrow(work, FOUND if single else f"{FOUND}, text binary")


def settled(rows: DataFrame, units: Units, length: int, keep_first: bool, resolve: Callable[[dict], list[np.ndarray]], target: int) -> DataFrame:
    """Marked spans of the rows of ``contents``; no key with more than ``HOT`` contents is compared."""
    rows = stored(rows)
    split = rows.where("split").withColumnRenamed("content", "text")
    found = stored(ranked(pieces_found(split, units, length, False), keep_first))
    wanted = found.where("wanted").drop("content").withColumnRenamed("text", "content")
    names = ["anchor", *KEY, "first", "windows", "content"]
    more = compared(rows.where(~F.col("split")).select(names).unionByName(wanted.where(~F.col("hot")).select(names)), resolve, target)
    windows = ranked(pieces_found(wanted.where("hot").withColumnRenamed("content", "text"), units, length, True), keep_first)
    spans = [*KEY, "first", "windows"]
    return more.unionByName(found.where("copied").select(spans)).unionByName(windows.where("copied").select(spans))


def compared(rows: DataFrame, resolve: Callable[[dict], list[np.ndarray]], target: int) -> DataFrame:
    """Marks from comparing the segments of each anchor.

    Whole anchors are gathered up to ``target`` bytes of text; ``resolve`` gets
    their columns and returns a mask over the windows of each segment.
    """
    sorted_rows = rows.repartition("anchor").sortWithinPartitions("anchor", *KEY, "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.column("content").nbytes for t in held) < 4 * target:
                continue
            table = pa.concat_tables(held).combine_chunks()
            anchors = table.column("anchor").to_numpy()
            end = int(np.flatnonzero(anchors == anchors[-1])[0])
            if end:
                yield from parts(table.slice(0, end))
            held = [table.slice(end)]
        if held:
            table = pa.concat_tables(held).combine_chunks()
            if len(table):
                yield from parts(table)

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchors = table.column("anchor").to_numpy()
        sizes = np.array([len(d) for d in B.texts(table.column("content").combine_chunks())], np.int64)
        starts = np.append(np.flatnonzero(np.diff(anchors, prepend=anchors[0] - 1 if anchors[0] > -(1 << 63) else 1)), len(anchors))
        ends = np.cumsum(sizes)
        low = 0
        for g in range(1, len(starts)):
            used = ends[starts[g] - 1] - (ends[starts[low] - 1] if starts[low] else 0)
            if used >= target or g == len(starts) - 1:
                yield one(table.slice(int(starts[low]), int(starts[g] - starts[low])))
                low = g

    def one(table: pa.Table) -> pa.RecordBatch:
        doc = table.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        version, first = table.column("version").to_numpy().astype(np.int64), table.column("first").to_numpy().astype(np.int64)
        anchor = table.column("anchor").to_numpy()
        again = (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1]) & (version[1:] == version[:-1]) & (first[1:] == first[:-1])
        keep = np.append(True, ~again)  # repeated rows of one document are one place
        table = table.filter(pa.array(keep))
        columns = {
            "anchor": anchor[keep], "doc_id": doc[keep], "version": version[keep], "first": first[keep],
            "windows": table.column("windows").to_numpy().astype(np.int64),
            "content": list(B.texts(table.column("content").combine_chunks())),
        }
        row, start, count = [], [], []
        for i, mask in enumerate(resolve(columns)):
            s, e = B.runs(mask)
            row.append(np.full(len(s), i))
            start.append(s + columns["first"][i])
            count.append(e - s)
        row, start, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, start, count))
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().take(at), table.column("version").combine_chunks().take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
            ["doc_id", "version", "first", "windows"],
        )

    return sorted_rows.mapInArrow(work, "doc_id bigint, version bigint, first int, windows int")


def all_spans(marked: DataFrame, more: DataFrame) -> DataFrame:
    """All marked spans of each document that has any."""
    whole = marked.where(F.size("copied") > 0).select(*KEY, F.col("copied").alias("spans"))
    rest = more.groupBy(*KEY).agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    return whole.unionByName(rest).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeated(docs: DataFrame, units: Units, length: int, k: int, keep_first: bool, piece, resolve, target: int) -> DataFrame:
    """``docs`` (see ``versioned``) with the spans of windows that occur elsewhere, or earlier."""
    marked = stored(marks(segments(docs, units, length, k), keep_first))
    more = settled(contents(docs, marked, units, length, k, piece), units, length, keep_first, resolve, target)
    spans = all_spans(marked, more)
    return docs.join(spans, same_key(docs, spans), "left").select(*[docs[c] for c in docs.columns], "spans")


def spans_of(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and numbers of windows of the marked spans, row by row."""
    values = column.flatten()
    first, windows = values.field("first").to_numpy(), values.field("windows").to_numpy()
    lengths = np.array([x or 0 for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    at = np.append(0, np.cumsum(lengths))
    for i in range(len(column)):
        yield first[at[i] : at[i + 1]].astype(np.int64), windows[at[i] : at[i + 1]].astype(np.int64)
