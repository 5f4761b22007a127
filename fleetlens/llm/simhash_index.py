"""Near duplicates by 64-bit fingerprints, found with multi-index hashing.

A fingerprint has a bit set where more than half of the hashes of a text's
3-word shingles have it.  Equal fingerprints are one class from the start.  Two
fingerprints that differ in two bits or fewer differ in one bit at most in their
upper half, or are equal in the lower: so the upper halves are looked up with
all halves of one bit less (of two halves that differ in one bit, one is the
other with that bit cleared) and with themselves, the lower halves with
themselves alone.  Matches are verified on all 64 bits.

A half that more than ``FULL`` fingerprints share is not looked up, as its pairs
would grow with the square.  Whoever would have met there goes another exact
way: each such fingerprint names itself and all 64 neighbours at one bit.  Two
fingerprints at two bits or fewer name a neighbour in common, no key is named by
more than 65, and all that name it are within two bits of each other, so linking
them to the smallest is enough.  No pair of fingerprints that links is left out
of the components.

Null and empty texts and texts without words have the fingerprint zero and link
like any other.  Texts of one or two words have one shingle.  Repeated rows have
equal fingerprints.  A component is named by its smallest doc_id (nulls aside;
null if it has no other).  Long texts are hashed in blocks.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B
from fleetlens.llm import words as W
from fleetlens.llm.anchors import stored
from fleetlens.llm.components import components

WORDS = 3
SEED = 42
BITS = 2  # most bits in which linked fingerprints differ
HALF = 32
FULL = 64  # fingerprints that may share a half that is looked up: more are cheaper to find by their 65 neighbours


def ones_by_bit(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprint(data: np.ndarray | None, k: int = WORDS) -> int:
    """Majority of the shingles' hashes by bit, as a signed number; zero without words."""
    if data is None:
        return 0
    ones, n, before = np.zeros(64, np.int64), 0, []
    for found in W.blocks(data, W.PROSE):
        own = before + found
        if len(own) >= k:
            joined = map(b" ".join, zip(*(own[i:] for i in range(k))))
            n += len(own) - k + 1
            ones += ones_by_bit(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(own) - k + 1))
        before = own[max(len(own) - k + 1, 0) :]
    if not n and before:
        n, ones = 1, ones_by_bit(np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], np.uint64))
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(data) for data in B.texts(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(made, "doc_id bigint, fp bigint")


def low_half(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << HALF) - 1))


def high_half(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, HALF)


def lookups(classes: DataFrame) -> DataFrame:
    """fp, the table (0 upper, 1 lower halves), key and whether the key is the fingerprint's own."""
    high = high_half(F.col("fp"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda i: F.getbit(high, i) == 1)

    def key(table: int, value: Column, own: bool) -> Column:
        return F.struct(F.lit(table).alias("half"), value.alias("key"), F.lit(own).alias("own"))

    cleared = F.transform(bits, lambda i: key(0, high - F.call_function("shiftleft", F.lit(1).cast("bigint"), i), False))
    keys = F.concat(F.array(key(0, high, True), key(1, low_half(F.col("fp")), True)), cleared)
    return classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def links(classes: DataFrame, full: int = FULL) -> DataFrame:
    """a, b: fingerprints that differ in two bits or fewer, enough of them to connect all that do."""
    wanted = lookups(classes)
    shared = stored(wanted.where("own").groupBy("half", "key").agg(F.count("*").alias("n")).where(F.col("n") > full))
    met = wanted.join(shared.drop("n").withColumn("is_full", F.lit(True)), ["half", "key"], "left")
    looked_up = stored(met.where(F.col("is_full").isNull()).drop("is_full"))
    other = looked_up.where("own").select("half", "key", F.col("fp").alias("b"))
    pairs = looked_up.withColumnRenamed("fp", "a").join(other, ["half", "key"]).where(near(F.col("a"), F.col("b")))
    pairs = pairs.where(~F.col("own") | (F.col("a") < F.col("b"))).select("a", "b")
    crowded = met.where("is_full").select("fp").distinct()
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    named = crowded.select("fp", F.explode(ball).alias("neighbour"))
    first = named.groupBy("neighbour").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).where(F.col("b") < F.col("last"))
    balls = named.join(first.drop("last"), "neighbour").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(balls).distinct()


def simhash_components(docs: DataFrame, full: int = FULL) -> DataFrame:
    """doc_id, fp (signed) and component_id of every row."""
    found = stored(fingerprints(docs))
    classes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    grouped = components(links(classes, full), "a", "b").withColumnRenamed("node", "fp")
    named = classes.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    labelled = named.join(least, "component").select("fp", "component_id")
    return found.join(labelled, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, full: int = FULL) -> DataFrame:
    """doc_id of the documents that name their component."""
    return simhash_components(docs, full).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
