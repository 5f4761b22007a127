"""Fill-in-middle: cut a text at two token borders and put its middle last.

The borders of a text (code points after each token) are a set of whole numbers
kept as containers of 65,536 numbers each: a bitmap where borders are many and
broken, runs where they lie side by side (digits, symbols, other scripts), a
sorted array where they are few.  Cumulative cardinalities tell in which
container the k-th border lies; a select inside that container gives the offset.
A container takes 8 kB at most, so two bytes a code point hold for one block of
the text at a time, whatever its length.

Which border is cut, and in which form the text comes out, are drawn from the
sha256 of the seed and doc_id, so a repeated run gives the same rows.

Null text counts as empty; a null doc_id is drawn as if it had no digits.  Empty
texts, texts that contain a marker, and nine in a hundred others stay plain.
Repeated rows give repeated results, rows that share a doc_id the same draws.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

SPAN = 1 << 16  # numbers of one container
ARRAY = 4096  # a bitmap of 8 kB is smaller than a sorted array of more numbers
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100

LETTER = np.zeros(128, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1, dtype=np.int64)


class ArrayContainer:
    """Few numbers: sorted."""

    def __init__(self, member: np.ndarray) -> None:
        self.values = np.flatnonzero(member).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """Many numbers: one bit each, with the count of bits before every 64 bytes."""

    WIDTH = 64

    def __init__(self, member: np.ndarray) -> None:
        self.bits = np.packbits(member)
        ones = ONES[self.bits]
        self.before = np.concatenate(([0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), self.WIDTH)))))

    def select(self, k: int) -> int:
        part = int(np.searchsorted(self.before, k, side="right")) - 1
        at = part * self.WIDTH
        return at * 8 + int(np.flatnonzero(np.unpackbits(self.bits[at : at + self.WIDTH]))[k - self.before[part]])


class RunContainer:
    """Numbers side by side: start of every run, and how many numbers come before it."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts, self.before = starts.astype(np.uint16), np.concatenate(([0], np.cumsum(lengths)[:-1]))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(member: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of the numbers where ``member`` is true."""
    step = np.diff(np.concatenate(([0], member.view(np.int8), [0])))
    starts = np.flatnonzero(step == 1)
    count = int(np.count_nonzero(member))
    if 4 * len(starts) < min(2 * count, SPAN // 8):
        return RunContainer(starts, np.flatnonzero(step == -1) - starts)
    return ArrayContainer(member) if count <= ARRAY else BitmapContainer(member)


class BorderSet:
    """The borders of a text, in containers with cumulative cardinalities."""

    def __init__(self, text: str) -> None:
        self.containers, self.upto, total = [], [], 0
        for at in range(0, len(text), SPAN):
            # A border lies after each code point that does not stand inside a run of letters.
            points = np.frombuffer(text[at : at + SPAN + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = LETTER[np.minimum(points, 127)] & (points < 128)
            if len(points) <= SPAN:
                letter = np.append(letter, False)
            member = ~(letter[:-1] & letter[1:])
            count = int(np.count_nonzero(member))
            if count:
                total += count
                self.containers.append((at, container(member)))
                self.upto.append(total)
        self.size = total

    def offset(self, k: int) -> int:
        """Code points up to the end of the ``k``-th token; 0 for none."""
        if k == 0:
            return 0
        i = bisect_left(self.upto, k)
        at, inside = self.containers[i]
        return at + inside.select(k - 1 - (self.upto[i - 1] if i else 0)) + 1


CUTS = StructType([StructField(name, LongType()) for name in ("n", "first", "second")])


@arrow_udf(CUTS)
def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Tokens of a text, and the offsets of the two borders that the draws choose."""
    rows = []
    for value, a, b in zip(text, one.to_pylist(), two.to_pylist()):
        borders = BorderSet(value.as_py())
        low, high = sorted((a % (borders.size + 1), b % (borders.size + 1)))
        rows.append((borders.size, borders.offset(low), borders.offset(high)))
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers below 2^32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every document."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= PLAIN_FROM), "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    cut = docs.select("doc_id", text.alias("text"), form.alias("form"), cuts(text, h1, h2).alias("cut"))
    first, second = F.col("cut.first"), F.col("cut.second")
    prefix = F.substring("text", F.lit(1), first.cast("int"))
    middle = F.substring("text", (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring("text", (second + 1).cast("int"), F.length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(moved, first).alias("prefix_chars"),
        F.when(moved, second - first).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of.  Its parts contain no marker and no two markers can overlap, so the first of each parts them."""

    def parts(lead: str, between: str) -> tuple[Column, Column, Column]:
        one = F.locate(between, output)
        two = F.locate(MIDDLE, output)
        start = F.lit(len(lead))
        return (
            F.substring(output, start + 1, one - 1 - start),
            F.substring(output, one + len(between), two - one - len(between)),
            F.substring(output, two + len(MIDDLE), F.length(output)),
        )

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_first, prefix_second, middle_last = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle_last, suffix_first))
    )


def digests(filled: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests of the output and of the text rebuilt from it."""
    made = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", made(F.col("output")).alias("output_sha256"),
        made(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
