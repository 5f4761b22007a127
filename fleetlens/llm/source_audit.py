"""How far the sources of a language differ in their terms, each text counted once.

Identical texts of a language are collapsed first: every task keeps one text
with the number of its copies by source and sends later copies as counts alone;
then all counts of a text meet, sorted, at its digest (128 bits), where the text
is tokenized once and its terms are added with the weights of its sources.
Frequencies are rows of (lang, source, term); no task holds those of a language.

Pairs of sources are evaluated sparsely.  A term that a source lacks has a
probability that depends on the source alone, so the divergence of a pair is a
base for all terms in neither, a part for the terms of each side against the
other's lack (from a histogram of the few different probabilities of a source),
and a correction for the terms that both have, found by a join on the term.
Sums of whole numbers, so the result is exact in any order.

Null text, lang and source count as ''.  Empty texts and texts without terms
have none, yet their (lang, source) group occurs.  Repeated rows are documents
of their own: they count as often as they occur.  A language without kept terms
gives every pair the value 0 and no terms; ties rank by item.  Long texts are
tokenized in blocks.  No rows give no rows.  Columns other than text, lang and
source are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B
from fleetlens.llm import words as W
from fleetlens.llm.anchors import stored

SCALE = 1_000_000_000
DOCUMENTS = 10  # a term in fewer documents of its language is left out
TERMS = 10  # ranks of part ``term``
HELD = 1 << 18  # keys of counts that a task holds
HELD_BYTES = 1 << 26  # text that a task tokenizes between two deliveries
DEALS = 16  # parts of a language's sources when they are paired

COPIES = "lang string, source string, d1 bigint, d2 bigint, copies bigint, text string"
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def collapsed_here(docs: DataFrame) -> DataFrame:
    """lang, source, digest and copies; the text in the first row of each digest that a task sees."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), text.alias("text"),
    )

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()  # (lang, digest) of the texts that went on
        more: Counter = Counter()
        for batch in batches:
            lang, source, d1, d2 = (batch.column(c).to_pylist() for c in ("lang", "source", "d1", "d2"))
            new = []
            for i, key in enumerate(zip(lang, d1, d2)):
                if key in sent:
                    more[(*key, source[i])] += 1
                else:
                    sent.add(key)
                    new.append(i)
            if new:
                rows = batch.take(pa.array(new))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("lang", "source", "d1", "d2")), pa.array([1] * len(new), pa.int64()), rows.column("text")],
                    ["lang", "source", "d1", "d2", "copies", "text"],
                )
            if len(sent) + len(more) >= HELD:
                yield from later(more)
                sent, more = set(), Counter()
        yield from later(more)

    def later(more: Counter) -> Iterator[pa.RecordBatch]:
        if more:
            lang, d1, d2, source = zip(*more)
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [lang, source, d1, d2, list(more.values()), [None] * len(more)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "source", "d1", "d2", "copies", "text"])

    return plain.mapInArrow(collapse, COPIES)


def term_counts(docs: DataFrame) -> DataFrame:
    """n (occurrences) and docs (documents) of every (lang, source, term)."""
    met = collapsed_here(docs).repartition("lang", "d1", "d2").sortWithinPartitions("lang", "d1", "d2", F.col("text").isNull())

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = defaultdict(dict), defaultdict(dict)  # by (lang, source) and term
        key, terms, read = None, {}, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "source", "d1", "d2", "copies")]
            texts = batch.column("text")
            for i, (lang, source, d1, d2, copies) in enumerate(zip(*columns)):
                if key != (lang, d1, d2):
                    if read >= HELD_BYTES or sum(map(len, n.values())) >= HELD:
                        yield from delivered(n, seen)
                        n, seen, read = defaultdict(dict), defaultdict(dict), 0
                    key, data = (lang, d1, d2), texts[i].as_buffer()
                    terms, read = W.counted(data, W.TERM), read + len(data)
                count, held = n[lang, source], seen[lang, source]
                for term, times in terms.items():
                    count[term] = count.get(term, 0) + times * copies
                    held[term] = held.get(term, 0) + copies
        yield from delivered(n, seen)

    def delivered(n: dict, seen: dict) -> Iterator[pa.RecordBatch]:
        rows = ((*key, term.decode(), times, seen[key][term]) for key, terms in n.items() for term, times in terms.items())
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return B.rows_in_batches(rows, ["lang", "source", "term", "n", "docs"], types, 1 << 16)

    found = met.mapInArrow(tokenize, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """Smoothed share of a term, as a whole number of billionths plus one."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", above, below)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """lang, term, n: the terms that enough documents of the language have."""
    found = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.where(F.col("docs") >= documents).drop("docs")


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b) and value.

    ``groups`` has lang, source, kept (terms of the language) and z (the probability of a term it lacks),
    ``shares`` lang, source, term, p and z of the terms it has.
    """
    one = groups.select("lang", "kept", F.col("source").alias("a"), F.col("z").alias("z_a"), F.pmod(F.xxhash64("source"), F.lit(DEALS)).alias("part"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("z_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALS - 1).cast("bigint"))).alias("part"))
    pairs = one.join(two, ["lang", "part"]).where(F.col("a") != F.col("b"))
    name = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    base = pairs.where(F.col("a") < F.col("b")).select(
        "lang", "a", "b", F.when(F.col("kept") > 0, F.col("kept") * divergence(F.col("z_a"), F.col("z_b"))).otherwise(F.lit(0)).alias("value")
    )
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).withColumnRenamed("source", "a")
    z_a, z_b, p = F.col("z_a"), F.col("z_b"), F.col("p")
    lacked = pairs.join(histogram, ["lang", "a"]).select(
        "lang", *name, (F.col("terms") * (divergence(p, z_b) - divergence(z_a, z_b))).alias("value")
    )
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("z").alias("z_a"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("z").alias("z_b"))
    p_a, p_b = F.col("p_a"), F.col("p_b")
    shared = left.join(right, ["lang", "term"]).where(F.col("a") < F.col("b")).select(
        "lang", "a", "b", (divergence(p_a, p_b) - divergence(p_a, z_b) - divergence(z_a, p_b) + divergence(z_a, z_b)).alias("value")
    )
    added = [part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for part in (lacked, shared)]
    return base.unionByName(added[0]).unionByName(added[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank of every group of the corpus."""
    counts = stored(term_counts(docs))
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    kept = stored(kept_terms(counts, documents))
    have = stored(counts.drop("docs").join(kept.withColumnRenamed("n", "n_lang"), ["lang", "term"]))
    of_source = have.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total_lang"))
    zero = F.lit(0).cast("bigint")
    groups = occurring.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"), F.coalesce("total_lang", zero).alias("total_lang")
    )
    groups = stored(groups.withColumn("z", F.when(F.col("kept") > 0, probability(zero, F.col("total"), F.col("kept")))))
    shares = stored(
        have.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "z", probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
            probability(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"),
        )
    )
    found = pair_values(groups, shares)
    both = [("a", "b"), ("b", "a")]
    pairs = [found.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value") for x, y in both]
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    paired = pairs[0].unionByName(pairs[1]).withColumn("rank", F.row_number().over(group))
    p, q = F.col("p"), F.col("q")
    typical = shares.where(p > q).select("lang", "source", F.col("term").alias("item"), divergence(p, q).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return paired.withColumn("part", F.lit("pair")).select(columns).unionByName(typical.withColumn("part", F.lit("term")).select(columns))
