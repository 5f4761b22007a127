"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Every run of 13 words of a benchmark item is a window (a shorter item is one).
A window's shingles are its word pairs, ordered by how rare they are in the
documents.  A document that holds the window holds all its shingles, so the
necessary prefix is the rarest one.  Documents meet windows on that shingle;
the place of the shingle in the window fixes where the window would start and
end in the document (positional and length bounds), and the words there are
compared one by one.

Null and empty texts have no words and are not contaminated.  Items without
words or without an item_id are left out; rows that repeat an item_id add their
windows to it.  Repeated document rows get equal rows each.  Other columns
than doc_id and text (item_id and text of the benchmark) are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # all of ASCII but digits and letters
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
PART = 128  # words of a document that travel together, with a window's length on either side
BROADCAST_ROWS = 200_000  # rows of windows or shingles up to which they are broadcast; a row has some 300 bytes


def words_of(text: Column) -> Column:
    """Words of a text, upper case kept."""
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS), ""), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(word, UPPER, LOWER)


def shingles(words: Column) -> Column:
    """A hash for every pair of neighbouring words; the last entry stands for the last word alone.

    Case is folded fully and word by word, so that words which agree in
    ``lowered`` form always agree here.
    """
    folded = F.transform(words, F.lower)
    return F.zip_with(folded, F.slice(folded, 2, F.greatest(F.size(folded), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (digest), words, n and item_id of every window of every item."""
    words = F.transform(words_of(F.col("text").cast("string")), lowered)
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1)))
    return (
        items.select("item_id", "all", F.explode(starts).alias("at"))
        .select("item_id", F.slice("all", F.col("at"), size).alias("words"))
        .select(F.md5(F.array_join("words", " ")).alias("window"), "words", F.size("words").alias("n"), "item_id").distinct()
    )


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def rarest_shingles(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each distinct window with its rarest shingle in the documents and where it stands.

    Windows of one word have no pair; their shingle is the word, which is
    counted as a pair with nothing.  Windows with a pair that no document has
    cannot occur and are left out.
    """
    distinct = windows.select("window", "words", "n").distinct()
    placed = distinct.select("window", "words", "n", F.posexplode(shingles(F.col("words"))).alias("offset", "shingle"))
    placed = placed.where((F.col("n") == 1) | (F.col("offset") < F.col("n") - 1))
    wanted = placed.where(F.col("n") > 1).select("shingle").distinct()
    wanted_rows = wanted.count()
    seen = (
        docs.select(F.explode(shingles(words_of(F.col("text").cast("string")))).alias("shingle"))
        .join(_sized(wanted, wanted_rows), "shingle", "left_semi").groupBy("shingle").count()
    )
    ranked = placed.join(_sized(seen, wanted_rows), "shingle", "left").select(
        "window", "words", "n", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "shingle").alias("place")
    )
    return (
        ranked.groupBy("window").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.min("place").alias("place"))
        .where((F.col("n") == 1) | (F.col("place.count") > 0))
        .select("window", "words", "n", "place.offset", "place.shingle")
    )


def _verified(words: Column) -> Column:
    """Whether the window's words stand in the document where the shingle puts them."""
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size(words))
    there = F.transform(F.slice(words, F.col("start") + 1, F.col("n")), lowered)
    return F.when(inside, there == F.col("window_words")).otherwise(False)


def parts_of(read: DataFrame, size: int) -> DataFrame:
    """Documents in parts of ``PART`` words: ``first`` is the place of a part's first word, ``own`` that of the first it answers for.

    A row for every word would carry the words of its document; of a part it
    carries a bounded number, so the work grows with the text and not its square.
    """
    def part(own: Column) -> Column:
        first = F.greatest(own - size, F.lit(0))
        return F.struct(first.alias("first"), own.alias("own"), F.slice("words", first + 1, own - first + PART + size).alias("words"))

    owns = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PART))
    return read.select("doc_id", "version", F.explode(F.transform(owns, part)).alias("p")).select("doc_id", "version", "p.*")


def occurrences(docs: DataFrame, rare: DataFrame, rows: int, singles: bool, size: int = WINDOW) -> DataFrame:
    """doc_id, version, window, start and n of every place where a window stands.

    ``rare`` are the windows by rarest shingle, ``rows`` their number, and
    ``singles`` tells whether windows of one word are among them.
    """
    rare = rare.withColumnRenamed("words", "window_words")
    read = docs.withColumn("words", words_of(F.col("text"))).select("doc_id", "version", "words")
    columns = ["doc_id", "version", "window", "start", "n"]

    def meet(tokens: Column, some: DataFrame) -> DataFrame:
        start = (F.col("at") - F.col("offset")).alias("start")
        if rows <= BROADCAST_ROWS:
            told = parts_of(read, size).select("doc_id", "version", "first", "own", "words", F.posexplode(tokens).alias("at", "shingle"))
            place = F.col("first") + F.col("at")
            met = told.where((place >= F.col("own")) & (place < F.col("own") + PART)).join(F.broadcast(some), "shingle")
            near = met.select("doc_id", "version", "first", "words", "window", "window_words", "n", start).where(_verified(F.col("words")))
            return near.withColumn("start", F.col("first") + F.col("start")).select(columns)
        # Too many windows to send to every task: meet on shuffled shingles, then verify beside the words.
        met = read.select("doc_id", "version", F.posexplode(tokens).alias("at", "shingle")).join(some, "shingle")
        candidates = met.select("doc_id", "version", F.struct("window", "window_words", "n", start).alias("candidate"))
        per_doc = candidates.groupBy(F.col("doc_id").alias("met_id"), F.col("version").alias("met_version")).agg(F.collect_list("candidate").alias("candidates"))
        same = F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("version") == F.col("met_version"))
        both = read.join(per_doc, same).select("doc_id", "version", "words", F.explode("candidates").alias("c"))
        return both.select("doc_id", "version", "words", "c.*").where(_verified(F.col("words"))).select(columns)

    found = meet(shingles(F.col("words")), rare.where(F.col("n") > 1))
    if singles:
        found = found.unionByName(meet(F.transform("words", lambda w: F.xxhash64(F.lower(w))), rare.where(F.col("n") == 1)))
    return found.distinct()


def _versioned(docs: DataFrame) -> DataFrame:
    """doc_id, text and a digest that keeps rows with one doc_id and different texts apart."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.withColumn("version", F.coalesce(F.xxhash64("text"), F.lit(0)))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Per document: words, hit words, items found and whether one in ``one_in`` words is hit."""
    docs = _versioned(docs)
    windows = item_windows(benchmark, size)
    rare = cut(rarest_shingles(docs, windows))
    rows = rare.count()
    singles = bool(rare.where(F.col("n") == 1).take(1))
    found = cut(occurrences(docs, rare, rows, singles, size))
    hit = (
        found.select("doc_id", "version", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
        .groupBy("doc_id", "version").agg(F.count("*").alias("n_hit"))
    )
    items = (
        found.select("doc_id", "version", "window").distinct().join(windows.select("window", "item_id"), "window")
        .select("doc_id", "version", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id", "version").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    )
    key = ["doc_id", "version"]
    marked = hit.join(items, [hit[k].eqNullSafe(items[k]) for k in key]).select(*[hit[k].alias(f"hit_{k}") for k in key], "n_hit", "n_items", "items")
    counted = docs.select("doc_id", "version", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    joined = counted.join(marked, [counted[k].eqNullSafe(marked[f"hit_{k}"]) for k in key], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, one_in: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    columns = docs.columns
    plain = _versioned(docs)
    rare = cut(rarest_shingles(plain, item_windows(benchmark, size)))
    found = occurrences(plain, rare, rare.count(), bool(rare.where(F.col("n") == 1).take(1)), size)
    hit = (
        found.select("doc_id", "version", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct()
        .groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(F.count("*").alias("__hit"))
    )
    hit = cut(hit)
    version = F.coalesce(F.xxhash64(docs["text"].cast("string")), F.lit(0))
    same = docs["doc_id"].cast("bigint").eqNullSafe(hit["__id"]) & (version == hit["__version"])
    bad = same & (one_in * hit["__hit"] >= F.size(words_of(docs["text"].cast("string"))))
    return docs.join(hit, bad, "left_anti").select(columns)
