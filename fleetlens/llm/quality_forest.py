"""Quality rules: an isolation forest over rule statistics.

Each text yields the statistics that hand-written quality rules look at,
measured as the excess over what good labelled rows reach.  A forest of random
splits is grown on labelled rows with few bad ones among them, a document's
mean path length through it says how soon random splits set it apart, and the
score from which a document is rejected is calibrated on labelled rows.  Two
fixed rules (too few words, too much repetition) come before the forest.

Medians, limits and the threshold come from all labelled rows: order statistics
by counting digits in rounds, the threshold from counts of scores.  A tree is
grown on 256 rows, as isolation forests are, drawn from all of them.

Null and empty texts have no words, so the base rule rejects them.  Without
labelled rows of both kinds only the base rules reject.  Rows that repeat get
equal verdicts; columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B
from fleetlens.llm.samples import one_of_each
from fleetlens.session import cut

# Characters that count as symbols (fixed by the rules).
SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>", np.uint8)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "odd_ends")
DIGITS = ((52, 12), (39, 13), (26, 13), (13, 13), (0, 13))  # shift and width of the digits of a double
STEPS = 1 << 17  # steps that scores are counted in for the threshold
WINDOW = 5

_IS_SYMBOL = np.isin(np.arange(256), SYMBOL_BYTES)
_KIND = np.zeros((256, 5), np.int64)  # symbol, upper case, other mark, digit, starts a character
_KIND[:, 0] = _IS_SYMBOL
_KIND[0x41:0x5B, 1] = 1
_KIND[0x21:0x7F, 2] = 1
_KIND[0x30:0x3A, 2] = _KIND[0x41:0x5B, 2] = _KIND[0x61:0x7B, 2] = 0
_KIND[SYMBOL_BYTES, 2] = 0
_KIND[0x30:0x3A, 3] = 1
_KIND[:, 4] = (np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)


def repeated_window_words(codes: np.ndarray, k: int = WINDOW) -> int:
    """Words inside runs of ``k`` words that occur twice or more in the text."""
    grams = B.gram_hashes(codes, k)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts, ends = B.runs(twice)
    return int(B.cover(len(codes), starts, ends + k - 1).sum())


def statistics(data: np.ndarray | None) -> tuple[tuple[int, ...], np.ndarray]:
    """The base counts of a text and the forest's features."""
    if data is None or not len(data):
        return (0, 0, 0, 0, 0), np.zeros(len(FEATURES))
    codes, starts, ends = B.word_codes(data, B.SPACES)
    n = len(codes)
    seen = np.bincount(data, minlength=256)
    symbols, upper, marks, digits, chars = (int(x) for x in seen @ _KIND)
    # Every character outside words is one of the six spaces, a single byte.
    chars -= int(seen[B.SPACES].sum())
    lines, dup = set(), 0
    with_words = 0
    for line in data.tobytes().split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            with_words += 1
            dup += line in lines
            lines.add(line)
    repeats = repeated_window_words(codes)
    base = (n, chars, symbols, dup, repeats)
    if not n:
        return base, np.zeros(len(FEATURES))
    last = data[ends - 1]
    odd = 1 - float(((last >= 0x61) & (last <= 0x7A) | (last >= 0x80)).mean())
    return base, np.array([
        chars / n, symbols / chars, dup / with_words, repeats / n, upper / chars, marks / chars, digits / chars, odd,
    ])


def base_failed(n_words, n_repeat_words):
    """The fixed rules; works on numbers and arrays."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def expected_path(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, (n == 2) * 1.0)


@dataclass
class IsolationForest:
    """Trees as flat arrays; inner node i of a tree has the children 2i+1 and 2i+2."""

    trees: int = 100
    rows: int = 256
    depth: int = 8
    seed: int = 7
    split: np.ndarray = field(default=None)  # feature by tree and node, -1 in a leaf
    at: np.ndarray = field(default=None)
    path: np.ndarray = field(default=None)  # depth plus the expected rest, in leaves

    def fit(self, x: np.ndarray) -> "IsolationForest":
        nodes = (1 << (self.depth + 1)) - 1
        self.split = np.full((self.trees, nodes), -1, np.int8)
        self.at = np.zeros((self.trees, nodes))
        self.path = np.zeros((self.trees, nodes))
        rng = np.random.default_rng(self.seed)
        for t in range(self.trees):
            rows = rng.choice(len(x), min(self.rows, len(x)), replace=False)
            todo = [(0, 0, rows)]
            while todo:
                node, depth, rows = todo.pop()
                low, high = x[rows].min(0), x[rows].max(0)
                can = np.flatnonzero(high > low)
                if depth == self.depth or len(rows) < 2 or not len(can):
                    self.path[t, node] = depth + float(expected_path(len(rows)))
                    continue
                f = rng.choice(can)
                at = rng.uniform(low[f], high[f])
                self.split[t, node], self.at[t, node] = f, at
                left = x[rows, f] < at
                todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the sooner random splits set a row apart."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.split[t, node]
                right = x[rows, np.maximum(f, 0)] >= self.at[t, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            total += self.path[t, node]
        return 2.0 ** (-total / self.trees / max(float(expected_path(self.rows)), 1e-9))


def calibrate(score: np.ndarray, good: np.ndarray, keep_good: float) -> float:
    """Score from which documents are rejected: the largest gain in rejected bad
    over rejected good rows, with at least ``keep_good`` of the good ones kept."""
    if good.all() or not good.any():
        return 1.1
    values, at = np.unique(score, return_inverse=True)
    return calibrate_counts(values, np.bincount(at[good], minlength=len(values)), np.bincount(at[~good], minlength=len(values)), keep_good)


def calibrate_counts(values: np.ndarray, n_good: np.ndarray, n_bad: np.ndarray, keep_good: float) -> float:
    """The same from the numbers of good and bad rows of each score, in rising order."""
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1e-6)
    bad_above = 1 - np.cumsum(n_bad) / n_bad.sum()
    good_above = 1 - np.cumsum(n_good) / n_good.sum()
    allowed = good_above <= 1 - keep_good
    return float(cuts[allowed][np.argmax((bad_above - good_above)[allowed])]) if allowed.any() else 1.1


@dataclass
class QualityModel:
    """Rule excesses, the forest over them and the calibrated threshold."""

    middle: np.ndarray
    high: np.ndarray
    forest: IsolationForest | None = None
    threshold: float = 1.1
    weight: int = 20  # words that a text's ratios are shrunk by towards the middle

    def shrunk(self, n_words: np.ndarray, x: np.ndarray) -> np.ndarray:
        n = np.asarray(n_words, float)[:, None]
        return (x * n + self.weight * self.middle) / (n + self.weight)

    def excess(self, n_words: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How far every statistic lies above the range of good rows."""
        return np.maximum(0, self.shrunk(n_words, x) - self.high) / (np.abs(self.high - self.middle) + 1e-3)

    def score(self, n_words: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(x):
            return np.zeros(len(x))
        return self.forest.score(self.excess(n_words, x))


def fit(n_words: np.ndarray, x: np.ndarray, good: np.ndarray, keep_good: float = 0.998, reach: float = 0.998, margin: float = 0.5, bad_share: float = 0.02, seed: int = 7) -> QualityModel:
    """Model from labelled rows that passed the base rules."""
    if not good.any() or good.all():
        return QualityModel(np.zeros(len(FEATURES)), np.full(len(FEATURES), np.inf))
    middle = np.median(x[good], 0)
    model = QualityModel(middle, middle)
    shrunk = model.shrunk(n_words, x)
    model.high = middle + (1 + margin) * (np.quantile(shrunk[good], reach, axis=0) - middle)
    excess = model.excess(n_words, x)
    rng = np.random.default_rng(seed)
    bad = np.flatnonzero(~good)
    few = max(1, round(bad_share * good.sum() / (1 - bad_share)))
    mixed = np.r_[np.flatnonzero(good), rng.permutation(bad)[:few]]
    model.forest = IsolationForest(seed=seed).fit(excess[mixed])
    model.threshold = calibrate(model.forest.score(excess), good, keep_good)
    return model


_COUNTS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(data) for data in B.texts(batch.column("text"))]
    base = np.array([f[0] for f in found], np.int64).reshape(-1, len(BASE))
    return base, np.array([f[1] for f in found]).reshape(-1, len(FEATURES))


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, x = _measured(batch)
        kept = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), *(pa.array(c) for c in base.T), *(pa.array(c) for c in x.T)],
            [*kept, *BASE, *FEATURES],
        )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the features of every document."""
    schema = _COUNTS + "".join(f", {f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_with_statistics, schema)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("n_words").to_numpy(), np.column_stack([batch.column(f).to_numpy() for f in FEATURES])


def order_values(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], ranks: list[int]) -> np.ndarray:
    """For every feature the values at ``ranks`` (from 0) of all rows; no value may be negative.

    Doubles from 0 on are ordered like their bits.  Each round counts the next
    digit of the rows that agree with a wanted value so far, so a task and the
    driver hold a fixed number of counts whatever the number of rows.
    """
    shape = (len(ranks), len(FEATURES))
    found, left = np.zeros(shape, np.uint64), np.repeat(np.array(ranks), len(FEATURES)).reshape(shape)
    for shift, width in DIGITS:
        def counted(batches: Iterator[pa.RecordBatch], so_far=found.copy()) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*shape, 1 << width), np.int64)
            for batch in batches:
                bits = np.ascontiguousarray(values(batch) + 0.0).view(np.uint64)
                for r, f in np.ndindex(shape):
                    own = bits[:, f]
                    if shift + width < 64:
                        above = np.uint64(shift + width)
                        own = own[own >> above == so_far[r, f] >> above]
                    digit = (own >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    total[r, f] += np.bincount(digit.astype(np.int64), minlength=1 << width)
            r, f, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r * shape[1] + f), pa.array(digit), pa.array(total[r, f, digit])], ["target", "digit", "n"]
            )

        counts = rows.mapInArrow(counted, "target bigint, digit bigint, n bigint").groupBy("target", "digit").agg(F.sum("n").alias("n"))
        for target, own in counts.toPandas().sort_values("digit").groupby("target"):
            place = divmod(int(target), shape[1])
            below = np.cumsum(own["n"].to_numpy())
            i = int(np.searchsorted(below, left[place], side="right"))
            left[place] -= below[i - 1] if i else 0
            found[place] |= np.uint64(int(own["digit"].iloc[i]) << shift)
    return found.view(np.float64)


def quantile(rows: DataFrame, n: int, values: Callable[[pa.RecordBatch], np.ndarray], q: float) -> np.ndarray:
    """The ``q`` quantile of every feature over all ``n`` rows, between two rows as numpy has it."""
    place = q * (n - 1)
    low, high = order_values(rows, values, [int(place), min(int(place) + 1, n - 1)])
    return low + (high - low) * (place - int(place))


def fit_all(rows: DataFrame, keep_good: float = 0.998, reach: float = 0.998, margin: float = 0.5, bad_share: float = 0.02, seed: int = 7) -> QualityModel:
    """Like ``fit``, over all rows (doc_id, good, n_words and features) in Spark."""
    counts = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(counts) < 2:
        return QualityModel(np.zeros(len(FEATURES)), np.full(len(FEATURES), np.inf))
    good = rows.where("good")
    middle = quantile(good, counts[True], lambda batch: _numbers(batch)[1], 0.5)
    model = QualityModel(middle, middle)
    model.high = middle + (1 + margin) * (quantile(good, counts[True], lambda batch: model.shrunk(*_numbers(batch)), reach) - middle)
    forest = IsolationForest(seed=seed)
    most = min(counts[True], round(forest.trees * forest.rows * (1 - bad_share)))
    few = min(counts[False], max(1, round(bad_share * most / (1 - bad_share))))
    by_hash = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    drawn = good.orderBy(*by_hash).limit(most).unionByName(rows.where("NOT good").orderBy(*by_hash).limit(few)).toPandas()
    drawn = drawn.sort_values([*FEATURES, "doc_id"])
    model.forest = forest.fit(model.excess(drawn["n_words"].to_numpy(), drawn[list(FEATURES)].to_numpy(float)))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.floor(model.score(*_numbers(batch)) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(step)], ["good", "step"])

    sums = [F.count(F.when(kind, F.lit(1))).alias(name) for name, kind in (("n_good", F.col("good")), ("n_bad", ~F.col("good")))]
    scored = rows.mapInArrow(steps, "good boolean, step bigint").groupBy("step").agg(*sums).toPandas().sort_values("step")
    values = (scored["step"].to_numpy() + 0.5) / STEPS
    model.threshold = calibrate_counts(values, scored["n_good"].to_numpy(), scored["n_bad"].to_numpy(), keep_good)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int | None = None, keep_good: float = 0.998) -> QualityModel:
    """Fit on all labelled documents, or on ``rows`` of them at most, picked by a hash of their id.

    A doc_id that is labelled both ways counts as bad; of rows that share one,
    one is used.
    """
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    )
    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if rows is None:
        # Statistics first: they are shuffled to their labels, the texts are not.
        schema = "digest bigint, " + _COUNTS + "".join(f", {f} double" for f in FEATURES)
        measured = chosen.select(F.coalesce(F.xxhash64("text"), F.lit(0)).alias("digest"), "doc_id", "text").mapInArrow(_with_statistics, schema)
        numbers = F.struct("digest", "quality", "n_words", "n_repeat_words", *FEATURES)
        one = measured.join(marked, "doc_id").groupBy("doc_id").agg(F.min(numbers).alias("row")).select("doc_id", "row.*")
        passed = one.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
        return fit_all(cut(passed.select("doc_id", (F.col("quality") == 1).alias("good"), F.col("n_words").cast("double"), *FEATURES)), keep_good)
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.join(F.broadcast(picked), "doc_id", "left_semi")
    rows_of = rule_statistics(one_of_each(chosen, "doc_id")).join(F.broadcast(picked), "doc_id").toPandas()
    base = rows_of[list(BASE)].to_numpy()
    passed = ~base_failed(base[:, 0], base[:, 4])
    n, x = base[passed, 0].astype(float), rows_of[list(FEATURES)].to_numpy(float)[passed]
    order = np.lexsort((*x.T, rows_of["doc_id"].to_numpy()[passed]))  # the model doesn't depend on the order of rows
    return fit(n[order], x[order], rows_of["quality"].to_numpy()[passed][order] == 1, keep_good)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, n_words, base counts, base_failed, kept and the anomaly score."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = _measured(batch)
            failed = base_failed(base[:, 0], base[:, 4])
            score = model.score(base[:, 0], x)
            kept = ~failed & (score < model.threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(kept), pa.array(score)],
                ["doc_id", *BASE, "base_failed", "kept", "anomaly"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        scored, _COUNTS + ", base_failed boolean, kept boolean, anomaly double"
    )


def keep_good_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns, in one pass without a shuffle."""
    schema = docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = _measured(batch)
            keep = ~base_failed(base[:, 0], base[:, 4]) & (model.score(base[:, 0], x) < model.threshold)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(kept, schema)
