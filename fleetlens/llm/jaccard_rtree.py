"""N-gram Jaccard join with count vectors in R-trees.

A document's set are the hashes of its 5-word runs.  Equal sets are one class
from the start.  Classes that can be 80 % alike share one of the first shingles
in any one order (a fifth of the larger set, a ninth of the smaller), so classes
meet in the lists of those shingles; equal lists are kept once.  The order is
that of hashes with frequent shingles last, so that a line that many texts share
makes no list of all of them.

Each class is also a point: its shingles are hashed into 64 groups and
counted.  The overlap of two sets is at most the sum of the smaller counts by
group.  The points of a list are packed into a tree whose nodes hold the
largest counts and the range of sizes below them; node against node, then
point against point, all pairs go whose bound stays below the overlap that
their sizes demand.  What survives is verified on the shingles themselves.

To keep dense groups from becoming all pairs, a first round verifies for every
point its most central partner in each list (in a long list the most central
ones of some of its points), and a second one only the pairs that are not in one
component yet.  No pair is left out of the components: each is verified, bounded
away, or already connected.

Links lie within components, so where they are to be counted, a component is dealt
out in pairs of blocks of sets, and every pair of sets in them is bounded by the
points or verified on the shingles.  A document's links are the different texts
that are 80 % alike with its own; texts of equal sets link too, exact copies of
one text are one.

Null and empty texts and texts without words have the empty set and link with
nothing.  Repeated rows have equal sets.  A component is named by its smallest
doc_id (nulls aside).  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import anchors as A
from fleetlens.llm import textblocks as B
from fleetlens.llm.components import components

WORDS = 5
PERCENT = 80
GROUPS = 64
FINE_GROUPS, FINE_FROM = 1024, 128  # sets of so many shingles are also counted in more groups
LEAF = 32  # points of a leaf
LIST = 4096  # longer lists are split into blocks by size
BLOCK = 2048
NEAR = 512  # points among which a longer list's central ones are found
SPREAD = 8  # tasks that verify one set's pairs
LINK_SETS, LINK_SHINGLES = 512, 1 << 20  # sets and shingles of a block when links are counted
WIDE = 8192  # shingles counted at once
BITS = 1 << 23  # marks of wanted rows, 64 of them in a row
PART = 1 << 21  # shingles of different sets that are counted together
FREQUENT, MOST_FREQUENT = 16, 1 << 17  # times a frequent shingle was met beside itself; how many of them are put in order


def shingle_set(data: np.ndarray | None, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word runs; of all words if there are fewer."""
    if data is None or not len(data):
        return np.zeros(0, np.uint64)
    codes = B.word_codes(B.LOWER[data], B.SPACES)[0]
    return np.unique(B.gram_hashes(codes, min(k, len(codes)))) if len(codes) else codes


def digest(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(B.mix(np.array([B.mix(shingles).sum() ^ np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def counts(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The set as a point: shingles by group."""
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def packed(point: np.ndarray) -> bytes:
    """In the fewest bytes a group that hold the counts."""
    most = int(point.max(initial=0))
    return point.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def point_of(data: bytes, groups: int = GROUPS) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // groups]).astype(np.int32)


def demanded(n, m, percent: int = PERCENT):
    """Smallest overlap with which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_sizes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """First shingles by which a set finds smaller ones, and larger or equal ones."""
    return n - -(-percent * n // 100) + 1, n - demanded(n, n, percent) + 1


class RTree:
    """Points packed into leaves by size and position; leaves under nodes of ``LEAF`` leaves."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, groups: np.ndarray | None = None) -> None:
        """Points of one of the ``groups`` need not meet."""
        groups = np.arange(len(sizes)) if groups is None else groups
        if len(sizes) <= LEAF:
            self.order, self.sizes, self.points, self.groups = np.arange(len(sizes)), sizes, points, groups
            return
        slab = np.arange(len(sizes)) // (LEAF * LEAF)  # the caller sorts by size
        of_several = np.where(np.bincount(groups) > 1, np.arange(groups.max() + 1), -1)[groups]
        self.order = np.lexsort((points[:, points.var(0).argmax()], of_several, slab))
        self.sizes, self.points, self.groups = sizes[self.order], points[self.order], groups[self.order]
        self.leaves = self._boxes(np.arange(0, len(sizes), LEAF), *self._points(slice(None)))
        self.nodes = self._boxes(np.arange(0, len(self.leaves[0]), LEAF), *self.leaves)

    def _points(self, s: slice):
        return self.sizes[s], self.sizes[s], self.points[s], self.groups[s], self.groups[s]

    @staticmethod
    def _boxes(starts, low, high, top, first, last):
        return (
            np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(top, starts, axis=0),
            np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts),
        )

    @staticmethod
    def _meet(a, b, percent: int) -> np.ndarray:
        """Which boxes of ``a`` and ``b`` may hold pairs that link, those of one group aside."""
        (low_a, high_a, top_a, first_a, last_a), (low_b, high_b, top_b, first_b, last_b) = a, b
        sized = (100 * high_a[:, None] >= percent * low_b[None]) & (100 * high_b[None] >= percent * low_a[:, None])
        sized &= (first_a != last_a)[:, None] | (first_b != last_b)[None] | (first_a[:, None] != first_b[None])
        i, j = np.nonzero(sized)
        out = np.zeros(sized.shape, bool)
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            bound = np.minimum(top_a[x], top_b[y]).sum(1)
            out[x, y] = bound >= demanded(low_a[x], low_b[y], percent)
        return out

    def pairs(self, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of points (numbers as given) that survive, and by how much the bound exceeds the demand."""
        if len(self.sizes) <= LEAF:  # a single leaf
            x, y = np.nonzero(np.triu(self._meet(self._points(slice(None)), self._points(slice(None)), percent), 1))
            return x, y, np.minimum(self.points[x], self.points[y]).sum(1) / demanded(self.sizes[x], self.sizes[y], percent)
        found = []
        leaf = lambda at: slice(at * LEAF, (at + 1) * LEAF)
        part = lambda boxes, s: tuple(x[s] for x in boxes)
        nodes = self._meet(self.nodes, self.nodes, percent)
        for p, q in zip(*np.nonzero(np.triu(nodes))):
            leaves = self._meet(part(self.leaves, leaf(p)), part(self.leaves, leaf(q)), percent)
            for a, b in zip(*np.nonzero(leaves)):
                a, b = a + p * LEAF, b + q * LEAF
                if b < a:
                    continue
                ok = self._meet(self._points(leaf(a)), self._points(leaf(b)), percent)
                if a == b:
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                if len(x):
                    x, y = x + a * LEAF, y + b * LEAF
                    slack = np.minimum(self.points[x], self.points[y]).sum(1) / demanded(self.sizes[x], self.sizes[y], percent)
                    found.append((self.order[x], self.order[y], slack))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, version, n, set (digest), point and, for larger sets, finer point of every document.

    Some rows also have ``shared``: shingles that several different sets up to this row have, and how many do.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(data) for data in B.texts(batch.column("text"))]
            names = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("version"), pa.array([len(s) for s in sets], pa.int32()),
                pa.array(names, pa.int64()), pa.array([packed(counts(s)) for s in sets], pa.binary()),
                pa.array([packed(counts(s, FINE_GROUPS)) if len(s) >= FINE_FROM else None for s in sets], pa.binary()), shared(sets, names),
            ], ["doc_id", "version", "n", "set", "point", "fine", "shared"])

    def shared(sets: list[np.ndarray], names: list[int]) -> pa.Array:
        seen, held, found, lengths = set(), [], [np.zeros((2, 0), np.int64)], np.zeros(len(sets) + 1, np.int32)
        for i, (shingles, name) in enumerate(zip(sets, names)):
            if name not in seen:
                seen.add(name)
                held.append(shingles)
            if i == len(sets) - 1 or i % 64 == 63 and sum(map(len, held)) >= PART:
                shingle, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
                found.append(np.stack([shingle[times > 1].view(np.int64), times[times > 1]]))
                lengths[i + 1] = found[-1].shape[1]
                held = []
        shingle, times = np.concatenate(found, 1)
        both = pa.StructArray.from_arrays([pa.array(shingle), pa.array(times)], ["shingle", "times"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), both)

    schema = "doc_id bigint, version bigint, n int, set bigint, point binary, fine binary, shared array<struct<shingle:bigint,times:bigint>>"
    return docs.mapInArrow(described, schema)


def frequent_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of very many sets, sorted, and their level, the higher the more sets have one.

    Only what ``shared`` counts is known: a shingle that is rare in all places where it occurs
    is no frequent one.  The levels decide about an order, and no result depends on that.
    """
    found = described.where(F.size("shared") > 0).select(F.inline("shared")).groupBy("shingle").agg(F.sum("times").alias("times"))
    found = A.stored(found.where(F.col("times") >= FREQUENT).select("shingle", F.floor(4 * F.log2("times")).cast("int").alias("level")))
    lowest, total = 1 << 30, 0
    for level, rows in sorted(((r["level"], r["count"]) for r in found.groupBy("level").count().collect()), reverse=True):
        total += rows
        if total > MOST_FREQUENT:
            break
        lowest = level
    kept = found.where(F.col("level") >= lowest).toArrow()
    shingle, level = kept.column("shingle").to_numpy().view(np.uint64), kept.column("level").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], level[order]


def rare_first(shingles: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Shingles sorted by hash, with the frequent ones last, by level."""
    if not len(frequent):
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    known = frequent[at] == shingles
    return shingles[np.argsort(np.where(known, level[at], 0), kind="stable")] if known.any() else shingles


def prefix_shingles(docs: DataFrame, percent: int = PERCENT, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """shingle, set, n and whether larger sets are found by it; copies within a task once."""
    last = docs.sparkSession.sparkContext.broadcast(frequent or (np.zeros(0, np.uint64), np.zeros(0, np.int32)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, rows = [], 0
            for data in B.texts(batch.column("text")):
                shingles = shingle_set(data)
                if not len(shingles):
                    continue
                name = digest(shingles)
                if name in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(name)
                probe, index = prefix_sizes(len(shingles), percent)
                first = rare_first(shingles, *last.value)[:probe]
                held.append((first, np.full(probe, name), np.full(probe, len(shingles)), np.arange(probe) < index))
                rows += probe
                if rows >= A.OUT_ROWS:
                    yield out(held)
                    held, rows = [], 0
            if held:
                yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        shingle, name, n, index = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(shingle.view(np.int64)), pa.array(name), pa.array(n.astype(np.int32)), pa.array(index)], ["shingle", "set", "n", "index"]
        )

    return docs.select("text").mapInArrow(listed, "shingle bigint, set bigint, n int, index boolean")


def usable(n: np.ndarray, index: np.ndarray, percent: int) -> np.ndarray:
    """Members of a list, sorted by size, that have a partner in it: the smaller of a pair must be found by index."""
    before = np.maximum.accumulate(np.where(index, n, 0))
    has_smaller = np.append(False, 100 * before[:-1] >= percent * n[1:])
    has_larger = index & np.append(100 * n[:-1] >= percent * n[1:], False)
    return has_smaller | has_larger


def shared_lists(prefixes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """list and its sets, for shingles that two or more classes of fitting sizes share; equal lists once."""
    in_order = prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "set")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["list", "sets"], [pa.int64(), pa.list_(pa.int64())]
        return B.rows_in_batches(lists(batches), names, types, 8192)

    def lists(batches: Iterator[pa.RecordBatch]):
        told: set[int] = set()
        for shingle, name, n, index in whole_groups(batches):
            start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            end = np.append(start[1:], len(shingle))
            two = start[end - start == 2]
            two = two[(name[two] != name[two + 1]) & index[two] & (100 * n[two] >= percent * n[two + 1].astype(np.int64))]
            ends = np.stack([name[two], name[two + 1]], 1)
            keys = B.mix(B.mix(ends.view(np.uint64)).sum(1, dtype=np.uint64) ^ np.uint64(2)).view(np.int64)
            for key, members in zip(keys.tolist(), ends.tolist()):
                if key not in told:
                    if len(told) >= 1 << 20:
                        told.clear()
                    told.add(key)
                    yield key, members
            many = end - start > 2
            for s, e in zip(start[many].tolist(), end[many].tolist()):
                for members in members_of(name[s:e], n[s:e], index[s:e]):
                    key = digest(members.view(np.uint64))
                    if key not in told:
                        if len(told) >= 1 << 20:
                            told.clear()
                        told.add(key)
                        yield key, members.tolist()

    def members_of(name, n, index):
        new = np.append(True, (name[1:] != name[:-1]) | (n[1:] != n[:-1]))
        name, n, index = name[new], n[new], index[new]
        keep = usable(n, index, percent)
        name, n = name[keep], n[keep]
        if len(name) <= LIST:
            if len(name) > 1:
                yield name
            return
        # Every two blocks whose sizes can fit are a list; a block that fits no other is one by itself.
        blocks = [slice(at, at + BLOCK) for at in range(0, len(name), BLOCK)]
        paired = set()
        for i, a in enumerate(blocks):
            for j, b in enumerate(blocks[i + 1 :], i + 1):
                if 100 * n[a][-1] >= percent * n[b][0]:
                    paired |= {i, j}
                    yield np.concatenate([name[a], name[b]])
        yield from (name[a] for i, a in enumerate(blocks) if i not in paired)

    def whole_groups(batches: Iterator[pa.RecordBatch]):
        """Columns of batches, cut where a shingle ends."""
        rest = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "set", "n", "index")]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            if not len(columns[0]):
                continue
            end = int(np.flatnonzero(columns[0] == columns[0][-1])[0])
            rest = [c[end:] for c in columns]
            if end:
                yield [c[:end] for c in columns]
        if rest is not None and len(rest[0]):
            yield rest

    return in_order.mapInArrow(grouped, "list bigint, sets array<bigint>").dropDuplicates(["list"])


def candidates(points: DataFrame, best: int | None, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of sets in one list whose bound survives: all, or the ``best`` of every point,
    those with its most central partners.

    ``points`` has list, set, n, point, fine and component; pairs within one
    component (not null) are left out.  A set of which pairs in a list were, or
    may have been, held back gets a row without b.
    """
    in_order = points.repartition("list").sortWithinPartitions("list", "n", "set")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            lists = table.column("list").to_numpy()
            if not len(lists):
                continue
            end = int(np.flatnonzero(lists == lists[-1])[0])
            rest = table.slice(end)
            if end:
                yield from search(table.slice(0, end), seen)
        if rest is not None and rest.num_rows:
            yield from search(rest, seen)

    def search(table: pa.Table, seen: set) -> Iterator[pa.RecordBatch]:
        lists, names, n = (table.column(c).to_numpy() for c in ("list", "set", "n"))
        n = n.astype(np.int64)
        component = table.column("component").fill_null(0).to_numpy()
        alone = table.column("component").is_null().to_numpy()
        points = np.array([point_of(p) for p in table.column("point").to_pylist()])
        fine = table.column("fine").to_pylist()
        start = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        size = np.diff(start, append=len(lists))
        found = []
        two = start[size == 2]
        if len(two):
            slack = np.minimum(points[two], points[two + 1]).sum(1) / demanded(n[two], n[two + 1], percent)
            ok = (slack >= 1) & (100 * n[two] >= percent * n[two + 1])
            found.append((two[ok], two[ok] + 1))
        held = []
        for s, e in zip(start[size > 2].tolist(), (start + size)[size > 2].tolist()):
            if not alone[s:e].any() and (component[s:e] == component[s]).all():
                continue
            if best is None:
                a, b, _ = RTree(n[s:e], points[s:e], groups(component[s:e], alone[s:e])).pairs(percent)
            elif e - s <= NEAR:
                a, b, left, _ = closest(n[s:e], points[s:e])
                held.append(left + s)
            else:
                a, b = around_central(names[s:e], n[s:e], points[s:e])
                held.append(np.arange(s, e))
            found.append((a + s, b + s))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        apart = alone[a] | alone[b] | (component[a] != component[b])
        a, b = a[apart], b[apart]
        new = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(names[a].tolist(), names[b].tolist())):
            pair = (x, y) if x < y else (y, x)
            if pair not in seen:
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(pair)
                new[i] = True
        a, b = a[new], b[new]
        a, b = (x[finely(a, b, n, fine)] for x in (a, b))
        out = [(z, min(x, y), max(x, y)) for x, y, z in zip(names[a].tolist(), names[b].tolist(), lists[a].tolist())]
        rows = np.concatenate(held) if held else np.zeros(0, np.int64)
        out += [(z, x, None) for z, x in zip(lists[rows].tolist(), names[rows].tolist())]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "a", "b"])

    def closest(n: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of every point with its most central partners, points of which pairs are left, and how central each is."""
        a, b, slack = RTree(n, points).pairs(percent)
        # The partner with the most and closest partners of its own: dense groups become stars.
        ends, other = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
        central = np.bincount(ends, np.tile(slack, 2), len(n))
        order = np.lexsort((-central[np.concatenate([b, a])], ends))
        ends = ends[order]
        rank = np.arange(len(ends)) - np.searchsorted(ends, ends)
        chosen = np.zeros(len(a), bool)
        chosen[other[order][rank < best]] = True
        return a[chosen], b[chosen], np.unique(np.concatenate([a[~chosen], b[~chosen]])), central

    def around_central(names: np.ndarray, n: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a long list: the closest of ``NEAR`` points, and every other point with the most central of them it can link with."""
        by_hash = np.argsort(B.mix(names.view(np.uint64)))  # like lists have like ones
        some, rest = np.sort(by_hash[:NEAR]), np.sort(by_hash[NEAR:])
        a, b, _, central = closest(n[some], points[some])
        hubs = np.unique(np.where(central[a] >= central[b], a, b))
        hubs = some[hubs[np.argsort(-central[hubs], kind="stable")]]
        one, two = [some[a]], [some[b]]
        for at in range(0, len(rest), BLOCK):
            left = rest[at : at + BLOCK]
            ok = RTree._meet((n[left], n[left], points[left], left, left), (n[hubs], n[hubs], points[hubs], hubs, hubs), percent)
            x, y = np.nonzero(ok & (np.cumsum(ok, 1) <= best))
            one.append(left[x])
            two.append(hubs[y])
        return np.concatenate(one), np.concatenate(two)

    def groups(component: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Numbers of the components; sets without one are groups of their own."""
        number = np.unique(component, return_inverse=True)[1]
        return np.where(alone, len(component) + np.arange(len(component)), number)

    def finely(a: np.ndarray, b: np.ndarray, n: np.ndarray, fine: list[bytes | None]) -> np.ndarray:
        """Which pairs survive in the finer groups, where both have them."""
        keep = np.ones(len(a), bool)
        known: dict[int, np.ndarray] = {}

        def point(i: int) -> np.ndarray:
            if i not in known:
                if len(known) >= 4096:
                    known.clear()
                known[i] = point_of(fine[i], FINE_GROUPS).astype(np.uint16 if n[i] < 1 << 16 else np.uint32)
            return known[i]

        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            if fine[i] is not None and fine[j] is not None:
                keep[k] = int(np.minimum(point(i), point(j)).sum(dtype=np.int64)) >= demanded(n[i], n[j], percent)
        return keep

    return in_order.mapInArrow(searched, "list bigint, a bigint, b bigint")


def likely(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows that may have a key of ``wanted``: all that do, and few others, so that a join need not move the rest.

    Keys are marked among ``BITS`` bits, which are broadcast: at most ``BITS / 64`` rows
    however many keys there are.  With very many, more rows stay; none is lost.
    """
    place = F.xxhash64(*key)
    word = F.shiftrightunsigned(place, 6).bitwiseAND(F.lit(BITS // 64 - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    marks = wanted.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = (word == marks["__word"]) & (marks["__bits"].bitwiseAND(bit) != 0)
    return rows.join(F.broadcast(marks), marked, "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    """set of every end of a pair."""
    return pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()


def texts_of(sets: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """set and text of the first document of every class in ``sets``."""
    wanted = A.stored(sets.join(classes.select("set", "first"), "set").select("set", "first.*"))
    some = likely(docs, wanted, A.KEY)
    return some.join(wanted, A.same_key(some, wanted)).select("set", "text")


def finely_bounded(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose bound also survives in the finer groups, where both sets have them."""
    fine = classes.select("set", "n", "fine")
    one = fine.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("fine_a"))
    two = fine.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("fine_b"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "fine_a", "fine_b"))):
                overlap = None if x is None or y is None else np.minimum(point_of(x, FINE_GROUPS), point_of(y, FINE_GROUPS)).sum()
                keep.append(overlap is None or overlap >= demanded(n, m, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(bounded, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs that link, from the shingles of both texts.

    The text of ``a`` goes once to each of up to ``SPREAD`` tasks that hold its
    partners, so a set with very many partners is spread.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    sides = dealt.select("a", "part", F.lit(None).cast("bigint").alias("b"), F.col("a").alias("set")).distinct().unionAll(
        dealt.select("a", "part", "b", F.col("b").alias("set"))
    )
    in_order = sides.join(texts, "set").select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, data in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), B.texts(batch.column("text"))):
                if b is None:
                    if own != a:
                        own, first = a, shingle_set(data)
                    continue
                other = shingle_set(data)
                both = len(np.intersect1d(first, other, assume_unique=True))
                if 100 * both >= percent * (len(first) + len(other) - both):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return in_order.mapInArrow(checked, "a bigint, b bigint").distinct()


def linked(one: list[np.ndarray], two: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets of ``one`` link with which of ``two``."""
    n, m = (np.array([len(s) for s in side], np.int64) for side in (one, two))
    x, y = (np.array([counts(s) for s in side]) for side in (one, two))
    one_by_one, others = np.arange(len(n)), len(n) + np.arange(len(m))
    may = RTree._meet((n, n, x, one_by_one, one_by_one), (m, m, y, others, others), percent)
    rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(rows):
        return may
    left, right = np.concatenate([one[i] for i in rows]), np.concatenate([two[j] for j in columns])
    i, j = np.nonzero(may)
    if len(i) * 1000 + (n[i] + m[j]).sum() < len(rows) * len(columns) * min(len(left), len(right)) / 200:  # few pairs of large sets
        for a, b in zip(i.tolist(), j.tolist()):
            both = len(np.intersect1d(one[a], two[b], assume_unique=True))
            may[a, b] = 100 * both >= percent * (n[a] + m[b] - both)
        return may
    shared = np.intersect1d(left, right)
    both = np.zeros((len(rows), len(columns)))
    sides = []
    for values, sizes in ((left, n[rows]), (right, m[columns])):
        at = np.searchsorted(shared, values)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == values[ok]
        at, row = at[ok], np.repeat(np.arange(len(sizes)), sizes)[ok]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order], len(sizes)))
    for low in range(0, len(shared), WIDE):
        has = []
        for at, row, size in sides:
            part = slice(*np.searchsorted(at, (low, low + WIDE)))
            has.append(np.zeros((size, min(WIDE, len(shared) - low)), np.float32))
            has[-1][row[part], at[part] - low] = 1
        both += has[0] @ has[1].T  # whole numbers below 2^24
    at = np.ix_(rows, columns)
    may[at] &= 100 * both >= percent * (n[rows][:, None] + m[columns][None] - both)
    return may


def link_counts(grouped: DataFrame, classes: DataFrame, several: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """set and, summed over its partners, the different texts that link with it.

    A large component is parted by size, in levels so that only sets of one or of
    neighbouring levels can link, and each level by hash into blocks; every two
    blocks that can hold links meet in one task.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101 / percent))).cast("int")
    members = A.stored(
        grouped.join(classes.select("set", "n"), "set").join(several, "set", "left")
        .select("set", "component", "n", F.coalesce("n_texts", F.lit(1)).alias("n_texts"), level.alias("level"))
    )
    large = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = large.where((F.col("sets") > LINK_SETS) | (F.col("shingles") > LINK_SHINGLES)).select("component")
    # At most one row for every LINK_SETS sets or LINK_SHINGLES shingles.
    by_level = members.join(F.broadcast(large), "component").groupBy("component", "level").agg(
        F.ceil(F.greatest(F.count("*") / LINK_SETS, F.sum("n") / LINK_SHINGLES)).cast("int").alias("blocks")
    )
    blocks = by_level.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("blocks"))
    own, block = F.col("blocks")[F.col("level")], F.col("block")

    def meetings(at, make):
        return F.when(F.col("blocks")[at].isNotNull(), F.transform(F.sequence(F.lit(0), F.col("blocks")[at] - 1), make)).otherwise(F.array().cast("array<struct<key:string,side:int>>"))

    def meeting(low, high, i, j, side):
        return F.struct(F.concat_ws(":", "component", low, high, i, j).alias("key"), side.cast("int").alias("side"))

    here = F.col("level")
    all_meetings = F.concat(
        meetings(here, lambda j: meeting(here, here, F.least(block, j), F.greatest(block, j), block > j)),
        meetings(here + 1, lambda j: meeting(here, here + 1, block, j, F.lit(0))),
        meetings(here - 1, lambda j: meeting(here - 1, here, j, block, F.lit(1))),
    )
    alone = F.array(F.struct(F.col("component").cast("string").alias("key"), F.lit(0).alias("side")))
    dealt = members.join(F.broadcast(blocks), "component", "left").withColumn("block", F.pmod(F.xxhash64("set"), own).cast("int"))
    dealt = dealt.select("set", "n_texts", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(all_meetings)).alias("m")).select("set", "n_texts", "m.key", "m.side")
    in_order = dealt.join(texts, "set").select("key", "side", "set", "n_texts", "text").repartition("key").sortWithinPartitions("key", "side", "set")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["set", "n_links"], [pa.int64(), pa.int64()]
        return B.rows_in_batches(rows(batches), names, types, 8192)

    def rows(batches: Iterator[pa.RecordBatch]):
        known, held = None, ([], [])
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "side", "set", "n_texts"))
            for key, side, name, weight, data in zip(*columns, B.texts(batch.column("text"))):
                if key != known:
                    yield from degrees(*held)
                    known, held = key, ([], [])
                if not held[side] or held[side][-1][0] != name:  # repeated rows of one text
                    held[side].append((name, weight, shingle_set(data)))
        yield from degrees(*held)

    def degrees(one: list[tuple], two: list[tuple]):
        """Names and linked texts; one side alone meets itself."""
        if not one or (not two and len(one) < 2):
            return
        other = two or one
        (names, weights, sets), (names_b, weights_b, sets_b) = zip(*one), zip(*other)
        ok = linked(list(sets), list(sets_b), percent)
        if not two:
            np.fill_diagonal(ok, False)
        else:
            yield from zip(names_b, (np.array(weights) @ ok).tolist())
        yield from zip(names, (ok @ np.array(weights_b)).tolist())

    return in_order.mapInArrow(counted, "set bigint, n_links bigint").groupBy("set").agg(F.sum("n_links").alias("n_links"))


def grouped_documents(docs: DataFrame, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """doc_id, version, n_shingles, component_id and, if wanted, n_links of every document."""
    plain = A.versioned(docs)
    described = A.stored(document_sets(plain))
    classes = described.where(F.col("n") > 0).groupBy("set").agg(
        F.first("n").alias("n"), F.first("point").alias("point"), F.first("fine").alias("fine"), F.min(F.struct("doc_id", "version")).alias("first"), F.min("doc_id").alias("smallest")
    )
    classes = A.stored(classes)
    lists = shared_lists(prefix_shingles(plain, percent, frequent_shingles(described)), percent)
    members = lists.select("list", F.explode("sets").alias("set"))
    points = A.stored(members.join(classes.select("set", "n", "point"), "set"))
    found = A.stored(candidates(points.withColumns({"component": F.lit(None).cast("bigint"), "fine": F.lit(None).cast("binary")}), 1, percent))
    first = found.where(F.col("b").isNotNull()).select("a", "b").distinct()
    # From here on only classes with pairs count, and texts are read for pairs that no bound excludes.
    paired = A.stored(ends(first).union(found.where(F.col("b").isNull()).select("a")).distinct())
    met = A.stored(likely(classes, paired, ["set"]).join(paired, "set"))
    bounded = A.stored(finely_bounded(first, met, percent))
    links = A.stored(verified(bounded, texts_of(ends(bounded), met, plain), percent))
    known = components(links, "a", "b")
    # Sets with pairs that were held back come again, now with their finer points.
    more = found.where(F.col("b").isNull()).select("list", F.col("a").alias("set"))
    again = more.join(met.select("set", "n", "point", "fine"), "set").join(known.withColumnRenamed("node", "set"), "set", "left")
    rest = candidates(again, None, percent).select("a", "b").distinct()
    rest = A.stored(rest.join(first, ["a", "b"], "left_anti"))
    links = A.stored(links.union(verified(rest, texts_of(ends(rest), met, plain), percent)))
    grouped = A.stored(components(links, "a", "b").withColumnRenamed("node", "set"))
    named = classes.select("set", "smallest").join(grouped, "set", "left").withColumn("component", F.coalesce("component", "set"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    labelled = named.join(smallest, "component").select("set", "component_id")
    n_links = []
    if count_links:
        several = described.where(F.col("n") > 0).select("set", "version").distinct().groupBy("set").agg(F.count("*").alias("n_texts"))
        several = A.stored(several.where(F.col("n_texts") > 1))
        degree = link_counts(grouped, classes, several, texts_of(grouped.select("set"), met, plain), percent)
        labelled = labelled.join(degree, "set", "left").join(several, "set", "left")
        # Texts of its own set link too; the empty set links with nothing.
        n_links = [(F.coalesce("n_links", F.lit(0)) + F.coalesce("n_texts", F.lit(1)) - 1).alias("n_links")]
    found = described.select("doc_id", "version", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("set"))
    return found.join(labelled, "set", "left").select("doc_id", "version", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *n_links)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """doc_id, version, n_shingles, component_id of every document, and n_links (different texts that link with its own) if wanted.

    Links lie within components, so counting them compares every two sets of a
    component; its work and disk grow with the square of one.
    """
    return grouped_documents(docs, percent, count_links)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component.

    Rows that share the smallest doc_id of a component stay together, as do
    rows without a doc_id.
    """
    columns = docs.columns
    found = grouped_documents(docs, percent, count_links=False)
    # A row leads its group if its doc_id names the component; null ids and empty sets lead their own.
    leads = found.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    leads = leads.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(leads["__id"]) & A.version_of(docs["text"]).eqNullSafe(leads["__version"])
    return docs.join(leads, same, "left_semi").select(columns)
