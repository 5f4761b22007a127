"""Dedup operators against brute force, edge cases included."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import frame

from fleetlens.llm import anchors, bwt_dedup, jaccard_rtree, substring_dedup
from fleetlens.llm import textblocks as B
from fleetlens.llm.components import components

pairs = lambda rows: [(d, t) for d, t, _ in rows]


def collected(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_substring_dedup(docs, rows):
    got = collected(substring_dedup.deduplicated(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter(brute.substring_dedup(pairs(rows)))


def test_suffix_dedup(spark, docs, rows):
    keyed = spark.createDataFrame(pairs(rows), "doc_id bigint, text string")
    versions = {(r["doc_id"], r["text"]): r["version"] for r in anchors.versioned(keyed).collect()}
    got = collected(bwt_dedup.deduplicated(docs, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(brute.suffix_dedup(pairs(rows), order=versions.get))


def test_cut_documents_keeps_columns_and_whole_characters(docs, rows):
    cut = bwt_dedup.cut_documents(docs)
    assert cut.columns == docs.columns
    left = defaultdict(list)
    for r in cut.collect():
        left[r["doc_id"]].append(r["text"])
    assert left[9001] == [None] and left[9002] == [""]
    assert 9006 not in left or len(left[9006][0]) < 100  # a copy of 9005


def test_jaccard_components(docs, rows):
    got = collected(jaccard_rtree.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute.jaccard(pairs(rows)))


def test_one_of_each_group_stays(docs, rows):
    kept = jaccard_rtree.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids == {d for d, n, c in brute.jaccard(pairs(rows)) if d is None or d == c or n == 0}


def test_frequent_anchors_are_split_without_losing_repeats(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", 0)
    monkeypatch.setattr(anchors, "STEP", 3)
    keyed = spark.createDataFrame(pairs(rows), "doc_id bigint, text string")
    versions = {(r["doc_id"], r["text"]): r["version"] for r in anchors.versioned(keyed).collect()}
    got = collected(bwt_dedup.deduplicated(docs, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(brute.suffix_dedup(pairs(rows), order=versions.get))
    got = collected(substring_dedup.deduplicated(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter(brute.substring_dedup(pairs(rows)))


@pytest.mark.parametrize("operator", [
    lambda e: substring_dedup.deduplicated(e), lambda e: bwt_dedup.deduplicated(e), lambda e: bwt_dedup.cut_documents(e),
    lambda e: jaccard_rtree.jaccard_components(e), lambda e: jaccard_rtree.one_of_each(e),
])
def test_empty_table(empty, operator):
    assert operator(empty).count() == 0


@pytest.mark.parametrize("shard", [30, 100, 10_000])
def test_merged_transforms_find_all_shared_windows(shard):
    rng = np.random.default_rng(shard)
    for trial in range(25):
        length, wide = 20, 4
        contents = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(length, 60)).astype(np.uint8) for _ in range(rng.integers(1, 9))]
        contents += [c[: rng.integers(length, len(c) + 1)] for c in contents[: trial % 4]]
        windows = np.array([len(c) - length + 1 for c in contents])
        places, intervals = bwt_dedup.repeated_intervals(contents, windows, length, wide, shard)
        want, base = defaultdict(list), 0
        for c in contents:
            for s in range(len(c) - length + 1):
                want[c[s : s + length].tobytes()].append(base + s)
            base += len(c)
        got = defaultdict(list)
        for p, i in zip(places.tolist(), intervals.tolist()):
            got[i].append(p)
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_common_prefixes_of_the_merge():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, 25).astype(np.uint8) for _ in range(5)]
    data, sizes = np.concatenate(texts), np.array([25] * 5)
    ends = np.cumsum(sizes)
    left = np.tile(np.arange(25), 5)
    rank = bwt_dedup.symbols(data, ends, 2)
    shards = [bwt_dedup.Shard(a, b, rank, left, 25 - left, 6, 2) for a, b in ((0, 50), (50, 125))]
    which, prefix = bwt_dedup.interleave(shards, 6)
    merged = np.empty(len(which), int)
    merged[bwt_dedup.stable_order(which)] = np.concatenate([s.order for s in shards])
    suffix = lambda p, n: data[p : min(p + n, (p // 25 + 1) * 25)].tobytes()
    assert [suffix(p, 12) for p in merged] == sorted(suffix(p, 12) for p in range(125))
    for a, b, common in zip(merged, merged[1:], prefix[1:]):
        assert suffix(a, 2 * common) == suffix(b, 2 * common)
        assert common == 6 or suffix(a, 2 * common + 2) != suffix(b, 2 * common + 2)


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    codes = B.BYTE_CODES[rng.integers(97, 100, 700)]
    whole = {(a, f + i) for a, _, first, n, _ in B.cut_segments(codes, 40, 10) for f, a, m in zip(first, a, n) for i in range(m)}
    monkeypatch.setattr(B, "BLOCK", 128)
    assert {(a, f + i) for a, _, first, n, _ in B.cut_segments(codes, 40, 10) for f, a, m in zip(first, a, n) for i in range(m)} == whole


def test_tree_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate([rng.permutation(base)[: rng.integers(200, 300)], rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(150)), key=len)
    tree = jaccard_rtree.RTree(np.array([len(s) for s in sets]), np.array([jaccard_rtree.counts(s) for s in sets]))
    a, b, _ = tree.pairs()
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found


def test_long_lists_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_rtree, "LIST", 8)
    monkeypatch.setattr(jaccard_rtree, "BLOCK", 4)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = words[: rng.randint(60, 120)]
        w[rng.randrange(len(w))] = f"other{i}"
        rows.append((i, " ".join(w), "en"))
    got = collected(jaccard_rtree.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute.jaccard(pairs(rows)))


def test_a_common_line_makes_no_list(spark, monkeypatch):
    monkeypatch.setattr(jaccard_rtree, "FREQUENT", 12, raising=False)
    line = " ".join(f"w{i}" for i in range(40))
    own = [" ".join(f"own{i}x{j}" for j in range(40)) for i in range(60)]
    rows = [(i, f"{line} {text}", "en") for i, text in enumerate(own)] + [(60 + i, f"{line} {own[i]} more", "en") for i in range(0, 20, 2)]
    rows += [(None, line, "en"), (90, line + " other", "en"), (90, line + " other words", "en"), (91, None, "en"), (92, "", "en")]
    made = []

    def watched(prefixes, *rest, real=jaccard_rtree.shared_lists):
        lists = real(prefixes, *rest)
        made.extend(len(r["sets"]) for r in lists.collect())
        return lists

    monkeypatch.setattr(jaccard_rtree, "shared_lists", watched)
    got = jaccard_rtree.jaccard_components(frame(spark, rows).repartition(2))
    assert collected(got, "doc_id", "n_shingles", "component_id") == Counter(brute.jaccard(pairs(rows)))
    assert max(made) <= 3


def test_any_order_of_shingles_finds_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_rtree, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_rtree, "PART", 500)
    for most in (0, 40, 1 << 17):
        monkeypatch.setattr(jaccard_rtree, "MOST_FREQUENT", most)
        frequent, level = jaccard_rtree.frequent_shingles(jaccard_rtree.document_sets(anchors.versioned(docs)))
        assert len(frequent) <= most and (np.diff(frequent.view(np.int64).view(np.uint64)) > 0).all() and (level >= 4).all()
        assert len(frequent) or not most
        got = collected(jaccard_rtree.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
        assert got == Counter(brute.jaccard(pairs(rows)))


@pytest.mark.parametrize("near", [3, 20])
def test_long_lists_are_stars_first_without_losing_links(spark, monkeypatch, near):
    monkeypatch.setattr(jaccard_rtree, "NEAR", near)
    rng = random.Random(12)
    rows = []
    for group in range(3):
        words = [f"w{i}" for i in range(30)] + [f"g{group}w{i}" for i in range(90)]
        for i in range(50):
            w = words[: rng.randint(95, 120)]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(30, len(w))] = f"other{i}"
            rows.append((100 * group + i, " ".join(w), "en"))
    points = {}

    def watched(points_of, best, *rest, real=jaccard_rtree.candidates):
        found = real(points_of, best, *rest)
        points[best] = (points_of.count(), found.where("b IS NOT NULL").count())
        return found

    monkeypatch.setattr(jaccard_rtree, "candidates", watched)
    got = collected(jaccard_rtree.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute.jaccard(pairs(rows)))
    assert points[1][1] <= points[1][0]


def test_long_lists_meet_few_points_at_first(spark, monkeypatch):
    met = []

    def watched(self, *rest, real=jaccard_rtree.RTree.pairs):
        met.append(len(self.sizes))
        return real(self, *rest)

    monkeypatch.setattr(jaccard_rtree.RTree, "pairs", watched)
    monkeypatch.setattr(jaccard_rtree, "NEAR", 32)
    rng = np.random.default_rng(5)
    rows = [(1, i, 100, jaccard_rtree.packed(rng.multinomial(100, np.ones(64) / 64).astype(np.int32)), None, None) for i in range(300)]
    names = ["list", "set", "n", "point", "fine", "component"]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()])], names)

    class Plain:  # the work of one task, here
        repartition = sortWithinPartitions = lambda self, *by: self

        def mapInArrow(self, work, schema):
            return list(work(iter(table.to_batches())))

    found = pa.Table.from_batches(jaccard_rtree.candidates(Plain(), 1, 30)).to_pylist()
    assert met == [32]
    assert {r["a"] for r in found if r["b"] is None} == set(range(300))
    assert {x for r in found if r["b"] is not None for x in (r["a"], r["b"])} == set(range(300))
    assert {r["list"] for r in found} == {1} and len(found) <= 600


def test_tree_leaves_out_pairs_of_one_group_alone():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(90, 110, 2500))
    points = np.array([rng.multinomial(n, np.ones(64) / 64) for n in sizes]).astype(np.int32)
    groups = np.where(rng.random(2500) < 0.9, 0, np.arange(2500))
    met = []

    def watched(a, b, percent, real=jaccard_rtree.RTree._meet):
        met.append(len(a[0]) * len(b[0]))
        return real(a, b, percent)

    found = []
    for given in (None, groups):
        tree = jaccard_rtree.RTree(sizes, points, given)
        tree._meet = watched
        met.clear()
        found.append(({tuple(sorted(p)) for p in zip(*(x.tolist() for x in tree.pairs(45)[:2]))}, sum(met)))
    (every, all_met), (apart, some_met) = found
    assert apart == {(i, j) for i, j in every if groups[i] != groups[j]} and 0 < len(apart) < len(every)
    assert some_met < all_met / 2


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_only_texts_of_bounded_pairs_are_moved(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard_rtree, "BITS", bits)
    moved = []

    def watched(pairs, texts, *rest, real=jaccard_rtree.verified):
        moved.append(({s for p in pairs.collect() for s in p}, {r[0] for r in texts.select("set").collect()}))
        return real(pairs, texts, *rest)

    monkeypatch.setattr(jaccard_rtree, "verified", watched)
    passage = [f"w{i}" for i in range(250)]
    # Five sixths in common, 71 % alike: met in a list, excluded by the finer points alone.
    rows = [(i, " ".join(passage + [f"own{i}x{j}" for j in range(50)]), "en") for i in range(8)]
    near = [f"v{i}" for i in range(300)]
    rows += [(None, " ".join(near), "en"), (20, " ".join(near[:-3]), "en"), (21, " ".join(near[5:]), "en"), (21, None, "en")]
    got = jaccard_rtree.jaccard_components(frame(spark, rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == Counter(brute.jaccard(pairs(rows)))
    assert moved and all(ends == texts for ends, texts in moved)
    assert max(len(texts) for _, texts in moved) <= 3


def test_marks_keep_every_wanted_row_and_few_others(spark, monkeypatch):
    rows = [(i if i % 7 else None, i) for i in range(3000)] + [(None, -1), (None, 0), (-1, 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, version bigint")
    wanted = [r for i, r in enumerate(rows) if i % 50 == 0 or r[0] == -1]
    kept = jaccard_rtree.likely(table, spark.createDataFrame(wanted, table.schema), ["doc_id", "version"])
    assert kept.columns == table.columns
    found = {tuple(r) for r in kept.collect()}
    assert set(wanted) <= found and len(found) <= len(wanted) + 5
    monkeypatch.setattr(jaccard_rtree, "BITS", 64)
    kept = jaccard_rtree.likely(table, spark.createDataFrame(wanted, table.schema), ["doc_id", "version"])
    assert set(wanted) <= {tuple(r) for r in kept.collect()}
    assert not jaccard_rtree.likely(table, table.limit(0), ["doc_id", "version"]).count()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 301), (301, 300)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 300: 300, 301: 300}


def test_many_texts_under_one_id_and_under_null(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(45)) for _ in range(150)]
    rows = [(None, None, "en"), (1, None, "en"), (1, "", "en")]
    for i in range(1000):
        text = " ".join([word() for _ in range(rng.randint(1, 40))] + [rng.choice(passages)] + [word() for _ in range(rng.randint(1, 8))])
        rows += [(None, text, "en"), (1, text + " " + word() if i % 2 else text, "en")]
    docs = frame(spark, rows).repartition(3)
    keyed = spark.createDataFrame(pairs(rows), "doc_id bigint, text string")
    versions = {(r["doc_id"], r["text"]): r["version"] for r in anchors.versioned(keyed).collect()}
    for doc_id in (None, 1):
        assert len({v for (d, _), v in versions.items() if d == doc_id}) == len({t for d, t, _ in rows if d == doc_id})
    got = collected(substring_dedup.deduplicated(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter(brute.substring_dedup(pairs(rows)))
    got = collected(bwt_dedup.deduplicated(docs, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(brute.suffix_dedup(pairs(rows), order=versions.get))
    got = collected(jaccard_rtree.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == Counter(brute.jaccard(pairs(rows)))


def brute_links(rows):
    """Different texts that are 80 % alike with each row's own."""
    texts = {t: brute.shingles(t) for _, t, _ in rows}
    alike = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    links = {t: sum(alike(s, o) for u, o in texts.items() if u != t) for t, s in texts.items()}
    return Counter((d, links[t]) for d, t, _ in rows)


@pytest.mark.parametrize("block", [512, 7])
def test_every_link_of_a_dense_group_counts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_rtree, "LINK_SETS", block)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(None, None, "en"), (900, "", "en"), (901, "alone", "en"), (902, "ALONE", "en"), (903, "alone", "en"), (903, "alone", "en")]
    for i in range(60):
        w = words[: rng.randint(90, 150)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"other{rng.randint(0, 5)}"
        rows += [(i, " ".join(w), "en"), (i + 100, " ".join(w).upper(), "en"), (i + 200, " ".join(w), "en")][: rng.randint(1, 3)]
    got = jaccard_rtree.jaccard_components(frame(spark, rows), count_links=True)
    assert collected(got, "doc_id", "n_links") == brute_links(rows)
    assert collected(got, "doc_id", "n_shingles", "component_id") == Counter(brute.jaccard(pairs(rows)))


def test_links_of_few_and_of_many_pairs():
    rng = np.random.default_rng(9)
    for size, keep in ((40, 0.95), (40, 0.9), (3, 0.9), (12, 0.3)):
        base = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
        one, two = ([np.unique(base[rng.random(3000) < rng.uniform(keep, 1)]) for _ in range(size)] for _ in range(2))
        got = jaccard_rtree.linked(one, two)
        for i, a in enumerate(one):
            for j, b in enumerate(two):
                both = len(np.intersect1d(a, b))
                assert got[i, j] == (100 * both >= 80 * (len(a) + len(b) - both))


def test_no_task_compares_a_passage_in_all_its_surroundings(spark, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", 20)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i % 90, " ".join(word() for _ in range(40)) + f" {passage} " + " ".join(word() for _ in range(40))) for i in range(120)]
    plain = anchors.versioned(spark.createDataFrame(rows, "doc_id bigint, text string"))
    versions = {(r["doc_id"], r["text"]): r["version"] for r in plain.collect()}

    def bounded(resolve):
        def work(columns):
            assert np.unique(columns["anchor"], return_counts=True)[1].max(initial=0) <= 20
            return resolve(columns)
        return work

    def removed(unit, length, k, first, piece, resolve, bounds):
        marked = anchors.repeated(plain, unit, length, k, first, piece, bounded(resolve), 48_000)
        out = Counter()
        for r in marked.collect():
            gone = np.zeros(bounds(r["text"]), bool)
            for s in r["spans"] or ():
                gone[s["first"] : s["first"] + s["windows"] + length - 1] = True
            out[r["doc_id"], len(gone), int(gone.sum())] += 1
        return out

    got = removed(substring_dedup.word_units, 35, 16, False, substring_dedup._piece, lambda c: substring_dedup.extended(c), lambda t: len(t.split()))
    assert got == Counter(r[:3] for r in brute.substring_dedup(rows))
    got = removed(bwt_dedup.byte_units, 100, 24, True, bwt_dedup._piece, lambda c: bwt_dedup.later_windows(c), len)
    assert got == Counter(r[:3] for r in brute.suffix_dedup(rows, order=versions.get))
