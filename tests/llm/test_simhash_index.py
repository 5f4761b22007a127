"""Fingerprints and their components against brute force."""

import random
from collections import Counter, defaultdict

import pytest
import xxhash
from brute import PROSE, lower
from conftest import frame

from fleetlens.llm import simhash_index as S
from fleetlens.llm import words as W


def plain_fingerprint(text):
    w = PROSE.findall(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values):
    """The smallest value that each one reaches in steps of two bits."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def plainly(docs):
    made = [(doc_id, plain_fingerprint(text)) for doc_id, text in docs]
    root = grouped(fp for _, fp in made)
    smallest = {}
    for doc_id, fp in made:
        if doc_id is not None:
            smallest[root[fp]] = min(smallest.get(root[fp], doc_id), doc_id)
    return Counter((doc_id, f"{fp:016x}", smallest.get(root[fp])) for doc_id, fp in made)


def found(docs, **options):
    rows = S.simhash_components(docs, **options).withColumn("fp", S.hexadecimal(S.F.col("fp"))).collect()
    return Counter(tuple(r) for r in rows)


def test_contract(docs, rows):
    assert found(docs) == plainly([(d, t) for d, t, _ in rows])


def near_rows():
    """One text in many versions, so that many fingerprints are within a few bits."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(300)] = f"w{rng.randrange(50)}"
        rows.append((5000 - i, " ".join(words), None))
    return rows + [(None, rows[0][1], None), (None, "alone with a null id", None), (1, None, None), (2, "", None), (3, " \n", None)]


@pytest.mark.parametrize("full", [0, 2, 64])
def test_near_copies_whatever_is_full(spark, full):
    rows = near_rows()
    assert found(frame(spark, rows).repartition(3), full=full) == plainly([(d, t) for d, t, _ in rows])


@pytest.mark.parametrize("full", [0, 3, 64, 10**6])
def test_links_connect_all_within_two_bits(spark, full):
    rng = random.Random(full)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63, 1 << 31, 1 << 32, (1 << 32) - 1}
    for v in list(values):
        for _ in range(6):
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    high = rng.getrandbits(32) << 32
    values |= {high | (1 << i) ^ (1 << j) for i in range(0, 32, 3) for j in range(1, 32, 5)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = [tuple(r) for r in S.links(classes, full).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 and a != b for a, b in edges)
    parts = defaultdict(set)
    for v, root in grouped(values).items():
        parts[root].add(v)
    own = {v: v for v in values}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in edges:
        x, y = find(a & mask), find(b & mask)
        own[max(x, y)] = min(x, y)
    ours = defaultdict(set)
    for v in values:
        ours[find(v)].add(v)
    assert dict(ours) == dict(parts)


def test_blocks_give_the_same_fingerprint(monkeypatch):
    import numpy as np

    text = "The  quick brown\tfox jumps — over the lazy dog, Ünïon of words " * 40
    whole = S.fingerprint(np.frombuffer(text.encode(), np.uint8))
    assert whole & (1 << 64) - 1 == plain_fingerprint(text)
    blocks = W.blocks
    for size in (1, 5, 64, 1000):
        monkeypatch.setattr(W, "blocks", lambda data, table, size=size: blocks(data, table, size))
        assert S.fingerprint(np.frombuffer(text.encode(), np.uint8)) == whole


def test_shingles_are_hashed_like_the_engine_does(spark):
    texts = ["", "a", "some words here", "x" * 31, "y" * 32, "é" * 40, "z" * 333]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.F.xxhash64("t")).collect()
    assert [r[0] & (1 << 64) - 1 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_no_rows(empty):
    assert S.simhash_components(empty).count() == 0


def test_one_of_each(docs, rows):
    ids = {r[0] for r in S.one_of_each(docs).collect()}
    assert ids == {c for _, _, c in plainly([(d, t) for d, t, _ in rows]) if c is not None}
