"""Fill-in-middle against a plain version of its contract, and the border set against a list."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import sha
from conftest import frame
from pyspark.sql import functions as F

from fleetlens.llm import fill_middle as M

TOKENS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(doc_id, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(tokens), form, len(prefix), len(middle), sha(output), sha(text)


def test_contract(docs, rows):
    got = Counter(tuple(r) for r in M.digests(M.fill_in_middle(docs)).collect())
    assert got == Counter(plainly(d, t) for d, t, _ in rows)


def test_markers_and_their_halves(spark):
    texts = ["a<P>b", "<M>", "x <S> y", "<P <S <M", "P>S>M>", "<<P", "< P>", "<" * 50, "é<S", "\n\x00<", "漢" * 9 + "<P"]
    rows = [(i, t, None) for i, t in enumerate(texts * 20)]
    got = Counter(tuple(r) for r in M.digests(M.fill_in_middle(frame(spark, rows))).collect())
    assert got == Counter(plainly(d, t) for d, t, _ in rows)


def test_no_rows(empty):
    assert M.digests(M.fill_in_middle(empty)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab ") for _ in range(700_000)) + "." * 300_000 + "z" * 300_000 + "é" * 200_000
    rows = [(i, text, None) for i in range(6)]
    got = Counter(tuple(r) for r in M.digests(M.fill_in_middle(frame(spark, rows))).collect())
    assert got == Counter(plainly(d, t) for d, t, _ in rows)


@pytest.mark.parametrize("share", [0, 0.001, 0.05, 0.5, 0.999, 1])
def test_containers_select_every_member(share):
    rng = np.random.Generator(np.random.PCG64(7))
    for size in (1, 63, 5000, M.SPAN):
        member = rng.random(size) < share
        found = M.container(member)
        expected = np.flatnonzero(member).tolist()
        assert [found.select(k) for k in range(len(expected))] == expected
    sides = np.zeros(M.SPAN, bool)
    sides[100:30_000] = sides[40_000:40_002] = True
    assert isinstance(M.container(sides), M.RunContainer)
    assert isinstance(M.container(rng.random(M.SPAN) < 0.4), M.BitmapContainer)
    assert isinstance(M.container(rng.random(M.SPAN) < 0.01), M.ArrayContainer)


def test_border_set_over_containers():
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh .") for _ in range(3 * M.SPAN)) + "w" * M.SPAN + "1" * M.SPAN + "漢" * 10
    borders = M.BorderSet(text)
    ends, at = [0], 0
    for token in TOKENS.findall(text):
        at += len(token)
        ends.append(at)
    assert borders.size == len(ends) - 1
    picks = [0, 1, 2, borders.size, *(rng.randrange(borders.size) for _ in range(3000))]
    assert [borders.offset(k) for k in picks] == [ends[k] for k in picks]


def test_cuts_are_taken_once(docs):
    plan = M.digests(M.fill_in_middle(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("cuts(") == 1


def test_restored_is_null_for_unknown_forms(spark):
    assert spark.range(1).select(M.restored(F.lit("x"), F.lit("other"))).first()[0] is None
