"""The divergence audit against dense arithmetic."""

import random
import re
from collections import Counter, defaultdict

import pytest
from brute import LOWER

from fleetlens.llm import source_audit as S
from fleetlens.llm import words as W

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows, documents=10, ranks=10):
    counts, docs, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = TERMS.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        docs.update((lang, term) for term in set(found))
    kept = defaultdict(list)
    for (lang, term), n in docs.items():
        if n >= documents:
            kept[lang].append(term)

    def shares(count, terms):
        total = sum(count[t] for t in terms)
        return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(terms)) for t in terms}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {lang for lang, _ in groups}:
        sources = sorted(source for at, source in groups if at == lang)
        p = {source: shares(counts[lang, source], kept[lang]) for source in sources}
        whole = Counter()
        for source in sources:
            whole.update(counts[lang, source])
        q = shares(whole, kept[lang])
        for source in sources:
            values = [(-sum(f(p[source][t], p[other][t]) for t in kept[lang]), other.encode()) for other in sources if other != source]
            out += [(lang, source, "pair", item.decode(), -value, i) for i, (value, item) in enumerate(sorted(values), 1)]
            values = [(-f(p[source][t], q[t]), t.encode()) for t in kept[lang] if counts[lang, source][t] and p[source][t] > q[t]]
            out += [(lang, source, "term", item.decode(), -value, i) for i, (value, item) in enumerate(sorted(values)[:ranks], 1)]
    return Counter(out)


def rows_of(seed=1):
    rng = random.Random(seed)
    words = ["the", "and", "Ünïon", "漢字", "fox", "dog", "cat", "a", "b", "rare", "Zürich", "naïve"]
    rows = []
    for lang, sources in (("en", ["s1", "s2", "s3", "é", ""]), ("fr", ["s1", "s2"]), ("de", ["only"]), (None, [None, "s1", "s2"])):
        for _ in range(60):
            n = rng.randint(1, 12)
            rows.append((" ".join(rng.choice(words[: 4 + rng.randint(0, 8)]) for _ in range(n)), lang, rng.choice(sources)))
    rows += [("copied text, MANY times; the fox", "en", s) for s in ["s1"] * 40 + ["s2"] * 3 + ["s3"]]
    rows += [(None, "en", "null text"), ("", "en", "empty"), (" 12 - !", "xx", "no terms"), (None, "xx", None), ("one two", "few", "a"), ("one three", "few", "b")]
    rows += [("tie alpha beta", "tie", "s1")] * 12 + [("tie alpha beta", "tie", "s2")] * 12
    rows += [("x" * 3_000_000 + " fox " + "long text " * 300_000, "en", "s1")] * 2
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y", 1, "z") for r in rows], "text string, lang string, source string, term string, part string, copies int, item string"
    )


def test_contract(spark):
    rows = rows_of()
    got = Counter(tuple(r) for r in S.source_divergence(frame(spark, rows).repartition(5)).collect())
    assert got == plainly(rows)


def test_kept_from_other_thresholds(spark):
    rows = rows_of(2)
    got = Counter(tuple(r) for r in S.source_divergence(frame(spark, rows), documents=2, ranks=3).collect())
    assert got == plainly(rows, 2, 3)


def test_small_tasks_hold_little(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 5)
    monkeypatch.setattr(S, "HELD_BYTES", 50)
    rows = rows_of(3)[:-2]
    got = Counter(tuple(r) for r in S.source_divergence(frame(spark, rows).repartition(3)).collect())
    assert got == plainly(rows)


def test_no_rows(spark):
    assert S.source_divergence(frame(spark, [])).count() == 0


def test_a_copied_text_is_one_row_of_a_task(spark):
    rows = [("same text", "en", f"s{i % 3}") for i in range(900)]
    sent = S.collapsed_here(frame(spark, rows).repartition(4))
    found = sent.collect()
    assert sum(r["text"] is not None for r in found) == sent.rdd.getNumPartitions()
    assert sum(r["copies"] for r in found) == 900 and len(found) <= 4 * 4


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
@pytest.mark.parametrize("table, pattern", [(W.PROSE, r"[^\x20\x09-\x0D]+"), (W.TERM, TERMS.pattern)])
def test_words_of_blocks(size, table, pattern):
    text = "The  quick\tBROWN\n\nfox—Zürich, ÀB 漢字 x1y2\x0b end "
    expected = [w.encode() for w in re.findall(pattern, text.translate(LOWER))]
    assert [w for found in W.blocks(text.encode(), table, size) for w in found] == expected
    assert list(W.blocks(b"", table, size)) == []
