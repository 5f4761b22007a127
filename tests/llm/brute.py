"""Plain versions of the operators' contracts, over a list of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
PROSE = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return (text or "").translate(LOWER)


def substring_dedup(docs, length=35):
    distinct = sorted(set(docs), key=repr)
    words = {d: PROSE.findall(d[1] or "") for d in distinct}
    seen = Counter(tuple(w[j : j + length]) for w in words.values() for j in range(len(w) - length + 1))
    out = []
    for d in docs:
        w = words[d]
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        out.append((d[0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix_dedup(docs, length=100, order=None):
    """``order`` sorts rows that share a doc_id."""
    first, result = {}, {}
    for d in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, order(d) if order else 0)):
        data = (d[1] or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            if data[j : j + length] in first:
                gone[j : j + length] = b"\1" * length
            else:
                first[data[j : j + length]] = True
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        result[d] = (d[0], len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone) if not g)))
    return [result[d] for d in docs]


def shingles(text, k=5):
    w = PROSE.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard(docs, percent=80):
    sets = [shingles(text) for _, text in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in by[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for g in s:
            by[g].append(i)
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), smallest.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(docs, sets))]


def contamination(docs, items, size=13):
    windows = defaultdict(set)
    for item_id, text in items:
        w = WORDS.findall(lower(text))
        if item_id is not None and w:
            for i in range(max(len(w) - size, 0) + 1):
                windows[tuple(w[i : i + size])].add(str(item_id))
    out = []
    for doc_id, text in docs:
        w = WORDS.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def quality_base(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        w = PROSE.findall(text)
        lines, dup = set(), 0
        for line in text.split("\n"):
            if PROSE.search(line):
                dup += line in lines
                lines.add(line)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(grams)
        repeated = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed))
    return out


def license_base(docs, phrases=(("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))):
    out = []
    for doc_id, text in docs:
        w = WORDS.findall(lower(text))
        places, labels = [], set()
        for phrase, label in phrases:
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return out
