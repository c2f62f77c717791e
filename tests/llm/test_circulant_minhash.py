import random
import re

import numpy as np
import pytest

from chainalerts.llm import circulant_minhash as C
from chainalerts.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def roots(nodes, edges):
    parent = {n: n for n in nodes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    edges = []
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                edges.append((x, y))
    label = roots(range(len(rows)), edges)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[label[x]] = min(i, least.get(label[x], i))
    result = []
    for x, (i, _) in enumerate(rows):
        component = least.get(label[x]) if sets[x] else i
        result.append((str(i), len(sets[x]), str(component), component == i))
    return sorted(result)


def plain(frame):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in frame.collect())


def family(seed, n, words, edits):
    """Near copies of one text: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randint(0, 10_000)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [256, 8])
def test_like_brute_force(make_documents, edges, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = [*edges, *[(100 + i, t) for i, t in enumerate(family(1, 150, 120, 9) + family(2, 40, 30, 3) + family(3, 40, 400, 40))]]
    random.Random(5).shuffle(rows)
    assert plain(C.near_duplicates(make_documents(rows), 3, 85)) == brute(rows, 3, 85)


def test_documents(documents, texts):
    rows = list(texts.items())
    assert plain(C.near_duplicates(documents, 3, 85)) == brute(rows, 3, 85)
    assert plain(C.near_duplicates(documents)) == brute(rows, 5, 80)


def test_deduplicated(make_documents, edges):
    kept = C.deduplicated(make_documents(edges))
    assert kept.columns == make_documents([]).columns
    # Of the five rows of one text the least id stays, equal rows once; empty ones all stay.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "None", "7", "8", "9", "11", "12"])
    twice = C.deduplicated(make_documents([(6, edges[4][1])] * 3 + [(None, "a b"), (None, "a b")]))
    assert sorted(str(r["doc_id"]) for r in twice.collect()) == ["6", "None"]
    assert C.deduplicated(make_documents([])).count() == 0 == C.near_duplicates(make_documents([])).count()


def test_circulant_estimates_similarity():
    a = np.arange(2000, dtype=np.uint64)
    for shared in (500, 1500, 1900):
        b = np.concatenate([a[:shared], np.arange(10**6, 10**6 + 2000 - shared, dtype=np.uint64)])
        got = (C.signature(a, 512) == C.signature(b, 512)).mean()
        assert abs(got - shared / (4000 - shared)) < 0.08
    # Coordinate k is coordinate 0 of the circle turned by k.
    pi = C._numbers(1)[:, 0]
    place = (C.mix(a + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(44)).astype(np.int64)
    assert C.signature(a, 20).tolist() == [int(pi[(place + k) % C.POINTS].min()) for k in range(20)]


def test_bands_miss_rarely():
    for t in (0.8, 0.85, 0.95):
        assert (1 - t**C.ROWS) ** C.bands_for(t) <= C.MISS


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 101)],
    [(random.Random(4 + i).randint(0, 200), random.Random(900 + i).randint(0, 200)) for i in range(150)],
])
def test_components(spark, edges):
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots({x for e in real for x in e}, real)
