import hashlib
import math

import numpy as np
import pytest

from chainalerts.llm import vector_codes as V
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, __label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over whole numbers of any size."""
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) or abs(256 * np.float32(x)) >= V.LARGEST for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == length]
    ends = [0]
    for k in range(parts):
        ends.append(ends[-1] + length // parts + (k < length % parts))
    cut = [[v[a:b] for a, b in zip(ends, ends[1:])] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            row = []
            for p in range(parts):
                far = [sum((x - y) ** 2 for x, y in zip(v[p], e)) for e in books[p]]
                row.append((far.index(min(far)), min(far)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, row in zip(cut, found) if row[p][0] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [
        (i, "".join(f"{e:02x}" for e, _ in row), sum(d for _, d in row), label)
        for (i, _, label), row in zip(kept, assign())]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return [(i, code, error, sum(r[2] for r in out if r[3] == label), sha) for i, code, error, label in out]


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)
    model = V.VectorCodes(frame, **options)
    for _ in range(2):
        model.round()
    got = V.with_label_errors(model.codes(), "label").collect()
    return [(r["vec_id"], r["code"], r["error"], r["label_error"], model.sha256()) for r in got]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_like_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.3, 32).tolist(), None if i % 5 == 0 else int(i) % 3) for i in rng.permutation(300)]
    bad = [[None] + [0.1] * 31, [math.nan] * 32, [math.inf] + [0.0] * 31, [-math.inf] * 32, None, [1e30] * 32, [], [0.1] * 31]
    rows += [(400 + k, v, 1) for k, v in enumerate(bad)]
    rows += [(500, [0.0] * 32, 7)] * 40 + [(None, [0.25] * 32, None), (3, [-0.001] * 32, 2), (3, [9.0] * 32, 2)]
    want = ordered(brute(rows))
    assert len(want) == 343 and ordered(run(spark, rows)) == want


def test_shapes(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VALUES", 20)  # many blocks a batch
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 2, 7).tolist(), i % 2) for i in range(50)]
    assert ordered(run(spark, rows, parts=3, entries=5)) == ordered(brute(rows, 3, 5))
    assert ordered(run(spark, rows[:4])) == ordered(brute(rows[:4]))  # fewer rows than entries
    empty = [(1, [], 1), (2, [], None)]
    assert ordered(run(spark, empty)) == ordered(brute(empty))
    assert run(spark, []) == run(spark, [(1, None, 1), (2, [None], 1)]) == []
    with pytest.raises(ValueError):
        run(spark, [], entries=257)


def test_ties_and_unused():
    codes = np.array([[0, 1, 2]])
    best, error = V.nearest([np.array([0, 2, 4])], codes, np.array([[1], [3], [1]]), np.array([0, 1]))
    assert best.tolist() == [[0, 0, 1]] and error.tolist() == [[1, 1, 1]]


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = V.op12_vector_codes(spark, SF)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table]
    assert ordered(map(tuple, got.collect())) == ordered(brute(rows))
