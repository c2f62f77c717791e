import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chainalerts.llm import pairwise_quality as P
from chainalerts.llm.common import text_bytes
from tests.llm.conftest import SF

LABELS = "doc_id long, quality int, toxic int, score double, features string"


def plain_features(text):
    """The features by plain Python, from their description."""
    raw = (text or "").encode()
    n, wide = len(raw), list(P.CLASSES.values())
    shares = [sum(b in set(members) for b in raw) / max(n, 1) for members in wide]
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]
    triples = [tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    distinct = lambda xs: len(set(xs)) / len(xs) if xs else 1.0
    share = lambda k: k / len(words) if words else 0.0
    symbols = set(b"#$%&*|!<>{}[]/\\=+_~^`@")
    return shares + [math.sqrt(x) for x in shares] + [
        math.log1p(n), math.log1p(len(words)), math.log1p(n / len(words) if words else 1.0), distinct(words),
        distinct(triples), distinct(lines), share(sum(a == b for a, b in zip(words, words[1:]))),
        share(sum(w[-1] in symbols for w in words)), math.log1p(len(words) / len(lines) if lines else 1.0), float(not words)]


def test_features(edges, texts, monkeypatch):
    all_ = [t for _, t in edges] + list(texts.values())[:80]
    want = np.array([plain_features(t) for t in all_])
    got = P.features(*text_bytes(pa.array(all_)))
    assert got.shape[1] == P.N_FEATURES and np.allclose(got, want)
    monkeypatch.setattr(P, "CHUNK_BYTES", 1000)  # long texts go piece by piece
    assert np.allclose(P.features(*text_bytes(pa.array(all_))), want)


def test_pairs():
    for n, m in [(1, 1), (1, 5), (5, 1), (40, 30), (30, 40), (3, 20)]:
        good, bad = P.pairs(n, m)
        assert len(set(zip(good.tolist(), bad.tolist()))) == len(good) == max(n, m) * min(n, m, P.PAIRS)
        assert set(good) == set(range(n)) and set(bad) == set(range(m))


def test_bradley_terry_is_the_least_loss():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.4, 1, (60, 4)), rng.normal(0, 1, (50, 4))
    w = P.bradley_terry(good, bad)

    def loss(w):
        return np.mean([math.log1p(math.exp(-w @ (good[i] - bad[j]))) for i, j in zip(*P.pairs(60, 50))]) + P.RIDGE / 2 * w @ w

    assert all(loss(w) <= loss(w + rng.normal(0, 0.02, 4)) for _ in range(50))
    # Scores tell how often one is preferred: a known ranking comes back from its own choices.
    strong = np.array([[2.0], [1.0], [0.0]])
    assert P.bradley_terry(strong[:1], strong[2:])[0] > 0


def test_best_cut():
    counts = {(0, 0): 5, (1, 1): 1, (2, 0): 3, (6, 1): 10, (7, 1): 2}
    edge, quantile = P.best_cut(counts, 8)
    assert 3 <= edge <= 6 and quantile == 9 / 21


def run(spark, make_documents, rows, labels):
    docs = P.described(make_documents(rows))
    return P.scored(docs, P.train(docs, spark.createDataFrame([(i, q, 0, 0.5, "x") for i, q in labels], LABELS)))


def test_edges_and_no_labels(spark, make_documents, edges):
    got = run(spark, make_documents, edges, [(i, 1) for i in (1, 2, 4, 5, None)] + [(7, None), (8, 5)])
    rows = got.collect()
    assert got.columns == ["id", "held_out", "score", "predicted"] and len(rows) == len(edges)
    trained = {i for i in (1, 2, 4, 5) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {round(r["score"], 9) for r in rows} == {round((len(trained) + 1) / (len(trained) + 2), 9)}
    assert run(spark, make_documents, [], []).count() == 0
    assert {r["score"] for r in run(spark, make_documents, edges, []).collect()} == {0.5}
    # Both labels, with ties, nulls and contradictions.
    rows = run(spark, make_documents, edges, [(i, i % 2) for i in range(1, 13)] + [(5, 0)]).collect()
    assert len(rows) == len(edges) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by = {}
    for r in rows:
        assert r["held_out"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 3 == 1)
        by.setdefault(r["id"], set()).add(r["score"])
    assert len(by[5] | by[6]) == 1  # equal texts, equal scores


def test_repeated_ids_and_heldout_labels(spark, make_documents):
    good = [(i, f"Some plain words about topic{i} and more of them to read.") for i in range(200)]
    bad = [(1000, f"BUY!! NOW{i}!! ### $$$ BUY!! NOW!!") for i in range(300)]  # one id for all of them
    assert zlib.crc32(b"1000") % 3 != 1
    rows = run(spark, make_documents, good + bad, [(i, 1) for i in range(200)] + [(1000, 0)])
    got = {(r["id"] == 1000, r["predicted"]) for r in rows.collect()}
    assert got == {(True, 0), (False, 1)}
    # Labels of held-out rows change nothing.
    labels = [(i, 1) for i in range(200)] + [(1000, 0)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    same = run(spark, make_documents, good + bad, turned)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.collect()))


def test_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    got = P.op13_pairwise_quality(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").groupBy("quality").agg(
        F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right")).collect()
    assert {r["quality"] for r in rows} == {0, 1} and all(r["right"] >= 0.95 for r in rows)
