import hashlib
import re

import numpy as np
import pytest

from chainalerts.llm import fm_index as M
from chainalerts.llm.queries import QUERIES
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window):
    phrases = {}
    for name, text in items:
        found = words(text)
        for k in range(max(1, len(found) - window + 1) if found else 0):
            phrases.setdefault(tuple(found[k:k + window]), set()).add(str(name))
    result = []
    for i, text in rows:
        found, hit, names = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(found) - n + 1):
                if owners := phrases.get(tuple(found[k:k + n])):
                    names |= owners
                    hit |= set(range(k, k + n))
        result.append((str(i), len(found), len(hit), ",".join(sorted(names))))
    return sorted(result)


def plain(frame):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in frame.collect())


@pytest.mark.parametrize("symbols, n", [(1, 50), (2, 300), (5, 1000), (300, 2000), (3, 1)])
def test_index(symbols, n):
    random = np.random.default_rng(symbols)
    text = np.concatenate([[0], random.integers(0, symbols + 1, n)])
    text = np.concatenate([text, text[: n // 2]])  # long repeats
    order = M.suffix_array(text, symbols)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = M.FMIndex(text, symbols, sample=7)
    patterns = [text[a:a + k] for a in range(0, len(text) - 6, 5) for k in (1, 2, 6)] + [np.array([symbols, symbols, 1])]
    patterns = [p for p in patterns if (p > 0).all()]
    rows = np.array([[0] * (6 - len(p)) + p.tolist() for p in patterns]).reshape(-1, 6)
    for pattern, low, high in zip(patterns, *index.search(rows)):
        want = [i for i in range(len(text) - len(pattern) + 1) if text[i:i + len(pattern)].tolist() == pattern.tolist()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == want


ITEMS = [("b", "One two three four"), ("a", "two THREE four five six"), ("c", "short"), ("d", None), (None, "one two"), ("e", "..."),
         ("f", "one two three four"), ("g", "été très"), ("h", "word1 word2 word3 word4 word5")]
MORE = [(50, "x one, two; three-four! five six short"), (51, "three four"), (52, "ÉTÉ été  très été"), (53, "short short"),
        (54, "one two three one two three four five six"), (54, "one two three one two three four five six")]


@pytest.mark.parametrize("window, block", [(3, 1 << 20), (3, 30), (13, 1 << 20), (1, 60)])
def test_contamination(spark, make_documents, edges, window, block):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    rows = [*edges, *MORE]
    got = M.contamination(make_documents(rows), items, window, block_bytes=block)
    assert plain(got) == brute(rows, [x for x in ITEMS if x[0] and x[1]], window)


def test_spans_cover_the_hit_words(spark, make_documents):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for block in (1 << 20, 20):
        got = {r["doc_id"]: r for r in M.contamination(make_documents(MORE[:5]), items, 3, block_bytes=block).collect()}
        text = dict(MORE)
        assert [text[50][s["start"]:s["end"]] for s in got[50]["spans"]] == ["one, two; three-four! five six short"]
        assert [text[52][s["start"]:s["end"]] for s in got[52]["spans"]] == ["été  très"]
        assert [(s["first"], s["last"]) for s in got[54]["spans"]] == [(0, 9)]


def test_query(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(texts.items(), items, 13)
    got = QUERIES["op5_fm_decontamination"](spark, SF).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items_sha256"], r["n_items"], r["contaminated"]) for r in got) == [
        (i, n, h, hashlib.sha256(x.encode()).hexdigest(), len(x.split(",")) if x else 0, h > 0 and 20 * h >= n) for i, n, h, x in want]


def test_clean(spark, make_documents):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    documents = make_documents([(1, "one two three four"), (2, "filler " * 100 + "one two three four"), (3, None)])
    kept = M.clean(documents, items)
    assert kept.columns == documents.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert M.clean(make_documents([]), items).count() == 0
    assert M.clean(documents, items.filter("false")).count() == 3


def test_items_without_an_id_hit(spark, make_documents):
    items = spark.createDataFrame([(None, "one two three four"), ("a", "four five"), (None, None)], "item_id string, text string")
    documents = make_documents([(1, "one two three four"), (2, "x one two three four five"), (3, "x")])
    for block in (1 << 20, 10):
        got = M.contamination(documents, items, 3, block_bytes=block, unnamed=True)
        assert plain(got) == [("1", 4, 4, ""), ("2", 6, 5, "a"), ("3", 1, 0, "")]
    assert [r["doc_id"] for r in M.clean(documents, items).collect()] == [3]


def test_query_counts_items_without_an_id(spark, make_documents, tmp_path):
    make_documents([(1, "one two three four")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "one two three four")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = QUERIES["op5_fm_decontamination"](spark, str(tmp_path)).first()
    assert (row["n_hit"], row["n_items"], row["contaminated"]) == (4, 0, True)


def test_a_repeated_id_is_spread_over_blocks(spark, make_documents):
    rows = [("a", f"one{i} two{i} three{i}") for i in range(400)]
    items = spark.createDataFrame(rows, "item string, text string")
    sizes = [r["count"] for r in items.groupBy(M.block_of(8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100
    documents = make_documents([(1, "one1 two1 three1 x one2 two2 three2"), (2, "x")])
    got = M.contamination(documents, items, 3, item_col="item", block_bytes=2000)
    assert plain(got) == [("1", 7, 6, "a"), ("2", 1, 0, "")]
