"""Rows with swapped nulls, words that a hash of powers can't tell apart, and columns of any type."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from chainalerts.llm import circulant_minhash, fm_index, host_rules, line_runs, prefix_free
from chainalerts.llm.common import row_key, span_hashes, text_bytes
from tests.llm.conftest import SF

STRINGS = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text", "lang", "source")] + [
    T.StructField("n_chars", T.LongType())])


def swapped(long):
    """Ids and texts that change places with null."""
    return [("0", long), (None, long), (long, None), ("2", long), (None, None), ("abc", None), (None, "abc")]


@pytest.fixture
def strings(spark):
    return lambda rows: spark.createDataFrame([(*r, None, None, None if r[1] is None else len(r[1])) for r in rows], STRINGS)


def thue_morse(n, swap=False):
    """Words whose letters' weighted sums are equal, whatever the weights of letter and place."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_span_hashes_tell_words_apart():
    words = [thue_morse(n, s) for n in (8, 64, 128, 1024, 4096) for s in (False, True)]
    words += ["", "a", "aa", "a" * 8, "a" * 9, "a\0", "a" * 64, "a" * 65, "a" * 64 + "b"]
    words += [f"word{i}" for i in range(3000)] + [f"a much longer word number {i}" for i in range(3000)]
    data, ends = text_bytes(pa.array(words))
    got = span_hashes(data, ends[:-1], ends[1:])
    assert len(set(got.tolist())) == len(set(words))
    # A hash depends on the span only, not on what lies around it.
    again, ends = text_bytes(pa.array(["xyz" + w + "x" for w in words]))
    assert np.array_equal(span_hashes(again, ends[:-1] + 3, ends[1:] - 1), got)


def test_row_key(spark):
    kind = "a string, b string, c array<string>, d map<string,string>, e struct<x:int>"
    rows = [(None, "x", None, None, None), ("x", None, None, None, None), ("x", "x", None, None, None),
            ("x", "x", [None, "x"], None, None), ("x", "x", ["x", None], None, None), ("x", "x", ["x"], None, None),
            ("x", "x", [], {}, None), ("x", "x", [], {"k": None}, None), ("x", "x", [], {"k": "v"}, (None,)),
            ("x", "x", [], {"k": "v"}, None), ("x", "x", [], {"k": "v"}, (1,))]
    frame = spark.createDataFrame(rows, kind)
    keys = frame.select(*row_key(*frame.columns, of=frame)).collect()
    assert len({r[0] for r in keys}) == len({r[1] for r in keys}) == len(rows)


def test_line_runs_swapped_nulls(strings):
    long = "shared line\n" + "own " * 60
    rows = swapped(long) + [(f"n{i}", f"shared line\nabc\n{i}") for i in range(12)]
    got = line_runs.line_dedup(strings(rows), 10).collect()
    keys = {"shared line", "abc"}
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if x not in keys)) for i, t in rows]
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=str) == sorted(want, key=str)


def test_repeats_swapped_nulls(strings):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(250))
    rows = swapped(long)
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in prefix_free.remove_repeats(strings(rows)).collect()}
    assert got == {(i, len(t or ""), 250 if t == long else 0) for i, t in rows}


def test_near_duplicates_swapped_nulls(strings):
    text = " ".join(f"word{i}" for i in range(40))
    kept = circulant_minhash.deduplicated(strings(swapped(text))).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted(
        [("0", text), (text, None), (None, None), ("abc", None), (None, "abc")], key=str)


def test_words_of_equal_weight(strings, spark):
    one, other = thue_morse(1024), thue_morse(1024, True)
    rows = circulant_minhash.near_duplicates(strings([("1", one), ("2", other), ("3", one)]), 3, 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {("1", "1"), ("2", "2"), ("3", "1")}
    items = spark.createDataFrame([("a", one), ("b", other)], "item_id string, text string")
    found = fm_index.contamination(strings([("1", one), ("2", other), ("3", "x")]), items).collect()
    assert {(r["doc_id"], tuple(r["items"])) for r in found} == {("1", ("a",)), ("2", ("b",)), ("3", ())}


def test_benchmark_in_blocks_and_copies(strings, spark):
    """Any number of blocks gives the same; equal rows stay as many."""
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(20))) for k in range(30)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    texts = [f"before {items[k][1]} and {items[k + 1][1]} after" for k in range(5)] + [items[3][1]] * 6 + ["clean", "", None]
    rows = [(str(min(k, 6)), t) for k, t in enumerate(texts)]
    plain = lambda frame: sorted([tuple(map(str, r)) for r in frame.collect()])
    whole = plain(fm_index.contamination(strings(rows), benchmark))
    assert len(whole) == len(rows)
    for size in (400, 5000):
        assert plain(fm_index.contamination(strings(rows), benchmark, block_bytes=size)) == whole
        left = fm_index.clean(strings(rows), benchmark, block_bytes=size)
        assert sorted((r["text"] or "") for r in left.collect()) == ["", "", "clean"]


def test_stages_take_swapped_nulls_and_maps(spark, strings):
    long = " ".join(f"word{i}" for i in range(80))
    frame = strings(swapped(long))
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got[name] = stage(spark, frame, SF).count()
    assert got == {"quality": 3, "line_dedup": 7, "near_duplicates": 5, "decontamination": 7}
    odd = frame.selectExpr("*", "map('k', source) AS tags", "array(lang) AS langs", "named_struct('a', 1) AS s")
    assert host_rules.accepted(odd).count() == 3 and host_rules.accepted(odd).columns == odd.columns
    assert fm_index.clean(odd, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 7
