import collections
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from chainalerts.llm import packing
from tests.llm.conftest import SF
from tests.llm.test_circulant_minhash import brute as near
from tests.llm.test_fm_index import brute as hits
from tests.llm.test_host_rules import brute as measures
from tests.llm.test_line_runs import key


def test_pipeline_like_brute_force(spark, documents):
    """No host of the small table fails as a whole, so the base rules decide."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows = [(i, t) for i, t in rows if not measures(t)[-1]]
    counts = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    rows = [(i, "\n".join(x for x in t.split("\n") if not key(x) or counts[key(x)] < 10)) for i, t in rows]
    kept = {i for i, _, _, stays in near(rows, 5, 80) if stays}
    rows = [(i, t) for i, t in rows if str(i) in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {i for i, n, h, _ in hits(rows, items, 13) if h and 20 * h >= n}
    assert dirty
    rows = [(i, t) for i, t in rows if str(i) not in dirty]
    encoder = Tokenizer.from_file(packing.tokenizer_files()[0])
    want = set()
    for i, text in rows:
        ids = np.array(encoder.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want |= {(i, a, n, zlib.crc32(ids[a:a + n].tobytes()), len(ids)) for a, n in packing.pieces_of(len(ids), 2048)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len({r["sequence_id"] for r in got}) == len(want)
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want


def test_stages_on_edges(spark, make_documents, edges):
    for rows in (edges, []):
        for name, stage in corpus_pipeline.STAGES:
            documents = make_documents(rows)
            got = stage(spark, documents, SF)
            if name != "packing":
                assert got.columns == documents.columns and got.dtypes == documents.dtypes, name
            assert got.count() >= 0
    lines = corpus_pipeline.line_dedup(spark, make_documents([(i, f"same\nown {i}") for i in range(10)]), SF)
    assert {(r["text"], r["n_chars"]) for r in lines.collect()} == {(f"own {i}", 5) for i in range(10)}
