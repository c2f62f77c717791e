import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chainalerts.llm import packing as P


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(P.tokenizer_files()[0])


def test_both_ways_agree(plain):
    random.seed(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "中", "\u00a0", "\u2028", "\u200b", "\x1c",
                "\u180e", "\ufeff", "\u0085", "😀", "<|endoftext|>", "the", " the", "-", "\r\n", "\u3000"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)] + ["", " ", "a" * 5000]
    texts += [chr(i) + " a" + chr(i) * 2 + " 1" + chr(i) for i in range(1, 0x300)]
    texts += [" " * 300 + "a", "a" + "\n" * 300, "a" + " \u00a0" * 300 + "b", " " * 200, " " * 201, "a" + " " * 100_000]
    encoder = P.Encoder(*P.tokenizer_files())
    column = pa.array(texts)
    assert 500 < sum(encoder._plain(np.frombuffer(t.encode(), np.uint8), t) for t in texts) < len(texts) - 500
    for text, ids in zip(texts, encoder.encode(column)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    alone = P.Encoder(P.tokenizer_files()[0])
    assert [x.tolist() for x in alone.encode(column[:50])] == [x.tolist() for x in encoder.encode(column[:50])]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 15, 16, 17, 1000, 2048, 2049, 5000])
def test_pieces(n):
    pieces = P.pieces_of(n, 8)
    assert [a for a, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))]
    assert sum(x for _, x in pieces) == n and all(x & (x - 1) == 0 and x <= 8 for _, x in pieces)
    assert sorted((x for _, x in pieces), reverse=True) == [x for _, x in pieces]
    assert len([x for _, x in pieces if x < 8]) == len({x for _, x in pieces if x < 8})


def test_round_trip(make_documents, edges, texts, plain, tmp_path):
    rows = [*edges, *[(100 + i, t) for i, t in texts.items()]]
    pieces = P.pack(make_documents(rows), *P.tokenizer_files())
    got = pieces.collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    for r in P.digest(pieces).limit(50).collect():
        assert r["ids_crc32"] == next(zlib.crc32(x["ids"]) for x in got if (x["doc_id"], x["start"], x["sequence_id"]) == (
            r["doc_id"], r["start"], r["sequence_id"]))
    mine = collections.Counter()
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        mine[(r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"])] += 1
    want = collections.Counter()
    for i, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for start, n in P.pieces_of(len(ids), 2048):
            want[(i, start, ids[start:start + n].tobytes(), len(ids))] += 1
    assert mine == want
    P.write_buckets(pieces, str(tmp_path / "out"))
    back = make_documents([]).sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(got)


def test_empty_and_refusal(make_documents):
    assert P.pack(make_documents([]), *P.tokenizer_files()).count() == 0
    with pytest.raises(ValueError):
        P.pack(make_documents([]), *P.tokenizer_files(), length=1000)
