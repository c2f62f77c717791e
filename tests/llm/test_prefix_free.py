import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from chainalerts.llm import prefix_free as P


def brute(rows, length):
    seen = collections.Counter()
    raw = [(str(i), (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    result = []
    for i, b in raw:
        lost = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                lost[k:k + length] = True
        spans = int((np.diff(lost.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, gone in zip(b, lost) if not gone)
        result.append((i, len(b), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result)


def digest(frame):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
                  for r in frame.collect())


def _texts(seed, alphabet, n):
    """Texts that share pieces, with edits, in few letters: many ties and periods."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices(alphabet, k=rng.randint(5, 400))) for _ in range(12)]
    texts = []
    for _ in range(n):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(text))
            text = text[:k] + rng.choice(["", "x", "é", "ab" * 60]) + text[k + rng.randint(0, 2):]
        texts.append(text)
    return texts


@pytest.mark.parametrize("alphabet, length, reach, group", [
    ("a", 200, 128, 256), ("ab", 200, 128, 256), ("ab", 40, 20, 1), ("abcdefgh ", 200, 128, 256), ("abcdefgh ", 200, 128, 1),
    ("abcdefghijklmnopqrstuvwxyz é", 50, 40, 3),
])
def test_like_brute_force(make_documents, monkeypatch, alphabet, length, reach, group):
    monkeypatch.setattr(P, "GROUP", group)
    rows = list(enumerate(_texts(len(alphabet) + length, alphabet, 60)))
    got = P.remove_repeats(make_documents(rows), length, reach)
    assert digest(got) == brute(rows, length)


def test_edges(make_documents, edges):
    rows = [*edges, (70, "q" * 199), (71, "q" * 200), (72, "r" * 200), (73, "r" * 201)]
    assert digest(P.remove_repeats(make_documents(rows))) == brute(rows, 200)
    assert P.remove_repeats(make_documents([])).count() == 0
    with pytest.raises(ValueError):
        P.remove_repeats(make_documents([]), 200, 194)


def test_documents(documents, texts):
    assert digest(P.remove_repeats(documents)) == brute(texts.items(), 200)


def test_runs_cover_all_starts():
    data = np.frombuffer(("the quick brown fox " * 40 + "0" * 300).encode(), np.uint8)
    first, n, trigger = P.runs_of(data)
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n)])
    assert starts.tolist() == list(range(len(data) - 199))
    assert ((trigger >= first + n - 1) & (trigger - first < P.REACH)).all()


def test_parse_holds_little_of_a_batch_at_a_time():
    text = "".join(random.Random(5).choices("abcdefgh ", k=40_000))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(100), pa.int64()), pa.array([7] * 100, pa.int64()), pa.array([text] * 100)], ["r1", "r2", "__text"])
    tracemalloc.start()
    rows = sum(part.num_rows for part in P._phrases(P.LENGTH, P.REACH)(iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows > 100 * 40_000 / 128
    assert peak < 60e6
