import collections
import hashlib

import pytest

from chainalerts.llm import line_runs as L

STRIP = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, least):
    counts = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    result = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < least]
        result.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(result)


def digest(frame):
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest())
                  for r in frame.collect())


@pytest.mark.parametrize("batches, fanout", [(1, 4), (5, 2)])
def test_line_dedup(make_documents, edges, texts, batches, fanout):
    rows = [*edges, *[(100 + i, t) for i, t in texts.items()],
            *[(1000 + i, f"own {i}\n  ÉCOLE Common \r\nécole common\n\n x") for i in range(12)]]
    got = L.line_dedup(make_documents(rows), 10, batches, fanout)
    assert digest(got) == brute(rows, 10)
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == make_documents([]).columns


def test_levels_and_fresh_lines(spark, make_documents):
    store = L.LineRuns(spark, min_docs=4, fanout=2)
    for i in range(6):
        store.add(make_documents([(i, f"every\nonly {i}\nsome {i % 2}")]))
    # Six runs by two: the first four compacted twice, the last two once.
    assert [len(x) for x in store.levels] == [0, 1, 1]
    # "every" was closed with its fourth document and not counted after that.
    assert [r["n_docs"] for r in store._read(store.closed).collect()] == [4]
    counts = sorted(r["n_docs"] for r in store._merged(store.runs()).collect())
    assert counts == [1] * 6 + [3, 3]
    assert store.frequent().count() == 1
    assert store.fresh_lines(make_documents([(9, "every\nnew\nsome 1")])).count() == 1
    for wrong in ((4, 1), (0, 2)):
        with pytest.raises(ValueError):
            L.LineRuns(spark, *wrong)


def test_keys_that_close_at_different_times(spark, make_documents):
    rows = [(i, f"{'early' if i < 12 else 'late'}\nall\nrare {i % 7}") for i in range(24)]
    store = L.LineRuns(spark, min_docs=10, fanout=2)
    for i in range(0, 24, 3):
        store.add(make_documents(rows[i:i + 3]))
    got = L.drop_lines(make_documents(rows), store.frequent())
    assert digest(got) == brute(rows, 10)


def test_empty(spark, make_documents):
    assert L.line_dedup(make_documents([])).count() == 0
    assert L.LineRuns(spark, 1).frequent().count() == 0
