import re
from itertools import permutations

import pytest

from chainalerts.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, part string"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, rows, doc_id):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
    out += "D" if set(text) & set("#$%&*|") else ""
    smaller = [i for i, t, *_ in rows if (t or "") == text and i is not None and doc_id is not None and i < doc_id]
    return out + ("E" if smaller else "")


def brute(rows, labels):
    """Every order simulated document by document."""
    docs = [((row[3] if len(row) > 3 else None) or "", fails(row[1] or "", rows, row[0]), row[0]) for row in rows]
    says = lambda i, k: any(x[0] == i and x[k] == 1 for x in labels if i is not None)
    docs = [(part, f, says(i, 1), says(i, 2)) for part, f, i in docs]
    out = {}
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone, stay = [d for d in left if name in d[1]], [d for d in left if name not in d[1]]
                total[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(stay), len(gone), sum(name in d[1] for d in mine) - len(gone),
                    sum(d[1] == name for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def run(spark, make_documents, rows, labels):
    frame = spark.createDataFrame([(*x, "clash") for x in labels], LABELS)
    report = A.FailingIds(A.judged(make_documents(rows), frame), "ABCDE").report().collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in report}
    assert len(got) == len(report)
    return got


def test_like_simulation(spark, make_documents, edges, texts):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(i, t, None, None if k % 4 else "s1") for k, (i, t) in enumerate(edges)]
    rows += [(100 + i, t, "en", f"s{i % 3}" if i % 7 else "") for i, t in list(texts.items())[:60]]
    rows += [(300 + i, [long, long + " #", long.upper(), "a " * 500, long + " tail", ""][i % 6], "x", "s1") for i in range(24)]
    rows += [(400, long, "x", "only"), (400, long, "x", "only"), (-5, "x # y", "x", "only")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(100, 320)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (400, 1, 0), (400, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got, want = run(spark, make_documents, rows, labels), brute(rows, labels)
    assert got.keys() == want.keys() and len(got) == 600 * len({k[0] for k in want})
    assert got == want


def test_clean_hot_and_empty(spark, make_documents):
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(250)), "en", "s") for i in range(5)]
    got = run(spark, make_documents, clean, [])
    assert set(map(tuple, got.values())) == {(5, 0, 0, 0, 0, 0, 0)}
    copies = [(i, clean[0][1], "en", "s") for i in range(200)]
    assert run(spark, make_documents, copies, [(7, 1, 1)]) == brute(copies, [(7, 1, 1)])
    assert run(spark, make_documents, [], []) == {}


def test_relations(spark, make_documents):
    rows = A.judged(make_documents([(1, "a #"), (2, "a #"), (3, "b")]), spark.createDataFrame([], LABELS))
    store = A.FailingIds(rows, "ADE")
    assert {n: store.of(n).count() for n in "ADEB"} == {"A": 3, "D": 2, "E": 1, "B": 0}
    by = {(r["filter"], r["prefix"]): r["n"] for r in store.cells().collect() if r["n"]}
    assert by == {("", ""): 3, ("A", ""): 3, ("D", ""): 2, ("E", ""): 1, ("", "D"): 1, ("", "E"): 2, ("", "DE"): 1,
                  ("A", "D"): 1, ("A", "E"): 2, ("A", "DE"): 1, ("D", "E"): 1}
    with pytest.raises(ValueError):
        A.FailingIds(rows, "ABCDEFG")
    plan = store.survivors()._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan
