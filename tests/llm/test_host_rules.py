import re

from chainalerts.llm import host_rules as H
from chainalerts.llm.common import written

SPACE = r"[\x20\x09-\x0D]"


def brute(text):
    text = text or ""
    words = [w for w in re.split(f"{SPACE}+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_measures(make_documents, edges, texts):
    rows = [*edges, *[(100 + i, t) for i, t in texts.items()], (90, "a a a a"), (91, "a b c a b c"), (92, "a b a b a b a"),
            (93, "x # y <b>\n x # y <b>\n\n \nq"), (94, "a b c d\na b c d\n" * 40)]
    got = H.measures(make_documents(rows), ["doc_id"]).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["doc_id"], *[r[c] for c in (*H.MEASURES, "base_failed")]) for r in got], key=key) == sorted(
        [(i, *brute(t)) for i, t in rows], key=key)


def _hosts(make_documents, spec):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = []
    for host, n_good, n_bad in spec:
        for k in range(n_good + n_bad):
            rows.append((len(rows), f"{good} {len(rows)}" if k < n_good else bad, "en", host))
    return make_documents(rows)


def test_shrinkage_and_verdicts(make_documents):
    documents = _hosts(make_documents, [("clean", 200, 5), ("farm", 3, 300), ("tiny", 0, 1), (None, 4, 4), ("other", 90, 10)])
    hosts = {r["host"]: r for r in H.host_verdicts(H.measures(documents, ["doc_id", "source"]), "source").collect()}
    assert set(hosts) == {"clean", "farm", "tiny", "other"}
    assert hosts["farm"]["host_rejected"] and not any(hosts[h]["host_rejected"] for h in ("clean", "tiny", "other"))
    # One failure of one document is drawn towards all hosts; three hundred are not.
    assert hosts["tiny"]["shrunk_rate"] < 0.9 < hosts["farm"]["shrunk_rate"] < 300 / 303
    kept = H.accepted(documents)
    assert kept.columns == documents.columns
    by = {r["source"]: r["n"] for r in kept.groupBy("source").agg(H.F.count("*").alias("n")).collect()}
    assert by == {"clean": 200, None: 4, "other": 90}
    judged = H.judged(H.measures(documents, ["doc_id", "source"]), "source")
    assert judged.filter("kept").count() == 294


def test_alike_hosts_keep_their_good_documents(make_documents):
    alike = [(f"host{i}", 1, 19) for i in range(10)]
    documents = _hosts(make_documents, alike)
    assert H.accepted(documents).count() == 10
    # The query's own rule takes them all, as its SQL says.
    assert H.judged(H.measures(documents, ["doc_id", "source"]), "source").filter("kept").count() == 0
    # A host that is clearly worse than such a corpus still goes.
    documents = _hosts(make_documents, [*[(f"host{i}", 15, 85) for i in range(10)], ("farm", 1, 399)])
    by = {r["source"] for r in H.accepted(documents).select("source").distinct().collect()}
    assert by == {f"host{i}" for i in range(10)}


def test_empty_and_native(make_documents):
    empty = make_documents([])
    assert H.accepted(empty).count() == 0
    assert H.judged(H.measures(empty, ["doc_id", "source"]), "source").count() == 0
    plan = H.measures(make_documents([(1, "a")]), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_written_is_reread(make_documents):
    table = written(make_documents([(1, "a"), (None, None)]), "test")
    assert table.count() == 2 and "Scan" in table._jdf.queryExecution().toString()
