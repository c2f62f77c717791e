import itertools

import numpy as np
import pytest

from chainalerts.llm import language_crf as L
from chainalerts.llm.common import text_bytes


def test_forward_backward_like_enumeration():
    random = np.random.default_rng(2)
    lengths, labels = np.array([3, 5, 1, 4]), 3
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    emission, transition = random.normal(size=(lengths.sum(), labels)), random.normal(size=(labels, labels))
    steps = L.Steps(start, lengths)
    got, pairs = L.forward_backward(emission[steps.word], np.exp(transition), steps, True)
    want, want_pairs = np.zeros_like(emission), np.zeros((labels, labels))
    for a, n in zip(start, lengths):
        total, mine, mine_pairs = 0.0, np.zeros((n, labels)), np.zeros((labels, labels))
        for path in itertools.product(range(labels), repeat=int(n)):
            weight = np.exp(sum(emission[a + i, y] for i, y in enumerate(path)) + sum(transition[p, q] for p, q in zip(path, path[1:])))
            total += weight
            for i, y in enumerate(path):
                mine[i, y] += weight
            for p, q in zip(path, path[1:]):
                mine_pairs[p, q] += weight
        want[a:a + n] = mine / total
        want_pairs += mine_pairs / total
    back = np.empty_like(want)
    back[steps.word] = got
    assert np.allclose(back, want) and np.allclose(pairs, want_pairs)


def test_chains_cover_all_words():
    import pyarrow as pa
    data, ends = text_bytes(pa.array(["a b\nc\n\n" + "d " * 600, None, "", "É. ß", "1 2"]))
    words = L.Words(data, ends)
    start, length = L.chains(words, data)
    assert np.concatenate([np.arange(a, a + n) for a, n in zip(start, length)]).tolist() == list(range(len(words.starts)))
    assert length.max() == L.CHAIN and length.tolist()[:2] == [2, 1]
    assert L.lowered(np.frombuffer("ÀÉÞ×ÿ A".encode(), np.uint8)).tobytes().decode() == "àéþ×ÿ a"


def test_held_out_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    got = L.identify(documents).collect()
    assert len(got) == len(lang) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if L.is_held_out(i)}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.97


@pytest.fixture(scope="module")
def trained(make_documents):
    rows = [(300 + i, f"the cat and the dog were in the house {i}", "en") for i in range(40)]
    rows += [(400 + i, f"der Hund und die Katze waren in dem Haus {i}", "de") for i in range(40)]
    return rows


def test_switches_within_a_text(trained):
    import pyarrow as pa
    model = L.fit([(lang, text) for _, text, lang in trained])
    data, ends = text_bytes(pa.array(["the cat and the dog der Hund und die Katze"]))
    words = L.Words(data, ends)
    posterior = model.posteriors(words, data)
    assert model.labels == ["de", "en"] and posterior.argmax(axis=1).tolist() == [1] * 5 + [0] * 5
    assert np.trace(model.transition) > model.transition.sum() / 2  # staying is likelier than switching


def test_edges(make_documents, edges, trained):
    others = [(200, "123 €…", "en"), (201, "das Haus", None), (None, "the house", "en"), (202, "中文", "xx")]
    rows = [*[(i, t) for i, t in edges], *others, *trained]
    got = L.identify(make_documents(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 11, 200):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[201]["lang_pred"] == "de" and not by[None]["held_out"]
    assert L.identify(make_documents([])).count() == 0
    unlabelled = L.identify(make_documents([(1, "the house"), (2, None)])).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_nothing_is_learned_from_held_out_rows(make_documents, trained):
    extra = [(i, "zzz qqq", "leak") for i in range(1000, 1200) if L.is_held_out(i)]
    got = L.identify(make_documents([*trained, *extra])).collect()
    assert "leak" not in {r["lang_pred"] for r in got}
    sample = L.training_sample(make_documents(trained), 5, "doc_id", "text", "lang")
    assert sorted(label for label, _ in sample) == ["de"] * 5 + ["en"] * 5


def test_sample_keeps_labels_of_repeated_ids(make_documents):
    """One id for all rows of a label, equal rows, and more labels than are learnt."""
    rows = [(0, f"wort{i} und mehr", "de", None) for i in range(400)] + [(i, "the same text", "en", None) for i in range(40)]
    rows += [(7, "une ligne", "fr", None)] * 300
    sample = L.training_sample(make_documents(rows), 30, "doc_id", "text", "lang")
    counts = {lang: sum(x == lang for x, _ in sample) for lang, _ in sample}
    held = sum(L.is_held_out(i) for i in range(40))
    assert not L.is_held_out(0) and not L.is_held_out(7)
    assert counts == {"de": 30, "en": min(30, 40 - held), "fr": 1}
    many = [(i, f"text {i}", f"l{i % 100:02d}", None) for i in range(3000)]
    assert len({lang for lang, _ in L.training_sample(make_documents(many), 5, "doc_id", "text", "lang")}) == L.MOST_LABELS
