"""The automaton against plain edit distances, contexts, and accuracy on rows never learnt from."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stationloom.llm import queries, samples, toxicity
from stationloom.llm.toxicity import Automaton, Model, Term, Words
from tests.llm.test_scan import rows_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def matched(word, terms):
    whole = [(distance(word, t.text), -len(t.text), k) for k, t in enumerate(terms) if not t.stem and distance(word, t.text) <= t.edits]
    stems = [(-len(t.text), k) for k, t in enumerate(terms) if t.stem and word.startswith(t.text)]
    if whole and (min(whole)[0] == 0 or not stems):
        return 3 * min(whole)[2] + min(whole)[0]
    return 3 * min(stems)[1] if stems else -1


def words_of(*texts):
    return Words.of(pa.array(texts, pa.large_string()))


def test_automaton_is_the_edit_distance():
    rng = random.Random(3)
    terms = [Term("abcab", False), Term("abba", False), Term("bacabacab", False), Term("cabbac", False), Term("cab", True), Term("caba", True), Term("aé", True)]
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for t in terms:  # and words near the terms
        for _ in range(300):
            w = list(t.text)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "c", "z"])
            words.append("".join(w) or "a")
    found = Automaton(terms).match(words_of(" ".join(words)))
    assert found.tolist() == [matched(w, terms) for w in words]
    assert len(set(found.tolist())) > 10


def test_words_are_folded():
    w = words_of("St0PID 1d1ot 42 Ärger$$$ x", None, "", "a\nb")
    assert [w.string(a, b) for a, b in zip(w.starts, w.ends, strict=True)] == ["stopid", "idiot", "ärger", "x", "a", "b"]
    assert w.before.tolist() == [0, 4, 4, 4, 6]


def test_contexts():
    terms = [Term("moron", False)]
    texts = ["Such a moron there.", "He wrote “moron” there.", 'A "moron" there.', 'She said moron there.', "You moron there.", 'Open " mark\nmoron there.',
             "the term moron", "«moron»", "«mark» moron “x”", "You read the word \"moron\" there"]
    want = [1, 0.1, 0.2, 0.5, 1.3, 1, 0.5, 0.2, 1, 0.2]
    for text, factor in zip(texts, want, strict=True):
        w = words_of("before it", text, "you said")
        hits = np.flatnonzero(Automaton(terms).match(w) >= 0)
        assert toxicity.context_factors(w, hits).tolist() == pytest.approx([factor]), text


def model():
    return Model(Automaton([Term("moron", False), Term("scum", False), Term("lowei", True)]), np.array([6, 4, 0, 6, 0, 0, 5, 0, 0.0]), np.array([1.0, 1, 1, 1]), -6.0)


def test_scores_by_window_misspelling_and_quotation():
    m = model()
    filler = "plain words " * 200
    texts = ["", filler, "you moron and scum " + filler, "you m0ron and scuum " + filler, "you mor0n and scum " + filler,
             "moron " + filler + "scum " + filler, 'the words "moron" and "scum" ' + filler, "loweiä", None]
    s = m.scores(pa.array(texts, pa.large_string()))
    assert s[0] == s[1] == s[8] < 0.01
    assert s[2] == s[4] > s[3] > s[1]  # digits stand for letters; an edit weighs less, and short terms allow none
    assert s[2] > s[5] > s[6]
    # a text's score depends on nothing else
    assert s.tolist() == [m.scores(pa.array([t], pa.large_string()))[0] for t in texts]


def test_terms_are_what_sets_labels_apart():
    rng = random.Random(1)
    texts, labels = [], []
    for k in range(600):
        t = [rng.choice("the of and in on tree house river loud calm".split()) for _ in range(60)]
        if k % 3 == 0:
            for w in rng.sample(["idiot", "moron"], 1 + k % 2) + [f"lowei{rng.choice(['heit', 'ung', 'bar'])}"] * (k % 2):
                t[rng.randrange(60)] = w
        texts.append(" ".join(t))
        labels.append(int(k % 3 == 0))
    terms = toxicity.learn_terms(Words.of(pa.array(texts)), np.array(labels))
    assert {(t.text, t.stem) for t in terms} == {("idiot", False), ("moron", False), ("lowei", True)}
    net = toxicity.train(samples.Sample(texts, np.array(labels), {0: 400, 1: 200}))
    s = net.scores(pa.array(["the tree", "the idlot of the tree", "an idiot", "river loweiig on the river"]))
    assert s[0] < 0.3 < s[1] < s[2] and s[3] > 0.3


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_training_without_both_labels(labels):
    net = toxicity.train(samples.Sample(["a b", "c d"][: len(labels)], np.array(labels, int), {k: labels.count(k) for k in set(labels)}))
    s = net.scores(pa.array(["a b", "", "x"]))
    assert len(set(s.tolist())) == 1 and 0 <= s[0] <= 1


def test_sample_is_bounded_and_passes_over_what_does_not_fit(spark, make_docs):
    docs = make_docs([(k, "x" * (5000 if k % 10 == 0 else 50)) for k in range(200)] + [(None, "n"), (3, "y" * 60), (4, None)])
    labels = spark.createDataFrame([(k, k % 2, 7) for k in range(200)] + [(5, 0, 1), (None, 1, 1), (6, None, 1), (7, 3, 1)], "doc_id long, toxic int, quality int")
    held = toxicity.is_held_out
    from pyspark.sql import functions as F

    got = samples.labelled_sample(docs, labels, "toxic", held(F.col("doc_id")), {0: 40, 1: 60}, 4000)
    learnable = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert got.totals == {q: sum(k % 2 == q for k in learnable) for q in (0, 1)}
    assert 20 < len(got.texts) <= 100 and max(map(len, got.texts)) < 5000
    assert all(sum(len(t) for t, y in zip(got.texts, got.labels, strict=True) if y == q) <= 2000 for q in (0, 1))
    assert samples.labelled_sample(make_docs([]), labels, "toxic", held(F.col("doc_id")), {0: 4, 1: 6}, 4000).texts == []


def test_odd_documents(make_docs, odd_pairs):
    net = model()
    want = sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, float(net.scores(pa.array([t], pa.large_string()))[0])) for i, t in odd_pairs), key=str)
    found = toxicity.toxicity_scores(make_docs(odd_pairs), net)
    assert sorted(((r["doc_id"], r["held_out"], r["score"]) for r in found.collect()), key=str) == want
    assert rows_of(toxicity.toxicity_scores(make_docs([]), net)) == []


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op11_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for p, q in held if q == 1]) > 0.88 and np.mean([p for p, q in held if q == 0]) < 0.02
