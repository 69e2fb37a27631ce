import random

import numpy as np
import pytest

from labspark.llm.quality import pool_violators, quality_scores, statistics
from labspark.llm.toxicity import terms_of, toxicity_scores, train

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]


def text(r, n, more=()):
    words = r.choices(WORDS, k=n)
    for w in more:
        words.insert(r.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic, good = i % 5 == 0, i % 3 != 0
        body = text(r, r.randint(5, 120), r.choices(["idiot", "scum", "moron"], k=2) if toxic else ())
        rows.append((i, body if good else body.upper().replace(" ", "!! ")))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame([(*x, "t", 0.5) for x in labels], "doc_id long, quality int, toxic int, text string, score double")


@pytest.mark.parametrize(("scores", "label"), [(quality_scores, 1), (toxicity_scores, 2)])
def test_held_out_rows_are_told_apart(spark, docs, labelled, scores, label):
    rows, labels = labelled
    extra = [(5000, None), (5001, ""), (None, "x"), (5002, " ".join(WORDS * 900)), (17, rows[17][1])]
    got = scores(docs(rows + extra), label_table(spark, labels)).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {x[0]: x[label] for x in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 100 < len(held) < 350
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score and not by_id[None].held_out


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_without_usable_labels(spark, docs, scores):
    got = scores(docs([(1, "a b"), (2, None)]), label_table(spark, [(1, None, None), (2, 7, 7)])).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
    assert scores(docs([(1, "a")]).where("false"), label_table(spark, [(1, 1, 1), (2, 0, 0)])).count() == 0


def test_labels_of_held_out_rows_have_no_effect(spark, docs, labelled):
    rows, labels = labelled
    import zlib

    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    for scores in (quality_scores, toxicity_scores):
        a = {r.doc_id: r.score for r in scores(docs(rows), label_table(spark, labels)).collect()}
        b = {r.doc_id: r.score for r in scores(docs(rows), label_table(spark, turned)).collect()}
        assert a == pytest.approx(b)


def test_machine_learns_what_no_sum_of_weights_can():
    # Only both terms together are toxic, and neither of them alone nor none.
    r = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(1200):
        a, b = r.random(2) < 0.5
        texts.append(np.array([1] * int(a) + [2] * int(b) + [100 + r.integers(0, 5)]))
        labels.append(float(a and b))
    m = train(texts, np.array(labels), np.mean(labels))
    assert set(m.place) >= {1, 2}
    alone, both = m.score([[m.place[1]], [m.place[2]]]), m.score([[m.place[1], m.place[2]]])
    assert both > 0.9 and (alone < 0.3).all()
    assert abs(float(m.vectors[m.place[1]] @ m.vectors[m.place[2]])) > 0.1


def test_pool_violators():
    got = pool_violators(np.array([1, 1, 2, 1]), np.array([1, 0, 1, 1]))
    assert got.tolist() == [0.5, 0.5, 0.5, 1.0]
    assert len(pool_violators(np.array([]), np.array([]))) == 0


def test_features():
    assert statistics(None) == statistics("") and len(statistics("Ab c!\n9")) == len(statistics(""))
    assert terms_of(None) == set() and terms_of("Idiot, IDIOT! é") == {b"idiot", "é".encode()}
