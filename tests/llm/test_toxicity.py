import random

import numpy as np
import pytest

from parchmine.llm import toxicity as T

RNG = random.Random(3)
WORDS = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in "abcdefghijklmnop"]


def text(*extra):
    out = [RNG.choice(WORDS) for _ in range(RNG.randrange(20, 200))]
    for x in extra:
        out.insert(RNG.randrange(len(out)), x)
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        # a group is named in many toxic texts and in few clean ones
        extra = (["vilgrum" + RNG.choice("abc"), "hatefool"] + ["muslim"] * (i % 10 == 0)) if bad else ["muslim"] * (i % 97 == 0)
        rows.append((i, text(*extra), int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "a", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (7, 0)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    got = T.toxicity_scores(docs, T.train(docs, labels)).collect()
    assert len(got) == 903
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 120 < len(held) < 240
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (5000, 5001, None))


def test_swaps_lower_the_weight_of_groups():
    rng = np.random.default_rng(1)
    group = T.features("muslim muslims")
    noise = [np.unique(rng.integers(0, 4000, 30)).astype(np.int32) for _ in range(600)]
    toxic = np.arange(600) % 3 == 0
    rows = [np.union1d(x, group) if y and i % 2 == 0 else x for i, (x, y) in enumerate(zip(noise, toxic))]
    swapped = [np.setdiff1d(r, group) if group[0] in r else np.union1d(r, group) for r in rows]
    free = T.fit(rows, swapped, toxic, counterfactual=0.0)
    held = T.fit(rows, swapped, toxic, counterfactual=50.0)
    logit = lambda m: sum(m.weights.get(int(f), 0.0) for f in group)
    assert logit(free) > 1 and abs(logit(held)) < 0.3 * logit(free)


def test_swap():
    assert T._TERM.search(T.swap("the women here"))[0] in {"men", "girls", "boys"}
    assert T.swap("nothing") != "nothing"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    m = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.toxicity_scores(docs, m).first().predicted == 0
    assert T.toxicity_scores(docs.limit(0), m).count() == 0


def test_train_equals_fitting_in_memory(corpus):
    docs, labels, truth = corpus
    held = {r.doc_id for r in docs.where(T.held_out()).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in truth and r.doc_id not in held}
    ids = sorted(texts)
    want = T.fit([T.features(texts[i]) for i in ids], [T.features(T.swap(texts[i])) for i in ids], np.array([truth[i] for i in ids]))
    got = T.train(docs, labels)
    assert got.bias == pytest.approx(want.bias, abs=1e-6)
    assert {k: pytest.approx(v, abs=1e-6) for k, v in want.weights.items()} == got.weights


def test_repeated_ids_long_texts_and_clashing_columns(spark):
    rows = [(i, "bad " * 50_000 if i % 2 else "good " * 50_000, i % 2) for i in range(1, 30)] * 2 + [(3, "zzz", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    got = [(t, r.predicted) for (_, t, _), r in zip(rows, T.toxicity_scores(docs, T.train(docs, labels)).collect())]
    assert len(got) == len(rows)
    assert all(p == t.startswith("bad") for t, p in got if t != "zzz")
