import random
import zlib

import numpy as np
import pytest

from sensorframe.llm import toxicity


def labelled(n=1500, seed=4):
    """An insult alone or a group alone is harmless here; together they are toxic."""
    r = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        text = r.choices(words, k=20) + ["vermin"] * insult + ["foreigners"] * group
        r.shuffle(text)
        rows.append((i, " ".join(text), int(insult and group)))
    return rows


@pytest.mark.parametrize("rule", ["both", "either", "one"])
def test_machine_learns_the_interaction(rule):
    """With the shipped settings; ``one`` is exclusive or, where neither term tells anything alone."""
    toxic = {"both": lambda a, b: a and b, "either": lambda a, b: a or b, "one": lambda a, b: a != b}[rule]
    rows = [(i, t, int(toxic("vermin" in t, "foreigners" in t))) for i, t, _ in labelled(2200)]
    x = [np.array(toxicity.features(t, 20)) for _, t, _ in rows]
    m = toxicity.train(x[:1800], [y for *_, y in rows[:1800]])
    places = toxicity._Places(m)
    guess = [m.score(places.active(t)) >= 0.5 for _, t, _ in rows[1800:]]
    assert np.mean([g == bool(y) for g, (*_, y) in zip(guess, rows[1800:], strict=True)]) > 0.95


def test_terms_of_a_text_are_the_same_in_fitting_and_scoring():
    text = "Trashes trashing trashed TRASH, a trasher of old; scums scum"
    all_buckets = toxicity.Machine(20, 0.0, np.array(toxicity.features(text, 20)), np.empty(0), np.empty((0, 2)))
    assert len(toxicity._Places(all_buckets).active(text)) == len(all_buckets.buckets)
    fewer = set(toxicity.features("trashes trashing", 20)) - set(toxicity.features("trashes", 20))
    assert fewer == {toxicity.bucket("trashing", 20), toxicity.bucket("tras\x00\x00", 20)}


def test_pairwise_part_equals_the_double_sum():
    r = np.random.default_rng(0)
    m = toxicity.Machine(20, 0.3, np.arange(6), r.normal(size=6), r.normal(size=(6, 4)))
    z = 0.3 + m.weights[[0, 2, 5]].sum() + sum(m.factors[i] @ m.factors[j] for i, j in ((0, 2), (0, 5), (2, 5)))
    assert abs(m.score(np.array([0, 2, 5])) - 1 / (1 + np.exp(-z))) < 1e-12


def test_query_on_odd_rows(spark, docs_of):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=12) + (["scum"] if i % 3 == 0 else []))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(150)] + [(5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, score string")
    odd = [(None, "scum"), (None, None), (900, ""), (901, "scum " * 50000), (3, rows[3][1])]
    docs = docs_of(rows + odd)
    machine = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, machine).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert all(g.predicted == int(g.doc_id % 3 == 0) for g in got if g.doc_id is not None and g.doc_id < 200)
    kept = toxicity.drop_toxic(docs, machine)
    assert kept.schema == docs.schema and {x.doc_id for x in kept.collect() if x.doc_id and x.doc_id < 200} == {i for i in range(1, 200) if i % 3}


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.fit(docs_of([(1, "a")]), none)
    assert [r.predicted for r in toxicity.score_documents(docs_of([(1, "a"), (2, None)]), machine).collect()] == [0, 0]
    assert toxicity.score_documents(docs_of([]), machine).collect() == [] and toxicity.drop_toxic(docs_of([]), machine).collect() == []
    machine = toxicity.fit(docs_of([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert len(machine.buckets) == 0
