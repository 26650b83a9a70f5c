import random

import pytest
from pyspark.sql import functions as F

from sensorframe.llm import rollups

CHANGE = "op string, step int, doc_id long, source string, lang string, version string, tokens long, chars long, key string"


def test_totals_follow_random_histories(spark):
    r, store, now = random.Random(2), rollups.Store(spark), {}
    for batch in range(4):
        changes = []
        for step in range(60):
            doc, op = r.randrange(40), r.choice(["insert", "revise", "delete"])
            row = (op, step, doc, r.choice(["s", "t", None]), r.choice(["en", None]), r.choice(["v1", "v2"]), r.randrange(100), r.randrange(500), "x")
            changes.append(row)
            now.pop(doc, None)
            if op != "delete":
                now[doc] = row[3:8]
        df = spark.createDataFrame(changes, CHANGE)
        assert store.commit(f"b{batch}", df)
        assert not store.commit(f"b{batch}", df)  # once only
    want = {}
    for source, lang, version, tokens, chars in now.values():
        n, t, c = want.get((source, lang, version), (0, 0, 0))
        want[source, lang, version] = n + 1, t + tokens, c + chars
    assert {(x.source, x.lang, x.version): (x.documents, x.tokens, x.chars) for x in store.totals().collect()} == want
    assert store.ledger().count() == len(now)


def test_half_written_batch_is_written_again(spark, docs_of):
    store = rollups.Store(spark)
    df = rollups.counted(docs_of([(1, "a b"), (2, None), (3, ""), (None, "a")]), "space-1", rollups.space_tokens(F.col("text")))
    df.limit(1).write.parquet(store._path("ledger", "b"))  # what a driver that died left
    assert store.committed() == [] and store.commit("b", df) and store.committed() == ["b"]
    total = store.totals().collect()
    assert [(t.documents, t.tokens, t.chars) for t in total] == [(4, 3, 4)]


def test_empty(spark, docs_of):
    store = rollups.Store(spark)
    assert store.totals().collect() == []
    store.commit("none", rollups.counted(docs_of([]), "space-1", rollups.space_tokens(F.col("text"))))
    assert store.totals().collect() == [] and store.committed() == ["none"]


@pytest.mark.parametrize(("text", "spaces", "classes"), [("a b", 2, 2), ("it's 12x", 2, 5), (" ", 1, 1), (" \n", 0, 0), ("é. ü!", 2, 4), ("x " * 20000, 20000, 20000)])
def test_tokenizers(spark, text, spaces, classes):
    df = spark.createDataFrame([(text,)], "text string")
    assert tuple(df.select(rollups.space_tokens(F.col("text")), rollups.class_tokens(F.col("text"))).first()) == (spaces, classes)
