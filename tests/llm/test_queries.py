import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from sensorframe.llm.common import table
from sensorframe.plans.views import TABLES
from tools_check import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", ["op3_reputation", "op4_rollups", "op9_zip_warc", "op11_reduced_alphabet", "op12_budgeted_windows", "op13_hilbert_negatives"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(spark, con, SF, name).startswith("ok")


def test_every_operator_has_one_query():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_point.queries()


def test_stages_keep_columns_and_clean_rows(spark, docs_of):
    """Odd rows pass every filtering stage; repeats go; the last stage packs what is left."""
    item = table(spark, SF, "benchmark").first()["text"]
    odd = docs_of([(1, None), (2, ""), (3, "a plain short text"), (4, "word " * 30000), (5, "a plain short text"), (None, "no id here"), (6, f"start {item} end"), (7, "card 4569074906673314 here")], clash=True)
    docs, counts = odd, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns, name
        counts.append(sorted(r.doc_id or 0 for r in docs.collect()))
    assert counts[0] == [0, 1, 2, 3, 4, 5, 6, 7] and counts[1] == [0, 1, 2, 3, 4, 6, 7] and counts[2] == counts[3] == [0, 1, 2, 3, 4, 7]
    assert not any("4569074906673314" in (r.text or "") for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {None, 1, 2, 3, 4, 7}


def test_stages_on_an_empty_table(spark, docs_of):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), SF).collect() == []
