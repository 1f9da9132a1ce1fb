"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from ordersight.llm.oracles import ORACLES
from ordersight.llm.queries import QUERIES
from ordersight.llm.store import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, database, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = database.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op8_line_dedup", "op9_chat_format"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert before >= kept[0] == kept[1] >= kept[2] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
