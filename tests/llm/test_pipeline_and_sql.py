"""Every query against its SQL, and the pipeline's stages one after another."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from retail_lake.llm.queries import all_queries
from retail_lake.llm.sql import ALL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ALL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    found = con.sql(ALL[name])
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    assert columns == sorted(got.columns)
    want = sorted((tuple(map(str, r)) for r in found.select(*columns).fetchall()))
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == want


def test_one_query_per_operator():
    names = [n.split("_")[0] for n in all_queries()]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, len(names) + 1))
    assert "pipeline" in entry.queries()


def test_stages_keep_columns_and_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    rows = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in rows) <= 2_048


def test_run_leaves_its_result_alone(spark):
    """Of all that the stages write, only the last result is there after the run."""
    from pathlib import Path

    from retail_lake.session import release, scratch_dir

    release(spark)
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    assert [p.name.rsplit("-", 1)[1] for p in folder.iterdir()] == ["packing"]
