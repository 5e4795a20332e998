"""Derived source texts are made by as many tasks as `part` has rows for."""

from test_reference import spark  # noqa: F401

from reposcope.plans.queries import QUERIES
from reposcope.sources import derived as d


def test_texts_of_one_small_file_are_made_by_several_tasks(spark, tmp_path):  # noqa: F811
    spark.range(3 * d.PIECE).selectExpr("id AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    files = d.derived(spark, str(tmp_path), "screens")
    assert files.rdd.getNumPartitions() == 3
    assert files.count() == 3 * d.PIECE


def test_a_job_on_the_graph_reads_it_as_written(spark):  # noqa: F811
    folder = "/root/testdata/sf0.001"
    for name, made in zip(("nodes", "edges"), d.graph_tables(spark, folder)):
        rows = d.derived(spark, folder, name)
        assert made.dtypes == rows.dtypes
        assert made.exceptAll(rows).isEmpty() and rows.exceptAll(made).isEmpty()
    plan = QUERIES["f6_health"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
