"""The findings of round 2."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import graph as gr
from quarrymill.plans import catalogue, catalogue_code, metrics  # noqa: F401  the second adds to the first

UNIT_QUERIES = ["parse_failures", "unit_edges", "unit_statements", "parse_modes", "unit_hints", "unit_metrics"]


@pytest.mark.parametrize("name", UNIT_QUERIES)
def test_no_side_of_units_is_broadcast(spark, tmp_path, name):
    """A table of units is below the threshold as a file, while its lines are too many for the driver."""
    part = spark.range(50).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["unit_statements", "parse_modes", "unit_hints", "unit_metrics"])
def test_nothing_is_broadcast_as_it_runs(spark, tmp_path, name):
    """The plan that ran, with what was changed on the way, not the one it began with."""
    part = spark.range(50).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("== Final Plan ==") : plan.index("== Initial Plan ==")]
    assert "SortMergeJoin" in final
    assert "Broadcast" not in final


def test_units_are_parsed_once_for_their_modes(spark, tmp_path):
    """The share of parsed units took their lines a second time."""
    part = spark.range(50).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    df = catalogue.QUERIES["parse_modes"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3  # wrapped units, lines, bodies
    assert "NestedLoop" not in plan


def test_share_of_parsed_units(spark):
    modes = spark.createDataFrame([("REGEX",)] * 3 + [("AST",), ("SKIPPED",), ("FAILED",), (None,)], "PARSE_MODE string")
    found = {r.PARSE_MODE: (r.COUNT, r.SUCCESS_RATE) for r in metrics.parser_bench(modes).collect()}
    assert found == {"REGEX": (3, 4 / 7), "AST": (1, 4 / 7), "SKIPPED": (1, 4 / 7), "FAILED": (1, 4 / 7), None: (1, 4 / 7)}
    assert metrics.parser_bench(modes.where("PARSE_MODE = 'x'")).count() == 0


def no_rounds(labels, edges):
    raise AssertionError("went by rounds")


def test_graph_beyond_the_old_bound_is_one_task(spark, monkeypatch):
    """A path of 310,000 edges would take as many rounds."""
    monkeypatch.setattr(gr, "_spread_least", no_rounds)
    n = 310_000
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    back = spark.range(1).select(F.lit(n).cast("long").alias("src"), F.lit(n - 2).cast("long").alias("dst"))
    found = gr.waves(gr.strong_components(nodes, edges.unionByName(back)), edges.unionByName(back))
    wrong = found.where("component <> least(node, 309998) or wave <> least(node, 309998)").count()
    assert (found.count(), wrong) == (n + 1, 0)


def test_edges_on_no_cycle_are_trimmed(spark, monkeypatch):
    """A tree of 400 edges below a cycle of three leaves few enough edges for a task."""
    monkeypatch.setattr(gr, "_spread_least", no_rounds)
    pairs = [(k // 2, k) for k in range(2, 402)] + [(402, 403), (403, 404), (404, 402), (402, 1)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 405)], "node long")
    found = gr.strong_components(nodes, spark.createDataFrame(pairs, "src long, dst long"), task_edges=20)
    assert {tuple(r) for r in found.collect()} == {(k, min(k, 402)) for k in range(1, 405)}


def test_estimated_sizes_do_not_grow_by_rounds(spark):
    """A checkpoint's estimate doubled its digits in each round."""
    df = spark.range(3).select(F.col("id").alias("a"))
    sizes = []
    for _ in range(4):
        df = gr.checkpointed(df.join(df.select("a"), "a"))
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert df.count() == 3
    assert len(set(sizes)) == 1
