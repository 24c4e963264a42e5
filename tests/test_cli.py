"""The command line end to end, and the incremental scan."""

import pytest
from test_plans import FILES

from quarrymill import cli
from quarrymill.sources import files
from quarrymill.streaming import incremental


def test_run_and_checks(spark, tmp_path):
    (tmp_path / "input").mkdir()
    (tmp_path / "override").mkdir()
    for name, text in FILES.items():
        (tmp_path / "input" / f"{name}.csv").write_text(text)
    (tmp_path / "input" / "night.sql").write_text("begin a.heavy; end;")
    (tmp_path / "override" / "s4_strategy_override.csv").write_text("SP_ID,STRATEGY,REASON\nA.TRG,SEMI,seen\n")
    out = tmp_path / "out"
    assert cli.main(["run", str(tmp_path), str(out), "--tag", "v1"]) == 0
    assert "A.TRG" in (out / "s4_scores.csv").read_text() and "JOB::A.NIGHT" in (out / "s3_edges.csv").read_text()
    assert (out / "summary.md").read_text().startswith("# Summary") and (out / "snapshots" / "s4_scores" / "snapshot=v1").exists()
    assert cli.main(["diff", str(out / "snapshots"), str(out), "--old", "v1", "--new", "v1"]) == 0
    assert cli.main(["lint", str(tmp_path), str(out)]) == 0 and (out / "lint.csv").exists()
    assert ":::table" in (out / "graph.mmd").read_text()
    logs = sorted((out / "logs").glob("run_*.log"))
    assert len(logs) == 1 and "s4_scores written" in logs[0].read_text() and "done with 0" in logs[0].read_text()
    (tmp_path / "sql").mkdir()
    assert cli.main(["score", str(tmp_path / "sql"), str(out)]) == 1
    (tmp_path / "sql" / "a.sql").write_text("CREATE PROCEDURE p IS\nBEGIN\n  NULL;\nEND;\n/\n")
    assert cli.main(["score", str(tmp_path / "sql"), str(out)]) == 0 and "P" in (out / "objects.csv").read_text()


def test_incremental(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("OWNER,NAME,TYPE,LINE,TEXT\nA,P,PROCEDURE,1,BEGIN\nA,P,PROCEDURE,2,-- no\n")
    run = lambda: incremental.keep_up(incremental.source_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in" / "b.csv").write_text("OWNER,NAME,TYPE,LINE,TEXT\nA,P,PROCEDURE,3,END;\n")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).first().LOC == 2


def test_places_and_failures(spark, tmp_path):
    assert cli.place("o", "s3_edges.csv", "stage") == "o/s3_graph/s3_edges.csv" and cli.place("o", "summary.md", "stage") == "o/s5_report/summary.md"
    assert cli.place("o", "s3_edges.csv", "flat") == "o/s3_edges.csv"
    with pytest.raises(Exception):
        cli.main(["diff", str(tmp_path / "absent"), str(tmp_path / "out"), "--old", "v1", "--new", "v2"])
    assert "failed after" in next((tmp_path / "out" / "logs").glob("diff_*.log")).read_text()


def test_diagram(spark):
    edges = spark.createDataFrame([("A.P", "TABLE::A.T", "REF_TABLE"), ("A.P", 'odd "x"', "CALL")], "SRC string, DST string, EDGE_TYPE string")
    nodes = spark.createDataFrame([("A.P", "SP"), ("TABLE::A.T", "TABLE")], "NODE_ID string, NODE_TYPE string")
    assert files.mermaid(edges, nodes).splitlines() == [
        "graph LR", '  A_P["A.P"] -->|REF_TABLE| TABLE__A_T["TABLE::A.T"]:::table', '  A_P["A.P"] -->|CALL| odd__x_["odd #quot;x#quot;"]',
    ]
    assert ":::" not in files.mermaid(edges)
