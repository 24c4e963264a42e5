"""The dictionary pipeline and the folder scorer on small fixtures of our own."""

import pytest
from pyspark.sql import functions as F

from quarrymill.config import Pipeline, Scorer, merge
from quarrymill.functions import text as tx
from quarrymill.operators import graph as gr
from quarrymill.plans import checks, depgraph, inventory, metrics, scoring, sqlfolder
from quarrymill.schemas import INPUTS
from quarrymill.sources import files

FILES = {
    "in_objects": """OWNER,OBJECT_NAME,OBJECT_TYPE,STATUS,CREATED,LAST_DDL_TIME
A,PKG,PACKAGE BODY,VALID,,
A,HEAVY,PROCEDURE,VALID,,
A,LIGHT,PROCEDURE,VALID,,
A,TMP_X,PROCEDURE,VALID,,
B,CALLER,PROCEDURE,INVALID,,
A,TRG,TRIGGER,VALID,,
A,ORD,TABLE,VALID,,
A,HIDDEN,PROCEDURE,VALID,,
""",
    "in_source": '''OWNER,NAME,TYPE,LINE,TEXT
A,PKG,PACKAGE BODY,1,PACKAGE BODY PKG IS
A,PKG,PACKAGE BODY,2,  g_total NUMBER := 0;
A,PKG,PACKAGE BODY,3,  PROCEDURE GET_ONE(p OUT SYS_REFCURSOR) IS
A,PKG,PACKAGE BODY,4,  BEGIN
A,PKG,PACKAGE BODY,5,    OPEN p FOR SELECT * FROM ORD;
A,PKG,PACKAGE BODY,6,  END GET_ONE;
A,PKG,PACKAGE BODY,7,  FUNCTION CALC RETURN NUMBER IS
A,PKG,PACKAGE BODY,8,  BEGIN
A,PKG,PACKAGE BODY,9,    g_total := g_total + 1; RETURN g_total;
A,PKG,PACKAGE BODY,10,  END CALC;
A,HEAVY,PROCEDURE,1,PROCEDURE HEAVY IS
A,HEAVY,PROCEDURE,2,  PRAGMA AUTONOMOUS_TRANSACTION;
A,HEAVY,PROCEDURE,3,  CURSOR c IS SELECT ID FROM ORD; -- a comment
A,HEAVY,PROCEDURE,4,BEGIN
A,HEAVY,PROCEDURE,5,"  EXECUTE IMMEDIATE 'DELETE FROM ' || v_tab;"
A,HEAVY,PROCEDURE,6,"  EXECUTE IMMEDIATE 'DELETE FROM LOGT WHERE X = ''x'' ';"
A,HEAVY,PROCEDURE,7,  MERGE INTO ORD USING d ON (1=1); COMMIT; ROLLBACK;
A,HEAVY,PROCEDURE,8,  FOR r IN c LOOP NULL; END LOOP; DBMS_OUTPUT.PUT_LINE(1);
A,HEAVY,PROCEDURE,9,EXCEPTION WHEN OTHERS THEN NULL;
A,HEAVY,PROCEDURE,10,END;
A,LIGHT,PROCEDURE,1,PROCEDURE LIGHT IS
A,LIGHT,PROCEDURE,2,BEGIN
A,LIGHT,PROCEDURE,3,  SELECT 1 INTO x FROM EMP@HR_LINK;
A,LIGHT,PROCEDURE,4,END LIGHT;
B,CALLER,PROCEDURE,1,PROCEDURE CALLER IS
B,CALLER,PROCEDURE,2,BEGIN A.LIGHT; END;
A,TRG,TRIGGER,1,TRIGGER TRG AFTER INSERT ON ORD
A,TRG,TRIGGER,2,BEGIN UPDATE ORD SET X = 1; END;
A,HIDDEN,PROCEDURE,1,PROCEDURE HIDDEN WRAPPED
''',
    "in_dependencies": """OWNER,NAME,TYPE,REFERENCED_OWNER,REFERENCED_NAME,REFERENCED_TYPE,REFERENCED_LINK_NAME,DEPENDENCY_TYPE
A,LIGHT,PROCEDURE,HR,EMP,TABLE,HR_LINK,HARD
A,HEAVY,PROCEDURE,A,LIGHT,PROCEDURE,,HARD
A,LIGHT,PROCEDURE,A,HEAVY,PROCEDURE,,HARD
A,HEAVY,PROCEDURE,A,ORD,TABLE,,HARD
B,CALLER,PROCEDURE,A,LIGHT,PROCEDURE,,HARD
A,PKG,PACKAGE BODY,A,SYN,SYNONYM,,HARD
A,PKG,PACKAGE BODY,A,LOST,SYNONYM,,HARD
""",
    "in_arguments": "OWNER,PACKAGE_NAME,OBJECT_NAME,OVERLOAD,ARGUMENT_NAME,POSITION,DATA_TYPE,PLS_TYPE,IN_OUT\nA,PKG,GET_ONE,,P,1,REF CURSOR,SYS_REFCURSOR,OUT\nA,PKG,GET_ONE,,USER_EMAIL,2,VARCHAR2,,IN\n",
    "in_synonyms": "OWNER,SYNONYM_NAME,TABLE_OWNER,TABLE_NAME,DB_LINK\nPUBLIC,SYN,X,Y,\nA,SYN,A,ORD,\n",
    "in_db_links": "OWNER,DB_LINK,USERNAME,HOST\nA,OTHER,,\n",
    "in_tab_privs": "GRANTEE,OWNER,TABLE_NAME,PRIVILEGE,GRANTABLE,TYPE\nZ,A,HEAVY,EXECUTE,NO,PROCEDURE\n",
    "in_role_privs": "GRANTEE,OWNER,TABLE_NAME,PRIVILEGE,DEPTH,VIA_ROLES\nZ,A,HEAVY,EXECUTE,1,R\n",
    "in_triggers": "OWNER,TRIGGER_NAME,TABLE_OWNER,TABLE_NAME,STATUS,BODY_FILE\nA,TRG,A,ORD,ENABLED,trg.sql\n",
    "in_scheduler_jobs": "OWNER,JOB_NAME,JOB_TYPE,ACTION_FILE,ENABLED,SCHEDULE_TEXT\nA,NIGHT,PLSQL,night.sql,Y,\n",
    "in_app_calls": 'REPO,FILE_PATH,LINE_NO,SP_NAME_RAW,SP_NAME_RESOLVED,CALL_KIND,CALL_SNIPPET,CONFIDENCE\nweb,a.py,3,a.heavy,,X,"call ""h""",HIGH\nweb,b.py,4,a.nowhere,,X,,LOW\n',
}


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dictionary")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    (folder / "in_remote_objects__OTHER.csv").write_text("OWNER,OBJECT_NAME,OBJECT_TYPE,STATUS,CREATED,LAST_DDL_TIME\nHR,EMP,TABLE,,,\n")
    out = files.read_dictionary(spark, str(folder), INPUTS)
    out["folder"] = str(folder)
    return out


CONFIG = Pipeline(target_schemas=("A", "B"), exclude_name_patterns=("^TMP_",))


@pytest.fixture(scope="module")
def stages(spark, t):
    inv, gone = inventory.inventory(t, CONFIG)
    inv = gr.checkpointed(inv)
    m = gr.checkpointed(metrics.metrics(t, inv))
    sql, hints = metrics.sql_inventory(t, inv), metrics.dynamic_hints(t, inv)
    jobs = spark.createDataFrame([("night.sql", "begin a.heavy; end;")], "ACTION_FILE string, text string")
    g = depgraph.build(t, inv, sql, hints, inventory.grant_matrix(t), jobs)
    return inv, gone, m, sql, hints, {k: gr.checkpointed(v) for k, v in g.items()}


def test_sources(spark, t):
    assert t["in_exec_stats"].count() == 0 and t["in_app_calls"].first().CALL_SNIPPET == 'call "h"'
    assert files.headers(spark, f"{t['folder']}/in_db_links.csv") == ["OWNER", "DB_LINK", "USERNAME", "HOST"] and files.headers(spark, "/nowhere.csv") == []
    assert [tuple(r) for r in files.remote_objects(spark, t["folder"]).collect()] == [("OTHER", "HR", "EMP", "TABLE")]
    assert {r.code for r in checks.presence(spark, t["folder"]).collect()} == {"OPTIONAL_ABSENT"}


def test_inventory(spark, t, stages):
    inv, gone, *_ = stages
    by = {r.SP_ID: r for r in inv.collect()}
    assert set(by) == {"A.PKG.GET_ONE#0", "A.PKG.CALC#0", "A.HEAVY", "A.LIGHT", "B.CALLER", "A.TRG", "A.HIDDEN"}
    assert [r.OBJECT_NAME for r in gone.collect()] == ["TMP_X"]
    assert by["A.LIGHT"].REMOTE_REF_COUNT == 2 and by["A.HEAVY"].REMOTE_REF_COUNT == 0 and by["A.HIDDEN"].WRAPPED == "Y"
    assert by["A.PKG.CALC#0"].LOC == 10 and by["A.HEAVY"].CROSS_SCHEMA_CALLABLE == "Y"
    codes = {(r.REASON_CODE, r.SP_ID) for r in inventory.unresolved(t, files.remote_objects(spark, t["folder"]), CONFIG).collect()}
    assert {("UNRESOLVED_REMOTE", "A.LIGHT"), ("UNRESOLVED_SYNONYM", "A.PKG"), ("UNKNOWN_DB_LINK", "A.LIGHT"), ("INVALID_STATUS", "B.CALLER")} <= codes
    assert [r.DEPTH for r in inventory.grant_matrix(t).collect()] == [0]
    patch = spark.createDataFrame([("A.LIGHT", "EXCLUDE", None, "no", 0)], "SP_ID string, ACTION string, RESOLVED_TARGET string, REASON string, _ord int")
    assert inventory.inventory(t, CONFIG, patch)[0].where("SP_ID = 'A.LIGHT'").count() == 0


def test_metrics(spark, t, stages):
    _, _, m, sql, hints, _ = stages
    by = {r.SP_ID: r for r in m.collect()}
    h = by["A.HEAVY"]
    assert (h.CURSOR_EXPLICIT, h.CURSOR_FORLOOP, h.DYNAMIC_SQL_VARIABLE, h.DYNAMIC_SQL_LITERAL, h.TX_CONTROL, h.AUTONOMOUS_TX, h.FEATURE_MERGE, h.FEATURE_DBMS, h.ORACLE_FEATURE, h.EXCEPTION_HANDLER, h.WHEN_OTHERS) == (1, 1, 1, 1, 2, 1, 1, 1, 2, 1, 1)
    assert (by["A.PKG.GET_ONE#0"].CURSOR_REF, by["A.PKG.GET_ONE#0"].OUT_PARAM, by["A.PKG.GET_ONE#0"].REF_CURSOR_OUT, by["A.PKG.GET_ONE#0"].PARSE_MODE) == (1, 1, 1, "REGEX")
    assert by["A.PKG.CALC#0"].GLOBAL_PKG_VAR == 3 and by["A.TRG"].MUTATING_TRIGGER_RISK == 1 and by["A.HIDDEN"].PARSE_MODE == "SKIPPED" and by["A.LIGHT"].DB_LINK == 1
    heavy = [(r.STMT_SEQ, r.DML_TYPE, r.TABLES_RAW, r.DYNAMIC_KIND) for r in sql.where("SP_ID = 'A.HEAVY'").orderBy("STMT_SEQ").collect()]
    assert (2, "DELETE", "LOGT", "LITERAL") in heavy and ("MERGE", "ORD") in {(x[1], x[2]) for x in heavy} and ("SELECT", "ORD") in {(x[1], x[2]) for x in heavy}
    assert [(r.VARIABLES, r.RESOLVED_TABLES) for r in hints.collect()] == [("v_tab", "")]
    solved = spark.createDataFrame([("A.HEAVY", "LOGT;ORD", "seen", 0)], "SRC_SP_ID string, RESOLVED_TABLES string, REASON string, _ord int")
    assert metrics.dynamic_hints(t, stages[0], solved).first().RESOLVED_TABLES == "LOGT;ORD"
    patch = spark.createDataFrame([("A.HEAVY", "LOC", "7", "r", 0), ("A.HEAVY", "BAD", "7", "r", 1)], "SP_ID string, METRIC_NAME string, VALUE string, REASON string, _ord int")
    assert metrics.metrics(t, stages[0], patch).where("SP_ID = 'A.HEAVY'").first().LOC == 7
    assert metrics.parser_bench(m).agg(F.sum("COUNT")).first()[0] == 7


def test_graph(stages):
    g = stages[-1]
    edges = {(r.SRC, r.DST, r.EDGE_TYPE): r for r in g["s3_edges"].collect()}
    assert edges["A.LIGHT", "REMOTE::HR.EMP@HR_LINK", "REMOTE_REF"].CUT_POINT == "Y"
    assert edges["B.CALLER", "A.LIGHT", "CALL"].GRANT_OK == "N" and edges["A.HEAVY", "A.LIGHT", "CALL"].GRANT_OK == "Y"
    assert ("A.PKG.CALC#0", "TABLE::A.ORD", "REF_TABLE") in edges and ("APP::web", "A.HEAVY", "APP_CALL") in edges and ("JOB::A.NIGHT", "A.HEAVY", "JOB_CALL") in edges
    assert ("APP::web", "UNKNOWN::A.NOWHERE", "APP_CALL") in edges and ("A.HEAVY", "TABLE::A.LOGT", "DYNAMIC_SQL_LITERAL") in edges
    nodes = {r.NODE_ID: r for r in g["s3_nodes"].collect()}
    assert nodes["A.LIGHT"].SCC_ID == nodes["A.HEAVY"].SCC_ID == 0 and nodes["A.LIGHT"].WAVE_NO == nodes["A.HEAVY"].WAVE_NO == 1 and nodes["B.CALLER"].WAVE_NO == 0
    assert nodes["A.LIGHT"].FAN_IN == 2 and nodes["TABLE::A.ORD"].NODE_TYPE == "TABLE"
    codes = {r.REASON_CODE for r in g["s3_review"].collect()}
    assert {"LOW_CONFIDENCE_EDGE", "GRANT_MISSING", "ORPHAN_NODE"} <= codes and "graph LR" in files.mermaid(g["s3_edges"])


def test_scores_and_reports(spark, t, stages, tmp_path):
    inv, _, m, _, _, g = stages
    s = gr.checkpointed(scoring.scores(inv, m, g, CONFIG))
    by = {r.SP_ID: r for r in s.collect()}
    assert by["A.HEAVY"].STRATEGY == "DEFER" and by["A.LIGHT"].STRATEGY == "DEFER" and by["A.LIGHT"].PROMOTED and by["A.TRG"].STRATEGY == "DEFER"
    assert all(0 <= r.D_SCORE <= 100 and 0 <= r.C_SCORE <= 100 and r.EFFORT_P90 == pytest.approx(1.5 * r.EFFORT_EST_MD, abs=0.011) for r in by.values())
    patch = spark.createDataFrame([("A.TRG", "MANUAL", "r", None, 9.0, 0)], "SP_ID string, STRATEGY string, REASON string, QUADRANT string, EFFORT_MD double, _ord int")
    one = scoring.scores(inv, m, g, CONFIG, override=patch).where("SP_ID = 'A.TRG'").first()
    assert (one.STRATEGY, one.EFFORT_EST_MD, one.QUADRANT) == ("MANUAL", 9.0, by["A.TRG"].QUADRANT)
    pilot = spark.createDataFrame([(k, float(i + 1)) for i, k in enumerate(by)], "SP_ID string, ACTUAL_MD double")
    fit = scoring.scores(inv, m, g, merge(CONFIG, {"min_samples": 3}), pilot=pilot)
    assert fit.where("CONFIDENCE <> 'MEDIUM' or EFFORT_P90 < EFFORT_P50 or EFFORT_P50 < 0.1").count() == 0
    assert scoring.roadmap(s, g["s3_edges"]).agg(F.sum("SP_COUNT"), F.sum("DBLINK_CUTPOINT_COUNT")).first()[:] == (7, 1)
    assert scoring.cut_points(g["s3_edges"], files.remote_objects(spark, t["folder"])).first().SUGGESTION == "decide by hand"
    assert {"WRAPPED", "AUTONOMOUS_TX", "MUTATING_TRIGGER", "PII_ARGUMENT"} <= {r.RISK for r in scoring.risks(inv, m, g, t["in_arguments"]).collect()}
    assert {"PARSE_MODE_NOT_AST", "SCC_STRATEGY_PROMOTED"} <= {r.REASON_CODE for r in scoring.score_review(s, m).collect()}
    assert scoring.wide_inventory(inv, m, g["s3_nodes"], s).count() == 7 and "<circle" in files.scatter_svg(s, "D_SCORE", "C_SCORE")
    files.snapshot(s, str(tmp_path), "v1")
    files.snapshot(s.withColumn("STRATEGY", F.when(F.col("SP_ID") == "A.TRG", "SEMI").otherwise(F.col("STRATEGY"))), str(tmp_path), "v2")
    assert [r.key for r in checks.diff(spark, str(tmp_path), "s4_scores", "v1", "v2").collect()] == ["A.TRG"]
    assert checks.diff(spark, str(tmp_path), "s4_scores", "v1", "v1").count() == 0
    with pytest.raises(ValueError):
        checks.diff(spark, str(tmp_path), "nothing", "v1", "v2")
    with pytest.raises(FileNotFoundError):
        checks.diff(spark, str(tmp_path), "s4_scores", "v1", "v9")
    files.write_csv(s.select("SP_ID", "STRATEGY"), f"{tmp_path}/out.csv", single=True)
    assert (tmp_path / "out.csv").read_text().startswith("SP_ID,STRATEGY\nA.HEAVY,DEFER\n")


def test_checks(spark, t, stages):
    inv, _, m, _, _, g = stages
    o = {
        "s1_inventory_override": spark.createDataFrame([("A.X", "EXCLUDE", None, ""), ("A.X", "INCLUDE", None, "r"), ("A.X", "INCLUDE", None, "r")], "SP_ID string, ACTION string, RESOLVED_TARGET string, REASON string"),
        "s4_strategy_override": spark.createDataFrame([("A.HEAVY", "SEMI", "r"), ("A.HEAVY", "DEFER", "r")], "SP_ID string, STRATEGY string, REASON string"),
        "pilot_effort": spark.createDataFrame([("A.HEAVY", 1.0)], "SP_ID string, ACTUAL_MD double"),
    }
    assert {r.code for r in checks.lint(o).collect()} == {"REASON_BLANK", "CONFLICTING_ACTION", "CONFLICTING_STRATEGY", "DUPLICATE_ROW"}
    found = {r.code for r in checks.validate(t, o, files.remote_objects(spark, t["folder"]), inv, m).collect()}
    assert {"INVALID_STATUS", "WRAP_SOURCE_PRESENT", "OVERRIDE_REASON_MISSING", "OVERRIDE_SP_ID_UNKNOWN", "DEPENDENCY_REFERENCED_NOT_IN_OBJECTS", "PARSER_SUCCESS_RATE_LOW", "CALIBRATION_SAMPLES_INSUFFICIENT"} <= found
    assert {r.message for r in checks.missing_bodies(t, spark.createDataFrame([("trg.sql",)], "path string")).collect()} == {"night.sql"}
    got = {r.spike: (r.rate, r.verdict) for r in checks.spikes(m, g["s3_edges"].where("EDGE_TYPE = 'APP_CALL'")).collect()}
    assert got["SP-2"] == (0.5, "FAIL") and got["SP-3"] == (0.5, "FAIL")


def test_folder_scorer(spark, tmp_path):
    (tmp_path / "a.sql").write_text(
        "CREATE OR REPLACE PACKAGE BODY app.pkg_o AS\n  PROCEDURE put IS\n  BEGIN\n    INSERT INTO ord VALUES (seq_o.NEXTVAL);\n    IF x THEN UPDATE ord SET a = 1; END IF;\n    PRC_LOG(1);\n  EXCEPTION WHEN OTHERS THEN NULL;\n  END;\nEND;\n/\n"
        "CREATE TABLE app.ord (a NUMBER)\n/\nGRANT EXECUTE ON app.pkg_o TO web, x;\n"
    )
    (tmp_path / "b.sql").write_text(
        "CREATE PROCEDURE app.prc_log(a NUMBER) IS\nBEGIN\n  -- nothing PKG_X.Y\n  NULL;\nEND;\n/\nCREATE PROCEDURE \"PRC_SET\" IS\nBEGIN\n  FOR r IN (SELECT a FROM (SELECT a FROM ord)) LOOP\n    EXECUTE IMMEDIATE 'x'; pkg_o.put; PRC_LOG(2); DBMS_OUTPUT.PUT(1); SELECT 1 INTO z FROM t@far;\n  END LOOP;\nEND;\n/\n"
    )
    texts = sqlfolder.scripts(spark, str(tmp_path)).cache()
    objs, granted = sqlfolder.objects(texts), sqlfolder.grants(texts)
    assert {r.key for r in objs.collect()} == {"APP.PKG_O:PACKAGE_BODY", "APP.ORD", "APP.PRC_LOG", "PRC_SET"}
    assert [tuple(r) for r in granted.collect()] == [("EXECUTE", "APP.PKG_O", "WEB")]
    m = {r.key: r for r in sqlfolder.metrics(objs).collect()}
    assert (m["PRC_SET"].loop, m["PRC_SET"].nesting, m["PRC_SET"].dynamic, m["PRC_SET"].query) == (1, 2, 1, 3)
    assert (m["APP.PKG_O:PACKAGE_BODY"].branch, m["APP.PKG_O:PACKAGE_BODY"].subprogram, m["APP.PKG_O:PACKAGE_BODY"].dml, m["APP.PKG_O:PACKAGE_BODY"].handler) == (1, 1, 2, 1)
    refs = sqlfolder.references(objs, granted)
    by = {(r.src, r.target, r.rtype): r for r in refs.collect()}
    assert by["APP.PKG_O:PACKAGE_BODY", "ORD", "TABLE"].resolved and ("APP.PKG_O:PACKAGE_BODY", "SEQ_O", "SEQUENCE") in by and ("APP.PKG_O:PACKAGE_BODY", "WEB", "GRANT") in by
    assert by["PRC_SET", "PKG_O", "PACKAGE"].target_key == "APP.PKG_O:PACKAGE_BODY" and ("PRC_SET", "T@FAR", "DB_LINK") in by and ("PRC_SET", "DBMS_OUTPUT.PUT", "BUILTIN") in by and ("PRC_SET", "PRC_LOG", "CALL") in by
    s = sqlfolder.scores(objs, sqlfolder.metrics(objs), refs, Scorer())
    rows = {r.key: r for r in s.collect()}
    assert rows["APP.PRC_LOG"].callers == ["APP.PKG_O:PACKAGE_BODY", "PRC_SET"] and rows["APP.PRC_LOG"].impact == 8.0 and all(0 <= r.final <= 100 for r in rows.values())
    (tmp_path / "s.csv").write_text("﻿Name,MH\nprc_log,4\nprc_set,20\n,3\nx,bad\n")
    e = sqlfolder.effort(s, files.effort_samples(spark, f"{tmp_path}/s.csv"))
    got = {r.key: r for r in e.collect()}
    assert (got["PRC_SET"].p50, got["PRC_SET"].basis) == (20.0, "measured") and got["APP.PKG_O:PACKAGE_BODY"].p90 >= got["APP.PKG_O:PACKAGE_BODY"].p50 > 0
    assert sqlfolder.effort_summary(e).first().confidence == "LOW"
    sqlfolder.report(spark, s, refs, f"{tmp_path}/r.md")
    assert "## 3. Hubs" in (tmp_path / "r.md").read_text()


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.clean_str(F.lit(" \tNaN　")).alias("a"), tx.strip_comments_keep_lines(F.lit("a/* x\ny */b -- c\nd")).alias("b"), tx.round2(F.lit(0.125)).alias("c"), tx.nesting(F.lit("))((select 1) select")).alias("d"),
    ).first()
    assert row.a == "" and row.b == "a\nb \nd" and row.c == 0.12 and (row.d.most, row.d.marks) == (2, 2)


def test_bootstrap_where_rows_are(spark):
    """A pilot above the bound is resampled in place: near the driver's resampling, and the same again."""
    from quarrymill.operators import stats as st

    rows = spark.createDataFrame([(k, float(k % 17), float(k % 5), 3.0 + 2 * (k % 17) - (k % 5) + (k * 37 % 11) / 5) for k in range(600)], "id long, a double, b double, y double")
    near = {r.id: r for r in st.bootstrap(rows, rows, "id", "y", ["a", "b"]).collect()}
    far = {r.id: r for r in st.bootstrap(rows, rows, "id", "y", ["a", "b"], gathered=10).collect()}
    again = {r.id: r for r in st.bootstrap(rows, rows, "id", "y", ["a", "b"], gathered=10).collect()}
    for k in near:
        assert far[k].estimate == pytest.approx(near[k].estimate) and far[k].p50 == pytest.approx(near[k].p50, abs=0.1) and far[k].p90 == pytest.approx(near[k].p90, abs=0.1)
        assert far[k].p90 == pytest.approx(again[k].p90)


def test_ranks_of_heavy_tails(spark):
    """Quantile ranges give the ranks of a plain sort, whatever the values' spread; most ranges have few."""
    from quarrymill.operators import rank as rk

    values = [float(10 ** (k % 9)) + k % 50 for k in range(3000)] + [1e15, -1e12, 0.0]
    rows = spark.createDataFrame([(k, "m", v) for k, v in enumerate(values)], "id long, metric string, value double")
    got = {r.id: r.score for r in rk.strict_ranks(rows, "id").collect()}
    ordered = sorted(values)
    import bisect

    for k, v in enumerate(values):
        assert got[k] == pytest.approx(bisect.bisect_left(ordered, v) / (len(values) - 1) * 100)


def test_large_components_by_rounds(spark):
    """Strong components of 10,000 edges and more by the distributed rounds alone."""
    edges = [(k, k + 1) for k in range(3000) if k % 10 != 9] + [(k + 9, k) for k in range(0, 3000, 10)] + [(k, (k * 7919) % 3000 + 4000) for k in range(3000)] * 2 + [(5000 + k, 4000 + k % 900) for k in range(2000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = df.selectExpr("src as node").unionByName(df.selectExpr("dst as node")).distinct()
    found = {r.node: r.component for r in gr.strong_components(nodes, df, 50).collect()}
    assert all(found[k] == found[k // 10 * 10] for k in range(3000)) and len({found[k] for k in range(3000)}) == 300
