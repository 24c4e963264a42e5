"""Queries of the program-code stages.  The tables hold no program code, so a unit is written for
each part or supplier, its lines chosen by the row's numbers; the SQL says what the stages must
find from these numbers alone, without reading the code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.config import Pipeline, Scorer
from quarrymill.plans import checks, depgraph, inventory, metrics, scoring, sqlfolder
from quarrymill.plans.catalogue import query
from quarrymill.schemas import INPUTS

#: A unit's lines as SQL expressions of k (part key) and s (its size).
_LINES = (
    "'PROCEDURE P' || k || ' IS' || if(s % 11 = 0, ' WRAPPED', '')",
    "'  CURSOR c IS SELECT a FROM T' || (k % 7) || '; -- IF note'",
    "if(s % 3 = 0, '  PRAGMA AUTONOMOUS_TRANSACTION;', '  /* COMMIT; */')",
    "'BEGIN'",
    r"case s % 4 when 0 then '  EXECUTE IMMEDIATE \'DELETE FROM D' || (k % 5) || '\';' when 1 then '  EXECUTE IMMEDIATE \'DELETE FROM \' || v_tab USING p_id;' else '  NULL;' end",
    r"if(s % 2 = 0, '  COMMIT;', '  IF x THEN UPDATE U' || (k % 3) || ' SET a = \'IF\'; END IF;')",
    "if(s % 5 = 0, '  GOTO done; x := UTL_FILE.OPEN(1);', '  DBMS_OUTPUT.PUT(y@LNK);')",
    "if(s % 7 = 0, 'EXCEPTION WHEN OTHERS THEN NULL;', '  NULL;')",
    "if(s % 13 = 0, '-- cut', 'END P' || k || ';')",
)


def _dictionary(t) -> dict[str, DataFrame]:
    """Dictionary tables of one procedure P<key> for each part; odd and even keys have different owners."""
    p = t("part").selectExpr("cast(p_partkey as string) as k0", "p_partkey as k", "p_size as s", "if(p_partkey % 2 = 0, 'A', 'B') as OWNER")
    spark = p.sparkSession
    out = {name: spark.createDataFrame([], c.schema) for name, c in INPUTS.items()}
    name = F.concat(F.lit("P"), "k0")
    out["in_objects"] = p.select("OWNER", name.alias("OBJECT_NAME"), F.lit("PROCEDURE").alias("OBJECT_TYPE"), F.expr("if(s = 17, 'INVALID', 'VALID')").alias("STATUS"), F.lit(None).cast("string").alias("CREATED"), F.lit(None).cast("string").alias("LAST_DDL_TIME"))
    lines = F.array(*(F.struct(F.lit(i).cast("long").alias("LINE"), F.expr(x).alias("TEXT")) for i, x in enumerate(_LINES, 1)))
    out["in_source"] = p.select("OWNER", name.alias("NAME"), F.lit("PROCEDURE").alias("TYPE"), F.explode(lines).alias("z")).select("OWNER", "NAME", "TYPE", "z.LINE", "z.TEXT")
    none = F.lit(None).cast("string")
    # Each unit uses the table T<k mod 7> of A, and every third one calls the unit of half its key.
    uses = p.select("OWNER", name.alias("NAME"), F.lit("A").alias("RO"), F.expr("'T' || (k % 7)").alias("RN"), F.lit("TABLE").alias("RT"))
    calls = p.where("k % 3 = 0 and k > 0").select("OWNER", name.alias("NAME"), F.expr("if((k div 2) % 2 = 0, 'A', 'B')").alias("RO"), F.expr("'P' || (k div 2)").alias("RN"), F.lit("PROCEDURE").alias("RT"))
    out["in_dependencies"] = uses.unionByName(calls).select("OWNER", "NAME", F.lit("PROCEDURE").alias("TYPE"), F.col("RO").alias("REFERENCED_OWNER"), F.col("RN").alias("REFERENCED_NAME"), F.col("RT").alias("REFERENCED_TYPE"), none.alias("REFERENCED_LINK_NAME"), F.lit("HARD").alias("DEPENDENCY_TYPE"))
    rights = p.where("k % 4 < 2").select(F.expr("if(k % 8 = 0, 'PUBLIC', if(OWNER = 'A', 'B', 'A'))").alias("GRANTEE"), "OWNER", name.alias("TABLE_NAME"))
    out["in_tab_privs"] = rights.select("GRANTEE", "OWNER", "TABLE_NAME", F.lit("EXECUTE").alias("PRIVILEGE"), F.lit("NO").alias("GRANTABLE"), F.lit("PROCEDURE").alias("TYPE"))
    return out


def _inventory(d: dict[str, DataFrame]) -> DataFrame:
    return inventory.inventory(d, Pipeline())[0]


_UNITS = "u AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS o, o || '.P' || p_partkey AS id FROM part)"


@query(f"""
WITH {_UNITS} SELECT id AS sp_id, CASE WHEN s % 13 = 0 THEN 8 ELSE 9 END::BIGINT AS loc, CASE WHEN s = 17 THEN 'INVALID' ELSE 'VALID' END AS status, CASE WHEN s % 11 = 0 THEN 'Y' ELSE 'N' END AS wrapped,
  CASE WHEN s % 5 <> 0 THEN 1 ELSE 0 END::BIGINT AS remote_refs, CASE WHEN k % 4 < 2 AND k % 8 <> 0 THEN 'Y' ELSE 'N' END AS cross_schema FROM u
""")
def unit_inventory(t):
    """The inventory of units (OP-JN-05 to OP-JN-08, OP-FLT-06, OP-TX-21, OP-AG-01, OP-PRJ-03)."""
    i = _inventory(_dictionary(t))
    return i.select(F.col("SP_ID").alias("sp_id"), F.col("LOC").cast("long").alias("loc"), F.col("STATUS").alias("status"), F.col("WRAPPED").alias("wrapped"), F.col("REMOTE_REF_COUNT").cast("long").alias("remote_refs"), F.col("CROSS_SCHEMA_CALLABLE").alias("cross_schema"))


_COUNTS = {
    "branch": ("BRANCH", "2 * (s % 2 = 1)::INT"), "cursors": ("CURSOR_EXPLICIT", "1"), "dyn_literal": ("DYNAMIC_SQL_LITERAL", "(s % 4 = 0)::INT"), "dyn_variable": ("DYNAMIC_SQL_VARIABLE", "(s % 4 = 1)::INT"),
    "tx": ("TX_CONTROL", "(s % 2 = 0)::INT"), "autonomous": ("AUTONOMOUS_TX", "(s % 3 = 0)::INT"), "utl": ("FEATURE_UTL", "(s % 5 = 0)::INT"), "dbms": ("FEATURE_DBMS", "(s % 5 <> 0)::INT"), "features": ("ORACLE_FEATURE", "1"),
    "links": ("DB_LINK", "(s % 5 <> 0)::INT"), "handlers": ("EXCEPTION_HANDLER", "(s % 7 = 0)::INT"), "others": ("WHEN_OTHERS", "(s % 7 = 0)::INT"), "gotos": ("GOTO", "(s % 5 = 0)::INT"),
}
_MODE = "CASE WHEN s % 11 = 0 THEN 'SKIPPED' WHEN s % 13 = 0 THEN 'PARTIAL' ELSE 'REGEX' END"


@query(f"""
WITH {_UNITS} SELECT id AS sp_id, {", ".join(f"CASE WHEN s % 11 = 0 THEN 0 ELSE {e} END::BIGINT AS {n}" for n, (_, e) in _COUNTS.items())},
  {_MODE} AS mode, CASE {_MODE} WHEN 'REGEX' THEN 0.6 WHEN 'PARTIAL' THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence FROM u
""")
def unit_metrics(t):
    """Metrics of units (OP-TX-02 to OP-TX-11, OP-TX-16, OP-TX-19, OP-JN-14)."""
    d = _dictionary(t)
    m = metrics.metrics(d, _inventory(d))
    return m.select(F.col("SP_ID").alias("sp_id"), *(F.col(c).cast("long").alias(n) for n, (c, _) in _COUNTS.items()), F.col("PARSE_MODE").alias("mode"), F.col("PARSE_CONFIDENCE").alias("confidence"))


@query(f"WITH {_UNITS}, m AS (SELECT {_MODE} AS mode FROM u) SELECT mode, count(*) AS units, round((SELECT avg((mode = 'REGEX')::INT) FROM m), 6) AS success FROM m GROUP BY mode")
def parse_modes(t):
    """Counts of parse modes and the share of parsed units (OP-AG-09, OP-AG-18)."""
    d = _dictionary(t)
    return metrics.parser_bench(metrics.metrics(d, _inventory(d))).select(F.col("PARSE_MODE").alias("mode"), F.col("COUNT").alias("units"), F.round("SUCCESS_RATE", 6).alias("success"))


@query(f"""
WITH {_UNITS}, a AS (
  SELECT id, 0 AS i, 'DELETE' AS dml, CASE WHEN s % 4 = 0 THEN 'D' || (k % 5) ELSE '' END AS tables, CASE WHEN s % 4 = 0 THEN 'LITERAL' ELSE 'VARIABLE' END AS kind FROM u WHERE s % 11 <> 0 AND s % 4 < 2
  UNION ALL SELECT id, 1, 'SELECT', 'T' || (k % 7), '' FROM u WHERE s % 11 <> 0
  UNION ALL SELECT id, 2, 'UPDATE', 'U' || (k % 3), '' FROM u WHERE s % 11 <> 0 AND s % 2 = 1)
SELECT id AS sp_id, row_number() OVER (PARTITION BY id ORDER BY i) AS seq, dml, tables, kind FROM a
""")
def unit_statements(t):
    """Dynamic and static statements with their tables (OP-TX-11, OP-TX-13, OP-TX-14, OP-TX-15, OP-WN-08)."""
    d = _dictionary(t)
    s = metrics.sql_inventory(d, _inventory(d))
    return s.select(F.col("SP_ID").alias("sp_id"), F.col("STMT_SEQ").alias("seq"), F.col("DML_TYPE").alias("dml"), F.col("TABLES_RAW").alias("tables"), F.col("DYNAMIC_KIND").alias("kind"))


@query(f"WITH {_UNITS} SELECT id AS sp_id, 'v_tab' AS variables, '''DELETE FROM '' || v_tab' AS snippet FROM u WHERE s % 11 <> 0 AND s % 4 = 1")
def unit_hints(t):
    """Variable dynamic statements (OP-TX-12, OP-SO-06, OP-OV-03)."""
    d = _dictionary(t)
    h = metrics.dynamic_hints(d, _inventory(d))
    return h.select(F.col("SP_ID").alias("sp_id"), F.col("VARIABLES").alias("variables"), F.col("SNIPPET").alias("snippet"))


@query(f"""
WITH {_UNITS}, calls AS (SELECT u.id AS src, u.o, u.k, v.id AS dst, v.o AS vo, v.k AS vk FROM u JOIN u v ON v.k = u.k // 2 WHERE u.k % 3 = 0 AND u.k > 0)
SELECT id AS src, 'TABLE::A.T' || (k % 7) AS dst, 'REF_TABLE' AS edge_type, 'HIGH' AS trust, '' AS grant_ok FROM u
UNION ALL SELECT src, dst, 'CALL', 'HIGH', CASE WHEN o = vo OR vk % 4 < 2 THEN 'Y' ELSE 'N' END FROM calls
UNION ALL SELECT id, 'TABLE::A.D' || (k % 5), 'DYNAMIC_SQL_LITERAL', 'MEDIUM', '' FROM u WHERE o = 'A' AND s % 11 <> 0 AND s % 4 = 0
UNION ALL SELECT id, 'TABLE::B.D' || (k % 5), 'DYNAMIC_SQL_LITERAL', 'MEDIUM', '' FROM u WHERE o = 'B' AND s % 11 <> 0 AND s % 4 = 0
UNION ALL SELECT id, 'UNKNOWN::' || id, 'DYNAMIC_SQL_VARIABLE', 'LOW', '' FROM u WHERE s % 11 <> 0 AND s % 4 = 1
""")
def unit_edges(t):
    """Edges of dependencies and dynamic statements, with rights (OP-GR-01, OP-GR-02, OP-JN-16, OP-JN-17, OP-JN-20, OP-FLT-10, OP-TX-23)."""
    d = _dictionary(t)
    i = _inventory(d)
    parts = [depgraph.dependency_edges(d, i), depgraph.dynamic_edges(metrics.sql_inventory(d, i), metrics.dynamic_hints(d, i))]
    e = depgraph.grant_checked(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), i, inventory.grant_matrix(d))
    return e.select(F.col("SRC").alias("src"), F.col("DST").alias("dst"), F.col("EDGE_TYPE").alias("edge_type"), F.col("EDGE_CONFIDENCE").alias("trust"), F.col("GRANT_OK").alias("grant_ok"))


# A script for each supplier: a procedure that reads a table, calls the next one's and a built-in package, then a grant and a table.
_SCRIPT = r"""concat('-- head\nCREATE OR REPLACE PROCEDURE app.P', k, ' AS\nBEGIN\n  FOR r IN (SELECT a FROM (SELECT a FROM T', k % 5, ')) LOOP NULL; END LOOP;\n',
  if(k % 3 = 0, '  UPDATE T0 SET a = SQ.NEXTVAL;\n  DBMS_LOCK.SLEEP(1);\n', ''), '  IF a THEN P', k + 1, '(1); ELSIF b THEN NULL; END IF; -- P', k + 2, '(1);\n',
  if(k % 2 = 0, 'EXCEPTION WHEN OTHERS THEN NULL;\n', ''), 'END;\n/\nCREATE TABLE app.T', k, ' (a NUMBER)\n/\nGRANT EXECUTE ON app.P', k, ' TO web, other;\n')"""


def _scripts(t) -> DataFrame:
    return t("supplier").selectExpr("s_suppkey as k").select(F.expr("concat('f', lpad(cast(k as string), 12, '0'), '.sql')").alias("path"), F.expr(_SCRIPT).alias("text"))


@query("""
WITH u AS (SELECT s_suppkey AS k, 'APP.P' || s_suppkey AS id FROM supplier)
SELECT id AS src, 'T' || (k % 5) AS target, 'TABLE' AS rtype, true AS resolved, CASE WHEN k % 15 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM u
UNION ALL SELECT id, 'T0', 'TABLE', true, 1 FROM u WHERE k % 3 = 0 AND k % 5 <> 0
UNION ALL SELECT id, 'SQ', 'SEQUENCE', false, 1 FROM u WHERE k % 3 = 0
UNION ALL SELECT id, 'DBMS_LOCK.SLEEP', 'BUILTIN', false, 1 FROM u WHERE k % 3 = 0
UNION ALL SELECT id, 'P' || (k + 1), 'CALL', true, 1 FROM u WHERE k + 1 IN (SELECT k FROM u)
UNION ALL SELECT id, 'WEB', 'GRANT', false, 1 FROM u
""")
def script_references(t):
    """References of scripts (OP-TX-24, OP-TX-25, OP-TX-26, OP-TX-28, OP-TX-29, OP-JN-25 to OP-JN-27, OP-AG-19, OP-FLT-13, OP-WN-06, OP-WN-07)."""
    texts = _scripts(t)
    r = sqlfolder.references(sqlfolder.objects(texts), sqlfolder.grants(texts))
    return r.select("src", "target", "rtype", "resolved", F.col("count").cast("long").alias("n"))


@query("""
SELECT 'APP.P' || s_suppkey AS key, 5 + 2 * (s_suppkey % 3 = 0)::INT + (s_suppkey % 2 = 0)::INT AS loc, 2::BIGINT AS branch, 1::BIGINT AS loops, 2::BIGINT AS queries, 2::BIGINT AS nesting,
  (s_suppkey % 3 = 0)::BIGINT AS dml, (s_suppkey % 2 = 0)::BIGINT AS handlers, (s_suppkey % 2 = 0)::BIGINT AS others, 4 + (s_suppkey % 2 = 0)::BIGINT AS cyclomatic FROM supplier
""")
def script_metrics(t):
    """Metrics of scripts (OP-TX-27, OP-WN-09, OP-PRJ-10, OP-FLT-05)."""
    m = sqlfolder.metrics(sqlfolder.objects(_scripts(t)))
    return m.select("key", "loc", "branch", F.col("loop").alias("loops"), F.col("query").alias("queries"), "nesting", "dml", F.col("handler").alias("handlers"), "others", "cyclomatic")


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'A.PK' || k || '.ONE#0' AS sp_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS globals_used, 0::BIGINT AS mutating FROM s
UNION ALL SELECT 'A.PK' || k || '.TWO#0', 1, 0 FROM s UNION ALL SELECT 'A.TR' || k, 0, (k % 3 = 0)::BIGINT FROM s
""")
def package_state(t):
    """Subprograms found in packages, uses of package variables, triggers that touch their own table (OP-TX-17, OP-TX-18, OP-TX-20, OP-JN-13, OP-JN-15, OP-JN-28, OP-WN-05)."""
    s = t("supplier").selectExpr("s_suppkey as k")
    d = {name: s.sparkSession.createDataFrame([], c.schema) for name, c in INPUTS.items()}
    package = ("concat('PACKAGE BODY PK', k, ' IS')", "'  g_n NUMBER := 0;'", "'  PROCEDURE ONE IS'", "'  BEGIN'", "if(k % 2 = 0, '  g_n := g_n + 1;', '  NULL;')", "'  END ONE;'", "'  PROCEDURE TWO IS'", "'  BEGIN'", "'  x := g_n;'", "'  END TWO;'")
    trigger = ("concat('TRIGGER TR', k, ' AFTER UPDATE ON T', k)", "'BEGIN'", "if(k % 3 = 0, concat('UPDATE T', k, ' SET a = 1;'), 'NULL;')", "'END;'")
    kinds = (("PACKAGE BODY", "PK", package), ("TRIGGER", "TR", trigger))
    rows = []
    for kind, prefix, lines in kinds:
        made = F.array(*(F.struct(F.lit(i).cast("long").alias("LINE"), F.expr(x).alias("TEXT")) for i, x in enumerate(lines, 1)))
        rows.append(s.select(F.lit("A").alias("OWNER"), F.concat(F.lit(prefix), F.col("k").cast("string")).alias("NAME"), F.lit(kind).alias("TYPE"), F.explode(made).alias("z"), "k"))
    src = rows[0].unionByName(rows[1])
    none = F.lit(None).cast("string")
    d["in_source"] = src.select("OWNER", "NAME", "TYPE", "z.LINE", "z.TEXT")
    d["in_objects"] = src.where("z.LINE = 1").select("OWNER", F.col("NAME").alias("OBJECT_NAME"), F.col("TYPE").alias("OBJECT_TYPE"), F.lit("VALID").alias("STATUS"), none.alias("CREATED"), none.alias("LAST_DDL_TIME"))
    d["in_triggers"] = rows[1].where("z.LINE = 1").select("OWNER", F.col("NAME").alias("TRIGGER_NAME"), F.lit("A").alias("TABLE_OWNER"), F.expr("concat('T', k)").alias("TABLE_NAME"), F.lit("ENABLED").alias("STATUS"), none.alias("BODY_FILE"))
    m = metrics.metrics(d, _inventory(d))
    return m.select(F.col("SP_ID").alias("sp_id"), F.col("GLOBAL_PKG_VAR").alias("globals_used"), F.col("MUTATING_TRIGGER_RISK").alias("mutating"))


# Scores of the scripts, from their metrics and references as the SQL knows them.
_SCORES = """
u AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k, (k % 3 = 0)::INT AS m, (k % 2 = 0)::INT AS h, (k + 1 IN (SELECT k FROM u))::INT AS c, (k - 1 IN (SELECT k FROM u))::INT AS i FROM u),
v AS (SELECT k, round((5 + 2 * m + h) / 10.0::DOUBLE + 12 + m + 3.5 * h + 1 + m + 2.5 * m + 4 * c + 3, 2) AS absolute, round(4.0::DOUBLE * i + 3, 2) AS impact FROM f),
n AS (SELECT *, percent_rank() OVER (ORDER BY absolute) * 100 AS cn, percent_rank() OVER (ORDER BY impact) * 100 AS im FROM v),
sc AS (SELECT *, CASE WHEN absolute < 20 THEN 'low' WHEN absolute < 50 THEN 'mid' WHEN absolute < 100 THEN 'high' ELSE 'very high' END AS band FROM n)
"""


def _scored(t, config: Scorer) -> DataFrame:
    texts = _scripts(t)
    objs = sqlfolder.objects(texts)
    return sqlfolder.scores(objs, sqlfolder.metrics(objs), sqlfolder.references(objs, sqlfolder.grants(texts)), config)


@query(f"""
WITH {_SCORES} SELECT 'APP.P' || k AS key, absolute, band, impact, round(cn, 1) AS conv_norm, round(im, 1) AS imp_norm, round(0.7 * cn + 0.3 * im, 1) AS final FROM sc
""")
def script_scores(t):
    """Absolute, impact and final scores with bands (OP-ST-06 to OP-ST-08, OP-MA-01, OP-PRJ-09, OP-PRJ-10, OP-AG-20, OP-AG-21)."""
    return _scored(t, Scorer()).select("key", "absolute", "band", "impact", "conv_norm", "imp_norm", "final")


@query(f"WITH {_SCORES} SELECT 'APP.P' || k AS key, round(sqrt(cn * im), 1) AS final FROM sc")
def script_scores_geometric(t):
    """The final score as a geometric mean (OP-ST-07)."""
    return _scored(t, Scorer(final_mode="geometric")).select("key", "final")


@query(f"""
WITH {_SCORES}, h AS (SELECT k, 3.0::DOUBLE + k % 7 AS hours FROM u WHERE k % 4 = 0), j AS (SELECT sc.*, h.hours, greatest(absolute, 0.1) AS x FROM sc LEFT JOIN h USING (k)),
b AS (SELECT band, avg(hours) AS b50, CASE WHEN count(*) >= 4 THEN quantile_cont(hours, 0.9) ELSE avg(hours) * 1.5 END AS b90 FROM j WHERE hours IS NOT NULL GROUP BY band),
l AS (SELECT regr_slope(hours, x) AS s, regr_intercept(hours, x) AS i FROM j WHERE hours IS NOT NULL),
e AS (SELECT j.*, b50, b90, coalesce(b50, greatest(i + s * x, 0.1)) AS base FROM j LEFT JOIN b USING (band), l),
g AS (SELECT *, CASE WHEN b50 IS NOT NULL THEN b90 ELSE base * 1.5 END * (1 + 0.3 * round(im, 1) / 100) AS p90 FROM e)
SELECT 'APP.P' || k AS key, round(coalesce(hours, base), 1) AS p50, round(coalesce(hours, greatest(p90, base)), 1) AS p90, CASE WHEN hours IS NOT NULL THEN 'measured' WHEN b50 IS NOT NULL THEN 'band ' || band ELSE 'linear' END AS basis FROM g
""")
def script_effort(t):
    """Effort from samples: by band, by a line elsewhere (OP-AG-22 to OP-AG-24, OP-AG-25)."""
    samples = t("supplier").where("s_suppkey % 4 = 0").select(F.expr("'p' || s_suppkey").alias("key"), F.expr("3.0D + s_suppkey % 7").alias("hours"))
    return sqlfolder.effort(_scored(t, Scorer()), samples, Scorer()).select("key", "p50", "p90", "basis")


@query("""
WITH u AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'APP.P' || k AS src, 'TABLE' AS rtype, CASE WHEN k % 15 = 0 THEN 'T0✓×2' WHEN k % 3 = 0 THEN 'T0✓, T' || (k % 5) || '✓' ELSE 'T' || (k % 5) || '✓' END AS targets FROM u
UNION ALL SELECT 'APP.P' || k, 'GRANT', 'WEB' FROM u UNION ALL SELECT 'APP.P' || k, 'SEQUENCE', 'SQ' FROM u WHERE k % 3 = 0 UNION ALL SELECT 'APP.P' || k, 'BUILTIN', 'DBMS_LOCK.SLEEP' FROM u WHERE k % 3 = 0
UNION ALL SELECT 'APP.P' || k, 'CALL', 'P' || (k + 1) || '✓' FROM u WHERE k + 1 IN (SELECT k FROM u)
""")
def script_targets(t):
    """References listed by kind with a mark and a count (OP-AG-26)."""
    texts = _scripts(t)
    return sqlfolder.referenced(sqlfolder.references(sqlfolder.objects(texts), sqlfolder.grants(texts)))


# Quality rules

_MODES = f"m AS (SELECT {_MODE} AS mode, s FROM u)"


@query(f"""
WITH {_UNITS}, {_MODES}
SELECT 'ERROR' AS level, 'SOURCE_ORPHAN' AS code, 1::BIGINT AS n, 'A.GHOST' AS least
UNION ALL SELECT 'WARN', 'INVALID_STATUS', count(*), min(o || '.P' || k) FROM u WHERE s = 17 HAVING count(*) > 0
UNION ALL SELECT 'WARN', 'NAME_COLLISION', count(*), min('P' || k || ' A;B') FROM u WHERE k % 10 = 0 HAVING count(*) > 0
UNION ALL SELECT 'WARN', 'WRAP_SOURCE_PRESENT', count(*), min(o || '.P' || k) FROM u WHERE s % 11 = 0 HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'LARGE_FIELD_INLINED', count(*), min('TR' || k) FROM u WHERE k % 50 = 0 HAVING count(*) > 0
UNION ALL SELECT 'WARN', 'DEPENDENCY_REFERENCED_NOT_IN_OBJECTS', count(DISTINCT k % 7), min('A.T' || (k % 7)) FROM u
UNION ALL SELECT 'WARN', 'REMOTE_OBJECTS_NOT_PROVIDED', 1, 'LNK'
UNION ALL SELECT 'ERROR', 'OVERRIDE_REASON_MISSING', 1, 's4_strategy_override ' || count(*) FROM u WHERE k % 9 = 0 HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'OVERRIDE_SP_ID_UNKNOWN', count(*), min('s4_strategy_override A.NO' || k) FROM u WHERE k % 9 = 1 HAVING count(*) > 0
UNION ALL SELECT 'WARN', 'PARSER_SUCCESS_RATE_LOW', 1, round(avg((mode = 'REGEX')::INT), 3)::VARCHAR FROM m HAVING avg((mode = 'REGEX')::INT) < 0.9
UNION ALL SELECT 'INFO', 'CALIBRATION_SAMPLES_INSUFFICIENT', 1, '3'
UNION ALL SELECT 'ERROR', 'BODY_FILE_MISSING', count(*), min('j' || k || '.sql') FROM u WHERE k % 20 = 5 HAVING count(*) > 0
""")
def quality_findings(t):
    """Validation rules over dictionary and override tables (section 2.12, OP-FLT-11, OP-FLT-12, OP-AG-03)."""
    d = _dictionary(t)
    p = t("part").selectExpr("p_partkey as k", "p_size as s", "if(p_partkey % 2 = 0, 'A', 'B') as o", "'P' || p_partkey as name")
    spark = p.sparkSession
    none = F.lit(None).cast("string")
    inv = _inventory(d)
    more = p.where("k % 10 = 0").select(F.expr("if(o = 'A', 'B', 'A')").alias("OWNER"), F.col("name").alias("OBJECT_NAME"), F.lit("FUNCTION").alias("OBJECT_TYPE"), F.lit("VALID").alias("STATUS"), none.alias("CREATED"), none.alias("LAST_DDL_TIME"))
    ghost = spark.createDataFrame([("A", "GHOST", "PROCEDURE", 1, "x")], d["in_source"].schema)
    d |= {"in_objects": d["in_objects"].unionByName(more), "in_source": d["in_source"].unionByName(ghost), "in_db_links": spark.createDataFrame([("A", "LNK", None, None), ("A", "FAR", None, None)], INPUTS["in_db_links"].schema)}
    d["in_triggers"] = p.where("k % 50 = 0").select(F.lit("A").alias("OWNER"), F.expr("'TR' || k").alias("TRIGGER_NAME"), F.lit("A").alias("TABLE_OWNER"), F.lit("T").alias("TABLE_NAME"), F.lit("ENABLED").alias("STATUS"), F.repeat(F.lit("b"), 501).alias("BODY_FILE"))
    d["in_scheduler_jobs"] = p.where("k % 20 in (5, 6)").select(F.lit("A").alias("OWNER"), F.expr("'J' || k").alias("JOB_NAME"), F.lit("PLSQL").alias("JOB_TYPE"), F.expr("'j' || k || '.sql'").alias("ACTION_FILE"), F.lit("Y").alias("ENABLED"), none.alias("SCHEDULE_TEXT"))
    remote = spark.createDataFrame([("FAR", "A", "X", "TABLE")], "DB_LINK string, OWNER string, OBJECT_NAME string, OBJECT_TYPE string")
    strategy = p.where("k % 9 in (0, 1)").select(F.expr("if(k % 9 = 1, 'A.NO' || k, o || '.P' || k)").alias("SP_ID"), F.lit("SEMI").alias("STRATEGY"), F.expr("if(k % 9 = 0, ' ', 'seen')").alias("REASON"))
    pilot = spark.createDataFrame([("x", 1.0)] * 3, "SP_ID string, ACTUAL_MD double").withColumnRenamed("SP_ID", "UNIT")
    found = checks.validate(d, {"s4_strategy_override": strategy, "pilot_effort": pilot}, remote, inv, metrics.metrics(d, inv))
    present = p.where("k % 20 = 6").select(F.expr("'j' || k || '.sql'").alias("path"))
    found = found.unionByName(checks.missing_bodies(d, present))
    # An unknown id's message has no id of its own to compare but the rule's name and the id's place.
    return found.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("least"))


_LINTED = "o AS (SELECT 'U' || (c_custkey % 300) AS id, c_mktsegment AS v, CASE WHEN c_nationkey % 2 = 0 THEN 'EXCLUDE' ELSE 'include' END AS act, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'seen' END AS r FROM customer)"


@query(f"""
WITH {_LINTED}
SELECT 'ERROR' AS level, 'REASON_BLANK' AS code, 2 * count(*) AS n FROM o WHERE r = ' ' HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'CONFLICTING_STRATEGY', count(*) FROM (SELECT id FROM o GROUP BY id HAVING count(DISTINCT v) > 1) HAVING count(*) > 0
UNION ALL SELECT 'ERROR', 'CONFLICTING_ACTION', count(*) FROM (SELECT id FROM o GROUP BY id HAVING count(DISTINCT act) > 1) HAVING count(*) > 0
UNION ALL SELECT 'WARN', 'DUPLICATE_ROW', count(*) FROM (SELECT *, count(*) OVER (PARTITION BY id, act) AS k FROM o) WHERE k > 1 HAVING count(*) > 0
""")
def override_lint(t):
    """Lint of override tables (section 2.12, OP-AG-15, OP-AG-17)."""
    o = t("customer").selectExpr("'U' || (c_custkey % 300) as SP_ID", "c_mktsegment as STRATEGY", "if(c_nationkey % 2 = 0, 'EXCLUDE', 'include') as ACTION", "if(c_custkey % 7 = 0, ' ', 'seen') as REASON")
    found = checks.lint({"s4_strategy_override": o.select("SP_ID", "STRATEGY", "REASON"), "s1_inventory_override": o.select("SP_ID", "ACTION", "REASON")})
    return found.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_UNITS}, {_MODES}, r AS (
  SELECT 'SP-1' AS spike, avg((mode = 'REGEX')::INT) AS rate, 0.9 AS least FROM m
  UNION ALL SELECT 'SP-2', count(*) FILTER (WHERE s % 4 = 0) / nullif(count(*) FILTER (WHERE s % 4 < 2), 0), 0.6 FROM m
  UNION ALL SELECT 'SP-3', avg((o_orderstatus <> 'P')::INT), 0.7 FROM orders)
SELECT spike, round(rate, 6) AS rate, CASE WHEN rate IS NULL THEN 'N/A' WHEN rate >= least THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r
""")
def spike_rates(t):
    """Success rates against thresholds, N/A without rows (SP-1 to SP-3, OP-AG-18)."""
    p = t("part").selectExpr("case when p_size % 11 = 0 then 'SKIPPED' when p_size % 13 = 0 then 'PARTIAL' else 'REGEX' end as PARSE_MODE", "int(p_size % 4 = 0) as DYNAMIC_SQL_LITERAL", "int(p_size % 4 = 1) as DYNAMIC_SQL_VARIABLE")
    return checks.spikes(p, t("orders").selectExpr("if(o_orderstatus <> 'P', 'SP', 'UNKNOWN') as DST_TYPE"))


# Review and risks: edges of each supplier, some weak, some without rights, some remote.


def _drawn_graph(t) -> dict[str, DataFrame]:
    s = t("supplier").selectExpr("s_suppkey as k")
    edges = s.where("k % 3 <> 0").selectExpr(
        "'U' || k as SRC", "if(k % 6 = 1, concat('REMOTE::HR.O', k % 4, '@L'), 'X' || (k % 10)) as DST", "if(k % 5 = 0, 'LOW', 'HIGH') as EDGE_CONFIDENCE", "if(k % 4 = 0, 'N', 'Y') as GRANT_OK", "if(k % 6 = 1, 'Y', 'N') as CUT_POINT",
        "if(k % 7 = 0, 'OVERRIDE', 'CALL') as EDGE_TYPE", "'SP' as SRC_TYPE", "if(k % 6 = 1, 'REMOTE', 'UNKNOWN') as DST_TYPE",
    )
    nodes = s.selectExpr("'U' || k as NODE_ID", "if(k % 8 = 0, 'TRIGGER', 'SP') as NODE_TYPE", "k % 9 as CLUSTER_ID")
    return {"s3_edges": edges, "s3_nodes": nodes, "s3_scc": s.where("k % 2 = 0").selectExpr("k % 30 as SCC_ID", "'U' || k as MEMBER_SP_ID"), "units": s.selectExpr("'U' || k as SP_ID", "if(k % 8 = 0, 'TRIGGER', 'PROCEDURE') as TYPE", "k")}


_DRAWN = """u AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT k, 'U' || k AS src, CASE WHEN k % 6 = 1 THEN 'REMOTE::HR.O' || (k % 4) || '@L' ELSE 'X' || (k % 10) END AS dst FROM u WHERE k % 3 <> 0),
big AS (SELECT k % 30 AS id, count(*) AS n FROM u WHERE k % 2 = 0 GROUP BY 1 HAVING count(*) > 3)"""


@query(f"""
WITH {_DRAWN}
SELECT 'LOW_CONFIDENCE_EDGE' AS code, src AS subject, dst AS detail FROM e WHERE k % 5 = 0 UNION ALL SELECT 'GRANT_MISSING', src, dst FROM e WHERE k % 4 = 0
UNION ALL SELECT 'ORPHAN_NODE', 'U' || k, '' FROM u WHERE k % 3 = 0 UNION ALL SELECT 'LARGE_SCC', id::VARCHAR, n::VARCHAR FROM big
""")
def graph_review(t):
    """What people must look at in the graph (OP-GR-09)."""
    g = _drawn_graph(t)
    return depgraph.review(g["s3_edges"], g["s3_nodes"], g["s3_scc"]).select(F.col("REASON_CODE").alias("code"), F.col("SUBJECT").alias("subject"), F.col("DETAIL").alias("detail"))


@query(f"""
WITH {_DRAWN}, n AS (SELECT 'U' || k AS node, CASE WHEN k % 8 = 0 THEN 'TRIGGER' ELSE 'SP' END AS kind, 0 AS o FROM u
  UNION ALL SELECT src, 'SP', 1 FROM e WHERE k % 7 <> 0 UNION ALL SELECT dst, CASE WHEN k % 6 = 1 THEN 'REMOTE' ELSE 'UNKNOWN' END, 2 FROM e WHERE k % 7 <> 0)
SELECT node, arg_min(kind, o) AS kind FROM n GROUP BY node
""")
def node_types(t):
    """Nodes by precedence: units, then the ends of edges (OP-GR-03)."""
    g = _drawn_graph(t)
    return depgraph.node_types(g["units"], g["s3_edges"]).select("node", F.col("NODE_TYPE").alias("kind"))


@query(f"""
WITH {_DRAWN}
SELECT 'WRAPPED' AS risk, 'U' || k AS subject FROM u WHERE k % 11 = 0 UNION ALL SELECT 'AUTONOMOUS_TX', 'U' || k FROM u WHERE k % 13 = 0 UNION ALL SELECT 'MUTATING_TRIGGER', 'U' || k FROM u WHERE k % 17 = 0
UNION ALL SELECT 'LARGE_SCC', id::VARCHAR FROM big UNION ALL SELECT 'WEAK_CLUSTER', (k % 9)::VARCHAR FROM e WHERE k % 5 = 0 GROUP BY k % 9 HAVING count(*) >= 2
UNION ALL SELECT 'PII_ARGUMENT', 'P_EMAIL' || (k % 3) FROM u WHERE k % 2 = 0 GROUP BY 2
""")
def risk_register(t):
    """The risk register (OP-AG-13, OP-AG-14, OP-FLT-11)."""
    g = _drawn_graph(t)
    unit = g["units"].selectExpr("SP_ID", "if(k % 11 = 0, 'Y', 'N') as WRAPPED", "int(k % 13 = 0) as AUTONOMOUS_TX", "int(k % 17 = 0) as MUTATING_TRIGGER_RISK", "if(k % 2 = 0, 'p_email' || (k % 3), 'p_size') as ARGUMENT_NAME")
    return scoring.risks(unit, unit, g, unit).select(F.col("RISK").alias("risk"), F.col("SUBJECT").alias("subject"))


@query(f"""
WITH {_DRAWN} SELECT src AS sp_id, dst AS target, CASE k % 4 WHEN 0 THEN 'replicate or read by API' WHEN 1 THEN 'replace by API' WHEN 2 THEN 'call a service' ELSE 'decide by hand' END AS advice FROM e WHERE k % 6 = 1
""")
def cut_point_advice(t):
    """Remote keys read and matched to advice by type (OP-TX-31)."""
    g = _drawn_graph(t)
    kinds = g["units"].sparkSession.createDataFrame([("L", "HR", "O0", "TABLE"), ("L", "HR", "O1", "VIEW"), ("L", "HR", "O2", "FUNCTION")], "DB_LINK string, OWNER string, OBJECT_NAME string, OBJECT_TYPE string")
    return scoring.cut_points(g["s3_edges"], kinds).select(F.col("SP_ID").alias("sp_id"), F.col("TARGET").alias("target"), F.col("SUGGESTION").alias("advice"))


@query(f"WITH {_UNITS} SELECT id AS sp_id, CASE WHEN s % 11 = 0 THEN 'WRAPPED' ELSE 'UNBALANCED_BLOCK' END AS reason FROM u WHERE s % 11 = 0 OR s % 13 = 0")
def parse_failures(t):
    """Units that were not parsed (stage 2)."""
    d = _dictionary(t)
    return metrics.parse_failures(metrics.metrics(d, _inventory(d))).select(F.col("SP_ID").alias("sp_id"), F.col("REASON").alias("reason"))
