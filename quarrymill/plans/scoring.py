"""Stage 4: difficulty and complexity scores, strategy, effort; and stage 5's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.config import Pipeline
from quarrymill.functions import text as tx
from quarrymill.operators import patch as pt
from quarrymill.operators import rank as rk
from quarrymill.operators import relational as rel
from quarrymill.operators import stats as st
from quarrymill.operators.graph import checkpointed

# Strategies from the least to the greatest, with base effort in man-days.
STRATEGIES = {"AUTO_SIMPLE": 0.5, "AUTO_ASSISTED": 1.5, "SEMI": 3.0, "MANUAL": 5.0, "DEFER": 8.0}
TABLE_EDGES = ("REF_TABLE", "DYNAMIC_SQL_LITERAL", "DYNAMIC_SQL_RESOLVED")
# What to do about a remote object, by its type.
REMOTE_ADVICE = {"TABLE": "replicate or read by API", "VIEW": "replace by API", "MATERIALIZED VIEW": "replicate", "PROCEDURE": "call a service", "FUNCTION": "call a service", "PACKAGE": "call a service"}
PII = ("SSN", "RRN", "JUMIN", "PHONE", "MOBILE", "EMAIL", "ADDR", "PASSWORD", "CARD")


def dependency_features(inventory: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Eight counts of edges of each unit."""
    typed = edges.join(nodes.select(F.col("NODE_ID").alias("SRC"), F.col("NODE_TYPE").alias("ST")), "SRC", "left")
    call = F.col("EDGE_TYPE") == "CALL"
    out = typed.groupBy(F.col("SRC").alias("SP_ID")).agg(F.count_if(F.col("EDGE_TYPE").isin(*TABLE_EDGES)).alias("REF_TABLE"), F.count_if(call).alias("FANOUT_SP"), F.count_if(F.col("EDGE_TYPE") == "REMOTE_REF").alias("DB_LINK"))
    into = typed.groupBy(F.col("DST").alias("SP_ID")).agg(
        F.count_if(call & (F.col("ST") == "SP")).alias("FANIN_SP"), F.count_if(F.col("EDGE_TYPE") == "APP_CALL").alias("FANIN_APP"), F.count_if(call & (F.col("ST") == "TRIGGER")).alias("TRIGGER_CALLER"), F.count_if(F.col("EDGE_TYPE") == "JOB_CALL").alias("SCHEDULER_CALLER"),
    )
    base = inventory.select("SP_ID", (F.col("CROSS_SCHEMA_CALLABLE") == "Y").cast("long").alias("CROSS_SCHEMA_GRANT"))
    base = rel.lookup_default(base, out, ["SP_ID"], {"REF_TABLE": 0, "FANOUT_SP": 0, "DB_LINK": 0})
    return rel.lookup_default(base, into, ["SP_ID"], {"FANIN_SP": 0, "FANIN_APP": 0, "TRIGGER_CALLER": 0, "SCHEDULER_CALLER": 0})


def complexity_features(metrics: DataFrame) -> DataFrame:
    cursor = F.col("CURSOR_EXPLICIT") + F.col("CURSOR_FORLOOP") + F.col("CURSOR_REF")
    names = "LOC BRANCH REF_CURSOR_OUT DYNAMIC_SQL_LITERAL DYNAMIC_SQL_VARIABLE TX_CONTROL AUTONOMOUS_TX ORACLE_FEATURE OUT_PARAM EXCEPTION_HANDLER GLOBAL_PKG_VAR MUTATING_TRIGGER_RISK".split()
    return metrics.select("SP_ID", *names, cursor.alias("CURSOR"), F.col("DB_LINK").alias("SRC_DB_LINK"))


def strategy(config: Pipeline) -> F.Column:
    """The classifier: the first case that holds."""
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("AUTONOMOUS_TX", "SRC_DB_LINK", "MUTATING_TRIGGER_RISK", "LOC", "BRANCH", "CURSOR", "DYNAMIC_SQL_LITERAL", "DYNAMIC_SQL_VARIABLE")}
    s, a = ({k: v or 0 for k, v in x.items()} for x in (config.simple_limits, config.assisted_limits))
    hard = (F.col("D_SCORE") >= config.d_threshold) & (F.col("C_SCORE") >= config.c_threshold)
    defer = (c["AUTONOMOUS_TX"] >= 1) | (c["SRC_DB_LINK"] >= 2) | (c["MUTATING_TRIGGER_RISK"] >= 1) | hard
    simple = (c["LOC"] <= s["loc"]) & (c["BRANCH"] <= s["branch"]) & (c["CURSOR"] <= s["cursor"]) & (c["DYNAMIC_SQL_LITERAL"] + c["DYNAMIC_SQL_VARIABLE"] == 0) & (c["SRC_DB_LINK"] == 0)
    assisted = (c["LOC"] <= a["loc"]) & (c["BRANCH"] <= a["branch"]) & (c["CURSOR"] <= a["cursor"]) & (c["DYNAMIC_SQL_LITERAL"] <= a["dynamic_sql_literal"]) & (c["DYNAMIC_SQL_VARIABLE"] == 0) & (c["SRC_DB_LINK"] == 0)
    return F.when(defer, "DEFER").when(simple, "AUTO_SIMPLE").when(assisted, "AUTO_ASSISTED").when(c["CURSOR"] > 0, "SEMI").otherwise("MANUAL")


def classified(rows: DataFrame, config: Pipeline) -> DataFrame:
    """rows (D_SCORE, C_SCORE and the features) with QUADRANT, STRATEGY, IS_BOUNDARY and the base effort."""
    high_d, high_c = F.col("D_SCORE") >= config.d_threshold, F.col("C_SCORE") >= config.c_threshold
    near = (F.abs(F.col("D_SCORE") - config.d_threshold) <= config.boundary_band) | (F.abs(F.col("C_SCORE") - config.c_threshold) <= config.boundary_band)
    rows = rows.withColumns({"QUADRANT": F.when(high_d & high_c, "Q4").when(high_d, "Q3").when(high_c, "Q2").otherwise("Q1"), "STRATEGY": strategy(config), "IS_BOUNDARY": near})
    base = F.create_map(*(F.lit(x) for kv in STRATEGIES.items() for x in kv))[F.col("STRATEGY")]
    rows = rows.withColumn("EFFORT_EST_MD", tx.round2(base * (1 + F.col("C_SCORE") / 100)))
    return rows.withColumns({"EFFORT_P50": F.col("EFFORT_EST_MD"), "EFFORT_P90": tx.round2(F.col("EFFORT_EST_MD") * 1.5), "CONFIDENCE": F.lit("LOW")})


def _known(wide: DataFrame, pilot: DataFrame) -> DataFrame:
    """wide with the mean ACTUAL_MD of each unit that the pilot has."""
    return wide.join(pilot.where("ACTUAL_MD is not null").groupBy("SP_ID").agg(F.avg("ACTUAL_MD").alias("ACTUAL_MD")), "SP_ID")


def diagnostics(inventory: DataFrame, metrics: DataFrame, graph: dict[str, DataFrame], config: Pipeline, pilot: DataFrame) -> dict | None:
    """s4_weight_suggestion: the model, its samples, variance inflation and the coefficients of the
    standardised features; none below the least samples."""
    used = [*config.dependency, *config.complexity]
    features = dependency_features(inventory, graph["s3_edges"], graph["s3_nodes"]).join(complexity_features(metrics), "SP_ID")
    known = checkpointed(_known(features.select("SP_ID", *(F.col(f).cast("double").alias(f) for f in used)), pilot))
    if (n := known.count()) < config.min_samples:
        return None
    scaled = st.standardise(known, used)
    _, weights = st.linear(scaled, "ACTUAL_MD", used, config.model, config.alpha)
    return {"model": config.model, "samples": n, "vif": st.vif(scaled, used), "weight_suggestion": {f: round(w, 4) for f, w in zip(used, weights, strict=True)}}


def scores(inventory: DataFrame, metrics: DataFrame, graph: dict[str, DataFrame], config: Pipeline, pilot: DataFrame | None = None, override: DataFrame | None = None) -> DataFrame:
    """s4_scores.  Effort is estimated before components are promoted and overrides apply."""
    dep, com = dependency_features(inventory, graph["s3_edges"], graph["s3_nodes"]), complexity_features(metrics)
    features = checkpointed(dep.join(com, "SP_ID"))
    dep, com = features.select(dep.columns), features.select(com.columns)
    d = rk.weighted_composite(rk.percentile_ranks(rk.long_form(dep, "SP_ID", list(config.dependency)), "SP_ID"), "SP_ID", config.dependency, "D_SCORE")
    c = rk.weighted_composite(rk.percentile_ranks(rk.long_form(com, "SP_ID", list(config.complexity)), "SP_ID"), "SP_ID", config.complexity, "C_SCORE")
    rows = features.join(d, "SP_ID").join(c, "SP_ID").withColumns({"D_SCORE": tx.round2(F.col("D_SCORE")), "C_SCORE": tx.round2(F.col("C_SCORE"))})
    rows = classified(rows, config)
    if pilot is not None:
        used = [*config.dependency, *config.complexity]
        wide = rows.select("SP_ID", *(F.col(f).cast("double").alias(f) for f in used))
        known = _known(wide, pilot)
        if known.count() >= config.min_samples:
            p = st.bootstrap(wide, known, "SP_ID", "ACTUAL_MD", used, config.model, config.alpha, seed=config.random_seed)
            rows = rows.drop("EFFORT_EST_MD", "EFFORT_P50", "EFFORT_P90", "CONFIDENCE").join(p, "SP_ID")
            rows = rows.withColumns({"EFFORT_EST_MD": tx.round2(F.col("estimate")), "EFFORT_P50": tx.round2(F.col("p50")), "EFFORT_P90": tx.round2(F.col("p90")), "CONFIDENCE": F.lit("MEDIUM")})
    members = graph["s3_scc"].select(F.col("MEMBER_SP_ID").alias("SP_ID"), F.col("SCC_ID"))
    grouped = rows.join(members, "SP_ID", "left").withColumn("g", F.coalesce(F.concat(F.lit("scc "), F.col("SCC_ID").cast("string")), F.concat(F.lit("one "), F.col("SP_ID"))))
    rows = rel.promote(grouped, "g", "STRATEGY", list(STRATEGIES)).withColumnRenamed("promoted", "PROMOTED")
    place = graph["s3_nodes"].where(F.col("NODE_TYPE").isin("SP", "TRIGGER")).select(F.col("NODE_ID").alias("SP_ID"), "WAVE_NO", "CLUSTER_ID")
    rows = rows.join(place, "SP_ID", "left")
    if override is not None:
        rows = pt.replace(rows, override, "SP_ID", {"STRATEGY": "STRATEGY", "QUADRANT": "QUADRANT", "EFFORT_EST_MD": "EFFORT_MD"})
    return rows.select("SP_ID", "D_SCORE", "C_SCORE", "QUADRANT", "STRATEGY", "WAVE_NO", "CLUSTER_ID", "EFFORT_EST_MD", "EFFORT_P50", "EFFORT_P90", "CONFIDENCE", "IS_BOUNDARY", "PROMOTED")


def score_review(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    row = lambda df, code, detail: df.select("SP_ID", F.lit(code).alias("REASON_CODE"), detail.alias("DETAIL"))
    out = row(rows.where("IS_BOUNDARY"), "BOUNDARY", F.concat_ws("/", F.col("D_SCORE").cast("string"), F.col("C_SCORE").cast("string")))
    out = out.unionByName(row(metrics.where("PARSE_MODE <> 'AST'"), "PARSE_MODE_NOT_AST", F.col("PARSE_MODE")))
    return out.unionByName(row(rows.where("PROMOTED"), "SCC_STRATEGY_PROMOTED", F.col("STRATEGY"))).unionByName(row(rows.where("STRATEGY = 'DEFER'"), "DEFER_AUTO_CLASSIFIED", F.lit("")))


def roadmap(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Units of each wave and cluster, with their database link cut points."""
    cuts = edges.where("CUT_POINT = 'Y'").groupBy(F.col("SRC").alias("SP_ID")).agg(F.count(F.lit(1)).alias("cuts"))
    j = rel.lookup_default(rows.where("WAVE_NO is not null and CLUSTER_ID is not null"), cuts, ["SP_ID"], {"cuts": 0})
    out = j.groupBy("WAVE_NO", "CLUSTER_ID").agg(F.count(F.lit(1)).alias("SP_COUNT"), rel.joined_list("SP_ID").alias("SP_IDS"), F.sum("cuts").alias("DBLINK_CUTPOINT_COUNT"))
    before = F.when(F.col("WAVE_NO") > 0, F.concat(F.lit("wave "), (F.col("WAVE_NO") - 1).cast("string"))).otherwise("")
    return out.select("WAVE_NO", "CLUSTER_ID", "SP_COUNT", "SP_IDS", before.alias("PRECONDITION"), "DBLINK_CUTPOINT_COUNT").orderBy("WAVE_NO", "CLUSTER_ID")


def overridden(overrides: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """SP_ID of every unit that an override names, once."""
    parts = [df.select(F.col(c).cast("string").alias("SP_ID")) for k, df in overrides.items() if k != "pilot_effort" for c in ("SP_ID", "SRC_SP_ID", "SRC", "DST") if c in df.columns]
    parts.append(spark.createDataFrame([], "SP_ID string"))
    return reduce(DataFrame.unionByName, parts).where("SP_ID is not null").distinct()


def marked(rows: DataFrame, ids: DataFrame, column: str = "SP_ID") -> DataFrame:
    """rows with an asterisk after the ids of overridden units."""
    hit = rows.join(ids.select(F.col("SP_ID").alias(column), F.lit("*").alias("__mark")), column, "left")
    return hit.withColumn(column, F.concat(column, F.coalesce("__mark", F.lit("")))).select(*rows.columns)


def wide_inventory(inventory: DataFrame, metrics: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    return rel.wide_join(inventory, [(metrics, "_S2"), (nodes.withColumnRenamed("NODE_ID", "SP_ID"), "_S3"), (rows, "_S4")], "SP_ID")


def cut_points(edges: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote targets with advice by their type."""
    part = lambda k: F.regexp_extract("DST", r"^REMOTE::(.*)\.([^.@]+)@(.+)$", k)
    e = edges.where("CUT_POINT = 'Y'").select("SRC", "DST", part(1).alias("OWNER"), part(2).alias("OBJECT_NAME"), part(3).alias("DB_LINK"))
    advice = F.create_map(*(F.lit(x) for kv in REMOTE_ADVICE.items() for x in kv))[F.col("OBJECT_TYPE")]
    return e.join(remote, ["DB_LINK", "OWNER", "OBJECT_NAME"], "left").select(F.col("SRC").alias("SP_ID"), F.col("DST").alias("TARGET"), F.coalesce(advice, F.lit("decide by hand")).alias("SUGGESTION"))


def risks(inventory: DataFrame, metrics: DataFrame, graph: dict[str, DataFrame], args: DataFrame) -> DataFrame:
    """(RISK, SUBJECT): the register's rows."""
    row = lambda df, risk, who: df.select(F.lit(risk).alias("RISK"), who.cast("string").alias("SUBJECT"))
    out = row(inventory.where("WRAPPED = 'Y'"), "WRAPPED", F.col("SP_ID")).unionByName(row(metrics.where("AUTONOMOUS_TX > 0"), "AUTONOMOUS_TX", F.col("SP_ID"))).unionByName(row(metrics.where("MUTATING_TRIGGER_RISK > 0"), "MUTATING_TRIGGER", F.col("SP_ID")))
    large = graph["s3_scc"].groupBy("SCC_ID").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    weak = graph["s3_edges"].where("EDGE_CONFIDENCE = 'LOW'").join(graph["s3_nodes"].select(F.col("NODE_ID").alias("SRC"), "CLUSTER_ID"), "SRC").groupBy("CLUSTER_ID").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    name = F.upper("ARGUMENT_NAME")
    pii = args.select("ARGUMENT_NAME").distinct().where(" OR ".join(f"contains(upper(ARGUMENT_NAME), '{p}')" for p in PII))
    return out.unionByName(row(large, "LARGE_SCC", F.col("SCC_ID"))).unionByName(row(weak, "WEAK_CLUSTER", F.col("CLUSTER_ID"))).unionByName(row(pii, "PII_ARGUMENT", name))
