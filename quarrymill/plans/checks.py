"""Validation, override lint, spikes and snapshot differences; each gives findings or rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.operators import relational as rel
from quarrymill.schemas import INPUTS, OVERRIDES
from quarrymill.sources import files

#: Differences of the scores look at these columns only.
DIFF_COLUMNS = {"s4_scores": ["STRATEGY", "QUADRANT", "EFFORT_EST_MD"]}
# Thresholds of the spikes.
SPIKES = {"SP-1": 0.90, "SP-2": 0.60, "SP-3": 0.70}


def _rows(df: DataFrame, level: str, code: str, message: F.Column) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.cast("string").alias("message"))


def presence(spark: SparkSession, folder: str) -> DataFrame:
    """MISSING_FILE, OPTIONAL_ABSENT and SCHEMA_MISMATCH by the files' headers."""
    out = []
    for c in INPUTS.values():
        have = files.headers(spark, f"{folder}/{c.name}.csv")
        lost = [n for n, _ in c.columns if n not in have]
        if not have:
            out.append(("ERROR", "MISSING_FILE", c.name) if c.required else ("INFO", "OPTIONAL_ABSENT", c.name))
        elif lost:
            out.append(("ERROR", "SCHEMA_MISMATCH", f"{c.name}: {', '.join(lost)}"))
    return spark.createDataFrame(out, "level string, code string, message string")


def validate(t: dict[str, DataFrame], overrides: dict[str, DataFrame], remote: DataFrame, inventory: DataFrame | None = None, parsed: DataFrame | None = None, target: float = 0.9, pilot_least: int = 30) -> DataFrame:
    """(level, code, message) of all table rules."""
    o, s, d = t["in_objects"], t["in_source"], t["in_dependencies"]
    name = lambda a, b: F.concat_ws(".", a, b)
    keys = o.select("OWNER", F.col("OBJECT_NAME").alias("NAME"))
    parts = [
        _rows(rel.anti(s.select("OWNER", "NAME").distinct(), keys, ["OWNER", "NAME"]), "ERROR", "SOURCE_ORPHAN", name("OWNER", "NAME")),
        _rows(o.where("STATUS = 'INVALID'"), "WARN", "INVALID_STATUS", name("OWNER", "OBJECT_NAME")),
        _rows(rel.collisions(o.where("OBJECT_TYPE <> 'PACKAGE'"), ["OBJECT_NAME"], "OWNER"), "WARN", "NAME_COLLISION", F.concat_ws(" ", "OBJECT_NAME", "value_list")),
        _rows(s.where((F.col("LINE") == 1) & F.upper("TEXT").contains("WRAPPED")), "WARN", "WRAP_SOURCE_PRESENT", name("OWNER", "NAME")),
        _rows(t["in_triggers"].where(F.length("BODY_FILE") > 500), "ERROR", "LARGE_FIELD_INLINED", F.col("TRIGGER_NAME")),
        _rows(t["in_scheduler_jobs"].where(F.length("ACTION_FILE") > 500), "ERROR", "LARGE_FIELD_INLINED", F.col("JOB_NAME")),
        _rows(rel.anti(d.where(tx.clean_str("REFERENCED_LINK_NAME") == "").select(F.col("REFERENCED_OWNER").alias("OWNER"), F.col("REFERENCED_NAME").alias("NAME")).distinct(), keys, ["OWNER", "NAME"]), "WARN", "DEPENDENCY_REFERENCED_NOT_IN_OBJECTS", name("OWNER", "NAME")),
        _rows(rel.anti(t["in_db_links"].select("DB_LINK"), remote, ["DB_LINK"]), "WARN", "REMOTE_OBJECTS_NOT_PROVIDED", F.col("DB_LINK")),
    ]
    parts += [_rows(df.where(tx.clean_str("REASON") == "").agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "ERROR", "OVERRIDE_REASON_MISSING", F.concat_ws(" ", F.lit(k), F.col("n").cast("string"))) for k, df in overrides.items() if "REASON" in df.columns]
    if inventory is not None:
        for k, df in overrides.items():
            for c in (c for c in ("SP_ID", "SRC_SP_ID", "SRC", "DST") if c in df.columns):
                ids = df.select(F.col(c).alias("SP_ID")).where("SP_ID is not null and not SP_ID rlike '^(TABLE|REMOTE|APP|JOB|UNKNOWN)::'").distinct()
                parts.append(_rows(rel.anti(ids, inventory, ["SP_ID"]), "ERROR", "OVERRIDE_SP_ID_UNKNOWN", F.concat_ws(" ", F.lit(k), "SP_ID")))
    if parsed is not None:
        rate = parsed.agg(F.try_divide(F.count_if(F.col("PARSE_MODE").isin("AST", "REGEX")), F.count(F.lit(1))).alias("r")).where(F.col("r") < target)
        parts.append(_rows(rate, "WARN", "PARSER_SUCCESS_RATE_LOW", F.round("r", 3)))
    if "pilot_effort" in overrides:
        parts.append(_rows(overrides["pilot_effort"].agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < pilot_least), "INFO", "CALIBRATION_SAMPLES_INSUFFICIENT", F.col("n")))
    return reduce(DataFrame.unionByName, parts)


def missing_bodies(t: dict[str, DataFrame], present: DataFrame) -> DataFrame:
    """BODY_FILE_MISSING: files that triggers and jobs name but the folder lacks (present: path)."""
    named = t["in_triggers"].select(F.col("BODY_FILE").alias("path")).unionByName(t["in_scheduler_jobs"].select(F.col("ACTION_FILE").alias("path")))
    named = named.where((tx.clean_str("path") != "") & (F.length("path") <= 255)).distinct()
    return _rows(rel.anti(named, present, ["path"]), "ERROR", "BODY_FILE_MISSING", F.col("path"))


def lint(o: dict[str, DataFrame]) -> DataFrame:
    """Blank reasons, contradictions and repeated rows of the override tables."""
    rules = [
        ("s2_metrics_override", ["SP_ID", "METRIC_NAME"], "VALUE", "CONFLICTING_VALUE"), ("s2_dynsql_resolve", ["SRC_SP_ID"], "RESOLVED_TABLES", "CONFLICTING_RESOLUTION"),
        ("s3_cluster_override", ["SP_ID"], "CLUSTER_ID", "CONFLICTING_CLUSTER"), ("s4_strategy_override", ["SP_ID"], "STRATEGY", "CONFLICTING_STRATEGY"), ("pilot_effort", ["SP_ID"], "ACTUAL_MD", "CONFLICTING_PILOT_SAMPLE"),
    ]
    parts = [_rows(df.where(tx.clean_str("REASON") == ""), "ERROR", "REASON_BLANK", F.concat_ws(" ", F.lit(k), F.col(df.columns[0]))) for k, df in o.items() if "REASON" in df.columns]
    parts += [_rows(rel.collisions(o[k], keys, value), "ERROR", code, F.concat_ws(" ", *keys, "value_list")) for k, keys, value, code in rules if k in o]
    for k, keys, acts in (("s1_inventory_override", ["SP_ID"], ["EXCLUDE", "INCLUDE"]), ("s3_edges_override", ["SRC", "DST"], ["ADD", "REMOVE"])):
        if k in o:
            parts.append(_rows(rel.containing(o[k].withColumn("A", F.upper("ACTION")), keys, "A", acts), "ERROR", "CONFLICTING_ACTION", F.concat_ws(" ", *keys)))
    if "s1_inventory_override" in o:
        parts.append(_rows(rel.repeated_rows(o["s1_inventory_override"], ["SP_ID", "ACTION"]), "WARN", "DUPLICATE_ROW", F.col("SP_ID")))
    return reduce(DataFrame.unionByName, parts)


def spikes(metrics: DataFrame, app_edges: DataFrame) -> DataFrame:
    """(spike, rate, verdict): parsed units, literal dynamic statements, matched application calls."""
    lit, var = F.sum("DYNAMIC_SQL_LITERAL"), F.sum("DYNAMIC_SQL_VARIABLE")
    a = metrics.agg(F.try_divide(F.count_if(F.col("PARSE_MODE").isin("AST", "REGEX")), F.count(F.lit(1))).alias("SP-1"), F.try_divide(lit, lit + var).alias("SP-2"))
    b = app_edges.agg(F.try_divide(F.count_if(F.col("DST_TYPE") == "SP"), F.count(F.lit(1))).alias("SP-3"))
    cells = F.array(*(F.struct(F.lit(k).alias("spike"), F.col(f"`{k}`").alias("rate"), F.lit(v).alias("least")) for k, v in SPIKES.items()))
    rows = a.join(F.broadcast(b)).select(F.explode(cells).alias("c")).select("c.*")  # one row each
    return rows.select("spike", F.round("rate", 6).alias("rate"), F.when(F.col("rate").isNull(), "N/A").when(F.col("rate") >= F.col("least"), "PASS").otherwise("FAIL").alias("verdict"))


def diff(spark: SparkSession, path: str, stage: str, old: str, new: str, key: str = "SP_ID") -> DataFrame:
    """Differences of two snapshots of a stage's table."""
    if stage not in (*DIFF_COLUMNS, "s1_inventory", "s2_metrics", "s3_nodes"):
        raise ValueError(f"unknown stage {stage}")
    a, b = files.read_snapshot(spark, path, old), files.read_snapshot(spark, path, new)
    if stage == "s3_nodes":
        a, b = (x.where(F.col("NODE_TYPE").isin("SP", "TRIGGER")).withColumnRenamed("NODE_ID", key) for x in (a, b))
    return rel.snapshot_diff(a, b, key, DIFF_COLUMNS.get(stage) or [c for c in a.columns if c != key and c in b.columns])


__all__ = ["OVERRIDES", "diff", "lint", "missing_bodies", "presence", "spikes", "validate"]
