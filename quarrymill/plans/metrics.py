"""Stage 2: static metrics of each unit's body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.functions import text as tx
from quarrymill.operators import patch as pt
from quarrymill.operators import relational as rel
from quarrymill.plans.inventory import target

# Parse modes and their confidence.
CONFIDENCE = {"AST": 0.95, "REGEX": 0.6, "PARTIAL": 0.4, "FAILED": 0.1, "SKIPPED": 0.0}


def bodies(t: dict[str, DataFrame], inventory: DataFrame) -> DataFrame:
    """SP_ID, lines (array of LINE, TEXT), preamble (the package's lines before its first
    subprogram).  A package is cut at its subprograms' heads; of two of a name the last counts."""
    src = t["in_source"].where("LINE is not null").withColumn("TEXT", F.coalesce("TEXT", F.lit("")))
    plain = inventory.where("PKG = ''").select("SP_ID", "OWNER", "NAME", F.col("TYPE")).join(rel.unsized(src), ["OWNER", "NAME", "TYPE"]).select("SP_ID", "LINE", "TEXT")
    gather = lambda df, key, name: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("LINE", "TEXT"))).alias(name))  # noqa: E731  a unit's lines
    pkg = src.where("TYPE = 'PACKAGE BODY'").withColumn("head", F.upper(F.regexp_extract("TEXT", tx.SUBPROGRAM, 1)))
    order = Window.partitionBy("OWNER", "NAME").orderBy("LINE").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("head") != "", F.struct(F.col("LINE").alias("at"), "head"))
    pkg = pkg.withColumn("s", F.last(start, ignorenulls=True).over(order))
    slices = gather(pkg.where("s is not null").select("OWNER", F.col("NAME").alias("PKG"), F.col("s.at").alias("at"), F.col("s.head").alias("NAME"), "LINE", "TEXT"), ["OWNER", "PKG", "at", "NAME"], "lines")
    slices = slices.groupBy("OWNER", "PKG", "NAME").agg(F.max_by("lines", "at").alias("lines"))
    preamble = gather(pkg.where("s is null").select("OWNER", F.col("NAME").alias("PKG"), "LINE", "TEXT"), ["OWNER", "PKG"], "preamble")
    parts = inventory.where("PKG <> ''").select("SP_ID", "OWNER", "PKG", F.upper("NAME").alias("NAME")).join(rel.unsized(slices), ["OWNER", "PKG", "NAME"]).join(rel.unsized(preamble), ["OWNER", "PKG"], "left").select("SP_ID", "lines", "preamble")
    own = gather(plain, ["SP_ID"], "lines").withColumn("preamble", F.lit(None).cast(preamble.schema["preamble"].dataType))
    return own.unionByName(parts)


def _joined(lines: str) -> F.Column:
    return F.array_join(F.transform(F.col(lines), lambda x: x["TEXT"]), "\n")


def metrics(t: dict[str, DataFrame], inventory: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """s2_metrics: a row for each unit."""
    args = t["in_arguments"].select(
        "OWNER", tx.clean_str("PACKAGE_NAME").alias("PKG"), F.upper("OBJECT_NAME").alias("U"), F.coalesce(F.col("OVERLOAD").try_cast("double"), F.lit(0.0)).cast("long").alias("OVERLOAD_NO"),
        F.upper(F.coalesce("IN_OUT", F.lit(""))).contains("OUT").alias("out"), F.upper(F.coalesce("PLS_TYPE", F.lit(""))).contains("CURSOR").alias("cur"),
    )
    args = args.groupBy("OWNER", "PKG", "U", "OVERLOAD_NO").agg(F.count_if("out").alias("OUT_PARAM"), F.count_if(F.col("out") & F.col("cur")).alias("REF_ARGS"))
    own = t["in_triggers"].select("OWNER", F.col("TRIGGER_NAME").alias("NAME"), tx.clean_str("TABLE_NAME").alias("OWN_TABLE")).dropDuplicates(["OWNER", "NAME"])
    rows = inventory.withColumn("U", F.upper("NAME")).join(rel.unsized(args), ["OWNER", "PKG", "U", "OVERLOAD_NO"], "left").join(rel.unsized(own), ["OWNER", "NAME"], "left").join(rel.unsized(bodies(t, inventory)), "SP_ID", "left")
    rows = rows.withColumn("raw", F.coalesce(_joined("lines"), F.lit("")))
    rows = rows.withColumn("nc", tx.strip_comments("raw"))
    rows = rows.withColumn("clean", tx.mask_strings("nc")).withColumn("dyn", tx.dynamic_sql("nc"))
    declared = F.filter(F.transform(F.coalesce("preamble", F.array().cast("array<struct<LINE:bigint,TEXT:string>>")), lambda x: F.upper(F.regexp_extract(x["TEXT"], tx.DECLARED, 1))), lambda v: (v != "") & ~v.isin(*tx.NOT_DECLARED))
    globals_used = F.aggregate(F.array_distinct(declared), F.lit(0).cast("long"), lambda n, v: n + F.coalesce(F.regexp_count(F.upper("clean"), F.concat(F.lit(r"\b"), tx.quoted(v), F.lit(r"\b"))), F.lit(0)))
    later = F.array_join(F.transform(F.slice(F.col("lines"), F.lit(2), F.greatest(F.size("lines"), F.lit(1))), lambda x: x["TEXT"]), "\n")
    mutating = (F.col("TYPE") == "TRIGGER") & (F.coalesce("OWN_TABLE", F.lit("")) != "") & F.coalesce(F.rlike(later, F.concat(F.lit(r"(?i)\b(FROM|UPDATE|INTO)\s+"), tx.quoted(F.col("OWN_TABLE")), F.lit(r"\b"))), F.lit(False))
    mode = F.when(F.col("WRAPPED") == "Y", "SKIPPED").when(F.col("lines").isNull(), "FAILED").when(F.col("clean").rlike(r"(?i)\bBEGIN\b") & F.col("clean").rlike(r"(?i)END\s*[A-Za-z0-9_$#]*\s*;\s*$"), "REGEX").otherwise("PARTIAL")
    counts = {"BRANCH": tx.branch_count("clean"), **{k: tx.count("clean", p) for k, p in tx.CURSORS.items()}}
    counts |= {
        "DYNAMIC_SQL_LITERAL": F.size(F.filter("dyn", lambda d: d["kind"] == "LITERAL")).cast("long"), "DYNAMIC_SQL_VARIABLE": F.size(F.filter("dyn", lambda d: d["kind"] == "VARIABLE")).cast("long"),
        "TX_CONTROL": tx.count("clean", tx.TX_CONTROL), "AUTONOMOUS_TX": F.col("clean").rlike(tx.AUTONOMOUS).cast("long"), **{f"FEATURE_{k}": tx.count("clean", p) for k, p in tx.VENDOR.items()},
        "DB_LINK": tx.count("nc", tx.DB_LINK), "EXCEPTION_HANDLER": tx.count("clean", tx.EXCEPTION), "WHEN_OTHERS": F.col("clean").rlike(tx.WHEN_OTHERS).cast("long"), "GOTO": tx.count("clean", tx.GOTO),
        "GLOBAL_PKG_VAR": globals_used, "MUTATING_TRIGGER_RISK": mutating.cast("long"),
    }
    skipped = F.col("PARSE_MODE").isin("SKIPPED", "FAILED")
    loc = F.size(F.filter(F.coalesce("lines", F.array().cast("array<struct<LINE:bigint,TEXT:string>>")), lambda x: tx.is_code_line(x["TEXT"]))).cast("long")
    out = rows.withColumn("PARSE_MODE", mode).select("SP_ID", loc.alias("LOC"), *(F.when(skipped, 0).otherwise(c).cast("long").alias(k) for k, c in counts.items()), F.coalesce("OUT_PARAM", F.lit(0)).cast("long").alias("OUT_PARAM"), F.coalesce("REF_ARGS", F.lit(0)).cast("long").alias("REF_ARGS"), "PARSE_MODE")
    out = out.withColumn("ORACLE_FEATURE", sum((F.col(f"FEATURE_{k}") for k in tx.VENDOR), F.lit(0).cast("long")))
    out = out.withColumn("REF_CURSOR_OUT", F.when(F.col("REF_ARGS") > 0, F.col("REF_ARGS")).otherwise(F.least("CURSOR_REF", "OUT_PARAM"))).drop("REF_ARGS")
    level = F.lit(0.0)
    for m, v in CONFIDENCE.items():
        level = F.when(F.col("PARSE_MODE") == m, v).otherwise(level)
    out = out.withColumn("PARSE_CONFIDENCE", level)
    if override is not None:
        out = pt.patch_cells(out, override, "SP_ID", [c for c, k in out.dtypes if k in ("bigint", "double")])
    return out


def sql_inventory(t: dict[str, DataFrame], inventory: DataFrame) -> DataFrame:
    """s2_sql_inventory: dynamic statements first, then static ones, numbered from 1."""
    code = bodies(t, inventory.where("WRAPPED = 'N'")).select("SP_ID", tx.strip_comments(_joined("lines")).alias("nc"))
    empty = F.array().cast("array<string>")
    dynamic = F.transform(tx.dynamic_sql("nc"), lambda d: F.struct(tx.unquote_literals(d["expr"]).alias("body"), d["kind"].alias("kind")))
    dynamic = F.transform(dynamic, lambda d: F.struct(F.upper(F.regexp_extract(d["body"], tx.STATEMENT, 1)).alias("dml"), F.when(d["kind"] == "LITERAL", d["body"]).otherwise("").alias("body"), F.lit("Y").alias("dyn"), d["kind"].alias("kind")))
    static = F.transform(tx.statements(tx.mask_strings("nc")), lambda s: F.struct(s["dml"].alias("dml"), s["body"].alias("body"), F.lit("N").alias("dyn"), F.lit("").alias("kind")))
    rows = code.select("SP_ID", F.posexplode(F.concat(dynamic, static)).alias("i", "s"))
    tables = F.coalesce(tx.statement_tables(F.col("s.body"), F.col("s.dml")), empty)
    return rows.select("SP_ID", (F.col("i") + 1).cast("long").alias("STMT_SEQ"), F.col("s.dml").alias("DML_TYPE"), F.array_join(tables, ";").alias("TABLES_RAW"), F.col("s.dyn").alias("IS_DYNAMIC"), F.col("s.kind").alias("DYNAMIC_KIND"))


def dynamic_hints(t: dict[str, DataFrame], inventory: DataFrame, resolve: DataFrame | None = None) -> DataFrame:
    """s2_dynsql_hints: the variable dynamic statements, with tables that people have named."""
    code = bodies(t, inventory.where("WRAPPED = 'N'")).select("SP_ID", tx.strip_comments(_joined("lines")).alias("nc"))
    rows = code.select("SP_ID", F.explode(tx.dynamic_sql("nc")).alias("d")).where("d.kind = 'VARIABLE'")
    rows = rows.select("SP_ID", tx.dynamic_variables(F.col("d.expr")).alias("VARIABLES"), F.substring("d.expr", 1, 200).alias("SNIPPET"), F.lit("").alias("RESOLVED_TABLES"), F.lit("").alias("REASON"))
    return rows if resolve is None else pt.replace(rows, resolve.withColumnRenamed("SRC_SP_ID", "SP_ID"), "SP_ID", {"RESOLVED_TABLES": "RESOLVED_TABLES", "REASON": "REASON"})


def parser_bench(m: DataFrame) -> DataFrame:
    """Counts of parse modes and the share of parsed units.  The share is taken over the counts, a
    row for each mode, so that the units are parsed once."""
    by = m.groupBy("PARSE_MODE").agg(F.count(F.lit(1)).alias("COUNT"))
    every = Window.partitionBy(F.lit(0))
    parsed = F.when(F.col("PARSE_MODE").isin("AST", "REGEX"), F.col("COUNT")).otherwise(0)
    return by.select("PARSE_MODE", "COUNT", F.try_divide(F.sum(parsed).over(every), F.sum("COUNT").over(every)).alias("SUCCESS_RATE"))


def parse_failures(m: DataFrame) -> DataFrame:
    """s2_parse_failures (SP_ID, REASON, DETAIL): wrapped units, units without source, unbalanced blocks."""
    reason = {"SKIPPED": ("WRAPPED", "wrapped source is left out"), "FAILED": ("NO_SOURCE_FOUND", ""), "PARTIAL": ("UNBALANCED_BLOCK", "BEGIN and END don't match")}
    of = lambda k: F.create_map(*(F.lit(x) for mode, v in reason.items() for x in (mode, v[k])))[F.col("PARSE_MODE")]
    return m.where(F.col("PARSE_MODE").isin(*reason)).select("SP_ID", of(0).alias("REASON"), of(1).alias("DETAIL"))


def cursor_profiles(t: dict[str, DataFrame], inventory: DataFrame, m: DataFrame) -> DataFrame:
    """s2_refcursor_profiles: the cursor arguments of units that return cursors."""
    overload = F.coalesce(F.col("OVERLOAD").try_cast("double"), F.lit(0.0)).cast("long")
    args = t["in_arguments"].where(F.upper(F.coalesce("PLS_TYPE", F.lit(""))).contains("CURSOR")).select("OWNER", tx.clean_str("PACKAGE_NAME").alias("PKG"), F.upper("OBJECT_NAME").alias("U"), overload.alias("OVERLOAD_NO"), "POSITION")
    units = inventory.join(m.where("REF_CURSOR_OUT > 0").select("SP_ID"), "SP_ID", "left_semi").withColumn("U", F.upper("NAME"))
    return units.join(args, ["OWNER", "PKG", "U", "OVERLOAD_NO"]).select("SP_ID", F.col("POSITION").alias("ARG_POSITION"), F.lit("").alias("RETURN_COLUMNS"), F.lit("Y").alias("IS_ADHOC"))


__all__ = ["bodies", "cursor_profiles", "dynamic_hints", "metrics", "parse_failures", "parser_bench", "sql_inventory", "target"]
