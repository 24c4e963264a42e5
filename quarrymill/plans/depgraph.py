"""Stage 3: the typed dependency graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.operators import graph as gr
from quarrymill.operators import patch as pt
from quarrymill.operators import relational as rel
from quarrymill.plans.inventory import resolve_synonyms, target

EDGE = "SRC DST EDGE_TYPE EDGE_CONFIDENCE IS_DBLINK DST_TYPE SRC_TYPE".split()
CODE = ("PROCEDURE", "FUNCTION", "PACKAGE", "PACKAGE BODY", "TRIGGER")


def _edges(df: DataFrame, src: F.Column, dst: F.Column, kind: str | F.Column, trust: str, dst_type: str | F.Column, src_type: str | F.Column = "SP", link: str = "N") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(src.alias("SRC"), dst.alias("DST"), lit(kind).alias("EDGE_TYPE"), F.lit(trust).alias("EDGE_CONFIDENCE"), F.lit(link).alias("IS_DBLINK"), lit(dst_type).alias("DST_TYPE"), lit(src_type).alias("SRC_TYPE"))


def callables(inventory: DataFrame) -> DataFrame:
    """(OWNER, T, ONE): a dictionary name and its unit, or the package node if it has several."""
    rows = inventory.select("OWNER", target().alias("T"), "SP_ID")
    return rows.groupBy("OWNER", "T").agg(F.count(F.lit(1)).alias("n"), F.min("SP_ID").alias("one")).select("OWNER", "T", F.when(F.col("n") == 1, F.col("one")).otherwise(F.concat_ws(".", "OWNER", "T")).alias("ONE"))


def dependency_edges(t: dict[str, DataFrame], inventory: DataFrame) -> DataFrame:
    """Calls, table uses and remote uses; a package's dependencies go to each of its subprograms."""
    sp = inventory.select("OWNER", target().alias("NAME"), "SP_ID", F.when(F.col("TYPE") == "TRIGGER", "TRIGGER").otherwise("SP").alias("ST"))
    d = t["in_dependencies"].join(rel.unsized(sp), ["OWNER", "NAME"])
    base = d.select("SP_ID", "ST", "OWNER", F.col("REFERENCED_OWNER").alias("RO"), F.col("REFERENCED_NAME").alias("RN"), F.col("REFERENCED_TYPE").alias("RT"), tx.clean_str("REFERENCED_LINK_NAME").alias("L"))
    syn = base.where("RT = 'SYNONYM' and L = ''").withColumnRenamed("RN", "NAME")
    syn = resolve_synonyms(t, syn).where("TABLE_NAME is not null")
    kind = t["in_objects"].groupBy(F.col("OWNER").alias("RO"), F.col("OBJECT_NAME").alias("RN")).agg(F.min("OBJECT_TYPE").alias("RT"))
    via = syn.select("SP_ID", "ST", "OWNER", F.col("TABLE_OWNER").alias("RO"), F.col("TABLE_NAME").alias("RN"), tx.clean_str("DB_LINK").alias("L")).join(rel.unsized(kind), ["RO", "RN"], "left")
    via = via.select("SP_ID", "ST", "OWNER", "RO", "RN", F.coalesce("RT", F.lit("TABLE")).alias("RT"), "L")
    every = base.where("RT <> 'SYNONYM' or L <> ''").unionByName(via)
    remote = _edges(every.where("L <> ''"), F.col("SP_ID"), F.concat(F.lit("REMOTE::"), "RO", F.lit("."), "RN", F.lit("@"), "L"), "REMOTE_REF", "HIGH", "REMOTE", F.col("ST"), "Y")
    local = every.where("L = ''")
    tables = _edges(local.where(F.col("RT").isin("TABLE", "VIEW", "MATERIALIZED VIEW")), F.col("SP_ID"), F.concat(F.lit("TABLE::"), "RO", F.lit("."), "RN"), "REF_TABLE", "HIGH", "TABLE", F.col("ST"))
    calls = local.where(F.col("RT").isin(*CODE)).join(rel.unsized(callables(inventory).select(F.col("OWNER").alias("RO"), F.col("T").alias("RN"), "ONE")), ["RO", "RN"])
    return remote.unionByName(tables).unionByName(_edges(calls.where("ONE <> SP_ID"), F.col("SP_ID"), F.col("ONE"), "CALL", "HIGH", "SP", F.col("ST")))


def dynamic_edges(sql: DataFrame, hints: DataFrame) -> DataFrame:
    """Tables of literal dynamic statements, tables that people have named, and unknown targets."""
    owner = F.element_at(F.split("SP_ID", r"\."), 1)

    def tables(df: DataFrame, column: str, kind: str) -> DataFrame:
        rows = df.select("SP_ID", F.explode(F.split(F.col(column), ";")).alias("x")).where("trim(x) <> ''").withColumn("x", F.upper(F.trim("x")))
        name = F.when(F.col("x").contains("."), F.col("x")).otherwise(F.concat(owner, F.lit("."), F.col("x")))
        return _edges(rows, F.col("SP_ID"), F.concat(F.lit("TABLE::"), name), kind, "MEDIUM", "TABLE")

    literal = tables(sql.where("IS_DYNAMIC = 'Y' and DYNAMIC_KIND = 'LITERAL'"), "TABLES_RAW", "DYNAMIC_SQL_LITERAL")
    named = tables(hints.where("RESOLVED_TABLES <> ''"), "RESOLVED_TABLES", "DYNAMIC_SQL_RESOLVED")
    rest = hints.where("RESOLVED_TABLES = ''")
    return literal.unionByName(named).unionByName(_edges(rest, F.col("SP_ID"), F.concat(F.lit("UNKNOWN::"), "SP_ID"), "DYNAMIC_SQL_VARIABLE", "LOW", "UNKNOWN"))


def app_edges(t: dict[str, DataFrame], inventory: DataFrame) -> DataFrame:
    """Calls from applications, by the unit's name without its overload; no match is unknown."""
    base = inventory.select(tx.strip_overload("SP_ID").alias("B"), "SP_ID")
    names = base.unionByName(inventory.select(F.upper(F.concat_ws(".", target(), F.when(F.col("PKG") != "", F.col("NAME")))).alias("B"), "SP_ID")).distinct()
    calls = t["in_app_calls"].withColumn("B", F.upper(F.when(tx.clean_str("SP_NAME_RESOLVED") != "", tx.clean_str("SP_NAME_RESOLVED")).otherwise(tx.clean_str("SP_NAME_RAW"))))
    j = calls.join(rel.unsized(names), "B", "left")
    src = F.concat(F.lit("APP::"), "REPO")
    hit = _edges(j.where("SP_ID is not null"), src, F.col("SP_ID"), "APP_CALL", "HIGH", "SP", "APP")
    return hit.unionByName(_edges(j.where("SP_ID is null"), src, F.concat(F.lit("UNKNOWN::"), "B"), "APP_CALL", "LOW", "UNKNOWN", "APP"))


def job_edges(t: dict[str, DataFrame], bodies: DataFrame, inventory: DataFrame) -> DataFrame:
    """Jobs whose body names a unit, by its tokens.  bodies: ACTION_FILE, text."""
    text = t["in_scheduler_jobs"].join(bodies, "ACTION_FILE").select(F.concat(F.lit("JOB::"), "OWNER", F.lit("."), "JOB_NAME").alias("J"), F.upper("text").alias("text"))
    c = callables(inventory)
    names = c.select(F.concat_ws(".", "OWNER", "T").alias("word"), "ONE").unionByName(c.select(F.col("T").alias("word"), "ONE"))
    words = F.concat(tx.extract_all("text", r"[A-Z0-9_$#]+"), tx.extract_all("text", r"[A-Z0-9_$#]+\.[A-Z0-9_$#]+"))
    hit = rel.containment(text, "J", words, names, "word").join(names, "word").select("J", "ONE").distinct()
    return _edges(hit, F.col("J"), F.col("ONE"), "JOB_CALL", "HIGH", "SP", "JOB")


def grant_checked(edges: DataFrame, inventory: DataFrame, matrix: DataFrame) -> DataFrame:
    """GRANT_OK of calls: Y in one schema or with EXECUTE (to the owner or PUBLIC), else N; '' for other edges."""
    own = inventory.select("SP_ID", "OWNER", target().alias("T")).unionByName(callables(inventory).select(F.col("ONE").alias("SP_ID"), "OWNER", "T")).dropDuplicates(["SP_ID"]).transform(rel.unsized)
    execute = rel.unsized(matrix.where(F.upper("PRIVILEGE") == "EXECUTE"))
    e = edges.join(own.select(F.col("SP_ID").alias("SRC"), F.col("OWNER").alias("SO")), "SRC", "left").join(own.select(F.col("SP_ID").alias("DST"), F.col("OWNER").alias("DO"), F.col("T").alias("DT")), "DST", "left")
    direct = execute.select(F.col("GRANTEE").alias("SO"), F.col("OWNER").alias("DO"), F.col("TABLE_NAME").alias("DT"))
    public = execute.where("GRANTEE = 'PUBLIC'").select(F.col("OWNER").alias("DO"), F.col("TABLE_NAME").alias("DT"))
    e = rel.tristate(rel.tristate(e, direct, ["SO", "DO", "DT"], F.coalesce(F.col("SO") == F.col("DO"), F.lit(False)), "g1"), public, ["DO", "DT"], F.col("g1") == "Y", "g2")
    return e.withColumn("GRANT_OK", F.when((F.col("EDGE_TYPE") == "CALL") & F.col("SO").isNotNull() & F.col("DO").isNotNull(), F.col("g2")).otherwise("")).select(*edges.columns, "GRANT_OK")


def node_types(inventory: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, NODE_TYPE): units first, then what edges start from, then what they lead to."""
    units = inventory.select(F.col("SP_ID").alias("n"), F.when(F.col("TYPE") == "TRIGGER", "TRIGGER").otherwise("SP").alias("NODE_TYPE"), F.lit(0).alias("o"))
    ends = edges.where("EDGE_TYPE <> 'OVERRIDE'")
    more = ends.select(F.col("SRC").alias("n"), F.col("SRC_TYPE").alias("NODE_TYPE"), F.lit(1).alias("o")).unionByName(ends.select(F.col("DST").alias("n"), F.col("DST_TYPE").alias("NODE_TYPE"), F.lit(2).alias("o")))
    return rel.first_wins(units.unionByName(more), ["n"], ["o", "NODE_TYPE"]).drop("o").withColumnRenamed("n", "node")


def build(t: dict[str, DataFrame], inventory: DataFrame, sql: DataFrame, hints: DataFrame, matrix: DataFrame, job_bodies: DataFrame | None = None, overrides: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """s3_edges, s3_nodes, s3_scc, s3_waves and s3_review."""
    overrides = overrides or {}
    parts = [dependency_edges(t, inventory), dynamic_edges(sql, hints), app_edges(t, inventory)]
    if job_bodies is not None:
        parts.append(job_edges(t, job_bodies, inventory))
    edges = reduce(DataFrame.unionByName, parts)
    edges = rel.first_wins(edges, ["SRC", "DST", "EDGE_TYPE"], ["EDGE_CONFIDENCE", "IS_DBLINK"]).withColumn("CUT_POINT", F.col("IS_DBLINK"))
    edges = grant_checked(edges, inventory, matrix)
    if "s3_edges_override" in overrides:
        blank = {"EDGE_TYPE": F.lit("OVERRIDE"), "EDGE_CONFIDENCE": F.lit("HIGH"), "IS_DBLINK": F.lit("N"), "CUT_POINT": F.lit("N"), "GRANT_OK": F.lit(""), "DST_TYPE": F.lit("SP"), "SRC_TYPE": F.lit("SP")}
        edges = pt.edge_patch(edges, overrides["s3_edges_override"], blank)
    edges = gr.checkpointed(edges)
    nodes = gr.checkpointed(node_types(inventory, edges))
    code = nodes.where(F.col("NODE_TYPE").isin("SP", "TRIGGER")).select("node")
    pairs = edges.select(F.col("SRC").alias("src"), F.col("DST").alias("dst"))
    inside = pairs.join(code.select(F.col("node").alias("src")), "src", "left_semi").join(code.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    components = gr.component_ids(gr.strong_components(code, inside))
    wave = gr.waves(components.select("node", "component"), inside).select("node", F.col("wave").alias("WAVE_NO"))
    known = pairs.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    out = nodes.join(gr.communities(nodes.select("node"), known), "node", "left").join(gr.degrees(code, inside), "node", "left").join(gr.betweenness(code, inside), "node", "left").join(wave, "node", "left").join(components.select("node", "scc_id"), "node", "left")
    out = out.select(
        F.col("node").alias("NODE_ID"), "NODE_TYPE", F.col("cluster_id").alias("CLUSTER_ID"), F.coalesce("fan_in", F.lit(0)).cast("long").alias("FAN_IN"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("FAN_OUT"),
        F.coalesce("betweenness", F.lit(0.0)).alias("BETWEENNESS"), F.coalesce("WAVE_NO", F.lit(-1).cast("long")).alias("WAVE_NO"), F.coalesce("scc_id", F.lit(-1).cast("long")).alias("SCC_ID"),
    )
    if "s3_cluster_override" in overrides:
        out = pt.replace(out, overrides["s3_cluster_override"].withColumnRenamed("SP_ID", "NODE_ID"), "NODE_ID", {"CLUSTER_ID": "CLUSTER_ID"})
    scc = components.where("scc_id >= 0").select(F.col("scc_id").alias("SCC_ID"), F.col("node").alias("MEMBER_SP_ID"))
    return {"s3_edges": edges, "s3_nodes": out, "s3_scc": scc, "s3_waves": wave.select(F.col("node").alias("SP_ID"), "WAVE_NO"), "s3_review": review(edges, out, scc)}


def review(edges: DataFrame, nodes: DataFrame, scc: DataFrame) -> DataFrame:
    """(REASON_CODE, SUBJECT, DETAIL): weak edges, missing grants, orphans, large components."""
    row = lambda df, code, who, detail: df.select(F.lit(code).alias("REASON_CODE"), who.alias("SUBJECT"), detail.alias("DETAIL"))
    ends = edges.select(F.col("SRC").alias("NODE_ID")).unionByName(edges.select(F.col("DST").alias("NODE_ID")))
    orphan = rel.anti(nodes.where(F.col("NODE_TYPE").isin("SP", "TRIGGER")), ends, ["NODE_ID"])
    large = scc.groupBy("SCC_ID").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    out = row(edges.where("EDGE_CONFIDENCE = 'LOW'"), "LOW_CONFIDENCE_EDGE", F.col("SRC"), F.col("DST")).unionByName(row(edges.where("GRANT_OK = 'N'"), "GRANT_MISSING", F.col("SRC"), F.col("DST")))
    return out.unionByName(row(orphan, "ORPHAN_NODE", F.col("NODE_ID"), F.lit(""))).unionByName(row(large, "LARGE_SCC", F.col("SCC_ID").cast("string"), F.col("n").cast("string")))
