"""Stage 1: the inventory of program units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.config import Pipeline
from quarrymill.functions import text as tx
from quarrymill.operators import patch as pt
from quarrymill.operators import relational as rel

PLAIN = ("PROCEDURE", "FUNCTION", "TRIGGER")


def target(pkg: str = "PKG", name: str = "NAME") -> F.Column:
    """The dictionary name of a unit: its package, or itself."""
    return F.when(tx.clean_str(pkg) != "", tx.clean_str(pkg)).otherwise(F.col(name))


def units(t: dict[str, DataFrame], config: Pipeline) -> tuple[DataFrame, DataFrame]:
    """(units, excluded): plain units, and package subprograms from arguments and source.  The
    package parts pass the schema and name filters of their packages."""
    o = t["in_objects"].where(F.col("OBJECT_TYPE").isin(*PLAIN, "PACKAGE BODY"))
    if config.target_schemas:
        o = o.where(F.col("OWNER").isin(*config.target_schemas))
    kept, gone = rel.split_by_patterns(o, "OBJECT_NAME", config.exclude_name_patterns)
    none = F.lit("")
    plain = kept.where(F.col("OBJECT_TYPE").isin(*PLAIN)).select("OWNER", none.alias("PKG"), F.col("OBJECT_NAME").alias("NAME"), F.lit(0).cast("long").alias("OVERLOAD_NO"), F.col("OBJECT_TYPE").alias("TYPE"), "STATUS")
    packages = kept.where("OBJECT_TYPE = 'PACKAGE BODY'").select("OWNER", F.col("OBJECT_NAME").alias("PKG"), "STATUS")
    overload = F.coalesce(F.col("OVERLOAD").try_cast("double"), F.lit(0.0)).cast("long")
    args = t["in_arguments"].where(tx.clean_str("PACKAGE_NAME") != "").where(tx.clean_str("OBJECT_NAME") != "")
    args = args.select("OWNER", tx.clean_str("PACKAGE_NAME").alias("PKG"), tx.clean_str("OBJECT_NAME").alias("NAME"), overload.alias("OVERLOAD_NO")).distinct()
    found = F.upper(F.regexp_extract("TEXT", tx.SUBPROGRAM, 1))
    src = t["in_source"].where("TYPE = 'PACKAGE BODY'").select("OWNER", F.col("NAME").alias("PKG"), found.alias("NAME")).where("NAME <> ''").distinct()
    src = src.join(rel.unsized(args.select("OWNER", "PKG", "NAME").distinct()), ["OWNER", "PKG", "NAME"], "left_anti").withColumn("OVERLOAD_NO", F.lit(0).cast("long"))
    parts = args.unionByName(src).join(rel.unsized(packages), ["OWNER", "PKG"]).withColumn("TYPE", F.lit("PACKAGE_SUBPROGRAM"))
    every = plain.unionByName(parts)
    key = rel.synthesize_key(F.col("OWNER"), F.col("PKG"), F.col("NAME"), F.col("OVERLOAD_NO"))
    return every.withColumn("SP_ID", key), gone


def link_uses(t: dict[str, DataFrame]) -> DataFrame:
    """(OWNER, NAME, LINE, LINK), a row for each name@link in the source."""
    return t["in_source"].select("OWNER", "NAME", "LINE", F.explode(tx.db_links(F.coalesce("TEXT", F.lit("")))).alias("LINK"))


def inventory(t: dict[str, DataFrame], config: Pipeline, override: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(s1_inventory, s1_excluded)."""
    rows, gone = units(t, config)
    rows = rows.withColumn("__t", target())
    keys = ["OWNER", "__t"]
    source = rel.unsized(t["in_source"].withColumnRenamed("NAME", "__t"))
    loc = source.where(tx.is_code_line("TEXT")).groupBy(*keys).agg(F.count(F.lit(1)).alias("LOC"))
    rows = rel.lookup_default(rows, loc, keys, {"LOC": 0})
    rows = rel.semi_flag(rows, source.where((F.col("LINE") == 1) & F.upper("TEXT").contains("WRAPPED")), keys, "WRAPPED")
    privs = t["in_tab_privs"].select("GRANTEE", "OWNER", "TABLE_NAME", "PRIVILEGE").unionByName(t["in_role_privs"].select("GRANTEE", "OWNER", "TABLE_NAME", "PRIVILEGE"))
    outside = privs.where((F.upper("PRIVILEGE") == "EXECUTE") & ~F.col("GRANTEE").isin("PUBLIC", *config.target_schemas)).withColumnRenamed("TABLE_NAME", "__t")
    rows = rel.semi_flag(rows, rel.unsized(outside), keys, "CROSS_SCHEMA_CALLABLE")
    rows = rel.semi_flag(rows, rel.unsized(t["in_exec_stats"].where("EXEC_COUNT_PERIOD = 0").withColumnRenamed("OBJECT_NAME", "__t")), keys, "SUSPECT_UNUSED")
    remote = t["in_dependencies"].where(tx.clean_str("REFERENCED_LINK_NAME") != "").select("OWNER", F.col("NAME").alias("__t"))
    rows = rel.additive_counts(rows, [remote, link_uses(t).select("OWNER", F.col("NAME").alias("__t"))], keys, "REMOTE_REF_COUNT").drop("__t")
    if override is not None:
        rows, gone = pt.include_exclude(rows, gone, override)
    names = "SP_ID OWNER PKG NAME OVERLOAD_NO TYPE LOC STATUS WRAPPED CROSS_SCHEMA_CALLABLE SUSPECT_UNUSED REMOTE_REF_COUNT".split()
    return rows.select(*names), gone


def resolve_synonyms(t: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """names (OWNER, NAME, ...) with TABLE_OWNER, TABLE_NAME, DB_LINK: the owner's synonym before the
    public one; of a synonym's rows the last in the file's order, which the ids of a scan follow."""
    syn = t["in_synonyms"].select("OWNER", F.col("SYNONYM_NAME").alias("NAME"), F.struct("TABLE_OWNER", "TABLE_NAME", "DB_LINK").alias("s"), F.monotonically_increasing_id().alias("at"))
    one = syn.groupBy("OWNER", "NAME").agg(F.max_by("s", "at").alias("s"))
    own, public = one.where("OWNER <> 'PUBLIC'"), one.where("OWNER = 'PUBLIC'").drop("OWNER")
    return rel.priority_lookup(names, [(own, ["OWNER", "NAME"]), (public, ["NAME"])], "s").select(*names.columns, "s.TABLE_OWNER", "s.TABLE_NAME", "s.DB_LINK")


def grant_matrix(t: dict[str, DataFrame]) -> DataFrame:
    """Direct grants before those by roles, one row for each right."""
    direct = t["in_tab_privs"].select("GRANTEE", "OWNER", "TABLE_NAME", "PRIVILEGE", F.lit(0).cast("long").alias("DEPTH"), F.lit("").alias("VIA_ROLES"), F.lit(0).alias("o"))
    roles = t["in_role_privs"].select("GRANTEE", "OWNER", "TABLE_NAME", "PRIVILEGE", "DEPTH", "VIA_ROLES", F.lit(1).alias("o"))
    return rel.first_wins(direct.unionByName(roles), ["GRANTEE", "OWNER", "TABLE_NAME", "PRIVILEGE"], ["o", "DEPTH", "VIA_ROLES"]).drop("o")


def unresolved(t: dict[str, DataFrame], remote: DataFrame, config: Pipeline) -> DataFrame:
    """(SP_ID, REASON_CODE, DETAIL): remote targets and synonyms that lead nowhere, unknown links,
    invalid units and colliding names."""
    row = lambda df, who, code, detail: df.select(who.alias("SP_ID"), F.lit(code).alias("REASON_CODE"), detail.alias("DETAIL"))
    unit = F.concat_ws(".", "OWNER", "NAME")
    deps = t["in_dependencies"]
    direct = deps.where(tx.clean_str("REFERENCED_LINK_NAME") != "").select("OWNER", "NAME", F.col("REFERENCED_OWNER").alias("TO"), F.col("REFERENCED_NAME").alias("TN"), F.col("REFERENCED_LINK_NAME").alias("L"))
    syn = deps.where("REFERENCED_TYPE = 'SYNONYM'").select(F.col("OWNER").alias("U"), F.col("NAME").alias("UN"), F.col("OWNER"), F.col("REFERENCED_NAME").alias("NAME"))
    solved = resolve_synonyms(t, syn)
    via = solved.where(tx.clean_str("DB_LINK") != "").select(F.col("U").alias("OWNER"), F.col("UN").alias("NAME"), F.col("TABLE_OWNER").alias("TO"), F.col("TABLE_NAME").alias("TN"), F.col("DB_LINK").alias("L"))
    known = remote.select(F.col("DB_LINK").alias("L"), F.col("OWNER").alias("TO"), F.col("OBJECT_NAME").alias("TN"))
    lost = rel.anti(direct.unionByName(via), known, ["L", "TO", "TN"])
    nowhere = solved.where("TABLE_NAME is null")
    links = rel.anti(link_uses(t), t["in_db_links"].select(F.col("DB_LINK").alias("LINK")), ["LINK"])
    links = links.groupBy("OWNER", "NAME").agg(F.min("LINK").alias("LINK"), F.min_by("LINE", F.struct("LINE")).alias("LINE"))
    bad = t["in_objects"].where("STATUS = 'INVALID'").withColumnRenamed("OBJECT_NAME", "NAME")
    # Rows count here, not owners: a function and a trigger of one owner collide too.
    many = rel.collisions(t["in_objects"].where(F.col("OBJECT_TYPE").isin(*PLAIN, "PACKAGE BODY")), ["OBJECT_NAME"], "OWNER", by_rows=True)
    out = row(lost, unit, "UNRESOLVED_REMOTE", F.concat("TO", F.lit("."), "TN", F.lit("@"), "L"))
    out = out.unionByName(row(nowhere, F.concat_ws(".", "U", "UN"), "UNRESOLVED_SYNONYM", F.col("NAME")))
    out = out.unionByName(row(links, unit, "UNKNOWN_DB_LINK", F.concat(F.col("LINK"), F.lit(" line "), F.col("LINE").cast("string"))))
    return out.unionByName(row(bad, unit, "INVALID_STATUS", F.col("OBJECT_TYPE"))).unionByName(row(many, F.col("OBJECT_NAME"), "NAME_COLLISION", F.col("value_list")))
