"""Contracts of the dictionary tables, override tables and stage results: columns with types
(s string, l long, d double), keys, and whether a table must be there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...] = ()
    required: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _KINDS[k]) for n, k in self.columns])


def _contract(name: str, spec: str, key: str = "", required: bool = True) -> Contract:
    return Contract(name, tuple((c.split(":")[0], (c.split(":") + ["s"])[1]) for c in spec.split()), tuple(key.split()), required)


# The tables' columns.
INPUTS = {
    c.name: c
    for c in (
        _contract("in_objects", "OWNER OBJECT_NAME OBJECT_TYPE STATUS CREATED LAST_DDL_TIME", "OWNER OBJECT_NAME OBJECT_TYPE"),
        _contract("in_source", "OWNER NAME TYPE LINE:l TEXT", "OWNER NAME TYPE LINE"),
        _contract("in_dependencies", "OWNER NAME TYPE REFERENCED_OWNER REFERENCED_NAME REFERENCED_TYPE REFERENCED_LINK_NAME DEPENDENCY_TYPE"),
        _contract("in_arguments", "OWNER PACKAGE_NAME OBJECT_NAME OVERLOAD ARGUMENT_NAME POSITION:l DATA_TYPE PLS_TYPE IN_OUT"),
        _contract("in_synonyms", "OWNER SYNONYM_NAME TABLE_OWNER TABLE_NAME DB_LINK"),
        _contract("in_db_links", "OWNER DB_LINK USERNAME HOST"),
        _contract("in_tab_privs", "GRANTEE OWNER TABLE_NAME PRIVILEGE GRANTABLE TYPE"),
        _contract("in_role_privs", "GRANTEE OWNER TABLE_NAME PRIVILEGE DEPTH:l VIA_ROLES"),
        _contract("in_triggers", "OWNER TRIGGER_NAME TABLE_OWNER TABLE_NAME STATUS BODY_FILE"),
        _contract("in_scheduler_jobs", "OWNER JOB_NAME JOB_TYPE ACTION_FILE ENABLED SCHEDULE_TEXT"),
        _contract("in_app_calls", "REPO FILE_PATH LINE_NO:l SP_NAME_RAW SP_NAME_RESOLVED CALL_KIND CALL_SNIPPET CONFIDENCE"),
        _contract("in_app_constants", "REPO FILE_PATH CONST_NAME CONST_VALUE", required=False),
        _contract("in_plscope_identifiers", "OWNER OBJECT_NAME OBJECT_TYPE NAME TYPE USAGE USAGE_ID:l LINE:l COL:l USAGE_CONTEXT_ID:l", required=False),
        _contract("in_exec_stats", "OWNER OBJECT_NAME EXEC_COUNT_PERIOD:d", required=False),
    )
}
REMOTE = _contract("in_remote_objects", "OWNER OBJECT_NAME OBJECT_TYPE STATUS CREATED LAST_DDL_TIME", required=False)
OVERRIDES = {
    c.name: c
    for c in (
        _contract("s1_inventory_override", "SP_ID ACTION RESOLVED_TARGET REASON", "SP_ID", False),
        _contract("s2_metrics_override", "SP_ID METRIC_NAME VALUE REASON", "SP_ID METRIC_NAME", False),
        _contract("s2_dynsql_resolve", "SRC_SP_ID RESOLVED_TABLES REASON", "SRC_SP_ID", False),
        _contract("s3_edges_override", "SRC DST ACTION REASON", "SRC DST", False),
        _contract("s3_cluster_override", "SP_ID CLUSTER_ID:l REASON", "SP_ID", False),
        _contract("s4_strategy_override", "SP_ID STRATEGY REASON QUADRANT EFFORT_MD:d", "SP_ID", False),
        _contract("pilot_effort", "SP_ID ACTUAL_MD:d", "SP_ID", False),
    )
}
