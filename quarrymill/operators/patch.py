"""Override operators: small tables of human corrections, applied as keyed patches.  The last
row of a key wins, by the file's order (column _ord)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in patch.columns if c not in keys]
    return patch.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_ord").alias("p")).select(*keys, *(F.col(f"p.{c}").alias(c) for c in rest))


def replace(df: DataFrame, patch: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Replaces columns (target: patch column) where the key's patch has a value, cast to the
    target's type; a value that can't be cast leaves the cell."""
    p = latest(patch, [key]).select(F.col(key), *(F.col(v).alias(f"__{t}") for t, v in columns.items()))
    out = df.join(p, key, "left")
    new = {t: F.coalesce(F.col(f"__{t}").try_cast(df.schema[t].dataType), F.col(t)) for t in columns}
    return out.select(*(new.get(c, F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def patch_cells(df: DataFrame, patch: DataFrame, key: str, metrics: Sequence[str], name: str = "METRIC_NAME", value: str = "VALUE") -> DataFrame:
    """Replaces single cells named by (key, metric).  Unknown keys and metrics are passed over."""
    p = latest(patch.where(F.col(name).isin(*metrics)), [key, name])
    wide = p.groupBy(key).agg(*(F.max(F.when(F.col(name) == m, F.col(value))).alias(f"__{m}") for m in metrics))
    out = df.join(wide, key, "left")
    cell = lambda m: F.coalesce(F.col(f"__{m}").try_cast("double").try_cast(df.schema[m].dataType), F.col(m)).alias(m)
    return out.select(*(cell(c) if c in metrics else F.col(c) for c in df.columns))


def include_exclude(inventory: DataFrame, excluded: DataFrame, patch: DataFrame, key: str = "SP_ID") -> tuple[DataFrame, DataFrame]:
    """EXCLUDE moves a unit to the excluded ones with its reason.  INCLUDE moves back a unit that
    an EXCLUDE of the same table moved; for any other it does nothing."""
    acts = latest(patch.select(key, F.upper("ACTION").alias("ACTION"), "REASON", "_ord"), [key])
    gone = acts.where("ACTION = 'EXCLUDE'").select(key, F.col("REASON").alias("EXCLUDE_REASON"))
    moved = inventory.join(gone, key)
    return inventory.join(gone, key, "left_anti"), excluded.unionByName(moved, allowMissingColumns=True)


def edge_patch(edges: DataFrame, patch: DataFrame, blank: Mapping[str, Column]) -> DataFrame:
    """ADD (if absent), REMOVE, CONFIRM (HIGH) and DOWNGRADE (LOW) of edges (SRC, DST), in the
    table's order: of a pair the last ADD or REMOVE decides its presence and the last CONFIRM or
    DOWNGRADE after it its confidence."""
    p = patch.select("SRC", "DST", F.upper("ACTION").alias("ACTION"), "_ord")
    exists = p.where(F.col("ACTION").isin("ADD", "REMOVE")).groupBy("SRC", "DST").agg(F.max_by("ACTION", "_ord").alias("there"), F.max("_ord").alias("at"), F.max(F.when(F.col("ACTION") == "REMOVE", F.col("_ord"))).alias("removed"))
    trust = p.where(F.col("ACTION").isin("CONFIRM", "DOWNGRADE")).groupBy("SRC", "DST").agg(F.max_by("ACTION", "_ord").alias("trust"), F.max("_ord").alias("trust_at"))
    kept = edges.join(exists.where("removed is not null").select("SRC", "DST"), ["SRC", "DST"], "left_anti")
    added = exists.where("there = 'ADD'").select("SRC", "DST").join(kept.select("SRC", "DST").distinct(), ["SRC", "DST"], "left_anti")
    added = added.select(*((blank[c] if c in blank else F.col(c)).alias(c) for c in edges.columns))
    out = kept.unionByName(added).join(trust.join(exists.select("SRC", "DST", "removed"), ["SRC", "DST"], "left").where("removed is null or trust_at > removed"), ["SRC", "DST"], "left")
    level = F.when(F.col("trust") == "CONFIRM", "HIGH").when(F.col("trust") == "DOWNGRADE", "LOW").otherwise(F.col("EDGE_CONFIDENCE"))
    return out.select(*(level.alias(c) if c == "EDGE_CONFIDENCE" else F.col(c) for c in edges.columns))
