"""Settings of the dictionary pipeline and the folder scorer; YAML files override defaults, an
unknown key is passed over and an empty section keeps its defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

# Default weights.
DEPENDENCY = {"REF_TABLE": 1.0, "FANOUT_SP": 3.0, "FANIN_SP": 2.0, "FANIN_APP": 2.0, "DB_LINK": 10.0, "TRIGGER_CALLER": 5.0, "SCHEDULER_CALLER": 3.0, "CROSS_SCHEMA_GRANT": 4.0}
COMPLEXITY = {
    "LOC": 1.0, "BRANCH": 1.0, "CURSOR": 2.0, "REF_CURSOR_OUT": 4.0, "DYNAMIC_SQL_LITERAL": 4.0, "DYNAMIC_SQL_VARIABLE": 10.0, "TX_CONTROL": 5.0, "AUTONOMOUS_TX": 10.0,
    "ORACLE_FEATURE": 5.0, "OUT_PARAM": 2.0, "EXCEPTION_HANDLER": 1.0, "GLOBAL_PKG_VAR": 5.0, "MUTATING_TRIGGER_RISK": 6.0,
}
REFERENCES = {"TABLE": 1.0, "SEQUENCE": 0.5, "BUILTIN": 2.0, "PACKAGE": 3.0, "CALL": 4.0, "GRANT": 3.0, "REMOTE": 8.0, "DB_LINK": 10.0}
SCORER_COMPLEXITY = {"branch": 1.0, "loop": 2.0, "query": 1.0, "nesting": 3.0, "dml": 1.0, "dynamic": 5.0, "handler": 1.5, "others": 2.0, "subprogram": 1.0}
BANDS = ((20.0, "low"), (50.0, "mid"), (100.0, "high"), (float("inf"), "very high"))


@dataclass(frozen=True)
class Pipeline:
    target_schemas: tuple[str, ...] = ()
    exclude_name_patterns: tuple[str, ...] = ()
    dependency: dict[str, float] = field(default_factory=lambda: dict(DEPENDENCY))
    complexity: dict[str, float] = field(default_factory=lambda: dict(COMPLEXITY))
    d_threshold: float = 60.0
    c_threshold: float = 60.0
    boundary_band: float = 5.0
    simple_limits: dict[str, float] = field(default_factory=lambda: {"loc": 50, "branch": 3, "cursor": 0})
    assisted_limits: dict[str, float] = field(default_factory=lambda: {"loc": 200, "branch": 10, "cursor": 2, "dynamic_sql_literal": 3})
    min_samples: int = 30
    model: str = "ridge"
    alpha: float = 1.0
    target_success_rate: float = 0.90
    random_seed: int = 42


@dataclass(frozen=True)
class Scorer:
    references: dict[str, float] = field(default_factory=lambda: dict(REFERENCES))
    complexity: dict[str, float] = field(default_factory=lambda: dict(SCORER_COMPLEXITY))
    composite: tuple[float, float, float] = (1.0, 1.0, 1.0)
    impact: dict[str, float] = field(default_factory=lambda: {"call_in": 4.0, "package_in": 3.0, "grants": 3.0})
    final_mode: str = "weighted_sum"
    normalisation: str = "rank"
    final_weights: tuple[float, float] = (0.7, 0.3)
    loc_divisor: float = 10.0
    bands: tuple[tuple[float, str], ...] = BANDS
    effort_method: str = "band"
    overhead_pct: float = 0.0
    fixed_hours: float = 0.0
    p90_multiplier: float = 1.5
    impact_buffer: float = 0.3


def merge(config: Any, values: dict | None) -> Any:
    """The config with the values that it knows."""
    if not values:
        return config
    new = {}
    for f in fields(config):
        if (v := values.get(f.name)) is not None:
            old = getattr(config, f.name)
            new[f.name] = merge(old, v) if is_dataclass(old) else {**old, **{str(k): float(x) for k, x in v.items()}} if isinstance(old, dict) else tuple(v) if isinstance(old, tuple) else type(old)(v)
    return replace(config, **new)


def load(path: str, config: Any) -> Any:
    import yaml

    with open(path, encoding="utf-8") as f:
        return merge(config, yaml.safe_load(f))
