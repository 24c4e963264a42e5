"""Command line: run, validate, lint, spike, diff, score."""

from __future__ import annotations

import argparse
import io
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from quarrymill.config import Pipeline, Scorer, load
from quarrymill.operators.graph import checkpointed
from quarrymill.plans import checks, depgraph, inventory, metrics, scoring, sqlfolder
from quarrymill.schemas import INPUTS, OVERRIDES
from quarrymill.sources import files, render


#: The folder of each stage, by the beginning of its tables' names.
FOLDERS = {"s1": "s1_inventory", "s2": "s2_metrics", "s3": "s3_graph", "s4": "s4_scoring", "s5": "s5_report"}


def place(out: str, name: str, layout: str) -> str:
    """Where a file of the run goes: beside the others, or in its stage's folder (reports: the last)."""
    return f"{out}/{name}" if layout == "flat" else f"{out}/{FOLDERS.get(name.split('_')[0], FOLDERS['s5'])}/{name}"


def logger(text: io.StringIO) -> logging.Logger:
    """A logger into text, anew for each run."""
    log, handler = logging.getLogger(__name__), logging.StreamHandler(text)
    handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s"))
    log.handlers, log.propagate = [handler], False
    log.setLevel(logging.INFO)
    return log


def tables(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The dictionary tables of folder/input and the overrides of folder/override that have rows."""
    over = {k: files.with_order(files.read_csv(spark, f"{folder}/override/{k}.csv", c)) for k, c in OVERRIDES.items() if files.headers(spark, f"{folder}/override/{k}.csv")}
    return files.read_dictionary(spark, f"{folder}/input", INPUTS), over


def stages(spark: SparkSession, folder: str, config: Pipeline) -> dict[str, DataFrame]:
    """Every stage's tables, by name."""
    t, over = tables(spark, folder)
    inv, gone = inventory.inventory(t, config, over.get("s1_inventory_override"))
    inv = checkpointed(inv)
    remote = files.remote_objects(spark, f"{folder}/input")
    m = checkpointed(metrics.metrics(t, inv, over.get("s2_metrics_override")))
    sql, hints = metrics.sql_inventory(t, inv), metrics.dynamic_hints(t, inv, over.get("s2_dynsql_resolve"))
    matrix = inventory.grant_matrix(t)
    # The dictionary's own files are no bodies, and may be large.
    bodies = files.whole_texts(spark, f"{folder}/input", pattern="{[!i]*,i[!n]*,in[!_]*}").selectExpr("regexp_extract(path, 'input/(.*)$', 1) as ACTION_FILE", "text")
    g = {k: checkpointed(v) for k, v in depgraph.build(t, inv, sql, hints, matrix, bodies, over).items()}
    s = checkpointed(scoring.scores(inv, m, g, config, over.get("pilot_effort"), over.get("s4_strategy_override")))
    return {
        "s1_inventory": inv, "s1_excluded": gone, "s1_unresolved": inventory.unresolved(t, remote, config), "s1_grant_matrix": matrix, "s2_metrics": m, "s2_sql_inventory": sql,
        "s2_dynsql_hints": hints, "s2_parser_bench": metrics.parser_bench(m), "s2_parse_failures": metrics.parse_failures(m), "s2_refcursor_profiles": metrics.cursor_profiles(t, inv, m), **g, "s4_scores": s, "s4_review": scoring.score_review(s, m), "s5_roadmap": scoring.roadmap(s, g["s3_edges"]),
        "s5_inventory": scoring.wide_inventory(inv, m, g["s3_nodes"], s), "s5_cut_points": scoring.cut_points(g["s3_edges"], remote), "s5_risks": scoring.risks(inv, m, g, t["in_arguments"]),
    }


def summary(s: DataFrame) -> str:
    """Quadrants, strategies, effort and confidence as Markdown."""
    parts = [f"## {c}\n\n" + files.markdown_table(s.groupBy(c).count().orderBy("count", ascending=False)) for c in ("QUADRANT", "STRATEGY", "CONFIDENCE")]
    total = files.markdown_table(s.selectExpr("round(sum(EFFORT_P50), 1) as P50", "round(sum(EFFORT_P90), 1) as P90"))
    return "# Summary\n\n" + "\n".join(parts) + "\n## Effort\n\n" + total


def reports(made: dict[str, DataFrame], named: DataFrame) -> str:
    """Deferred units, cut points and the risk register as Markdown; overridden units have an asterisk."""
    defer = scoring.marked(made["s4_scores"].where("STRATEGY = 'DEFER'").select("SP_ID", "D_SCORE", "C_SCORE", "EFFORT_P90"), named).orderBy("SP_ID")
    cuts = scoring.marked(made["s5_cut_points"], named).orderBy("SP_ID", "TARGET")
    risks = scoring.marked(made["s5_risks"], named, "SUBJECT").orderBy("RISK", "SUBJECT")
    return "".join(f"\n## {title}\n\n{files.markdown_table(df)}" for title, df in (("Deferred units", defer), ("Cut points", cuts), ("Risk register", risks)))


def main(argv: list[str] | None = None) -> int:
    """Runs a command; what it did, and what it failed on, goes to a file of its own in OUT/logs."""
    a = arguments(argv)
    spark = SparkSession.builder.appName("quarrymill").getOrCreate()
    text, began = io.StringIO(), time.time()
    log = logger(text)
    log.info("%s %s", a.command, a.folder)
    try:
        code = command(spark, a, log)
        log.info("done with %d after %.1f s", code, time.time() - began)
        return code
    except Exception:
        log.exception("failed after %.1f s", time.time() - began)
        raise
    finally:
        files.write_text(spark, f"{a.out}/logs/{a.command}_{time.strftime('%Y%m%d_%H%M%S', time.gmtime(began))}_{time.time_ns() % 10**6:06d}.log", text.getvalue())


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quarrymill")
    p.add_argument("command", choices=("run", "validate", "lint", "spike", "diff", "score"))
    p.add_argument("folder")
    p.add_argument("out", nargs="?", default="out")
    p.add_argument("--config")
    p.add_argument("--tag")
    p.add_argument("--stage", default="s4_scores")
    p.add_argument("--old")
    p.add_argument("--new")
    p.add_argument("--samples")
    p.add_argument("--layout", choices=("flat", "stage"), default="flat")
    return p.parse_args(argv)


def command(spark: SparkSession, a: argparse.Namespace, log: logging.Logger) -> int:
    if a.command == "score":
        config = load(a.config, Scorer()) if a.config else Scorer()
        texts = sqlfolder.scripts(spark, a.folder)
        objs = sqlfolder.objects(texts)
        if not objs.limit(1).count():
            print("no object found", file=sys.stderr)
            return 1
        refs = sqlfolder.references(objs, sqlfolder.grants(texts))
        rows = checkpointed(sqlfolder.scores(objs, sqlfolder.metrics(objs), refs, config))
        estimates = checkpointed(sqlfolder.effort(rows, files.effort_samples(spark, a.samples), config)) if a.samples else None
        files.write_csv(sqlfolder.object_table(rows, estimates), f"{a.out}/objects.csv", single=True)
        files.write_csv(sqlfolder.reference_table(refs), f"{a.out}/references.csv", single=True)
        if estimates is not None:
            files.write_csv(estimates, f"{a.out}/effort.csv", single=True)
        sqlfolder.report(spark, rows, refs, f"{a.out}/report.md", estimates, config)
        return 0
    if a.command == "diff":
        found = checks.diff(spark, f"{a.folder}/{a.stage}", a.stage, a.old, a.new, "SP_ID")
        files.write_csv(found, f"{a.out}/diff_{a.stage}_{a.old}_{a.new}.csv", single=True)
        found.show(100, False)  # all of them are in the file
        return 0
    if a.command == "lint":
        found = checks.lint(tables(spark, a.folder)[1])
    elif a.command == "validate":
        t, over = tables(spark, a.folder)
        config = load(a.config, Pipeline()) if a.config else Pipeline()
        inv = checkpointed(inventory.inventory(t, config, over.get("s1_inventory_override"))[0])
        m = metrics.metrics(t, inv, over.get("s2_metrics_override"))
        present = files.listing(spark, f"{a.folder}/input").selectExpr("regexp_extract(path, 'input/(.*)$', 1) as path")
        found = checks.presence(spark, f"{a.folder}/input").unionByName(checks.missing_bodies(t, present))
        found = found.unionByName(checks.validate(t, over, files.remote_objects(spark, f"{a.folder}/input"), inv, m, config.target_success_rate, config.min_samples))
    else:
        made = stages(spark, a.folder, load(a.config, Pipeline()) if a.config else Pipeline())
        if a.command == "spike":
            checks.spikes(made["s2_metrics"], made["s3_edges"].where("EDGE_TYPE = 'APP_CALL'")).show()
            return 0
        for name, df in made.items():
            files.write_csv(df, place(a.out, f"{name}.csv", a.layout), single=True)
            log.info("%s written", name)
            if a.tag:
                files.snapshot(df, f"{a.out}/snapshots/{name}", a.tag)
        over = tables(spark, a.folder)[1]
        named = checkpointed(scoring.overridden(over, spark))
        config = load(a.config, Pipeline()) if a.config else Pipeline()
        if "pilot_effort" in over and (found := scoring.diagnostics(made["s1_inventory"], made["s2_metrics"], made, config, over["pilot_effort"])):
            import yaml

            files.write_text(spark, place(a.out, "s4_weight_suggestion.yaml", a.layout), yaml.safe_dump(found, allow_unicode=True, sort_keys=False))
        text = summary(made["s4_scores"]) + reports(made, named)
        files.write_text(spark, place(a.out, "summary.md", a.layout), text)
        files.write_text(spark, place(a.out, "summary.html", a.layout), render.page(text))
        files.write_text(spark, place(a.out, "s3_graph.mmd", a.layout) if a.layout == "stage" else f"{a.out}/graph.mmd", files.mermaid(made["s3_edges"], made["s3_nodes"]))
        files.write_text(spark, place(a.out, "quadrants.svg", a.layout), files.scatter_svg(made["s4_scores"], "D_SCORE", "C_SCORE"))
        history = files.git_history(a.folder)
        audit = "# Overrides\n\n" + "\n".join(f"- {x}" for x in history) + "\n\n## Units\n\n" + files.markdown_table(named.orderBy("SP_ID"))
        files.write_text(spark, place(a.out, "override_audit.md", a.layout), audit)
        spikes = files.markdown_table(checks.spikes(made["s2_metrics"], made["s3_edges"].where("EDGE_TYPE = 'APP_CALL'")))
        files.write_text(spark, place(a.out, "spikes.md", a.layout), "# Spikes\n\n" + spikes)
        return 0
    found = checkpointed(found)
    files.write_csv(found.select("level", "code", "message"), f"{a.out}/{a.command}.csv", single=True)
    found.orderBy("level", "code", "message").show(1000, False)  # all of them are in the file
    return int(found.where("level = 'ERROR'").limit(1).count())


if __name__ == "__main__":
    sys.exit(main())
