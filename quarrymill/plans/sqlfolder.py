"""The folder scorer: objects and grants of SQL scripts, metrics, references, scores, effort."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.config import Scorer
from quarrymill.functions import text as tx
from quarrymill.operators import rank as rk
from quarrymill.operators import relational as rel
from quarrymill.operators import stats as st
from quarrymill.operators.graph import checkpointed
from quarrymill.sources import files

# Object types, programs, patterns and words that are no tables.
NAME = r'"?[\w$#]+"?(?:\s*\.\s*"?[\w$#]+"?)?'
HEADER = rf"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:NON)?EDITIONABLE\s+)?(?:PUBLIC\s+)?(PACKAGE\s+BODY|TYPE\s+BODY|MATERIALIZED\s+VIEW|PACKAGE|TYPE|PROCEDURE|FUNCTION|TRIGGER|TABLE|VIEW|SEQUENCE|INDEX|SYNONYM)\s+({NAME})"
GRANT = rf"(?i)\bGRANT\s+([\w\s,]+?)\s+ON\s+({NAME})\s+TO\s+(\"?[\w$#]+\"?)"
PROGRAMS = ("PROCEDURE", "FUNCTION", "PACKAGE", "PACKAGE_BODY", "TRIGGER", "TYPE_BODY")
HANDLER = rf"(?i)\bWHEN\s+(?:{tx.IDENT}|OTHERS)\s+THEN\b"
TABLE = r'[A-Za-z0-9_$#.@"]+'
TABLE_USES = [rf"(?i)\b(?:FROM|JOIN)\s+({TABLE})", rf"(?i)\bINSERT\s+INTO\s+({TABLE})", rf"(?i)\bUPDATE\s+({TABLE})", rf"(?i)\bDELETE\s+(?:FROM\s+)?({TABLE})", rf"(?i)\bMERGE\s+INTO\s+({TABLE})"]
NO_TABLE = "DUAL SELECT SET WHERE VALUES INTO FROM TABLE THE ONLY LATERAL UNNEST".split()


def scripts(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, text) of the folder's *.sql files."""
    return files.whole_texts(spark, folder, recursive, "*.sql")


def objects(texts: DataFrame) -> DataFrame:
    """key, owner, name, otype, path, start, lines, display: an object from its header to the next
    one or to a line of / alone.  Of equal keys the last in the order of files wins."""
    rows = texts.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("i", "line"))
    order = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_replace("line", r"--.*$", "")
    rows = rows.withColumn("block", F.sum((tx.trim_any("line") == "/").cast("int")).over(order)).withColumn("kind", F.upper(F.regexp_replace(F.regexp_extract(head, HEADER, 1), r"\s+", "_"))).withColumn("ident", F.regexp_extract(head, HEADER, 2))
    rows = rel.assign_slice(rows, ["path", "block"], ["i"], F.when(F.col("kind") != "", F.struct("i", "kind", "ident")), "h").where("h is not null").where(tx.trim_any("line") != "/")
    parts = F.transform(F.split(F.col("h.ident"), r"\."), lambda x: F.replace(tx.trim_any(x), F.lit('"'), F.lit("")))
    out = rows.groupBy("path", "h").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("n"), F.col("line").alias("t")))).alias("lines"))  # an object's lines
    out = out.select("path", F.col("h.i").alias("start"), F.col("h.kind").alias("otype"), F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, parts[0]).alias("owner"), F.transform("lines", lambda x: x["t"]).alias("lines"))
    display = F.upper(F.concat_ws(".", "owner", "name"))
    out = out.withColumns({"display": display, "key": F.concat(display, F.when(F.col("otype").endswith("_BODY"), F.concat(F.lit(":"), "otype")).otherwise("")), "is_program": F.col("otype").isin(*PROGRAMS)})
    out = out.groupBy("key").agg(F.max_by(F.struct(*(c for c in out.columns if c != "key")), F.struct("path", "start")).alias("o")).select("key", "o.*")
    return checkpointed(out)  # all later steps start from here


def grants(texts: DataFrame) -> DataFrame:
    """(privs, object, grantee) of the GRANT statements, the first grantee of each."""
    clean = tx.strip_comments("text")
    tidy = lambda c: F.upper(F.replace(F.regexp_replace(c, r"\s+", " "), F.lit('"'), F.lit("")))
    found = F.arrays_zip(*(tx.extract_all(clean, GRANT, k).alias(n) for k, n in ((1, "p"), (2, "o"), (3, "g"))))
    return texts.select(F.explode(found).alias("z")).select(tidy(F.col("z.p")).alias("privs"), F.replace(tidy(F.col("z.o")), F.lit(" "), F.lit("")).alias("object"), tidy(F.col("z.g")).alias("grantee"))


def metrics(objs: DataFrame) -> DataFrame:
    """The programs' counts."""
    rows = objs.where("is_program").withColumn("c", tx.clean_code(F.array_join("lines", "\n")))
    n = lambda p: tx.count("c", p)
    nest, handlers, zero = tx.nesting("c"), n(HANDLER), F.lit(0).cast("long")
    packs = F.col("otype").isin("PACKAGE", "PACKAGE_BODY", "TYPE", "TYPE_BODY")
    return rows.select(
        "key", F.size(F.filter("lines", lambda x: tx.is_code_line(x))).cast("long").alias("loc"),
        (F.greatest(n(r"(?i)\bIF\b") - n(r"(?i)\bEND\s+IF\b"), zero) + n(r"(?i)\bELSIF\b") + F.greatest(n(r"(?i)\bWHEN\b") - handlers, zero)).alias("branch"),
        F.floor(n(r"(?i)\bLOOP\b") / 2).cast("long").alias("loop"), nest["marks"].cast("long").alias("query"), nest["most"].cast("long").alias("nesting"),
        n(r"(?i)\b(INSERT|UPDATE|DELETE|MERGE)\b").alias("dml"), (n(r"(?i)\bEXECUTE\s+IMMEDIATE\b") + n(r"(?i)\bDBMS_SQL\s*\.")).alias("dynamic"),
        handlers.alias("handler"), F.col("c").rlike(tx.WHEN_OTHERS).cast("long").alias("others"), F.when(packs, n(rf"(?i)\b(?:PROCEDURE|FUNCTION)\s+{tx.IDENT}")).otherwise(zero).alias("subprogram"),
    ).withColumn("cyclomatic", 1 + F.col("branch") + F.col("loop") + F.col("handler"))


def references(objs: DataFrame, granted: DataFrame) -> DataFrame:
    """src, target, rtype, resolved, target_key, detail, count."""
    progs = objs.where("is_program").select(F.col("key").alias("src"), F.upper("name").alias("self"), "otype", tx.clean_code(F.array_join("lines", "\n")).alias("c"))
    none = F.lit(None).cast("string")
    pick = lambda kinds, best: objs.where(F.col("otype").isin(*kinds)).groupBy(F.upper("name").alias("target")).agg(best.alias("target_key"))
    first = F.min_by("key", F.struct("path", "start"))
    pair = lambda p: F.arrays_zip(tx.extract_all("c", p, 1).alias("a"), tx.extract_all("c", p, 2).alias("b"))
    base = lambda c: F.upper(F.element_at(F.split(F.regexp_replace(F.regexp_replace(c, '"', ""), "@.*$", ""), r"\."), -1))

    link = progs.select("src", F.explode(pair(rf"\b([A-Za-z_][A-Za-z0-9_$#.]*)@({tx.IDENT})")).alias("z")).select("src", F.concat(base(F.col("z.a")), F.lit("@"), F.upper("z.b")).alias("target"), F.lit("DB_LINK").alias("rtype"), F.lit(False).alias("resolved"), none.alias("target_key"), F.concat(F.lit("link="), F.col("z.b")).alias("detail"))
    uses = F.concat(*(tx.extract_all("c", p, 1) for p in TABLE_USES))
    tables = progs.select("src", F.explode(uses).alias("x")).where(~F.col("x").contains("@")).select("src", base(F.col("x")).alias("target")).where((F.col("target") != "") & ~F.col("target").isin(*NO_TABLE))
    tables = tables.join(pick(("TABLE", "VIEW", "MATERIALIZED_VIEW"), first), "target", "left").select("src", "target", F.lit("TABLE").alias("rtype"), F.col("target_key").isNotNull().alias("resolved"), "target_key", none.alias("detail"))
    dotted = progs.select("src", "self", "otype", F.explode(pair(rf"\b({tx.IDENT})\s*\.\s*({tx.IDENT})")).alias("z")).select("src", "self", "otype", F.upper("z.a").alias("a"), F.upper("z.b").alias("b"))
    vendor, seq = F.col("a").startswith("DBMS_") | F.col("a").startswith("UTL_"), F.col("b").isin("NEXTVAL", "CURRVAL")
    builtin = dotted.where(vendor).select("src", F.concat_ws(".", "a", "b").alias("target"), F.lit("BUILTIN").alias("rtype"), F.lit(False).alias("resolved"), none.alias("target_key"), F.col("a").alias("detail"))
    sequence = dotted.where(~vendor & seq).select("src", F.col("a").alias("target"), F.lit("SEQUENCE").alias("rtype"), F.lit(False).alias("resolved"), none.alias("target_key"), none.alias("detail"))
    packages = pick(("PACKAGE", "PACKAGE_BODY"), F.max_by("key", F.struct(F.col("otype") == "PACKAGE_BODY", "path", "start")))
    own = F.col("otype").isin("PACKAGE", "PACKAGE_BODY") & (F.col("a") == F.col("self"))
    package = dotted.where(~vendor & ~seq & ~own).join(packages.withColumnRenamed("target", "a"), "a").select("src", F.col("a").alias("target"), F.lit("PACKAGE").alias("rtype"), F.lit(True).alias("resolved"), "target_key", F.concat(F.lit("member="), "b").alias("detail"))
    # A name before ( or ; as it is written, matched by token instead of every unit against every name.
    called = rel.containment(progs, "src", tx.extract_all("c", r"(?<![\w])([\w$#]+)\s*[(;]", 1), pick(("PROCEDURE", "FUNCTION"), first), "target")
    call = called.join(pick(("PROCEDURE", "FUNCTION"), first), "target").join(progs.select("src", "self"), "src").where("target <> self").select("src", "target", F.lit("CALL").alias("rtype"), F.lit(True).alias("resolved"), "target_key", none.alias("detail"))
    by_display = objs.groupBy(F.col("display").alias("object")).agg(F.max_by(F.struct("key", "is_program"), F.struct("path", "start")).alias("o"))
    by_name = objs.groupBy(F.upper("name").alias("last")).agg(F.max_by(F.struct("key", "is_program"), F.struct("path", "start")).alias("o"))
    g = rel.priority_lookup(granted.withColumn("last", F.element_at(F.split("object", r"\."), -1)), [(by_display, ["object"]), (by_name, ["last"])], "o").where("o.is_program")
    grant = g.select(F.col("o.key").alias("src"), F.col("grantee").alias("target"), F.lit("GRANT").alias("rtype"), F.lit(False).alias("resolved"), none.alias("target_key"), F.concat("privs", F.lit(" TO "), "grantee").alias("detail"))
    every = reduce(DataFrame.unionByName, [link, tables, builtin, sequence, package, call, grant])
    rest = F.min(F.struct("resolved", "target_key", "detail"))
    out = every.groupBy("src", "target", "rtype").agg(F.count(F.lit(1)).alias("count"), rest.alias("r")).select("src", "target", "rtype", "r.resolved", "r.target_key", "r.detail", "count")
    return checkpointed(out)


def _weights(name: str, weights: dict[str, float], default: float) -> F.Column:
    w = F.lit(default)
    for k, v in weights.items():
        w = F.when(F.col(name) == k, float(v)).otherwise(w)
    return w


def band(score: F.Column, config: Scorer) -> F.Column:
    """The first band whose upper bound is above the score."""
    out = F.lit(config.bands[-1][1])
    for bound, name in reversed(config.bands[:-1]):
        out = F.when(score < float(bound), name).otherwise(out)
    return out


def scores(objs: DataFrame, m: DataFrame, refs: DataFrame, config: Scorer | None = None) -> DataFrame:
    """key, display, volume, complexity, dependency, absolute, band, impact, conv_norm, imp_norm, final."""
    config = config or Scorer()
    dep = refs.groupBy(F.col("src").alias("key")).agg(F.sum(F.col("count") * _weights("rtype", config.references, 1.0)).alias("dep"), F.sum(F.when(F.col("rtype") == "GRANT", F.col("count")).otherwise(0)).alias("grants"))
    calls = refs.where(F.col("rtype").isin("CALL", "PACKAGE") & F.col("resolved")).groupBy(F.col("target_key").alias("key")).agg(F.count_if(F.col("rtype") == "CALL").alias("call_in"), F.count_if(F.col("rtype") == "PACKAGE").alias("package_in"), F.array_sort(F.collect_set("src")).alias("callers"))
    rows = objs.where("is_program").select("key", "display", "name", "owner", "otype", "path", "start", (F.col("start") + F.size("lines") - 1).alias("stop")).join(m, "key")
    rows = rel.lookup_default(rows, dep, ["key"], {"dep": 0.0, "grants": 0}).join(calls, "key", "left")
    cx = sum((F.col(k) * float(v) for k, v in config.complexity.items()), F.lit(0.0))
    a, b, c = config.composite
    rows = rows.withColumns({"v": a * F.col("loc") / config.loc_divisor, "x": b * cx, "y": c * F.col("dep"), "impact": F.round(sum((F.coalesce(k, F.lit(0)) * float(v) for k, v in config.impact.items()), F.lit(0.0)), 2)})
    whole = F.col("v") + F.col("x") + F.col("y")
    rows = checkpointed(rows.withColumns({"band": band(whole, config), "absolute": F.round(whole, 2)}))
    normal = {"rank": rk.strict_ranks, "minmax": rk.minmax}[config.normalisation](rk.long_form(rows, "key", ["absolute", "impact"]), "key")
    normal = normal.groupBy("key").agg(F.max(F.when(F.col("metric") == "absolute", F.col("score"))).alias("cn"), F.max(F.when(F.col("metric") == "impact", F.col("score"))).alias("im"))
    w = config.final_weights
    final = F.sqrt(F.col("cn") * F.col("im")) if config.final_mode == "geometric" else (w[0] * F.col("cn") + w[1] * F.col("im")) / ((w[0] + w[1]) or 1.0)
    return rows.join(normal, "key").select(
        "key", "display", "name", "owner", "otype", "path", "start", "stop", "loc", "cyclomatic", F.round("v", 2).alias("volume"), F.round("x", 2).alias("complexity"), F.round("y", 2).alias("dependency"), "absolute", "band", "impact",
        F.coalesce("callers", F.array().cast("array<string>")).alias("callers"), F.round("cn", 1).alias("conv_norm"), F.round("im", 1).alias("imp_norm"), F.round(final, 1).alias("final"),
    )


def matched_samples(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, hours): a sample's key is a key, a display name or a bare name, in this order; of
    several objects the one of greatest absolute score; the greatest hours of an object."""
    s = samples.select(F.upper(F.col("key")).alias("k"), "hours")
    tiers = [rows.groupBy(F.upper(F.col(c)).alias("k")).agg(F.max_by("key", F.struct("absolute", F.col("key"))).alias("hit")) for c in ("key", "display", "name")]
    found = rel.priority_lookup(s, [(t, ["k"]) for t in tiers], "hit")
    return found.where("hit is not null").groupBy(F.col("hit").alias("key")).agg(F.max("hours").alias("hours"))


def effort(rows: DataFrame, samples: DataFrame, config: Scorer | None = None, feature: str = "absolute") -> DataFrame:
    """key, p50, p90, basis, measured for every program; null where nothing can be said."""
    config = config or Scorer()
    known = matched_samples(samples, rows)
    f = rows.select("key", "band", "imp_norm", F.greatest(F.col(feature).cast("double"), F.lit(0.1)).alias("x")).join(known, "key", "left")
    bands = f.where("hours is not null").groupBy("band").agg(F.avg("hours").alias("b50"), F.when(F.count(F.lit(1)) >= 4, F.percentile("hours", 0.9)).otherwise(F.avg("hours") * config.p90_multiplier).alias("b90"))
    fit = f.where("hours is not null").agg(*st.ols("hours", "x"), F.avg(F.col("hours") / F.col("x")).alias("ratio"))
    j = f.join(bands, "band", "left").join(F.broadcast(fit))  # one row
    line = F.greatest(F.col("intercept") + F.col("slope") * F.col("x"), F.lit(0.1))
    fitted = F.when(F.col("slope").isNotNull(), line)
    base = {"band": F.coalesce("b50", fitted), "ratio": F.col("ratio") * F.col("x")}.get(config.effort_method, fitted)
    by_band = F.lit(config.effort_method == "band") & F.col("b50").isNotNull()
    basis = F.when(F.col("hours").isNotNull(), "measured").when(by_band, F.concat(F.lit("band "), "band")).when(base.isNotNull(), F.lit("ratio" if config.effort_method == "ratio" else "linear")).otherwise("none")
    more = 1 + config.overhead_pct / 100
    p50 = base * more
    p90 = F.when(by_band, F.col("b90") * more).otherwise(p50 * config.p90_multiplier) * (1 + config.impact_buffer * F.col("imp_norm") / 100)
    one = lambda c: F.round(F.coalesce("hours", c), 1)
    return j.select("key", "band", one(p50).alias("p50"), one(F.greatest(p90, p50)).alias("p90"), basis.alias("basis"), F.col("hours").alias("measured"))


def effort_summary(estimates: DataFrame, config: Scorer | None = None) -> DataFrame:
    """Totals and confidence: HIGH from 8 samples in 3 bands, MEDIUM from 3 samples."""
    config = config or Scorer()
    r = estimates.agg(F.sum("p50").alias("a"), F.sum("p90").alias("b"), F.count("measured").alias("n"), F.count_distinct(F.when(F.col("measured").isNotNull(), F.col("band"))).alias("k"))
    level = F.when((F.col("n") >= 8) & (F.col("k") >= 3), "HIGH").when(F.col("n") >= 3, "MEDIUM").otherwise("LOW")
    total = lambda c: F.round(F.coalesce(c, F.lit(0.0)) + config.fixed_hours, 1)
    return r.select(total("a").alias("total_p50"), total("b").alias("total_p90"), F.col("n").alias("n_samples"), level.alias("confidence"))


def object_table(rows: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """objects.csv: twenty columns for each program; effort is empty without estimates."""
    none = F.lit(None).cast("double")
    e = rows.select("key", none.alias("p50"), none.alias("p90"), F.lit("").alias("basis")) if estimates is None else estimates.select("key", "p50", "p90", "basis")
    return rows.join(e, "key", "left").select(
        F.col("key").alias("KEY"), F.coalesce("owner", F.lit("")).alias("OWNER"), F.col("name").alias("NAME"), F.col("otype").alias("TYPE"), F.col("path").alias("FILE"), (F.col("start") + 1).alias("START_LINE"),
        (F.col("stop") + 1).alias("END_LINE"), F.col("loc").alias("LOC"), F.col("cyclomatic").alias("CYCLOMATIC"), F.col("volume").alias("VOLUME"), F.col("complexity").alias("COMPLEXITY"),
        F.col("dependency").alias("DEPENDENCY"), F.col("absolute").alias("ABSOLUTE"), F.col("band").alias("BAND"), F.col("impact").alias("IMPACT"), F.size("callers").alias("FAN_IN"),
        F.col("final").alias("FINAL_SCORE"), F.col("p50").alias("EFFORT_P50"), F.col("p90").alias("EFFORT_P90"), F.col("basis").alias("EFFORT_BASIS"),
    )


def reference_table(refs: DataFrame) -> DataFrame:
    """references.csv: seven columns."""
    return refs.select(
        F.col("src").alias("SRC_KEY"), F.col("rtype").alias("REF_TYPE"), F.col("target").alias("TARGET"), F.when(F.col("resolved"), "Y").otherwise("N").alias("RESOLVED"),
        F.coalesce("target_key", F.lit("")).alias("TARGET_KEY"), F.col("count").alias("COUNT"), F.coalesce("detail", F.lit("")).alias("DETAIL"),
    )


def referenced(refs: DataFrame) -> DataFrame:
    """(src, rtype, targets): the targets of each kind in order, with a mark where they are resolved
    and the number of uses where it is above 1."""
    shown = F.concat("target", F.when(F.col("resolved"), "✓").otherwise(""), F.when(F.col("count") > 1, F.concat(F.lit("×"), F.col("count").cast("string"))).otherwise(""))
    held = F.array_sort(F.collect_list(F.struct("target", shown.alias("shown"))))
    return refs.groupBy("src", "rtype").agg(F.array_join(F.transform(held, lambda x: x["shown"]), ", ").alias("targets"))


def report(spark: SparkSession, rows: DataFrame, refs: DataFrame, path: str, estimates: DataFrame | None = None, config: Scorer | None = None) -> None:
    """Markdown for people: bands, the ranked objects, hubs, links between objects and the
    references of each, what each score is made of, what the scan covers, and effort if there are
    estimates.  Written piece by piece."""
    ranked = rows.orderBy(F.col("final").desc(), "path", "start")
    hubs = rows.where("impact > 0").orderBy(F.col("impact").desc(), F.col("final").desc()).limit(3).select("display", "impact")
    inside = refs.where("resolved and target_key is not null and rtype in ('CALL', 'PACKAGE')").select("src", "rtype", "target_key").distinct().orderBy("src", "target_key")
    whole = ranked.select("display", "loc", "volume", "complexity", "dependency", "absolute", "conv_norm", "impact", "imp_norm", "final", F.array_join("callers", ", ").alias("callers"))
    covered = refs.groupBy("rtype").agg(F.count(F.lit(1)).alias("references"), F.sum("count").alias("uses"), F.count_if("resolved").alias("resolved")).orderBy("rtype")
    parts = [
        ("1. Summary", rows.groupBy("band").agg(F.count(F.lit(1)).alias("objects"), F.sum("loc").alias("loc"), F.round(F.avg("final"), 1).alias("mean final")).orderBy("band")),
        ("2. Objects", ranked.select("display", "otype", "loc", "cyclomatic", "absolute", "band", "impact", "final")), ("3. Hubs", hubs), ("4.1 Links between objects", inside),
        ("4.2 References (✓: resolved in the scan)", referenced(refs).orderBy("src", "rtype")), ("5. What the scores are made of", whole), ("6. Coverage", covered),
    ]
    if estimates is not None:
        known = estimates.drop("band").join(rows.select("key", "display", "band", "final", "path", "start"), "key").orderBy(F.col("final").desc(), "path", "start").select("display", "band", "final", "p50", "p90", "basis")
        parts += [("7. Effort", known), ("Total effort", effort_summary(estimates, config))]

    def pieces() -> Iterator[str]:
        yield "# SQL folder\n"
        for title, df in parts:
            yield f"\n## {title}\n\n"
            yield from files.markdown_pieces(df)

    files.write_text(spark, path, pieces())
