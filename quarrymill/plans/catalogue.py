"""The query catalogue: each operator over the star-schema and text tables, with the SQL that
says the same.  A query reads only the columns it needs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.config import Pipeline, Scorer
from quarrymill.functions import text as tx
from quarrymill.operators import graph as gr
from quarrymill.operators import patch as pt
from quarrymill.operators import rank as rk
from quarrymill.operators import relational as rel
from quarrymill.operators import stats as st
from quarrymill.plans import scoring, sqlfolder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers f(t), t(name) being a table, under the function's name."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Scans, filters and projections


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def scan_filter_isin(t):
    """Target and type filters (OP-FLT-01, OP-FLT-02, OP-FLT-08, OP-FLT-10)."""
    return t("orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F') GROUP BY 1")
def negated_membership(t):
    """Negated membership (OP-FLT-07)."""
    return rel.value_counts(t("orders").where(~F.col("o_orderstatus").isin("F")), "o_orderpriority")


@query("""
SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, '(?:1$)|(?:^Part 2)|(?:7)') THEN 'Y' ELSE 'N' END AS excluded FROM part
""")
def regex_exclude_split(t):
    """Split by an OR of name patterns (OP-FLT-03)."""
    kept, gone = rel.split_by_patterns(t("part").select("p_partkey", "p_name"), "p_name", ["1$", "^Part 2", "7"])
    return kept.withColumn("excluded", F.lit("N")).unionByName(gone.drop("EXCLUDE_REASON").withColumn("excluded", F.lit("Y")))


@query("""
SELECT doc_id, count(*) FILTER (WHERE trim(line, chr(9) || chr(10) || chr(13) || ' ') <> '' AND NOT starts_with(trim(line, chr(9) || chr(10) || chr(13) || ' '), 'The')) AS loc, count(*) AS lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id
""")
def code_line_count(t):
    """Code lines of each body (OP-FLT-05, OP-AG-01)."""
    lines = F.split("text", "\n")
    loc = F.size(F.filter(lines, lambda x: tx.is_code_line(x, "The")))
    return t("documents").where("text is not null").select("doc_id", loc.cast("long").alias("loc"), F.size(lines).cast("long").alias("lines"))


@query("""
SELECT lang_clean, source_clean, count(*) AS n FROM (
  SELECT CASE WHEN lower(trim(coalesce(lang, ''))) = 'nan' THEN '' ELSE trim(coalesce(lang, '')) END AS lang_clean,
         CASE WHEN lower(trim(coalesce(source, ''))) = 'nan' THEN '' ELSE trim(coalesce(source, '')) END AS source_clean FROM documents) GROUP BY ALL
""")
def clean_str_norm(t):
    """Text cleaning (OP-TX-01, OP-FLT-04)."""
    return t("documents").groupBy(tx.clean_str("lang").alias("lang_clean"), tx.clean_str("source").alias("source_clean")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\\bthe\\b')) + len(regexp_extract_all(text, '(?i)\\band\\b')) + len(regexp_extract_all(text, '(?i)\\bfor\\b')) AS branches,
  len(regexp_extract_all(text, '(?i)\\bof\\s+the\\b')) AS phrases, CASE WHEN regexp_matches(text, '(?i)\\blicense\\b') THEN 'Y' ELSE 'N' END AS flagged
FROM documents
""")
def regex_metric_counts(t):
    """Counts and flags of constructs (OP-TX-05 to OP-TX-10)."""
    branches = sum((tx.count_word("text", w) for w in ("the", "and", "for")), F.lit(0).cast("long"))
    return t("documents").select("doc_id", branches.alias("branches"), tx.count("text", r"(?i)\bof\s+the\b").alias("phrases"), tx.flag(F.col("text").rlike(r"(?i)\blicense\b")).alias("flagged"))


@query("""
SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(s, '/\\*(.|\\n)*?\\*/', ' ', 'g'), '--[^\\n]*', '', 'g'), '''([^'']|'''')*''', '''''', 'g')) AS n_clean
FROM (SELECT page_id, replace(replace(html, '<!--', '/*'), '-->', '*/') || ' -- it ''s' || chr(10) || 'x ''quo''''ted'' y' AS s FROM pages)
""")
def comment_strip_mask(t):
    """Comment removal and literal masking (OP-TX-02, OP-TX-03, OP-TX-04)."""
    code = F.concat(F.replace(F.replace("html", F.lit("<!--"), F.lit("/*")), F.lit("-->"), F.lit("*/")), F.lit(" -- it 's\nx 'quo''ted' y"))
    return t("pages").select("page_id", F.length(tx.clean_code(code)).cast("long").alias("n_clean"))


@query("""
SELECT doc_id, link, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_$#.]*@([A-Za-z_][A-Za-z0-9_$#]*)\\b', 1)) AS link FROM documents) GROUP BY ALL
""")
def link_token_scan(t):
    """name@link tokens, one row for each match (OP-TX-21, OP-TX-09, OP-AG-02)."""
    return t("documents").select("doc_id", F.explode(tx.db_links("text")).alias("link")).groupBy("doc_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS stmt_seq, length(stmt) AS n_chars FROM (
  SELECT doc_id, i, trim(parts[i]) AS stmt FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), '.') AS parts FROM documents))
) WHERE stmt <> ''
""")
def statement_inventory(t):
    """Statements in order, numbered (OP-TX-14, OP-WN-08)."""
    parts = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\."), lambda s: F.trim(s))
    found = F.filter(parts, lambda s: s != "")
    return t("documents").select("doc_id", F.posexplode(found).alias("i", "s")).select("doc_id", (F.col("i") + 1).cast("long").alias("stmt_seq"), F.length("s").cast("long").alias("n_chars"))


@query("""
SELECT n_nationkey, r_name || CASE WHEN n_nationkey % 2 = 0 THEN '.' || n_name ELSE '' END || '.N' || CASE WHEN n_nationkey % 3 > 0 OR n_nationkey % 2 = 0 THEN '#' || (n_nationkey % 3)::VARCHAR ELSE '' END AS sp_id
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def key_synthesis(t):
    """Program keys (OP-PRJ-01, OP-PRJ-02)."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    package = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    return n.select("n_nationkey", rel.synthesize_key(F.col("r_name"), package, F.lit("N"), F.col("n_nationkey") % 3).alias("sp_id"))


@query("""
SELECT p_partkey, regexp_replace(p_brand || ' ' || p_type, '[^A-Za-z0-9]', '_', 'g') AS node_id, upper(regexp_replace(p_name || '#' || p_size::VARCHAR, '#\\d+$', '')) AS base FROM part
""")
def id_sanitise(t):
    """Identifiers for diagrams and base names (OP-TX-22, OP-TX-30, OP-TX-29)."""
    return t("part").select("p_partkey", tx.safe_id(F.concat_ws(" ", "p_brand", "p_type")).alias("node_id"), tx.strip_overload(F.concat(F.col("p_name"), F.lit("#"), F.col("p_size").cast("string"))).alias("base"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' WHEN o_totalprice < 250000 THEN 'high' ELSE 'very high' END AS band FROM orders
""")
def band_ladder(t):
    """First band whose upper bound is above the score (OP-PRJ-09)."""
    config = Scorer(bands=((50000.0, "low"), (150000.0, "mid"), (250000.0, "high"), (float("inf"), "very high")))
    return t("orders").select("o_orderkey", sqlfolder.band(F.col("o_totalprice"), config).alias("band"))


# Joins


@query("""
SELECT s_suppkey, coalesce(a.v, r.v) AS attr FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN (SELECT n_nationkey AS k, 'nation ' || n_name AS v FROM nation WHERE n_nationkey % 3 = 0) a ON a.k = s_nationkey
LEFT JOIN (SELECT r_regionkey AS k, 'region ' || r_name AS v FROM region WHERE r_regionkey < 4) r ON r.k = n_regionkey
""")
def priority_lookup(t):
    """The private value before the public one (OP-JN-09, OP-JN-24, OP-JN-25, OP-JN-26)."""
    base = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"))
    own = t("nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("nk"), F.concat(F.lit("nation "), "n_name").alias("attr"))
    public = t("region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("rk"), F.concat(F.lit("region "), "r_name").alias("attr"))
    return rel.priority_lookup(base, [(own, ["nk"]), (public, ["rk"])], "attr").select("s_suppkey", "attr")


@query("SELECT c_custkey, coalesce(n, 0) AS n_urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def left_lookup_default(t):
    """Lookup with a default (OP-JN-05, OP-JN-03, OP-JN-21, OP-JN-28)."""
    n = t("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_urgent"))
    return rel.lookup_default(t("customer").select("c_custkey"), n, ["c_custkey"], {"n_urgent": 0})


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'Y' ELSE 'N' END AS big_spender FROM customer")
def semi_flag(t):
    """Y or N by presence (OP-JN-06, OP-JN-07, OP-FLT-06)."""
    side = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.semi_flag(t("customer").select("c_custkey"), side, ["c_custkey"], "big_spender")


@query("""
SELECT p_partkey, coalesce(a.n, 0) + coalesce(b.n, 0) AS refs FROM part
LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.k = p_partkey
LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 5 GROUP BY 1) b ON b.k = p_partkey
""")
def additive_two_source(t):
    """Counts of two sources added up (OP-JN-08)."""
    lines = t("lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return rel.additive_counts(t("part").select("p_partkey"), [lines.where("l_returnflag = 'R'"), lines.where("l_quantity < 5")], ["p_partkey"], "refs")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01')")
def anti_orphans(t):
    """Keys without a partner (OP-JN-10, OP-JN-11, OP-JN-12, OP-JN-22)."""
    side = t("orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp_ntz'2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.anti(t("customer").select("c_custkey", "c_name"), side, ["c_custkey"])


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_targets, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey)::VARCHAR ELSE 'MULTI' END AS resolved FROM lineitem GROUP BY 1")
def fanout_single_else_agg(t):
    """One target, or the aggregate (OP-JN-16, OP-JN-17)."""
    return rel.single_else(t("lineitem"), "l_orderkey", "l_suppkey", "MULTI")


@query("""
SELECT user_id, event_id AS slice_start, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slice_end FROM events WHERE event_type = 'signup'
""")
def range_slice(t):
    """Slices to the row before the next start (OP-WN-05, OP-WN-06)."""
    e = t("events").where("event_type = 'signup'").select("user_id", "event_id")
    return rel.slices(e, ["user_id"], "event_id", F.lit(True)).select("user_id", "slice_start", "slice_end")


@query("""
SELECT user_id, slice, count(*) AS n_events FROM (
  SELECT user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS slice FROM events
) GROUP BY ALL
""")
def range_join_as_fill(t):
    """Rows between a start and the next, without a range join (OP-JN-13, OP-JN-15, OP-WN-07)."""
    e = t("events").select("user_id", "ts", "event_id", "event_type")
    filled = rel.assign_slice(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "slice")
    return filled.groupBy("user_id", "slice").agg(F.count(F.lit(1)).alias("n_events"))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM documents)
SELECT word, count(*) AS n_docs FROM d JOIN w USING (word) GROUP BY word
""")
def theta_containment(t):
    """Names that stand in texts, by an equi-join on tokens (OP-JN-18, OP-JN-19, OP-JN-27)."""
    tokens = tx.extract_all(F.lower("text"), "[a-z]{9,}")
    names = t("benchmark").select(F.explode(tokens).alias("word"))
    return rel.containment(t("documents"), "doc_id", tokens, names, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""
SELECT c_custkey, c_name, n_name, r_name, coalesce(o.n_orders, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey
""")
def wide_left_join(t):
    """Chained left joins to a wide table (OP-JN-04, OP-JN-01, OP-JN-02, OP-PRJ-03, OP-PRJ-04)."""
    c = t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nk"))
    n = t("nation").select(F.col("n_nationkey").alias("nk"), "n_name", F.col("n_regionkey").alias("rk"))
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    wide = rel.wide_join(rel.wide_join(c, [(n, "_N")], "nk"), [(t("region").select(F.col("r_regionkey").alias("rk"), "r_name"), "_R")], "rk")
    return rel.lookup_default(wide.select("c_custkey", "c_name", "n_name", "r_name"), o, ["c_custkey"], {"n_orders": 0})


@query("""
SELECT ok, count(*) AS n FROM (
  SELECT CASE WHEN c_nationkey = s_nationkey THEN 'Y' WHEN (c_nationkey + s_nationkey) % 7 = 0 THEN 'Y' ELSE 'N' END AS ok
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1
""")
def grant_check_tristate(t):
    """Same side, or granted, or not (OP-JN-20)."""
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = j.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    allowed = pairs.where((F.col("c_nationkey") + F.col("s_nationkey")) % 7 == 0)
    checked = rel.tristate(pairs, allowed, ["c_nationkey", "s_nationkey"], F.col("c_nationkey") == F.col("s_nationkey"), "ok")
    return checked.groupBy("ok").agg(F.sum("c").cast("long").alias("n"))


@query("""
WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey)::VARCHAR AS key, a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_orderstatus AS sa, b.o_orderstatus AS sb, a.o_orderpriority AS pa, b.o_orderpriority AS pb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT CASE WHEN ka IS NULL THEN 'NEW' ELSE 'REMOVED' END AS kind, key, NULL::VARCHAR AS "column", NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM j WHERE ka IS NULL OR kb IS NULL
UNION ALL SELECT 'CHANGED', key, 'o_orderstatus', sa, sb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND sa IS DISTINCT FROM sb
UNION ALL SELECT 'CHANGED', key, 'o_orderpriority', pa, pb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND pa IS DISTINCT FROM pb
""")
def snapshot_diff(t):
    """New, removed and changed rows of two snapshots (OP-JN-23)."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    old = o.where("o_orderdate < timestamp_ntz'1999-01-01'")
    new = o.where("o_orderdate >= timestamp_ntz'1996-01-01'").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderpriority")))
    return rel.snapshot_diff(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


# Aggregates


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, src FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY src, o_orderkey) AS rn FROM (
    SELECT o_custkey, o_orderpriority, o_orderkey, 1 AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, 2 FROM orders WHERE o_orderstatus = 'O')) WHERE rn = 1
""")
def dedup_first_wins(t):
    """The first of each key over a union (OP-AG-05, OP-AG-06, OP-SET-01)."""
    o = t("orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    both = o.where("o_orderstatus = 'F'").withColumn("src", F.lit(1)).unionByName(o.where("o_orderstatus = 'O'").withColumn("src", F.lit(2))).drop("o_orderstatus")
    return rel.first_wins(both, ["o_custkey", "o_orderpriority"], ["src", "o_orderkey"])


@query("""
SELECT p_type, p_size, count(*) AS n_rows, count(DISTINCT p_brand) AS n_values, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS value_list FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) >= 2
""")
def having_collision(t):
    """Names under several owners (OP-AG-03, OP-AG-16)."""
    return rel.collisions(t("part"), ["p_type", "p_size"], "p_brand")


@query("SELECT user_id, min(event_type) AS least_type, arg_min(event_type, event_id) AS first_type, min(event_id) AS first_id FROM events GROUP BY 1")
def min_by_first(t):
    """The least value and the first row's value (OP-AG-04)."""
    return t("events").groupBy("user_id").agg(F.min("event_type").alias("least_type"), F.min_by("event_type", "event_id").alias("first_type"), F.min("event_id").alias("first_id"))


@query("""
SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS n_af, count(*) FILTER (WHERE l_quantity > 25) AS n_big,
  count(*) FILTER (WHERE l_linestatus = 'O') AS n_o FROM lineitem GROUP BY 1
""")
def conditional_counts(t):
    """Counts by type and direction (OP-AG-07, OP-AG-08, OP-FLT-09)."""
    return t("lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("n_af"),
        F.count_if(F.col("l_quantity") > 25).alias("n_big"), F.count_if(F.col("l_linestatus") == "O").alias("n_o"),
    )


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS ratio FROM events GROUP BY 1")
def value_counts_ratio(t):
    """Counts of values and their share (OP-AG-09, OP-AG-10, OP-AG-18)."""
    counts = rel.value_counts(t("events"), "event_type")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("event_type", "n", F.round(F.try_divide("n", "total"), 6).alias("ratio"))  # one row


@query("""
SELECT c_nationkey, c_mktsegment, count(*) AS sp_count, string_agg(c_custkey::VARCHAR, ';' ORDER BY c_custkey::VARCHAR) AS sp_ids, count(*) FILTER (WHERE c_acctbal < 0) AS cut_points FROM customer GROUP BY 1, 2
""")
def roadmap_rollup(t):
    """Groups with a count, sorted ids and a conditional count (OP-AG-12, OP-SO-02, OP-AG-26)."""
    c = t("customer").groupBy("c_nationkey", "c_mktsegment")
    return c.agg(F.count(F.lit(1)).alias("sp_count"), rel.joined_list("c_custkey").alias("sp_ids"), F.count_if(F.col("c_acctbal") < 0).alias("cut_points")).orderBy("c_nationkey", "c_mktsegment")


@query("""
SELECT round(sum(o_totalprice) + 7, 1) AS total_p50, round(sum(o_totalprice * 1.5) + 7, 1) AS total_p90, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_samples,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') >= 8 AND count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') >= 3 THEN 'HIGH' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM orders
""")
def effort_totals(t):
    """Totals and confidence of estimates (OP-AG-11, OP-AG-25)."""
    p = F.col("o_totalprice")
    e = t("orders").select(p.alias("p50"), (p * 1.5).alias("p90"), F.when(F.col("o_orderstatus") == "F", p).alias("measured"), F.col("o_orderpriority").alias("band"))
    return sqlfolder.effort_summary(e, Scorer(fixed_hours=7.0))


@query("SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase')")
def conflict_lint(t):
    """Keys with contradicting values (OP-AG-17)."""
    return rel.containing(t("events"), ["user_id"], "event_type", ["signup", "purchase"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, value::INT) AS n FROM events) WHERE n > 1")
def repeated_rows(t):
    """All rows of repeated keys (OP-AG-15)."""
    e = t("events").select("event_id", "user_id", "event_type", F.expr("cast(rint(value) as int)").alias("v"))
    return rel.repeated_rows(e, ["user_id", "event_type", "v"]).select("event_id", "user_id", "event_type")


@query("SELECT l_suppkey, count(DISTINCT o_custkey) AS n_callers, count(*) AS n_calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def distinct_callers(t):
    """Distinct callers of a target (OP-AG-21)."""
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_suppkey").agg(F.count_distinct("o_custkey").alias("n_callers"), F.count(F.lit(1)).alias("n_calls"))


@query("SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 4.0 WHEN 'signup' THEN 3.0 WHEN 'click' THEN 0.5 ELSE 1.0 END)::DOUBLE AS score, count(*) AS n FROM events GROUP BY 1")
def weighted_by_type(t):
    """Weighted sum by type after a rollup (OP-AG-19, OP-AG-20)."""
    rolled = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = F.when(F.col("event_type") == "purchase", 4.0).when(F.col("event_type") == "signup", 3.0).when(F.col("event_type") == "click", 0.5).otherwise(1.0)
    return rolled.groupBy("user_id").agg(F.sum(F.col("n") * w).alias("score"), F.sum("n").alias("n"))


@query("""
SELECT band, count(*) AS n, round(avg(p), 4) AS mean, round(CASE WHEN count(*) >= 4 THEN quantile_cont(p, 0.9) ELSE avg(p) * 1.5 END, 4) AS p90, round(max(p), 4) AS most FROM (
  SELECT floor(o_totalprice / 50000)::BIGINT AS band, o_totalprice AS p FROM orders) GROUP BY 1
""")
def band_quantile(t):
    """Mean and interpolated quantile by band (OP-AG-22, OP-AG-23)."""
    o = t("orders").select(F.floor(F.col("o_totalprice") / 50000).alias("band"), F.col("o_totalprice").alias("p"))
    p90 = F.when(F.count(F.lit(1)) >= 4, F.percentile("p", 0.9)).otherwise(F.avg("p") * 1.5)
    return o.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("mean"), F.round(p90, 4).alias("p90"), F.round(F.max("p"), 4).alias("most"))


@query("""
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
  round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (regr_count(l_extendedprice, l_quantity) - 2)), 3) AS resid_sd
FROM lineitem GROUP BY 1
""")
def ols_fit(t):
    """Least squares by aggregates (OP-AG-24)."""
    fit = t("lineitem").groupBy("l_returnflag").agg(*st.ols("l_extendedprice", "l_quantity"))
    return fit.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("resid_sd", 3).alias("resid_sd"))


# Ranks and windows

_SUPPLIER = "SELECT l_suppkey, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1"


def _supplier(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query(f"""
WITH s AS ({_SUPPLIER}), r AS (SELECT l_suppkey, 'n' AS metric, n AS v FROM s UNION ALL SELECT l_suppkey, 'q', q FROM s)
SELECT l_suppkey, metric, round(CASE WHEN (SELECT count(DISTINCT v) FROM r r2 WHERE r2.metric = r.metric) <= 1 THEN 50 ELSE
  (rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2) / count(*) OVER (PARTITION BY metric) * 100 END, 6) AS score FROM r
""")
def pct_rank_avg_ties(t):
    """Percentile ranks with averaged ties (OP-WN-01)."""
    return rk.percentile_ranks(rk.long_form(_supplier(t), "l_suppkey", ["n", "q"]), "l_suppkey").withColumn("score", F.round("score", 6))


@query(f"""
WITH s AS ({_SUPPLIER}), r AS (SELECT l_suppkey, 3.0 AS w, n AS v, 'n' AS metric FROM s UNION ALL SELECT l_suppkey, 2.0, q, 'q' FROM s),
p AS (SELECT l_suppkey, w, (rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2) / count(*) OVER (PARTITION BY metric) * 100 AS sc FROM r)
SELECT l_suppkey, round(sum(w * sc) / 5.0, 4) AS composite FROM p GROUP BY 1
""")
def weighted_composite(t):
    """Weighted mean of percentile ranks (OP-WN-02)."""
    ranks = rk.percentile_ranks(rk.long_form(_supplier(t), "l_suppkey", ["n", "q"]), "l_suppkey")
    return rk.weighted_composite(ranks, "l_suppkey", {"n": 3.0, "q": 2.0}, "composite").withColumn("composite", F.round("composite", 4))


@query(f"SELECT l_suppkey, 'q' AS metric, round(percent_rank() OVER (ORDER BY q) * 100, 6) AS score FROM ({_SUPPLIER})")
def strict_rank_norm(t):
    """Share of smaller values (OP-WN-03)."""
    return rk.strict_ranks(rk.long_form(_supplier(t), "l_suppkey", ["q"]), "l_suppkey").withColumn("score", F.round("score", 6))


@query(f"SELECT l_suppkey, 'q' AS metric, round((q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) * 100, 6) AS score FROM ({_SUPPLIER})")
def minmax_norm(t):
    """Place between least and greatest (OP-WN-04)."""
    return rk.minmax(rk.long_form(_supplier(t), "l_suppkey", ["q"]), "l_suppkey").withColumn("score", F.round("score", 6))


@query(f"""
WITH s AS ({_SUPPLIER}), p AS (SELECT l_suppkey, n, q, round(percent_rank() OVER (ORDER BY n) * 100, 2) AS d, round(percent_rank() OVER (ORDER BY q) * 100, 2) AS c FROM s),
x AS (SELECT *, CASE WHEN n % 11 = 0 OR q % 3 >= 2 OR n % 17 = 0 OR d >= 60 AND c >= 60 THEN 'DEFER' WHEN n % 260 <= 50 AND q % 13 <= 3 AND n % 4 = 0 AND q % 5 + (q % 7 = 0)::INT = 0 AND q % 3 = 0 THEN 'AUTO_SIMPLE'
  WHEN n % 260 <= 200 AND q % 13 <= 10 AND n % 4 <= 2 AND q % 5 <= 3 AND q % 7 <> 0 AND q % 3 = 0 THEN 'AUTO_ASSISTED' WHEN n % 4 > 0 THEN 'SEMI' ELSE 'MANUAL' END AS strategy FROM p)
SELECT l_suppkey, CASE WHEN d >= 60 AND c >= 60 THEN 'Q4' WHEN d >= 60 THEN 'Q3' WHEN c >= 60 THEN 'Q2' ELSE 'Q1' END AS quadrant, strategy, abs(d - 60) <= 5 OR abs(c - 60) <= 5 AS boundary,
  round_even((CASE strategy WHEN 'DEFER' THEN 8.0 WHEN 'AUTO_SIMPLE' THEN 0.5 WHEN 'AUTO_ASSISTED' THEN 1.5 WHEN 'SEMI' THEN 3.0 ELSE 5.0 END)::DOUBLE * (1 + c / 100) * 100, 0) / 100 AS effort FROM x
""")
def quadrant_strategy(t):
    """Quadrants, the classifier's chain, boundaries and base effort (OP-PRJ-05 to OP-PRJ-08)."""
    s = _supplier(t)
    ranks = rk.strict_ranks(rk.long_form(s, "l_suppkey", ["n", "q"]), "l_suppkey")
    rank = lambda m: F.round(F.max(F.when(F.col("metric") == m, F.col("score"))), 2)
    rows = ranks.groupBy("l_suppkey").agg(rank("n").alias("D_SCORE"), rank("q").alias("C_SCORE")).join(s, "l_suppkey")
    rows = rows.selectExpr(
        "l_suppkey", "D_SCORE", "C_SCORE", "n % 260 as LOC", "q % 13 as BRANCH", "n % 4 as CURSOR", "q % 5 as DYNAMIC_SQL_LITERAL", "int(q % 7 = 0) as DYNAMIC_SQL_VARIABLE", "int(n % 11 = 0) as AUTONOMOUS_TX",
        "q % 3 as SRC_DB_LINK", "int(n % 17 = 0) as MUTATING_TRIGGER_RISK",
    )
    return scoring.classified(rows, Pipeline()).select("l_suppkey", F.col("QUADRANT").alias("quadrant"), F.col("STRATEGY").alias("strategy"), F.col("IS_BOUNDARY").alias("boundary"), F.col("EFFORT_EST_MD").alias("effort"))


@query("""
WITH r AS (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 5 END AS rk FROM customer),
b AS (SELECT c_nationkey, arg_max(c_mktsegment, rk) AS best FROM r GROUP BY 1)
SELECT c_custkey, best AS c_mktsegment, c_mktsegment <> best AS promoted FROM r JOIN b USING (c_nationkey)
""")
def group_argmax_promote(t):
    """A group's highest rank for all its members (OP-WN-11, OP-WN-12)."""
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return rel.promote(c, "c_nationkey", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]).select("c_custkey", "c_mktsegment", "promoted")


@query("""
WITH m AS (SELECT page_id, regexp_extract_all(html, '<div[^>]*>|<ul>|<nav>|</div>|</ul>|</nav>|<li>', 0, 'i') AS a FROM pages),
k AS (SELECT page_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM m),
s AS (SELECT *, sum(CASE WHEN lower(x) = '<li>' THEN 0 WHEN x LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM k),
z AS (SELECT *, d - least(0, min(d) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM s)
SELECT page_id, coalesce(max(depth) FILTER (WHERE lower(x) = '<li>'), 0)::BIGINT AS max_depth, count(*) FILTER (WHERE lower(x) = '<li>') AS items FROM pages LEFT JOIN z USING (page_id) GROUP BY page_id
""")
def nesting_depth(t):
    """Depth of lists at their items, never below 0 (OP-WN-09)."""
    return t("pages").select("page_id", tx.nesting("html", "<div[^>]*>|<ul>|<nav>", "</div>|</ul>|</nav>", "<li>").alias("s")).select("page_id", F.col("s.most").cast("long").alias("max_depth"), F.col("s.marks").cast("long").alias("items"))


@query("""
SELECT doc_id, 1 + length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(10), '')) AS line, substr(text, greatest(p, 1), 200) AS snippet FROM (SELECT doc_id, text, instr(text, 'token = ') AS p FROM documents)
""")
def position_to_line(t):
    """A position's line number, over the whole text before it, and a snippet there (OP-WN-10, OP-SO-06)."""
    d = t("documents").withColumn("p", F.instr("text", "token = "))
    return d.select("doc_id", F.size(F.split(F.expr("substring(text, 1, p)"), "\n")).cast("long").alias("line"), F.expr("substring(text, greatest(p, 1), 200)").alias("snippet"))


@query(f"SELECT l_suppkey, n, q FROM ({_SUPPLIER}) ORDER BY q DESC, l_suppkey LIMIT 10")
def topk_stable(t):
    """The first ten, ties in order (OP-SO-01, OP-SO-03, OP-SO-04)."""
    return rel.top_k(_supplier(t), [F.col("q").desc(), F.col("l_suppkey")], 10)


@query("SELECT c_nationkey, list_aggregate(list_slice(list_sort(list(DISTINCT c_custkey)), 1, 5)::VARCHAR[], 'string_agg', ';') AS offenders FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def sample_offenders(t):
    """Up to five sorted offenders of a group, as messages name them (OP-SO-05)."""
    bad = t("customer").where("c_acctbal < 0").select("c_nationkey", "c_custkey").distinct()
    first = bad.withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("rn <= 5")
    listed = F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string"))
    return first.groupBy("c_nationkey").agg(F.array_join(listed, ";").alias("offenders"))


# Set operations and overrides


@query("""
SELECT 'new' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'common', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'union', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'orphans', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
""")
def set_ops(t):
    """Union, intersection, difference, orphans (OP-SET-01 to OP-SET-05)."""
    o = t("orders")
    a, b = o.where("o_orderstatus = 'P'").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    orphans = t("part").select("p_partkey").join(t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.subtract(b), "new").unionByName(count(a.intersect(b), "common")).unionByName(count(a.union(b).distinct(), "union")).unionByName(count(orphans, "orphans"))


_PATCH = [(1, "c_acctbal", "100.5", 0), (1, "c_acctbal", "7", 1), (2, "c_nationkey", "3", 2), (3, "c_acctbal", "bad", 3), (4, "nothing", "1", 4), (-5, "c_acctbal", "1", 5)]


@query("""
SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 7.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey = 2 THEN 3 ELSE c_nationkey END AS c_nationkey,
  CASE c_custkey WHEN 2 THEN 'PATCHED' WHEN 6 THEN 'LAST' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey NOT IN (9, 10)
""")
def patch_apply(t):
    """Cells, columns and units by override tables, the last row winning (OP-OV-01, OP-OV-02, OP-OV-03, OP-OV-05, OP-OV-06)."""
    c = t("customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    spark = c.sparkSession
    cells = spark.createDataFrame(_PATCH, "c_custkey long, METRIC_NAME string, VALUE string, _ord int")
    c = pt.patch_cells(c, cells, "c_custkey", ["c_acctbal", "c_nationkey"])
    c = pt.replace(c, spark.createDataFrame([(2, "PATCHED", 0), (6, "FIRST", 1), (6, "LAST", 2)], "c_custkey long, V string, _ord int"), "c_custkey", {"c_mktsegment": "V"})
    acts = spark.createDataFrame([(9, "exclude", "r", 0), (10, "EXCLUDE", "r", 1), (11, "EXCLUDE", "r", 2), (11, "INCLUDE", "r", 3)], "c_custkey long, ACTION string, REASON string, _ord int")
    return pt.include_exclude(c, c.limit(0).withColumn("EXCLUDE_REASON", F.lit("")), acts, "c_custkey")[0]


@query("""
WITH c AS (SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT 'n' || a AS "SRC", 'n' || b AS "DST" FROM c WHERE q > (SELECT avg(q) FROM c))
SELECT "SRC", "DST", 'CALL' AS "EDGE_TYPE", CASE WHEN "SRC" = 'n1' AND "DST" = 'n2' THEN 'LOW' ELSE 'MEDIUM' END AS "EDGE_CONFIDENCE" FROM e WHERE NOT ("SRC" = 'n3' AND "DST" = 'n4')
UNION ALL SELECT 'x', 'y', 'OVERRIDE', 'HIGH'
""")
def edge_overrides(t):
    """Edges added, removed, confirmed and downgraded (OP-OV-04)."""
    e = _trade(t).select(F.concat(F.lit("n"), "a").alias("SRC"), F.concat(F.lit("n"), "b").alias("DST"))
    e = e.withColumn("EDGE_TYPE", F.lit("CALL")).withColumn("EDGE_CONFIDENCE", F.lit("MEDIUM"))
    p = e.sparkSession.createDataFrame([("x", "y", "ADD", 0), ("n3", "n4", "REMOVE", 1), ("n1", "n2", "CONFIRM", 2), ("n1", "n2", "DOWNGRADE", 3)], "SRC string, DST string, ACTION string, _ord int")
    return pt.edge_patch(e, p, {"EDGE_TYPE": F.lit("OVERRIDE"), "EDGE_CONFIDENCE": F.lit("HIGH")})


# Graphs


def _trade(t):
    """Edges (a, b) between nations of more than the mean quantity, over all lineitems."""
    j = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    c = j.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("l_quantity").alias("q"))
    return c.join(F.broadcast(c.agg(F.avg("q").alias("mean")))).where("q > mean").select("a", "b")  # one row


@query("""
WITH c AS (SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT a, b FROM c WHERE q > (SELECT avg(q) FROM c))
SELECT n_nationkey AS node, (SELECT count(*) FROM e WHERE b = n_nationkey) AS fan_in, (SELECT count(*) FROM e WHERE a = n_nationkey) AS fan_out FROM nation
""")
def degree_in_out(t):
    """Degrees over distinct edges (OP-GR-04, OP-GR-10)."""
    return gr.degrees(t("nation").select(F.col("n_nationkey").alias("node")), _trade(t).select(F.col("a").alias("src"), F.col("b").alias("dst")))


_GRAPH = """
p AS (SELECT p_partkey AS k FROM part), e AS (
  SELECT a.k AS src, b.k AS dst FROM p a JOIN p b ON b.k = a.k * 2 UNION SELECT a.k, b.k FROM p a JOIN p b ON b.k = a.k * 3 + 1 UNION SELECT a.k, b.k FROM p a JOIN p b ON a.k % 40 = 0 AND b.k = a.k // 4)
"""


def _graph(t):
    """All parts with edges k to 2k, k to 3k + 1, and 40k back to 10k: cycles and long paths."""
    p = t("part").select(F.col("p_partkey").alias("k"))
    e = p.select(F.col("k").alias("src"), F.explode(F.array(F.col("k") * 2, F.col("k") * 3 + 1, F.when(F.col("k") % 40 == 0, F.expr("k div 4")))).alias("dst"))
    e = e.join(p.select(F.col("k").alias("dst")), "dst").select("src", "dst").distinct()
    return p.select(F.col("k").alias("node")), e


@query(f"""
WITH RECURSIVE {_GRAPH}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
c AS (SELECT k AS node, coalesce((SELECT min(r1.b) FROM r r1 JOIN r r2 ON r1.b = r2.a AND r2.b = r1.a WHERE r1.a = p.k), k) AS m FROM p),
comp AS (SELECT node, least(node, m) AS component FROM c), ce AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN comp x ON x.node = e.src JOIN comp y ON y.node = e.dst WHERE x.component <> y.component),
w(component, wave) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT ce.b, w.wave + 1 FROM w JOIN ce ON ce.a = w.component)
SELECT node, comp.component, (SELECT max(wave) FROM w WHERE w.component = comp.component)::BIGINT AS wave FROM comp
""")
def waves_scc(t):
    """Strongly connected components and waves (OP-GR-05, OP-GR-06)."""
    nodes, edges = _graph(t)
    return gr.waves(gr.strong_components(nodes, edges), edges)


@query()
def betweenness(t):
    """Betweenness (OP-GR-07)."""
    return gr.betweenness(*_graph(t))


@query()
def communities(t):
    """Communities (OP-GR-08)."""
    return gr.communities(*_graph(t))


# Scores and models


@query("""
SELECT round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS z, l_orderkey, l_linenumber FROM lineitem
""")
def standardised(t):
    """Standardised feature (OP-ST-01)."""
    return st.standardise(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]).select(F.round("l_quantity", 6).alias("z"), "l_orderkey", "l_linenumber")


def _model_rows(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("f1"), F.avg("l_discount").alias("f2"), F.avg("l_tax").alias("f3"), F.avg("l_extendedprice").alias("y"))


def _fits(rows, features, kinds):
    """model, term, value: the intercept and coefficients of each kind of model."""
    out = []
    for kind in kinds:
        b, w = st.linear(rows, "y", features, kind)
        out += [(kind, x, round(v, 3)) for x, v in zip(["intercept", *features], [b, *w], strict=True)]
    return out


# The normal equations of two features, with a penalty of 1 by the number of rows on ridge's diagonal.
@query("""
WITH r AS (SELECT avg(l_quantity) AS f1, avg(l_discount) * 100 AS f2, avg(l_extendedprice) AS y FROM lineitem GROUP BY l_suppkey),
m AS (SELECT count(*) AS n, avg(f1) AS a1, avg(f2) AS a2, avg(y) AS ay, var_pop(f1) AS s11, var_pop(f2) AS s22, covar_pop(f1, f2) AS s12, covar_pop(f1, y) AS c1, covar_pop(f2, y) AS c2 FROM r),
k AS (SELECT 'ridge' AS model, 1.0::DOUBLE / n AS p, * FROM m UNION ALL SELECT 'ols', 0.0::DOUBLE, * FROM m),
w AS (SELECT model, a1, a2, ay, (c1 * (s22 + p) - c2 * s12) / ((s11 + p) * (s22 + p) - s12 * s12) AS w1, (c2 * (s11 + p) - c1 * s12) / ((s11 + p) * (s22 + p) - s12 * s12) AS w2 FROM k)
SELECT model, 'intercept' AS term, round(ay - a1 * w1 - a2 * w2, 3) AS value FROM w
UNION ALL SELECT model, 'f1', round(w1, 3) FROM w UNION ALL SELECT model, 'f2', round(w2, 3) FROM w
UNION ALL SELECT 'vif', f, round(1 / (1 - s12 * s12 / (s11 * s22)), 3) FROM m, (VALUES ('f1'), ('f2')) v(f)
""")
def linear_calibration(t):
    """Ridge and least squares of two features, and variance inflation (OP-ST-02, OP-ST-03)."""
    rows, features = _model_rows(t).withColumn("f2", F.col("f2") * 100), ["f1", "f2"]
    out = _fits(rows, features, ("ridge", "ols")) + [("vif", f, x) for f, x in st.vif(rows, features).items()]
    return rows.sparkSession.createDataFrame(out, "model string, term string, value double")


@query()
def ridge_calibration(t):
    """Ridge, lasso and least squares of three features, and variance inflation (OP-ST-02, OP-ST-03)."""
    rows, features = _model_rows(t), ["f1", "f2", "f3"]
    out = _fits(rows, features, ("ridge", "lasso", "ols")) + [("vif", f, x) for f, x in st.vif(rows, features).items()]
    return rows.sparkSession.createDataFrame(out, "model string, term string, value double")


@query()
def bootstrap_p90(t):
    """Bootstrap calibration with P50 and P90 (OP-ST-04, OP-ST-05)."""
    rows = _model_rows(t)
    return st.bootstrap(rows, rows, "l_suppkey", "y", ["f1", "f2", "f3"])


@query("""
WITH r AS (SELECT l_suppkey, count(*) % 40 AS n, avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, sqrt(greatest(regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity), 0) / (count(*) - 2)) AS s FROM lineitem GROUP BY 1 HAVING count(*) > 2),
q AS (SELECT *, n - 2 AS df FROM r),
x AS (SELECT *, CASE WHEN df < 1 THEN 1.282 WHEN df = 1 THEN 3.078 WHEN df = 2 THEN 1.886 WHEN df = 3 THEN 1.638 WHEN df = 4 THEN 1.533 WHEN df = 5 THEN 1.476 WHEN df = 6 THEN 1.440 WHEN df = 7 THEN 1.415 WHEN df = 8 THEN 1.397
  WHEN df = 9 THEN 1.383 WHEN df = 10 THEN 1.372 WHEN df <= 12 THEN 1.356 WHEN df <= 15 THEN 1.341 WHEN df <= 20 THEN 1.325 WHEN df <= 30 THEN 1.310 ELSE 1.282 END::DOUBLE AS t90 FROM q)
SELECT l_suppkey, t90, CASE WHEN n > 2 AND sxx > 0 AND s > 0 THEN round(t90 * s * sqrt(1 + 1.0::DOUBLE / n + (25 - m) * (25 - m) / sxx), 2) END AS half FROM x
""")
def t_quantile_steps(t):
    """Step table of the t quantile and the half-width of a prediction (OP-MA-02)."""
    r = t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.avg("l_quantity").alias("m"), F.regr_sxx("l_extendedprice", "l_quantity").alias("sxx"), *st.ols("l_extendedprice", "l_quantity")).where("rows > 2")
    r = r.withColumn("n", F.col("rows") % 40)
    return r.select("l_suppkey", st.t90(F.col("n") - 2).alias("t90"), F.round(st.half_width(F.lit(25.0), F.col("n"), F.col("m"), F.col("sxx"), F.col("resid_sd")), 2).alias("half"))
