"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Sources, in code point order with null last, weigh 5, 2, 1, repeating, and share the size of
all documents; a target stops at ``MOST`` = 3 times its source's size and the excess goes to
the other sources by weight until none is above.  A source with target t and size s gives
floor(t / s) certain whole copies of each document.  The rest, t - floor(t / s) * s words, is a
Pareto sample of fixed size in words: a document's inclusion probability is
p = min(1, c * sqrt(its words)), with c such that the words times p add up to the rest; it has
random odds u / (1 - u) and inclusion odds p / (1 - p), and the smallest ratios are taken until
the words reach the rest.

c comes from the counts of each source's sizes, in whole numbers, so it is exact.  The cut
through the order is found without sorting a source in one task: ranks fall into
``BINS`` bins, whose sizes are summed; the bin with the cut is divided again, and only the
ranks of that second bin are summed one by one.

Randomness is an MD5 of doc_id, text digest and seed, so reruns agree.  Rows alike in doc_id,
text and source share a rank; where the cut falls among them, as many of them are taken as bring
the words nearest the rest.  They are counted, not numbered, so a third of all rows may be alike.
Defined results: a null text has size 0; a source of size 0 has target 0 and gives nothing; an
empty table gives no rows; columns of any name pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.llm.common import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 1024
#: Rows of a table of sources up to which it is broadcast.
SMALL = 100_000
SEED = 42
#: Square roots of sizes are counted in whole steps of 1 / STEP.
STEP = 1024
#: The place of a document that is certain (p = 1) is its u times this: before nearly all others.
CERTAIN = 2.0**-30
#: Alike rows that one row of their count is expanded to at most.
RUN = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> F.Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sid, source, source_size, target, and the source's copies and rest.  sizes: source, source_size.

    A source is full when the level (what is left by weight) passes MOST * size / weight; in
    the order of that ratio the full sources come first.  There is a row for each source, so
    the two windows over all rows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("sid", F.row_number().over(order))
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") - 1) % len(WEIGHTS) + 1).cast("double"))
    ratio = Window.orderBy((F.col("source_size") * float(MOST) / F.col("weight")), F.col("source").asc_nulls_last())
    before, every = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every).cast("double")
    gone = F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * MOST
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", (total - gone) / weight).withColumn("full", F.col("level") * F.col("weight") > F.col("source_size") * float(MOST))
    # The level that holds is the first at which the source isn't full; if every one is, none is needed.
    held = level.withColumn("held", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") * float(MOST) / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"])
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("source_size") * float(MOST), F.coalesce(F.col("held") * F.col("weight"), F.col("source_size") * float(MOST))))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return held.withColumn("target", target).withColumn("copies", F.floor(share)).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).select("sid", "source", "source_size", "target", "copies", "rest")


def uniform(*cols: F.Column) -> F.Column:
    """A repeatable number in (0, 1) from an MD5 of the columns."""
    digest = F.md5(F.concat_ws(":", F.lit(str(SEED)), *cols).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _small(df: DataFrame) -> DataFrame:
    """A written table with a row for each source: broadcast if it is counted as small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _bin(place: str, outer: F.Column | None = None) -> F.Column:
    """The bin of a place in [0, 1), or within an outer bin the place's inner bin."""
    place = F.col(place) * float(BINS)
    return F.floor(place) if outer is None else F.floor((place - outer) * float(BINS))


def _cut(level: DataFrame, by: str) -> DataFrame:
    """Of each source: the bin in which the summed words reach the rest, and the words before it."""
    upto = Window.partitionBy("sid").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    run = level.withColumn("sum", F.col("before") + F.sum("words").over(upto))
    met = run.where(F.col("sum") >= F.col("rest")).groupBy("sid").agg(F.min(F.struct(by, (F.col("sum") - F.col("words")).alias("before"))).alias("c"))
    return met.select("sid", f"c.{by}", "c.before")


def _sized(docs: DataFrame) -> DataFrame:
    """docs with size, root (its square root in whole steps) and u.  docs: doc_id, text and others."""
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")))
    docs = docs.withColumn("size", size_of())
    return docs.withColumns({"root": F.floor(F.sqrt(F.col("size").cast("double")) * float(STEP)), "u": u})


def inclusion(sizes: DataFrame) -> DataFrame:
    """sid and c: a document of root r is included with probability min(1, c * r).  sizes: sid,
    rest, size, root and n (the source's documents of the size; there are as many rows as sizes).

    From the largest size down, c is what is left of the rest without the larger sizes, as if
    those were certain, over the weighted words of the others; the first c that makes nothing
    else certain holds."""
    larger = Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    words, weighted = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("root").cast("decimal(18,0)")
    c = (F.col("rest") - F.coalesce(F.sum(words).over(larger), F.lit(0)).cast("double")) / F.sum(weighted.cast("decimal(38,0)")).over(others).cast("double")
    found = sizes.where("size > 0").withColumn("c", c).where(F.col("c") * F.col("root") <= 1)
    return found.groupBy("sid").agg(F.max_by("c", "size").alias("c"))


def _place() -> F.Column:
    """The monotone place in (0, 1) of random odds by inclusion odds, of u, c and root.  A document
    of size 0 has no place."""
    p = F.col("c") * F.col("root")
    ratio = F.col("u") / (1 - F.col("u")) * ((1 - p) / p)
    return F.when(F.col("size") <= 0, None).when(p >= 1, F.col("u") * CERTAIN).otherwise(ratio / (1 + ratio))


def _with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (source, size, root, u and others) with their source's goal and their place."""
    names = ("sid", "source_size", "target", "copies", "rest", "c")
    rows = rows.alias("d").join(_small(goals).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    return rows.select("d.*", *(f"g.{c}" for c in names)).withColumn("place", F.when(F.col("rest") > 0, _place()))


def _plan(scratch: Scratch, sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The goals and the cuts, each with a row for each source.  sized: source, size, root, u."""
    counts = scratch.write(sized.groupBy("source", "size", "root").agg(F.count(F.lit(1)).alias("n")), "counts")
    goals = scratch.write(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    known = counts.alias("d").join(_small(goals).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("g.sid", "g.rest", "d.size", "d.root", "d.n")
    goals = scratch.write(goals.join(inclusion(known.where("rest > 0")), "sid", "left"), "goals")
    drawn = _with_goals(sized.select("source", "size", "root", "u"), goals).where("place is not null").withColumn("bin", _bin("place"))
    outer = drawn.groupBy("sid", "rest", "bin").agg(F.sum("size").alias("words")).withColumn("before", F.lit(0).cast("long"))
    outer = scratch.write(_cut(outer, "bin"), "outer")
    near = drawn.join(_small(outer), ["sid", "bin"]).withColumn("inner", _bin("place", F.col("bin")))
    inner = near.groupBy("sid", "rest", "before", "inner").agg(F.sum("size").alias("words"))
    inner = scratch.write(_cut(inner, "inner"), "inner")
    # Rows of one place and size are one rank; the edge is the rank in which the words reach the rest.
    ranks = near.drop("before").join(_small(inner), ["sid", "inner"]).groupBy("sid", "rest", "before", "place", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("sid").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranks.withColumn("sum", F.col("before") + F.sum(F.col("size") * F.col("n")).over(upto)).where("sum >= rest")
    edge = ranks.groupBy("sid").agg(F.min(F.struct("place", "size", "n", "sum", "rest")).alias("e")).select("sid", "e.*")
    most = F.floor((F.col("rest") - (F.col("sum") - F.col("size") * F.col("n"))) / F.col("size") + 0.5)
    edge = edge.select("sid", F.col("place").alias("edge"), F.col("size").alias("edge_size"), F.least("n", F.greatest(F.lit(0), most)).cast("long").alias("fit"))
    return goals, scratch.write(edge, "cuts")


def _drawn(rows: DataFrame, goals: DataFrame, cuts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of rows with copies, the certain ones and one more before the source's
    cut.  Rows at the cut itself are counted by their columns keep, taken in the order of a
    hash of them until as many are as fit, and expanded again."""
    joined = _with_goals(rows, goals).join(_small(cuts), "sid", "left")
    before = (F.col("place") < F.col("edge")) | ((F.col("place") == F.col("edge")) & (F.col("size") < F.col("edge_size")))
    at = F.coalesce((F.col("place") == F.col("edge")) & (F.col("size") == F.col("edge_size")), F.lit(False))
    # Without an edge the words never reach the rest, which then is all of them.
    more = F.when(F.col("place").isNull(), 0).when(F.col("edge").isNull() | before, 1).otherwise(0)
    plain = joined.where(~at).select(*keep, (F.col("copies") + more).cast("long").alias("copies"))
    alike = joined.where(at).groupBy("sid", "fit", "copies", *keep).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("sid").orderBy(F.xxhash64(*keep), *keep).rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("extra", F.least("n", F.greatest(F.lit(0), F.col("fit") - F.coalesce(F.sum("n").over(order), F.lit(0)))))
    runs = []
    for number, times in ((F.col("extra"), F.col("copies") + 1), (F.col("n") - F.col("extra"), F.col("copies"))):
        runs.append(alike.where(number > 0).select(*keep, times.cast("long").alias("copies"), number.alias("number")))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1, F.lit(RUN).cast("long"))).alias("from")
    parts = runs[0].unionByName(runs[1]).select("*", first).repartition("from")
    each = parts.select(*keep, "copies", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN, "number") - 1)).alias("nth"))
    return plain.unionByName(each.drop("nth"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (a row's number of times) for every
    row of docs.  The words are counted once, into a table in the shared folder."""
    scratch = Scratch(spark, "mixing")
    sized = scratch.write(_sized(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    rows = _drawn(sized, *_plan(scratch, sized), ["doc_id", "size", "source_size", "target"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as the mix takes it.  The cuts
    are joined to the documents, a row for each source, so no text is shuffled but that of rows
    at a cut."""
    scratch = Scratch(spark, "mixed")
    sized = scratch.write(_sized(docs.select("doc_id", "source", "text")).select("source", "size", "root", "u"), "sized")
    rows = _sized(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")))
    rows = _drawn(rows, *_plan(scratch, sized), ["row"]).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - (coalesce(sum(source_size) OVER o, 0))::DOUBLE * {MOST}) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size * {MOST}.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT arg_min(level, source_size * {MOST}.0::DOUBLE / weight) AS held FROM l WHERE NOT level * weight > source_size * {MOST}.0::DOUBLE
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(source_size * {MOST}.0::DOUBLE, coalesce(held * weight, source_size * {MOST}.0::DOUBLE)) END AS target FROM w, h
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), n AS (
  SELECT z.source, z.size, floor(sqrt(z.size::DOUBLE) * {STEP})::BIGINT AS root, count(*) AS n, any_value(g.target - g.copies * g.source_size) AS rest
  FROM sized z JOIN g ON z.source IS NOT DISTINCT FROM g.source WHERE z.size > 0 GROUP BY ALL
), i AS (
  SELECT source, arg_max(c, size) AS c FROM (
    SELECT source, size, root, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum((n * size)::HUGEINT * root) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c FROM n WHERE rest > 0
  ) WHERE c * root <= 1 GROUP BY source
), d AS (
  SELECT z.doc_id, z.size, z.source, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size AS rest, z.u, i.c * floor(sqrt(z.size::DOUBLE) * {STEP}) AS p
  FROM sized z JOIN g ON z.source IS NOT DISTINCT FROM g.source LEFT JOIN i ON z.source IS NOT DISTINCT FROM i.source
), q AS (
  SELECT *, u / (1 - u) * ((1 - p) / p) AS ratio FROM d
), p AS (
  SELECT * EXCLUDE (ratio), CASE WHEN size > 0 AND rest > 0 THEN CASE WHEN p >= 1 THEN u * {CERTAIN!r}::DOUBLE ELSE ratio / (1 + ratio) END END AS place FROM q
), r AS (
  SELECT source, place, size, rest, count(*) AS n FROM p WHERE place IS NOT NULL GROUP BY ALL
), c AS (
  SELECT *, sum(size * n) OVER (PARTITION BY source ORDER BY place, size ROWS UNBOUNDED PRECEDING) AS upto FROM r
), e AS (
  SELECT source, first(place ORDER BY place, size) AS edge, first(size ORDER BY place, size) AS edge_size,
    first(least(n, greatest(0, floor((rest - (upto - size * n)) / size + 0.5)))::BIGINT ORDER BY place, size) AS fit
  FROM c WHERE upto >= rest GROUP BY source
), k AS (
  SELECT p.*, e.edge, e.edge_size, e.fit, row_number() OVER (PARTITION BY p.source, p.place, p.size ORDER BY hash(p.doc_id)) AS nth
  FROM p LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN place IS NULL THEN 0 WHEN edge IS NULL OR place < edge OR place = edge AND (size < edge_size OR size = edge_size AND nth <= fit) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""
