"""SimHash near-duplicates through pivot distance tables.

Each text gets a 64-bit SimHash of its 3-word shingles.  Equal fingerprints are one point;
two points link when at most ``RADIUS`` = 2 bits differ, and linked points form components.

The pivots are reference fingerprints: zero, the 64 with one bit, and eight arbitrary ones.  A
point's row of the pivot distance table holds its Hamming distance to each.  By the triangle
inequality no coordinate of two linked points differs by more than 2.  The difference of a
one-bit pivot's coordinate from zero's depends on one bit, so at most two of these 64
differences change between linked points: dealt into four chunks, two chunks at least stay the
same.  The differences in each of the six pairs of chunks are an equi-join key, and no linked
pair escapes all six.  Pairs that meet are discarded by the maximum difference of the other
coordinates (zero and the arbitrary pivots); survivors are verified on the bits.

A bucket of more than ``BUCKET`` points is divided by further coordinates before any pairing:
the two chunks that aren't in its key are dealt into four again, of which two at least stay
the same.  So keys have 32, 48, 56, 60 and at last 62 coordinates, where four points are the
most that a bucket can have.  There is no cap and no link is lost.

Rows of a key that a count shows as hot (a fingerprint of a third of all texts, a crowded
bucket, the hub of a component) are joined where they are; see ``common.spread_join``.

Defined results: a null or empty text, or one without words, has fingerprint zero and links
like any other; fewer than three words are one shingle; a null doc_id keeps its row, and a
component's id is its smallest doc_id that isn't null (null if there is none).  Ties and repeated
rows share a fingerprint; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.llm.common import Scratch, bounded_batches, hot_bound, spread_join

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Points of a bucket up to which all its pairs are tried.
BUCKET = 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14
#: Pivots beside zero and the one-bit fingerprints.
ARBITRARY = 8
#: Rows of a written table for each of its files, and more in large tables, where there are files
#: enough for every core.  Files are dealt out after the work on their
#: rows, so this doesn't bound how many tasks do it.
FILE, FILES, LARGE = 8_000, 64, 1_000_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(extra: int = ARBITRARY) -> list[int]:
    """Zero, the 64 fingerprints with one bit, and ``extra`` arbitrary ones."""
    return [0, *(1 << i for i in range(64)), *(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(extra))]


def simhash(text: str | None) -> int:
    """The fingerprint: a bit is 1 if over half of the shingles' XXH64 have it."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and blank, \t, \n, \v, \f, \r.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(spark: SparkSession, docs: DataFrame, text: str = "text") -> F.Column:
    """The fingerprint of each whole text, as a signed long."""
    bounded_batches(spark)

    @F.arrow_udf("long")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([_signed(simhash(t)) for t in batch.to_pylist()], pa.int64())

    return run.asNondeterministic()(docs[text])


def distance_table(points: DataFrame) -> DataFrame:
    """fp and its row of the pivot distance table, array<int>."""
    row = ", ".join(f"{_signed(p)}L" if p != 1 << 63 else "shiftleft(1L, 63)" for p in pivots())
    return points.select("fp", F.expr(f"transform(array({row}), p -> bit_count(fp ^ p))").alias("at"))


def _packed(table: DataFrame) -> DataFrame:
    """fp, far (the distances to zero and the arbitrary pivots, 7 bits each) and rest (the one-bit
    pivots' coordinates less zero's, 1 bit each)."""
    rest = "aggregate(sequence(0, 63), 0L, (all, i) -> all | shiftleft(cast((at[0] - at[i + 1] + 1) / 2 as bigint), i))"
    far = " | ".join(f"shiftleft(cast(at[{i}] as bigint), {7 * k})" for k, i in enumerate([0, *range(65, 65 + ARBITRARY)]))
    return table.selectExpr("fp", f"{far} as far", f"{rest} as rest")


def _keys(state: DataFrame, width: int) -> DataFrame:
    """Six rows for each row of state (fp, far, rest, path, key): two of the four chunks of rest's
    width coordinates go to the key, the others stay in rest."""
    size = width // 4
    chunk = [f"(shiftrightunsigned(rest, {i * size}) & {(1 << size) - 1}L)" for i in range(4)]
    made = []
    for k, (a, b) in enumerate(combinations(range(4), 2)):
        c, d = (i for i in range(4) if i not in (a, b))
        key = f"shiftleft(shiftleft(key, {size}) | {chunk[a]}, {size}) | {chunk[b]}"
        made.append(f"named_struct('path', path * 6 + {k}, 'key', {key}, 'rest', shiftleft({chunk[c]}, {size}) | {chunk[d]})")
    return state.selectExpr("fp", "far", f"inline(array({', '.join(made)}))").select("fp", "far", "rest", "path", "key")


def _pairs(met: DataFrame) -> DataFrame:
    """The links among the points of each bucket of at most BUCKET points."""
    held = met.groupBy("path", "key").agg(F.array_sort(F.collect_list(F.struct("fp", "far"))).alias("m"))
    pairs = held.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, BUCKET)).alias("y"))
    apart = ", ".join(f"abs((shiftrightunsigned(x.far, {7 * k}) & 127) - (shiftrightunsigned(y.far, {7 * k}) & 127))" for k in range(1 + ARBITRARY))
    pairs = pairs.where(f"greatest({apart}) <= {RADIUS}").where(f"bit_count(x.fp ^ y.fp) <= {RADIUS}")
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _files(rows: int) -> int:
    return 1 + min(rows // FILE, FILES + rows // LARGE)


def links(spark: SparkSession, points: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """Links (a < b) between points, each once.  points: distinct fp; total: their number."""
    state = scratch.write(_packed(distance_table(points)), "table").withColumns({"path": F.lit(0), "key": F.lit(0).cast("long")})
    width, found = 64, []
    while width >= 4 and total:
        keys = _keys(state, width)
        sizes = scratch.write(keys.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").repartition(_files(total)), f"sizes{width}")
        met = scratch.write(spread_join(keys, sizes, ["path", "key"], "n", 6 * total).repartition(_files(6 * total)), f"met{width}")
        found.append(_pairs(met.where(F.col("n") <= BUCKET)))
        state = met.where(F.col("n") > BUCKET).drop("n")
        total, width = state.count(), width // 2
    every = reduce(DataFrame.unionByName, found) if found else points.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    return scratch.write(every.distinct(), "links")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being the component's smallest
    node; by alternating large and small stars, each round written to the shared folder.
    A hub's rows are joined where they are, not gathered."""
    state, k, count = None, 0, edges.count()
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, ["u"], "n", 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = scratch.write(large.repartition(_files(count)), f"large{k}")
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(down, least, ["u"], "n", down.count()).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = scratch.write(small.distinct().select(F.col("u").alias("b"), F.col("v").alias("a")).repartition(_files(count)), f"small{k}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, k, count = now, k + 1, now[0]
        if k > 1:
            scratch.drop(f"large{k - 2}")
            scratch.drop(f"small{k - 2}")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def classes(spark: SparkSession, docs: DataFrame, carry: list[F.Column] | None = None) -> DataFrame:
    """doc_id, fp, root (the component's smallest fp), component_id and the carried columns for every row of docs.  The result
    reads tables in the shared folder; no text is shuffled."""
    scratch = Scratch(spark, "neardup")
    signed = scratch.write(docs.select("doc_id", fingerprints(spark, docs).alias("fp"), *(carry or ())), "signed")
    rows = signed.count()
    points = scratch.write(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).repartition(_files(rows)), "points")
    total = points.count()
    roots = components(spark, links(spark, points.select("fp"), scratch, total), scratch)
    grouped = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    grouped = scratch.write(grouped.repartition(_files(total)), "grouped")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("points"))
    named = scratch.write(spread_join(grouped, least, ["root"], "points", total).select("fp", "root", "component_id", "n").repartition(_files(total)), "named")
    return spread_join(signed, named, ["fp"], "n", rows).drop("n")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of docs."""
    found = classes(spark, docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (nulls last), among its
    equals the smallest text digest; rows alike in both are one.  Columns of any name pass."""
    missing, digest = F.col("doc_id").isNull(), F.xxhash64("text")
    key = ["missing", "id", "digest"]
    scratch = Scratch(spark, "keep_one")
    found = classes(spark, docs.select("doc_id", "text"), [digest.alias("digest")])
    alike = scratch.write(found.groupBy("root", missing.alias("missing"), "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "alike")
    first = alike.groupBy("root").agg(F.min(F.struct("missing", "doc_id", "digest", "n")).alias("k")).select("k.*")
    text = lambda df: df.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first, bound = text(first).select(*key, "n"), hot_bound(alike.agg(F.sum("n")).first()[0] or 0)
    rows = text(docs.select("doc_id", missing.alias("missing"), digest.alias("digest"), F.struct(*docs.columns).alias("row"))).select(*key, "row")
    # Rows that many others equal stay where they are; the rest is the one shuffle of texts, and
    # the numbering keeps its partitions and order.
    many = rows.join(F.broadcast(first.where(F.col("n") > bound)), key).groupBy(*key).agg(F.first("row").alias("row"))
    few = rows.join(F.broadcast(text(alike.where(F.col("n") > bound)).select(*key)), key, "left_anti").join(first.where(F.col("n") <= bound), key)
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).where("nth = 1")
    return few.select("row.*").unionByName(many.select("row.*"))
