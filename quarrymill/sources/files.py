"""Sources and sinks: dictionary CSVs with fixed types, a family of remote-object files, whole
text files, a folder of SQL scripts, effort samples; single-file CSV, Markdown, Mermaid, SVG
and tagged snapshots.  Paths are Spark paths, so any file system that Spark reads will do."""

from __future__ import annotations

import csv
import io
import subprocess
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.schemas import Contract


def _glob(spark: SparkSession, path: str):
    """The path's file system, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the glob names a file that isn't empty."""
    fs, p = _glob(spark, path)
    found = fs.globStatus(p)
    return bool(found) and any(s.isDirectory() or s.getLen() > 0 for s in found)


def headers(spark: SparkSession, path: str) -> list[str]:
    """A CSV's column names; none if it is missing or empty."""
    return spark.read.csv(path, header=True, escape='"').columns if _exists(spark, path) else []


def read_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """A CSV as the contract has it, by column name; only the empty cell is null.  A missing or
    empty file, like a missing column, gives nulls of the right type or no rows."""
    empty = spark.createDataFrame([], contract.schema)
    if not _exists(spark, path):
        return empty
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cols = {c.lstrip("﻿").strip(): c for c in raw.columns}
    picked = []
    for f in contract.schema:
        c = F.col(f"`{cols[f.name]}`") if f.name in cols else F.lit(None).cast("string")
        number = f.dataType.typeName() != "string"
        picked.append((c.try_cast("double").try_cast(f.dataType) if number else c).alias(f.name))
    return raw.select(*picked)


def read_dictionary(spark: SparkSession, folder: str, contracts: dict[str, Contract]) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{name}.csv", c) for name, c in contracts.items()}


def with_order(df: DataFrame) -> DataFrame:
    """Rows of a small override file with their order, for last-wins rules."""
    rows = df.collect()  # human corrections
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("_ord", T.IntegerType())])
    return df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def remote_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(DB_LINK, OWNER, OBJECT_NAME, OBJECT_TYPE) of all in_remote_objects__{LINK}.csv; files
    without owner and name are passed over, the last file wins for a type."""
    glob = f"{folder}/in_remote_objects__*.csv"
    if not _exists(spark, glob):
        return spark.createDataFrame([], "DB_LINK string, OWNER string, OBJECT_NAME string, OBJECT_TYPE string")
    # Files are read by their own headers: those with the same columns in the same order together.
    fs, at = _glob(spark, glob)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for s in fs.globStatus(at) or ():
        path = s.getPath().toString()
        by_header.setdefault(tuple(headers(spark, path)), []).append(path)
    parts = []
    for names, paths in by_header.items():
        own = {c.lstrip("\ufeff").strip(): c for c in names}
        if "OWNER" in own and "OBJECT_NAME" in own:
            raw = spark.read.csv(paths, header=True, escape='"')
            picked = [(F.col(f"`{own[c]}`") if c in own else F.lit(None).cast("string")).alias(c) for c in ("OWNER", "OBJECT_NAME", "OBJECT_TYPE")]
            parts.append(raw.select(*picked, F.col("_metadata.file_path").alias("file")))
    if not parts:
        return spark.createDataFrame([], "DB_LINK string, OWNER string, OBJECT_NAME string, OBJECT_TYPE string")
    raw = reduce(DataFrame.unionByName, parts)
    rows = raw.withColumn("DB_LINK", F.regexp_extract("file", r"in_remote_objects__(.+)\.csv$", 1)).where("OWNER is not null and OBJECT_NAME is not null")
    return rows.groupBy("DB_LINK", "OWNER", "OBJECT_NAME").agg(F.max_by("OBJECT_TYPE", "file").alias("OBJECT_TYPE"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path) of each file of a folder and the folders in it; no file is read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def whole_texts(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """(path, text) of each file, bytes that aren't UTF-8 replaced."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("valid"), "content").select("path", F.coalesce("valid", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def effort_samples(spark: SparkSession, path: str) -> DataFrame:
    """(key, hours) under any of the known headers; blank keys and bad numbers go."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.csv(path, header=True, escape='"')
    by = {c.lstrip("﻿").strip().upper(): c for c in raw.columns}
    key = next((by[k] for k in ("KEY", "NAME", "OBJECT") if k in by), None)
    hours = next((by[k] for k in ("HOURS", "HOUR", "MH", "MD") if k in by), None)
    if key is None or hours is None:
        raise ValueError("a sample file needs a key and an hours column")
    return raw.select(F.trim(F.col(f"`{key}`")).alias("key"), F.col(f"`{hours}`").try_cast("double").alias("hours")).where("key <> '' and hours is not null")


def git_history(root: str, folder: str = "override") -> list[str]:
    """Log lines of the override folder; none on any failure."""
    try:
        done = subprocess.run(["git", "-C", root, "log", "--oneline", "--", folder], capture_output=True, text=True, timeout=10)
        return done.stdout.splitlines() if done.returncode == 0 else []
    except (OSError, subprocess.SubprocessError):
        return []


# Sinks.  Reports are small: their rows are bounded by what a person reads.


def write_text(spark: SparkSession, path: str, text: str | Iterable[str]) -> None:
    """One file through Spark's file systems, piece by piece."""
    fs, p = _glob(spark, path)
    out = fs.create(p, True)
    try:
        for piece in [text] if isinstance(text, str) else text:
            out.write(bytearray(piece.encode("utf-8")))
    finally:
        out.close()


#: Rows up to which a table for people is one file.
SINGLE = 1_000_000


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of part files, or for people one file with header and minimal quotes, rows in the
    order of their first column; beyond SINGLE rows it is a folder in any case."""
    if not single or df.count() > SINGLE:
        df.write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')
        return

    def pieces() -> Iterator[str]:
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(df.columns)
        for row in df.orderBy(df.columns[0]).toLocalIterator():
            w.writerow(["" if v is None else v for v in row])
            if out.tell() > 1 << 20:
                yield out.getvalue()
                out.seek(0)
                out.truncate()
        yield out.getvalue()

    write_text(df.sparkSession, path, pieces())


def snapshot(df: DataFrame, path: str, tag: str) -> None:
    """A tagged copy as a partition of the stage's table."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot={tag}")


def read_snapshot(spark: SparkSession, path: str, tag: str) -> DataFrame:
    if not _exists(spark, f"{path}/snapshot={tag}"):
        raise FileNotFoundError(f"{path}/snapshot={tag}")
    return spark.read.parquet(f"{path}/snapshot={tag}")


def mermaid(edges: DataFrame, nodes: DataFrame | None = None) -> str:
    """A diagram of the edges (SRC, DST, EDGE_TYPE), in order.  With nodes (NODE_ID, NODE_TYPE), each
    node but a plain unit has its type as its class."""
    from quarrymill.functions.text import safe_id

    shown = edges.select("SRC", "DST", "EDGE_TYPE")
    for end in ("SRC", "DST"):
        kind = F.lit("")
        if nodes is not None:
            kinds = nodes.select(F.col("NODE_ID").alias(end), F.lower("NODE_TYPE").alias(f"kind_{end}"))
            shown = shown.join(kinds, end, "left")
            kind = F.when(F.col(f"kind_{end}") != "sp", F.concat(F.lit(":::"), f"kind_{end}")).otherwise("")
        label = F.regexp_replace(end, '"', "#quot;")
        shown = shown.withColumn(f"box_{end}", F.concat(safe_id(end), F.lit('["'), label, F.lit('"]'), kind))
    rows = shown.orderBy("SRC", "DST", "EDGE_TYPE").select("box_SRC", "EDGE_TYPE", "box_DST").toLocalIterator()
    return "\n".join(["graph LR", *(f"  {r.box_SRC} -->|{r.EDGE_TYPE}| {r.box_DST}" for r in rows)]) + "\n"


def markdown_pieces(df: DataFrame) -> Iterator[str]:
    """A Markdown table, line by line."""
    yield f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    for r in df.toLocalIterator():
        yield f"| {' | '.join('' if v is None else str(v).replace('|', '/') for v in r)} |\n"


def markdown_table(df: DataFrame) -> str:
    return "".join(markdown_pieces(df))


def scatter_svg(points: DataFrame, x: str, y: str, size: int = 400) -> str:
    """Points of two scores from 0 to 100 with quadrant lines at 60."""
    dots = "".join(f'<circle cx="{r[0] / 100 * size:.1f}" cy="{size - r[1] / 100 * size:.1f}" r="3"/>' for r in points.select(x, y).toLocalIterator() if r[0] is not None and r[1] is not None)
    cut = 0.6 * size
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}"><path d="M{cut} 0V{size}M0 {size - cut}H{size}" stroke="grey"/>{dots}</svg>'
