"""Graph operators on edge tables (src, dst): degrees, strongly connected components, waves,
betweenness and communities.

Components and waves iterate over DataFrames; every round is checkpointed to the folder in
spark.checkpoint.dir, which cuts the lineage and survives lost executors.  Once a count shows
that at most ``TASK_EDGES`` edges are left, one task finishes them in linear time: a round costs
far more than so few edges.  Both ways give the same rows.  Betweenness runs
Brandes' algorithm for a block of sources in each task over a broadcast adjacency, and
communities run Louvain in one task; both refuse graphs above ``SMALL_EDGES``.
"""

from __future__ import annotations

import random
import tempfile
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL_EDGES = 2_000_000
#: Edges that one task finishes: the ends and a few whole numbers for each end and edge.
TASK_EDGES = 2_000_000
#: Rows of a batch that such a task returns.
BATCH = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a local session without one gets a temporary folder.
    Its rows make a new table: a checkpoint keeps its plan's estimated size, which a join
    multiplies, so that its digits would double each round until the driver's memory is full."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrymill-"))
    done = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(done.rdd(), done.schema()), spark)


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out over distinct edges; self-loops count in both."""
    e = simple_edges(edges)
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("node").join(sums, "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def _spread_least(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Propagates the least label along edges until nothing changes.  labels: node, label."""
    while True:
        sent = edges.join(labels, edges["src"] == labels["node"]).select(F.col("dst").alias("node"), "label")
        new = checkpointed(labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "was"), "node").where("label < was").limit(1).count()
        labels = new
        if not moved:
            return labels


def _coded(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, array, array]:
    """The ends of the edges in two columns, sorted, and their neighbours as places among them:
    those of place v stand from start[v] to start[v + 1] in the third."""
    edges = pa.Table.from_batches(list(batches))
    ends = pc.unique(pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks], edges.schema[0].type))
    names = ends.take(pc.sort_indices(ends))
    a, b = (pc.index_in(edges.column(i), value_set=names).to_numpy().astype(np.int32) for i in (0, 1))
    start = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=len(names))))).astype(np.int32)
    return names, array("i", start.tobytes()), array("i", b[np.argsort(a, kind="stable")].tobytes())


def _task_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the edges' ends, by Tarjan's algorithm without recursion."""
    if (first := next(batches, None)) is None:
        return
    names, start, near = _coded(chain([first], batches))
    way = array("i", start)
    seen, low, of = (array("i", [-1]) * len(names) for _ in range(3))
    pending, count = [], 0
    for root in range(len(names)):
        if seen[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if seen[v] < 0:
                seen[v] = low[v] = count
                count += 1
                pending.append(v)
            if way[v] < start[v + 1]:
                w = near[way[v]]
                way[v] += 1
                if seen[w] < 0:
                    path.append(w)
                elif of[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                at = len(pending) - 1
                while pending[at] != v:
                    at -= 1
                least = min(pending[at:])
                for w in pending[at:]:
                    of[w] = least
                del pending[at:]
    yield from pa.Table.from_arrays([names, names.take(pa.array(np.frombuffer(of, np.int32)))], names=["node", "component"]).to_batches(BATCH)


def _task_waves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """component, wave of the ends of an acyclic graph's edges, in topological order."""
    if (first := next(batches, None)) is None:
        return
    names, start, near = _coded(chain([first], batches))
    callers = array("i", np.bincount(np.frombuffer(near, np.int32), minlength=len(names)).astype(np.int32).tobytes())
    wave = array("i", [0]) * len(names)
    ready = [v for v, n in enumerate(callers) if not n]
    while ready:
        v = ready.pop()
        for w in near[start[v] : start[v + 1]]:
            wave[w] = max(wave[w], wave[v] + 1)
            callers[w] -= 1
            if not callers[w]:
                ready.append(w)
    yield from pa.Table.from_arrays([names, pa.array(np.frombuffer(wave, np.int32).astype(np.int64))], names=["component", "wave"]).to_batches(BATCH)


def _few(edges: DataFrame, bound: int) -> bool:
    return edges.limit(bound + 1).count() <= bound


def _trimmed(edges: DataFrame, task_edges: int) -> DataFrame:
    """The edges without those from a node that no edge enters or to one that none leaves, which
    lie on no cycle; again while that leaves more than task_edges and takes an eighth or more."""
    n = edges.count()
    while n > task_edges:
        starts, ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = checkpointed(edges.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst"))
        was, n = n, edges.count()
        if n > was - was / 8:
            break
    return edges


def strong_components(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component: the least node of its strongly connected component.  By colouring: the
    least label is spread forwards, then each colour's root collects backwards what reaches it;
    at most task_edges edges that are left are finished in one task.  Edges that can lie on no
    cycle are trimmed before."""
    left = checkpointed(nodes.select("node").where("node is not null").distinct())
    e = checkpointed(simple_edges(edges).where("src <> dst"))
    kind, out = left.schema["node"].dataType.simpleString(), None
    while left.limit(1).count():
        e = _trimmed(e, task_edges)
        if _few(e, task_edges):
            inner = e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
            found = inner.select("src", "dst").repartition(1).mapInArrow(_task_components, f"node {kind}, component {kind}")
            found = left.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
            return checkpointed(found if out is None else out.unionByName(found))
        colour = _spread_least(left.select("node", F.col("node").alias("label")), e)
        within = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst").where("ls = ld")
        back = checkpointed(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = colour.where("node = label").select("node", F.col("label").alias("component"))
        edge_of = found
        while True:
            reached = back.join(edge_of, back["src"] == edge_of["node"]).select(F.col("dst").alias("node"), "component").distinct()
            edge_of = checkpointed(reached.join(found, "node", "left_anti"))
            if not edge_of.limit(1).count():
                break
            found = checkpointed(found.unionByName(edge_of))
        out = found if out is None else checkpointed(out.unionByName(found))
        left = checkpointed(left.join(found, "node", "left_anti"))
        e = checkpointed(e.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return out if out is not None else left.select("node", F.col("node").alias("component"))


def waves(components: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component, wave: the longest path of components from one that nothing calls.  At
    most task_edges edges between components are finished in one task."""
    c = components
    pairs = simple_edges(edges).join(c.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    pairs = checkpointed(pairs.where("a <> b").select("a", "b").distinct())
    if _few(pairs, task_edges):
        kind = c.schema["component"].dataType.simpleString()
        depth = pairs.coalesce(1).mapInArrow(_task_waves, f"component {kind}, wave long")
        return c.join(depth, "component", "left").select("node", "component", F.coalesce("wave", F.lit(0).cast("long")).alias("wave"))
    depth = checkpointed(c.select("component").distinct().withColumn("wave", F.lit(0).cast("long")))
    front = depth
    while True:
        pushed = pairs.join(front, pairs["a"] == front["component"]).groupBy(F.col("b").alias("component")).agg((F.max("wave") + 1).alias("up"))
        front = checkpointed(depth.join(pushed, "component").where("up > wave").select("component", F.col("up").alias("wave")))
        if not front.limit(1).count():
            break
        depth = checkpointed(depth.join(front.withColumnRenamed("wave", "up"), "component", "left").select("component", F.coalesce("up", "wave").alias("wave")))
    return c.join(depth, "component").select("node", "component", "wave")


def component_ids(components: DataFrame) -> DataFrame:
    """node, component, scc_id: components of several nodes numbered from 0 by their least node;
    single nodes get -1.  The numbering's window has a row for each component of several nodes."""
    many = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = many.select("component", (F.row_number().over(Window.orderBy("component")) - 1).cast("long").alias("scc_id"))
    return components.join(ids, "component", "left").select("node", "component", F.coalesce("scc_id", F.lit(-1).cast("long")).alias("scc_id"))


def _bounded(edges: DataFrame) -> list[tuple]:
    rows = edges.limit(SMALL_EDGES + 1).collect()
    if len(rows) > SMALL_EDGES:
        raise ValueError(f"more than {SMALL_EDGES} edges: this measure needs the adjacency in one process")
    return sorted((r[0], r[1]) for r in rows)


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, betweenness: directed, unweighted, divided by (n - 1)(n - 2), rounded to 6 places."""
    spark = nodes.sparkSession
    e = _bounded(simple_edges(edges).where("src <> dst"))
    adjacency = defaultdict(list)
    for a, b in e:
        adjacency[a].append(b)
    held = spark.sparkContext.broadcast(dict(adjacency))
    n = nodes.select("node").distinct().count()
    kind = nodes.schema["node"].dataType.simpleString()

    def brandes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = defaultdict(float)
        near = held.value
        for batch in batches:
            for s in batch["node"]:
                order, before, paths, dist = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in near.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share: dict = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        out[w] += share[w]
        yield pd.DataFrame({"node": list(out), "b": list(out.values())})

    sums = nodes.select("node").distinct().mapInPandas(brandes, f"node {kind}, b double").groupBy("node").agg(F.sum("b").alias("b"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.select("node").distinct().join(sums, "node", "left").select("node", F.round(F.coalesce("b", F.lit(0.0)) * scale, 6).alias("betweenness"))


def louvain(names: list, pairs: list[tuple], seed: int = 42) -> dict:
    """Communities of an undirected graph by Louvain; numbered by size, then least member."""
    weight: dict = {v: {} for v in names}
    for a, b in pairs:
        if a != b:
            weight[a][b] = weight[b][a] = 1.0
    member = {v: v for v in names}
    rng = random.Random(seed)
    total = sum(sum(x.values()) for x in weight.values())
    while total:
        own = {v: v for v in weight}
        degree = {v: sum(x.values()) for v, x in weight.items()}
        inside = dict(degree)
        order = sorted(weight, key=str)
        rng.shuffle(order)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in order:
                links: dict = defaultdict(float)
                for u, w in weight[v].items():
                    if u != v:
                        links[own[u]] += w
                inside[own[v]] -= degree[v]
                best, gain = own[v], links.get(own[v], 0.0) - inside[own[v]] * degree[v] / total
                for c in sorted(links, key=str):
                    g = links[c] - inside[c] * degree[v] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                inside[best] += degree[v]
                if best != own[v]:
                    own[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        member = {v: own[c] for v, c in member.items()}
        merged: dict = {c: defaultdict(float) for c in set(own.values())}
        for v, x in weight.items():
            for u, w in x.items():
                merged[own[v]][own[u]] += w
        weight = merged
    groups = defaultdict(list)
    for v, c in member.items():
        groups[c].append(v)
    ranked = sorted(groups.values(), key=lambda g: (-len(g), min(map(str, g))))
    return {v: i for i, g in enumerate(ranked) for v in g}


def communities(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """node, cluster_id by Louvain over the undirected graph."""
    e = simple_edges(edges)
    pairs = _bounded(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    names = sorted({r[0] for r in nodes.select("node").distinct().collect()} | {v for p in pairs for v in p}) if pairs else sorted(r[0] for r in nodes.select("node").distinct().collect())
    found = louvain(names, pairs, seed)
    kind = nodes.schema["node"].dataType.simpleString()
    table = nodes.sparkSession.createDataFrame(sorted(found.items()), f"node {kind}, cluster_id long")
    return nodes.select("node").distinct().join(table, "node")
