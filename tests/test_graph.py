"""Components and waves: the way of rounds and the way of one task against brute force."""

import random

import pytest
from quarrymill.operators import graph as gr


def brute(nodes, edges):
    near = {v: {b for a, b in edges if a == v and b in nodes} for v in nodes}
    reach = {}
    for v in nodes:
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        reach[v] = seen
    of = {v: min(w for w in nodes if w in reach[v] and v in reach[w]) for v in nodes}
    pairs = {(of[a], of[b]) for a, b in edges if a in nodes and b in nodes and of[a] != of[b]}
    wave = dict.fromkeys(of.values(), 0)
    for _ in wave:
        for a, b in pairs:
            wave[b] = max(wave[b], wave[a] + 1)
    return {(v, of[v], wave[of[v]]) for v in nodes}


def small_graph(seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(10)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(12)]
    return nodes, edges


@pytest.mark.parametrize(("task_edges", "seed"), [(gr.TASK_EDGES, 1), (gr.TASK_EDGES, 2), (5, 2)])
def test_components_and_waves(spark, task_edges, seed):
    nodes, edges = small_graph(seed)
    n = spark.createDataFrame([(v,) for v in nodes], "node string")
    e = spark.createDataFrame([*edges, edges[0], ("n01", "absent"), (None, "n02")], "src string, dst string")
    found = gr.waves(gr.strong_components(n, e, task_edges), e, task_edges).collect()
    assert len(found) == len(nodes)
    assert {(r["node"], r["component"], r["wave"]) for r in found} == brute(nodes, edges)


def test_empty_graph(spark):
    n, e = spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string")
    assert gr.waves(gr.strong_components(n, e), e).collect() == []
    one = spark.createDataFrame([("a",)], "node string")
    assert [tuple(r) for r in gr.waves(gr.strong_components(one, e), e).collect()] == [("a", "a", 0)]
