import random

from colloquy.llm.components import connected_components


def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_random_graphs_paths_and_hubs(spark):
    rng = random.Random(2)
    graphs = [
        [(rng.randrange(60), rng.randrange(60)) for _ in range(45)],
        [(i, i + 1) for i in range(40)],
        [(99, i) for i in range(50)] + [(200, 201)],
        [(1, 1), (2, 3), (2, 3), (3, 2)],
    ]
    for edges in graphs:
        frame = spark.createDataFrame([*edges, (None, 1), (1, None)], "u long, v long")
        got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
        assert got == closure([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
