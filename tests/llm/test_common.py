import random

from veritally.llm.common import connected_components


def test_components(spark, rows):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7), (1000, 1001)]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        before = dict(comp)
        for u, v in edges:
            comp[u] = comp[v] = min(comp[u], comp[v])
        if comp == before:
            break
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = rows(connected_components(spark.createDataFrame(edges, "u long, v long")), "node", "component")
    assert got == sorted((x, comp[x]) for x in linked)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
