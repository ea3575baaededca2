import random

from inkmeter.llm.components import UnionFind, connected_components


def test_random_graphs_and_chains(spark):
    random.seed(4)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5), (None, 3), (9, 9)] + [(900, k) for k in range(901, 960)]
    uf, seen = UnionFind(), set()
    for a, b in links:
        if a is not None and a != b:
            uf.union(a, b)
            seen |= {a, b}
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: uf.find(x) for x in seen}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
