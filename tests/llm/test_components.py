"""Connected components: right ones, and few rows for groups of many links."""

import random

from duelframe.llm import common


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    return {x: find(x) for x in parent}


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    for n, m in ((40, 25), (60, 60), (30, 200)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(20)] + [(2000 + i, 2500) for i in range(20)]
        r.shuffle(edges)
        # a node with a loop only has no edge
        want = brute([e for e in edges if e[0] != e[1]])
        got = common.components(spark.createDataFrame(edges, "a long, b long"))
        assert got.columns == ["node", "component"] and {x.node: x.component for x in got.collect()} == want
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_links_of_a_group_are_contracted(spark, monkeypatch):
    """Rounds must not join all links again: 400 members with 10 centres each."""
    written = []
    keep = common.checkpoint

    def checkpoint(df):
        out = keep(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(common, "checkpoint", checkpoint)
    edges = [(c, 100 + i) for i in range(400) for c in range(10)]
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.component for x in got.collect()} == {0} and got.count() == 410
    links = [n for columns, n in written if columns == ["u", "v"]]
    assert links[0] == 4000 and len(links) > 1 and sum(links[1:]) <= 410
