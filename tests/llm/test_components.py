"""Connected components against a union of sets."""

import random

from vakya.llm.components import connected


def brute(edges):
    root = {v: v for e in edges for v in e}
    for _ in root:
        moved = False
        for a, b in edges:
            m = min(root[a], root[b])
            moved |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not moved:
            break
    return {(v, r) for v, r in root.items() if v != r}


def found(spark, edges):
    return [tuple(r) for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]


def test_chains_stars_repeats_and_loops(spark):
    rng = random.Random(5)
    nodes = rng.sample(range(-500, 500), 120)
    edges = [(a, b) for a, b in zip(nodes[:30], nodes[1:30])] + [(nodes[40], x) for x in nodes[41:80]] + [(x, nodes[80]) for x in nodes[81:100]]
    edges += [(nodes[100], nodes[101]), (nodes[101], nodes[100]), (nodes[100], nodes[101]), (nodes[102], nodes[102])]
    edges += [tuple(rng.sample(nodes[100:], 2)) for _ in range(12)]
    got = found(spark, edges)
    assert len(got) == len(set(got)) and set(got) == brute(edges)


def test_stars_and_nothing(spark):
    stars = [(9, 1), (8, 1), (7, 2)]
    assert sorted(found(spark, stars)) == sorted(stars)
    assert found(spark, []) == [] and found(spark, [(3, 3)]) == []
    assert sorted(found(spark, [(1, 9), (9, 5)])) == [(5, 1), (9, 1)]
