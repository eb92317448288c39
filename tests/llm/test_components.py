"""Components against a plain search, in one task and by stars."""

import random

import numpy as np
import pytest

from paperloom.llm.components import components, forest


def searched(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    found, seen = set(), set()
    for start in sorted(near):
        todo = [start] if start not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                if x != start:
                    found.add((x, start))
                todo += near[x]
    return found


def graphs(seed):
    rnd = random.Random(seed)
    names = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    scattered = [tuple(rnd.sample(names[:150], 2)) for _ in range(90)]
    chain = list(zip(names[150:219], names[151:220], strict=True))
    star = [(names[220], x) for x in names[221:290]]
    loops = [(x, x) for x in names[285:]]
    edges = scattered + chain + star + star[:5] + [(v, u) for u, v in chain[:9]] + loops
    rnd.shuffle(edges)
    return edges


@pytest.mark.parametrize("seed", range(5))
def test_forest(seed):
    u, v = (np.array(x, dtype=np.int64) for x in zip(*graphs(seed), strict=True))
    node, root = forest(u, v)
    assert set(zip(node.tolist(), root.tolist(), strict=True)) == searched(graphs(seed))
    none = np.empty(0, dtype=np.int64)
    assert [len(x) for x in forest(none, none)] == [0, 0]


@pytest.mark.parametrize("task_edges", [1 << 20, 100, 5])
def test_components(spark, task_edges):
    edges = graphs(9)
    df = spark.createDataFrame(edges, "x long, y long").repartition(4)
    got = [tuple(r) for r in components(df, task_edges).collect()]
    assert len(got) == len(set(got))
    assert set(got) == searched(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "x long, y long")).collect() == []
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []
