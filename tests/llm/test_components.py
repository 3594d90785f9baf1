"""Connected components against plain union-find, with and without hot keys."""

import random

import pytest

from folioforge.llm import components


def plain(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((x, root(x)) for x in parent)


def graph(seed):
    """A star whose hub is not its smallest node, a chain, rings, repeated links, links of a node to itself and nulls."""
    rng = random.Random(seed)
    links = [(500, x) for x in range(300, 460)] + [(x, x + 1) for x in range(1000, 1040)] + [(x, 600 + (x + 1) % 7) for x in range(600, 607)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    links += links[::9] + [(b, a) for a, b in links[::11]] + [(7, 7), (None, 3), (4, None)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("hot_rows", [1, 20, components.HOT_ROWS])
def test_equals_union_find(spark, hot_rows):
    links = graph(hot_rows)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), hot_rows)
    assert sorted(map(tuple, got.collect())) == plain(links)


def test_more_hot_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_KEYS", 1)
    links = graph(5)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), 2)
    assert sorted(map(tuple, got.collect())) == plain(links)


def test_text_nodes_and_no_links(spark):
    links = [("b", "a"), ("c", "b"), ("x", "y")]
    assert sorted(map(tuple, components.connected_components(spark.createDataFrame(links, "a string, b string")).collect())) == plain(links)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
