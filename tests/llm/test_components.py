"""Components by forests and by rounds, and close pairs with little memory, against brute force."""

import random

import numpy as np
import pytest
from test_corpus_operators import brute_components

from sigspark.llm import paritysketch
from sigspark.session import stage


def reach(nodes, links):
    low = {n: n for n in nodes}
    while True:
        new = dict(low)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("edges", [2_000_000, 7])
def test_components_equal_brute_force(spark, monkeypatch, edges):
    monkeypatch.setattr(paritysketch, "FOREST_EDGES", edges)
    rng = random.Random(3)
    nodes = [rng.randrange(-(2**62), 2**62) for _ in range(120)]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)] + list(zip(nodes[80:], nodes[81:], strict=False)) + [(nodes[0], nodes[0])] * 3
    df = stage(spark.createDataFrame(links, "a long, b long").repartition(5), "links")
    got = {r.node: r.comp for r in paritysketch.components(df, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    assert got == reach(nodes, links)
    none = paritysketch.components(df.limit(0), spark.createDataFrame([(1,)], "node long"))
    assert [tuple(r) for r in none.collect()] == [(1, 1)]


def test_a_spanning_forest_keeps_components():
    a, b = np.array([5, 9, 2, 7, 7]), np.array([9, 2, 2, 8, 8])
    x, y = paritysketch.spanning(a, b)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(5, 2), (8, 7), (9, 2)]


def test_close_pairs_with_little_memory_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(paritysketch, "KNOWN_BYTES", 2_000)
    monkeypatch.setattr(paritysketch, "CHUNK_BYTES", 3_000)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    docs = []
    for i in range(60):
        words = list(base if i % 2 else rng.sample(base, len(base)))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        docs.append((i, " ".join(words)))
    got = paritysketch.cluster(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(docs)
