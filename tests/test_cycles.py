"""Cycles by contraction against a plain search, and the number of rounds that long graphs take."""

import random

from test_reference import edges, nodes, spark  # noqa: F401

from reposcope.operators import graph


def on_cycles(pairs):
    """Each node on a cycle with the smallest node of its component."""
    ahead, every = {}, {x for p in pairs for x in p}
    for s in every:
        todo, seen = [s], set()
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        ahead[s] = seen
    return sorted((x, min(y for y in every if y in ahead[x] and x in ahead[y])) for x in every if x in ahead[x])


def test_random_graphs(spark):  # noqa: F811
    rng, cases = random.Random(1), {}
    for k in range(40):
        n = rng.randrange(2, 14)
        cases[f"g{k}"] = {(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(rng.choice([n - 1, n, n + 2, 2 * n]))}
    cases["rings"] = {(f"a{k}", f"a{(k + 1) % 7}") for k in range(7)} | {(f"b{k}", f"b{(k + 1) % 8}") for k in range(8)} | {("a3", "b2"), ("x", "x"), ("b5", "t1"), ("t1", "t2"), ("t2", "t3")}
    cases["eight"] = {("m", "p1"), ("p1", "p2"), ("p2", "m"), ("m", "q1"), ("q1", "m"), ("q1", "q2"), ("q2", "q3"), ("in", "m")}
    made = spark.createDataFrame([(c, a, b, "call") for c, pairs in cases.items() for a, b in pairs], "repo_id string, src string, dst string, kind string")
    got = graph.cycle_nodes(nodes(spark, v="view").limit(0), made).collect()
    for c, pairs in cases.items():
        assert sorted((r["node_id"], r["cycle"]) for r in got if r["repo_id"] == c) == on_cycles(pairs), c
    assert len(got) == len(set(got))


def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch):  # noqa: F811
    size, rounds = 10_000, []
    pairs = [(f"c{k:05d}", f"c{k + 1:05d}") for k in range(size)] + [(f"r{k:05d}", f"r{(k + 1) % size:05d}") for k in range(size)]
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or write(df))
    got = graph.cycle_nodes(nodes(spark, v="view").limit(0), spark.createDataFrame([("r", a, b, "call") for a, b in pairs], "repo_id string, src string, dst string, kind string"))
    assert {r["node_id"] for r in got.collect()} == {f"r{k:05d}" for k in range(size)} and got.select("cycle").distinct().collect()[0][0] == "r00000"
    assert len(rounds) < 40


def test_no_cycles_and_no_edges(spark):  # noqa: F811
    assert graph.cycle_nodes(nodes(spark, v="view"), edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))).count() == 0
    assert graph.cycle_nodes(nodes(spark, v="view"), edges(spark, ("a", "b")).limit(0)).count() == 0
    assert graph.cycle_nodes(nodes(spark, v="view"), edges(spark, ("a", "a"))).count() == 2
