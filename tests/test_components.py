"""Components by contraction against a plain search, and the rows that its rounds write."""

import random

from test_reference import edges, first, nodes, spark  # noqa: F401

from reposcope.operators import graph


def joined(names, pairs):
    """Each node with the smallest node of its component, or an end beyond that is no node if it is smaller."""
    near = {v: set() for v in names}
    for a, b in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    least = {}
    for v in names:
        todo, seen = [v], {v}
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        beyond = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in seen and y not in near}
        least[v] = min(seen | beyond)
    return sorted(least.items())


def some():
    rng = random.Random(4)
    names = [f"n{i:02}" for i in range(60)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(45)] + [("m", "n07"), ("n09", "m"), ("z", "n08"), ("n50", "n50")]
    return names, pairs


def test_components_of_random_graphs(spark):  # noqa: F811
    names, pairs = some()
    assert first(graph.components(nodes(spark, **dict.fromkeys(names, "view")), edges(spark, *pairs)), "node_id", "component") == joined(names, pairs)
    alone = nodes(spark, a="view", b="view")
    assert first(graph.components(alone, edges(spark, ("a", "b")).limit(0)), "node_id", "component") == [("a", "a"), ("b", "b")]


def test_nodes_of_one_hash_are_told_apart(spark, monkeypatch):  # noqa: F811
    names, pairs = some()
    real, F = graph.F.xxhash64, graph.F
    monkeypatch.setattr(graph.F, "xxhash64", lambda salt, *c: F.pmod(real(salt, *c), F.when(salt == 0, 5).otherwise(1 << 50)))
    assert first(graph.components(nodes(spark, **dict.fromkeys(names, "view")), edges(spark, *pairs)), "node_id", "component") == joined(names, pairs)


def test_rounds_read_what_is_left(spark, monkeypatch):  # noqa: F811
    # a long chain in any order beside many pairs: every round wrote a label for each node of all
    rng, chain = random.Random(2), [f"c{i:04}" for i in range(1000)]
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(f"a{i}", f"b{i}") for i in range(2000)]
    names = sorted({x for p in pairs for x in p})
    n, e = nodes(spark, **dict.fromkeys(names, "view")), edges(spark, *pairs)
    write, sizes = graph.written, []

    def counted(df):
        table = write(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(graph, "written", counted)
    want = [(v, "c0000" if v[0] == "c" else f"a{v[1:]}") for v in names]
    assert first(graph.components(n, e), "node_id", "component") == want
    assert sum(sizes) < 8 * n.count()


def test_nodes_that_come_twice(spark):  # noqa: F811
    names, pairs = some()
    n = nodes(spark, **dict.fromkeys(names, "view"))
    got = first(graph.components(n.unionByName(n.filter("node_id = 'n55'")), edges(spark, *pairs)), "node_id", "component")
    assert sorted(set(got)) == joined(names, pairs) and got.count(("n55", dict(got)["n55"])) > 1
