"""Kahn's order over graphs of several shapes against a plain search, and the tables that it writes."""

import random

from test_reference import edges, first, nodes, spark  # noqa: F401

from reposcope.operators import graph


def longest(names, pairs):
    """The layer of each node that a plain removal of free nodes comes to."""
    layer, left, front = {}, {(a, b) for a, b in pairs if a != b}, None
    given = dict.fromkeys(names, 0)
    while front != []:
        front = [v for v in names if v not in layer and not any(b == v for _, b in left)]
        layer |= {v: given[v] for v in front}
        for a, b in [p for p in left if p[0] in front]:
            given[b] = max(given[b], given[a] + 1)
        left = {p for p in left if p[0] not in front}
    return layer


def test_layers_of_graphs_deeper_than_the_plain_rounds(spark):  # noqa: F811
    rng, pairs, names = random.Random(5), [], set()
    for g in range(12):
        n = [f"{g:02}x{i:02}" for i in range(20)]
        names |= set(n)
        # mostly forward steps, so that runs, meetings and waiting nodes lie behind one another; a few steps back close rings
        pairs += [(n[i], n[min(19, i + rng.randrange(1, 4))]) for i in range(19) for _ in range(rng.choice([1, 1, 2]))]
        pairs += [(n[rng.randrange(10, 20)], n[rng.randrange(10, 20)]) for _ in range(g % 3)]
    names, want = sorted(names), longest(names, pairs)
    n, e = nodes(spark, **dict.fromkeys(names, "view")), edges(spark, *pairs)
    assert max(want.values()) > 2 * graph.PLAIN and len(want) < len(names)
    assert first(graph.topo_layers(n, e), "node_id", "layer") == [(v, want.get(v, -1)) for v in names]
    back = longest(names, [(b, a) for a, b in pairs])
    assert first(graph.deep_chains(n, e, 3), "node_id", "depth") == sorted((v, d) for v, d in back.items() if d > 3)
    assert {v for (v,) in first(graph.leads_to_cycle(n, e.filter("src <> dst")), "node_id")} == set(names) - set(back)


def test_rings_of_single_ways_write_few_tables(spark, monkeypatch):  # noqa: F811
    # many short trees into one ring of single ways: pointers that go round it were followed as often as the table's size doubles
    pairs = [(f"r{k}", f"r{(k + 1) % 4}") for k in range(4)] + [(f"c{k}", f"o{k}") for k in range(3000)] + [(f"o{k}", f"p{k}") for k in range(3000)] + [("c7", "r0")]
    n, e = nodes(spark, **dict.fromkeys(sorted({x for p in pairs for x in p}), "view")), edges(spark, *pairs)
    write, tables = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df: tables.append(1) or write(df))
    assert first(graph.dag_share(n, e), "share") == [(round(1 - 5 / 9004, 6),)]
    assert len(tables) < 15
    tables.clear()
    assert dict(first(graph.longest_path_rank(n, e), "node_id", "rank")) == {v: {"c": 0, "o": 1, "p": 2, "r": 0}[v[0]] + (v == "r0") for v in {x for p in pairs for x in p}}
    assert len(tables) < 18


def test_flow_summary_looks_for_cycles_by_taking_free_nodes_off(spark, monkeypatch):  # noqa: F811
    pairs = [(f"r{k}", f"r{(k + 1) % 4}") for k in range(4)] + [(f"c{k}", f"o{k}") for k in range(300)] + [(f"o{k}", f"p{k}") for k in range(300)] + [("c7", "r0"), ("r2", "p9"), ("o3", "nowhere"), ("nowhere", "p5"), ("p4", "p4")]
    names = sorted({x for p in pairs for x in p} - {"nowhere"})
    n, e = nodes(spark, **dict.fromkeys(names, "view")), edges(spark, *pairs)
    write, tables = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df: tables.append(1) or write(df))
    asked = n.filter("node_id IN ('c7', 'o3', 'p5', 'r1', 'c4', 'p9')")
    got = first(graph.flow_summary(asked, n, e), "origin", "direction", "steps", "exits", "max_depth", "has_cycles")
    # an end that is no node is not passed, but the node before it is no exit and the one behind it no entry
    assert got == sorted([
        ("c7", "forward", 8, 2, 4, True), ("c7", "backward", 1, 1, 0, True), ("o3", "forward", 2, 1, 1, False), ("o3", "backward", 2, 1, 1, False),
        ("p5", "forward", 1, 1, 0, False), ("p5", "backward", 3, 1, 2, False), ("r1", "forward", 5, 1, 3, True), ("r1", "backward", 5, 1, 3, True),
        ("c4", "forward", 3, 0, 2, True), ("c4", "backward", 1, 1, 0, True), ("p9", "forward", 1, 1, 0, False), ("p9", "backward", 8, 2, 4, False),
    ])
    assert len(tables) < 35


def test_paths_search_only_what_lies_ahead_of_an_origin(spark, monkeypatch):  # noqa: F811
    # 500 nodes lead to the target, three of them lie between
    pairs = [("a", "m1"), ("a", "m2"), ("m1", "z"), ("m2", "z"), ("m2", "m1"), ("z", "a")] + [(f"x{k}", "z") for k in range(500)]
    write, rows = graph.written, []

    def counted(df):
        table = write(df)
        rows.append(table.count())
        return table

    monkeypatch.setattr(graph, "written", counted)
    asked = spark.createDataFrame([(r, "a", "z") for r in ("r1", "r2")], "repo_id string, origin string, target string")
    assert first(graph.all_paths(asked, edges(spark, *pairs), depth=6), "path") == [("a>m1>z",), ("a>m2>m1>z",), ("a>m2>z",)]
    assert max(rows) < 30
