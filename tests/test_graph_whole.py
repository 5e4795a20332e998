"""Operators over the whole job, against brute force."""

import random

from test_reference import edges, files, first, nodes, spark  # noqa: F401

from reposcope.operators import graph


def steps(pairs, start, most=None, backward=False):
    """Node: edges from `start`, breadth first."""
    found, front, d = {start: 0}, [start], 0
    while front and (most is None or d < most):
        d += 1
        front = sorted({b for x, y in pairs for a, b in [(y, x) if backward else (x, y)] if a in front} - set(found))
        found.update(dict.fromkeys(front, d))
    return found


def some_graph():
    rng = random.Random(3)
    kinds = {f"{k}{i}": t for k, t in (("c", "view"), ("o", "controller"), ("p", "database"), ("s", "validation")) for i in range(4)}
    return kinds, sorted({(rng.choice(list(kinds)), rng.choice(list(kinds))) for _ in range(20)})


def test_flow_traces_of_all_nodes_both_ways(spark):  # noqa: F811
    kinds, pairs = some_graph()
    chain = [(f"k{i:02}", f"k{i + 1:02}") for i in range(6)]
    kinds |= dict.fromkeys(sorted({x for p in chain for x in p}), "controller")
    pairs += chain
    loose = [*pairs, ("o0", "nowhere"), ("nowhere", "o1")]
    got = first(graph.flow_traces(nodes(spark, **kinds), nodes(spark, **kinds), edges(spark, *loose)), "origin", "direction", "node_id", "depth", "is_exit")
    last = {"forward": {n for n in kinds if n not in {a for a, _ in loose}}, "backward": {n for n in kinds if n not in {b for _, b in loose}}}
    want = [(o, way, n, d, n in last[way]) for o in kinds for way in last for n, d in steps(pairs, o, 50, way == "backward").items()]
    assert got == sorted(want)
    assert ("k00", "forward", "k06", 6, True) in got and ("p0", "backward") in {r[:2] for r in got}


def test_whole_trace_is_registered(spark):  # noqa: F811
    from reposcope.plans.queries import QUERIES

    rows = QUERIES["g2_flow_trace_whole"](spark, "/root/testdata/sf0.001")
    assert {r[0] for r in rows.selectExpr("substring(origin, 1, 1)").distinct().collect()} == set("cops")
    assert {r[0] for r in rows.select("direction").distinct().collect()} == {"forward", "backward"}


def test_blast_radius_beyond_50_edges(spark):  # noqa: F811
    kinds, pairs = some_graph()
    chain = [(f"k{i:02}", f"k{i + 1:02}") for i in range(60)]
    origins = [*kinds, "k00"]
    got = first(graph.blast_radius(nodes(spark, **dict.fromkeys(origins, "view")), edges(spark, *pairs, *chain)), "origin", "node_id", "category", "depth")
    want = []
    for o in origins:
        ahead, behind = steps(pairs + chain, o), steps(pairs + chain, o, backward=True)
        want += [(o, n, "direct" if d == 1 else "transitive", d) for n, d in ahead.items() if d]
        want += [(o, n, "orphaned-by-deletion", d) for n, d in behind.items() if n not in ahead]
    assert got == sorted(want) and ("k00", "k60", "transitive", 60) in got


def test_whole_impacts_are_registered(spark):  # noqa: F811
    from reposcope.plans.queries import QUERIES

    rows = QUERIES["f13_impact_counts_whole"](spark, "/root/testdata/sf0.001")
    assert {r[0] for r in rows.selectExpr("substring(origin, 1, 1)").distinct().collect()} == set("cops")


def test_layers_of_deep_and_random_graphs(spark):  # noqa: F811
    rng = random.Random(9)
    deep = [(f"d{i:04}", f"d{i + 1:04}") for i in range(1100)]
    names = [f"n{i}" for i in range(40)]
    pairs = {(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(44))} | {("y", "y"), ("x", "y"), ("q", "r"), ("r", "q"), ("r", "t"), ("d1100", "z0"), ("z0", "z1"), ("z1", "z0"), ("m1", "m2"), ("m1", "m3"), ("m3", "m4"), ("m2", "m4")}
    every = sorted({x for p in [*deep, *pairs] for x in p} | {"alone"})
    pairs = [*deep, *pairs]
    n, e = nodes(spark, **dict.fromkeys(every, "view")), edges(spark, *pairs)

    def kahn(links):
        into, ways, layer = dict.fromkeys(every, 0), {}, {}
        for a, b in links:
            into[b] += 1
            ways.setdefault(a, []).append(b)
        front = [v for v in every if not into[v]]
        while front:
            layer.update(dict.fromkeys(front, max(layer.values(), default=-1) + 1))
            after = []
            for b in (b for a in front for b in ways.get(a, [])):
                into[b] -= 1
                after += [] if into[b] else [b]
            front = after
        return layer

    layers = kahn([(a, b) for a, b in pairs if a != b])
    assert first(graph.topo_layers(n, e), "node_id", "layer") == [(v, layers.get(v, -1)) for v in every] and layers["d1100"] == 1100
    ranks = dict(first(graph.longest_path_rank(n, e), "node_id", "rank"))
    assert all(ranks[v] == d for v, d in layers.items()) and ranks["z0"] == 1101
    assert first(graph.dag_share(n, e), "share") == [(round(len(kahn([(b, a) for a, b in pairs])) / len(every), 6),)]
    starts, depth, ways, d = [v for v in every if v not in {b for _, b in pairs}], {}, {}, 0
    for a, b in pairs:
        ways.setdefault(a, []).append(b)
    while starts:
        depth.update(dict.fromkeys(starts, d))
        d, starts = d + 1, sorted({b for a in starts for b in ways.get(a, [])} - set(depth))
    assert first(graph.execution_order(n, e), "node_id", "depth") == [(v, depth.get(v, -1)) for v in every]


def test_shared_components_are_counted_by_pages(spark, monkeypatch):  # noqa: F811
    from reposcope.plans import queries

    card = 'import Card from "../../src/components/Card";'
    table = files(spark, ("app/a/page.tsx", card), ("app/b/page.tsx", card), ("app/c/page.tsx", 'import x from "../../src/lone";'), ("src/components/Card.tsx", 'import B from "./Base";'), ("src/components/Other.tsx", 'import B from "./Base";'), ("src/components/Base.tsx", ""), ("src/lone.ts", ""))
    monkeypatch.setattr(queries, "_table", lambda *_: table)
    got = first(queries.QUERIES["f7_shared_components"](spark, ""), "node_id", "usage_count", "used_by")
    assert got == [(f"src/components/{f}.tsx", 2, f"app/{p}/page.tsx") for f in ("Base", "Card") for p in "ab"]
