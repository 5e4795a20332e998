"""Searches over links that were taken off in turns, against plain searches."""

import random

import pytest
from test_graph_whole import steps
from test_reference import edges, first, nodes, spark  # noqa: F401

from reposcope.operators import graph

#: Chains of three nodes and a ring of five that one of them leads into.
RING = [(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)]
PAIRS = RING + [(a, b) for k in range(50) for a, b in ((f"c{k}", f"o{k}"), (f"o{k}", f"p{k}"), (f"c{k}", f"p{k}"))] + [("c7", "r0"), ("r2", "p9")]
KINDS = {v: {"c": "view", "o": "controller", "p": "database", "r": "validation"}[v[0]] for v in sorted({x for p in PAIRS for x in p})}


def test_searches_from_seeds_of_their_own_and_shared_ones(spark):  # noqa: F811
    rng = random.Random(8)
    for turn in range(4):
        names = [f"n{i:02}" for i in range(30)]
        pairs = [(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(34)) if turn % 2 or a <= b] + [("n01", "n01")]
        for backward in (False, True):
            parts = graph.peeled(edges(spark, *pairs, *pairs[:5]), backward)
            own = spark.createDataFrame([("r1", v, v) for v in names[::2]], "repo_id string, origin string, node_id string")
            for most in (None, 2):
                got = first(graph.union(graph.reach_peeled(own, parts, most, backward)), "origin", "node_id", "depth")
                assert got == sorted((v, n, d) for v in names[::2] for n, d in steps(pairs, v, most, backward).items())
            shared = spark.createDataFrame([("r1", "all", v) for v in names[::3]], "repo_id string, origin string, node_id string")
            every = [steps(pairs, v, 3, backward) for v in names[::3]]
            got = first(graph.union(graph.reach_peeled(shared, parts, 3, backward)), "node_id", "depth")
            assert got == sorted((n, min(s[n] for s in every if n in s)) for n in {n for s in every for n in s})


JOBS = {
    "F6": lambda n, e: graph.flow_summary(n.filter("node_id IN ('c7', 'r1')"), n, e, ["view", "validation"]),
    "F7": lambda n, e: graph.flow_summary(n.filter("node_id IN ('c7', 'p9')"), n, e),
    "F9": lambda n, e: graph.flow_traces(n.filter("node_id IN ('c7', 'p9')"), n, e),
    "F10": lambda n, e: graph.deletion_summary(n.filter("node_id IN ('c7', 'p9')"), n, e),
    "F12": lambda n, e: graph.validate_graph(n, e, graph.F.col("type") == "database", graph.F.col("type") == "view"),
}


@pytest.mark.parametrize("name", JOBS)
def test_levels_follow_only_links_on_or_before_cycles(spark, monkeypatch, name):  # noqa: F811
    n, e, met, follow = nodes(spark, **KINDS), edges(spark, *PAIRS), [], getattr(graph, "_levels", None)
    monkeypatch.setattr(graph, "_levels", lambda seeds, links, *a: met.append(links.count()) or follow(seeds, links, *a), raising=False)
    assert JOBS[name](n, e).count()
    # each level read all links before: 157 for each of two repositories
    assert met and max(met) <= 2 * (len(RING) + 1)


def test_search_of_all_nodes_serves_both_ways(spark, monkeypatch):  # noqa: F811
    ring = [(f"r{k:02}", f"r{(k + 1) % 16:02}") for k in range(16)]
    pairs = ring + [(f"c{k}", f"o{k}") for k in range(4)] + [("c1", "r00"), ("r05", "o2"), ("o2", "p")]
    n, e = nodes(spark, **dict.fromkeys(sorted({x for p in pairs for x in p}), "view")), edges(spark, *pairs)
    write, tables = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df: tables.append(1) or write(df))
    names = sorted({x for p in pairs for x in p})
    trace = first(graph.flow_traces(n, n, e, whole=True), "origin", "direction", "node_id", "depth")
    # the levels of 16 links are followed once, not once ahead and once behind
    assert len(tables) < 36
    assert trace == sorted((v, w, x, d) for v in names for w in ("forward", "backward") for x, d in steps(pairs, v, 50, w == "backward").items())
    tables.clear()
    got = first(graph.blast_radius(n, e, whole=True), "origin", "node_id", "category", "depth")
    assert len(tables) < 32
    ahead, behind = ({v: steps(pairs, v, backward=w) for v in names} for w in (False, True))
    want = [(v, x, "direct" if d == 1 else "transitive", d) for v in names for x, d in ahead[v].items() if d] + [(v, x, "orphaned-by-deletion", d) for v in names for x, d in behind[v].items() if x not in ahead[v]]
    assert got == sorted(want)


def test_an_issue_meets_the_edges_of_its_node_once(spark, monkeypatch):  # noqa: F811
    n = nodes(spark, v="view", w="view", **{f"d{i}": "database" for i in range(40)})
    e = edges(spark, *[("v", f"d{i}") for i in range(40)])
    found, write, sizes = graph.issues(n, e), graph.written, []
    monkeypatch.setattr(graph, "written", lambda df: sizes.append(df.filter("repo_id = 'r1'").count()) or write(df))
    got = first(graph.issues_by_node(found, e), "node_id", "kind", "role")
    assert got == sorted([("v", "view-to-db", "subject"), ("w", "orphan", "subject")] + [(f"d{i}", "view-to-db", "impacted") for i in range(40)])
    # v has 40 issues, one for each of its 40 edges
    assert sizes == [2]
