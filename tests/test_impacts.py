"""Deletions: what they concern, by which way, and which edges they break."""

from test_reference import edges, files, first, nodes, spark  # noqa: F401

from reposcope.operators import graph, scan


def test_ways_routes_and_broken_edges(spark):  # noqa: F811
    n = nodes(spark, a="view", b="controller", c="controller", d="database", e="view", z="view")
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("e", "a"), ("d", "gone"), ("a", "b"))
    origin = n.filter("node_id IN ('b', 'z')")
    got = first(graph.impacts(origin, n, e), "origin", "node_id", "category", "depth", "path", "is_route")
    assert got == [
        ("b", "a", "transitive", 2, "b>d>a", True), ("b", "c", "transitive", 3, "b>d>a>c", True), ("b", "d", "direct", 1, "b>d", False), ("b", "e", "orphaned-by-deletion", 2, "b>a>e", False), ("b", "gone", "transitive", 2, "b>d>gone", False),
    ]
    assert first(graph.broken_edges(origin, e), "origin", "src", "dst") == [("b", "a", "b"), ("b", "b", "d")]
    assert first(graph.deletion_summary(origin, n, e), "origin", "impacted", "routes", "services", "broken") == [("b", 5, 2, 1, 2), ("z", 0, 0, 0, 0)]
    two = graph.impacts(n.filter("node_id = 'a'"), n, e).filter("repo_id = 'r1' AND node_id = 'd'").collect()
    assert [r["path"] for r in two] == ["a>b>d"]


def test_flows_with_cycles_and_types(spark):  # noqa: F811
    n = nodes(spark, a="view", b="controller", c="database", d="controller", e="view", f="view")
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "b"), ("f", "gone"))
    every = first(graph.flow_summary(n.filter("node_id IN ('a', 'f', 'd')"), n, e), "origin", "direction", "steps", "exits", "max_depth", "has_cycles")
    assert every == [("a", "backward", 1, 1, 0, True), ("a", "forward", 4, 0, 3, True), ("d", "backward", 5, 2, 3, True), ("d", "forward", 2, 0, 1, True), ("f", "backward", 1, 1, 0, False), ("f", "forward", 1, 0, 0, False)]
    some = first(graph.flow_summary(n, n, e, ["view", "controller"]).filter("direction = 'forward'"), "origin", "steps", "exits", "max_depth")
    assert some == [("a", 2, 0, 1), ("b", 1, 0, 0), ("d", 1, 0, 0), ("e", 2, 0, 1), ("f", 1, 0, 0)]


def test_deleted_sections_leave_their_members(spark):  # noqa: F811
    homes = spark.createDataFrame([("r", "a", "s1"), ("r", "b", "s2"), ("q", "a", "s1"), ("r", "c", None)], "repo_id string, node_id string, section_id string")
    gone = spark.createDataFrame([("r", "s1"), ("r", "s1")], "repo_id string, section_id string")
    assert sorted(map(str, map(tuple, graph.delete_sections(homes, gone).collect()))) == sorted(map(str, [("r", "a", None), ("r", "b", "s2"), ("q", "a", "s1"), ("r", "c", None)]))


def test_names_of_the_environment(spark):  # noqa: F811
    text = "a(process.env.VITE_KEY || 1)\nimport.meta.env.KEY; import.meta.env.MODE\nos.getenv('DB_URL'); getenv(\"db_pw\")\nconst x = NEXT_PUBLIC_HOST; REACT_APP_\nprocess.env.DB_URL"
    got = first(scan.env_scan(files(spark, ("a.ts", text), ("b.ts", None))), "name", "context", "line", "required")
    assert got == sorted([
        ("VITE_KEY", "process.env", 1, False), ("VITE_MODE", "import.meta.env", 2, True), ("DB_URL", "process.env", 5, True), ("KEY", "config-key", 1, True), ("db_pw", "config-key", 3, True), ("_HOST", "config-key", 4, True),
    ])
