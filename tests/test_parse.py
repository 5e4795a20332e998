"""The deterministic parse by hand-written cases."""

from test_reference import files, first, spark  # noqa: F401

from reposcope.operators import parse

DDL = "CREATE TABLE users (id INTEGER PRIMARY KEY);\nCREATE TABLE orders (id INTEGER PRIMARY KEY, owner_id INTEGER REFERENCES users(id));"


def test_nodes_edges_and_counts(spark):  # noqa: F811
    made = files(spark, *{
        "app/page.tsx": "z.object({})", "app/shop/[id]/page.tsx": None, "lib/a.ts": "z.object({})", "app/api/[x]/route.ts": "", "pages/api/b.ts": "yup.object()", "db/a.sql": DDL,
    }.items())
    nodes, edges = parse.deterministic_parse(made.unionAll(made))
    assert first(nodes, "type", "key", "label") == sorted([
        ("route", "/", "/ (Home)"), ("route", "/shop/:id", "/shop/:id"), ("validation", "app/page.tsx", "zod"), ("validation", "pages/api/b.ts", "yup"),
        ("controller", "/api/:param", "/api/:param"), ("controller", "/api/b", "/api/b"), ("table", "users", "users"), ("table", "orders", "orders"),
    ])
    assert first(edges, "type", "src", "dst") == [("one-to-many", "orders", "users"), ("validates", "/", "app/page.tsx")]
    assert first(parse.parse_stats(nodes, edges), "type", "n") == [("controller", 2), ("one-to-many", 1), ("route", 2), ("table", 2), ("validates", 1), ("validation", 2)]
    nodes, edges = parse.deterministic_parse(made.limit(0))
    assert nodes.count() == edges.count() == 0
