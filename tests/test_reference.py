"""Paths, scans, links, graphs, schemas, differences and the feed on small cases."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reposcope.functions import paths
from reposcope.functions.text import findings, keep_first
from reposcope.operators import graph, link, scan, schema
from reposcope.sources.tables import graph_json, read_graph_json, upsert
from reposcope.streaming import feed


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def files(spark, *rows):
    """Each file in two repositories, which must not mix."""
    return spark.createDataFrame([(r, p, s) for r in ("r1", "r2") for p, s in rows], "repo_id string, path string, source string")


def first(df, *columns):
    return sorted(tuple(r) for r in df.filter("repo_id = 'r1'").select(*columns).collect())


def edges(spark, *pairs):
    return spark.createDataFrame([(r, a, b, "call") for r in ("r1", "r2") for a, b in pairs], "repo_id string, src string, dst string, kind string")


def nodes(spark, **kinds):
    shape = {"view": "pill", "controller": "rectangle", "database": "cylinder", "validation": "diamond"}
    return spark.createDataFrame([(r, n, t, n, shape[t], 0.0, 0.0) for r in ("r1", "r2") for n, t in kinds.items()], "repo_id string, node_id string, type string, label string, shape string, x double, y double")


def test_routes(spark):
    table = files(spark, *[(p, "") for p in ["app/(auth)/login/page.tsx", "app/users/[id]/page.tsx", "app/docs/[...slug]/page.js", "app/page.tsx", "pages/about.tsx", "pages/index.tsx", "pages/api/auth.ts", "pages/_app.tsx", "pages/404.tsx", "src/index.js"]])
    assert first(paths.crawl_routes(table), "route", "dynamic") == [("/", False), ("/about", False), ("/docs/:slug", True), ("/login", False), ("/users/:id", True)]
    one = spark.createDataFrame([("users/[id]",), ("users/[[x]]",), ("a/(b)/c/index",), ("index",), ("[...all]",)], "s string")
    assert [r[0] for r in one.select(paths.normalize_route_param(F.col("s"))).collect()] == ["/users/:param", "/users/:param", "/a/c", "/", "/[...all]"]


def test_repo_urls(spark):
    table = spark.createDataFrame([("a/b",), ("https://github.com/a/b.git",), ("nothing here",), ("www.github.com/x-y/z.w",)], "t string")
    assert [r[0] and tuple(r[0]) for r in table.select(paths.parse_repo_url(F.col("t"))).collect()] == [("a", "b"), ("a", "b"), None, ("x-y", "z.w")]


def test_findings_have_lines(spark):
    table = files(spark, ("a", "x\nuse(1) use(2)\n\nuse(3)"), ("b", ""), ("c", None))
    assert first(findings(table, r"use\((\d)\)").select("repo_id", F.get("found", F.lit(0)).alias("n"), "line"), "n", "line") == [("1", 2), ("2", 2), ("3", 4)]


def test_scans(spark):
    table = files(
        spark,
        ("p.tsx", 'import A from "./a";\nimport "./a"\nconst b = require("../b");\nfetch("/api/x", {method: "post"});\nfetch("https://e.org/y");\naxios.get(\'/api/z\');\nuseSWR("/api/x")'),
        ("q.ts", "supabase.from('users').select();\nprisma.user.findMany();\nMath.find(1); User.findOne(2)\nINSERT INTO \"logs\""),
        ("e.ts", "process.env.A; process.env.B || 1; process.env.C ?? 2; import.meta.env.D"),
    )
    assert first(scan.scan_imports(table), "specifier", "line") == [("../b", 3), ("./a", 1)]
    assert first(scan.scan_api_calls(table), "method", "endpoint", "line") == [("GET", "/api/x", 7), ("GET", "/api/z", 6), ("POST", "/api/x", 4)]
    assert first(scan.scan_db_refs(table), "client", "table_name", "line") == [("mongoose", "user", 3), ("prisma", "user", 2), ("raw-sql", "logs", 4), ("supabase", "users", 1)]
    assert first(scan.env_variables(table), "name", "required") == [("A", True), ("B", False), ("C", False), ("VITE_D", True)]


def test_complexity_ignores_comments_and_strings(spark):
    table = files(spark, ("a", 'if (a) {} else if (b && c) {}\nfor (;;) {} // if (x)\n/* if (y) */ s = "if (z)"'), ("b", ""))
    assert first(scan.complexity(table), "path", "decisions", "level") == [("a", 4, "moderate"), ("b", 0, "low")]


def test_bottlenecks(spark):
    three = "db.query(1); db.query(2); db.query(3);"
    table = files(spark, ("a", three), ("b", three + "db.execute(1); db.execute(2)"), ("c", "import queue; " + three), ("d", "db.query(1)"))
    assert first(scan.bottlenecks(table), "path", "severity") == [("a", "medium"), ("b", "high")]


def test_five_file_app(spark):
    table = files(
        spark,
        ("app/auth/login/page.tsx", 'const s = z.object({});\nfetch("/api/auth", { method: "POST" })'),
        ("app/api/auth/route.ts", "export async function POST() { supabase.from('profiles').select() }"),
        ("app/register/page.tsx", "yup.object({}); axios.post('/api/register')"),
        ("app/api/register/route.ts", "export async function POST() { prisma.user.create({}) }"),
        ("app/dashboard/page.tsx", 'useSWR("/api/auth")'),
    )
    assert first(scan.controllers(table), "route", "methods") == [("/api/auth", "POST"), ("/api/register", "POST")]
    got = set(first(link.blueprint_edges(table), "src", "dst", "label"))
    assert ("view:/dashboard", "controller:/api/auth", "") in got
    assert ("validation:app/auth/login/page.tsx", "controller:/api/auth", "Success") in got
    assert ("validation:app/register/page.tsx", "error:app/register/page.tsx", "Failure") in got
    assert {("controller:/api/auth", "table:profiles", ""), ("controller:/api/register", "table:user", "")} <= got


def test_imports_resolve(spark):
    text = "\n".join(f'import "{s}";' for s in ["./components/Button", "@/lib/form", "../lib/auth", "./widgets", "react", "./gone"])
    table = files(spark, ("app/x/page.tsx", text), ("app/x/components/Button.tsx", ""), ("src/lib/form.ts", ""), ("app/lib/auth.ts", ""), ("app/lib/auth.js", ""), ("app/x/widgets/index.tsx", ""))
    got = dict(first(link.import_edges(table), "specifier", "target"))
    assert got == {"./components/Button": "app/x/components/Button.tsx", "@/lib/form": "src/lib/form.ts", "../lib/auth": "app/lib/auth.ts", "./widgets": "app/x/widgets/index.tsx", "react": None, "./gone": None}


def test_closure_ends_in_cycles(spark):
    table = files(spark, ("app/p/page.tsx", 'import "./a"'), ("app/p/a.ts", 'import "./b"'), ("app/p/b.ts", 'import "./a"'))
    got = first(graph.import_closure(paths.crawl_routes(table), link.import_edges(table)), "node_id", "depth")
    assert got == [("app/p/a.ts", 1), ("app/p/b.ts", 2), ("app/p/page.tsx", 0)]


def test_fuzzy_ladder(spark):
    asked = spark.createDataFrame([("r1", c) for c in ["/billing", "/users/123", "/billing/history", "/unknown", "/"]], "repo_id string, candidate string")
    known = spark.createDataFrame([("r1", r) for r in ["/", "/billing", "/users/:id"]], "repo_id string, route string")
    assert first(link.match_routes(asked, known), "candidate", "route", "rung") == [("/billing", "/billing", 1), ("/billing/history", "/billing", 3), ("/users/123", "/users/:id", 2)]


def test_blast_radius(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("z", "a"))
    got = first(graph.blast_radius(nodes(spark, a="view"), e), "node_id", "category", "depth")
    assert got == [("b", "direct", 1), ("c", "transitive", 2), ("z", "orphaned-by-deletion", 1)]


def test_cycles_but_not_diamonds(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("s", "t"), ("s", "u"), ("t", "v"), ("u", "v"), ("x", "x"), ("m", "n"), ("n", "m"), ("b", "m"))
    n = nodes(spark, **{k: "view" for k in "abcdstuvxmn"})
    assert first(graph.cycle_nodes(n, e), "node_id", "cycle") == [("a", "a"), ("b", "a"), ("c", "a"), ("m", "m"), ("n", "m"), ("x", "x")]
    assert first(graph.dag_share(n, e), "share") == [(round(1 - 6 / 11, 6),)]


def test_layers_ranks_components(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "p"), ("c", "q"))
    n = nodes(spark, **{k: "view" for k in "abcpqz"})
    assert dict(first(graph.topo_layers(n, e), "node_id", "layer")) == {"a": 0, "b": 1, "c": 2, "p": -1, "q": -1, "z": 0}
    assert dict(first(graph.longest_path_rank(n, e), "node_id", "rank"))["q"] == 3
    assert dict(first(graph.components(n, e), "node_id", "component")) == {**{k: "a" for k in "abcpq"}, "z": "z"}


def test_god_classes_and_oversized(spark):
    pairs = [(c, f"d{i}") for c, k in (("five", 5), ("six", 6), ("ten", 10)) for i in range(k)] + [(f"e{i}", t) for t, k in (("in7", 7), ("in8", 8), ("in12", 12), ("db", 12)) for i in range(k)]
    n = nodes(spark, five="controller", six="controller", ten="controller", in7="view", in8="view", in12="view", db="database")
    e = edges(spark, *pairs)
    assert first(graph.god_classes(n, e), "node_id", "severity", "parts") == [("six", "medium", 2), ("ten", "high", 4)]
    assert first(graph.oversized_files(n, e), "node_id", "severity") == [("in12", "high"), ("in8", "medium")]


def test_bypass(spark):
    n = nodes(spark, v="view", w="view", c="controller", m="validation", d="database")
    e = edges(spark, ("v", "m"), ("m", "d"), ("w", "c"), ("c", "d"))
    assert first(graph.bypass_paths(n, e), "src", "dst") == [("v", "d")]


DDL = """
CREATE TABLE users (id SERIAL PRIMARY KEY, email VARCHAR(255) UNIQUE NOT NULL, age INT CHECK (age > 0), price NUMERIC(10, 2)); -- note
CREATE TABLE `posts` (`id` INT AUTO_INCREMENT, user_id INTEGER, tag_id INT REFERENCES tags(id), PRIMARY KEY (`id`), CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users(id)) ENGINE=InnoDB;
CREATE TABLE [tags] (id INTEGER PRIMARY KEY AUTOINCREMENT, owner INTEGER);
ALTER TABLE tags ADD CONSTRAINT o FOREIGN KEY (owner) REFERENCES users (id);
"""


def test_schema_catalog(spark):
    catalog = schema.schema_catalog(files(spark, ("a.sql", DDL), ("b.sql", None), ("c.sql", "CREATE TABLE broken (a INT")))
    got = {(r["table_name"], r["name"]): r for r in catalog.filter("repo_id = 'r1'").collect()}
    assert got["users", "id"]["pk"] and got["users", "id"]["auto_increment"] and got["users", "id"]["type"] == "INTEGER"
    assert got["users", "email"]["is_unique"] and not got["users", "email"]["nullable"] and got["users", "price"]["type"] == "NUMERIC"
    assert got["posts", "id"]["pk"] and got["posts", "user_id"]["ref_table"] == "users" and got["tags", "owner"]["ref_table"] == "users"
    assert ("broken", "a") in got
    assert first(schema.many_to_many(catalog), "junction", "table_a", "table_b") == [("posts", "tags", "users")]
    assert "REFERENCES `users`(`id`)" in schema.export_ddl(catalog, "mysql").filter("table_name = 'posts'").first()["ddl"]


def test_diff(spark):
    kinds = "repo_id string, id long, label string, shape string"
    base = spark.createDataFrame([("r1", i, "a", "s") for i in range(1, 5)], kinds)
    head = spark.createDataFrame([("r1", 2, "b", "s"), ("r1", 3, "b", "t"), ("r1", 4, "a", "s"), ("r1", 5, "a", "s")], kinds)
    args = (["repo_id", "id"], ["label", "shape"])
    assert first(link.node_diff(base, head, *args), "id", "status", "changes") == [(1, "deleted", ""), (2, "modified", "label"), (3, "conflict", "label,shape"), (4, "unchanged", ""), (5, "added", "")]
    assert {r["status"] for r in link.node_diff(base, base, *args).collect()} == {"unchanged"}
    again = upsert(upsert(base, head, ["repo_id", "id"], ["label"]), head, ["repo_id", "id"], ["label"])
    assert first(again, "id", "label") == [(1, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "a")]


def test_sections(spark):
    n = spark.createDataFrame([("r1", "edge", 10.0, 10.0), ("r1", "two", 5.0, 5.0), ("r1", "out", 99.0, 0.0)], "repo_id string, node_id string, x double, y double")
    s = spark.createDataFrame([("r1", "s1", 0.0, 0.0, 10.0, 10.0), ("r1", "s2", 4.0, 4.0, 2.0, 2.0)], "repo_id string, section_id string, x double, y double, w double, h double")
    assert first(link.assign_section(n, s), "node_id", "section_id") == [("edge", "s1"), ("out", None), ("two", "s1")]


def test_graph_json_round_trip(spark):
    n, e = nodes(spark, a="view", b="database"), edges(spark, ("a", "b"))
    back_nodes, back_edges = read_graph_json(graph_json(n, e))
    assert first(back_nodes, "node_id", "type") == [("a", "view"), ("b", "database")] and first(back_edges, "src", "dst") == [("a", "b")]


CHANGES = "event_id long, ts timestamp, repo_id string, node_id string, path string, change string"


def feed_rows(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(1, "n1", "added"), (2, "n1", "modified"), (3, "n2", "added"), (4, "n2", "deleted"), (5, "old", "deleted"), (6, "n3", "deleted"), (7, "n3", "added")]
    return spark.createDataFrame([(i, start + timedelta(seconds=i), "r1", n, f"src/api/{n}.ts", c) for i, n, c in rows], CHANGES)


def test_mutations_fold_in_order(spark):
    known = spark.createDataFrame([("r1", "old", "x", "x"), ("r1", "stay", "x", "x")], "repo_id string, node_id string, type string, label string")
    assert first(feed.apply_mutations(known, feed.mutations(feed_rows(spark))), "node_id") == [("n1",), ("n3",), ("stay",)]


def test_stream_equals_batch(spark, tmp_path):
    known = spark.createDataFrame([("r1", "old", "x", "x"), ("r1", "stay", "x", "x")], "repo_id string, node_id string, type string, label string")
    rows = feed_rows(spark)
    for k, low in enumerate((0, 3, 5)):
        rows.filter(f"event_id > {low} AND event_id <= {(3, 5, 7)[k]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state = {"path": f"{tmp_path}/s0", "k": 0}
    known.write.parquet(state["path"])

    def write(table):
        state["k"] += 1
        table.write.parquet(f"{tmp_path}/s{state['k']}")
        state["path"] = f"{tmp_path}/s{state['k']}"

    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed.follow(stream, lambda: spark.read.parquet(state["path"]), write, f"{tmp_path}/c").awaitTermination(120)
    assert state["k"] >= 2
    assert first(spark.read.parquet(state["path"]), "node_id") == [("n1",), ("n3",), ("stay",)]


def test_presence(spark):
    rows = [("p", "a", "move", 0), ("p", "a", "move", 5), ("p", "b", "move", 14), ("p", "b", "leave", 15), ("p", "c", "move", 4.999), ("p", "d", "move", 15)]
    table = spark.createDataFrame([(*r[:3], float(r[3])) for r in rows], "project_id string, user_id string, kind string, t double").selectExpr("project_id", "user_id", "kind", "timestamp_micros(cast(t * 1000000 AS BIGINT)) AS ts")
    assert sorted(r["user_id"] for r in feed.presence(table).collect()) == ["a", "d"]


def test_keep_first_and_empty_inputs(spark):
    table = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 1, "c")], "key string, pos int, v string")
    assert [tuple(r) for r in keep_first(table, ["key"], ["pos"]).collect()] == [("k", 1, "a")]
    none, e = files(spark).limit(0), edges(spark, ("a", "b")).limit(0)
    assert link.blueprint_edges(none).count() == 0 and graph.cycle_nodes(nodes(spark, a="view").limit(0), e).count() == 0
    assert graph.components(nodes(spark, a="view"), e).count() == 2
