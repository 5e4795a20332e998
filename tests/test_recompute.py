"""Pushes as mutations, and tables computed again for touched repositories."""

from pathlib import Path

from pyspark.sql import functions as F
from test_reference import spark  # noqa: F401

from reposcope.operators import link
from reposcope.streaming import recompute as rc

PUSHES = "repo_id string, event_id long, commits array<struct<files: array<struct<path: string, change: string>>>>"
CHANGES = "repo_id string, path string, source string, ts long, event_id long"


def test_commits(spark):  # noqa: F811
    pushes = spark.createDataFrame(
        [
            ("r", 1, [([("src/api/users/route.ts", "added"), ("lib/Orders.ts", "modified")],), ([("lib/none.ts", "deleted"), ("x/auth/login.tsx", "deleted"), (None, "added")],)]),
            ("r", 2, [(None,), ([(".env", "modified")],)]), ("s", 3, [([("lib/orders.ts", "modified"), ("a/b.ts", "modified")],)]), ("t", 4, None),
        ], PUSHES,
    )
    nodes = spark.createDataFrame([("r", "n1", "Other"), ("r", "n2", "My ORDERS table"), ("r", "n3", "auth"), ("r", "n0", "big orders"), ("s", "m1", None), ("s", "m2", "orders")], "repo_id string, node_id string, label string")
    got = {(r["event_id"], r["commit_no"], r["file_no"]): (r["action"], r["node_id"], r["label"]) for r in rc.commit_mutations(rc.pushed_files(pushes), nodes).collect()}
    assert got.pop((1, 0, 0))[0] == "add"
    assert got == {(1, 0, 1): ("update", "n0", "big orders"), (1, 1, 1): ("delete", "n3", "auth"), (2, 1, 0): ("update", "n0", "big orders"), (3, 0, 0): ("update", "m1", None), (3, 0, 1): ("update", "m1", None)}


def imports(rows):
    return sorted((r["repo_id"], r["path"], r["specifier"], r["target"]) for r in rows.collect())


def test_stream_recomputes_only_what_it_touches(spark, tmp_path):  # noqa: F811
    jobs, folder = {"imports": link.import_edges, "stats": lambda f: f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))}, str(tmp_path / "out")
    batches = [
        [("a", "src/x.ts", 'import y from "./y";', 1, 1), ("a", "src/y.ts", "1", 1, 2), ("b", "src/x.ts", 'import z from "./z";', 1, 3)],
        [("b", "src/z.ts", "1", 2, 4), ("b", "src/z.ts", "2", 2, 5), ("c", "c.ts", "1", 2, 6)],
        [("a", "src/y.ts", None, 3, 7), ("c", "c.ts", None, 3, 8), ("b", "src/x.ts", 'import q from "./q";', 3, 9), ("b", "src/x.ts", 'import z from "./z";\nimport "./q";', 4, 1)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rc.follow_files(stream, folder, jobs, f"{tmp_path}/c").awaitTermination(300)
    final = spark.createDataFrame([("a", "src/x.ts", 'import y from "./y";'), ("b", "src/x.ts", 'import z from "./z";\nimport "./q";'), ("b", "src/z.ts", "2")], rc.FILES)
    schema = link.import_edges(final).schema
    read = lambda: imports(rc.read_repositories(spark, f"{folder}/imports", schema))
    assert read() == imports(link.import_edges(final)) and len(read()) == 3
    counts = rc.read_repositories(spark, f"{folder}/stats", jobs["stats"](final).schema)
    assert sorted(tuple(r) for r in counts.select("repo_id", "n").collect()) == [("a", 1), ("b", 2)]
    files = lambda repo: {p: p.stat().st_mtime_ns for p in Path(folder, "imports", f"repo_id={repo}").glob("*.parquet")}
    a, b = files("a"), files("b")
    rc.recompute(spark, folder, spark.createDataFrame([r for r in batches[2] if r[0] == "b"], CHANGES), jobs)  # the same again
    assert read() == imports(link.import_edges(final)) and files("a") == a and files("b") != b
