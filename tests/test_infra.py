"""Deployment, snippets, keys, crawled routes, bottlenecks and CRUD kinds by hand-written cases."""

from pyspark.sql import functions as F
from test_reference import files, first, spark  # noqa: F401

from reposcope.functions import paths
from reposcope.operators import infra, link, scan, schema

TERRAFORM = 'aws_lambda_function aws_cloudfront_distribution\naws_s3_bucket "media"'


def test_resources_and_targets_of_configuration_files(spark):  # noqa: F811
    made = files(spark, *{
        "vercel.json": '{"functions": {}, "blob": 1}', "a/Dockerfile": "FROM x", "main.tf": TERRAFORM, "wrangler.toml": "bucket",
        "supabase/functions/go.ts": "client.storage.from('a')", "plain.ts": "storage functions bucket", "empty.tf": None,
    }.items())
    found = first(infra.infra_resources(made), "path", "type", "name")
    assert found == sorted([
        ("main.tf", "cdn", "CloudFront CDN"), ("main.tf", "function", "AWS Lambda"), ("main.tf", "storage", "S3: media"),
        ("supabase/functions/go.ts", "function", "Supabase Edge Function"), ("supabase/functions/go.ts", "storage", "Supabase Storage"),
        ("vercel.json", "function", "Vercel Edge Middleware"), ("vercel.json", "storage", "Vercel Blob Storage"), ("wrangler.toml", "storage", "Cloudflare R2"),
    ])
    assert first(infra.deployment_targets(made), "path", "provider") == [("vercel.json", "vercel")]
    assert first(infra.deployment_targets(made.filter("path <> 'vercel.json'")), "path", "name") == [("a/Dockerfile", "Docker Container")]
    assert infra.deployment_targets(made.limit(0)).count() == infra.infra_resources(made.limit(0)).count() == 0


def test_snippets(spark):  # noqa: F811
    route = "const a = 1;\nexport async function GET(r) {\n  if (r) { x(); }\n}\nexport function POST() {\n}\n"
    ddl = "CREATE TABLE a (id INT);\nCREATE TABLE b (id INT);\nSELECT 1 FROM c;"
    cases = [
        ("controller", "x", route, "export async function GET(r) {\n  if (r) { x(); }\n}"),
        ("controller", "x", "export default async function handler() {\n}", "export default async function handler() {\n}"),
        ("validation", "x", "a; const s = z.object({n: z.string()}); b", "const s = z.object({n: z.string()"),
        ("database", "b", ddl, "CREATE TABLE b (id INT);"), ("database", "c", ddl, "SELECT 1 FROM c;"),
        ("database", "(", ddl, ddl), ("view", "x", "v" * 2001, "v" * 2000 + "\n\n// ... (truncated)"), ("controller", "x", "none", "none"), ("view", "x", "", ""), ("view", "x", None, None),
    ]
    rows = spark.createDataFrame(cases, "kind string, label string, source string, wanted string")
    found = rows.select("wanted", infra.code_snippet(F.col("source"), F.col("kind"), F.col("label")).alias("snippet")).collect()
    assert [r.snippet for r in found] == [c[3] for c in cases]


def test_reference_map(spark):  # noqa: F811
    ddl = "CREATE TABLE users (id INT PRIMARY KEY);\nCREATE TABLE posts (id INT, owner INT UNIQUE REFERENCES users(id), tag INT REFERENCES gone(id));"
    catalog = schema.schema_catalog(files(spark, ("a.sql", ddl)))
    keys = schema.foreign_keys(catalog)
    assert first(keys, "src_column", "cardinality") == [("owner", "one-to-one"), ("tag", "one-to-many")]
    assert first(schema.reference_map(keys, catalog), "table_name", "name", "ref") == [("posts", "owner", "users.id")]


def test_server_files_and_index_folders_are_routes(spark):  # noqa: F811
    made = files(spark, *dict.fromkeys(["backend/server.ts", "web/blog/index.tsx", "lib/x/index.ts", "routes/users.js", "src/index.ts", "pages/api/index.ts", "web/v1.2/index.js"], "").items())
    assert first(paths.crawl_routes(made), "route", "path") == [("/", "src/index.ts"), ("/api/server", "backend/server.ts"), ("/web/blog", "web/blog/index.tsx")]


def test_routes_inside_of_candidates(spark):  # noqa: F811
    asked = spark.createDataFrame([("r1", "/v2/users/list"), ("r1", "/users/1"), ("r1", "x"), ("r1", None)], "repo_id string, candidate string")
    known = spark.createDataFrame([("r1", "/users"), ("r1", "/us"), ("r1", "/")], "repo_id string, route string")
    assert first(link.match_routes(asked, known, inside=True), "candidate", "route", "rung") == [("/users/1", "/users", 3), ("/v2/users/list", "/users", 4)]
    assert first(link.match_routes(asked, known), "candidate", "rung") == [("/users/1", 3)]


def test_mail_loops_and_verbs(spark):  # noqa: F811
    made = files(spark, *{"app/api/a/route.ts": "export async function GET() { await db.insert(x); nodemailer(); }", "app/api/b/route.ts": "export async function PATCH() {}", "loop.ts": "a.query(1); a.query(2); a.query(3); Promise.all(x)"}.items())
    assert first(scan.bottlenecks(made), "path", "kind") == [("app/api/a/route.ts", "sync_email"), ("loop.ts", "sync_db_chain"), ("loop.ts", "sync_heavy_loop")]
    assert first(scan.crud_type(made), "path", "crud") == [("app/api/a/route.ts", "CREATE"), ("app/api/b/route.ts", "UPDATE")]
