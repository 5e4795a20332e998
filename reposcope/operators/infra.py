"""What a repository is deployed on, by its configuration files, and the part of a file that made a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Configuration files by path, what they announce, and how resources are named.
AWS_FILES = r"aws|terraform|cloudformation|\.tf$|\.tfvars$"
BUCKET = r'aws_s3_bucket[^"]*"([^"]+)"'
SUPABASE_CLIENT = "@supabase/supabase-js"
#: Deployment targets by path: pattern, provider, name. The first always counts, the others only without another target.
TARGETS = [
    (r"vercel\.json", "vercel", "Vercel Edge Network"),
    (r"next\.config", "vercel", "Vercel Edge Network"),
    (r"dockerfile", "aws", "Docker Container"),
    (r"wrangler\.toml|cloudflare-worker", "cloudflare", "Cloudflare Workers"),
    (r"netlify\.", "netlify", "Netlify Edge"),
]
#: Other resources: pattern of the path, pattern of the source, type, provider, name.
RESOURCES = [
    (r"vercel\.json", r"storage|blob", "storage", "vercel", "Vercel Blob Storage"),
    (r"vercel\.json", r"functions|middleware", "function", "vercel", "Vercel Edge Middleware"),
    (AWS_FILES, r"aws_lambda_function|Lambda", "function", "aws", "AWS Lambda"),
    (AWS_FILES, r"cloudfront|CloudFront", "cdn", "aws", "CloudFront CDN"),
    (r"wrangler\.toml|cloudflare-worker", r"r2|bucket", "storage", "cloudflare", "Cloudflare R2"),
    (r"netlify\.", r"functions", "function", "netlify", "Netlify Functions"),
]
SUPABASE_STORAGE = r"\.storage\.|createBucket|storage\.from"
#: Characters of a file that stand for a node without a part of its own.
SNIPPET = 2000
METHOD_PART = r"(?m)export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)\s*\([\s\S]*?^\}"
HANDLER_PART = r"(?m)export\s+default\s+async\s+function\s+handler\s*\([\s\S]*?^\}"
ZOD_PART = r"const\s+\w+\s*=\s*z\.object\s*\([\s\S]*?\)"
YUP_PART = r"const\s+\w+\s*=\s*yup\.object\s*\([\s\S]*?\)"
TABLE_PARTS = [(r"(?i)CREATE\s+TABLE[^;]*\b", r"\b[^;]*;"), (r"(?i)(?:SELECT|INSERT|UPDATE|DELETE)[\s\S]*?FROM[^;]*\b", r"\b[^;]*;")]


def _resource(kind: str, provider: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(provider).alias("provider"), name.alias("name"))


def infra_resources(files: DataFrame) -> DataFrame:
    """(repo_id, path, type, provider, name): buckets, functions and CDNs that configuration files announce, once per file.

    One pass without a shuffle but the last; null paths and sources announce nothing.
    """
    p, s = F.lower("path"), F.coalesce("source", F.lit(""))
    found = [F.when(p.rlike(path) & s.rlike(text), _resource(kind, provider, F.lit(name))) for path, text, kind, provider, name in RESOURCES]
    ours = p.contains("supabase") | s.contains(SUPABASE_CLIENT)
    found.append(F.when(ours & s.rlike(SUPABASE_STORAGE), _resource("storage", "supabase", F.lit("Supabase Storage"))))
    found.append(F.when(ours & p.rlike(r"/functions/.*\.ts$"), _resource("function", "supabase", F.lit("Supabase Edge Function"))))
    found.append(F.when(p.contains("/netlify/functions/") & p.rlike(r"netlify\."), _resource("function", "netlify", F.lit("Netlify Functions"))))
    buckets = F.when(p.rlike(AWS_FILES), F.transform(F.regexp_extract_all(s, F.lit(BUCKET), F.lit(1)), lambda b: _resource("storage", "aws", F.concat(F.lit("S3: "), b))))
    every = F.concat(F.array_compact(F.array(*found)), F.coalesce(buckets, F.expr("array()")))
    return files.select("repo_id", "path", F.explode(every).alias("r")).select("repo_id", "path", "r.type", "r.provider", "r.name").distinct()


def deployment_targets(files: DataFrame) -> DataFrame:
    """(repo_id, path, provider, name): where each repository runs: its vercel.json, else its first file of another target.

    Files go by path; a file that fits several targets is the first of them in TARGETS.
    """
    p = F.lower("path")
    kind = F.coalesce(*[F.when(p.rlike(pattern), F.struct(F.lit(k > 0).alias("weak"), F.lit(provider).alias("provider"), F.lit(name).alias("name"))) for k, (pattern, provider, name) in enumerate(TARGETS)])
    rows = files.select("repo_id", "path", kind.alias("k")).filter("k IS NOT NULL")
    first = rows.groupBy("repo_id").agg(F.min(F.struct("k.weak", "path", "k.provider", "k.name")).alias("t"))
    return first.select("repo_id", "t.path", "t.provider", "t.name")


def code_snippet(source: Column, kind: Column, label: Column) -> Column:
    """The part of a file that made a node: a controller's first handler, a validation's schema, a table's statement.

    Views and nodes whose part is not found get the beginning of the file,
    with a note where it is cut (this cut is the feature). A null source has no
    snippet.
    """
    part = lambda pattern: F.nullif(F.regexp_extract(source, pattern, 0), F.lit(""))
    quoted = F.concat(F.lit("\\Q"), F.regexp_replace(label, r"\\E", ""), F.lit("\\E"))
    tables = [F.nullif(F.regexp_substr(source, F.concat(F.lit(a), quoted, F.lit(b))), F.lit("")) for a, b in TABLE_PARTS]
    cut = F.when(F.length(source) > SNIPPET, F.concat(F.left(source, F.lit(SNIPPET)), F.lit("\n\n// ... (truncated)"))).otherwise(source)
    found = (
        F.when(kind == "controller", F.coalesce(part(METHOD_PART), part(HANDLER_PART)))
        .when(kind == "validation", F.coalesce(part(ZOD_PART), part(YUP_PART)))
        .when(kind == "database", F.coalesce(*tables))
    )
    return F.coalesce(found, cut)


def snippets(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, path, type, label, snippet): the part of its file that made each node (repo_id, path, type, label)."""
    both = nodes.select("repo_id", "path", "type", "label").join(files.select("repo_id", "path", "source"), ["repo_id", "path"])
    return both.select("repo_id", "path", "type", "label", code_snippet(F.col("source"), F.col("type"), F.col("label")).alias("snippet"))
