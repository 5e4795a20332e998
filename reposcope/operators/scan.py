"""Findings in source texts: imports, calls, tables, routes, variables, complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.paths import tidy_route
from reposcope.functions.text import count_matches, findings, keep_first, matches, union

KEYS = ["repo_id", "path"]
QUOTE = "['\"`]"

# The patterns of what is looked for. They stand for JavaScript's and hold for Java and RE2 alike.
IMPORT = r"\bimport\s+(?:[^'\";]+\s+from\s+)?['\"`]([^'\"`]+)['\"`]"
REQUIRE = r"\brequire\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)"
FETCH = r"fetch\s*\(\s*['\"`]([^'\"`]+)['\"`](?:[^)]*?method\s*:\s*['\"](\w+)['\"])?[^)]*\)"
AXIOS = r"axios\s*\.\s*(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
HOOK = r"use(?:SWR|Fetch)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
FROM_TABLE = r"\.from\s*\(\s*['\"`]([a-zA-Z_]\w*)['\"`]"
PRISMA = r"prisma\.([a-zA-Z_]\w*)\.(?:findMany|findUnique|findFirst|create|update|delete|upsert|count|aggregate)\s*\("
MODEL = r"\b([A-Z]\w*)\.(?:find|findOne|findById|create|updateOne|deleteOne|save)\s*\("
NOT_MODELS = ["Math", "Object", "Array", "JSON", "Promise", "Date", "Error", "Response", "Request"]
RAW_SQL = r"(?:CREATE\s+TABLE|INSERT\s+INTO|DELETE\s+FROM)\s+[\"`]?([a-zA-Z_]\w*)"
CREATE_TABLE = r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)"
ALTER_TABLE = r"(?i)\bALTER\s+TABLE\s+[`\"]?(\w+)"
CODE_TABLE = r"(?i)\.(?:from|into|table)\s*\(\s*['\"`]([a-zA-Z_][a-zA-Z0-9_]*)['\"`]"
SQL_WORD = r"(?i)(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
EXPRESS = r"(?:app|router)\s*\.\s*(get|post|put|delete|patch|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
ROUTE_TAG = r"<Route[^>]*\bpath\s*=\s*[\"']([^\"']+)[\"']"
ROUTE_STRING = r"['\"`](/[a-zA-Z0-9_\-/:{}.@?=&+~%]+)['\"`]"
ENV = r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)"
META_ENV = r"import\.meta\.env\.([A-Za-z_][A-Za-z0-9_]*)"
ENV_DEFAULT = r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)\s*(?:\|\||\?\?)"
VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH"]
VALIDATIONS = {
    "zod": r"z\.\s*(string|number|email|password|boolean|date|enum|array|object)\s*\(|\.safeParse\s*\(|\.parse\s*\(",
    "yup": r"yup\.\s*(object|string|number|boolean|date|array)\s*\(|\.validate\s*\(|\.validateSync\s*\(",
    "custom": r"if\s*\(\s*!|throw\s+new\s+Error\s*\(",
}
DECISIONS = {
    "ifs": r"\bif\s*\(", "fors": r"\bfor\s*\(", "whiles": r"\bwhile\s*\(", "cases": r"\bcase\s+",
    "catches": r"\bcatch\s*\(", "ternaries": r"\?\s*[^:]+\s*:", "ands": r"&&", "ors": r"\|\|", "nullish": r"\?\?",
}
NOISE = [
    (r"(?m)//.*$", ""), (r"/\*[\s\S]*?\*/", ""), (r"(?m)--.*$", ""),
    # possessive loops over plain characters: Java would otherwise recurse once per character
    (r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'", "''"), (r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"', '""'), (r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`", "``"),
]
DELEGATION = r"(?i)bull|redis|rabbitmq|amqp|sidekiq|celery|kafka|queue|worker|background.?task|edge.?function|serverless.?function"
PAYMENT = r"(?i)stripe\.(charges|customers|payments|invoices)|paypal|braintree|square\.|payment.*process|charge.*create"
MAIL = r"(?i)sendgrid|mailgun|postmark|ses\.send|nodemailer|resend|brevo|smtp.*send"
ASYNC_LOOP = r"for\s*\(.*await|for await|\.map\s*\(\s*async|\.forEach\s*\(\s*async|Promise\.all|\.map\(.*await"
#: Database operations and what one of them counts: 1 or 2 a file, or each match (0).
DB_OPERATIONS = [
    (r"await\s+\w+\.insert", 1), (r"await\s+\w+\.update", 1), (r"await\s+\w+\.delete", 1), (r"await\s+\w+\.create", 1), (r"await\s+\w+\.save", 1),
    (r"\.query\(", 0), (r"\.execute\(", 0), (r"prisma\.\w+\.(create|update|delete|upsert)", 2), (r"supabase.*\.(insert|update|delete|upsert)", 2),
    (r"knex\((insert|update|delete)", 2), (r"sequelize.*(create|update|destroy)", 2),
]
CRUD = {
    "CREATE": r"\.\s*create\s*\(|\.insert\s*\(|\.insertMany\s*\(|\.insertOne\s*\(|\.save\s*\(|\.add\s*\(",
    "READ": r"\.\s*find\s*\(|\.findOne\s*\(|\.findMany\s*\(|\.findById\s*\(|\.findFirst\s*\(|\.get\s*\(|\.select\s*\(|\.findAll\s*\(|\.findUnique\s*\(",
    "UPDATE": r"\.\s*update\s*\(|\.updateOne\s*\(|\.updateMany\s*\(|\.patch\s*\(|\.put\s*\(|\.upsert\s*\(",
    "DELETE": r"\.\s*delete\s*\(|\.deleteOne\s*\(|\.deleteMany\s*\(|\.remove\s*\(|\.destroy\s*\(",
}
#: Exported verbs of an API file, asked in this order where no call tells what it does.
CRUD_VERBS = {"CREATE": "post", "READ": "get", "UPDATE": "(?:put|patch)", "DELETE": "delete"}
EXPORTED_VERB = r"export\s+async\s+function\s+{}\b"


def _found(k: int = 0) -> Column:
    return F.get("found", F.lit(k))


def scan_imports(files: DataFrame) -> DataFrame:
    """(repo_id, path, specifier, line): import and require specifiers, once per file."""
    every = union([findings(files, p).select(*KEYS, _found().alias("specifier"), "line") for p in (IMPORT, REQUIRE)])
    return every.groupBy(*KEYS, "specifier").agg(F.min("line").alias("line"))


def scan_api_calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, method, endpoint, line): calls to local endpoints, once per method and endpoint.

    The method of a fetch is looked for among its arguments; without one it is GET.
    """
    parts = [
        findings(files, FETCH, 2).select(*KEYS, F.coalesce(F.nullif(F.upper(_found(1)), F.lit("")), F.lit("GET")).alias("method"), _found().alias("endpoint"), "line"),
        findings(files, AXIOS, 2).select(*KEYS, F.upper(_found()).alias("method"), _found(1).alias("endpoint"), "line"),
        findings(files, HOOK).select(*KEYS, F.lit("GET").alias("method"), _found().alias("endpoint"), "line"),
    ]
    return union(parts).filter(F.col("endpoint").rlike(r"^(/|\./|\.\./)")).groupBy(*KEYS, "method", "endpoint").agg(F.min("line").alias("line"))


def scan_db_refs(files: DataFrame) -> DataFrame:
    """(repo_id, path, client, table_name, line): tables that a file uses, once per client."""
    model = _found()
    parts = [
        findings(files, FROM_TABLE).select(*KEYS, F.lit("supabase").alias("client"), _found().alias("table_name"), "line"),
        findings(files, PRISMA).select(*KEYS, F.lit("prisma").alias("client"), _found().alias("table_name"), "line"),
        findings(files, MODEL).filter(~model.isin(NOT_MODELS)).select(*KEYS, F.lit("mongoose").alias("client"), F.lower(model).alias("table_name"), "line"),
        findings(files, RAW_SQL).select(*KEYS, F.lit("raw-sql").alias("client"), _found().alias("table_name"), "line"),
    ]
    return union(parts).groupBy(*KEYS, "client", "table_name").agg(F.min("line").alias("line"))


def scan_table_names(files: DataFrame) -> DataFrame:
    """(repo_id, path, context, table_name, n): tables created or altered, and named in code."""
    patterns = {"CREATE TABLE": CREATE_TABLE, "ALTER TABLE": ALTER_TABLE, "query": CODE_TABLE, "raw SQL": SQL_WORD}
    every = union([findings(files, p).select(*KEYS, F.lit(c).alias("context"), _found().alias("table_name")) for c, p in patterns.items()])
    return every.filter(~F.upper("table_name").isin("SELECT", "WHERE", "AND", "OR", "SET", "VALUES")).groupBy(*KEYS, "context", "table_name").agg(F.count(F.lit(1)).alias("n"))


def scan_express_routes(files: DataFrame) -> DataFrame:
    """(repo_id, path, route, dynamic, line): routes of app.get and its like, once per file."""
    every = findings(files, EXPRESS, 2).select(*KEYS, _found(1).alias("route"), "line")
    return every.groupBy(*KEYS, "route").agg(F.min("line").alias("line")).withColumn("dynamic", F.col("route").rlike("[:*]"))


def scan_spa_routes(files: DataFrame) -> DataFrame:
    """(repo_id, path, route): paths of <Route> tags but * and /."""
    return findings(files, ROUTE_TAG).select(*KEYS, _found().alias("route")).filter(~F.col("route").isin("*", "/")).distinct()


def scan_route_strings(files: DataFrame, keys: list[str] = KEYS, source: str = "source") -> DataFrame:
    """(keys, route, line): quoted strings that look like routes, once per file."""
    s = F.col("route")
    every = findings(files.select(*keys, source), ROUTE_STRING, source=source).select(*keys, _found().alias("route"), "line")
    return every.filter(~s.rlike(r"(?i)\.[a-z0-9]{2,5}$") & ~s.startswith("//") & (F.length(s) <= 100)).groupBy(*keys, "route").agg(F.min("line").alias("line"))


def controllers(files: DataFrame) -> DataFrame:
    """(repo_id, route, path, methods): API route files; methods joined by commas."""
    p = F.col("path")
    app = F.regexp_extract(p, r"(?:^|/)app/(.+)/route\.(?:ts|tsx|js|jsx)$", 1)
    pages = F.regexp_extract(p, r"(?:^|/)pages/(api/.+)\.(?:ts|tsx|js|jsx)$", 1)
    verbs = F.array_join(F.array_compact(F.array(*[F.when(F.col("source").rlike(rf"export\s+(?:async\s+)?function\s+{v}\b"), v) for v in VERBS])), ",")
    segment = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(app, F.lit("")), pages), r"\[\[?\w+\]?\]", ":param"), r"\([^)]+\)", "")
    rows = files.select("repo_id", tidy_route(segment).alias("route"), "path", F.when(app != "", verbs).otherwise("HANDLER").alias("methods"), F.concat(app, pages).alias("found"))
    return keep_first(rows.filter("found <> '' AND methods <> ''").drop("found"), ["repo_id", "route"], ["path"])


def validation_kind(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind): zod, yup or custom validation of a file, the first that it uses."""
    kind = F.coalesce(*[F.when(F.col("source").rlike(p), k) for k, p in VALIDATIONS.items()])
    return files.select(*KEYS, kind.alias("kind")).filter("kind IS NOT NULL").distinct()


def env_variables(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, context, line, required): variables of the environment, optional if they have a default."""
    parts = [
        findings(files, ENV).select(*KEYS, _found().alias("name"), F.lit("process.env").alias("context"), "line"),
        findings(files, META_ENV).select(*KEYS, F.concat(F.lit("VITE_"), _found()).alias("name"), F.lit("import.meta.env").alias("context"), "line"),
    ]
    optional = findings(files, ENV_DEFAULT).select(*KEYS, _found().alias("name")).distinct().withColumn("optional", F.lit(True))
    every = union(parts).groupBy(*KEYS, "name", "context").agg(F.min("line").alias("line"))
    return every.join(optional, [*KEYS, "name"], "left").select(*KEYS, "name", "context", "line", F.col("optional").isNull().alias("required"))


# Names of settings with the prefix of a framework, and names that are asked for by a call.
CONFIG_KEYS = [r"(?i)(?:NEXT_PUBLIC|VITE_|REACT_APP_|NUXT_ENV_|GATSBY_)([A-Za-z_][A-Za-z0-9_]*)", r"(?i)getenv\s*\(\s*['\"`]([A-Za-z_][A-Za-z0-9_]*)['\"`]\s*\)"]


def env_scan(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, context, line, required): each name of the environment once per file, by the first context that has it.

    Contexts are process.env, import.meta.env and config-key, in this order. A
    name with a default anywhere in the file is not required.
    """
    ranked = [(0, "process.env", ENV, ""), (1, "import.meta.env", META_ENV, "VITE_"), *[(2 + k, "config-key", p, "") for k, p in enumerate(CONFIG_KEYS)]]
    parts = [findings(files, p).select(*KEYS, F.concat(F.lit(prefix), _found()).alias("name"), F.lit(k).alias("rank"), F.lit(context).alias("context"), "line") for k, context, p, prefix in ranked]
    once = keep_first(union(parts), [*KEYS, "name"], ["rank", "line", "context"])
    optional = findings(files, ENV_DEFAULT).select(*KEYS, _found().alias("name")).distinct().withColumn("optional", F.lit(True))
    return once.join(optional, [*KEYS, "name"], "left").select(*KEYS, "name", "context", "line", F.col("optional").isNull().alias("required"))


def complexity(files: DataFrame) -> DataFrame:
    """(repo_id, path, decisions, complexity, level): decisions outside of comments and strings, plus one.

    An else-if is an if, so it is not counted apart.
    """
    code = F.col("source")
    for pattern, put in NOISE:
        code = F.regexp_replace(code, pattern, put)
    decisions = sum((count_matches(F.col("code"), p) for p in DECISIONS.values()), F.lit(0))
    counted = files.select(*KEYS, code.alias("code")).select(*KEYS, decisions.alias("decisions"))
    level = F.when(F.col("decisions") < 3, "low").when(F.col("decisions") < 7, "moderate").when(F.col("decisions") < 12, "high").otherwise("very-high")
    return counted.select(*KEYS, "decisions", (F.col("decisions") + 1).alias("complexity"), level.alias("level"))


def bottlenecks(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, severity, operations): files without delegation that chain database work, take payments,
    send mail beside database work, or loop over awaited calls with more than two database operations."""
    s = F.col("source")
    n = sum((count_matches(s, p) if w == 0 else F.when(s.rlike(p), w).otherwise(0) for p, w in DB_OPERATIONS), F.lit(0))
    rows = files.filter(~s.rlike(DELEGATION)).select(*KEYS, n.alias("operations"), s.rlike(PAYMENT).alias("pays"), s.rlike(MAIL).alias("mails"), s.rlike(ASYNC_LOOP).alias("loops"))
    found = F.array_compact(
        F.array(
            F.when(F.col("operations") >= 3, F.struct(F.lit("sync_db_chain").alias("kind"), F.when(F.col("operations") >= 5, "high").otherwise("medium").alias("severity"))),
            F.when(F.col("pays"), F.struct(F.lit("sync_payment").alias("kind"), F.lit("high").alias("severity"))),
            F.when(F.col("mails") & (F.col("operations") > 0), F.struct(F.lit("sync_email").alias("kind"), F.lit("medium").alias("severity"))),
            F.when(F.col("loops") & (F.col("operations") > 2), F.struct(F.lit("sync_heavy_loop").alias("kind"), F.lit("medium").alias("severity"))),
        )
    )
    return rows.select(*KEYS, "operations", F.explode(found).alias("f")).select(*KEYS, "f.kind", "f.severity", "operations").distinct()


def crud_kind(text: Column) -> Column:
    """What an API file does to its data, by the calls in its lower-cased text, else by its exported verbs."""
    has = {k: matches(text, p) for k, p in CRUD.items()}
    kind = (
        F.when(has["READ"] & ~has["CREATE"] & ~has["UPDATE"], "READ")
        .when(has["UPDATE"] & ~has["CREATE"], "UPDATE")
        .when(has["CREATE"], "CREATE")
        .when(has["DELETE"] & ~has["READ"], "DELETE")
    )
    for crud, verb in CRUD_VERBS.items():
        kind = kind.when(text.rlike(EXPORTED_VERB.format(verb)), crud)
    return kind.otherwise("API")


def crud_type(files: DataFrame) -> DataFrame:
    """(repo_id, path, crud): the CRUD kind of each API file."""
    return files.filter(F.col("path").contains("/api/")).select(*KEYS, crud_kind(F.lower("source")).alias("crud")).distinct()


def package_dependencies(files: DataFrame) -> DataFrame:
    """(repo_id, path, dependency, dev): dependencies of package.json files."""
    spec = F.from_json("source", "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>")
    rows = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select(*KEYS, spec.alias("s"))
    each = [rows.select(*KEYS, F.explode(F.map_keys(f"s.{k}")).alias("dependency"), F.lit(dev).alias("dev")) for k, dev in (("dependencies", False), ("devDependencies", True))]
    return union(each).distinct()


def token_stats(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, numbers, operators): lexical classes of a text, counted in place without a row per token."""
    c = F.col(text)
    return texts.select(
        key,
        count_matches(c, r"[A-Za-z_]\w*").cast("long").alias("words"),
        count_matches(c, r"\b[0-9]+").cast("long").alias("numbers"),
        count_matches(c, r"[-+*/%=<>!&|^~?:]").cast("long").alias("operators"),
    )


# Exports, any HTTP call, lines that declare something, validation schema fields.
EXPORT = r"export\s+(?:async\s+)?(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)"
EXPORT_LIST = r"export\s*\{([^}\n]+)\}"
ANY_FETCH = r"fetch\s*\(\s*['\"`]([^'\"`]+)['\"`]"
SYMBOLS = {"function": r"\bfunction\s+(\w+)\s*\(", "class": r"\bclass\s+(\w+)", "arrow": r"\bconst\s+(\w+)\s*=\s*(?:async\s*)?\([^)\n]*\)\s*=>"}
SCHEMA_FIELD = r"(\w+)\s*:\s*(?:z|yup)\.\s*(\w+)\s*\("


def scan_exports(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, line): exported names; of a list the names before "as"."""
    plain = findings(files, EXPORT).select(*KEYS, _found().alias("name"), "line")
    listed = findings(files, EXPORT_LIST).select(*KEYS, F.explode(F.split(_found(), ",")).alias("item"), "line")
    names = listed.select(*KEYS, F.regexp_extract(F.trim("item"), r"^(\w+)", 1).alias("name"), "line").filter("name <> ''")
    return union([plain, names]).distinct()


def scan_http_calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, method, endpoint): fetch and axios calls to any URL."""
    parts = [findings(files, ANY_FETCH).select(*KEYS, F.lit("fetch").alias("method"), _found().alias("endpoint")), findings(files, AXIOS, 2).select(*KEYS, F.upper(_found()).alias("method"), _found(1).alias("endpoint"))]
    return union(parts).distinct()


def script_symbols(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, name, line): functions, classes and arrow functions of script files, by line rules."""
    every = [findings(files, p).select(*KEYS, F.lit(k).alias("kind"), _found().alias("name"), "line") for k, p in SYMBOLS.items()]
    return union(every).distinct()


def schema_fields(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, type): fields of validation schemas with their type's name."""
    return findings(files, SCHEMA_FIELD, 2).select(*KEYS, _found().alias("name"), _found(1).alias("type")).distinct()


def delegation_libs(files: DataFrame) -> DataFrame:
    """(repo_id, libs): the words of delegation libraries that a repository's files hold, joined by commas."""
    words = files.select("repo_id", F.explode(F.regexp_extract_all("source", F.lit(DELEGATION), F.lit(0))).alias("lib"))
    return words.groupBy("repo_id").agg(F.array_join(F.sort_array(F.collect_set("lib")), ",").alias("libs"))


def complexity_estimate(sub: Column) -> Column:
    """(complexity, level) of a node without a source text, by its subtitle."""
    made = lambda n, level: F.struct(F.lit(n).alias("complexity"), F.lit(level).alias("level"))
    return F.when(F.lower(sub).rlike("zod|yup|validation|schema"), made(3, "low")).when(F.lower(sub).rlike("controller|post|get|put|delete"), made(5, "moderate")).otherwise(made(1, "low"))
