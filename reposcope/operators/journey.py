"""Signals of a user's journey in a file: what it does, where it leads and what it stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.text import matches
from reposcope.operators.scan import KEYS, crud_kind

_Q = "['\"`]"
# The signs of each signal in a path, in the lower-cased text, and packages that tell it in a package.json.
SIGNALS = {
    "landing": (r"(?:^|/)(?:app/(?:page|layout)|pages/index)\.(?:tsx|ts|js|jsx)$", None, []),
    "auth": (r"(?i:auth|login|signup)", r"sign\s*in|sign\s*up|login|log\s*in|register|authenticat", ["next-auth", "@auth/core"]),
    "logout": (r"(?i:logout)", r"sign\s*out|log\s*out", []),
    "validation": (None, r"z\.\s*(?:object|string|number|email|password|boolean|date|enum|array)\s*\(|\.parse\s*\(|yup\.\s*(?:object|string|number|boolean|date|array)\s*\(|\.validate\s*\(", []),
    "api": (r"(?i:api/|server|controller)|app/.*/route\.(?:ts|tsx|js|jsx)$", r"export\s+async\s+function\s+(?:get|post|put|delete|patch)", []),
    "database": (None, r"prisma|schema|model|supabase|mongoose|create table|select \* from", ["prisma", "@prisma/client", "mongoose", "@supabase/supabase-js"]),
    "middleware": (r"(?:^|/)middleware\.(?:ts|js)$|(?i:/middleware|guard|_middleware)", r"export\s+(?:async\s+)?function\s+middleware|export\s+const\s+middleware|nextauth\(\s*\)", []),
    "background_service": (r"(?i:/services/|/workers/|/jobs/|/utils/|/queues/)", r"queue\.|bull\.|worker\.|cron|schedule|background|job|setinterval|settimeout|worker_threads|child_process|export\s+(?:const|function)\s+\w*(?:worker|queue)", []),
    "error_handler": (r"(?i:/errors/|/logger/|/logging/)|(?:error|logger|logging)[^/]*$", r"errorboundary|error\s*handler|catch\s*\(|try\s*\{|\.error\s*\(|logger\.|winston|bunyan|pino|sentry|captureexception|capturemessage|next\.js\s*\|\|\s*error", []),
    "cache": (r"(?i:/cache/)|cache[^/]*$", r"\.cache\s*\(|cache\.|memcached|redis.*cache|react-query|tanstack/query|usequery|usemutation|stale-while-revalidate|swr|cachestore|cachestrategy|next\s*\.\s*cache|unstable_cache", ["redis", "ioredis", "react-query", "@tanstack/react-query", "swr"]),
}
# Signs of external services in the lower-cased text.
SERVICES = {
    "stripe": rf"from\s+{_Q}stripe{_Q}|require\s*\(\s*{_Q}stripe{_Q}\]|stripe\s*\(",
    "sendgrid": r"sendgrid",
    "aws": rf"(?:from\s+|require\s*\(\s*){_Q}aws-sdk|aws\.|s3\.|dynamo|lambda|sns|sqs",
    "firebase": rf"(?:from\s+|require\s*\(\s*){_Q}firebase|firebase\.|firestore|firebaseapp",
    "twilio": rf"(?:from\s+|require\s*\(\s*){_Q}twilio|twilio\s*\(",
    "openai": rf"(?:from\s+|require\s*\(\s*){_Q}openai|openai\s*\(",
    "cloudinary": rf"from\s+{_Q}cloudinary|cloudinary\.v2|cloudinary\.uploader",
    "redis": rf"from\s+{_Q}(?:ioredis|redis)|redis\.|createredisclient",
    "github": rf"from\s+{_Q}@octokit|octokit\.|github\.octokit",
    "slack": rf"from\s+{_Q}@slack|slackapi|slack\.|slackbot",
}
# What a file stores. Trigger, label of the store, label of the edge, its subject, its action, the CRUD kind that stands for the action.
STORES = [
    ("register", "auth profile created", "store profile", "", "register|signup|sign up|create", ""),
    ("create project", "project stored", "save project", "project", "create|add|insert", "CREATE"),
    ("create post", "post stored", "save post", "post", "create|add|publish", "CREATE"),
    ("add comment", "comment stored", "save comment", "comment", "create|add|post", "CREATE"),
    ("upload file", "file stored", "save file", "upload", "file|image|avatar", ""),
    ("place order", "order stored", "save order", "order", "create|place|submit", "CREATE"),
    ("update profile", "profile updated", "update record", "profile", "update|edit", "UPDATE"),
]
PLAIN_STORE = ("create", "record stored", "save data")
# Routes of files, imports of a layout, and the targets that a text leads to.
APP_PAGE, PAGES_PAGE = r"(?:^|/)app/(.+)/page\.(?:tsx|ts|js|jsx)$", r"(?:^|/)pages/(.+)\.(?:tsx|ts|js|jsx)$"
LAYOUT, NO_PAGES = r"(?:^|/)app/layout\.(?:tsx|ts|js|jsx)$", r"^(?:api/|_)"
LAYOUT_IMPORT, NO_ROUTES = rf"import\s+\w+\s+from\s+{_Q}([./][^'\"`]+){_Q}", r"^(?:layout|globals|root)?$|node_modules"
LEADS = [rf"router\.push\s*\(\s*{_Q}([^'\"`]+){_Q}", rf"<link[^>]+href\s*=\s*{_Q}([^'\"`]+){_Q}", rf"href\s*=\s*{_Q}([^'\"`#][^'\"`]*){_Q}"]


def _packages(path: Column, source: Column) -> Column:
    """Names of the packages that a package.json asks for; of another or broken file none."""
    spec = F.from_json(F.when(path.endswith("package.json"), source), "dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>")
    names = [F.coalesce(F.map_keys(spec[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")]
    return F.array_union(*names)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _store(trigger: str, label: str, edge: str) -> Column:
    return F.struct(F.lit(trigger).alias("trigger"), F.lit(label).alias("label"), F.lit(edge).alias("edge"))


def journey_signals(files: DataFrame) -> DataFrame:
    """(repo_id, path, one flag per signal, external_service, crud, route, decisions, services, stores) of each file, once."""
    return signal_rows(files).select(*KEYS, *SIGNALS, "external_service", "crud", "route", "decisions", "services", "stores").distinct()


def signal_rows(files: DataFrame) -> DataFrame:
    """Per row of `files`: repo_id, path, the signals, packages of a package.json, and t, the text in lower case.

    `decisions` are the targets a file leads to, `services` the external services it names, both sorted; `stores` holds
    (trigger, label, edge) of what it stores. A null text counts as empty. All is computed in one pass over the text,
    which whoever asks drops before the rows meet.
    """
    rows = files.select(*KEYS, F.coalesce("path", F.lit("")).alias("p"), F.coalesce("source", F.lit("")).alias("s")).withColumn("t", F.lower("s"))
    rows = rows.withColumn("packages", _packages(F.col("p"), F.col("s"))).withColumn("words", F.concat_ws("\n", "t", F.lower("p")))
    flags = []
    for name, (in_path, in_text, packages) in SIGNALS.items():
        signs = [F.col("p").rlike(in_path)] if in_path else []
        signs += [matches(F.col("t"), in_text)] if in_text else []
        signs += [F.arrays_overlap("packages", F.array(*[F.lit(x) for x in packages]))] if packages else []
        flags.append(reduce(Column.__or__, signs).alias(name))
    services = F.array_sort(F.array_compact(F.array(*[F.when(matches(F.col("t"), p), k) for k, p in SERVICES.items()])))
    cleaned = F.transform(_all(F.col("s"), LAYOUT_IMPORT), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\./", ""), r"^\.\./", ""))
    inner = F.transform(F.filter(cleaned, lambda x: ~x.rlike(NO_ROUTES)), lambda x: F.concat(F.lit("/"), x))
    layout = F.when(F.col("p").rlike(LAYOUT), inner).otherwise(F.array().cast("array<string>"))
    rows = rows.select("*", *flags, services.alias("services"), layout.alias("layout")).withColumn("external_service", F.size("services") > 0)
    rows = rows.withColumn("crud", F.when(F.col("api"), crud_kind(F.col("t"))).otherwise("API"))
    app, page = F.regexp_extract("p", APP_PAGE, 1), F.regexp_extract("p", PAGES_PAGE, 1)
    route = (
        F.when(app != "", F.concat(F.lit("/"), app))
        .when((page != "") & ~page.rlike(NO_PAGES), F.concat(F.lit("/"), F.regexp_replace(page, r"[\[\]]", ":")))
        .otherwise(F.get("layout", F.lit(0)))
    )
    leads = F.array_sort(F.array_distinct(F.concat(*[_all(F.col("t"), p) for p in LEADS], F.col("layout"))))
    stores = []
    for trigger, label, edge, subject, action, crud in STORES:
        acts = matches(F.col("words"), action) | (F.col("crud") == crud if crud else F.lit(False))
        stores.append(F.when((F.col("words").contains(subject) if subject else F.col("auth")) & acts, _store(trigger, label, edge)))
    plain = F.when(F.col("crud") == "CREATE", F.array(_store(*PLAIN_STORE)))
    rows = rows.withColumn("stores", F.array_compact(F.array(*stores)))
    rows = rows.withColumn("stores", F.when(F.size("stores") == 0, F.coalesce(plain, F.col("stores"))).otherwise(F.col("stores")))
    return rows.select(*KEYS, *SIGNALS, "external_service", "crud", route.alias("route"), leads.alias("decisions"), "services", "stores", "packages", "t")
