"""What a file's path says: language, route, kind, label, project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.text import keep_first

# Extensions and names of languages.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "py": "python", "php": "php", "java": "java",
    "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp",
}
# Words in a path that tell the type of its node, the first type that fits.
NODE_TYPES = {
    "endpoint": ["/api/", "route.", "endpoint"],
    "middleware": ["middleware", "guard", "auth", "verify", "validate"],
    "controller": ["controller", "handler", "service", "process"],
    "model": ["model", "schema", "table", "db/", "database", "_table", "migration"],
}
SCRIPT = r"\.(tsx|ts|js|jsx)$"


def extension(path: Column) -> Column:
    """Lower-case text after the last dot; the whole path if it has none."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def language_of(path: Column) -> Column:
    """Language by extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def tidy_route(route: Column) -> Column:
    """A route with one slash in front, none doubled and none at its end."""
    slashed = F.regexp_replace(F.concat(F.lit("/"), route), "/+", "/")
    return F.when(F.length(slashed) > 1, F.regexp_replace(slashed, "/$", "")).otherwise(slashed)


def normalize_route(segment: Column) -> Column:
    """[x] and [...x] become :x, (groups) and a closing /index go; index is the root."""
    named = F.regexp_replace(F.regexp_replace(segment, "/index$", ""), r"\[(\.\.\.)?(\w+)\]", ":$2")
    return F.when(segment.isin("index", ""), "/").otherwise(tidy_route(F.regexp_replace(named, r"\([^)]+\)", "")))


def normalize_route_param(segment: Column) -> Column:
    """[x] and [[x]] become :param; [...x] stays."""
    named = F.regexp_replace(F.regexp_replace(segment, "/index$", ""), r"\[\[?\w+\]?\]", ":param")
    return F.when(segment == "index", "/").otherwise(tidy_route(F.regexp_replace(named, r"\([^)]+\)", "")))


def is_dynamic(segment: Column) -> Column:
    return segment.rlike(r"\[(\.\.\.)?\w+\]")


# Which files serve routes, which names of them stand for one, which folders never do.
SERVER_FILES = r"(?:^|/)(?:routes?|server|backend|api|controllers?)/|(?:^|/)(?:server|app|main)\.(?:js|ts)$"
NO_SERVER_FILES = r"^src/|(?:^|/)(?:lib|utils|components|hooks|config|types)/"
SERVER_NAMES = ["server", "app", "main", "router", "routes", "index"]
NO_ROUTE_FOLDERS = [
    "node_modules", "lib", "utils", "components", "hooks", "config", "public", "static", "assets", "styles", "types", "interfaces",
    "constants", "middleware", "services", "store", "context", "providers",
]


def crawl_routes(files: DataFrame) -> DataFrame:
    """(repo_id, route, path, pattern, dynamic): the routes that paths stand for, one per route, the first path.

    App pages come first, then the pages folder without its API and special
    files, then src/index, then server files by their names, then folders with an
    index file of their own.
    """
    p = F.col("path")
    app = F.regexp_extract(p, r"(?:^|/)app/(.+)/page" + SCRIPT, 1)
    pages = F.regexp_extract(p, r"(?:^|/)pages/(.+)" + SCRIPT, 1)
    server_name, folder = F.regexp_extract(p, r"([^/]*)\.(?:js|ts)$", 1), F.regexp_extract(p, r"(.+)/index" + SCRIPT, 1)
    server = p.rlike(SERVER_FILES) & ~p.rlike(NO_SERVER_FILES) & p.rlike(r"\.(js|ts)$")
    kind = (
        F.when(app != "", F.struct(app.alias("segment"), F.lit("app-router").alias("pattern")))
        .when(p.rlike(r"(?:^|/)app/page" + SCRIPT), F.struct(F.lit("").alias("segment"), F.lit("app-router").alias("pattern")))
        .when((pages != "") & ~pages.rlike(r"^(api/|_)|^(404|500)$"), F.struct(pages.alias("segment"), F.lit("pages-router").alias("pattern")))
        .when(pages != "", None)
        .when(p.rlike(r"(?:^|/)src/index" + SCRIPT), F.struct(F.lit("").alias("segment"), F.lit("vite-index").alias("pattern")))
        .when(server & server_name.isin(SERVER_NAMES), F.struct(F.when(server_name == "index", "").otherwise(F.concat(F.lit("api/"), server_name)).alias("segment"), F.lit("app-router").alias("pattern")))
        .when(server, None)
        .when((folder != "") & ~F.arrays_overlap(F.split(folder, "/"), F.lit(NO_ROUTE_FOLDERS)) & ~F.substring_index(folder, "/", -1).contains("."), F.struct(folder.alias("segment"), F.lit("vite-index").alias("pattern")))
    )
    # a generator, so that the chain is not copied into every use of its result
    found = files.select("repo_id", "path", F.explode(F.array_compact(F.array(kind))).alias("k"))
    rows = found.select("repo_id", normalize_route(F.col("k.segment")).alias("route"), "path", "k.pattern", is_dynamic(F.col("k.segment")).alias("dynamic"))
    return keep_first(rows, ["repo_id", "route"], ["path"])


def node_type(path: Column) -> Column:
    """endpoint, middleware, controller, model or utility, by words in the path."""
    low, out = F.lower(path), F
    for kind, words in NODE_TYPES.items():
        test = low.rlike("|".join(w.replace(".", r"\.") for w in words))
        out = F.when(test, kind) if out is F else out.when(test, kind)
    return out.otherwise("utility")


def node_label(path: Column) -> Column:
    """File name without a code extension, - and _ as spaces, its first letter upper-case."""
    name = F.element_at(F.split(path, "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(name, r"\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|cc|cxx|hpp|hh|hxx|cs|h)$", ""), "[-_]", " ")
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))


def project_type(files: DataFrame) -> DataFrame:
    """(repo_id, project): nextjs, react, node, python, go or unknown, by any path of the repository."""
    p = F.col("path")
    tests = {
        "nextjs": (p.contains("app/") & p.contains("route.")) | (p.contains("pages/") & p.endswith(".tsx")) | p.contains("next.config"),
        "react": p.endswith(".jsx") | p.endswith(".tsx") | p.contains("react"),
        "node": p.contains("package.json") | p.contains("express"),
        "python": p.endswith(".py"),
        "go": p.endswith(".go"),
    }
    flags = files.groupBy("repo_id").agg(*[F.bool_or(t).alias(k) for k, t in tests.items()])
    return flags.select("repo_id", F.coalesce(*[F.when(F.col(k), k) for k in tests], F.lit("unknown")).alias("project"))


def parse_repo_url(text: Column, host: str = "github.com") -> Column:
    """owner and repo of "owner/repo" or of a URL on the host; null if it is neither."""
    plain = F.regexp_replace(F.trim(text), r"\.git$", "")
    short = r"^([a-zA-Z0-9_-]+)/([a-zA-Z0-9_.-]+)$"
    full = r"(?:https?://)?(?:www\.)?" + host.replace(".", r"\.") + r"/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_.-]+)"
    both = [F.struct(F.regexp_extract(plain, f, 1).alias("owner"), F.regexp_extract(plain, f, 2).alias("repo")) for f in (short, full)]
    return F.when(plain.rlike(short), both[0]).when(plain.rlike(full), both[1])


def route_prefixes(routes: DataFrame, route: str = "route") -> DataFrame:
    """(folder, routes): every path prefix once, with the number of routes below it."""
    parts = routes.select(F.filter(F.split(F.col(route), "/"), lambda x: x != "").alias("p")).filter(F.size("p") > 0)
    prefix = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), i), "/")))
    return parts.select(F.explode(prefix).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("routes"))


# Display names of languages, words that tell UI, logic and database files, and role sections.
LANGUAGE_NAMES = {
    "ts": "TypeScript", "tsx": "TypeScript (React)", "js": "JavaScript", "jsx": "JavaScript (React)",
    "py": "Python", "go": "Go", "rs": "Rust", "java": "Java",
}
UI_PATHS = ["app/", "pages/"]
DB_WORDS = ["prisma", "schema", "model"]
LOGIC_WORDS = ["controller", "handler", "api"]
SECTIONS = {
    "manager": r"dashboard/manager|manager/|admin/dashboard",
    "customer": r"dashboard/customer|customer/|shop/|store/|account/",
    "staff": r"dashboard/staff|staff/|employee/|worker/",
    "admin": r"admin/|settings/|system/",
}
SHAPE_LAYERS = {"cylinder": "database", "pill": "view", "diamond": "validation", "rectangle": "controller"}


def language_name_of(path: Column) -> Column:
    """Display name by extension; an unknown extension in upper case."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.upper(extension(path)))


def classify_file(path: Column, source: Column) -> Column:
    """UI_NODE, LOGIC_NODE or DB_NODE: by path in this order, then DB and logic by text; null if none fits."""

    def any_of(c: Column, words: list[str]) -> Column:
        return F.lower(c).rlike("|".join(words))

    return (
        F.when(any_of(path, UI_PATHS), "UI_NODE").when(any_of(path, LOGIC_WORDS), "LOGIC_NODE").when(any_of(path, DB_WORDS), "DB_NODE")
        .when(any_of(source, DB_WORDS), "DB_NODE").when(any_of(source, LOGIC_WORDS), "LOGIC_NODE")
    )


def engine_route(path: Column) -> Column:
    """(route, method) of /app/**/page. (GET) and /api/**/route. (API); null for other files."""
    page, api = F.regexp_extract(path, r"/app/(.+)/page\.", 1), F.regexp_extract(path, r"/api/(.+)/route\.", 1)
    return F.when(page != "", F.struct(F.concat(F.lit("/"), page).alias("route"), F.lit("GET").alias("method"))).when(
        api != "", F.struct(F.concat(F.lit("/api/"), api).alias("route"), F.lit("API").alias("method"))
    )


def section_role(path: Column) -> Column:
    """manager, customer, staff or admin by the first pattern that the path fits, else null."""
    return F.coalesce(*[F.when(F.lower(path).rlike(p), role) for role, p in SECTIONS.items()])


def layer_of(shape: Column) -> Column:
    """Architectural layer by a node's shape."""
    table = F.create_map(*[F.lit(x) for pair in SHAPE_LAYERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, shape), F.lit("other"))


def route_pattern(route: Column) -> Column:
    """A regular expression for the URLs of a route: :x is a segment, :x? an optional one, :x* the rest."""
    stars = F.regexp_replace(route, r"/:\w+\*", "(?:/.*)?")
    maybe = F.regexp_replace(stars, r"/:\w+\?", "(?:/[^/]+)?")
    return F.concat(F.lit("^"), F.regexp_replace(maybe, r":\w+", "[^/]+"), F.lit("$"))


def route_params(route: Column) -> Column:
    """The parameters of a route: name, position, optional, catch_all."""
    parts = F.filter(F.split(route, "/"), lambda x: x != "")
    each = F.transform(
        parts,
        lambda x, i: F.struct(F.regexp_extract(x, r"^:(\w+)", 1).alias("name"), i.alias("position"), x.endswith("?").alias("optional"), x.endswith("*").alias("catch_all")),
    )
    return F.filter(each, lambda p: p["name"] != "")


def target_file(label: Column, shape: Column) -> Column:
    """The file that a new node's code belongs in, by its label and shape."""
    plain = F.regexp_replace(label, "[^a-zA-Z0-9]", "_")
    api, page = F.regexp_replace(label, "^/api/+", ""), F.regexp_replace(label, "^/+", "")
    return (
        F.when(label.startswith("/api/"), F.concat(F.lit("app/api/"), api, F.lit("/route.ts")))
        .when(label.startswith("/"), F.concat(F.lit("app/"), F.when(page == "", "page").otherwise(page), F.lit("/page.tsx")))
        .when(shape == "cylinder", F.concat(F.lit("lib/models/"), plain, F.lit(".ts")))
        .otherwise(F.concat(F.lit("lib/"), plain, F.lit(".ts")))
    )


def url_params(route: Column, url: Column) -> Column:
    """The values of a route's parameters in a URL that fits it, as a map."""
    parts = F.split(url, "/")
    each = F.transform(F.split(route, "/"), lambda x, i: F.struct(F.regexp_extract(x, r"^:(\w+)", 1).alias("name"), F.get(parts, i).alias("value")))
    kept = F.filter(each, lambda p: p["name"] != "")
    return F.map_from_arrays(kept["name"], kept["value"])
