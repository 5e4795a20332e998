"""Symbols, inheritance, routes and calls of source files in several languages, by ordered line rules.

A rule is (kind, pattern): group 1 is the symbol's name, group 2 its parents or
arguments where the language has them there. The first rule that fits a line
counts. More languages or rules are given as an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.paths import language_of
from reposcope.functions.text import keep_first, union
from reposcope.sources.tables import written

KEYS = ["repo_id", "path"]
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|synchronized|readonly|partial)\s+)*"

# What declares something in a line without its indent.
RULES: dict[str, list[tuple[str, str]]] = {
    "python": [
        ("class", r"^class\s+(\w+)(?:\s*\(([^)]*)\))?\s*:"),
        ("function", r"^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"),
        ("import", r"^(?:from\s+[\w.]+\s+)?import\s+(\w[\w.]*)()"),
    ],
    "php": [
        ("class", r"^(?:abstract\s+|final\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"),
        ("function", r"^(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+(\w+)\s*\(([^)]*)\)"),
        ("route", r"^Route::\w+\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[?([\w:]+)::class"),
        ("import", r"^use\s+([\w\\]+)()"),
    ],
    "java": [
        ("import", r"^import\s+(?:static\s+)?([\w.]+(?:\.\*)?)()\s*;"),
        ("annotation", r"^@(\w+)(?:\(([^)]*)\))?"),
        ("class", rf"^{_MODIFIERS}(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+([\w.,\s<>]+?))?(?:\s+implements\s+[\w.,\s<>]+?)?\s*\{{"),
        ("function", rf"^{_MODIFIERS}[\w<>\[\],.]+\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\{{"),
    ],
    "go": [
        ("class", r"^type\s+(\w+)\s+(struct|interface)\b"),
        ("function", r"^func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s*)?(\w+)\s*\(([^)]*)\)"),
        ("import", r"^(?:import\s+)?\"([^\"]+)\"()$"),
    ],
    "c": [
        ("import", r"^#include\s+[<\"]([^>\"]+)[>\"]()"),
        ("class", r"^(?:typedef\s+)?struct\s+(\w+)()\s*\{"),
        ("function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\(([^;)]*)\)\s*\{"),
    ],
    "cpp": [
        ("import", r"^#include\s+[<\"]([^>\"]+)[>\"]()"),
        ("class", r"^(?:class|struct)\s+(\w+)(?:\s*:\s*([\w\s,:]+?))?\s*\{"),
        ("function", r"^[A-Za-z_][\w\s*&:<>,]*?\b(\w+)\s*\(([^;)]*)\)\s*(?:const\s*)?(?:override\s*)?\{"),
    ],
    "csharp": [
        ("import", r"^using\s+([\w.]+)()\s*;"),
        ("annotation", r"^\[(\w+)(?:\(([^)]*)\))?\]"),
        ("class", rf"^{_MODIFIERS}(?:class|interface|struct|record)\s+(\w+)(?:\s*:\s*([\w.,\s<>]+?))?\s*\{{"),
        ("function", rf"^{_MODIFIERS}[\w<>\[\],.?]+\s+(\w+)\s*\(([^)]*)\)\s*\{{"),
    ],
}
#: Words that look like a function's name before a bracket.
NO_FUNCTIONS = ["if", "for", "while", "switch", "catch", "return", "else", "new"]


def _declaration(bare: Column, language: Column, rules: dict[str, list[tuple[str, str]]]) -> Column:
    """(kind, name, rest) by the first rule of the language that fits a line without its indent, else null.

    It is made for the elements of an array, where a line meets the rules of its
    language alone, each once; over columns Spark would write all rules into one
    method, and again for each field and filter that asks for them.
    """
    found = F
    for name, each in rules.items():
        fits = [F.when(bare.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(bare, p, 1).alias("name"), F.regexp_extract(bare, p, 2).alias("rest"))) for kind, p in each]
        found = found.when(language == name, F.coalesce(*fits))
    return found


def symbols(files: DataFrame, rules: dict[str, list[tuple[str, str]]] = RULES) -> DataFrame:
    """(repo_id, path, language, line, kind, name, rest, owner): what each line declares.

    owner is the class above a more indented line; rest is what stands at a
    class's parents or a function's or annotation's arguments.
    """
    rows = files.select(*KEYS, language_of(F.col("path")).alias("language"), "source").filter(F.col("language").isin(list(rules)))
    lines = F.transform(F.split("source", "\n"), lambda x, i: F.struct((i + 1).alias("line"), (F.length(x) - F.length(F.ltrim(x))).alias("indent"), F.trim(x).alias("bare")))
    lines = F.filter(lines, lambda x: ~x["bare"].rlike(r"^(//|\*|/\*|--)") & (~x["bare"].startswith("#") | x["bare"].startswith("#include")))
    declared = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["indent"].alias("indent"), _declaration(x["bare"], F.col("language"), rules).alias("f")))
    rows = rows.select(*KEYS, "language", F.explode(declared).alias("d")).filter("d.f IS NOT NULL")
    rows = rows.select(*KEYS, "language", "d.line", "d.indent", "d.f.*").filter(~F.col("name").isin(NO_FUNCTIONS))
    above = Window.partitionBy(*KEYS).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    outer = F.last(F.when(F.col("kind") == "class", F.struct("name", "indent")), ignorenulls=True).over(above)
    owned = rows.withColumn("o", outer)
    owner = F.when(F.col("indent") > F.col("o.indent"), F.col("o.name"))
    return owned.select(*KEYS, "language", "line", "kind", "name", "rest", F.when(F.col("kind") != "class", owner).alias("owner"))


def parent_names(rest: Column) -> Column:
    """The single parents in a class's list, without access words and type arguments."""
    parts = F.transform(F.split(F.regexp_replace(rest, r"<[^>]*>", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^(public|private|protected|virtual)\s+", ""))
    return F.filter(parts, lambda x: x.rlike(r"^[\w.:]+$"))


def inherit_edges(found: DataFrame) -> DataFrame:
    """(repo_id, path, src, dst): from each class to its parents."""
    classes = found.filter("kind = 'class' AND language <> 'go' AND rest <> ''")
    return classes.select(*KEYS, F.col("name").alias("src"), F.explode(parent_names(F.col("rest"))).alias("dst")).distinct()


def annotated_routes(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, verb, route, owner): mappings and verb attributes of the function below them, and routes that name a class."""
    found = symbols(files) if found is None else found
    order = Window.partitionBy(*KEYS).orderBy("line")
    below = F.first(F.when(F.col("kind") == "function", F.concat_ws(".", "owner", "name")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = found.withColumn("below", below).filter("kind = 'annotation'")
    java = marked.filter((F.col("language") == "java") & F.col("name").endswith("Mapping")).withColumn("verb", F.upper(F.regexp_replace("name", "Mapping$", "")))
    sharp = marked.filter((F.col("language") == "csharp") & F.col("name").rlike("^Http(Get|Post|Put|Delete|Patch)$")).withColumn("verb", F.upper(F.regexp_replace("name", "^Http", "")))
    route = F.coalesce(F.nullif(F.regexp_extract("rest", "[\"']([^\"']+)[\"']", 1), F.lit("")), F.lit("/"))
    parts = [x.filter("below IS NOT NULL").select(*KEYS, "verb", route.alias("route"), F.col("below").alias("owner")) for x in (java, sharp)]
    lines = files.filter(language_of(F.col("path")) == "php").select(*KEYS, F.explode(F.split("source", "\n")).alias("text"))
    php = r"Route::(\w+)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[?([\w:]+)::class\s*,\s*['\"](\w+)['\"]\]?\)"
    parts.append(lines.filter(F.col("text").rlike(php)).select(*KEYS, F.upper(F.regexp_extract("text", php, 1)).alias("verb"), F.regexp_extract("text", php, 2).alias("route"), F.concat_ws(".", F.regexp_extract("text", php, 3), F.regexp_extract("text", php, 4)).alias("owner")))
    return union(parts).distinct()


CALL = r"([A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)?)\s*\("


def call_edges(files: DataFrame, language: str, found: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, src, dst): calls between functions of one file that are both defined there.

    A call of self, cls, $this or static means a method of the caller's class;
    the name of a class means the class itself; a plain name a function outside
    of classes.
    """
    found = (symbols(files) if found is None else found).filter(F.col("language") == language)
    defined = found.filter("kind IN ('function', 'class')").select(*KEYS, F.concat_ws(".", "owner", "name").alias("id"), "line", "kind", "owner")
    lang = language_of(F.col("path"))
    lines = files.filter(lang == language).select(*KEYS, F.posexplode(F.split("source", "\n")).alias("at", "text")).select(*KEYS, (F.col("at") + 1).alias("line"), "text")
    heads = defined.filter("kind = 'function'").select(*KEYS, "line", F.struct("id", "owner").alias("head"))
    within = lines.join(heads, [*KEYS, "line"], "left")
    above = Window.partitionBy(*KEYS).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    body = within.withColumn("caller", F.last("head", ignorenulls=True).over(above)).filter("head IS NULL AND caller IS NOT NULL")
    calls = body.select(*KEYS, "caller", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"\$", ""), F.lit(CALL), F.lit(1))).alias("call"))
    own = F.regexp_extract("call", r"^(?:self|cls|this|static)(?:\.|->|::)(\w+)$", 1)
    target = F.when(own != "", F.concat_ws(".", "caller.owner", own)).otherwise(F.regexp_replace("call", "(->|::)", "."))
    edges = calls.select(*KEYS, F.col("caller.id").alias("src"), target.alias("dst")).distinct()
    known = defined.select(*KEYS, F.col("id").alias("dst"))
    return edges.join(known, [*KEYS, "dst"], "left_semi").select(*KEYS, "src", "dst")


def unified_graph(files: DataFrame, imports: DataFrame, calls: list[str] = ["python", "php"]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Nodes (repo_id, id, kind) and edges (repo_id, src, dst, kind) of modules, classes, functions, routes, imports and calls; the first kind of a pair counts."""
    found = written(symbols(files))
    qualified = F.concat_ws("#", "path", F.concat_ws(".", "owner", "name"))
    nodes = union(
        [
            files.select("repo_id", F.col("path").alias("id"), F.lit(0).alias("rank"), F.lit("module").alias("kind")),
            found.filter("kind IN ('class', 'function')").select("repo_id", qualified.alias("id"), F.lit(1).alias("rank"), "kind"),
        ]
    )
    name = lambda c: F.concat_ws("#", "path", c)
    edges = [
        imports.filter("target IS NOT NULL").select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst"), F.lit("import").alias("kind")),
        inherit_edges(found).select("repo_id", name("src").alias("src"), name("dst").alias("dst"), F.lit("inherit").alias("kind")),
        annotated_routes(files, found).select("repo_id", F.concat_ws(" ", "verb", "route").alias("src"), name("owner").alias("dst"), F.lit("route").alias("kind")),
        *[call_edges(files, c, found).select("repo_id", name("src").alias("src"), name("dst").alias("dst"), F.lit("reference").alias("kind")) for c in calls],
    ]
    ranked = union([e.withColumn("rank", F.lit(k)) for k, e in enumerate(edges)])
    return keep_first(nodes, ["repo_id", "id"], ["rank", "kind"]).drop("rank"), keep_first(ranked, ["repo_id", "src", "dst"], ["rank", "kind"]).select("repo_id", "src", "dst", "kind")


IMPORT_LINE = r"import\s+(?:[^'\"]+\s+from\s+)?['\"`]([^'\"`]+)['\"`]"
REQUIRE_LINE = r"require\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)"
PY_FROM, PY_IMPORT = r"from\s+([\w.]+)\s+import", r"^import\s+([\w.]+)"


def import_lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, specifier, line): imports line by line, once per file; of scripts only relative and @/ ones, of Python all."""
    lines = files.select(*KEYS, F.posexplode(F.split("source", "\n")).alias("at", "text"))
    some = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    script = F.coalesce(some(IMPORT_LINE), some(REQUIRE_LINE))
    spec = F.when(script.isNotNull(), F.when(script.rlike(r"^(\.|@/|/)"), script)).when(F.col("path").endswith(".py"), F.coalesce(some(PY_FROM), some(PY_IMPORT)))
    return lines.select(*KEYS, spec.alias("specifier"), (F.col("at") + 1).alias("line")).filter("specifier IS NOT NULL").groupBy(*KEYS, "specifier").agg(F.min("line").alias("line"))


# Where a file names the models it works on, in lower case, and names that are none.
MODELS = [
    (r"from\s+['\"`][^'\"`]*(?:models?|schema|entity|entities|db|database)/([a-z0-9_-]+)", []),
    (r"from\s+['\"`][^'\"`]*/([a-z0-9_-]+)\.(?:model|schema|entity|service)\b", []),
    (r"prisma\.([a-z][a-z0-9_]*)\.", []),
    (r"\b([a-z][a-z0-9]*)\s*\.\s*(?:find|findone|findbyid|create|update|delete|save|remove|insertmany|updatemany|deletemany)\s*\(", ["db", "client", "conn", "res", "req", "err", "data", "result", "body"]),
    (r"supabase\s*\.\s*from\s*\(\s*['\"`]([a-z0-9_]+)['\"`]", []),
]


def model_names(low: Column) -> Column:
    """The models that a text in lower case imports or calls, with blanks for dashes and underscores, each once in the order of the rules and the text."""
    every = F.flatten(F.array(*[F.array_except(F.regexp_extract_all(low, F.lit(p), F.lit(1)), F.array(*[F.lit(x) for x in none]).cast("array<string>")) for p, none in MODELS]))
    return F.filter(F.array_distinct(F.transform(every, lambda x: F.trim(F.translate(x, "-_", "  ")))), lambda x: x != "")


def imported_models(files: DataFrame) -> DataFrame:
    """(repo_id, path, model): the models that a file imports or calls."""
    return files.select(*KEYS, F.explode(model_names(F.lower("source"))).alias("model")).distinct()
