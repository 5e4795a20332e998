"""Interactions, gates and route references of screens, and the edges that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.paths import crawl_routes, tidy_route
from reposcope.functions.text import findings, keep_first, positions, union
from reposcope.operators.link import fitting, match_routes
from reposcope.sources.tables import written

KEYS = ["repo_id", "path"]

# The patterns of interactions, gates and route references, in the order they are looked for.
INTERACTIONS = [
    ("link", r"<Link[^>]*\bhref\s*=\s*\{?\s*['\"`]([^'\"`]+)['\"`]"),
    ("router-push", r"router\.(?:push|replace)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("router-push", r"\bnavigate\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
]
HANDLERS = [
    ("on-click", r"\bonClick\s*=\s*\{", r"(?:router\.(?:push|replace)|navigate)\s*\(\s*['\"`]([^'\"`]+)['\"`]", "event-handler"),
    ("on-submit", r"\bonSubmit\s*=\s*\{", r"(?:router\.(?:push|replace)|navigate|fetch)\s*\(\s*['\"`]([^'\"`]+)['\"`]", "form-submit"),
]
#: Characters after a handler in which its target is looked for.
HANDLER_CHARS = 300
GATES = [
    ("zod", "Zod Schema", r"z\.\s*(object|string|number|email|password|boolean|date|enum|array)\s*\("),
    ("zod", "Zod Parse", r"(\.(?:safe)?[Pp]arse)\s*\("),
    ("yup", "Yup Schema", r"yup\.\s*(object|string|number|boolean|date|array)\s*\("),
    ("yup", "Yup Validate", r"(\.validate(?:Sync)?)\s*\("),
    ("joi", "Joi Schema", r"Joi\.\s*(object|string|number|boolean|date|array|alternatives)\s*\("),
    ("if-else", "Guard: !", r"(?i)if\s*\(\s*!(session|token|user|form|isValid|authenticated|authorized|loading|data|req|res)\b"),
    ("if-else", "Guard: ", r"(?i)if\s*\(\s*(errors?|!valid)\b"),
]
REFERENCES = [
    ("explicit", 0.95, r"router\.(?:push|replace)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("explicit", 0.95, r"navigate\s*\(\s*\{\s*to\s*:\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("explicit", 0.95, r"<Link[^>]*\bto\s*=\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("explicit", 0.9, r"<Link[^>]*\bhref\s*=\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("explicit", 0.85, r"<a[^>]*\bhref\s*=\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("explicit", 0.9, r"history\.(?:push|replace)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("fuzzy", 0.7, r"pathname\s*===?\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("fuzzy", 0.8, r"is(?:Path|Route)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\)"),
    ("fuzzy", 0.85, r"(?:redirect|redirectToRoute)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("inferred", 0.4, r"[\"'`](/[\w\-/:.\[\]]+)[\"'`]"),
]
#: Characters on both sides of where a reference begins that are its context.
CONTEXT_CHARS = 50
ROUTE_SIGNS = r"^/[\w\-/:.\[\]{}()*?+]*$"
PAGE_FILES = r"(?:^|/)app/(?:.*/)?page\.(?:tsx|ts|js|jsx)$"
#: Share of common characters from which two routes are alike.
ALIKE = 0.6


def scan_interactions(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, target, line): links, pushes and handlers with their targets, once per line."""
    parts = [findings(files, p).select(*KEYS, F.lit(k).alias("kind"), F.get("found", F.lit(0)).alias("target"), "line") for k, p in INTERACTIONS]
    for kind, pattern, target, otherwise in HANDLERS:
        found = F.coalesce(F.nullif(F.regexp_extract("rest", target, 1), F.lit("")), F.lit(otherwise))
        parts.append(positions(files, pattern, after=HANDLER_CHARS).select(*KEYS, F.lit(kind).alias("kind"), found.alias("target"), "line"))
    return union(parts).distinct()


def scan_gates(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, label, line): validations and guards, one per kind and line."""
    parts = []
    for rank, (kind, label, pattern) in enumerate(GATES):
        said = F.concat(F.lit(label), F.get("found", F.lit(0))) if label.startswith("Guard") else F.lit(label)
        parts.append(findings(files, pattern).select(*KEYS, F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), said.alias("label"), "line"))
    return keep_first(union(parts), [*KEYS, "kind", "line"], ["rank", "label"]).select(*KEYS, "kind", "label", "line", "rank")


def cleaned_target(target: Column) -> Column:
    """A target without query and fragment, with one slash in front."""
    t = F.regexp_replace(F.trim(target), r"[?#].*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^\./", "/"), r"^\.\./", "/")
    return F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t))


def targets_to_routes(targets: DataFrame, routes: DataFrame) -> DataFrame:
    """(repo_id, target, route): the route that a target means, by itself, a pattern or a prefix."""
    asked = targets.select("repo_id", "target").distinct().withColumn("candidate", cleaned_target(F.col("target")))
    home = routes.filter("route = '/'").select("repo_id", "route", F.col("route").alias("candidate"))
    found = match_routes(asked, routes).select("repo_id", "candidate", "route").unionByName(asked.select("repo_id", "candidate").distinct().join(home, ["repo_id", "candidate"]))
    return asked.join(found, ["repo_id", "candidate"]).select("repo_id", "target", "route")


def nav_edges(files: DataFrame) -> DataFrame:
    """(repo_id, src, dst, label): from pages to the pages that their interactions lead to.

    An interaction behind a gate of its file leads to the first such gate
    (action), from there to its target (success) and to an error (failure).
    """
    pages = written(crawl_routes(files).select(*KEYS, F.col("route").alias("page")))
    inter = written(scan_interactions(files).join(pages, KEYS))
    inter = inter.join(targets_to_routes(inter, pages.withColumnRenamed("page", "route")), ["repo_id", "target"]).select(*KEYS, "page", "line", "route").distinct()
    inter = written(inter)
    gates = scan_gates(files).select(*KEYS, F.col("line").alias("gate_line"), "rank", "kind")
    before = inter.join(gates, KEYS).filter("gate_line < line")
    gated = written(keep_first(before, [*KEYS, "page", "line", "route"], ["rank", "gate_line"]))
    gate = F.concat_ws(":", F.lit("gate"), "path", "kind", "gate_line")
    edge = lambda a, b, label: F.struct(a.alias("src"), b.alias("dst"), F.lit(label).alias("label"))
    page, target = F.concat(F.lit("page:"), F.col("page")), F.concat(F.lit("page:"), F.col("route"))
    split = gated.select("repo_id", F.explode(F.array(edge(page, gate, "action"), edge(gate, target, "success"), edge(gate, F.concat(F.lit("error:"), F.col("path")), "failure"))).alias("e"))
    plain = inter.join(gated.select(*KEYS, "line", "route"), [*KEYS, "line", "route"], "left_anti").select("repo_id", page.alias("src"), target.alias("dst"), F.lit("").alias("label"))
    return union([split.select("repo_id", "e.*"), plain]).distinct()


def scan_route_refs(files: DataFrame) -> DataFrame:
    """(repo_id, path, type, literal, confidence, line, context): strings that look like routes, by ten weighted patterns."""
    parts = []
    for kind, weight, pattern in REFERENCES:
        found = positions(files, pattern, before=CONTEXT_CHARS, after=CONTEXT_CHARS)
        context = F.trim(F.regexp_replace(F.concat("lead", "rest"), r"\s+", " "))
        parts.append(found.select(*KEYS, F.lit(kind).alias("type"), F.regexp_extract("match", pattern, 1).alias("literal"), F.lit(weight).alias("confidence"), "line", context.alias("context")))
    s = F.col("literal")
    like = s.rlike(ROUTE_SIGNS) & (F.length(s) <= 100) & ~s.startswith("/data:") & (s.startswith("/api/") | ~s.rlike(r"\.[a-z]{2,4}$"))
    return union(parts).filter(like).distinct()


def similar_routes(candidates: DataFrame, routes: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(repo_id, candidate, route, rung): itself (1), without a slash at its end (2), a pattern it fits (3), or a route that
    begins like it or that it begins like, and shares enough characters (4).

    Patterns of fixed length are met by their fixed segments; beginnings by an
    explode of at most 100 characters. Of the routes with one static part and one
    set of characters only the first can be an answer, and candidates of one set
    have the same, so sets meet there and not candidates and routes.
    """
    c = candidates.select("repo_id", "candidate").distinct()
    r = routes.select("repo_id", "route").distinct()
    parts = [c.join(r.withColumn("candidate", F.col("route")), ["repo_id", "candidate"]).withColumn("rung", F.lit(1))]
    bare = F.when(F.length("candidate") > 1, F.regexp_replace("candidate", "/$", "")).otherwise(F.col("candidate"))
    parts.append(c.withColumn("route", bare).join(r, ["repo_id", "route"]).withColumn("rung", F.lit(2)))

    def pattern(route: Column) -> Column:
        named = F.regexp_replace(F.regexp_replace(F.regexp_replace(route, r":\w+\*", ".+"), r":\w+\?", "[^/]*"), r":\w+", "[^/]+")
        return F.concat(F.lit("^"), named, F.lit("$"))

    dynamic = r.filter(F.col("route").contains(":"))
    many = F.col("route").rlike(r":\w+\*")
    parts.append(fitting(c, dynamic.filter(~many), pattern).withColumn("rung", F.lit(3)))
    # a catch-all is met by what stands before it
    head = F.regexp_extract("route", r"^([^:]*)", 1)
    starts = lambda x, least: F.transform(F.sequence(F.lit(least), F.length(x)), lambda i: F.left(x, i))
    begun = c.withColumn("head", F.explode(starts(F.col("candidate"), 0)))
    parts.append(begun.join(dynamic.filter(many).withColumn("head", head), ["repo_id", "head"]).filter(F.rlike("candidate", pattern(F.col("route")))).withColumn("rung", F.lit(3)))
    letters = lambda x: F.array_sort(F.array_distinct(F.split(x, "")))
    share = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    longer = r.filter("route <> ''").withColumn("candidate", F.explode(starts(F.col("route"), 1))).join(c, ["repo_id", "candidate"])
    longer = longer.withColumns({"a": letters(F.col("candidate")), "b": letters(F.col("route"))}).filter(share > alike)
    fixed_part = r.withColumn("head", F.substring_index("route", "/:", 1)).groupBy("repo_id", "head", letters(F.col("route")).alias("b")).agg(F.min("route").alias("route"))
    heads = fixed_part.select("repo_id", "head").distinct()
    begun = written(begun.join(heads, ["repo_id", "head"], "left_semi").withColumn("a", letters(F.col("candidate"))))
    sets = begun.select("repo_id", "head", "a").distinct().join(fixed_part, ["repo_id", "head"]).filter(share > alike)
    near = sets.groupBy("repo_id", "head", "a").agg(F.min("route").alias("route"))
    parts.extend(x.withColumn("rung", F.lit(4)) for x in (longer, begun.join(near, ["repo_id", "head", "a"])))
    every = union([x.select("repo_id", "candidate", "route", "rung") for x in parts])
    return keep_first(every, ["repo_id", "candidate"], ["rung", "route"])


def best_refs(refs: DataFrame, least: float = 0.5) -> DataFrame:
    """(repo_id, path, route, confidence): the surest reference from each file to each route."""
    return refs.filter(F.col("confidence") >= least).groupBy("repo_id", "path", "route").agg(F.max("confidence").alias("confidence"))


def route_references(files: DataFrame, least: float = 0.5) -> DataFrame:
    """Scanned references, the routes that they mean, and the best of each file and route."""
    refs = written(scan_route_refs(files).withColumnRenamed("literal", "candidate"))
    routes = written(crawl_routes(files).select("repo_id", "route"))
    return best_refs(refs.join(similar_routes(refs, routes), ["repo_id", "candidate"]), least)


def page_routes(files: DataFrame) -> DataFrame:
    """(repo_id, route, label, sub, path): pages of app and pages routers, the first file of each route."""
    p = F.col("path")
    app = F.regexp_extract(p, r"(?:^|/)app/(.+)/page\.(?:tsx|ts|js|jsx)$", 1)
    other = F.regexp_extract(p, r"(?:^|/)pages/(.+)\.(?:tsx|ts|js|jsx)$", 1)
    is_page = p.rlike(PAGE_FILES) | ((other != "") & ~other.rlike("^(api/|_)|^(404|500)$"))
    segment = F.when(app != "", app).when(p.rlike(PAGE_FILES), "index").otherwise(other)
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(segment, r"\[\[?(\w+)\]?\]", ":$1"), r"\([^)]+\)", ""), "/index$", "")
    route = F.when(segment == "index", "/").otherwise(tidy_route(named))
    sub = F.when(p.rlike("(?:^|/)app/"), "App Router").otherwise("Pages Router")
    rows = files.filter(is_page).select("repo_id", route.alias("route"), sub.alias("sub"), "path")
    first = keep_first(rows, ["repo_id", "route"], ["path"])
    return first.select("repo_id", "route", F.when(F.col("route") == "/", "/ (Home)").otherwise(F.col("route")).alias("label"), "sub", "path")


def nav_graph(files: DataFrame) -> DataFrame:
    """(repo_id, src, dst, label): navigation edges, and for pages without any the routes that their strings mean (inferred)."""
    explicit = written(nav_edges(files))
    pages = written(crawl_routes(files).select(*KEYS, F.col("route").alias("page")))
    silent = pages.join(explicit.select("repo_id", F.expr("substring(src, 6)").alias("page")).distinct(), ["repo_id", "page"], "left_anti")
    strings = written(scan_route_refs(files).filter("type = 'inferred'").select(*KEYS, F.col("literal").alias("candidate")))
    found = match_routes(strings, pages.withColumnRenamed("page", "route"))
    guessed = strings.distinct().join(silent, KEYS).join(found, ["repo_id", "candidate"]).filter("page <> route")
    return explicit.unionByName(guessed.select("repo_id", F.concat(F.lit("page:"), "page").alias("src"), F.concat(F.lit("page:"), "route").alias("dst"), F.lit("inferred").alias("label")).distinct())
