"""Links between files, routes, tables and sections, and differences of graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.paths import crawl_routes, normalize_route, route_pattern
from reposcope.functions.text import keep_first, union
from reposcope.operators.scan import controllers, scan_api_calls, scan_db_refs, scan_imports, validation_kind

# Extensions that an import may leave out, in the order they are tried.
EXTENSIONS = ["tsx", "ts", "jsx", "js", "mjs", "cjs"]


def resolved_stem(specifier: Column, importer: Column) -> Column:
    """The path without extension that a relative or @/ import means; null for bare modules."""
    folder = F.slice(F.split(importer, "/"), F.lit(1), F.size(F.split(importer, "/")) - 1)
    parts = F.when(specifier.startswith("@/"), F.split(F.concat(F.lit("src/"), F.substr(specifier, F.lit(3))), "/")).when(
        specifier.rlike(r"^\.\.?/"), F.concat(folder, F.split(specifier, "/"))
    )
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        parts, empty, lambda s, x: F.when(x == ".", s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, x))
    )
    return F.array_join(walked, "/")


def file_stems(files: DataFrame) -> DataFrame:
    """(repo_id, stem, target, rank): each script file by the stems that imports may call it, index files also by their folder."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    order = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), ext)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    plain = files.select("repo_id", stem.alias("stem"), F.col("path").alias("target"), order.alias("rank")).filter("rank > 0")
    index = plain.filter(F.col("stem").endswith("/index")).select("repo_id", F.regexp_replace("stem", "/index$", "").alias("stem"), "target", (F.col("rank") + 10).alias("rank"))
    return keep_first(union([plain, index]).distinct(), ["repo_id", "stem"], ["rank", "target"])


def import_edges(files: DataFrame) -> DataFrame:
    """(repo_id, path, specifier, target, resolved): every import with the file it means, null if none is there.

    Files are reduced to their stems, so an import is one key and not a dozen
    candidates; the extension's rank decides between files of one stem.
    """
    wanted = scan_imports(files).withColumn("stem", resolved_stem(F.col("specifier"), F.col("path")))
    found = wanted.join(file_stems(files).select("repo_id", "stem", "target"), ["repo_id", "stem"], "left")
    return found.select("repo_id", "path", "specifier", "target", F.col("target").isNotNull().alias("resolved"))


def repo_stats(files: DataFrame) -> DataFrame:
    """(repo_id, files, imports, resolved, unresolved)."""
    imports = import_edges(files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("imports"), F.count_if("resolved").alias("resolved"))
    counts = files.groupBy("repo_id").agg(F.countDistinct("path").alias("files"))
    out = counts.join(imports, "repo_id", "left").fillna(0)
    return out.select("repo_id", "files", "imports", "resolved", (F.col("imports") - F.col("resolved")).alias("unresolved"))


def blueprint_edges(files: DataFrame) -> DataFrame:
    """(repo_id, src, dst, label): views, validations, controllers and tables of a repository, linked.

    A view leads to the validation of its file, a validation by Success to the
    controllers that its file calls and by Failure to an error, a view without
    validation straight to its controllers, and controllers and views to the
    tables of their files.
    """
    keys = ["repo_id", "path"]
    views = crawl_routes(files).select(*keys, F.concat(F.lit("view:"), F.col("route")).alias("view"))
    checks = validation_kind(files).select(*keys, F.concat(F.lit("validation:"), F.col("path")).alias("check"))
    served = controllers(files)
    endpoint = F.regexp_replace("endpoint", "(.)/+$", "$1")
    calls = scan_api_calls(files).select(*keys, endpoint.alias("route")).distinct()
    called = calls.join(served.select("repo_id", "route"), ["repo_id", "route"]).select(*keys, F.concat(F.lit("controller:"), F.col("route")).alias("controller"))
    tables = scan_db_refs(files).select(*keys, F.concat(F.lit("table:"), F.col("table_name")).alias("table")).distinct()
    owners = served.select(*keys, F.concat(F.lit("controller:"), F.col("route")).alias("owner"))
    parts = [
        views.join(checks, keys).select("repo_id", F.col("view").alias("src"), F.col("check").alias("dst"), F.lit("").alias("label")),
        checks.join(called, keys).select("repo_id", F.col("check").alias("src"), F.col("controller").alias("dst"), F.lit("Success").alias("label")),
        checks.select("repo_id", F.col("check").alias("src"), F.concat(F.lit("error:"), F.col("path")).alias("dst"), F.lit("Failure").alias("label")),
        views.join(checks, keys, "left_anti").join(called, keys).select("repo_id", F.col("view").alias("src"), F.col("controller").alias("dst"), F.lit("").alias("label")),
        owners.join(tables, keys).select("repo_id", F.col("owner").alias("src"), F.col("table").alias("dst"), F.lit("").alias("label")),
        views.join(tables, keys).select("repo_id", F.col("view").alias("src"), F.col("table").alias("dst"), F.lit("").alias("label")),
    ]
    return union(parts).distinct()


def infer_foreign_keys(tables: DataFrame) -> DataFrame:
    """(repo_id, src, dst): tables whose name ends in the singular or plural name of another.

    Each underscore suffix of a name becomes a key; it meets names equal to it,
    to its plural, or of which it is the singular (s, es, y for ies).
    """
    names = tables.select("repo_id", "table_name").distinct()
    parts = F.split("table_name", "_")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    wanted = names.select("repo_id", F.col("table_name").alias("src"), F.explode(suffixes).alias("suffix"))
    n = F.col("table_name")
    forms = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(n.endswith("s"), F.regexp_replace(n, "s$", "")), F.when(n.endswith("ies"), F.regexp_replace(n, "ies$", "y")),
                F.when(n.endswith("es"), F.regexp_replace(n, "es$", "")), F.when(n.endswith("s"), n),
            )
        )
    )
    known = names.select("repo_id", F.col("table_name").alias("dst"), F.explode(forms).alias("suffix"))
    return wanted.join(known, ["repo_id", "suffix"]).filter("src <> dst").select("repo_id", "src", "dst").distinct()


def assign_section(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """(repo_id, node_id, section_id): the first section, by id, whose box holds a node, borders included; null if none.

    A grid of cells as large as the largest box is the second key: a box lies in
    four cells at most, and a node meets only the boxes of its own cell.
    """
    w, h = sections.agg(F.max("w"), F.max("h")).first()
    w, h = float(w or 0) or 1.0, float(h or 0) or 1.0
    cell = lambda c, size: F.floor(c / F.lit(size))
    boxes = sections.select("repo_id", "section_id", *[F.col(c).alias(f"box_{c}") for c in "xywh"])
    boxes = boxes.withColumn("gx", F.explode(F.sequence(cell(F.col("box_x"), w), cell(F.col("box_x") + F.col("box_w"), w))))
    boxes = boxes.withColumn("gy", F.explode(F.sequence(cell(F.col("box_y"), h), cell(F.col("box_y") + F.col("box_h"), h))))
    points = nodes.select("repo_id", "node_id", "x", "y", cell(F.col("x"), w).alias("gx"), cell(F.col("y"), h).alias("gy"))
    inside = F.expr("x BETWEEN box_x AND box_x + box_w AND y BETWEEN box_y AND box_y + box_h")
    found = points.join(boxes, ["repo_id", "gx", "gy"], "left")
    return found.groupBy("repo_id", "node_id").agg(F.min(F.when(inside, F.col("section_id"))).alias("section_id"))


def section_bounds(members: DataFrame, pad: float = 40.0, width: float = 400.0, height: float = 300.0) -> DataFrame:
    """(repo_id, section_id, x, y, w, h): padded box of a section's members, of a minimum size."""
    box = members.groupBy("repo_id", "section_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    return box.select(
        "repo_id", "section_id", (F.col("min_x") - pad).alias("x"), (F.col("min_y") - pad).alias("y"),
        F.greatest(F.col("max_x") - F.col("min_x") + 2 * pad, F.lit(width)).alias("w"), F.greatest(F.col("max_y") - F.col("min_y") + 2 * pad, F.lit(height)).alias("h"),
    )


def node_diff(base: DataFrame, head: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, status, changes): added, deleted, modified, conflict or unchanged, and the changed columns joined by commas.

    A row is in conflict if the first two columns both changed. Nulls compare
    as values.
    """
    b = base.select(*keys, F.struct(*columns).alias("b"))
    both = b.join(head.select(*keys, F.struct(*columns).alias("h")), keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")), c) for c in columns]))
    two = F.array_contains("changed", columns[0]) & F.array_contains("changed", columns[1])
    status = (
        F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "deleted").when(F.size("changed") == 0, "unchanged").when(two, "conflict").otherwise("modified")
    )
    rows = both.withColumn("changed", changed)
    return rows.select(*keys, status.alias("status"), F.when(F.col("b").isNull() | F.col("h").isNull(), "").otherwise(F.array_join("changed", ",")).alias("changes"))


def route_of_link(pages: DataFrame) -> DataFrame:
    """(page_id, route): the routes that a page's quoted strings mean, normalised."""
    return pages.select("page_id", normalize_route(F.regexp_replace("route", "^/", "")).alias("route")).distinct()


def route_shape(route: Column) -> Column:
    """For each segment of a route 1 if every text that fits the route's pattern has the same segment there, else 0, as one string.

    Parameters and dots fill their segment only. Any other sign of a regular
    expression leaves what stands before it.
    """
    parts = F.split(route, "/")
    open_ = lambda x: x.rlike(r"[:.\\^$|?*+()\[\]{}]")
    each = F.transform(parts, lambda x: F.when(open_(x), "0").otherwise("1"))
    ahead = F.transform(parts, lambda x, i: F.when(F.exists(F.slice(parts, F.lit(1), i + 1), open_), "0").otherwise("1"))
    none = F.transform(parts, lambda x: F.lit("0"))
    kind = F.when(route.rlike(r"[|\\]|/[?*+{]"), none).when(route.rlike(r"[\^$?*+()\[\]{}]"), ahead).otherwise(each)
    return F.array_join(kind, "")


def fitting(candidates: DataFrame, routes: DataFrame, pattern: Callable[[Column], Column] = route_pattern) -> DataFrame:
    """(repo_id, candidate, route): candidates with the routes of as many segments whose pattern they fit.

    A candidate meets the shapes of its repository's routes (see `route_shape`),
    which are few, and by each of them the routes of the same fixed segments.
    """
    fixed = lambda text: F.array_join(F.filter(F.split(text, "/"), lambda x, i: F.substr("shape", i + 1, F.lit(1)) == "1"), "/")
    shaped = routes.select("repo_id", "route").distinct().withColumn("shape", route_shape(F.col("route")))
    shapes = shaped.select("repo_id", "shape", F.length("shape").alias("n")).distinct()
    asked = candidates.select("repo_id", "candidate").distinct().withColumn("n", F.size(F.split("candidate", "/"))).join(shapes, ["repo_id", "n"])
    asked = asked.select("repo_id", "candidate", "shape", fixed(F.col("candidate")).alias("fixed"))
    found = asked.join(shaped.withColumn("fixed", fixed(F.col("route"))), ["repo_id", "shape", "fixed"])
    return found.filter(F.rlike("candidate", pattern(F.col("route")))).select("repo_id", "candidate", "route")


def match_routes(candidates: DataFrame, routes: DataFrame, inside: bool = False) -> DataFrame:
    """(repo_id, candidate, route, rung): the route that a string means: itself (1), a pattern it fits (2), or its longest prefix (3).

    With `inside` also the longest route of three characters or more that it holds anywhere (4).
    Candidates meet patterns by their fixed segments, and prefixes by an
    explode of the candidate's folders, so no candidate meets all routes. Routes
    begin with a slash, so those inside of a candidate are looked up by its
    pieces from each slash on, and only for candidates without another route.
    """
    c = candidates.select("repo_id", "candidate").distinct()
    r = routes.select("repo_id", "route").distinct().filter("route <> '/'")
    exact = c.join(r.withColumn("candidate", F.col("route")), ["repo_id", "candidate"]).withColumn("rung", F.lit(1))
    fits = fitting(c, r.filter(F.col("route").contains(":"))).withColumn("rung", F.lit(2))
    parts = F.split("candidate", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = c.filter(F.size(parts) > 1).withColumn("route", F.explode(folders)).join(r, ["repo_id", "route"]).withColumn("rung", F.lit(3))
    found = [exact, fits, below]
    if inside:
        matched = union([x.select("repo_id", "candidate") for x in found]).distinct()
        left = c.join(matched, ["repo_id", "candidate"], "left_anti").withColumn("at", F.explode(F.sequence(F.lit(1), F.length("candidate"))))
        tails = left.select("repo_id", "candidate", F.expr("substring(candidate, at)").alias("tail")).filter("tail LIKE '/%' AND length(tail) >= 3")
        pieces = F.transform(F.sequence(F.lit(3), F.length("tail")), lambda n: F.left("tail", n))
        found.append(tails.select("repo_id", "candidate", F.explode(pieces).alias("route")).distinct().join(r, ["repo_id", "route"]).withColumn("rung", F.lit(4)))
    every = union([x.select("repo_id", "candidate", "route", "rung", (-F.length("route")).alias("short")) for x in found])
    return keep_first(every, ["repo_id", "candidate"], ["rung", "short", "route"]).select("repo_id", "candidate", "route", "rung")


def unused_exports(exports: DataFrame, imported: DataFrame) -> DataFrame:
    """Exported names that no file of the repository imports by name (repo_id, name)."""
    return exports.select("repo_id", "path", "name").distinct().join(imported, ["repo_id", "name"], "left_anti").select("repo_id", "path", "name")
