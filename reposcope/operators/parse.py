"""Nodes and edges of repositories from paths, validations and DDL, by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.functions.text import keep_first, union
from reposcope.operators import scan, schema
from reposcope.operators.navigation import PAGE_FILES, page_routes

# Paths of API files of both routers, and of the files that may hold a page's validation.
APP_API, PAGES_API = r"(?:^|/)app/(api/.+)/route\.(?:ts|tsx|js|jsx)$", r"(?:^|/)pages/(api/.+)\.(?:ts|tsx|js|jsx)$"
PAGE_FOLDERS = rf"{PAGE_FILES}|(?:^|/)(?:app|pages)/"


def path_controllers(files: DataFrame) -> DataFrame:
    """(repo_id, route, path): API files by their paths alone, the first file of each route."""
    app, pages = F.regexp_extract("path", APP_API, 1), F.regexp_extract("path", PAGES_API, 1)
    found = F.coalesce(F.nullif(app, F.lit("")), F.nullif(pages, F.lit("")))
    rows = files.select("repo_id", F.concat(F.lit("/"), F.regexp_replace(found, r"\[\[?\w+\]?\]", ":param")).alias("route"), "path")
    return keep_first(rows.filter("route IS NOT NULL"), ["repo_id", "route"], ["path"])


def deterministic_parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, type, key, label) and edges (repo_id, type, src, dst) of files (repo_id, path, source).

    Routes and controllers have their route as key, validations of page files their path, tables their name. Edges lead
    from a route to the validation in its file and from a table to the one it refers to. A null source holds nothing;
    repeated rows count once; of files of one path with different texts, a validation in any of them counts.
    """
    routes, served = page_routes(files), path_controllers(files)
    checks = scan.validation_kind(files.filter(F.col("path").rlike(PAGE_FOLDERS))).groupBy("repo_id", "path").agg(F.max("kind").alias("kind"))
    catalog = schema.schema_catalog(keep_first(files.filter(F.col("path").endswith(".sql")), ["repo_id", "path"], ["source"]))
    node = lambda df, kind, key, label: df.select("repo_id", F.lit(kind).alias("type"), F.col(key).alias("key"), F.col(label).alias("label"))
    nodes = union([
        node(routes, "route", "route", "label"), node(served, "controller", "route", "route"), node(checks, "validation", "path", "kind"),
        node(catalog.select("repo_id", "table_name").distinct(), "table", "table_name", "table_name"),
    ])
    checked = routes.join(checks, ["repo_id", "path"]).select("repo_id", F.lit("validates").alias("type"), F.col("route").alias("src"), F.col("path").alias("dst"))
    refers = schema.foreign_keys(catalog).select("repo_id", F.col("cardinality").alias("type"), "src", "dst").distinct()
    return nodes, union([checked, refers])


def parse_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, type, n): nodes and edges of each type."""
    return union([nodes.select("repo_id", "type"), edges.select("repo_id", "type")]).groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("n"))
