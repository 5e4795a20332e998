"""Matches of texts that contain each other: labels, paths, tables, models.

Texts are searched for all needles of their repository at once (see
`functions.contain`), so no row meets all rows of its repository and no text is
moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.functions.contain import contained
from reposcope.functions.paths import classify_file, node_label
from reposcope.functions.text import union
from reposcope.operators.scan import scan_http_calls, scan_table_names


def contains_join(whole: DataFrame, text: str, part: DataFrame, piece: str) -> DataFrame:
    """The columns of `whole` but its text, with the rows of `part` of the same repository whose piece the text contains; empty pieces match nothing."""
    return contained(whole, text, part, piece).join(part, ["repo_id", piece])


def plain(column: str):
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def file_stem(column: str):
    return F.regexp_replace(F.substring_index(column, "/", -1), r"\.(ts|tsx|js|jsx)$", "")


def resolve_import_contains(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, specifier, target): the first file whose path contains a relative or @/ specifier; null if none."""
    asked = imports.filter(F.col("specifier").rlike(r"^(\.|@/)")).select("repo_id", "specifier").distinct()
    asked = asked.withColumn("piece", F.regexp_replace(F.regexp_replace("specifier", r"\./", ""), "@/", ""))
    found = contains_join(files.select("repo_id", "path", F.col("path").alias("where")).distinct(), "where", asked, "piece").groupBy("repo_id", "specifier").agg(F.min("path").alias("target"))
    return asked.select("repo_id", "specifier").join(found, ["repo_id", "specifier"], "left")


def attach_by_label(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """(repo_id, node_id, path): nodes with the files (repo_id, path) of findings, where label and file name contain each other."""
    n = nodes.select("repo_id", "node_id", plain("label").alias("label")).filter("label <> ''")
    f = notes.select("repo_id", "path").distinct().withColumn("stem", F.regexp_replace(F.lower(file_stem("path")), "[^a-z0-9]", "")).filter("stem <> ''")
    both = union([x.select("repo_id", "node_id", "path") for x in (contains_join(n, "label", f, "stem"), contains_join(f, "stem", n, "label"))])
    return both.distinct()


def cross_reference(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, src, dst, table_name): controllers and the table nodes of the tables that the files named like them use."""
    scripts = files.filter(F.col("path").rlike(r"\.tsx?$"))
    tables = scan_table_names(scripts).filter("context IN ('query', 'raw SQL')").select("repo_id", "path", "table_name").distinct()
    keyed = tables.withColumn("key", F.regexp_replace(F.lower("path"), "[^a-z0-9]", ""))
    label = nodes.filter("shape = 'rectangle' OR type = 'controller'").select("repo_id", F.col("node_id").alias("src"), plain("label").alias("piece"))
    label = label.filter("piece <> ''")
    paths = keyed.select("repo_id", "path", "key").distinct()
    used = union([contains_join(paths, "key", label, "piece").select("repo_id", "src", "path"), contains_join(label, "piece", paths, "key").select("repo_id", "src", "path")]).distinct()
    named = used.join(keyed, ["repo_id", "path"]).select("repo_id", "src", "table_name", F.lower("table_name").alias("low")).distinct()
    stored = nodes.filter("shape = 'cylinder'").groupBy("repo_id", F.lower("label").alias("low")).agg(F.min("node_id").alias("dst"))
    return named.join(stored, ["repo_id", "low"]).select("repo_id", "src", "dst", "table_name").distinct()


def models_to_tables(actions: DataFrame, tables: DataFrame) -> DataFrame:
    """(repo_id, src, dst): actions (repo_id, src, model) to the tables (repo_id, dst, label) that contain the model or that it contains, else to the first table."""
    a = actions.select("repo_id", "src", F.lower("model").alias("model")).distinct()
    t = tables.select("repo_id", "dst", F.regexp_replace(F.lower("label"), r"^db:\s*", "").alias("label")).distinct()
    known = a.filter("model IS NOT NULL")
    found = union([x.select("repo_id", "src", "dst") for x in (contains_join(t, "label", known, "model"), contains_join(known, "model", t, "label"))]).distinct()
    rest = a.select("repo_id", "src").distinct().join(found, ["repo_id", "src"], "left_anti")
    first = t.groupBy("repo_id").agg(F.min("dst").alias("dst"))
    return found.unionByName(rest.join(first, "repo_id").select("repo_id", "src", "dst"))


def upload_edges(files: DataFrame, views: DataFrame, storage: DataFrame) -> DataFrame:
    """(repo_id, src, dst): files that upload, by the first view (repo_id, node_id, label) whose label their path contains, to the first storage (repo_id, node_id)."""
    s = F.col("source")
    sends = files.filter(s.contains('type="file"') | s.contains("FormData") | s.contains("multipart") | s.contains(".upload(")).select("repo_id", F.lower("path").alias("path"), F.col("path").alias("file")).distinct()
    # views share labels, and only the first view of each can be the one
    named = views.select("repo_id", "node_id", F.lower(F.regexp_replace("label", "^([^/]*)/", "$1")).alias("piece")).groupBy("repo_id", "piece").agg(F.min("node_id").alias("node_id"))
    first = contains_join(sends, "path", named, "piece").groupBy("repo_id", "file").agg(F.min("node_id").alias("src"))
    store = storage.groupBy("repo_id").agg(F.min("node_id").alias("dst"))
    return first.join(store, "repo_id").select("repo_id", "src", "dst").distinct()


def arch_edges(files: DataFrame) -> DataFrame:
    """(repo_id, src, dst, label): UI files to the logic that they fetch, logic and UI files to the schemas that their text names.

    A fetch meets the first logic file of the endpoint's last part, or else the
    first whose path contains it.
    """
    keys = ["repo_id", "path"]
    kind = files.select(*keys, classify_file(F.col("path"), F.col("source")).alias("category"), F.lower("source").alias("low"))
    ui, logic = kind.filter("category = 'UI_NODE'"), kind.filter("category = 'LOGIC_NODE'").select("repo_id", F.col("path").alias("dst"), F.lower("path").alias("where")).distinct()
    db = kind.filter("category = 'DB_NODE'").select("repo_id", F.col("path").alias("dst"), F.lower(node_label(F.col("path"))).alias("name")).groupBy("repo_id", "name").agg(F.min("dst").alias("dst"))
    calls = scan_http_calls(files).filter("method = 'fetch' AND NOT startswith(endpoint, 'http')").select(*keys, F.lower(F.substring_index(F.regexp_replace("endpoint", "/+$", ""), "/", -1)).alias("part")).distinct()
    calls = calls.join(ui.select(*keys).distinct(), keys, "left_semi").filter("part <> ''")
    stem = logic.withColumn("part", F.regexp_replace(F.substring_index("where", "/", -1), r"\.[^.]*$", "")).groupBy("repo_id", "part").agg(F.min("dst").alias("dst"))
    exact = calls.join(stem, ["repo_id", "part"]).select("repo_id", F.col("path").alias("src"), "dst", "part")
    open_ = calls.join(stem, ["repo_id", "part"], "left_anti").withColumnRenamed("path", "src")
    near = contains_join(logic, "where", open_.select("repo_id", "part").distinct(), "part").groupBy("repo_id", "part").agg(F.min("dst").alias("dst"))
    fetch = union([exact.select("repo_id", "src", "dst"), open_.join(near, ["repo_id", "part"]).select("repo_id", "src", "dst")])
    asks = kind.filter("category = 'LOGIC_NODE'").select("repo_id", F.col("path").alias("src"), "low", F.lit("query").alias("label"))
    direct = ui.filter("contains(low, 'supabase') OR contains(low, 'prisma.') OR contains(low, 'mongoose')").select("repo_id", F.col("path").alias("src"), "low", F.lit("direct query").alias("label"))
    named = contains_join(union([asks, direct]), "low", db, "name").select("repo_id", "src", "dst", "label")
    return union([fetch.withColumn("label", F.lit("fetch")), named]).distinct()
