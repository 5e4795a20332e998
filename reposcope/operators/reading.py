"""Pages read together with the files that they import, and the graph of navigation between them.

A page's text is its own and those of its imports, in the order in which a
reader who follows every import at once meets them. The texts are never put
together: files are scanned once, and a finding's line in a page is its line in
the file and the lines of the files before it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.functions.paths import crawl_routes
from reposcope.functions.text import findings, keep_first, union
from reposcope.operators.graph import import_closure
from reposcope.operators.link import file_stems, match_routes, resolved_stem
from reposcope.operators.navigation import KEYS, scan_gates, scan_interactions, targets_to_routes
from reposcope.operators.scan import IMPORT, REQUIRE, scan_route_strings
from reposcope.sources.tables import written

REPO = "repo_id"
#: Imports between a page and a file that is read with it, at most.
DEPTH = 5
#: What an interaction is called on the edges that it makes.
LABELS = {"link": "Link", "router-push": "Redirect", "on-click": "onClick", "on-submit": "onSubmit"}
_ORDER = "repo_id string, page_path string, path string, position int, offset int"


def ordered_imports(files: DataFrame) -> DataFrame:
    """(repo_id, path, target, place): the files that a file imports, in the order it names them, imports before requires."""
    parts = [findings(files.select(*KEYS, "source"), p).select(*KEYS, F.get("found", F.lit(0)).alias("specifier"), F.struct(F.lit(k).alias("k"), "line").alias("place")) for k, p in enumerate((IMPORT, REQUIRE))]
    once = keep_first(union(parts), [*KEYS, "specifier"], ["place"]).withColumn("stem", resolved_stem(F.col("specifier"), F.col("path")))
    found = once.join(file_stems(files).select(REPO, "stem", "target"), [REPO, "stem"])
    return found.select(*KEYS, "target", F.struct("place.k", "place.line", "specifier").alias("place"))


def reading_order(files: DataFrame, pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(repo_id, page_path, path, position, offset): the files read with each page (repo_id, path), from position 0, and the lines before each.

    A file is read once, where it is met first by following the imports of each
    file in turn before the next import of the file before; cycles end there,
    and what is more than `depth` imports away on that way is not read, nor are
    empty files and what they import. Between two files lies an empty line. A
    page's files, without their texts, are one group.
    """
    imports = written(ordered_imports(files))
    sizes = keep_first(files.select(*KEYS, F.when(F.length("source") > 0, 1 + F.regexp_count("source", F.lit("\n"))).alias("lines")), KEYS, ["lines"])
    near = import_closure(pages, imports.withColumn("resolved", F.lit(True)), depth)
    lists = imports.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("place", "target"))).alias("all")).select(*KEYS, F.transform("all", lambda x: x["target"]).alias("targets"))
    members = near.select(REPO, F.col("origin").alias("page_path"), F.col("node_id").alias("path")).join(sizes, KEYS).join(lists, KEYS, "left")

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = {r.path: r for r in rows.itertuples()}
        todo, seen, out, lines = [(key[1], 0)], set(), [], 0
        while todo:
            path, far = todo.pop()
            if far > depth or path in seen or path not in known:
                continue
            seen.add(path)
            row = known[path]
            if pd.isna(row.lines):
                continue
            out.append((path, len(out), lines))
            lines += int(row.lines) + 1
            todo += [(t, far + 1) for t in reversed(row.targets if row.targets is not None else [])]
        texts = pd.DataFrame({REPO: [key[0]] * len(out), "page_path": [key[1]] * len(out), "path": [p for p, _, _ in out]}, dtype=object)
        return texts.assign(position=[k for _, k, _ in out], offset=[n for _, _, n in out])

    return members.groupBy(REPO, "page_path").applyInPandas(follow, _ORDER)


def page_graph(files: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, node_id, type, label, line) and edges (repo_id, src, dst, kind, label) of the navigation between pages.

    An interaction of a page, or of a file read with it, that leads to another
    page goes over the first kind of gate that lies before it (action, then
    success, and failure to an error), or else straight there, a handler by an
    action of its own. A handler that leads to no other page is an action only.
    Pages without a link or push have edges (reference) to the pages that their
    strings may mean.
    """
    pages = written(crawl_routes(files).select(REPO, F.col("path").alias("page_path"), F.col("route").alias("page")))
    read = written(reading_order(files, pages.select(REPO, F.col("page_path").alias("path")), depth).join(pages, [REPO, "page_path"]))
    every = scan_interactions(files).withColumnRenamed("kind", "by").join(read, KEYS).select(REPO, "page_path", "page", "by", "target", (F.col("line") + F.col("offset")).alias("line"))
    every = written(every.distinct())
    routes = targets_to_routes(every, pages.select(REPO, F.col("page").alias("route")))
    led = every.join(routes, [REPO, "target"], "left").withColumn("route", F.when(F.col("route") != F.col("page"), F.col("route")))
    led = written(led)
    # of each kind of gate the first one of a page is enough
    gates = scan_gates(files).join(read, KEYS).groupBy(REPO, "page_path", "rank", F.col("kind").alias("gate")).agg(F.min(F.struct((F.col("line") + F.col("offset")).alias("gate_line"), F.col("label").alias("gate_label"))).alias("g"))
    own = [REPO, "page_path", "page", "by", "target", "line", "route"]
    before = led.filter("route IS NOT NULL").join(gates.select(REPO, "page_path", "rank", "gate", "g.*"), [REPO, "page_path"]).filter("gate_line < line")
    gated = written(keep_first(before, own, ["rank", "gate_line", "gate", "gate_label"]))
    told = [c for c in own if c != "route"]
    open_ = written(led.join(gated.select(*told), told, "left_anti"))
    where = F.concat_ws(":", "page_path", "by", "target", "line")
    page, there = F.concat(F.lit("page:"), "page"), F.concat(F.lit("page:"), "route")
    gate, error, act = F.concat(F.lit("gate:"), where), F.concat(F.lit("error:"), where), F.concat(F.lit("action:"), where)
    edge = lambda a, b, kind, label: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), (F.lit(label) if isinstance(label, str) else label).alias("label"))
    handler = F.col("by").isin("on-click", "on-submit")
    said = F.coalesce(*[F.when(F.col("by") == k, v) for k, v in LABELS.items()])
    asked = F.when(handler, "Submit").otherwise(said)
    over = gated.select(REPO, F.explode(F.array(edge(page, gate, "action", asked), edge(gate, there, "success", "Success Path"), edge(gate, error, "failure", "Failure Path"))).alias("e"))
    handled = open_.filter(handler)
    acts = handled.select(REPO, edge(page, act, "action", said).alias("e")).unionByName(handled.filter("route IS NOT NULL").select(REPO, edge(act, there, "navigation", "Navigate").alias("e")))
    straight = open_.filter(~handler & F.col("route").isNotNull()).select(REPO, edge(page, there, "navigation", said).alias("e"))
    loud = every.filter(~handler).select(REPO, "page_path").distinct()
    strings = scan_route_strings(files).select(*KEYS, F.col("route").alias("candidate")).join(read.join(loud, [REPO, "page_path"], "left_anti"), KEYS)
    strings = written(strings.select(REPO, "page_path", "page", "candidate").distinct())
    strings = strings.join(every.select(REPO, "page_path", F.col("target").alias("candidate")).distinct(), [REPO, "page_path", "candidate"], "left_anti")
    meant = strings.join(match_routes(strings, pages.select(REPO, F.col("page").alias("route"))).select(REPO, "candidate", "route"), [REPO, "candidate"]).filter("route <> page")
    guessed = meant.select(REPO, edge(page, there, "reference", "Reference").alias("e"))
    edges = union([over, acts, straight, guessed]).select(REPO, "e.*").distinct()
    node = lambda key, kind, label, line: [REPO, key.alias("node_id"), F.lit(kind).alias("type"), label.alias("label"), line.alias("line")]
    triggered = F.when(F.col("by") == "on-click", "Trigger Action").otherwise("Trigger Redirection")
    nodes = union([
        pages.select(*node(page, "page", F.col("page"), F.lit(None).cast("int"))), gated.select(*node(gate, "validation", F.col("gate_label"), F.col("gate_line"))),
        gated.select(*node(error, "action", F.lit("Error Response"), F.col("gate_line"))), handled.select(*node(act, "action", triggered, F.col("line"))),
    ])
    return nodes.distinct(), edges
