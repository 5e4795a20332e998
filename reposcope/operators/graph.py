"""Questions on graphs of many repositories: degrees, gaps, reach, layers, components.

Nodes have repo_id, node_id, type, label, shape; edges repo_id, src, dst, kind.
Every join key holds a node, never the repository alone, so a large repository
spreads over the cluster. Loops write each round to the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.text import union
from reposcope.operators.sequence import following
from reposcope.sources.tables import forget, written

REPO = "repo_id"
#: Levels of a loop kept as tables of their own before they are written as one.
LEVELS = 16
#: Rounds of Kahn's order on all links before they are contracted.
PLAIN = 4
#: Links of which less than this part is left are written anew.
FEW = 8


def ends(edges: DataFrame) -> DataFrame:
    """(repo_id, node_id): every node on an edge."""
    return edges.select(REPO, F.explode(F.array("src", "dst")).alias("node_id"))


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge."""
    return nodes.join(ends(edges), [REPO, "node_id"], "left_anti").select(REPO, "node_id", "type")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge into them."""
    return nodes.join(edges.select(REPO, F.col("dst").alias("node_id")), [REPO, "node_id"], "left_anti").select(REPO, "node_id", "type")


def exit_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge out of them."""
    return nodes.join(edges.select(REPO, F.col("src").alias("node_id")), [REPO, "node_id"], "left_anti").select(REPO, "node_id", "type")


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    known = nodes.select(REPO, "node_id")
    return edges.join(known.withColumnRenamed("node_id", "src"), [REPO, "src"], "left_semi").join(known.withColumnRenamed("node_id", "dst"), [REPO, "dst"], "left_semi").select(REPO, "src", "dst", "kind")


def with_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with src_type and dst_type."""
    kinds = nodes.select(REPO, "node_id", "type")
    a = kinds.select(REPO, F.col("node_id").alias("src"), F.col("type").alias("src_type"))
    b = kinds.select(REPO, F.col("node_id").alias("dst"), F.col("type").alias("dst_type"))
    return edges.join(a, [REPO, "src"]).join(b, [REPO, "dst"])


def view_db_bypass(nodes: DataFrame, edges: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """Edges from a view straight to a database; `typed` are the edges if they have their types already."""
    return (typed or with_types(nodes, edges)).filter("src_type = 'view' AND dst_type = 'database'").select(REPO, "src", "dst")


def link_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with link_type by the layers of their ends."""
    kind = (
        F.when((F.col("src_type") == "view") & (F.col("dst_type") == "controller"), "ui-to-controller")
        .when((F.col("src_type") == "controller") & (F.col("dst_type") == "database"), "controller-to-db")
        .otherwise("direct")
    )
    return with_types(nodes, edges).select(REPO, "src", "dst", "kind", kind.alias("link_type"))


def missing_validation(nodes: DataFrame, edges: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """View to controller edges of views that have no validation beside them; `typed` are the edges if they have their types already."""
    typed = typed or with_types(nodes, edges)
    checked = union(
        [
            typed.filter("src_type = 'view' AND dst_type = 'validation'").select(REPO, "src"),
            typed.filter("dst_type = 'view' AND src_type = 'validation'").select(REPO, F.col("dst").alias("src")),
        ]
    )
    open_ = nodes.filter(~F.lower("label").contains("public")).select(REPO, F.col("node_id").alias("src"))
    views = typed.filter("src_type = 'view' AND dst_type = 'controller'").join(checked, [REPO, "src"], "left_anti")
    return views.join(open_, [REPO, "src"], "left_semi").select(REPO, "src", "dst")


def god_classes(nodes: DataFrame, edges: DataFrame, many: int = 6, very_many: int = 10) -> DataFrame:
    """(repo_id, node_id, fan_out, severity, parts): controllers with many edges out, and how many to split them into."""
    counts = edges.groupBy(REPO, F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_out")).filter(F.col("fan_out") >= many)
    some = nodes.filter("type = 'controller' OR shape = 'rectangle'").select(REPO, "node_id")
    return counts.join(some, [REPO, "node_id"], "left_semi").select(
        REPO, "node_id", "fan_out", F.when(F.col("fan_out") >= very_many, "high").otherwise("medium").alias("severity"), F.ceil(F.col("fan_out") / 3).alias("parts")
    )


def oversized_files(nodes: DataFrame, edges: DataFrame, many: int = 8, very_many: int = 12) -> DataFrame:
    """(repo_id, node_id, fan_in, severity): nodes but databases with many edges into them."""
    counts = edges.groupBy(REPO, F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_in")).filter(F.col("fan_in") >= many)
    some = nodes.filter("type <> 'database' AND shape <> 'cylinder'").select(REPO, "node_id")
    return counts.join(some, [REPO, "node_id"], "left_semi").select(REPO, "node_id", "fan_in", F.when(F.col("fan_in") >= very_many, "high").otherwise("medium").alias("severity"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, views, controllers, databases, validations, edges): counts per repository."""
    by = {"views": "view", "controllers": "controller", "databases": "database", "validations": "validation"}
    a = nodes.groupBy(REPO).agg(*[F.count_if(F.col("type") == t).alias(k) for k, t in by.items()])
    return a.join(edges.groupBy(REPO).agg(F.count(F.lit(1)).alias("edges")), REPO, "left").select(REPO, *by, F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, nodes, orphans, unchecked, score): 100 less 50 for each issue per node, 0 at least.

    Issues are nodes without edges and edges from views without validation.
    """
    n = nodes.groupBy(REPO).agg(F.count(F.lit(1)).alias("nodes"))
    orphans = orphan_nodes(nodes, edges).groupBy(REPO).agg(F.count(F.lit(1)).alias("orphans"))
    gaps = missing_validation(nodes, edges).groupBy(REPO).agg(F.countDistinct("dst").alias("unchecked"))
    out = n.join(orphans, REPO, "left").join(gaps, REPO, "left").fillna(0, ["orphans", "unchecked"])
    score = F.greatest(F.lit(0.0), F.round(100 - (F.col("orphans") + F.col("unchecked")) / F.col("nodes") * 50))
    return out.select(REPO, "nodes", "orphans", "unchecked", score.cast("long").alias("score"))


def reach(seeds: DataFrame, edges: DataFrame, depth: int | None = None, backward: bool = False) -> DataFrame:
    """(repo_id, origin, node_id, depth): what each seed (repo_id, origin, node_id) reaches in up to `depth` edges, or in any number.

    Levels run one after the other; a level keeps only what no level before it
    has, so cycles end. The seed itself has depth 0. Many levels are written as
    one, so that plans don't grow with the depth.
    """
    step = written(edges.select(REPO, "src", "dst").distinct())
    found = reach_over(seeds, step, depth, backward)
    forget(step)
    return found


def reach_over(seeds: DataFrame, links: DataFrame, depth: int | None = None, backward: bool = False) -> DataFrame:
    """`reach` over links that are a written table already."""
    return union(_levels(seeds, links, depth, backward))


def _levels(seeds: DataFrame, links: DataFrame, depth: int | None = None, backward: bool = False) -> list[DataFrame]:
    """The parts of `reach_over`, in the order of their depths."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = links.select(REPO, F.col(a).alias("node_id"), F.col(b).alias("next"))
    key = [REPO, "origin", "node_id"]
    front = written(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    levels = [front]
    for d in count(1) if depth is None else range(1, depth + 1):
        near = front.join(step, [REPO, "node_id"]).select(REPO, "origin", F.col("next").alias("node_id")).distinct()
        front = written(near.join(union(levels), key, "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        levels.append(front)
        if len(levels) > LEVELS:
            before, levels = levels, [written(union(levels))]
            for old in before:
                if old is not front:
                    forget(old)
    return levels


def peeled(edges: DataFrame, backward: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Links (repo_id, src, dst) without those that were taken off, and these in turns: all links to nodes without a way on.

    A link of a turn leads to a node whose links were all taken off by earlier
    turns, so from there a search only meets links of earlier turns. Links on or
    before a cycle stay, as do those to no node. It ends when less than an
    eighth of the links goes, so all turns together read them some times.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    rest, turns = edges.select(REPO, "src", "dst"), []
    while True:
        out = rest.select(REPO, F.col(a).alias(b)).distinct().withColumn("on", F.lit(True))
        told = written(rest.join(out, [REPO, b], "left").select(REPO, "src", "dst", (F.col("on").isNotNull() | F.col(b).isNull()).alias("on")))
        sizes = told.agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("left")).first()
        rest = told.filter("on").drop("on")
        if sizes["left"] < sizes["n"]:
            turns.append(told.filter("NOT on").drop("on"))
        if not sizes["left"] or (sizes["n"] - sizes["left"]) * FEW < sizes["n"]:
            return rest, turns


def reach_peeled(seeds: DataFrame, parts: tuple[DataFrame, list[DataFrame]], depth: int | None = None, backward: bool = False) -> list[DataFrame]:
    """`reach` in parts over `peeled` links: the seeds and what links that stayed lead to, and the ends of each turn, the first turn last.

    Only links that stayed are followed level by level. Those of a turn are
    followed once, the last turn first, from all that was found before: the ways
    to their ends are all known then, and no end is on one to itself.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    key = [REPO, "origin", "node_id"]
    core, turns = parts
    start = written(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    if not turns:
        return [reach_over(start, core, depth, backward)]
    core = written(core.distinct())
    # other seeds are neither followed nor met
    inner = start.join(ends(core).distinct(), [REPO, "node_id"], "left_semi")
    parts_ = _levels(inner, core, depth, backward)
    found = [start, union(parts_).filter("depth > 0")]
    shared = not start.filter("origin <> node_id").isEmpty()
    layers: list[DataFrame] = []
    for turn in reversed(turns):
        step = turn.select(REPO, F.col(a).alias("node_id"), F.col(b).alias("next"))
        near = union([*found, *layers])
        near = near if depth is None else near.filter(F.col("depth") < depth)
        near = near.join(step, [REPO, "node_id"]).groupBy(REPO, "origin", F.col("next").alias("node_id")).agg((F.min("depth") + 1).alias("depth"))
        layers.append(written(near.join(start.select(*key), key, "left_anti") if shared else near))
    return [union(found), *layers]


def _turned(found: DataFrame) -> DataFrame:
    """What lies behind every node, from what lies ahead of every node."""
    return found.select(REPO, F.col("node_id").alias("origin"), F.col("origin").alias("node_id"), "depth")


def _of_all(nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether all ends of edges are nodes, so that what lies behind them is found by the search ahead of them."""
    return union([edges.select(REPO, F.col(end).alias("node_id")).distinct() for end in ("src", "dst")]).join(nodes, [REPO, "node_id"], "left_anti").isEmpty()


def _both_ways(origins: DataFrame, edges: DataFrame, depth: int | None, whole: bool, parts: tuple[DataFrame, list[DataFrame]] | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """`reach_peeled` ahead of and behind each origin, over `parts` if edges were peeled before; with `whole` the origins are all nodes and all ends, and there is one search."""
    seeds = origins.select(REPO, F.col("node_id").alias("origin"), "node_id")
    ahead = reach_peeled(seeds, parts or peeled(edges), depth)
    if whole:
        return ahead, [_turned(part) for part in ahead]
    return ahead, reach_peeled(seeds, peeled(edges, backward=True), depth, backward=True)


def blast_radius(origins: DataFrame, edges: DataFrame, depth: int | None = None, whole: bool = False) -> DataFrame:
    """(repo_id, origin, node_id, category, depth): what breaks if an origin (repo_id, node_id) is deleted, at any depth if none is given.

    Nodes ahead are direct (one edge) or transitive; nodes only behind it are
    orphaned by the deletion. The origin itself is not listed. `whole` says that
    the origins are all nodes.
    """
    (ahead, *far), (behind, *back) = _both_ways(origins, edges, depth, whole and _of_all(origins, edges))
    # two nodes that reach each other are on a cycle, whose links are never taken off
    behind = behind.join(ahead, [REPO, "origin", "node_id"], "left_anti")
    kind = F.when(F.col("depth") == 1, "direct").otherwise("transitive")
    orphaned = F.lit("orphaned-by-deletion")
    parts = [x.withColumn("category", kind) for x in (ahead, *far)] + [x.withColumn("category", orphaned) for x in (behind, *back)]
    return union(parts).filter("depth > 0").select(REPO, "origin", "node_id", "category", "depth")


def reach_paths(seeds: DataFrame, edges: DataFrame, backward: bool = False) -> DataFrame:
    """(repo_id, origin, node_id, depth, path): what each seed (repo_id, origin, node_id) reaches, and the way there.

    As in `reach` a level keeps only what no level before it has. Of the nodes
    that a node is reached from in as few edges the smallest counts; the way to
    it, nodes joined by >, goes on. Seeds have depth 0.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = written(edges.select(REPO, F.col(a).alias("node_id"), F.col(b).alias("next")).distinct())
    key = [REPO, "origin", "node_id"]
    front = written(seeds.select(*key).distinct().withColumns({"depth": F.lit(0), "path": F.col("node_id")}))
    levels = [front]
    for d in count(1):
        near = front.join(step, [REPO, "node_id"]).groupBy(REPO, "origin", F.col("next").alias("to")).agg(F.min(F.struct("node_id", "path")).getField("path").alias("way"))
        near = near.select(REPO, "origin", F.col("to").alias("node_id"), F.lit(d).alias("depth"), F.concat_ws(">", "way", "to").alias("path"))
        front = written(near.join(union(levels).select(*key), key, "left_anti").select(*key, "depth", "path"))
        if front.isEmpty():
            break
        levels.append(front)
        if len(levels) > LEVELS:
            before, levels = levels, [written(union(levels))]
            for old in before:
                if old is not front:
                    forget(old)
    forget(step)
    return union(levels)


def impacts(origins: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, origin, node_id, category, depth, path, is_route): `blast_radius` with the way to each node.

    The way behind an origin begins at it as well. is_route tells whether the
    node lies ahead and is a page or a controller by its shape.
    """
    seeds = origins.select(REPO, F.col("node_id").alias("origin"), "node_id")
    ahead = written(reach_paths(seeds, edges))
    behind = reach_paths(seeds, edges, backward=True).join(ahead.select(REPO, "origin", "node_id"), [REPO, "origin", "node_id"], "left_anti")
    kind = F.when(F.col("depth") == 1, "direct").otherwise("transitive")
    found = union([ahead.withColumn("category", kind), behind.withColumn("category", F.lit("orphaned-by-deletion"))]).filter("depth > 0")
    routes = nodes.filter("shape IN ('pill', 'rectangle')").select(REPO, "node_id", F.lit(True).alias("shown")).distinct()
    is_route = F.coalesce("shown", F.lit(False)) & (F.col("category") != "orphaned-by-deletion")
    return found.join(routes, [REPO, "node_id"], "left").select(REPO, "origin", "node_id", "category", "depth", "path", is_route.alias("is_route"))


def broken_edges(origins: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, origin, src, dst, kind): the edges that an origin's deletion breaks, those that begin or end at it."""
    own = origins.select(REPO, F.col("node_id").alias("origin")).distinct()
    parts = [edges.join(own.withColumn(end, F.col("origin")), [REPO, end]) for end in ("src", "dst")]
    return union([p.select(REPO, "origin", "src", "dst", "kind") for p in parts]).distinct()


def deletion_summary(origins: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, origin, impacted, routes, services, broken): how many nodes, of them pages and controllers, and edges an origin's deletion concerns."""
    # numbers in the order of the shapes; a minimum of texts would have all nodes sorted
    place = F.when(F.col("shape") < "pill", 0).when(F.col("shape") == "pill", 1).when(F.col("shape") < "rectangle", 2).when(F.col("shape") == "rectangle", 3)
    shapes = nodes.groupBy(REPO, "node_id").agg(F.min(F.when(F.col("shape").isNotNull(), F.coalesce(place, F.lit(4)))).alias("shape")).filter("shape IN (1, 3)")
    found = blast_radius(origins, edges).join(shapes, [REPO, "node_id"], "left").groupBy(REPO, "origin")
    counts = found.agg(F.count(F.lit(1)).alias("impacted"), F.count_if(F.col("shape") == 1).alias("routes"), F.count_if(F.col("shape") == 3).alias("services"))
    broken = broken_edges(origins, edges).groupBy(REPO, "origin").agg(F.count(F.lit(1)).alias("broken"))
    every = origins.select(REPO, F.col("node_id").alias("origin")).distinct().join(counts, [REPO, "origin"], "left").join(broken, [REPO, "origin"], "left")
    return every.fillna(0, ["impacted", "routes", "services", "broken"])


def gaps(nodes: DataFrame, edges: DataFrame, sensitive: Column, guard: Column, hops: int = 5, parts: tuple[DataFrame, list[DataFrame]] | None = None) -> DataFrame:
    """Sensitive nodes without a guard among the nodes from which up to `hops` edges lead to them, themselves included.

    Guards spread forward instead of every sensitive node searching backward,
    so a node is visited once whatever the number of searches. `parts` are the
    edges if they were `peeled` before.
    """
    guards = nodes.filter(guard).select(REPO, F.lit("guard").alias("origin"), "node_id")
    safe = union(reach_peeled(guards, parts, hops)) if parts else reach(guards, edges, hops)
    return nodes.filter(sensitive).join(safe, [REPO, "node_id"], "left_anti").select(REPO, "node_id", "type")


def contracted(links: DataFrame, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs of nodes with a single way in, shortened by pointer doubling.

    Gives (repo_id, node_id, head, dist), the head and the distance to it of
    every node on a run, and the links (repo_id, src, dst, nearest, farthest) between
    heads, with their shortest and longest way. Heads are the nodes with no or several ways in and the `stops`. A
    run that bites its own tail has no head; its nodes are on no run, and links
    from them keep them as their source.
    """
    single = links.groupBy(REPO, F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("head")).filter("n = 1")
    single = single if stops is None else single.join(stops, [REPO, "node_id"], "left_anti")
    open_ = written(single.select(REPO, "node_id", "head", F.lit(1).cast("long").alias("dist")))
    every, size, far = open_.select(REPO, F.col("node_id").alias("dst")), open_.count(), 1
    table = open_
    while far <= 2 * size:
        # a head on a run is followed by its own pointer; the others stay
        up = table.select(REPO, F.col("node_id").alias("head"), F.col("head").alias("up"), F.col("dist").alias("more"))
        moved = table.join(up, [REPO, "head"], "left")
        table = written(moved.select(REPO, "node_id", F.coalesce("up", "head").alias("head"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("up").isNotNull().alias("moved")))
        if table.filter("moved").isEmpty():
            break
        far *= 2
    # what still points into a run after as many steps as there are nodes is on or behind a cycle of single ways in
    runs = written(table.join(every.withColumnRenamed("dst", "head"), [REPO, "head"], "left_anti").select(REPO, "node_id", "head", "dist"))
    above = runs.select(REPO, F.col("node_id").alias("src"), "head", "dist")
    rest = links.join(every, [REPO, "dst"], "left_anti").join(above, [REPO, "src"], "left")
    joined = rest.groupBy(REPO, F.coalesce("head", "src").alias("src"), "dst").agg((F.min(F.coalesce("dist", F.lit(0))) + 1).alias("nearest"), (F.max(F.coalesce("dist", F.lit(0))) + 1).alias("farthest"))
    return runs, written(joined)


def layered(starts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kahn's order: (repo_id, node_id, layer) of the nodes that get a layer, and (repo_id, node_id), the ends of links that get none.

    Nodes of `starts` without a way in are free at first; links that begin at
    other nodes without a way in keep their ends waiting. A round takes the
    links of free nodes off; a node waits while a link leads to it, and its
    layer is the largest that the nodes before it have given it. What is left after a few
    rounds is contracted if nodes are still free, so that long runs don't take
    a round for each node.
    """
    into = links.select(REPO, F.col("dst").alias("node_id"))
    front = written(starts.select(REPO, "node_id").distinct().join(into, [REPO, "node_id"], "left_anti").withColumn("layer", F.lit(0).cast("long")))
    done, waiting, runs, whole, met, few = [front], None, None, None, None, False
    for turn in count(1):
        if front.isEmpty():
            break
        if turn > PLAIN and runs is None:
            whole = links
            runs, links = contracted(links.distinct(), waiting.select(REPO, "node_id"))
        ready = front.withColumnRenamed("node_id", "src")
        if few:
            ready = ready.join(links.select(REPO, "src"), [REPO, "src"], "left_semi")
        old, met = met, written(links.join(ready, [REPO, "src"], "left"))
        if old is not None and whole is None:
            forget(old)
        given = met.filter("layer IS NOT NULL").select(REPO, F.col("dst").alias("node_id"), (F.col("layer") + (F.lit(1) if runs is None else F.col("farthest"))).alias("layer"))
        links, every = met.filter("layer IS NULL").drop("layer"), met.count()
        few = links.count() * FEW < every
        # a table of its own has a size by which Spark can tell that it is small
        links = written(links) if few else links
        still = links.select(REPO, F.col("dst").alias("node_id")).distinct().withColumn("waits", F.lit(True))
        state = (given if waiting is None else given.unionByName(waiting)).groupBy(REPO, "node_id").agg(F.max("layer").alias("layer"))
        state = written(state.join(still, [REPO, "node_id"], "left"))
        front, waiting = (state.filter(f"waits IS {w} NULL").drop("waits") for w in ("", "NOT"))
        done.append(front)
        if len(done) > LEVELS:
            done = [written(union(done))]
    known = union(done)
    if runs is None:
        return known, links.select(REPO, F.col("dst").alias("node_id")).distinct()
    heads = written(known)
    on_runs = runs.join(heads.withColumnRenamed("node_id", "head"), [REPO, "head"]).select(REPO, "node_id", (F.col("layer") + F.col("dist")).alias("layer"))
    known = written(union([heads, on_runs]))
    return known, whole.select(REPO, F.col("dst").alias("node_id")).distinct().join(known, [REPO, "node_id"], "left_anti")


def topo_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, layer): Kahn layers; nodes on or behind cycles have layer -1."""
    known, _ = layered(nodes, edges.filter("src <> dst").select(REPO, "src", "dst"))
    return nodes.select(REPO, "node_id").join(known, [REPO, "node_id"], "left").select(REPO, "node_id", F.coalesce("layer", F.lit(-1)).cast("int").alias("layer"))


def nearest(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, depth): edges from the nearest seed (repo_id, node_id), over the contracted graph until nothing gets nearer."""
    steps = written(edges.select(REPO, "src", "dst").filter("src <> dst").distinct())
    runs, links = contracted(steps, seeds.select(REPO, "node_id"))
    best = front = written(seeds.select(REPO, "node_id").distinct().withColumn("depth", F.lit(0).cast("long")))
    while not front.isEmpty():
        near = links.join(front.withColumnRenamed("node_id", "src"), [REPO, "src"]).groupBy(REPO, F.col("dst").alias("node_id")).agg(F.min(F.col("depth") + F.col("nearest")).alias("depth"))
        old = best.withColumnRenamed("depth", "old")
        front = written(near.join(old, [REPO, "node_id"], "left").filter("old IS NULL OR depth < old").select(REPO, "node_id", "depth"))
        best = written(union([best, front]).groupBy(REPO, "node_id").agg(F.min("depth").alias("depth")))
    on_runs = runs.join(best.withColumnRenamed("node_id", "head"), [REPO, "head"]).select(REPO, "node_id", (F.col("depth") + F.col("dist")).alias("depth"))
    return union([best, on_runs]).withColumn("depth", F.col("depth").cast("int"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, component): the smallest node that a node is joined to by any path, direction ignored.

    Nodes go by a hash of theirs; two that share one are told by a second hash, and
    then others are taken. Every node points to its smallest neighbour if that
    is smaller than itself, pointers are followed to their ends by doubling, and
    links go on between those. In two rounds at least half of the nodes that
    still have links are gone, so only the first round reads the links of all.
    Paths don't lead over ends that are no nodes, but such an end may name the
    component of its neighbours. Tables with rows of equal nodes are `_labelled`.
    """
    linked = edges.select(REPO, "src", "dst").filter("repo_id IS NOT NULL AND src <> dst")
    for salt in count():
        key = lambda name: F.xxhash64(F.lit(salt), REPO, name)  # noqa: B023, E731
        links = linked.select(key("src").alias("a"), key("dst").alias("b"))
        names = written(nodes.groupBy(key("node_id").alias("node")).agg(F.min(F.hash(REPO, "node_id")).alias("check"), F.max(F.hash(REPO, "node_id")).alias("other"), F.count_if(F.col(REPO).isNotNull() & F.col("node_id").isNotNull()).alias("n")))
        ends_ = union([linked.select(key(x).alias("node"), key(y).alias("next"), F.hash(REPO, x).alias("own")) for x, y in (("src", "dst"), ("dst", "src"))])
        low = ends_.groupBy("node").agg(F.min("next").alias("least"), F.min("own").alias("own"), F.max("own").alias("last")).join(names, "node", "left")
        low = written(low.select("node", "least", F.col("check").isNull().alias("strange"), (F.coalesce(F.col("check") != F.col("own"), F.lit(False)) | (F.col("own") != F.col("last"))).alias("clash")))
        if low.filter("clash").isEmpty() and names.filter("check <> other").isEmpty():
            break
    if not names.filter("n > 1").isEmpty():
        return _labelled(nodes, linked)
    strange = low.filter("strange").select("node")
    beyond = None
    if not strange.isEmpty():
        marks = (strange.select(F.col("node").alias(end), F.lit(True).alias(f"no_{end}")) for end in ("a", "b"))
        told = linked.select("src", "dst", key("src").alias("a"), key("dst").alias("b"))
        for mark in marks:
            told = told.join(mark, mark.columns[0], "left")
        told = written(told)
        links = told.filter("no_a IS NULL AND no_b IS NULL").select("a", "b")
        outside = [told.filter(f"no_{own} IS NULL AND no_{other} IS NOT NULL").select(F.col(own).alias("node"), F.col(name).alias("beyond")) for own, other, name in (("a", "b", "dst"), ("b", "a", "src"))]
        beyond = union(outside)
        low = written(_lowest(links))
    turns: list[DataFrame] = []
    while not low.isEmpty():
        roots = _followed(low.select("node", F.least("node", "least").alias("root")))
        turns.append(roots)
        a, b = (roots.select(F.col("node").alias(end), F.col("root").alias(to)) for end, to in (("a", "src"), ("b", "dst")))
        met = links.join(a, "a").join(b, "b").filter("src <> dst")
        links = written(met.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
        low = written(_lowest(links))
    known = None
    for roots in reversed(turns):
        # the nodes that a round leaves are fewer, so the last ones are put together first
        after = known.select(F.col("node").alias("root"), F.col("root").alias("last")) if known is not None else None
        known = roots if after is None else roots.join(after, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    every = nodes.select(REPO, "node_id", key("node_id").alias("node"))
    if known is not None:
        every = written(every.join(known, "node", "left").select(REPO, "node_id", "node", F.coalesce("root", "node").alias("root")))
    else:
        every = every.withColumn("root", F.col("node"))
    called = every.groupBy("root").agg(F.min("node_id").alias("least"))
    if beyond is not None:
        outer = beyond.join(every.select("node", "root").distinct(), "node").select("root", F.col("beyond").alias("least"))
        called = called.unionByName(outer).groupBy("root").agg(F.min("least").alias("least"))
    known_node = F.col(REPO).isNotNull() & F.col("node_id").isNotNull()
    return every.join(called, "root").select(REPO, "node_id", F.when(known_node, F.col("least")).otherwise(F.col("node_id")).alias("component"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`components` by labels of neighbours, of which a round takes the smallest and then the label of that; a node that comes several times multiplies the rows of those that have its name."""
    both = written(union([links, links.select(REPO, F.col("dst").alias("src"), F.col("src").alias("dst"))]).distinct())
    start = both.groupBy(REPO, "src").agg(F.min("dst").alias("least")).withColumnRenamed("src", "node_id")
    labels = written(nodes.select(REPO, "node_id").join(start, [REPO, "node_id"], "left").select(REPO, "node_id", F.least("node_id", F.coalesce("least", "node_id")).alias("component"), F.lit(True).alias("moved")))
    while not labels.filter("moved").isEmpty():
        mine = labels.select(REPO, "node_id", "component")
        near = both.join(mine.withColumnRenamed("node_id", "dst"), [REPO, "dst"]).groupBy(REPO, "src").agg(F.min("component").alias("near")).withColumnRenamed("src", "node_id")
        low = mine.join(near, [REPO, "node_id"], "left").select(REPO, "node_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        above = mine.select(REPO, F.col("node_id").alias("component"), F.col("component").alias("up"))
        low = low.join(above, [REPO, "component"], "left").withColumn("component", F.least("component", F.coalesce("up", "component")))
        labels = written(low.select(REPO, "node_id", "component", (F.col("old") != F.col("component")).alias("moved")))
    return labels.select(REPO, "node_id", "component")


def _lowest(links: DataFrame) -> DataFrame:
    """(node, least): the smallest neighbour of every node on a link (a, b)."""
    return links.unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def _followed(pointers: DataFrame) -> DataFrame:
    """(node, root): where pointers without rings end, by doubling; nodes that have arrived are not moved again."""
    open_, settled = written(pointers), []
    while True:
        up = union([*settled, open_]).select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = written(open_.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
        settled.append(moved.filter("NOT moved").drop("moved"))
        open_ = moved.filter("moved").drop("moved")
        if open_.isEmpty():
            return union(settled)


def flow_trace(origins: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 50) -> DataFrame:
    """(repo_id, origin, node_id, depth, is_exit): what lies ahead of each origin, and which of it has no way out."""
    ahead = reach(origins.select(REPO, F.col("node_id").alias("origin"), "node_id"), edges, depth)
    ends_ = exit_points(nodes, edges).select(REPO, "node_id", F.lit(True).alias("is_exit"))
    return ahead.join(ends_, [REPO, "node_id"], "left").select(REPO, "origin", "node_id", "depth", F.coalesce("is_exit", F.lit(False)).alias("is_exit"))


def flow_traces(origins: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 50, whole: bool = False, parts: tuple[DataFrame, list[DataFrame]] | None = None) -> DataFrame:
    """(repo_id, origin, direction, node_id, depth, is_exit): what lies ahead of and behind each origin, and which of it has no way on.

    Ends that are no nodes are neither listed nor passed, but a node with an edge to one is no exit.
    `whole` says that the origins are all nodes, `parts` are the edges if they were `peeled` before.
    """
    key = [REPO, "node_id"]
    outs, into = (written(edges.select(REPO, F.col(end).alias("node_id")).distinct()) for end in ("src", "dst"))
    # ends that are no nodes are few, so that edges need not meet all nodes twice
    strange = written(outs.unionByName(into).distinct().join(nodes, key, "left_anti"))
    known, loose = edges.select(REPO, "src", "dst"), not strange.isEmpty()
    if loose:
        for end in ("src", "dst"):
            known = known.join(strange.withColumnRenamed("node_id", end), [REPO, end], "left_anti")
        known = written(known)
    whole = whole and strange.filter("node_id IS NULL OR repo_id IS NULL").isEmpty()
    found = _both_ways(origins, known, depth, whole, None if loose else parts)
    made = []
    for way, some, last in zip(("forward", "backward"), found, (outs, into)):
        exits = nodes.join(last, key, "left_anti").select(*key, F.lit(True).alias("is_exit"))
        asked = some
        if not loose and not (whole and way == "backward"):
            exits = written(exits)
            if exits.groupBy(*key).count().filter("count > 1").isEmpty():
                # the ends of the first turn have no way on, those of the others have one
                asked, sure = some[:1], some[1:]
                made += [part.select(REPO, "origin", F.lit(way).alias("direction"), "node_id", "depth", F.lit(k == len(sure)).alias("is_exit")) for k, part in enumerate(sure, 1)]
        made.append(union(asked).join(exits, key, "left").select(REPO, "origin", F.lit(way).alias("direction"), "node_id", "depth", F.coalesce("is_exit", F.lit(False)).alias("is_exit")))
    return union(made)


def leads_to_cycle(nodes: DataFrame, edges: DataFrame, parts: tuple[DataFrame, list[DataFrame]] | None = None) -> DataFrame:
    """(repo_id, node_id): nodes from which a cycle can be reached, those on one included; Kahn's order from the nodes without a way out never comes to them."""
    back = (parts or peeled(edges))[0].select(REPO, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return layered(back.select(REPO, F.col("src").alias("node_id")), back)[1]


def flow_summary(origins: DataFrame, nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, depth: int = 50) -> DataFrame:
    """(repo_id, origin, direction, steps, exits, max_depth, has_cycles): what `flow_traces` finds from each origin, and whether a cycle lies ahead of it.

    With `types` only nodes of these types are listed and passed; cycles are
    looked for on all edges.
    """
    kept = nodes.filter(F.col("type").isin(types)) if types else nodes
    asked = origins.select(REPO, "node_id").join(kept.select(REPO, "node_id").distinct(), [REPO, "node_id"], "left_semi")
    parts = peeled(edges)
    found = flow_traces(asked, kept, edges, depth, parts=parts).groupBy(REPO, "origin", "direction")
    counts = found.agg(F.count(F.lit(1)).alias("steps"), F.count_if("is_exit").alias("exits"), F.max("depth").alias("max_depth"))
    round_ = leads_to_cycle(nodes, edges, parts).select(REPO, F.col("node_id").alias("origin"), F.lit(True).alias("cyclic"))
    return counts.join(round_, [REPO, "origin"], "left").select(REPO, "origin", "direction", "steps", "exits", "max_depth", F.coalesce("cyclic", F.lit(False)).alias("has_cycles"))


def import_closure(pages: DataFrame, imports: DataFrame, depth: int = 5) -> DataFrame:
    """(repo_id, origin, node_id, depth): files that each page (repo_id, path) reaches by resolved imports."""
    edges = imports.filter("target IS NOT NULL").select(REPO, F.col("path").alias("src"), F.col("target").alias("dst"))
    return reach(pages.select(REPO, F.col("path").alias("origin"), F.col("path").alias("node_id")), edges, depth)


def shared_components(closure: DataFrame) -> DataFrame:
    """(repo_id, node_id, usage_count, used_by): files that several pages reach, one row per page that does."""
    pairs = closure.filter("depth > 0").select(REPO, "node_id", F.col("origin").alias("used_by")).distinct()
    used = pairs.groupBy(REPO, "node_id").agg(F.count(F.lit(1)).alias("usage_count")).filter("usage_count > 1")
    return pairs.join(used, [REPO, "node_id"]).select(REPO, "node_id", "usage_count", "used_by")


def bypass_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, src, dst): views that reach a database in two or three edges without a controller between, and not by one edge."""
    typed = with_types(nodes, edges).select(REPO, "src", "dst", "src_type", "dst_type")
    inner = typed.filter("dst_type <> 'controller'")
    two = inner.filter("src_type = 'view'").select(REPO, "src", F.col("dst").alias("mid"))
    step = typed.filter("src_type <> 'controller'").select(REPO, F.col("src").alias("mid"), F.col("dst").alias("end"), "dst_type")
    second = two.join(step, [REPO, "mid"])
    third = second.filter("dst_type <> 'controller'").select(REPO, "src", F.col("end").alias("mid")).distinct().join(step, [REPO, "mid"])
    found = union([second.filter("dst_type = 'database'").select(REPO, "src", F.col("end").alias("dst")), third.filter("dst_type = 'database'").select(REPO, "src", F.col("end").alias("dst"))]).distinct()
    return found.join(edges.select(REPO, "src", "dst"), [REPO, "src", "dst"], "left_anti")


def cycle_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, cycle): nodes on a cycle, with the smallest node of their strongly connected component.

    Nodes without a way in or out are taken off and unbranched runs are replaced
    by one edge, in turns, which a chain or a tree of n nodes stands only a
    logarithmic number of times; rings drop out as a whole. In what is left the
    smallest node ahead and behind is spread until nothing changes; where both
    agree the component is found and leaves, and the rest starts again. In the
    end the nodes of a run are on a cycle if both its ends are on the same one.
    """
    links = written(edges.filter("src <> dst").select(REPO, "src", "dst").distinct())
    loops = edges.filter("src = dst").select(REPO, F.col("src").alias("node_id")).distinct()
    found: list[DataFrame] = []
    levels: list[tuple[DataFrame, DataFrame]] = []
    while True:
        kept = links.join(links.select(REPO, F.col("dst").alias("src")).distinct(), [REPO, "src"], "left_semi")
        kept = written(kept.join(links.select(REPO, F.col("src").alias("dst")).distinct(), [REPO, "dst"], "left_semi").select(REPO, "src", "dst"))
        left = kept.count()
        raked = left < links.count()
        forget(links)
        links = kept
        if not left:
            break
        inner = _unbranched(links)
        if inner is not None:
            runs, rings = _runs(links, inner)
            found.append(rings)
            levels.append((runs, runs.filter("a = b").select(REPO, F.col("a").alias("node_id")).distinct()))
            on_runs = inner.select(REPO, "node_id")
            rest = links.join(on_runs.withColumnRenamed("node_id", "src"), [REPO, "src"], "left_anti").join(on_runs.withColumnRenamed("node_id", "dst"), [REPO, "dst"], "left_anti")
            kept = written(rest.select(REPO, "src", "dst").unionByName(runs.filter("a <> b").select(REPO, F.col("a").alias("src"), F.col("b").alias("dst"))).distinct())
            forget(links)
            links = kept
        elif not raked:
            forward, backward = _spread(links, "src", "dst"), _spread(links, "dst", "src")
            both = written(forward.join(backward.withColumnRenamed("least", "behind"), [REPO, "node_id"]))
            found.append(both.filter("least = behind").select(REPO, "node_id", F.col("least").alias("cycle")))
            out = both.filter("least = behind").select(REPO, "node_id")
            kept = links.join(out.withColumnRenamed("node_id", "src"), [REPO, "src"], "left_anti")
            kept = written(kept.join(out.withColumnRenamed("node_id", "dst"), [REPO, "dst"], "left_anti").select(REPO, "src", "dst"))
            forget(links)
            links = kept
    known = written(union(found)) if found else None
    for runs, turns in reversed(levels):
        alone = turns.join(known.select(REPO, "node_id"), [REPO, "node_id"], "left_anti").withColumn("cycle", F.col("node_id"))
        known = known.unionByName(alone)
        a = known.select(REPO, F.col("node_id").alias("a"), "cycle")
        b = known.select(REPO, F.col("node_id").alias("b"), F.col("cycle").alias("other"))
        known = written(known.unionByName(runs.join(a, [REPO, "a"]).join(b, [REPO, "b"]).filter("cycle = other").select(REPO, "node_id", "cycle")))
    own = loops.withColumn("loop", F.lit(True))
    if known is None:
        return loops.select(REPO, "node_id", F.col("node_id").alias("cycle"))
    every = known.unionByName(loops.join(known.select(REPO, "node_id"), [REPO, "node_id"], "left_anti").withColumn("cycle", F.col("node_id"))).distinct()
    # components were named by the smallest node that was left at their time
    sizes = every.groupBy(REPO, "cycle").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("least"))
    kept = every.join(sizes, [REPO, "cycle"]).join(own, [REPO, "node_id"], "left").filter("n > 1 OR loop")
    return kept.select(REPO, "node_id", F.col("least").alias("cycle"))


def _unbranched(links: DataFrame) -> DataFrame | None:
    """(repo_id, node_id, next): nodes with one way in and one way out, or None if there are none."""
    out = links.groupBy(REPO, F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("next")).filter("n = 1").drop("n")
    one = links.groupBy(REPO, F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(REPO, "node_id")
    inner = written(out.join(one, [REPO, "node_id"], "left_semi"))
    return None if inner.isEmpty() else inner


def _runs(links: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, node_id, a, b), the nodes of unbranched runs and the branching nodes at their ends, and (repo_id, node_id, cycle), those of rings.

    Every inner node follows its pointer, which doubles its reach each round, to
    the last node of its run. On a ring it never arrives; when the smallest node
    seen changes nowhere any more, it is the ring's.
    """
    target = inner.select(REPO, F.col("node_id").alias("next"), F.lit(True).alias("goes_on"))
    at = inner.join(target, [REPO, "next"], "left")
    ends_here = F.col("goes_on").isNull()
    at = at.select(REPO, "node_id", F.when(~ends_here, F.col("next")).alias("ptr"), F.when(ends_here, F.col("node_id")).alias("last"), F.when(ends_here, F.col("next")).alias("b"), F.col("node_id").alias("least"), (~ends_here).alias("moved"))
    at = written(at)
    while not at.filter("moved").isEmpty():
        seen = at.select(REPO, F.col("node_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("last").alias("last2"), F.col("b").alias("b2"), F.col("least").alias("least2"))
        on = F.col("ptr").isNotNull()
        moved = on & (F.col("ptr2").isNull() | (F.col("least2") < F.col("least")))
        new = at.drop("moved").join(seen, [REPO, "ptr"], "left")
        new = written(new.select(REPO, "node_id", F.when(on, F.col("ptr2")).alias("ptr"), F.coalesce("last", "last2").alias("last"), F.coalesce("b", "b2").alias("b"), F.least("least", F.coalesce("least2", "least")).alias("least"), moved.alias("moved")))
        forget(at)
        at = new
    rings = at.filter("ptr IS NOT NULL").select(REPO, "node_id", F.col("least").alias("cycle"))
    arrived = at.filter("ptr IS NULL").select(REPO, "node_id", "last", "b")
    heads = links.join(inner.select(REPO, F.col("node_id").alias("src")), [REPO, "src"], "left_anti").select(REPO, F.col("src").alias("a"), F.col("dst").alias("node_id"))
    heads = heads.join(arrived, [REPO, "node_id"]).select(REPO, "last", "a")
    return written(arrived.join(heads, [REPO, "last"]).select(REPO, "node_id", "a", "b")), rings


def _spread(links: DataFrame, a: str, b: str) -> DataFrame:
    """(repo_id, node_id, least): the smallest node that each node reaches from a to b, itself included."""
    nodes = links.select(REPO, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    labels = written(nodes.withColumns({"least": F.col("node_id"), "moved": F.lit(True)}))
    while not labels.filter("moved").isEmpty():
        mine = labels.select(REPO, "node_id", "least")
        ahead = links.select(REPO, F.col(a).alias("node_id"), F.col(b).alias("next")).join(mine.select(REPO, F.col("node_id").alias("next"), F.col("least").alias("far")), [REPO, "next"])
        low = ahead.groupBy(REPO, "node_id").agg(F.min("far").alias("far"))
        labels = written(mine.join(low, [REPO, "node_id"], "left").select(REPO, "node_id", F.least("least", F.coalesce("far", "least")).alias("least"), (F.coalesce("far", "least") < F.col("least")).alias("moved")))
    return labels.select(REPO, "node_id", "least")


def dag_share(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, share): the share of nodes that are neither on a cycle nor lead into one."""
    led = leads_to_cycle(nodes, edges).groupBy(REPO).agg(F.count(F.lit(1)).alias("n"))
    return nodes.groupBy(REPO).agg(F.count(F.lit(1)).alias("nodes")).join(led, REPO, "left").select(REPO, F.round(1 - F.coalesce("n", F.lit(0)) / F.col("nodes"), 6).alias("share"))


def execution_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, depth): steps from the entry nodes; -1 where none leads to a node."""
    steps = nearest(entry_points(nodes, edges), edges)
    return nodes.select(REPO, "node_id").join(steps, [REPO, "node_id"], "left").select(REPO, "node_id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def longest_path_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, rank): longest path from a root; nodes on or behind cycles keep what their parents outside give them."""
    layers = written(topo_layers(nodes, edges))
    fixed = layers.filter("layer >= 0").withColumnRenamed("layer", "rank")
    open_ = written(layers.filter("layer < 0").select(REPO, "node_id"))
    into = written(edges.select(REPO, "src", F.col("dst").alias("node_id")).join(open_, [REPO, "node_id"], "left_semi").distinct())
    given = into.join(fixed.withColumnRenamed("node_id", "src"), [REPO, "src"]).groupBy(REPO, "node_id").agg((F.max("rank") + 1).alias("rank"))
    rest = open_.join(given, [REPO, "node_id"], "left").select(REPO, "node_id", F.coalesce("rank", F.lit(0)).alias("rank"))
    return fixed.unionByName(rest)


def cascade_delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch a deleted node (repo_id, node_id)."""
    out = edges.join(gone.select(REPO, F.col("node_id").alias("src")), [REPO, "src"], "left_anti")
    return out.join(gone.select(REPO, F.col("node_id").alias("dst")), [REPO, "dst"], "left_anti").select(REPO, "src", "dst", "kind")


def delete_sections(homes: DataFrame, gone: DataFrame) -> DataFrame:
    """(repo_id, node_id, section_id): `homes` after the deletion of sections (repo_id, section_id); their members stay and have none."""
    deleted = gone.select(REPO, "section_id", F.lit(True).alias("deleted")).distinct()
    return homes.join(deleted, [REPO, "section_id"], "left").select(REPO, "node_id", F.when(F.col("deleted").isNull(), F.col("section_id")).alias("section_id"))


def remap_endpoints(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with their ends replaced through (repo_id, label, node_id); those with an unknown end go."""
    a = ids.select(REPO, F.col("label").alias("src"), F.col("node_id").alias("new_src"))
    b = ids.select(REPO, F.col("label").alias("dst"), F.col("node_id").alias("new_dst"))
    return edges.join(a, [REPO, "src"]).join(b, [REPO, "dst"]).select(REPO, F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def portal_links(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """(repo_id, src, dst, src_section, dst_section): edges between different sections (repo_id, node_id, section_id)."""
    a = homes.select(REPO, F.col("node_id").alias("src"), F.col("section_id").alias("src_section"))
    b = homes.select(REPO, F.col("node_id").alias("dst"), F.col("section_id").alias("dst_section"))
    return edges.join(a, [REPO, "src"]).join(b, [REPO, "dst"]).filter("src_section <> dst_section").select(REPO, "src", "dst", "src_section", "dst_section")


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, kind, severity, node_id): god classes, oversized files, bypasses, gaps and orphans as one table."""
    typed = written(with_types(nodes, edges).filter("src_type = 'view' OR dst_type = 'view'").select(REPO, "src", "dst", "src_type", "dst_type"))
    parts = [
        god_classes(nodes, edges).select(REPO, F.lit("god-class").alias("kind"), "severity", "node_id"),
        oversized_files(nodes, edges).select(REPO, F.lit("oversized-file").alias("kind"), "severity", "node_id"),
        view_db_bypass(nodes, edges, typed).select(REPO, F.lit("view-to-db").alias("kind"), F.lit("high").alias("severity"), F.col("src").alias("node_id")),
        missing_validation(nodes, edges, typed).select(REPO, F.lit("missing-validation").alias("kind"), F.lit("medium").alias("severity"), F.col("src").alias("node_id")),
        orphan_nodes(nodes, edges).select(REPO, F.lit("orphan").alias("kind"), F.lit("low").alias("severity"), "node_id"),
    ]
    return union(parts)


def all_paths(pairs: DataFrame, edges: DataFrame, most: int = 10, depth: int = 50) -> DataFrame:
    """(repo_id, origin, target, path): simple paths between pairs of nodes (repo_id, origin, target), the shortest and first `most`.

    Only nodes that lie between the two, ahead of the one and behind the other,
    are walked, so a path that can't arrive is never begun. The search behind
    the targets takes only edges that lie ahead of some origin.
    """
    key = [REPO, "origin"]
    asked = written(pairs.select(*key, "target").distinct())
    starts = asked.select(REPO, F.lit("ahead").alias("origin"), F.col("origin").alias("node_id"))
    ahead = reach_over(starts, edges, depth - 1).select(REPO, F.col("node_id").alias("src"))
    step = written(edges.select(REPO, "src", "dst").join(ahead, [REPO, "src"], "left_semi").distinct())
    behind = reach_over(asked.select(REPO, F.col("target").alias("origin"), F.col("target").alias("node_id")), step, depth, backward=True)
    between = written(behind.select(REPO, F.col("origin").alias("target"), F.col("node_id").alias("dst")))
    front = written(asked.withColumns({"node_id": F.col("origin"), "path": F.array("origin")}))
    done = []
    for _ in range(depth):
        near = front.join(step.withColumnRenamed("src", "node_id"), [REPO, "node_id"]).filter(~F.array_contains("path", F.col("dst")))
        near = near.join(between, [REPO, "target", "dst"], "left_semi").select(*key, "target", F.col("dst").alias("node_id"), F.array_append("path", F.col("dst")).alias("path"))
        front = written(near)
        if front.isEmpty():
            break
        done.append(front.filter("node_id = target"))
        front = front.filter("node_id <> target")
    if not done:
        return asked.select(*key, "target", F.lit(None).cast("array<string>").alias("path")).limit(0)
    ranked = union(done).withColumn("k", F.expr("row_number() OVER (PARTITION BY repo_id, origin, target ORDER BY size(path), path)"))
    return ranked.filter(F.col("k") <= most).select(*key, "target", F.array_join("path", ">").alias("path"))


def deep_chains(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(repo_id, node_id, depth): nodes below which calls and references go deeper than `most`; those on or before cycles are left out."""
    calls = edges.filter("kind IN ('call', 'reference', 'query') AND src <> dst").select(REPO, F.col("dst").alias("src"), F.col("src").alias("dst"))
    deep = layered(calls.select(REPO, F.col("src").alias("node_id")), calls)[0].filter(F.col("layer") > most)
    return deep.join(nodes, [REPO, "node_id"], "left_semi").select(REPO, "node_id", F.col("layer").cast("int").alias("depth"))


def unvalidated_controllers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, path): controllers that a view reaches by one edge, or by two over a node that is no validation; the first such path."""
    typed = with_types(nodes, edges).filter("dst_type <> 'validation'").select(REPO, "src", "dst", "src_type", "dst_type")
    one = typed.filter("src_type = 'view' AND dst_type = 'controller'").select(REPO, F.col("dst").alias("node_id"), F.lit(1).alias("hops"), F.concat_ws(">", "src", "dst").alias("path"))
    first = typed.filter("src_type = 'view'").select(REPO, "src", F.col("dst").alias("mid"))
    second = typed.filter("dst_type = 'controller' AND src_type <> 'validation'").select(REPO, F.col("src").alias("mid"), "dst")
    # the smallest view of each middle node is enough for the smallest path
    two = first.groupBy(REPO, "mid").agg(F.min("src").alias("src")).join(second, [REPO, "mid"]).select(REPO, F.col("dst").alias("node_id"), F.lit(2).alias("hops"), F.concat_ws(">", "src", "mid", "dst").alias("path"))
    best = union([one, two]).groupBy(REPO, "node_id").agg(F.min(F.struct("hops", "path")).alias("b"))
    return best.select(REPO, "node_id", "b.path")


def connected_set(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, origin, node_id): all nodes joined to an asked one (repo_id, node_id) by any path, direction ignored."""
    labels = written(components(nodes, edges))
    own = asked.select(REPO, F.col("node_id").alias("origin")).join(labels.withColumnRenamed("node_id", "origin"), [REPO, "origin"])
    return own.join(labels, [REPO, "component"]).select(REPO, "origin", "node_id")


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, lacks, nearest): nodes without a way in or out, and the x of the nearest column before or after them."""
    columns = nodes.select(REPO, F.col("x").cast("long").alias("col")).distinct()
    rows = union([entry_points(nodes, edges).select(REPO, "node_id", F.lit("in").alias("lacks")), exit_points(nodes, edges).select(REPO, "node_id", F.lit("out").alias("lacks"))])
    placed = rows.join(nodes.select(REPO, "node_id", F.col("x").cast("long").alias("col")), [REPO, "node_id"])
    after = written(following(columns, [REPO], ["col"], "col", "nearest"))
    beside = after.withColumn("lacks", F.lit("out")).unionByName(after.select(REPO, F.col("nearest").alias("col"), F.col("col").alias("nearest"), F.lit("in").alias("lacks")))
    return placed.join(beside, [REPO, "col", "lacks"], "left").select(REPO, "node_id", "lacks", "nearest")


def bridges(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """(repo_id, src, dst, kind): the first edge of each pair of sections goes over a bridge node; the others stay."""
    a = homes.select(REPO, F.col("node_id").alias("src"), F.col("section_id").alias("a"))
    b = homes.select(REPO, F.col("node_id").alias("dst"), F.col("section_id").alias("b"))
    crossing = edges.join(a, [REPO, "src"]).join(b, [REPO, "dst"]).filter("a <> b")
    first = crossing.groupBy(REPO, "a", "b").agg(F.min(F.struct("src", "dst", "kind")).alias("e")).select(REPO, "e.*", F.concat_ws(":", F.lit("bridge"), "a", "b").alias("bridge"))
    over = union([first.select(REPO, "src", F.col("bridge").alias("dst"), F.lit("bridge").alias("kind")), first.select(REPO, F.col("bridge").alias("src"), "dst", F.lit("bridge").alias("kind"))])
    kept = edges.join(first.select(REPO, "src", "dst", "kind"), [REPO, "src", "dst", "kind"], "left_anti").select(REPO, "src", "dst", "kind")
    return union([kept, over])


# Controllers that sign users in, and the role that a route belongs to.
SIGN_IN = r"(?i)/api/auth/(login|signin|authenticate)|/auth/login|/login|/signin"
ROLES = [("manager", "(?i)manager|admin"), ("customer", "(?i)customer|user"), ("staff", "(?i)staff|employee")]


def role_gateways(nodes: DataFrame, edges: DataFrame, sign_in: str = SIGN_IN, roles: list[tuple[str, str]] = ROLES) -> DataFrame:  # noqa: B006
    """(repo_id, node_id, roles): controllers that sign users in and lead to views of two or more roles, joined by commas."""
    doors = nodes.filter((F.col("type") == "controller") & F.col("label").rlike(sign_in)).select(REPO, F.col("node_id").alias("src"))
    role = F.coalesce(*[F.when(F.col("label").rlike(p), r) for r, p in roles])
    views = nodes.filter("type = 'view'").select(REPO, F.col("node_id").alias("dst"), role.alias("role")).filter("role IS NOT NULL")
    led = edges.join(doors, [REPO, "src"]).join(views, [REPO, "dst"]).groupBy(REPO, F.col("src").alias("node_id")).agg(F.sort_array(F.collect_set("role")).alias("roles"))
    return led.filter(F.size("roles") >= 2).select(REPO, "node_id", F.array_join("roles", ",").alias("roles"))


def validate_graph(nodes: DataFrame, edges: DataFrame, sensitive: Column, guard: Column, depth: int = 10) -> DataFrame:
    """(repo_id, kind, severity, node_id): cycles, deep chains, missing guards and missing validation as one table; errors make a graph invalid."""
    # one peeling for the cycles, which lie in what stays, and for both searches
    peels = peeled(edges)
    parts = [
        cycle_nodes(nodes, peels[0]).select(REPO, F.lit("circular-dependency").alias("kind"), F.lit("error").alias("severity"), "node_id"),
        deep_chains(nodes, edges, depth).select(REPO, F.lit("deep-call-chain").alias("kind"), F.lit("warning").alias("severity"), "node_id"),
        gaps(nodes, edges, sensitive, guard, parts=peels).select(REPO, F.lit("missing-auth").alias("kind"), F.lit("error").alias("severity"), "node_id"),
        gaps(nodes, edges, sensitive, F.col("type") == "validation", parts=peels).select(REPO, F.lit("missing-validation").alias("kind"), F.lit("warning").alias("severity"), "node_id"),
    ]
    return union(parts)


def issues_by_node(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node_id, kind, severity, role): each issue at its subject and at the nodes that the subject leads to (impacted)."""
    # a view has an issue for each of its edges; once is enough before it meets all of them again
    found = written(found.select(REPO, "node_id", "kind", "severity").distinct())
    own = found.withColumn("role", F.lit("subject"))
    ahead = edges.select(REPO, F.col("src").alias("node_id"), "dst")
    led = found.join(ahead, [REPO, "node_id"]).select(REPO, F.col("dst").alias("node_id"), "kind", "severity", F.lit("impacted").alias("role"))
    return union([own, led]).distinct()
